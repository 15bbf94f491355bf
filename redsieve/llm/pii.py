"""Sanitising personal data by what terms reveal about it.

First the entities: e-mail and IP addresses, card and phone numbers, by pattern
and check digits, leftmost and non-overlapping for each kind. Then the method:
terms of a document that holds an entity are weighed by how much they disclose of it. With
counts N, n(e), n(t) and n(t, e) of documents, all of whole texts and of rows,

    PMI(t, e) = log(N n(t, e) / (n(t) n(e))),    IC(e) = log(N / n(e)),

and PMI / IC, at most 1, is the share of the entity's information that the term
gives away: 1 when every document with the term has the entity. A term at or over
DISCLOSE is generalised wherever it stands in a document with that entity, one at or over
REMOVE is removed. It needs two different texts as evidence, as in a single one any rare
word would seem to reveal it. Documents without an entity are left alone.

All of it is DataFrame expressions. Documents with an entity are written once; their
terms are paired with those of their entities that other texts hold too, and summed before
the shuffle. Matches and words become rows, of which a running sum of lengths gives the
offsets. Of the rest of the corpus only counts of terms are shuffled.

Defined results: null text is empty and gives the digest of an empty string;
offsets count code points; rows that share doc_id and text share one result, but count each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import settle

#: In the order in which kinds are listed. \G goes on where the last match ended; otherwise a match starts where its
#: first run starts, so a long run is read once. Possessive repetition never goes back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: A cheap test that a text with a match of the kind passes.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MIN_TERM = 4
TERM = r"\p{L}{%d,}" % MIN_TERM
DISCLOSE = 0.9
REMOVE = 0.97
#: Up to so many terms, or keys of entities, a copy of them goes to each executor; beyond, terms are counted first and joined then.
FEW_TERMS = 100_000


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split(value, "\\."), lambda o: F.coalesce(F.regexp_replace(o, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _hinted(kind: str) -> Column:
    hint = HINTS[kind]
    if hint is None:
        return F.col("text").rlike("[0-9](?:[ -]?[0-9]){11}")
    return F.contains("text", F.lit(hint)) & F.col("text").rlike("[0-9]" if kind != "email" else "@[A-Za-z0-9-]")


def _matches(kind: str) -> Column:
    return F.when(_hinted(kind), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def holders(documents: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), text, m_<kind> (matches, valid or not), es (kind and value of each valid entity, once): rows with an entity."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    found = docs.select("*", *(_matches(k).alias(f"m_{k}") for k in KINDS)).where(" or ".join(f"size(m_{k}) > 0" for k in KINDS))
    sound = lambda o, k: F.transform(F.filter(f"m_{k}", lambda v: _valid(F.lit(k), v)), lambda v: F.concat(F.lit(f"{o}:"), F.lower(v)))
    return found.withColumn("es", F.array_distinct(F.concat(*(sound(o, k) for o, k in enumerate(KINDS))))).where("size(es) > 0")


def _steps(order: int, kind: str) -> Column:
    """The matches of a kind, each with the length of what lies before it."""
    zipped = F.arrays_zip(F.col(f"m_{kind}").alias("value"), F.slice(f"g_{kind}", 1, F.size(f"m_{kind}")).alias("gap"))
    return F.transform(zipped, lambda z, i: F.struct(F.lit(order).alias("k"), i.alias("i"), F.length(z["gap"]).alias("skip"), z["value"].alias("value")))


def _placed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, i, skip, value) with start and end: the i-th value of its keys stands skip behind the one before."""
    so_far = Window.partitionBy(*keys).orderBy("i")
    end = F.sum(F.col("skip") + F.length("value")).over(so_far).cast("long")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def entity_spans(held: DataFrame) -> DataFrame:
    """doc_id, t, start, end, k (place in KINDS), value: every entity that is valid, of holders()."""
    empty = F.array().cast("array<string>")
    # the text between matches, from which offsets follow
    gaps = held.select("doc_id", "t", *(f"m_{k}" for k in KINDS), *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(empty).alias(f"g_{k}") for k, p in PATTERNS.items()))
    each = F.flatten(F.array(*(_steps(o, k) for o, k in enumerate(KINDS))))
    rows = gaps.select("doc_id", "t", F.explode(each).alias("x")).select("doc_id", "t", "x.*").distinct()
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    return _placed(rows, "doc_id", "t", "k").where(_valid(kind, F.col("value"))).select("doc_id", "t", "start", "end", "k", "value")


def _few(keys: DataFrame) -> bool:
    return keys.limit(FEW_TERMS + 1).count() <= FEW_TERMS


def disclosing_terms(documents: DataFrame, held: DataFrame) -> DataFrame:
    """e, term, share: terms that give away at least DISCLOSE of an entity; held is holders(documents)."""
    entities = held.select("t", F.explode("es").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    entities = settle(entities.where("lo < hi").select("e", "n_e"), "shared-entities")
    each = held.select("t", "text", F.explode("es").alias("e"))
    if not _few(entities):
        # rows meet their entities without their texts first, and only those that share one take their text along
        mine = held.select("doc_id", "t", F.explode("es").alias("e")).join(entities.select("e"), "e").select("doc_id", "t", "e").distinct()
        rows = held.select(F.col("doc_id").alias("d"), F.col("t").alias("of"), "text")
        each = rows.join(mine, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("t"))).select("t", "text", "e")
    else:
        each = each.join(F.broadcast(entities.select("e")), "e", "left_semi")
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    pairs = each.select("t", "e", F.explode(terms).alias("term")).groupBy("e", "term").agg(F.count(F.lit(1)).alias("n_te"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    pairs = settle(pairs.where("lo < hi").select("e", "term", "n_te"), "pairs")
    wanted = settle(pairs.select("term").distinct(), "terms")
    words = documents.select(F.explode(terms).alias("term"))
    if _few(wanted):
        n_t = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    else:
        n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term", "left_semi")
    n = documents.count()
    pmi = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    # an entity in every document has no information that a term could give away
    shared = pairs.join(n_t, "term").join(entities, "e").withColumn("share", F.when(F.col("n_e") < n, pmi / ic))
    return shared.where(F.col("share") >= DISCLOSE).select("e", "term", "share")


def _term_spans(held: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, t, start, end, share: every place of a telling term in a document with the entity it tells of."""
    of = held.select("doc_id", "t", F.explode("es").alias("e")).distinct().join(telling, "e").groupBy("doc_id", "t", "term").agg(F.max("share").alias("share"))
    of = settle(of, "told")
    texts = of.groupBy("doc_id", "t").agg(F.collect_set("term").alias("terms"))
    rows = held.select(F.col("doc_id").alias("d"), F.col("t").alias("of"), "text")
    here = rows.join(texts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("t"))).select("doc_id", "t", "terms", "text")
    # the pattern of whole words: what is lower-cased is compared, what is placed is the word as it stands
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("value"), F.split("text", TERM, -1).alias("gap"))
    words = here.select("doc_id", "t", F.posexplode(zipped).alias("i", "x")).where("x.value is not null").select("doc_id", "t", "i", F.length("x.gap").alias("skip"), "x.value").distinct()
    placed = _placed(words, "doc_id", "t").select(F.col("doc_id").alias("d"), F.col("t").alias("of"), "start", "end", F.lower("value").alias("word"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("t")) & (F.col("word") == F.col("term"))
    return placed.join(of, same).select("doc_id", "t", "start", "end", "share")


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, t, start, end, k, kind, share: entities, and the terms that disclose them (k = number of kinds)."""
    held = settle(holders(documents), "holders")
    found = settle(entity_spans(held), "entities")
    telling = settle(disclosing_terms(documents, held), "disclosing")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    base = found.select("doc_id", "t", "start", "end", "k", kind.alias("kind"), F.lit(1.0).alias("share"))
    inside = _term_spans(held, telling).alias("x").join(
        found.select("doc_id", "t", F.col("start").alias("s"), F.col("end").alias("n")).alias("y"),
        F.expr("x.doc_id <=> y.doc_id and x.t = y.t and x.start < y.n and y.s < x.end"),
        "left_anti",
    )
    return base.unionByName(inside.select("doc_id", "t", "start", "end", F.lit(len(KINDS)).alias("k"), F.lit("term").alias("kind"), "share"))


def _label(kind: Column, share: Column) -> Column:
    return F.when(kind != "term", F.concat(F.lit("["), F.upper(kind), F.lit("]"))).when(share >= REMOVE, "").otherwise("[TERM]")


def sanitise(documents: DataFrame) -> DataFrame:
    """The documents with what spans() finds generalised or removed; overlapping spans become the first of them."""
    found = (
        spans(documents)
        .groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_of"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", _label(F.col("kind"), F.col("share")).alias("label")))).alias("_s"))
    )
    docs = documents.withColumn("_t", F.xxhash64("text"))
    both = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_of")), "left")
    # keep a span that starts after all before it have ended
    ends = F.transform("_s", lambda x, i: F.array_max(F.transform(F.slice(F.col("_s"), 1, i), lambda y: y["end"])))
    clear = F.filter(F.arrays_zip(F.col("_s").alias("s"), ends.alias("e")), lambda z: z["e"].isNull() | (z["e"] <= z["s"]["start"]))
    both = both.withColumn("_c", F.transform(clear, lambda z: z["s"]))
    pieces = F.transform(
        "_c",
        lambda x, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, F.lit(0)).otherwise(F.element_at("_c", F.greatest(i, F.lit(1)))["end"]).cast("int") + 1, (x["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("_c", F.greatest(i, F.lit(1)))["end"])).cast("int")),
            x["label"],
        ),
    )
    tail = F.substring(F.col("text"), (F.element_at("_c", -1)["end"]).cast("int") + 1, F.length("text"))
    text = F.when(F.size("_s") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return both.withColumn("text", text).select(*documents.columns)


def _count(order: int) -> Column:
    return F.size(F.filter("s", lambda x: x["k"] == order)).cast("long")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row for each row of documents."""
    listed = lambda only: F.array_join(
        F.transform(F.filter("s", lambda x: x["k"] < len(KINDS)) if only else F.col("s"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    found = (
        spans(documents)
        .groupBy(F.col("doc_id").alias("d"), "t")
        .agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("s"))
        .select("d", "t", *(_count(o).alias(f"n_{k}") for o, k in enumerate(KINDS)), listed(True).alias("base"), listed(False).alias("spans"))
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_t"))
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t")), "left")
    return both.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
