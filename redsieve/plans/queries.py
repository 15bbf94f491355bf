"""The queries that the driver runs for the engine's own operators.

Where the driver's tables hold no value of a type, text is made from TPC-H columns by
SQL expressions that both engines share (TEXTS).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx
from ..functions import surrogates as S
from ..functions.scalars import hash64, luhn, normalise, verhoeff
from ..operators import contextual, evaluate, harvest
from ..operators import names as N
from ..operators import redact as R
from ..operators.resolve import resolve
from ..operators.structured import SPAN, SPECS, recognise
from ..sources.sinks import audit_json
from .config import RedactionConfig

_BY_TYPE = {s.pii_type: s for s in SPECS}
#: Letters for digits, so that keys can stand in names.
LETTERS = "translate(cast({0} as string), '0123456789', 'abcdefghij')"


def _word(key: str) -> str:
    """A capitalised word from a key."""
    return "'Q' || " + LETTERS.format(key)


#: name -> (table, key, text): text that is made the same way here and in SQL.
TEXTS = {
    "ssn": ("orders", "o_orderkey", "'Ref SSN ' || lpad(cast(o_orderkey % 1000 as string), 3, '0') || '-' || lpad(cast(o_custkey % 100 as string), 2, '0') || '-' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || ' on file.'"),
    "pan": ("orders", "o_orderkey", "'PAN ABCDE' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || case when o_orderkey % 3 = 0 then 'k' else 'K' end || ' filed'"),
    "aadhaar": ("orders", "o_orderkey", "'Id ' || lpad(cast((o_orderkey * 7919 + 2340) % 10000 as string), 4, '0') || ' ' || lpad(cast(o_custkey % 10000 as string), 4, '0') || ' ' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || ' given'"),
    "din": ("orders", "o_orderkey", "case when o_orderkey % 2 = 0 then 'DIN: ' else 'Code ' end || lpad(cast(o_orderkey % 100000000 as string), 8, '0')"),
    "cin": ("orders", "o_orderkey", "'CIN U' || lpad(cast(o_custkey % 100000 as string), 5, '0') || 'MH' || '1999' || 'PLC' || lpad(cast(o_orderkey % 1000000 as string), case when o_orderkey % 5 = 0 then 5 else 6 end, '0') || ' ok'"),
    "bank": ("orders", "o_orderkey", "case when o_orderkey % 2 = 0 then 'Account no. ' else 'Invoice ' end || lpad(cast(o_orderkey as string), 12, '7')"),
    "dob": ("orders", "o_orderkey", "case when o_orderkey % 2 = 0 then 'Date of birth ' else 'Shipped ' end || lpad(cast(1 + o_orderkey % 28 as string), 2, '0') || '/' || lpad(cast(1 + o_custkey % 12 as string), 2, '0') || '/' || cast(1950 + o_custkey % 50 as string) || ' noted'"),
    "person": ("customer", "c_custkey", f"'Mr. ' || {_word('c_custkey')} || ' ' || {_word('c_nationkey + 1000')} || ' attended.'"),
    "role": ("customer", "c_custkey", f"'With us ' || {_word('c_custkey')} || ' ' || {_word('c_nationkey + 1000')} || ', Chief Executive Officer, spoke.'"),
    "label": ("customer", "c_custkey", f"'OUR PROMOTERS: ' || {_word('c_custkey')} || ' ' || {_word('c_nationkey + 1000')} || ', ' || {_word('c_custkey')} || ' ' || {_word('c_nationkey + 2000')}"),
    "cell": ("customer", "c_custkey", f"{_word('c_custkey')} || ' ' || {_word('c_nationkey + 1000')}"),
    "mail": ("customer", "c_custkey", f"'Write to ' || lower({_word('c_custkey')}) || case when c_custkey % 4 = 0 then '' else '.' || lower({_word('c_nationkey + 1000')}) end || '7@example.com now'"),
    "org": ("supplier", "s_suppkey", f"'Signed by ' || {_word('s_suppkey')} || ' ' || {_word('s_nationkey + 1000')} || case when s_suppkey % 3 = 0 then ' Private Limited' when s_suppkey % 3 = 1 then ' Limited' else ' Bank' end || ' today'"),
    "address": ("supplier", "s_suppkey", f"'Goods are kept here: Plot ' || cast(s_suppkey as string) || ', Sector ' || cast(s_nationkey as string) || ', ' || {_word('s_suppkey')} || ' - ' || lpad(cast(100000 + s_suppkey % 900000 as string), 6, '0') || case when s_suppkey % 2 = 0 then ', Maharashtra, India' else '' end"),
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. One of texts in so few pieces that cores would be idle, such as a single file with one row group, is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def text_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """id, text."""
    table, key, text = TEXTS[name]
    return _read(spark, sf_dir, table).selectExpr(f"cast({key} as bigint) as id", f"{text} as text")


def _rows(df: DataFrame, spans: Column, *ids: str) -> DataFrame:
    """A row for each span."""
    return df.select(*ids, F.inline(spans)).select(*ids, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("surface"))


def _spans_in(table: str, key: str, column: str, pii_type: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table).select(F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
        return _rows(df, recognise("text", _BY_TYPE[pii_type]), "id")

    return query


def _spans_of_text(name: str, pii_type: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(text_of(spark, sf_dir, name), recognise("text", _BY_TYPE[pii_type]), "id")

    return query


def email_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "documents").select("lang", F.size(recognise("text", _BY_TYPE["EMAIL"])).alias("n"))
    return df.groupBy("lang").agg(F.sum("n").cast("long").alias("n_emails"), F.count(F.lit(1)).alias("n_docs"))


def luhn_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "lpad(cast(o_orderkey as string), 10, '4') || lpad(cast(o_custkey as string), 6, '0')"
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"{number} as number").select("id", luhn("number").alias("valid"))


def verhoeff_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "lpad(cast((o_orderkey * 7919 + 2340) % 10000 as string), 4, '0') || lpad(cast(o_custkey % 10000 as string), 4, '0') || lpad(cast(o_orderkey % 10000 as string), 4, '0')"
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"{number} as number").select("id", verhoeff("number").alias("valid"))


#: type -> (table, key, value): what surrogates are made for.
SURROGATES = {
    "PERSON": ("customer", "c_custkey", "case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then 'Ann ' || c_name else upper('Ann B ' || c_name) end"),
    "EMAIL": ("customer", "c_custkey", "'ann.' || lower(c_name) || '@example.com'"),
    "PHONE": ("customer", "c_custkey", "case when c_custkey % 2 = 0 then '+91 ' else '022-' end || lpad(cast(c_custkey as string), 8, '3')"),
    "ORGANISATION": ("supplier", "s_suppkey", "s_name || case when s_suppkey % 3 = 0 then ' Private Limited' when s_suppkey % 3 = 1 then ' LLP' else ' Group' end"),
    "ADDRESS": ("supplier", "s_suppkey", "'Plot ' || cast(s_suppkey as string) || ', Pune'"),
    "SSN": ("customer", "c_custkey", "'452-11-' || lpad(cast(c_custkey % 10000 as string), 4, '0')"),
    "CREDIT_CARD": ("customer", "c_custkey", "'4539 1488 ' || lpad(cast(c_custkey as string), 8, '0')"),
    "DATE_OF_BIRTH": ("customer", "c_custkey", "case when c_custkey % 3 = 0 then '14/03/' when c_custkey % 3 = 1 then '14-03-' else 'March 7, ' end || cast(1950 + c_custkey % 50 as string)"),
    "IP_ADDRESS": ("customer", "c_custkey", "case when c_custkey % 2 = 0 then '10.0.0.' || cast(c_custkey % 256 as string) else '2001:db8:' || cast(c_custkey as string) end"),
    "PAN": ("customer", "c_custkey", "'ABCDE' || lpad(cast(c_custkey % 10000 as string), 4, '0') || 'K'"),
    "AADHAAR": ("customer", "c_custkey", "'2340 1234 ' || lpad(cast(c_custkey % 10000 as string), 4, '0')"),
    "DIN": ("customer", "c_custkey", "lpad(cast(c_custkey as string), 8, '0')"),
    "CIN": ("customer", "c_custkey", "'U12345MH1999PLC' || lpad(cast(c_custkey % 1000000 as string), 6, '0')"),
    "BANK_ACCOUNT": ("customer", "c_custkey", "lpad(cast(c_custkey as string), 12, '7')"),
    "WEBSITE": ("supplier", "s_suppkey", "case when s_suppkey % 2 = 0 then 'https://' else 'www.' end || lower(s_name) || '.com'"),
}


def _surrogate(pii_type: str):
    table, key, value = SURROGATES[pii_type]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table).selectExpr(f"cast({key} as bigint) as id", f"{value} as value")
        return df.select("id", S.surrogate_of(pii_type, F.col("value")).alias("surrogate"))

    return query


def hash64_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hash64(normalise("c_name"), S.SALT)
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (h % 1000).cast("long").alias("bucket"))


def _harvested(name: str, channel):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return text_of(spark, sf_dir, name).select("id", F.explode(channel(F.col("text"))).alias("name")).distinct()

    return query


def harvest_short_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_of(spark, sf_dir, "cell").withColumn("context", F.concat(F.lit("NAME | ROLE | "), F.col("text"), F.when(F.col("id") % 2 == 0, " | Managing Director").otherwise(" | x")))
    return df.select("id", F.explode(harvest.by_short_block(F.col("text"), F.col("context"))).alias("name"))


def _scoped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_of(spark, sf_dir, name).select(F.col("id").cast("string").alias("scope"), "id", "text")


def harvest_org_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.org_names(_scoped(spark, sf_dir, "org")).select(F.col("scope").cast("long").alias("id"), "name")


def person_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.person_variants(harvest.person_names(_scoped(spark, sf_dir, "person"))).select(F.col("scope").cast("long").alias("id"), "name")


def surname_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as string) as scope", f"{TEXTS['person'][2]} as text")
    return harvest.surname_families(harvest.person_names(rows)).select(F.col("scope").cast("long").alias("nation"), "surname")


def _nation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strong mention of each supplier's head, and a bare one of the same name, in the scope of the supplier's key."""
    who = f"{_word('s_suppkey')} || ' ' || {_word('s_nationkey + 1000')}"
    both = "array('Dr. ' || who || ' chairs.', 'Later ' || upper(who) || ' and ' || who || ' left.')"
    return _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", f"{who} as who").selectExpr("id", f"posexplode({both}) as (block, text)")


def propagate_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.detect(_nation_blocks(spark, sf_dir), scope="id", config=RedactionConfig(types=("PERSON",)))
    return _rows(found.withColumn("block", F.col("block").cast("long")), F.col("spans"), "id", "block")


def propagate_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _nation_blocks(spark, sf_dir).withColumn("scope", F.col("id").cast("string"))
    found = harvest.propagate_by_words(blocks, harvest.person_names(blocks))
    return found.select("id", F.col("block").cast("long").alias("block"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def propagate_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.detect(text_of(spark, sf_dir, "org"), scope="id", config=RedactionConfig(types=("ORGANISATION",)))
    return _rows(found, F.col("spans"), "id")


def surname_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", f"{_word('s_nationkey + 1000')} as surname")
    pattern = F.concat(F.lit(r"(?U)\b(?:(?:[A-Z][A-Za-z'\-]{1,20}|[A-Z])\.?\s+){1,3}(?i:"), F.col("surname"), F.lit(r")\b"))
    df = df.select("id", F.concat(F.lit("Sold to Anil "), F.col("surname"), F.lit(" there")).alias("text"), pattern.alias("surname_re"))
    return _rows(df, contextual.by_surname("text", "surname_re"), "id")


def address_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(text_of(spark, sf_dir, "address"), contextual.addresses("text"), "id")


def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = "case s_suppkey % 4 when 0 then 'Reserve Bank of India' when 1 then 'BSE Limited' else s_name || ' Limited' end"
    return _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", f"{phrase} as phrase").where(~N.is_public_body(F.col("phrase")))


def legislation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = "case s_suppkey % 3 when 0 then 'Companies Act, 2013' when 1 then 'Listing Rules Limited' else s_name || ' Limited' end"
    return _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", f"{phrase} as phrase").select("id", N.is_legislation(F.col("phrase")).alias("legislation"))


def name_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = f"case c_custkey % 5 when 0 then {_word('c_custkey')} || ' Rao' when 1 then 'Equity ' || {_word('c_custkey')} when 2 then 'A. B.' when 3 then {_word('c_custkey')} else 'B. ' || {_word('c_custkey')} || ' Rao' end"
    return _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", f"{phrase} as phrase").select("id", N.is_name_like(F.col("phrase")).alias("name_like"))


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as id",
        "cast(l_partkey % 50 as int) as start",
        "cast(l_partkey % 50 + 1 + l_quantity as int) as `end`",
        "cast(l_linenumber as string) as text",
        "0.5D as score",
    )
    each = F.struct("start", "end", F.lit("PERSON").alias("pii_type"), "text", "score", F.lit("x").alias("source"))
    listed = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("text", each.alias("s")))), lambda x: x["s"]).cast(SPAN).alias("spans"))
    return _rows(listed, resolve(F.col("spans")), "id")


_SLICE = RedactionConfig(types=("EMAIL", "IP_ADDRESS"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = R.redact(_read(spark, sf_dir, "documents").select("doc_id", "text"), config=_SLICE).where("size(spans) > 0")
    return done.select("doc_id", "redacted", F.size("spans").cast("long").alias("n_entities"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(R.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"), config=_SLICE))


def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"), config=_SLICE)
    return R.mapping(found, ("doc_id",), _SLICE)


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recogniser over every document, each a scope of its own."""
    found = R.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return R.exploded(found, "doc_id").select("doc_id", "start", "end", "pii_type", F.col("text").alias("surface"), "score", "source")


def audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_json(R.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"), config=_SLICE), _SLICE)


def type_filter_exposes_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of an organisation inside an address: with addresses off, the organisation surfaces."""
    rows = _read(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as bigint) as id", "case when s_suppkey % 2 = 0 then array('ADDRESS', 'ORGANISATION') else array('ORGANISATION') end as types"
    )
    one = lambda a, b, t, score: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("pii_type"), F.lit(t).alias("text"), F.lit(score).alias("score"), F.lit("x").alias("source"))
    spans = F.array(one(0, 20, "ADDRESS", 0.8), one(5, 10, "ORGANISATION", 0.99)).cast(SPAN)
    return _rows(rows, resolve(F.filter(spans, lambda s: F.array_contains("types", s["pii_type"]))), "id")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted spans from keys: every third prediction is shifted, every fifth is missing, every seventh of another type."""
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderpriority as stratum", "'aaaa bbbb cccc dddd eeee' as text")
    gold = "array(named_struct('start', 0, 'end', 4, 'label', 'PERSON', 'text', 'aaaa'), named_struct('start', 10, 'end', 14, 'label', 'EMAIL', 'text', 'cccc'))"
    pred = (
        "filter(array(named_struct('start', cast(case when id % 3 = 0 then 1 else 0 end as int), 'end', 4, 'label', case when id % 7 = 0 then 'PHONE' else 'PERSON' end, 'text', 'aaaa'), "
        "named_struct('start', 10, 'end', 14, 'label', 'EMAIL', 'text', 'cccc')), x -> x.label != 'EMAIL' or id % 5 != 0)"
    )
    return rows.selectExpr("id", "stratum", "text", f"{gold} as gold", f"{pred} as pred")


def eval_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_type(_annotated(spark, sf_dir))


def eval_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.micro(_annotated(spark, sf_dir))


def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(_annotated(spark, sf_dir))


def eval_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_stratum(_annotated(spark, sf_dir))


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(_annotated(spark, sf_dir)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_accuracy(_annotated(spark, sf_dir))


def synthetic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 annotated cases, one scope, scored by type."""
    gold = evaluate.synthetic_corpus(spark).withColumn("doc", F.lit("synthetic"))
    return evaluate.per_type(evaluate.predicted(R.detect(gold, scope="doc")))


def locate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "'on—file   Ann' || case when s_suppkey % 2 = 0 then '  ' else ' ' end || 'Rao-Dey end'"
    df = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", f"{text} as text")
    at = evaluate.locate(F.col("text"), F.lit("Ann Rao-Dey"))
    return df.select("id", at["start"].cast("long").alias("start"), at["end"].cast("long").alias("end"))


def base64_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.base64(F.encode("c_name", "utf-8")).alias("encoded"))


def escaped_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", "s_name || ' (P.) & Co' as phrase")
    return df.select("id", F.length(rx.escape("phrase")).cast("long").alias("n"), F.col("phrase").rlike(rx.literal("(P.) & Co")).alias("found"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {
        "email_spans": _spans_in("documents", "doc_id", "text", "EMAIL"),
        "ip_spans": _spans_in("documents", "doc_id", "text", "IP_ADDRESS"),
        "phone_spans": _spans_in("documents", "doc_id", "text", "PHONE"),
        "card_spans": _spans_in("documents", "doc_id", "text", "CREDIT_CARD"),
        "website_spans": _spans_in("pages", "page_id", "html", "WEBSITE"),
        "ssn_spans": _spans_of_text("ssn", "SSN"),
        "pan_spans": _spans_of_text("pan", "PAN"),
        "aadhaar_spans": _spans_of_text("aadhaar", "AADHAAR"),
        "din_gated": _spans_of_text("din", "DIN"),
        "cin_spans": _spans_of_text("cin", "CIN"),
        "bank_gated": _spans_of_text("bank", "BANK_ACCOUNT"),
        "dob_gated": _spans_of_text("dob", "DATE_OF_BIRTH"),
        "harvest_honorific": _harvested("person", harvest.by_honorific),
        "harvest_name_role": _harvested("role", harvest.by_name_then_role),
        "harvest_label_list": _harvested("label", harvest.by_label_list),
        "harvest_email": _harvested("mail", harvest.by_email),
    }
    for f in (
        email_counts_by_lang, luhn_flag, verhoeff_flag, hash64_bucket, harvest_short_block, harvest_org_alias, person_variants,
        surname_families, propagate_person, propagate_by_words, propagate_org, surname_spans, address_spans, allowlist_anti,
        legislation_filter, name_like, resolve_overlaps, redact_text, redaction_counts, mapping_table, detect_documents,
        audit_documents, type_filter_exposes_inner, eval_per_type, eval_micro, eval_macro, eval_stratum, eval_errors,
        token_accuracy, synthetic_report, locate_label, base64_text, escaped_pattern,
    ):
        out[f.__name__] = f
    return out | {f"surrogate_{t.lower()}": _surrogate(t) for t in SURROGATES}
