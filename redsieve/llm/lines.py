"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

Two lines within THRESHOLD edits share, when one is cut into THRESHOLD + 1
segments, at least one segment at nearly the same place. So every distinct line
puts its segments into an index keyed by (line length, segment number, segment),
and probes the indexes of its own and of slightly smaller lengths with the
substrings that the multi-match-aware bounds leave. Keys at which no two lines meet
are dropped by counts before anything is paired, and keys at which very many meet, as
those of templated lines do, are made finer by a second segment of what is left of the
line, which is exact (see _narrowed). Two lines at a key are a pair only
if sketches of their characters are as near as THRESHOLD edits leave them, which no
similar pair fails. Pairs are verified by a bit-parallel automaton over the band of
2 * THRESHOLD + 1 diagonals. Linked lines
form classes; the first occurrence of a class, by (doc_id, line number), stays.

Everything is DataFrame expressions. Copies of a line are one row before the join
and meet only by their 64-bit hash, so a line that makes up a third of all rows
costs one row in the index.

Defined results: null text has no lines; lines under MIN_CHARS code points are like
their exact copies only, and take part where `short` is set, as in op8 and
dedup_lines, unless they are blank; lines are whole texts between line feeds; rows that
share doc_id and text count as one document, and rows with a null doc_id come
first; other columns are kept as they are; an empty table gives an empty result.
Two different lines share a hash with probability 2^-64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import settle

THRESHOLD = 2
MIN_CHARS = 24
#: Up to so many keys or hashes (8 bytes each) a copy of them goes to each executor; beyond, a shuffle joins them.
FEW_IDS = 250_000
#: And so many rows of about 100 bytes.
FEW_ROWS = 50_000
#: A key with more index rows than this is made finer, so many times at most.
HOT = 64
DEPTH = 3


def _segments(length: Column, tau: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of each of tau + 1 segments of a line of that length; the last ones are longer by one."""
    short = F.floor(length / (tau + 1)).cast("int")
    longer = length - short * (tau + 1)
    out, start = [], F.lit(0)
    for i in range(tau + 1):
        size = short + F.when(F.lit(tau + 1 - i) <= longer, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def _slots(n: Column, tau: int) -> list[tuple[bool, int, Column, Column, Column]]:
    """(own, segment number, length of the line that is looked for, start from 0, size) of all keys of a line of n code points.

    The first tau + 1 are its segments, its own keys in the index. Under the others, lines at most as long, within tau edits, may be
    found; some of these places leave the line.
    """
    out = [(True, i, n, start, size) for i, (start, size) in enumerate(_segments(n, tau))]
    for delta in range(tau + 1):
        for i, (start, size) in enumerate(_segments(n - delta, tau)):
            lo, hi = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            out += [(False, i, n - delta, start + shift, size) for shift in range(lo, hi + 1) if delta or shift]
    return out


def keys_of(line: Column, tau: int) -> list[Column]:
    """Of a line's slots, the keys; null where a place leaves the line."""
    n = F.length(line)
    key = lambda i, of, at, size: F.xxhash64(of.cast("int"), F.lit(i), F.substring(line, at + 1, size))
    return [F.when(F.lit(own) | ((at >= 0) & (at + size <= n)), key(i, of, at, size)) for own, i, of, at, size in _slots(n, tau)]


def without_slot(line: Column, slot: Column, tau: int) -> Column:
    """The line without what a slot's key covers."""
    places = F.array(*(F.struct(at.cast("int").alias("at"), size.cast("int").alias("size")) for _, _, _, at, size in _slots(F.length(line), tau)))
    at, size = places[slot]["at"], places[slot]["size"]
    return F.concat(F.substring(line, F.lit(1), at), F.substring(line, at + size + 1, F.length(line)))


def within(x: str, y: str, tau: int) -> Column:
    """Is the edit distance of two columns, arrays of characters, at most tau?

    For each number of errors k up to tau, a word R_k has bit tau + o set when
    the first j characters of y and the first j + o of x can be matched with k
    edits. Reading a character of y shifts, ands and ors whole words.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    start = sum(((1 << (k + 1)) - 1) << tau << (width * k) for k in range(tau + 1))
    # for each character of y, itself and those of x on the band's diagonals
    none = F.lit(None).cast("string")
    band = [F.slice(x, 1 + o, 1 << 30) if o > 0 else F.concat(F.array_repeat(none, -o), F.col(x)) if o else F.col(x) for o in range(-tau, tau + 1)]
    zipped = F.slice(F.arrays_zip(F.col(y).alias("c"), *(d.alias(f"d{i}") for i, d in enumerate(band))), 1, F.size(y))

    def step(acc: Column, z: Column) -> Column:
        same = F.lit(0).cast("long")
        for i in range(width):
            same = same.bitwiseOR(F.when(z[f"d{i}"] == z["c"], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        out, old, new = F.lit(0).cast("long"), None, None
        for k in range(tau + 1):
            row = F.shiftright(acc, width * k).bitwiseAND(full)
            got = row.bitwiseAND(same)
            if k:
                got = got.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(full)
            old, new = row, got
            out = out.bitwiseOR(F.shiftleft(got, width * k))
        return out

    end = F.aggregate(zipped, F.lit(start).cast("long"), step)
    last = F.shiftright(end, width * tau).bitwiseAND(full)
    return (F.abs(F.size(x) - F.size(y)) <= tau) & (last.bitwiseAND(F.expr(f"shiftleft(1L, {tau} + size({x}) - size({y}))")) != 0)


def occurrences(documents: DataFrame, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """doc_id, t (hash of the text), line_no, line, h: every line that takes part; with short, those under min_chars too unless they are blank."""
    takes_part = F.length("line") >= min_chars
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(takes_part | F.col("line").rlike(r"\S") if short else takes_part)
        .withColumn("h", F.xxhash64("line"))
    )


def _few(ids: DataFrame, most: int = FEW_IDS) -> bool:
    return ids.limit(most + 1).count() <= most


def _met(occ: DataFrame, tau: int) -> DataFrame:
    """key, h, n, slot, own, n_own: the rows of keys under which a line's index meets another line, and how many index rows the key has."""
    keys = keys_of(F.col("line"), tau)
    every = [f"k{i}" for i in range(len(keys))]
    keyed = occ.select("h", F.length("line").alias("n"), *(k.alias(name) for k, name in zip(keys, every, strict=True)))
    # copies of a line have the same keys, so any of theirs will do
    keyed = settle(keyed.groupBy("h").agg(*(F.max(c).alias(c) for c in ("n", *every))), "segments")
    rows = keyed.select("h", "n", F.posexplode(F.array(*every)).alias("slot", "key")).where("key is not null").select("key", "h", "n", "slot", (F.col("slot") <= tau).alias("own"))
    return settle(_sharing(rows, "shared"), "met")


def _sharing(rows: DataFrame, name: str) -> DataFrame:
    """Rows of keys at which an index row meets another line, with n_own."""
    shared = rows.groupBy("key").agg(F.count_if("own").alias("n_own"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n_own > 0 and lo < hi").select("key", "n_own")
    shared = settle(shared, name)
    return rows.join(F.broadcast(shared) if _few(shared) else shared, "key")


def _narrowed(met: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """key, h, n, own: met, with keys that more than HOT index rows share replaced by finer ones.

    Two lines within tau edits of which one segment is left alone are, without it, still within tau edits. So what is left of
    the lines at such a key is cut into segments again, and two of them need a second one in common. That goes on, at most DEPTH
    times, where keys stay hot; no pair is lost by it.
    """
    out = met.where(F.col("n_own") <= HOT).select("key", "h", "n", "own")
    hot = met.where(F.col("n_own") > HOT)
    # n stays that of the whole line; rest is what is left of it
    hot = settle(hot.join(texts, "h").select("key", "h", "n", "own", without_slot(F.col("line"), F.col("slot"), tau).alias("rest")).distinct(), "hot")
    for depth in range(DEPTH):
        if hot.isEmpty():
            return out
        each = hot.select("key", "h", "n", "own", "rest", F.posexplode(F.array(*keys_of(F.col("rest"), tau))).alias("slot", "k")).where("k is not null")
        # of a row that probes, all keys probe
        rows = each.select(F.xxhash64("key", "k").alias("key"), "h", "n", (F.col("own") & (F.col("slot") <= tau)).alias("own"), "slot", "rest")
        rows = settle(_sharing(rows, "shared"), "met")
        last = depth == DEPTH - 1
        cold = rows if last else rows.where(F.col("n_own") <= HOT)
        out = out.unionByName(cold.select("key", "h", "n", "own"))
        if not last:
            left = rows.where(F.col("n_own") > HOT)
            hot = settle(left.select("key", "h", "n", "own", without_slot(F.col("rest"), F.col("slot"), tau).alias("rest")).distinct(), "hot")
    return out


def _sketch(chars: Column) -> Column:
    """64 parities of the numbers of hashed pairs of neighbouring characters. An edit removes and adds at most two pairs, so it changes at most four."""
    pairs = F.arrays_zip(chars.alias("a"), F.slice(chars, 2, 1 << 30).alias("b"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, z: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(z["a"], z["b"]), F.lit(64)))))


def similar_lines(occ: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """(a, b): hashes of different lines within tau edits."""
    met = _met(occ, tau)
    wanted = settle(met.select("h").distinct(), "wanted")
    texts = occ.select("h", "line").join(F.broadcast(wanted) if _few(wanted) else wanted, "h", "left_semi").dropDuplicates(["h"])
    texts = settle(texts, "texts")
    sketches = settle(texts.select("h", _sketch(F.split("line", "")).alias("s")), "sketches")
    rows = _narrowed(met, texts, tau).join(sketches, "h")
    index = rows.where("own").select("key", F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    probes = rows.select("key", F.col("h").alias("b"), "n", "s")
    alike = F.bit_count(F.col("s_a").bitwiseXOR(F.col("s"))) <= 4 * tau
    ordered = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("a") < F.col("b")))
    pairs = index.join(probes, (index["key"] == probes["key"]) & ordered & alike).select("a", "b").distinct()
    both = settle(pairs, "pairs").join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(
        texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b"
    )
    chars = both.select("a", "b", F.split("line_a", "").alias("x"), F.split("line_b", "").alias("y"))
    return chars.where(within("x", "y", tau)).select("a", "b")


def line_classes(documents: DataFrame, tau: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """One row for each occurrence: doc_id, t, line_no, class_doc_id, class_line_no, n_links, kept."""
    occ = occurrences(documents, min_chars)
    places = settle(occurrences(documents, min_chars, short).select("doc_id", "t", "line_no", "h"), "places")
    here = F.struct("doc_id", "t", "line_no")
    firsts = settle(places.groupBy("h").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    links = settle(similar_lines(occ, tau), "line-links")
    roots = settle(components(links, "a", "b"), "line-roots").withColumnRenamed("node", "h")
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    linked = firsts.join(roots, "h").join(degree, "h")
    # settled, so that AQE can split the partition of a class with very many lines
    of_class = settle(linked.groupBy("root").agg(F.min("first").alias("class")), "classes")
    linked = linked.join(of_class, "root").select("h", "class", "n_links")
    # a line of which there is one, and nothing like it, needs no partner
    alone = firsts.where("copies > 1").join(linked, "h", "left_anti").select("h", F.col("first").alias("class"), F.lit(0).cast("long").alias("n_links"))
    met = settle(linked.unionByName(alone), "repeated")
    # few are sent to the places; many meet them by a shuffle, of which AQE splits the partition of a hot line
    return places.join(F.broadcast(met) if _few(met, FEW_ROWS) else met, "h", "left").select(
        "doc_id",
        "t",
        F.col("line_no").cast("long").alias("line_no"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_doc_id"),
        F.coalesce("class.line_no", "line_no").cast("long").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("class").isNull() | here.eqNullSafe(F.col("class"))).alias("kept"),
    )


def dedup_lines(documents: DataFrame, tau: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with every repeated line removed but its first occurrence.

    A document of which no line is left goes; one that had no line that takes
    part stays as it is.
    """
    gone = line_classes(documents, tau, min_chars, short=True).where("not kept").groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("gone"))
    # a document's columns travel in a struct, so no name of theirs meets one of ours
    docs = documents.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("of"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    left = docs.join(gone, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("t")), "left")
    kept = F.expr("array_join(filter(split(row.text, '\\n'), (x, i) -> not array_contains(gone, cast(i as bigint))), '\\n')")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return left.select(F.col("row").withField("text", text).alias("row"), "gone").where("gone is null or trim(row.text) != ''").select("row.*")
