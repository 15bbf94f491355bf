"""Near-duplicate documents: one-permutation hashing with optimal densification.

A document is the set of its 5-word shingles. One hash of each shingle serves all
bins: the bin is given by the top bits and the bin's value is the least hash in
it. An empty bin borrows from the bins that a fixed sequence of its own names,
the first that is not empty. Bins are cut into bands; documents that agree in a
band share a bucket, and a bucket of m documents gives the m - 1 edges of a star.
Edges are confirmed on full sets.

Documents with the same set are one class before any bucket is made, so copies
cost nothing. A star loses a link between two leaves when neither links with the
centre. So while a bucket holds several components, further rounds take centres that
were none before: those whose hash, which differs for each bucket, is under a bound that
lets FASTER times as many through each round, until every pair of the bucket is tried or
within a component. No bucket is ever sorted or held whole. In the first round
the centre is the smallest doc_id, as what is copied mostly comes before its copies.
Pairs of later rounds are first held against sketches of their sets: parities that
differ in more places than the sets may differ in elements rule a pair out for certain.

Defined results: null text is empty text; documents without words have
n_shingles 0, link with nothing and are kept; repeated rows belong to one class;
rows with a null doc_id take part and are never kept; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import forget, ids_as_long, ids_as_text, rows_a_batch, settle

WORDS = 5
PERCENT = 75
BINS = 128
BANDS = 32
#: Parities in a set's sketch.
SKETCH = 1024
#: Each round takes so many times the centres of the one before.
FASTER = 16
#: Up to so many buckets (32 bytes each) a copy of them goes to each executor; beyond, a shuffle joins them.
FEW_BUCKETS = 250_000
#: A worker remembers the hashes of so many words.
WORD_CACHE = 1 << 17

_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, cache: dict, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and 09-0D and 20
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, _U)
    w = np.fromiter(map(cache.__getitem__, parts), _U, len(parts))
    width = min(words, len(parts))
    h = w[: len(w) - width + 1].copy()
    for j in range(1, width):
        h = h * _U(0x9E3779B97F4A7C15) + w[j : len(w) - width + 1 + j]
    return np.unique(_mix(h + _U(width)))


def _borrowing(bins: int) -> np.ndarray:
    """For each bin the sequence of bins that it borrows from when it is empty."""
    steps = np.arange(bins * 1024, dtype=_U)
    return (_mix(steps + _U(0x51ED270B)) % _U(bins)).astype(np.int64).reshape(bins, 1024)


def signature(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One value a bin, for a set that is not empty."""
    bins = len(table)
    at, first = np.unique((s >> _U(64 - bins.bit_length() + 1)).astype(np.int64), return_index=True)
    sig, full = np.zeros(bins, _U), np.zeros(bins, bool)
    sig[at], full[at] = s[first], True
    rest = np.flatnonzero(~full)
    for width in (16, table.shape[1]):
        hit = full[table[rest, :width]]
        got = hit.any(axis=1)
        sig[rest[got]] = sig[table[rest[got], hit[got].argmax(axis=1)]]
        rest = rest[~got]
        if not len(rest):
            break
    sig[rest] = s[0]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
    for j in range(rows.shape[1]):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + rows[:, j])
    return h.view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH parities of the numbers of hashes with the same low bits. One element more or less changes one of them."""
    odd = np.bincount((s & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache, table = _Hashes(), _borrowing(BINS)
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            s = shingle_set(text, cache)
            key = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) if len(s) else None
            out.append((doc, len(s), key, band_keys(signature(s, table), BANDS) if len(s) else None))
        # objects stay exact beside None, of which pandas would make floats
        signed = pd.DataFrame(out, columns=["doc_id", "n_shingles", "c", "bands"], dtype=object).astype({"n_shingles": "int64", "c": "Int64"})
        yield signed.assign(t=batch["t"].to_numpy())


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = _Hashes()
    for batch in batches:
        out = []
        for c, text in zip(batch["c"], batch["text"], strict=True):
            s = shingle_set(text, cache)
            if len(s) and xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) == c:
                out.append((c, s.view(np.int64), sketch(s)))
        yield pd.DataFrame(out, columns=["c", "s", "sketch"])


def _confirm(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Of edges (a, b) those with enough in common."""
    left = sets.select(F.col("c").alias("a"), F.col("s").alias("s_a"))
    right = sets.select(F.col("c").alias("b"), F.col("s").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (
        edges.join(left, "a")
        .join(right, "b")
        .select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), both.alias("i"))
        .where(F.expr(f"100 * i >= {PERCENT} * (n_a + n_b - i)"))
        .select("a", "b")
    )


def text_hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def _sizes_allow() -> str:
    return f"100 * least(n, m_n) >= {PERCENT} * greatest(n, m_n)"


def _sketches_allow() -> str:
    """Sets of N elements in all and enough in common differ in at most N (100 - PERCENT) / (100 + PERCENT)."""
    differ = "aggregate(zip_with(sketch, m_sketch, (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)"
    return f"{100 + PERCENT} * {differ} <= {100 - PERCENT} * (n + m_n)"


def near_duplicates(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of documents (doc_id, text).

    With with_text also t, the hash of the text (0 for null), and root, which is the same in a component and null without words.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("t"))
    signed = ids_as_text(docs, "doc_id").mapInPandas(_signed, "doc_id string, n_shingles long, c long, bands array<long>, t long")
    with rows_a_batch(documents.sparkSession, 1000):
        signed = settle(ids_as_long(signed, "doc_id"), "minhash")
    # a class's set is that of one row: the first by doc_id (null last), then hash of the text
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = signed.where("n_shingles > 0").groupBy("c").agg(
        F.min("doc_id").alias("least"), F.min(first).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    rows = classes.select("c", "n", "least", F.explode("bands").alias("key"))
    # the first document of a bucket is its centre: what is copied comes before its copies
    shared = rows.groupBy("key").agg(F.min(F.struct("least", "c", "n")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # settled, so that a bucket with very many rows is joined in as many tasks as AQE makes of it; few are sent to the rows
    shared = settle(shared.select("key", "k", F.col("m.c").alias("m"), F.col("m.n").alias("m_n")), "shared")
    buckets = settle(rows.select("key", "c", "n").join(F.broadcast(shared) if shared.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS else shared, "key"), "buckets")
    wanted = buckets.select("c").distinct()
    sources = classes.select("c", F.col("first.doc_id").alias("d"), F.col("first.t").alias("of")).join(wanted, "c")
    texts = docs.join(sources, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("of"))).select("c", "text")
    with rows_a_batch(documents.sparkSession, 500):
        sets = settle(texts.mapInPandas(_sets, "c long, s array<long>, sketch array<long>"), "sets")
    if sets.count() > sets.select("c").distinct().count():
        # repeated rows gave their set each
        sets = settle(sets.dropDuplicates(["c"]), "sets")
    tried = settle(buckets.where("c != m").where(_sizes_allow()).select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b")).distinct(), "star")
    links = settle(_confirm(tried, sets).distinct(), "links")
    roots = components(links, "a", "b")
    # those of a bucket have places from 0 to 1 by a hash of their own; those up to done / k have been centres
    place = F.pmod(F.xxhash64("c", "key"), F.lit(1 << 52)) / float(1 << 52)
    open_ = buckets.where("c != m").select("key", "c", "n", "k", place.alias("u")).join(sets.select("c", "sketch"), "c")
    done, more, before = 0, 1, []
    while True:
        placed = open_.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        several = settle(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "several")
        now = settle(placed.join(several, "key", "left_semi"), "open")
        for table in before:
            forget(table)
        before = [several, now]
        if now.isEmpty():
            break
        centre = now.where(F.col("u") * F.col("k") <= done + more).select("key", *(F.col(x).alias(f"m_{x}") for x in ("c", "n", "root", "u", "sketch")))
        star = (
            now.join(centre, "key")
            .where("(u > m_u or (u = m_u and c > m_c)) and root != m_root")
            .where(_sizes_allow())
            .where(_sketches_allow())
            .select(F.least("c", "m_c").alias("a"), F.greatest("c", "m_c").alias("b"))
            .distinct()
        )
        star = settle(star.join(tried, ["a", "b"], "left_anti"), "star")
        found = settle(_confirm(star, sets).distinct(), "links")
        tried = tried.unionAll(star)
        if not found.isEmpty():
            links = links.unionAll(found)
            roots = components(links, "a", "b")
        done, more = done + more, more * FASTER
        open_ = now.where(F.col("u") * F.col("k") > done).drop("root")
    roots = settle(roots, "roots")
    placed = classes.select("c", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    # settled, so that both sides of the join come from shuffles of their own, of which AQE splits the partition of a hot root
    least = settle(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    also = ["t", "root"] if with_text else []
    of = placed.join(least, "root").select("c", "component_id", *also[1:])
    return (
        signed.select("doc_id", "n_shingles", "c", *also[:1])
        .join(of, "c", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *also)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
