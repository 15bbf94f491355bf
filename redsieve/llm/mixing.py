"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key whose rate is its quality weight, so the
documents of a source in the order of their keys are a weighted sample without
replacement. A source's target is met by complete epochs over all its documents,
then by the first documents in that order whose sizes, summed as prefixes, stay within
the rest. What the next document is too large for is filled, in PASSES in all, by
documents further on that fit. Each pass ends at a cut in the order, so whether a
document is in follows from its own (key, doc_id) and size and the few cuts of its
source, and no text is ever sorted or moved.

The prefix sums are taken in two levels. Keys fall into SLICES parts of the
distribution of the lowest rate, LOWEST, so that a part holds at most a share of
1 / (LOWEST * SLICES) of a source whatever the rates of its documents are; sums by
slice find the slice that holds the cut, and only that slice's rows are sorted. A
source with a third of all rows is thus never sorted in one task.

The weight is a parameter: quality_weight() looks at the text alone, and the
pipeline gives the score of the quality classifier. Size and key are worked out
once for each document and written beside it.

Targets: a total budget is shared by weight; a source's target stops at
MAX_EPOCHS times its size, and what is over is shared again by weight, which is
the same as one level per unit of weight that all uncapped sources reach.

Defined results: null text is empty; a null source is a source, the last; empty
documents have size 0, and are taken whenever their key is before the cut; ties in
key go by doc_id, and repeated rows are taken together; a null weight, or one outside
LOWEST to 1, is taken to the nearer end; other columns are ignored, and kept by mix()
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import rows_a_batch, settle

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SLICES = 16384
#: The least weight that a document may have.
LOWEST = 0.1
#: How often what is left of a target is filled from the documents that fit.
PASSES = 3
SEED = "mix"


def size_of(text: str = "text") -> Column:
    """The number of words, runs of anything but 20 and 09-0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """0.1 to 1, higher the more of the text's bytes are not among the marks of junk and tables."""
    plain = F.length(F.translate(text, "#%&*$!|<>{}", ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def uniform(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """In (0, 1), from the first 52 bits of a digest of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def drawn_key(weight: Column) -> Column:
    """The document's exponential key, whose rate is its weight."""
    return -F.log(uniform()) / F.greatest(F.least(F.coalesce(weight, F.lit(LOWEST)), F.lit(1.0)), F.lit(LOWEST))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with target. A row for each source: what windows here sort are sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        caps.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") * budget - F.col("capped")) / F.col("open"))
        .withColumn("turn", F.row_number().over(by_fill))
    )
    # the level is right at the first source that it leaves uncapped; sources may fill at one level, so their turns tell them apart
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("turn", "level"))).over(everything)["level"]
    return filled.withColumn("share", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("share") * F.col("w"), F.col("cap").cast("double"))).alias("target")
    )


def _after(key: str, last: str, identity: str) -> Column:
    """Does a row come after (last, identity) in its source's order?"""
    none = F.lit(-(1 << 63))
    return (F.col(key) > F.col(last)) | ((F.col(key) == F.col(last)) & (F.coalesce("doc_id", none) > F.coalesce(identity, none)))


def _cut(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """of, cut_key, cut_id, got: for each source in goal (of, rest) the last row, in order of (key, doc_id), up to which sizes sum to rest at most."""
    part = F.least(F.floor((F.lit(1) - F.exp(F.col("key") * -LOWEST)) * SLICES), F.lit(SLICES - 1)).cast("int")
    parts = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("s"), F.max(F.struct("key", "doc_id")).alias("last"))
    up_to = Window.partitionBy("source").orderBy("part")
    summed = settle(parts.withColumn("past", F.sum("s").over(up_to) - F.col("s")), "parts")
    both = summed.join(goal, F.col("source").eqNullSafe(F.col("of"))).where("past <= rest")
    # whole slices, and the one in which the sum is reached
    before = both.where("past + s <= rest").groupBy("of").agg(F.max("last").alias("cut"), F.max(F.col("past") + F.col("s")).alias("got"))
    at = settle(both.where("past + s > rest").groupBy("of").agg(F.min(F.struct("part", "past")).alias("at"), F.first("rest").alias("rest")).select("of", F.col("at.part").alias("at_part"), F.col("at.past").alias("past"), "rest"), "at")
    near = rows.join(F.broadcast(at) if _few(at) else at, F.col("source").eqNullSafe(F.col("of")) & (part == F.col("at_part")))
    within = Window.partitionBy("of").orderBy("key", F.col("doc_id").asc_nulls_first())
    inside = (
        near.groupBy("of", "key", "doc_id")
        .agg(F.sum("size").alias("size"), F.first("past").alias("past"), F.first("rest").alias("rest"))
        .withColumn("sum", F.sum("size").over(within) + F.col("past"))
        .where("sum <= rest")
        .groupBy("of")
        .agg(F.max(F.struct("key", "doc_id")).alias("cut"), F.max("sum").alias("got"))
    )
    found = before.unionByName(inside).groupBy("of").agg(F.max("cut").alias("cut"), F.max("got").alias("got"))
    return found.select("of", F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"), "got")


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS) -> DataFrame:
    """From rows (doc_id, source, size, key): source, source_size, target, epochs and, for each pass k, key_k, id_k and room_k.

    A document is taken `epochs` times, and once more if it comes no later than the first pass's cut. What the document
    behind the cut was too large for is left to the next passes, which go on behind the last cut with documents that fit.
    """
    sizes = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = targets(sizes, weights, budget, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", whole.cast("long"))
    goal = goal.withColumn("room_1", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("key_0", F.lit(-1.0)).withColumn("id_0", F.lit(None).cast("long"))
    goal = settle(goal, "targets")
    for k in range(1, PASSES + 1):
        asked = goal.select(F.col("source").alias("of"), F.col(f"room_{k}").alias("rest"), F.col(f"key_{k - 1}").alias("last"), F.col(f"id_{k - 1}").alias("last_id")).where("rest > 0")
        side = F.broadcast(asked) if _few(asked) else asked
        left = rows.join(side, F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") <= F.col("rest")).where(_after("key", "last", "last_id")) if k > 1 else rows
        found = _cut(left.select("doc_id", "source", "size", "key"), asked.select("of", "rest"))
        goal = goal.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        goal = goal.withColumn(f"key_{k}", F.coalesce("cut_key", f"key_{k - 1}")).withColumn(f"id_{k}", F.when(F.col("cut_key").isNull(), F.col(f"id_{k - 1}")).otherwise(F.col("cut_id")))
        goal = settle(goal.withColumn(f"room_{k + 1}", F.col(f"room_{k}") - F.coalesce("got", F.lit(0))).drop("cut_key", "cut_id", "got"), "targets")
    return goal


def _few(sources: DataFrame, most: int = 100_000) -> bool:
    """Are the sources so few that a copy of them in each executor is small?"""
    return sources.limit(most + 1).count() <= most


def times(size: Column, key: str = "key") -> Column:
    """How often a document is taken, given the cuts of its source. Its size is looked at only behind the first cut."""
    more = ~_after(key, "_key_1", "_id_1")
    for k in range(2, PASSES + 1):
        more = more | (_after(key, f"_key_{k - 1}", f"_id_{k - 1}") & ~_after(key, f"_key_{k}", f"_id_{k}") & (size <= F.col(f"_room_{k}")))
    return F.col("_epochs") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)


def _with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """With the columns of cuts, a line before their names."""
    side = cut.select(*(F.col(c).alias(f"_{c}") for c in cut.columns))
    side = F.broadcast(side) if _few(cut) else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source")))


def mix_plan(documents: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row for each row of documents."""
    key = drawn_key(quality_weight() if weight is None else weight)
    rows = documents.withColumns({"doc_id": F.col("doc_id").cast("long"), "size": size_of(), "key": key}).select("doc_id", "source", "size", "key")
    rows = settle(rows, "drawn")
    return _with_cuts(rows, cuts(rows)).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * times(F.col("size"))).alias("taken")
    )


def mix(documents: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mixture itself: each document as often as it is taken, its columns as they were."""
    key = drawn_key(quality_weight() if weight is None else weight)
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    with rows_a_batch(documents.sparkSession, 1000):
        rows = settle(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size_of().alias("size"), key.alias("key"), whole), "drawn")
    cut = cuts(rows.select("doc_id", "source", "size", "key"))
    taken = _with_cuts(rows, cut).withColumn("n", times(F.col("size")).cast("int")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("row.*")
