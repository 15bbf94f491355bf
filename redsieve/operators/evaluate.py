"""Scoring spans against gold annotations: strict and relaxed, by type, micro and macro, by stratum and by token.

Annotated blocks carry two arrays, `gold` and `pred`, of (start, end, label, text). Matching is
greedy and one-to-one: each predicted span, in order, takes the first unclaimed gold span that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx

LABELLED = "array<struct<start:int,end:int,label:string,text:string>>"
TRUTH = "source_document string, blocks array<struct<index:int,text:string,stratum:string,entities:array<array<string>>>>"


def locate(text: Column, needle: Column) -> Column:
    """start and end of needle in text, exactly or with white space and dashes loosely; null if it isn't there."""
    at = F.call_function("locate", needle, text)
    exact = F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(needle)).cast("int").alias("end"))
    escaped = F.transform(F.filter(F.split(needle, r"(?U)\s+"), lambda t: t != ""), lambda t: F.replace(rx.escape(t), F.lit("\\-"), F.lit("[-‐-―]")))
    loose = F.get(rx.spans_of(text, F.concat(F.lit("(?U)"), F.array_join(escaped, r"\s*"))), F.lit(0))
    return F.when(at > 0, exact).when(loose.isNotNull(), F.struct(loose["start"].alias("start"), loose["end"].alias("end")))


def load_truth(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """truth_of() a truth file."""
    return truth_of(spark.read.schema(TRUTH).json(path, multiLine=True), blocks)


def truth_of(raw: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """block_idx, text, stratum, gold from TRUTH; blocks (block_idx, text) supplies texts that it names by index only.

    A label that can't be found in its block, or a block that isn't there, fails the query.
    """
    rows = raw.select(F.posexplode("blocks").alias("pos", "b")).select(
        F.coalesce("b.index", "pos").alias("block_idx"), F.col("b.text").alias("text"), F.coalesce("b.stratum", F.lit("all")).alias("stratum"), F.col("b.entities").alias("entities")
    )
    if blocks is not None:
        rows = rows.join(blocks.select("block_idx", F.col("text").alias("_t")), "block_idx", "left").withColumn("text", F.coalesce("text", "_t")).drop("_t")
    return annotate(rows)


def annotate(rows: DataFrame) -> DataFrame:
    """Rows with text and entities ([[label, surface]]) -> with gold in place of entities."""

    def found(e: Column) -> Column:
        at = locate(F.col("text"), e[1])
        missing = F.raise_error(F.concat(F.lit("label does not occur in its block: "), e[0], F.lit("="), e[1]))
        start = F.when(F.col("text").isNull(), F.raise_error(F.lit("block not found")).cast("int")).when(at.isNull(), missing.cast("int")).otherwise(at["start"])
        return F.struct(start.alias("start"), at["end"].alias("end"), e[0].alias("label"), e[1].alias("text"))

    return rows.withColumn("gold", F.transform(F.coalesce("entities", F.array().cast("array<array<string>>")), found)).drop("entities")


def predicted(detected: DataFrame) -> DataFrame:
    """detect()'s spans as pred."""
    return detected.withColumn(
        "pred", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["pii_type"].alias("label"), s["text"].alias("text")))
    ).drop("spans")


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def claims(gold: Column, pred: Column, strict: bool) -> Column:
    """For each predicted span the place of the gold span it takes, or -1."""
    numbered = F.transform(gold, lambda g, i: F.struct(i.alias("i"), g.alias("g")))

    def step(taken: Column, p: Column) -> Column:
        def fits(x: Column) -> Column:
            g = x["g"]
            same = (g["start"] == p["start"]) & (g["end"] == p["end"]) if strict else overlap(g, p)
            return (g["label"] == p["label"]) & same & ~F.array_contains(taken, x["i"])

        return F.concat(taken, F.array(F.coalesce(F.get(F.filter(numbered, fits), F.lit(0))["i"], F.lit(-1))))

    return F.aggregate(pred, F.array().cast("array<int>"), step)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _scores(counts: DataFrame, *keys: str) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        *keys, (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1")
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def _raw_per_type(blocks: DataFrame) -> DataFrame:
    parts = []
    for mode, strict in (("strict", True), ("relaxed", False)):
        labels = F.array_union(F.transform("gold", lambda s: s["label"]), F.transform("pred", lambda s: s["label"]))
        each = blocks.select("gold", "pred", claims(F.col("gold"), F.col("pred"), strict).alias("c"), labels.alias("labels"))
        each = each.select("gold", "pred", "c", F.explode("labels").alias("label"))
        n = lambda spans: F.size(F.filter(spans, lambda s: s["label"] == F.col("label")))
        hits = F.size(F.filter(F.arrays_zip(F.col("pred").alias("p"), F.col("c").alias("c")), lambda z: (z["p"]["label"] == F.col("label")) & (z["c"] >= 0)))
        parts.append(each.select(F.lit(mode).alias("mode"), "label", hits.alias("tp"), (n("pred") - hits).alias("fp"), (n("gold") - hits).alias("fn")))
    return parts[0].unionByName(parts[1]).groupBy("mode", "label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def per_type(blocks: DataFrame) -> DataFrame:
    """mode, label, support, tp, fp, fn, precision, recall, f1, ordered by the first two."""
    return _rounded(_scores(_raw_per_type(blocks), "mode", "label")).orderBy("mode", "label")


def micro(blocks: DataFrame) -> DataFrame:
    """The same from counts pooled over all types."""
    pooled = _raw_per_type(blocks).groupBy("mode").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return _rounded(_scores(pooled, "mode"))


def macro(blocks: DataFrame) -> DataFrame:
    """mode, precision, recall, f1: means over the types that have gold spans."""
    each = _scores(_raw_per_type(blocks), "mode", "label")
    means = each.groupBy("mode").agg(*(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col(c))), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")))
    return _rounded(means)


def by_stratum(blocks: DataFrame) -> DataFrame:
    """stratum, support, precision, recall, f1, relaxed, ordered by the first; matched over all types together."""
    hits = F.size(F.filter(claims(F.col("gold"), F.col("pred"), False), lambda i: i >= 0))
    each = blocks.select("stratum", hits.alias("tp"), (F.size("pred") - hits).alias("fp"), (F.size("gold") - hits).alias("fn"))
    pooled = each.groupBy("stratum").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return _rounded(_scores(pooled, "stratum")).select("stratum", "support", "precision", "recall", "f1").orderBy("stratum")


def token_labels(text: Column, spans: Column) -> Column:
    """For each word, the label of the first span that overlaps it, or O."""
    tokens = rx.spans_of(text, r"(?U)\S+")
    return F.transform(tokens, lambda t: F.coalesce(F.get(F.filter(spans, lambda s: overlap(s, t)), F.lit(0))["label"], F.lit("O")))


def token_accuracy(blocks: DataFrame) -> DataFrame:
    """correct, total, token_accuracy."""
    pairs = F.arrays_zip(token_labels(F.col("text"), F.col("gold")).alias("g"), token_labels(F.col("text"), F.col("pred")).alias("p"))
    each = blocks.select(F.size(F.filter(pairs, lambda z: z["g"] == z["p"])).alias("c"), F.size(pairs).alias("t"))
    return each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("correct"), F.coalesce(F.sum("t"), F.lit(0)).alias("total")).withColumn(
        "token_accuracy", F.round(_ratio(F.col("correct"), F.col("total")), 4)
    )


def errors(blocks: DataFrame) -> DataFrame:
    """kind, label, text: predicted spans without a gold one of their type in touch, and the other way round."""
    alone = lambda a, b: F.filter(a, lambda s: ~F.exists(b, lambda q: (s["label"] == q["label"]) & overlap(s, q)))
    fp = blocks.select(F.lit("false_positive").alias("kind"), F.inline(alone("pred", "gold")))
    fn = blocks.select(F.lit("false_negative").alias("kind"), F.inline(alone("gold", "pred")))
    return fp.unionByName(fn).select("kind", "label", "text")


def report(blocks: DataFrame) -> DataFrame:
    """One row of JSON with all of the above."""
    rows = lambda df, *order: F.to_json(F.sort_array(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))))
    tables = {"per_type": per_type(blocks), "micro": micro(blocks), "macro": macro(blocks), "by_stratum_relaxed": by_stratum(blocks), "errors": errors(blocks), "tokens": token_accuracy(blocks)}
    parts = [df.agg(F.lit(name).alias("part"), rows(df, df.columns[0]).alias("json")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def synthetic_corpus(spark: SparkSession) -> DataFrame:
    """block_idx, text, stratum, gold of the 18 annotated cases, seven of them decoys."""
    from ..sources.synthetic import CASES

    rows = [(i, text, "synthetic", [list(e) for e in entities]) for i, (text, entities) in enumerate(CASES)]
    return annotate(spark.createDataFrame(rows, "block_idx int, text string, stratum string, entities array<array<string>>"))


