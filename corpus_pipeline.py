"""From raw documents to token ids, in five stages.

Each stage is written as Parquet into the shared folder and read again, so a
lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsieve.llm import bpe, lines, minhash, mixing, quality
from redsieve.llm.util import read, settle


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.learn(docs, read(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    Null and empty texts get the score of no evidence, that is of the curve's intercept, and stay or go by it; repeated rows
    get one score; any other column, whatever its name, stays as it is. An empty table gives an empty one.
    """
    return docs.where(quality.scored(_model(spark, docs, sf_dir)) >= 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before, n_chars (if there is one) counted anew.

    Null and empty texts stay as they are, as do texts without a line that takes part; a document of which no line is left
    goes. Rows that share doc_id and text count as one document, so all of them lose the same lines; a null doc_id comes
    first; other columns stay as they are.
    """
    left = lines.dedup_lines(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the least doc_id (null last), then the least hash of a text.

    Rows without words (null, empty or blank text) are near nothing and all stay, repeated or not. Of equal rows, and of rows that share
    doc_id and text but differ in other columns, the one whose JSON form is the least stays. Different texts of one doc_id are judged
    each by itself. Columns are not touched, whatever their names.
    """
    found = settle(minhash.near_duplicates(docs, with_text=True).where("root is not null").select("doc_id", "t", "root"), "near")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    each = found.groupBy("doc_id", "t", "root").agg(F.count(F.lit(1)).alias("n"))
    least = settle(found.groupBy("root").agg(F.min(first).alias("first")), "firsts")
    judged = each.join(least, "root").select("doc_id", "t", "n", first.eqNullSafe(F.col("first")).alias("kept"))
    whole = docs.select(F.col("doc_id").cast("long").alias("d"), minhash.text_hash().alias("of"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    judged = settle(judged, "judged")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("t"))
    left = whole.join(judged.where("not kept"), same, "left_anti")
    # of equal rows, and of rows that differ in other columns only, the least stays
    again = judged.where("kept and n > 1")
    one = left.join(again, same, "left_semi").groupBy("d", "of").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(again, same, "left_anti").select("row.*").unionByName(one.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the classifier's score is the weight of a document in the draw.

    Null and empty texts have size 0 and weigh as no evidence does; a null source is a source of its own, the last; ties in the
    draw go by doc_id, and repeated rows are taken together; other columns are kept, whatever their names.
    """
    return mixing.mix(docs, quality.scored(_model(spark, docs, sf_dir)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null text is empty, and an empty text has no tokens."""
    return bpe.digest(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: Trained dictionaries, shared shingle hashes and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
