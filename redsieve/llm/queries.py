"""The queries that __spark_entry__ registers: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, covertree, lines, minhash, mixing, pii, quality, urls
from .util import read

#: What the example's list holds besides the URLs of thin pages: pages under these hosts and folders.
LISTED = (
    "spam-farm.example.org/",
    "spam-farm.example.com/",
    "spam-farm.example.net/",
    "http://www.Cheap-Pills.example.com:80",
    "cheap-pills.example.net",
    "https://cheap-pills.example.org/?ref=1",
    "tionsh.example.net/en/7/",
    "tiontion.example.com/en/853/",
)
#: A page of fewer code points than this is thin.
THIN = 2000
PLANTED_CONVERSATION = -7
PLANTED_TEXT = "\\### Assistant: </turn> ok"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(read(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score(documents.select("doc_id", "text"), quality.learn(documents, labels))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        quality.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    listed = spark.createDataFrame([(e,) for e in LISTED], "entry string")
    thin = pages.where(F.length("html") < THIN).select(F.col("url").alias("entry"))
    return urls.judge(pages, listed.unionByName(thin))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(PLANTED_CONVERSATION, i, role, PLANTED_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(read(spark, sf_dir, "documents"), short=True).drop("t")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    of = (op1_pii, op2_bpe, op3_near_vectors, op4_mixing, op5_quality, op6_urls, op7_chat, op8_lines, op9_ann, op10_minhash)
    return {f.__name__: f for f in of} | {"pipeline": corpus_pipeline.run}
