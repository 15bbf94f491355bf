"""What several operators share: materialised tables, packed vectors, hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset, a temporary folder takes its place on a local master,
    as in tests; on any other it is an error, as each machine would write to a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir is not set, and the executors of {master} share no temporary folder")
        found = tempfile.mkdtemp(prefix="redsieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    It cuts the lineage: what is read back survives the loss of executors, and
    is not computed again for each use. The files stay as long as results may be
    read; who names the folder cleans it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what settle() wrote, once nothing that may still be read comes from it."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, n: int, read: int | None = None) -> Iterator[None]:
    """While tables of large rows are written, Python workers get so many rows at once, and so many (if given) are read from files at once."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": n} | ({"spark.sql.parquet.columnarReaderBatchSize": read} if read else {})
    before = {key: spark.conf.get(key) for key in new}
    for key, value in new.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. One of texts in so few pieces that cores would be idle, such as a single file with one row group, is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def tally(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Row count and an order-free checksum of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(cols)}))").alias("x")).first()
    return row["n"], row["x"] or 0


def ids_as_text(df: DataFrame, *ids: str) -> DataFrame:
    """Long ids as text, for Python: pandas would make floats of them where some are null."""
    return df.withColumns({c: F.col(c).cast("long").cast("string") for c in ids})


def ids_as_long(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ids})
