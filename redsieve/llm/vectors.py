"""What the two vector operators share: valid rows, and blocks of vectors packed into one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of vectors that aren't null or zero and whose components are all finite."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by their largest component first, as squares of very small or large ones aren't finite numbers above 0."""
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def pack(rows: DataFrame, keys: list[str], block: int, extra: str | None = None) -> DataFrame:
    """Rows (keys, vec_id, embedding[, extra: long]) as blocks of at most `block` rows of one key.

    Gives keys, block_id (string), n, dim, ids, vectors[, extra] with the last three as binary. Rows are sorted by the keys within
    partitions and streamed, so a key may have any number of rows; vectors of one block have one length.
    """
    cols = [*keys, "vec_id", "embedding", *([extra] if extra else [])]
    schema = ", ".join(f"{k} long" for k in keys) + ", block_id string, n int, dim int, ids binary, vectors binary" + (f", {extra} binary" if extra else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made, key, held = TaskContext.get().partitionId(), 0, None, []

        def out() -> pd.DataFrame:
            nonlocal made
            made += 1
            ids = np.array([r[0] for r in held], np.int64)
            x = np.stack([np.asarray(r[1], np.float64) for r in held])
            row = [*key[:-1], f"{task}-{made}", len(ids), x.shape[1], ids.tobytes(), x.tobytes()]
            if extra:
                row.append(np.array([r[2] for r in held], np.int64).tobytes())
            return pd.DataFrame([row], columns=[*keys, "block_id", "n", "dim", "ids", "vectors", *([extra] if extra else [])])

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                now = (*row[: len(keys)], len(row[len(keys) + 1]))
                if held and (now != key or len(held) >= block):
                    yield out()
                    held = []
                key = now
                held.append(row[len(keys) :])
        if held:
            yield out()

    return rows.select(*cols).sortWithinPartitions(*keys, F.size("embedding"), "vec_id").mapInPandas(run, schema)


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
