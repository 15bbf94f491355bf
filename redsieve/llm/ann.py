"""Approximate nearest neighbours: learned partitions of a neighbour graph.

On a bounded sample the graph of exact nearest neighbours is cut into parts
of equal size, one for each PART vectors of the table within the bounds PARTS: from balanced seeds, vectors move to the part that most of their
neighbours are in, as long as it has room. A small classifier, multinomial
logistic regression on the vector, learns the parts. It then puts every vector of
the whole table into its most probable part, and sends a query to its several most
probable parts, whose vectors are reranked exactly in double precision.

How many parts a query visits is measured, not set: the fewest with which, for
queries of the sample, SURE of the nearest neighbours in the sample are reached.
On vectors without structure that is most of the parts.

A query that has found fewer than TOP, as the parts it visited hold no more, is sent to
all parts, so that it gets all candidates there are.

Parts are cut into blocks of vectors; blocks of queries meet blocks of vectors by
a join on the part, each meeting gives at most TOP rows for each query, and a window
over these keeps the nearest.

Defined results: vectors that are null, zero or hold null or non-finite
components are neither queries nor candidates, nor are rows with a null vec_id;
queries meet vectors of their own length; a query never meets rows of its own vec_id;
repeated rows of a candidate are candidates each; of rows of one query with different
vectors the least vector asks; a product beyond the range of a double is infinite, and ranks
as such, one that is not a number ranks last; ties go to the smaller vec_id; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import rows_a_batch, settle
from .vectors import pack, unit, unpack, valid

TOP = 20
QUERY_EVERY = 20
#: A part is to hold so many vectors; of the parts there are so many at least and at most.
PART = 4096
PARTS = (16, 128)
#: The sample: so many vectors for each part, and so many at least.
PER_PART = 64
SAMPLE = 4096
NEIGHBOURS = 10
SURE = 0.97
BLOCK = 4096
QUERIES = 512


def balanced_parts(graph: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """A part for each node of a neighbour graph (row: neighbours); no part is over a share of a k-th by more than 5 %."""
    n = len(graph)
    room = int(np.ceil(n / k * 1.05))
    # seeds: a walk over the graph fills one part after the other
    part, seen = np.full(n, -1), np.zeros(n, bool)
    queue: list[int] = []
    at = made = 0
    while made < n:
        while not queue:
            if not seen[at]:
                queue.append(at)
                seen[at] = True
            at += 1
        node = queue.pop(0)
        part[node] = min(made * k // n, k - 1)
        made += 1
        for other in graph[node]:
            if not seen[other]:
                seen[other] = True
                queue.append(int(other))
    size = np.bincount(part, minlength=k)
    for _ in range(rounds):
        votes = np.zeros((n, k))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            to = int(votes[node].argmax())
            if size[to] < room:
                size[part[node]] -= 1
                size[to] += 1
                part[node] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Multinomial logistic regression on the direction of a vector."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, probes: int):
        self.weights, self.bias, self.probes = weights, bias, probes

    @staticmethod
    def fit(x: np.ndarray, part: np.ndarray, k: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], k)), np.zeros(k)
        goal = np.eye(k)[part]
        m = [np.zeros_like(w), np.zeros_like(b)]
        v = [np.zeros_like(w), np.zeros_like(b)]
        for t in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - goal) / len(x)
            for i, (q, g) in enumerate(((w, x.T @ d + 1e-4 * w), (b, d.sum(axis=0)))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return w, b

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")


def _most_alike(rows: np.ndarray, others: np.ndarray, k: int, own: int | None = None) -> np.ndarray:
    """For each row the k others with the largest product, in pieces; with own, row i is other own + i, which is left out."""
    out = []
    for s in range(0, len(rows), 1024):
        near = rows[s : s + 1024] @ others.T
        if own is not None:
            near[np.arange(len(near)), own + s + np.arange(len(near))] = -np.inf
        out.append(np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def train(x: np.ndarray, most: int = PARTS[0]) -> Router:
    """From a sample of vectors, at most so many parts; the last eighth stays out of the classifier and tells how many parts to visit."""
    n = len(x)
    k = max(1, min(most, n // PER_PART))
    u = unit(x)
    if k == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    held = max(1, n // 8)
    base, test = slice(0, n - held), slice(n - held, n)
    graph = _most_alike(u[base], u[base], NEIGHBOURS, 0)
    w, b = Router.fit(u[base], balanced_parts(graph, k), k)
    router = Router(w, b, k)
    home = router.ranked(u[base])[:, 0]
    # for a query's nearest its length doesn't matter; that of the others does, relative to the largest component of all
    best = _most_alike(u[test], x[base] / np.abs(x).max(), TOP)
    order = router.ranked(u[test])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(k)[None, :], axis=1)
    visits = np.take_along_axis(place, home[best], axis=1)
    for probes in range(1, k + 1):
        if (visits < probes).mean() >= SURE:
            break
    return Router(w, b, probes)


def _routed(router: Router, every: bool):
    """(part, vec_id, embedding): each vector in its part, or in each of the parts that a query visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([np.asarray(e, np.float64) for e in batch["embedding"]])
            parts = router.ranked(unit(x))[:, : 1 if every else router.probes]
            yield pd.DataFrame({"part": parts.ravel(), "vec_id": batch["vec_id"].repeat(parts.shape[1]).to_numpy(), "embedding": batch["embedding"].repeat(parts.shape[1]).to_numpy()})

    return run


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            q, x = unpack(r.ids_q, r.vectors_q, r.dim)
            c, y = unpack(r.ids_c, r.vectors_c, r.dim)
            with np.errstate(over="ignore", invalid="ignore"):
                inner = np.nan_to_num(x @ y.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            other = q[:, None] != c[None, :]
            inner[~other] = -np.inf
            if len(c) > TOP:
                # all that tie with the last in are kept for the exact order; sums of another order may differ by a little
                last = np.partition(inner, len(c) - TOP, axis=1)[:, len(c) - TOP]
                slack = 1e-9 * np.maximum(1.0, np.abs(last, where=np.isfinite(last), out=np.zeros_like(last)))
                near = (inner >= (last - slack)[:, None]) & other
            else:
                near = other
            i, j = np.nonzero(near)
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (x[i] * y[j]).sum(axis=1)
            rank_by = np.nan_to_num(exact, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            order = np.lexsort((c[j], -rank_by, i))
            i, j, exact = i[order], j[order], exact[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            ok = rank < TOP
            yield pd.DataFrame({"query_id": q[i[ok]], "vec_id": c[j[ok]], "score": exact[ok]})


def nearest(embeddings: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its TOP nearest found."""
    rows = settle(valid(embeddings).where("vec_id is not null").withColumn("dim", F.size("embedding")), "vectors")
    out = None
    for dim in sorted(r[0] for r in rows.select("dim").distinct().toLocalIterator()):
        found = _nearest_of(rows.where(F.col("dim") == dim).select("vec_id", "embedding"), every)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def _nearest_of(own: DataFrame, every: int) -> DataFrame:
    """query_id, vec_id, score, of vectors of one length: at most TOP rows of each meeting of a query with a block."""
    spark, n = own.sparkSession, own.count()
    parts = min(max(PARTS[0], n // PART), PARTS[1])
    got = own.orderBy(F.md5(F.col("vec_id").cast("string")), "embedding").limit(max(SAMPLE, PER_PART * parts)).select("embedding").toLocalIterator()
    router = train(np.array([r[0] for r in got], np.float64), parts)
    routed = "part long, vec_id long, embedding array<double>"
    first = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # a part is dealt to as many tasks as it fills blocks
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 + n // (parts * BLOCK)))
    packed = lambda df, size, name: settle(pack(df.repartition("part", spread), ["part"], size), name)
    base = packed(own.mapInPandas(_routed(router, True), routed), BLOCK, "base")
    side = lambda d, s: d.select("part", F.col("dim").alias(f"dim_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("vectors").alias(f"vectors_{s}"))

    def met(asked: DataFrame) -> DataFrame:
        both = side(packed(asked, QUERIES, "queries"), "q").join(side(base, "c"), "part").withColumnRenamed("dim_q", "dim")
        with rows_a_batch(spark, 8):
            return settle(both.mapInPandas(_nearest, "query_id long, vec_id long, score double"), "found")

    found = met(first.mapInPandas(_routed(router, False), routed))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TOP)
    short = settle(first.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if short.isEmpty() or router.probes == router.weights.shape[1]:
        return found
    again = met(short.select(F.explode(F.sequence(F.lit(0), F.lit(router.weights.shape[1] - 1))).cast("long").alias("part"), "vec_id", "embedding"))
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
