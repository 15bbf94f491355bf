"""Quality classifier: how much better a text compresses after good text than after bad.

Two Zstandard dictionaries are trained, on texts labelled good and on texts
labelled bad. A text is compressed with each; the difference of the two sizes,
divided by the larger, is positive when it looks like good text. A logistic curve,
fitted on labelled texts that the dictionaries haven't seen, makes it a score.

Labels are learnt from a bounded sample, at most SAMPLE texts of each label that have
a text, by the order of a digest of their ids. The sample's texts are taken whole,
for the dictionaries in pieces of at most PIECE bytes, which is as far back as a dictionary
helps, and for the curve as they are. Scoring takes whole texts of all documents.

Defined results: null and empty texts get the score of a difference of 0; without
labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows get the same score; a repeated or null label row counts as any other
or not at all; other columns are kept out of the score; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import settle

#: Labelled texts of each label that are learnt from.
SAMPLE = 1500
#: A dictionary is trained on pieces of so many bytes, of which a text may have any number.
PIECE = 1 << 15
DICTIONARY = 112_640
LEVEL = 3
#: Every so many-th text is kept from the dictionaries, for the curve.
CALIBRATE = 4


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = (_compressor(model.good), _compressor(model.bad)) if model.good else None

    def difference(self, text: str | None) -> float:
        return self.of_bytes((text or "").encode("utf-8", "surrogatepass"))

    def of_bytes(self, data: bytes) -> float:
        if not data or not self.pair:
            return 0.0
        good, bad = (len(c.compress(data)) for c in self.pair)
        return (bad - good) / max(bad, good)

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.difference(text) + self.model.intercept
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a slight pull to 0."""
    a, beta, scale = np.column_stack([x, np.ones_like(x)]), np.zeros(2), 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (p - y)) + scale * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + scale * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _order() -> Column:
    return F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")))


def _pieces(texts: list[bytes]) -> list[bytes]:
    return [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]


def fit(labelled: DataFrame, shares: dict[int, int] | None = None) -> Model:
    """From rows (doc_id, text, quality), of which at most SAMPLE of each label are fetched; shares, if known, are the numbers of labels."""
    rows = labelled.where("text is not null and text != '' and quality in (0, 1)")
    if shares is None:
        shares = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    plain = Model(b"", b"", 0.0, math.log((prior + 1e-6) / (1 - prior + 1e-6)))
    texts = {k: [r["text"].encode("utf-8", "surrogatepass") for r in rows.where(F.col("quality") == k).orderBy(_order(), "doc_id", F.xxhash64("text")).limit(SAMPLE).toLocalIterator()] for k in (0, 1)}
    if not all(texts.values()):
        return plain
    train = {k: [t for i, t in enumerate(v) if i % CALIBRATE] for k, v in texts.items()}
    try:
        good, bad = (zstandard.train_dictionary(DICTIONARY, _pieces(train[k])).as_bytes() for k in (1, 0))
    except zstandard.ZstdError:
        # too little text to find common parts in: the texts themselves are the dictionary
        good, bad = (b"".join(train[k] or texts[k])[-DICTIONARY:] for k in (1, 0))
    scorer = Scorer(Model(good, bad, 0.0, 0.0))
    x, y, w = [], [], []
    for label, of in texts.items():
        rest = [t for i, t in enumerate(of) if i % CALIBRATE == 0]
        for t in rest:
            x.append(scorer.of_bytes(t))
            y.append(label)
            w.append(shares.get(label, 0) / len(rest))
    scale = len(x) / sum(w)
    slope, intercept = _logistic(np.array(x), np.array(y, float), np.array(w) * scale)
    return Model(good, bad, slope, intercept) if slope > 0 else plain


def scored(model: Model, text: str = "text") -> Column:
    """A double from 0 to 1; nothing but text is looked at."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for part in parts:
            yield pd.Series([scorer.score(t) for t in part], dtype="float64")

    return run(F.col(text))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with score added."""
    return documents.withColumn("score", scored(model))


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels that may be learnt from.

    The sample is drawn from the labels that meet a document with text, by ids and without the texts; it is bounded, so a
    broadcast of it fetches the texts, and no text is ever shuffled.
    """
    known = labels.where(~held_out()).where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    there = documents.where("text != ''").select("doc_id")
    with_text = known.distinct().join(there, "doc_id", "left_semi")
    chosen = [with_text.where(F.col("quality") == k).orderBy(_order(), "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = settle(chosen[0].unionAll(chosen[1]).select(F.col("doc_id").alias("_l"), "quality"), "chosen")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_l")).select("doc_id", "text", "quality")
    return fit(settle(found, "labelled"), shares)
