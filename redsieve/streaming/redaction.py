"""Redaction of streams.

What needs no names is stateless and runs on any stream as it is. Names need their
scope: a micro-batch is harvested by itself, together with what earlier batches made
known if a table of names is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import PII_TYPES
from ..operators.redact import NAMED, redact
from ..plans.config import RedactionConfig

STATELESS = tuple(t for t in PII_TYPES if t not in NAMED)


def redact_stream(stream: DataFrame, text: str = "text", config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """spans and redacted for every type but people and organisations; no state, no shuffle. Of the statistical layer, places are left."""
    types = tuple(t for t in (config.types or STATELESS) if t not in NAMED)
    return redact(stream, text, None, RedactionConfig(types, config.use_ner, config.ner_model, config.salt, policy=config.policy))


def counts_by_window(redacted: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, pii_type, n_entities over event time; rows later than `late` are left out."""
    rows = redacted.withWatermark(time, late).select(time, F.explode("spans").alias("s"))
    return rows.groupBy(F.window(time, window).alias("window"), F.col("s.pii_type").alias("pii_type")).agg(F.count(F.lit(1)).alias("n_entities"))


def each_batch(write: Callable[[DataFrame, int], None], text: str = "text", scope: str | None = None, config: RedactionConfig = RedactionConfig()):
    """For foreachBatch: all types, names shared within a scope of the batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(redact(batch, text, scope, config), batch_id)

    return run
