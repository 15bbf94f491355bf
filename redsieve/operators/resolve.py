"""Choosing spans that don't overlap: the longest first, then by score, start and recogniser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structured import SPAN


def of_types(spans: Column, types: Sequence[str] | None) -> Column:
    """Spans of enabled types; this comes before resolution, so an inner span may surface."""
    return spans if types is None else F.filter(spans, lambda s: s["pii_type"].isin(*types))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column) -> Column:
    """Greedy selection; ties go to the span that was listed first. The result is ordered by start."""
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct((s["start"] - s["end"]).alias("a"), (-s["score"]).alias("b"), s["start"].alias("c"), i.alias("d"), s.alias("s")),
        )
    )

    def keep(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlaps(k, x["s"])), kept).otherwise(F.concat(kept, F.array(x["s"])))

    return F.array_sort(F.aggregate(ranked, F.array().cast(SPAN), keep))
