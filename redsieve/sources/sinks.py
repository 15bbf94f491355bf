"""Sinks: the audit, the mapping and the evaluation report as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import report
from ..operators.redact import run_summary
from ..plans.config import RedactionConfig


def audit_json(detected: DataFrame, config: RedactionConfig = RedactionConfig(), scrubbed: tuple[str, ...] = ()) -> DataFrame:
    """json, one row; never the mapping."""
    summary = run_summary(detected, config, scrubbed)
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("json"))


def mapping_json(mapping: DataFrame) -> DataFrame:
    """pii_type, json of {original: surrogate}: one row for each type, as a type's values may be many. Sensitive."""
    return mapping.groupBy("pii_type").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("original", "surrogate"))))).alias("json"))


def mapping_document(mapping: DataFrame) -> DataFrame:
    """json, one row: {type: {original: surrogate}}, as one file holds it. All of a mapping is one value here, so it is for single documents. Sensitive."""
    by_type = mapping.groupBy("pii_type").agg(F.sort_array(F.collect_list(F.struct("original", "surrogate"))).alias("of"))
    listed = F.sort_array(F.collect_list(F.struct("pii_type", "of")))
    return by_type.agg(F.to_json(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["pii_type"], F.map_from_entries(x["of"]))))).alias("json"))


def write_audit(detected: DataFrame, path: str, config: RedactionConfig = RedactionConfig(), scrubbed: tuple[str, ...] = ()) -> None:
    audit_json(detected, config, scrubbed).write.text(path)


def write_mapping(mapping: DataFrame, path: str, whole: bool = False) -> None:
    """A row for each value; with whole, one object of all types."""
    if whole:
        mapping_document(mapping).coalesce(1).write.text(path)
    else:
        mapping.write.json(path)


def write_report(annotated: DataFrame, path: str) -> None:
    report(annotated).write.json(path)


def scrub_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Metadata columns of a table: whatever isn't empty becomes Redacted."""
    set_ = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", "Redacted").otherwise(F.col(c))
    return df.withColumns({c: set_(c) for c in columns})


def encoded(content: Column | str) -> Column:
    """A document as base64, as an HTTP reply carries it."""
    return F.base64(content)
