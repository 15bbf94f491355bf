"""spark-submit cli.py INPUT OUTPUT: redact a table, or a folder of Word documents."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from redsieve.operators.redact import detect, mapping, redact, run_summary
from redsieve.plans.config import RedactionConfig, parse_types
from redsieve.sources.docx import blocks_of, files_under, redact_files
from redsieve.sources.sinks import write_audit, write_mapping


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", default="parquet", help="of the input: parquet, json, csv or docx")
    p.add_argument("--text", default="text")
    p.add_argument("--id", default="doc_id")
    p.add_argument("--scope", help="column within which names are shared; by default each text")
    p.add_argument("--types", help="comma-separated; all by default")
    p.add_argument("--no-ner", action="store_true", help="leave the statistical layer out; without its library it finds nothing anyway")
    p.add_argument("--ner-model", default=RedactionConfig.ner_model)
    p.add_argument("--salt", default=RedactionConfig.salt)
    p.add_argument("--keep-metadata", action="store_true")
    p.add_argument("--audit", help="where the audit goes")
    p.add_argument("--mapping", help="where the mapping goes; it undoes the redaction")
    p.add_argument("--verbose", "-v", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.verbose:
        spark.sparkContext.setLogLevel("INFO")
    config = RedactionConfig(parse_types(a.types), not a.no_ner, a.ner_model, a.salt, not a.keep_metadata, bool(a.mapping))
    word = a.format == "docx"
    try:
        df = files_under(spark, a.input) if word else spark.read.format(a.format).load(a.input)
        df.schema  # noqa: B018 - some sources look for their path only now
    except AnalysisException as error:
        print(f"error: {a.input}: {error.getCondition() or error}", file=sys.stderr)
        return 1
    if word:
        scope, order, text = a.scope or "doc_id", ("doc_id", "block_idx"), "text"
        done = detect(blocks_of(df), text, scope, config).where("error is null")
        written = redact_files(df, config, scope)
        written.write.parquet(a.output)
        scrubbed = [r[0] for r in spark.read.parquet(a.output).select(F.explode("scrubbed")).distinct().orderBy("col").collect()]
    else:
        done, order, scrubbed = redact(df, a.text, a.scope, config), (a.id,), ()
        done.drop(a.text, "spans").withColumnRenamed("redacted", a.text).write.parquet(a.output)
    summary = run_summary(done, config, tuple(scrubbed)).first()
    print(f"Redacted {summary['entities_redacted']} entities across {summary['blocks_processed']} blocks")
    for kind, n in sorted(summary["counts_by_type"].items(), key=lambda x: (-x[1], x[0])):
        print(f"  {kind:<16} {n:>6}")
    print(f"Statistical layer active: {summary['ner_active']}")
    if a.audit:
        write_audit(done, a.audit, config, tuple(scrubbed))
    if a.mapping:
        write_mapping(mapping(done, order, config), a.mapping, whole=word)
    return 0


if __name__ == "__main__":
    sys.exit(main())
