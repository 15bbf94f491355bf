"""The public operators: detect, redact, count, map.

Names are harvested within a scope first, which is the only shuffle, and none where each
row is a scope; then every row is worked on alone, by expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from ..functions.scalars import normalise
from ..functions.surrogates import BUILDERS, surrogate
from ..plans.config import RedactionConfig
from . import contextual, ner
from .harvest import patterns, row_patterns
from .resolve import of_types, resolve
from .structured import SPAN, SPECS, RegexSpec, empty_spans, recognise

#: The types that only names known in a scope give.
NAMED = frozenset({"PERSON", "ORGANISATION"})


def structured_spans(text: str, types: tuple[str, ...] | None = None, specs: tuple[RegexSpec, ...] = SPECS) -> Column:
    """All spans of the structured recognisers; those of disabled types are never looked for."""
    found = [recognise(text, s) for s in specs if types is None or s.pii_type in types]
    return F.concat(*found) if found else empty_spans()


def _enabled(config: RedactionConfig, pii_type: str) -> bool:
    return config.types is None or pii_type in config.types


#: From the name of a text column to its spans, a column of SPAN.
Analyser = Callable[[str], Column]


def analyser_of(analyse: Callable[[str], Iterable]) -> Analyser:
    """An analyser from any function or bound method that gives entities for a text: objects with start, end, pii_type, score and source."""

    def run(text: str) -> Column:
        @F.pandas_udf(SPAN)
        def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(
                    [
                        [{"start": e.start, "end": e.end, "pii_type": str(e.pii_type), "text": t[e.start : e.end], "score": float(e.score), "source": e.source} for e in analyse(t)]
                        for t in part.fillna("")
                    ]
                )

        return found(F.col(text))

    return run


def detect(
    df: DataFrame,
    text: str = "text",
    scope: str | None = None,
    config: RedactionConfig = RedactionConfig(),
    specs: tuple[RegexSpec, ...] = SPECS,
    known: DataFrame | None = None,
    analysers: tuple[Analyser, ...] = (),
) -> DataFrame:
    """df with `spans`, the spans found in each text, without overlaps and by start.

    scope names the column whose rows share names. Without it, and where it is null, a row is a scope of its own, which needs no
    shuffle. `known` takes the place of harvesting: rows (scope, person_re, surname_re, org_re), scope '' for all rows if no column is
    named. analysers add spans of their own: each is a function from the text column's name to a column of spans (see
    analyser_of()). Columns context and is_header are used if df has them. Null text has no spans.
    """
    policy = config.policy
    raw = structured_spans(text, config.types, specs)
    parts = [raw]
    work = df
    if config.types is None or NAMED & set(config.types):
        context = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.col("context")).otherwise(F.col(text)) if "context" in df.columns else F.col(text)
        header = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in df.columns else F.lit(False)
        if scope is None and known is None:
            people, orgs = row_patterns(F.col(text), context, header, policy)
            work = df.withColumns({"_people": people, "org_re": orgs})
            work = work.withColumns({c: F.col("_people")[c] for c in ("person_re", "surname_re")})
        else:
            # rows without a scope share names only with rows that say the same, which know the same
            own = F.concat(F.lit("\0"), F.md5(F.concat_ws("\0", text, context, header.cast("string"))))
            work = df.withColumn("_scope", F.coalesce(F.col(scope).cast("string"), own) if scope else F.lit(""))
            if known is None:
                known = patterns(work.select(F.col("_scope").alias("scope"), F.col(text).alias("text"), context.alias("context"), header.alias("is_header")), policy)
            work = work.join(known.withColumnRenamed("scope", "_scope"), "_scope", "left")
        if _enabled(config, "PERSON"):
            parts += [contextual.known(text, "person_re", "PERSON", "PersonRecognizer"), contextual.by_surname(text, "surname_re", policy)]
        if _enabled(config, "ORGANISATION"):
            work = work.withColumn("_orgs", contextual.known(text, "org_re", "ORGANISATION", "OrganisationRecognizer"))
            parts += [F.col("_orgs"), contextual.by_legal_form(text, F.col("_orgs"), policy)]
    if _enabled(config, "ADDRESS"):
        parts.append(contextual.addresses(text, policy))
    if config.use_ner:
        parts.append(ner.entities(text, config.ner_model, policy))
    parts += [analyser(text) for analyser in analysers]
    spans = resolve(of_types(F.concat(*parts), config.types))
    return work.withColumn("spans", F.when(F.col(text).isNotNull(), spans).otherwise(empty_spans())).select(*df.columns, "spans")


def splice(text: Column | str, replacements: Column) -> Column:
    """text with each (start, end, new), ordered by start, put in; the rest is copied."""
    text = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct(r["end"].cast("int").alias("at"), F.concat(acc["out"], rx.slice_of(text, acc["at"], r["start"]), r["new"]).alias("out"))

    done = F.aggregate(replacements, start, step, lambda acc: F.concat(acc["out"], rx.slice_of(text, acc["at"], F.length(text))))
    return F.when(F.size(replacements) > 0, done).otherwise(text)


def with_surrogates(spans: Column, salt: str, types: tuple[str, ...] | None = None) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), surrogate(s["pii_type"], s["text"], salt, types).alias("new")))


def redact(df: DataFrame, text: str = "text", scope: str | None = None, config: RedactionConfig = RedactionConfig(), **more) -> DataFrame:
    """df with `spans` and `redacted`, the text with every span replaced by its surrogate."""
    found = detect(df, text, scope, config, **more)
    types = tuple(t for t in BUILDERS if _enabled(config, t))
    return found.withColumn("redacted", splice(text, with_surrogates(F.col("spans"), config.salt, types)))


def exploded(detected: DataFrame, *ids: str) -> DataFrame:
    """One row for each span, with the columns in ids."""
    # an inner explode would be planned with a filter on spans, for which they would be worked out once more
    return detected.select(*ids, F.inline_outer("spans")).where(F.col("start").isNotNull())


def counts(detected: DataFrame) -> DataFrame:
    """pii_type, n_entities, most first."""
    return exploded(detected).groupBy("pii_type").agg(F.count(F.lit(1)).alias("n_entities")).orderBy(F.desc("n_entities"), "pii_type")


def mapping(detected: DataFrame, order: tuple[str, ...], config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """pii_type, original, surrogate, ordered by the first two: for each normalised value its first surface by order, then start. It undoes the redaction: keep it apart."""
    rows = exploded(detected, *order)
    first = F.min_by("text", F.struct(*order, "start"))
    found = rows.groupBy("pii_type", normalise("text").alias("norm")).agg(first.alias("original"))
    return found.select("pii_type", "original", surrogate(F.col("pii_type"), F.col("original"), config.salt).alias("surrogate")).orderBy("pii_type", "original")


def run_summary(detected: DataFrame, config: RedactionConfig = RedactionConfig(), scrubbed: tuple[str, ...] = ()) -> DataFrame:
    """The one-row audit: blocks_processed, entities_redacted, counts_by_type, metadata_fields_scrubbed, ner_active."""
    totals = detected.agg(F.count(F.lit(1)).alias("blocks_processed"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("entities_redacted"))
    by_type = counts(detected).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pii_type", "n_entities")))).alias("counts_by_type"))
    fields = F.array(*map(F.lit, scrubbed)).cast("array<string>").alias("metadata_fields_scrubbed")
    # two one-row tables
    return totals.crossJoin(by_type).select("blocks_processed", "entities_redacted", "counts_by_type", fields, F.lit(config.use_ner and ner.active(config.ner_model)).alias("ner_active"))
