"""Pass A: people, organisations and header labels that a scope makes known.

The scope is a column: by default each document is one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import rx
from ..functions.policy import DEFAULT, Policy
from ..functions.scalars import among, contains_any, let, stripped, words
from . import names as N


def _block(blocks: DataFrame) -> DataFrame:
    """With the columns that harvesting needs; a missing context is the text itself."""
    have = set(blocks.columns)
    context = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.col("context")).otherwise(F.col("text")) if "context" in have else F.col("text")
    header = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in have else F.lit(False)
    return blocks.select("scope", "text", context.alias("context"), header.alias("is_header")).where("text is not null")


def header_texts(blocks: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """scope, header: header cells that are labels, so that no name is taken from them."""
    return _block(blocks).where(F.col("is_header") & ~N.has_person_context(F.col("text"), policy)).select("scope", F.lower("text").alias("header")).distinct()


def by_honorific(text: Column, policy: Policy = DEFAULT) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(N.honorific_pattern(policy)), F.lit(1)), F.trim)
    return F.filter(found, lambda p: N.is_name_like(p, policy))


def by_email(text: Column, policy: Policy = DEFAULT) -> Column:
    locals_ = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Za-z0-9._%+\-]+)@"), F.lit(1))
    return F.filter(F.transform(locals_, lambda x: N.name_from_email(x, policy)), lambda n: n.isNotNull())


def by_name_then_role(text: Column, policy: Policy = DEFAULT) -> Column:
    found = F.regexp_extract_all(text, F.lit(N.name_role_pattern(policy)), F.lit(1))
    named = F.filter(F.transform(found, lambda p: N.longest_name(p, policy)), lambda n: n.isNotNull())
    return F.when(N.has_person_context(text, policy), named).otherwise(F.array().cast("array<string>"))


def by_label_list(text: Column, policy: Policy = DEFAULT) -> Column:
    """Role: name, name and name, after the first such label only."""
    listed = F.regexp_extract(text, N.label_pattern(policy), 1)
    parts = F.split(listed, r"(?U),|\band\b|/|;")
    found = F.filter(F.transform(parts, lambda p: N.longest_name(F.trim(p), policy)), lambda n: n.isNotNull())
    return F.when(N.has_person_context(text, policy), found).otherwise(F.array().cast("array<string>"))


def by_short_block(text: Column, context: Column, policy: Policy = DEFAULT) -> Column:
    """Names in a short block, such as a cell, near a role in its row."""
    # a block this long isn't looked into
    short = F.when(F.length(text) <= N.MAX_CONTEXT_BLOCK, text)
    candidates = rx.spans_of(short, "(?U)" + N.CANDIDATE)
    named = F.transform(candidates, lambda m: F.struct(m["start"].alias("start"), N.longest_name(m["text"], policy).alias("name")))

    def sound(x: Column) -> Column:
        tail = rx.slice_of(text, x["start"] + F.length(x["name"]), x["start"] + F.length(x["name"]) + N.SUFFIX_REACH)
        return x["name"].isNotNull() & ~N.looks_like_org(tail, policy) & N.keyword_is_near(x["name"], context, policy)

    found = F.transform(F.filter(named, sound), lambda x: x["name"])
    return F.when((F.length(text) <= N.MAX_CONTEXT_BLOCK) & N.has_person_context(context, policy), found).otherwise(F.array().cast("array<string>"))


def people_in(text: Column, context: Column, policy: Policy = DEFAULT) -> tuple[Column, Column]:
    """Names by title or mailbox, and those by role, which header labels may still rule out."""
    sure = F.concat(by_honorific(text, policy), by_email(text, policy))
    return sure, F.concat(by_name_then_role(text, policy), by_label_list(text, policy), by_short_block(text, context, policy))


def by_legal_form(text: Column, policy: Policy = DEFAULT) -> Column:
    """Organisations by their legal form, and what they are called without it if that is two words or more."""
    phrases = F.transform(F.regexp_extract_all(text, F.lit(N.org_pattern(policy)), F.lit(1)), lambda raw: N.org_phrase(raw, policy))
    full = F.filter(phrases, lambda p: (p != "") & N.is_company(p, policy))

    def both(p: Column) -> Column:
        short = F.filter(F.array(N.strip_suffix(p, policy)), lambda s: (F.size(F.split(s, r"\s+")) >= 2) & ~N.is_public_body(s, policy))
        return F.concat(F.array(p), short)

    named = F.flatten(F.transform(full, both))
    return F.when(contains_any(F.lower(text), policy.strong_suffixes), named).otherwise(F.array().cast("array<string>"))


def mined(blocks: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """scope, people, orgs: arrays of the distinct names that each scope makes known, in one pass and one shuffle."""
    rows = _block(blocks)
    text = F.col("text")
    label = F.col("is_header") & ~N.has_person_context(text, policy)
    sure, by_role = people_in(text, F.col("context"), policy)
    none = F.array().cast("array<string>")
    kinds = {"sure": F.when(label, none).otherwise(sure), "by_role": F.when(label, none).otherwise(by_role), "orgs": by_legal_form(text, policy), "headers": F.when(label, F.array(F.lower(text))).otherwise(none)}
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    each = F.flatten(F.array(*(tagged(kind, values) for kind, values in kinds.items())))
    found = rows.select("scope", F.explode(each).alias("x")).groupBy("scope").agg(*(F.collect_set(F.when(F.col("x.kind") == kind, F.col("x.value"))).alias(kind) for kind in kinds))
    # a name in a header label is none
    free = F.filter("by_role", lambda n: ~F.exists("headers", lambda h: F.contains(h, F.lower(n))))
    return found.select("scope", F.array_union("sure", free).alias("people"), "orgs")


def person_names(blocks: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """scope, name: people by title, mailbox, role, list of roles, or a role near by."""
    return mined(blocks, policy).select("scope", F.explode("people").alias("name"))


def org_names(blocks: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """scope, name: organisations by their legal form, and what they are called without it."""
    return mined(blocks, policy).select("scope", F.explode("orgs").alias("name"))


def variants_of(name: Column) -> Column:
    """A name, its first and last word alone, and titles with its last."""
    parts = F.split(name, r"\s+")
    first, last, n = F.get(parts, F.lit(0)), F.element_at(parts, -1), F.size(parts)
    none = F.array().cast("array<string>")
    short = F.when(n >= 3, F.array(F.concat_ws(" ", first, last))).otherwise(none)
    titled = F.when(n >= 2, F.transform(words(P.VARIANT_HONORIFICS), lambda h: F.concat_ws(" ", h, last))).otherwise(none)
    return F.array_union(F.array(name), F.concat(short, titled))


def surname_of(name: Column, policy: Policy = DEFAULT) -> Column:
    """A name's last word if it is long enough to tell a relative by, else null."""
    parts = F.split(name, r"\s+")
    last = F.element_at(parts, -1)
    blocked = (*policy.non_person, *policy.more_non_person)
    return F.when((F.size(parts) >= 2) & (F.length(last) >= 4) & ~among(F.lower(last), blocked), last)


def person_variants(names: DataFrame) -> DataFrame:
    """scope, name: names as they may also be written."""
    return names.select("scope", F.explode(variants_of(F.col("name"))).alias("name")).distinct()


def surname_families(names: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """scope, surname: last names long enough to tell a relative by."""
    return names.select("scope", surname_of(F.col("name"), policy).alias("surname")).where("surname is not null").distinct()


def alternation(phrases: Column) -> Column:
    """A pattern for any of an array of phrases: longest first, ties by text; white space in a phrase matches any."""
    ranked = F.array_sort(
        F.transform(F.array_distinct(phrases), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"), F.array_join(F.transform(F.split(p, r"(?U)\s+"), rx.escape), r"\s+").alias("e")))
    )
    return F.array_join(F.transform(ranked, lambda x: x["e"]), "|")


def _whole(phrases: Column) -> Column:
    return F.when(F.size(phrases) > 0, F.concat(F.lit(r"(?iU)\b(?:"), alternation(phrases), F.lit(r")\b")))


def _families(surnames: Column) -> Column:
    before = r"(?U)\b(?:(?:[A-Z][A-Za-z'\-]{1,20}|[A-Z])\.?\s+){1,3}(?i:"
    return F.when(F.size(surnames) > 0, F.concat(F.lit(before), alternation(surnames), F.lit(r")\b")))


def row_patterns(text: Column, context: Column, is_header: Column, policy: Policy = DEFAULT) -> tuple[Column, Column]:
    """For rows that are scopes of their own: struct(person_re, surname_re), and org_re. No shuffle is needed."""
    sure, by_role = people_in(text, context, policy)
    no_label = ~is_header | N.has_person_context(text, policy)
    names = F.when(no_label, F.array_distinct(F.concat(sure, by_role))).otherwise(F.array().cast("array<string>"))
    return let(names, lambda n: _person_patterns(n, policy)), let(by_legal_form(text, policy), _whole)


def _person_patterns(names: Column, policy: Policy) -> Column:
    surnames = F.filter(F.transform(names, lambda x: surname_of(x, policy)), lambda x: x.isNotNull())
    return F.struct(_whole(F.flatten(F.transform(names, variants_of))).alias("person_re"), _families(surnames).alias("surname_re"))


def patterns(blocks: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """scope, person_re, surname_re, org_re: what each scope has made known, as patterns; null where there is nothing."""
    found = mined(blocks, policy).select("scope", _person_patterns(F.col("people"), policy).alias("p"), _whole(F.col("orgs")).alias("org_re"))
    return found.select("scope", "p.*", "org_re")


def propagate_by_words(blocks: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """block columns with start, end, text of every place where a name of its scope stands, by a hash join on runs of words.

    For scopes with so many names that one pattern would be too large: runs of up to `most` words meet the names by equality, so no
    side is ever held whole. A word is anything between white space, less marks at the run's ends.
    """
    found = blocks.where("text is not null").withColumn("_w", rx.spans_of("text", r"(?U)[\p{L}\p{N}'.&\-]+"))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(most)),
            lambda k: F.transform(F.filter(F.transform("_w", lambda w, i: i), lambda i: i + k <= F.size("_w")), lambda i: F.slice(F.col("_w"), i + 1, k)),
        )
    )
    each = found.withColumn("_r", F.explode(runs)).drop("_w")
    joined = F.lower(F.array_join(F.transform("_r", lambda w: w["text"]), " "))
    each = each.withColumn("_n", stripped(joined, ".")).withColumn("start", F.get("_r", F.lit(0))["start"]).withColumn("end", F.element_at("_r", -1)["end"])
    keyed = names.select(F.col("scope").alias("_s"), F.lower("name").alias("_n")).distinct()
    return each.join(keyed, (F.col("scope") == F.col("_s")) & (each["_n"] == keyed["_n"])).drop("_r", "_n", "_s")
