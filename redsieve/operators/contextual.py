"""Pass B: people and organisations by what the scope has made known, and addresses by their postal code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rx
from ..functions.policy import DEFAULT, Policy
from ..functions.scalars import among, contains_any, tokens
from . import names as N
from .resolve import overlaps
from .structured import SPAN, as_spans, empty_spans

MAX_LEFT, MAX_RIGHT, LEAD_IN_REACH = 200, 60, 120
# The postal code, and what introduces an address.
PIN = r"(?U)\b\d{3}\s?\d{3}\b"
LEAD_IN = (
    r"(?iU)\b(?:situated|located|having its|registered|corporate|principal|branch|head|office|address|residing|resident)\b[^,]{0,40}?\bat\b\s*[:,]?\s*"
)


def _span(start: Column, end: Column, pii_type: str, text: Column, score: float, source: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(pii_type).alias("pii_type"), text.alias("text"), F.lit(score).alias("score"), F.lit(source).alias("source")
    )


def known(text: str, pattern: str, pii_type: str, source: str) -> Column:
    """Places of what a pattern column lists."""
    return F.when(F.col(pattern).isNotNull(), as_spans(rx.spans_in(f"`{text}`", f"`{pattern}`"), pii_type, 0.9, source)).otherwise(empty_spans())


def by_surname(text: str, pattern: str, policy: Policy = DEFAULT) -> Column:
    """Given names before a known surname, cut from the left until they are like a name; offsets are those of the tokens."""

    def trimmed(m: Column) -> Column:
        parts = rx.spans_of(m["text"], r"(?U)\S+")
        n = F.size(parts)
        tails = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i < n), lambda i: F.slice(parts, i, n - i + 1))
        good = F.filter(tails, lambda t: N.is_name_like(F.array_join(F.transform(t, lambda w: w["text"]), " "), policy))
        first = F.get(F.get(good, F.lit(0)), F.lit(0))["start"]
        phrase = F.array_join(F.transform(F.get(good, F.lit(0)), lambda w: w["text"]), " ")
        return _span(m["start"] + first, m["end"], "PERSON", phrase, 0.7, "PersonRecognizer:surname")

    found = F.transform(rx.spans_in(f"`{text}`", f"`{pattern}`"), trimmed)
    return F.when(F.col(pattern).isNotNull(), F.filter(found, lambda s: s["start"].isNotNull())).otherwise(empty_spans())


def by_legal_form(text: str, seen: Column, policy: Policy = DEFAULT) -> Column:
    """Phrases that end in a legal form and touch no known organisation; leading noise is left out of the span."""
    found = F.filter(rx.spans_of(text, N.org_pattern(policy)), lambda m: ~F.exists(seen, lambda s: overlaps(s, m)))
    named = F.transform(found, lambda m: F.struct(m.alias("m"), N.org_phrase(m["text"], policy).alias("p")))
    named = F.filter(named, lambda x: (x["p"] != "") & N.is_company(x["p"], policy))

    def placed(x: Column) -> Column:
        dropped = F.size(tokens(x["m"]["text"])) - F.size(tokens(x["p"]))
        skip = F.get(rx.spans_of(x["m"]["text"], r"(?U)\S+"), F.greatest(dropped, F.lit(0)))["start"]
        return _span(x["m"]["start"] + F.coalesce(skip, F.lit(0)), x["m"]["end"], "ORGANISATION", x["p"], 0.8, "OrganisationRecognizer:suffix")

    spans = F.transform(named, placed)
    return F.when(contains_any(F.lower(F.col(text)), policy.strong_suffixes), spans).otherwise(empty_spans())


def _left(text: str, pin: Column, policy: Policy) -> Column:
    """Behind the last mark in reach that ends a sentence: one after a word that is neither short, a number nor an abbreviation."""
    from_ = F.greatest(pin - MAX_LEFT, F.lit(0))
    window = rx.slice_of(text, from_, pin)
    marks = rx.spans_of(window, r"(?U)[.:;]\s+")

    def ends(m: Column) -> Column:
        word = F.lower(F.regexp_extract(rx.slice_of(window, F.lit(0), m["start"]), r"(?U)(\w+)\W*$", 1))
        return (F.length(word) > 1) & ~among(word, policy.abbreviations) & ~word.rlike(r"^\d+$")

    last = F.try_element_at(F.filter(marks, ends), F.lit(-1))
    return from_ + F.coalesce(last["end"], F.lit(0))


def addresses(text: str, policy: Policy = DEFAULT) -> Column:
    """From a postal code to the left as far as a sentence goes, and to the right over state and country."""
    state = rx.any_of(policy.states)

    def around(m: Column) -> Column:
        tail = rx.slice_of(text, m["end"], m["end"] + MAX_RIGHT)
        right = m["end"] + F.length(F.regexp_extract(tail, rf"(?iU)^[\s,\-–]*(?:{state})?[\s,\-–]*(?:India)?", 0))
        followed = F.ltrim(rx.slice_of(text, m["end"], m["end"] + MAX_RIGHT), F.lit(" ,-–")).rlike(rf"(?iU)^\b(?:{state})\b")
        return F.struct(_left(text, m["start"], policy).alias("start"), right.alias("end"), followed.alias("state"))

    found = F.transform(rx.spans_of(text, PIN), around)
    found = F.filter(found, lambda a: contains_any(F.lower(rx.slice_of(text, a["start"], a["end"])), policy.address_markers) | a["state"])

    def trimmed(a: Column) -> Column:
        whole = rx.slice_of(text, a["start"], a["end"])
        lead = F.coalesce(F.try_element_at(rx.spans_of(F.substring(whole, 1, LEAD_IN_REACH), LEAD_IN), F.lit(-1))["end"], F.lit(0))
        rest = rx.slice_of(whole, lead, F.length(whole))
        start = a["start"] + lead + F.length(rest) - F.length(F.ltrim(rest, F.lit(" ,-–:")))
        return _span(start, a["end"], "ADDRESS", rx.slice_of(text, start, a["end"]), 0.85, "AddressRecognizer")

    return F.when(rx.has(text, r"[0-9]{3}"), F.transform(found, trimmed)).otherwise(F.array().cast(SPAN))
