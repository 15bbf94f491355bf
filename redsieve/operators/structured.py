"""Recognisers for values with a structure of their own, declared as RegexSpec."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rx
from ..functions.scalars import begins_any, digits, luhn, verhoeff

SPAN = "array<struct<start:int,end:int,pii_type:string,text:string,score:double,source:string>>"


@dataclass(frozen=True)
class RegexSpec:
    """A recogniser: every match of pattern, if a word begins with a gate within window before it and validate holds."""

    source: str
    pii_type: str
    pattern: str
    score: float = 0.95
    gate: tuple[str, ...] = ()
    window: int = 60
    validate: Callable[[Column], Column] | None = None
    #: A cheap test that a text with a match passes.
    hint: str | None = None


_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def _octets(text: Column) -> Column:
    small = F.forall(F.split(text, "[.]"), lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))
    return F.contains(text, F.lit(":")) | small


def _ssn(text: Column) -> Column:
    area, group, serial = F.substring(text, 1, 3), F.substring(text, 5, 2), F.substring(text, 8, 4)
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


#: In registry order, which breaks ties between spans. The patterns and scores are fixed values, but that a local part never gives back.
SPECS: tuple[RegexSpec, ...] = (
    RegexSpec("EmailRecognizer", "EMAIL", r"\b[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}\b", 0.99, hint="@"),
    RegexSpec(
        "PhoneRecognizer",
        "PHONE",
        r"(?<![\d.])(?:\+\s?\d{1,3}[\s\-]?(?:\(\d{1,4}\)[\s\-]?)?\d{2,5}[\s\-]?\d{3,5}[\s\-]?\d{0,5}|0\d{2,4}[\s\-]\d{6,8})(?!\d)(?!\.\d)",
        0.95,
        validate=lambda t: F.length(digits(t)).between(8, 15),
        hint=r"[+0]",
    ),
    RegexSpec(
        "IPAddressRecognizer",
        "IP_ADDRESS",
        r"(?<![\w.])(?:(?:\d{1,3}\.){3}\d{1,3}|(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4})(?!\w)(?!\.\d)",
        0.99,
        validate=_octets,
        hint=r"[.:]",
    ),
    RegexSpec("SSNRecognizer", "SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", 0.97, validate=_ssn, hint="[0-9]"),
    RegexSpec("CreditCardRecognizer", "CREDIT_CARD", r"(?<![\d.])(?:\d[ \-]?){12,18}\d(?!\d)(?!\.\d)", 0.98, validate=luhn, hint="[0-9]"),
    RegexSpec(
        "DateOfBirthRecognizer",
        "DATE_OF_BIRTH",
        rf"(?i)\b(?:\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|\d{{1,2}}\s+{_MONTH}[a-z]*\,?\s+\d{{4}}|{_MONTH}[a-z]*\s+\d{{1,2}},?\s+\d{{4}})\b",
        0.9,
        gate=("date of birth", "birth date", "born on", "dob", "d.o.b"),
        window=40,
        hint="[0-9]",
    ),
    RegexSpec("PANRecognizer", "PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.97, hint="[0-9]"),
    RegexSpec("AadhaarRecognizer", "AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", 0.97, validate=verhoeff, hint="[0-9]"),
    RegexSpec("DINRecognizer", "DIN", r"(?<!\d)\d{8}(?!\d)", 0.85, gate=("din", "director identification"), window=50, hint="[0-9]"),
    RegexSpec("CINRecognizer", "CIN", r"\b[LUu]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b", 0.99, hint="[0-9]"),
    RegexSpec(
        "BankAccountRecognizer",
        "BANK_ACCOUNT",
        r"(?<!\d)\d{9,18}(?!\d)",
        0.85,
        gate=("account no", "account number", "a/c no", "a/c number", "account:"),
        window=45,
        hint="[0-9]",
    ),
    RegexSpec("WebsiteRecognizer", "WEBSITE", r"(?i)\b(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+", 0.9, hint="(?i)http|www"),
)


def empty_spans() -> Column:
    return F.array().cast(SPAN)


def as_spans(found: Column, pii_type: str, score: float, source: str) -> Column:
    """Matches as spans."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(pii_type).alias("pii_type"), m["text"].alias("text"), F.lit(score).alias("score"), F.lit(source).alias("source")
        ),
    )


def recognise(text: str, spec: RegexSpec) -> Column:
    """The spans of one recogniser in a column of text."""
    found = rx.spans_of(text, "(?U)" + spec.pattern)
    if spec.gate:
        before = lambda m: rx.window_of(text, F.greatest(m["start"] - spec.window, F.lit(0)), m["start"])
        found = F.filter(found, lambda m: begins_any(before(m), spec.gate))
    if spec.validate:
        found = F.filter(found, lambda m: spec.validate(m["text"]))
    spans = as_spans(found, spec.pii_type, spec.score, spec.source)
    worth = F.lit(True) if spec.hint is None else rx.has(text, spec.hint)
    if spec.gate:
        worth = worth & begins_any(F.col(text), spec.gate)
    return F.when(worth, spans).otherwise(empty_spans())
