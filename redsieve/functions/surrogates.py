"""Surrogates: what each kind of value is replaced by, a pure function of salt, type and value."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import policy as P
from .scalars import digits, hash64, let, mirrored, modulo, normalise, pick, shifted, words

SALT = "redsieve-v1"


def _pad(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _digit(h: Column, i: Column) -> Column:
    """(h >> 3 i) % 10, and 0 once all bits are gone."""
    wraps = F.lit(Decimal(2**64))
    signed = F.when(h >= F.lit(Decimal(2**63)), h - wraps).otherwise(h).cast("long")
    later = F.call_function("shiftrightunsigned", signed, F.least(3 * i, F.lit(63))) % 10
    return F.when(i == 0, modulo(h, 10)).when(3 * i > 63, 0).otherwise(later).cast("int")


def _full_name(norm: Column, h: Column) -> Column:
    n = F.size(F.filter(F.split(norm, " "), lambda t: t != ""))
    first, last, middle = pick(P.FIRST_NAMES, h), pick(P.LAST_NAMES, h, 1), pick(P.LAST_NAMES, h, 2)
    return F.when(n == 1, last).when(n >= 3, F.concat_ws(" ", first, middle, last)).otherwise(F.concat_ws(" ", first, last))


def person(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return _full_name(norm, h)


def email(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    local = F.regexp_replace(F.substring_index(norm, "@", 1), r"\.", " ")
    return F.concat(F.replace(F.lower(let(hash64(local, salt), lambda x: _full_name(local, x))), F.lit(" "), F.lit(".")), F.lit("@"), pick(P.DOMAINS, h))


def phone(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    d = digits(raw)
    keep = F.when(F.ltrim(raw).startswith("+") & (F.length(d) > 2), 2).otherwise(0)
    chars = F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), c.rlike("[0-9]").alias("d")))
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        new = F.when(acc["i"] < keep, z["c"]).otherwise(_digit(h, acc["i"]).cast("string"))
        return F.when(z["d"], F.struct((acc["i"] + 1).alias("i"), F.concat(acc["out"], new).alias("out"))).otherwise(
            F.struct(acc["i"].alias("i"), F.concat(acc["out"], z["c"]).alias("out"))
        )

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def organisation(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    kept = F.lit("")
    # tried in this order; "private limited" ends in "limited" too
    for end, shown in ((" bank", " Bank"), (" trust", " Trust"), (" inc", " Inc"), (" ltd", " Ltd"), (" llp", " LLP"), (" limited", " Limited"), (" private limited", " Private Limited")):
        kept = F.when(F.endswith(norm, F.lit(end)), shown).otherwise(kept)
    return F.concat(pick(P.COMPANY_HEADS, h), F.lit(" "), pick(P.COMPANY_TAILS, h, 1), kept)


def address(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return F.concat_ws(", ", pick(P.STREETS, h), pick(P.LOCALITIES, h, 1), pick(P.CITIES, h, 2))


def ssn(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return F.concat_ws("-", _pad(100 + modulo(h, 800), 3), _pad(1 + modulo(shifted(h, 10), 99), 2), _pad(1 + modulo(shifted(h, 20), 9999), 4))


def credit_card(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    each = [F.lit(4), *(_digit(h, F.lit(i)) for i in range(14))]
    # the check digit comes last, so every other digit from the first counts twice
    total = sum((F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 == 0 else d) for i, d in enumerate(each))
    text = F.concat(*(d.cast("string") for d in each), ((10 - total % 10) % 10).cast("string"))
    return let(text, lambda t: F.concat_ws(" ", *(F.substring(t, 1 + 4 * i, 4) for i in range(4))))


def date_of_birth(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    year, month, day = 1955 + modulo(h, 45), 1 + modulo(shifted(h, 8), 12), 1 + modulo(shifted(h, 16), 28)
    name = F.get(words(P.MONTHS), (month - 1).cast("int"))
    return (
        F.when(F.contains(raw, F.lit("/")), F.concat_ws("/", _pad(day, 2), _pad(month, 2), year.cast("string")))
        .when(F.contains(raw, F.lit("-")), F.concat_ws("-", _pad(day, 2), _pad(month, 2), year.cast("string")))
        .otherwise(F.concat(name, F.lit(" "), day.cast("string"), F.lit(", "), year.cast("string")))
    )


def ip_address(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    groups = [F.lpad(F.lower(F.hex(modulo(shifted(h, 8 * i), 65536))), 4, "0") for i in range(4)]
    return F.when(F.contains(raw, F.lit(":")), F.concat(F.lit("2001:db8:"), F.concat_ws(":", *groups))).otherwise(
        F.concat(F.lit("198.51.100."), (modulo(h, 254) + 1).cast("string"))
    )


def _letter(n: Column) -> Column:
    return F.chr((n + 65).cast("long"))


def pan(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return F.concat(*(_letter(modulo(shifted(h, 5 * i), 26)) for i in range(5)), _pad(modulo(shifted(h, 25), 10000), 4), _letter(modulo(shifted(h, 40), 26)))


def aadhaar(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return F.concat_ws(" ", *(x.cast("string") for x in (2000 + modulo(h, 8000), modulo(shifted(h, 12), 9000) + 1000, modulo(shifted(h, 24), 9000) + 1000)))


def din(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return _pad(modulo(h, 90000000) + 10000000, 8)


def cin(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    return F.concat(F.lit("U"), (modulo(h, 90000) + 10000).cast("string"), F.lit("XX"), (1980 + modulo(h, 40)).cast("string"), F.lit("PLC"), (modulo(shifted(h, 8), 900000) + 100000).cast("string"))


def bank_account(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.length(digits(raw))), lambda i: i < F.length(digits(raw)))
    return F.array_join(F.transform(places, lambda i: _digit(h, i).cast("string")), "")


def website(norm: Column, raw: Column, h: Column, salt: str) -> Column:
    head = F.replace(F.lower(pick(P.COMPANY_HEADS, h)), F.lit(" "), F.lit(""))
    return F.concat(F.when(F.lower(raw).startswith("http"), "https://www.").otherwise("www."), head, F.lit("-example.com"))


#: A type's builder takes the normalised value, the value as it stands, the normal form's hash and the salt. More types may be added.
BUILDERS: dict[str, Callable[[Column, Column, Column, str], Column]] = {
    "PERSON": person,
    "EMAIL": email,
    "PHONE": phone,
    "ORGANISATION": organisation,
    "ADDRESS": address,
    "SSN": ssn,
    "CREDIT_CARD": credit_card,
    "DATE_OF_BIRTH": date_of_birth,
    "IP_ADDRESS": ip_address,
    "PAN": pan,
    "AADHAAR": aadhaar,
    "DIN": din,
    "CIN": cin,
    "BANK_ACCOUNT": bank_account,
    "WEBSITE": website,
}


def surrogate_of(pii_type: str, raw: Column, salt: str = SALT) -> Column:
    build = BUILDERS.get(pii_type)
    if not build:
        return F.lit("[REDACTED]")
    return let(normalise(raw), lambda norm: let(hash64(norm, salt), lambda h: let(build(norm, raw, h, salt), lambda made: mirrored(made, raw))))


def surrogate(pii_type: Column, raw: Column, salt: str = SALT, types: tuple[str, ...] | None = None) -> Column:
    out = F.lit("[REDACTED]")
    for name in types or tuple(BUILDERS):
        out = F.when(pii_type == name, surrogate_of(name, raw, salt)).otherwise(out)
    return F.when(pii_type.isNotNull(), out)
