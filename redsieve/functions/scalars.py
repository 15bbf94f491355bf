"""Scalar expressions: normal forms, hashes, check digits, shape tests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import _col, any_of

# The dihedral group of order ten and the permutation of the Verhoeff scheme.
_VERHOEFF_D = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 0, 6, 7, 8, 9, 5, 2, 3, 4, 0, 1, 7, 8, 9, 5, 6, 3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8, 5, 9, 8, 7, 6, 0, 4, 3, 2, 1, 6, 5, 9, 8, 7, 1, 0, 4, 3, 2, 7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
)
_VERHOEFF_P = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 5, 7, 6, 2, 8, 3, 0, 9, 4, 5, 8, 0, 3, 7, 9, 6, 1, 4, 2, 8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0, 4, 2, 8, 6, 5, 7, 3, 9, 0, 1, 2, 7, 9, 3, 8, 0, 6, 4, 1, 5, 7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
)


def words(values) -> Column:
    """A constant array. It is one literal that is split, which the optimiser folds, as a literal for each value is slow to plan."""
    if not len(values):
        return F.array().cast("array<string>")
    out = F.split(F.lit("\x1f".join(map(str, values))), "\x1f")
    return out.cast("array<int>") if isinstance(values[0], int) else out


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def among(value: Column, values) -> Column:
    return F.array_contains(words(values), value)


def digits(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), "[^0-9]", "")


def luhn(value: Column | str) -> Column:
    d = digits(value)
    return (F.length(d) >= 13) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def verhoeff(value: Column | str) -> Column:
    """Twelve digits whose check digit is right."""
    d = F.reverse(digits(value))
    table, turn = words(_VERHOEFF_D), words(_VERHOEFF_P)

    def step(c: Column, z: Column) -> Column:
        p = F.get(turn, (z["i"] % 8) * 10 + z["d"].cast("int"))
        return F.get(table, c * 10 + p)

    each = F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x, i: F.struct(i.alias("i"), x.alias("d")))
    return (F.length(d) == 12) & (F.aggregate(each, F.lit(0), step) == 0)


def normalise(value: Column | str) -> Column:
    """White space collapsed and stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(_col(value), r"(?U)\s+", " ")))


def hash64(value: Column, salt: str) -> Column:
    """The first 64 bits of a salted SHA-256 as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), value), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def shifted(h: Column, bits: int) -> Column:
    """h >> bits as decimal(20,0)."""
    return F.floor(h / F.lit(Decimal(2**bits)).cast("decimal(20,0)")).cast("decimal(20,0)") if bits else h


def modulo(h: Column, n: int) -> Column:
    return (h % F.lit(n).cast("decimal(20,0)")).cast("long")


def pick(pool: tuple[str, ...], h: Column, offset: int = 0) -> Column:
    at = (h.cast("decimal(38,0)") + F.lit(offset * 7919)) % F.lit(len(pool))
    return F.get(words(pool), at.cast("int"))


def mirrored(surrogate: Column, original: Column) -> Column:
    """Upper case where all letters of the original are upper case."""
    shouted = original.rlike(r"\p{L}") & ~original.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return F.when(shouted, F.upper(surrogate)).otherwise(surrogate)


def stripped(value: Column, chars: str) -> Column:
    return F.trim(value, F.lit(chars))


def collapsed(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\s+", " ")


def tokens(value: Column | str) -> Column:
    return F.filter(F.split(_col(value), r"(?U)\s+"), lambda t: t != "")


#: Where a word may begin: not behind a letter, a mark or a digit, or at a capital behind a small letter ("NameDirector").
WORD_BEGINS = r"(?:(?<![\p{L}\p{M}\p{N}])|(?<=\p{Ll})(?=\p{Lu}))"


def begins_any(text: Column, needles: tuple[str, ...]) -> Column:
    """Does a word of text begin with any needle, in either case? What stands within a word ("aged" in "managed") is none; what follows it (a plural) is free."""
    pattern = f"{WORD_BEGINS}(?i:{any_of(needles)})"
    # few texts have a needle at all, and the search for each is cheaper than the pattern
    return contains_any(F.lower(text), needles) & F.coalesce(text.rlike(pattern), F.lit(False)) if needles else F.lit(False)


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """Is any needle a substring of text? A search for each is several times as fast as an alternation of them."""
    return F.coalesce(let(text, lambda t: F.exists(words(needles), lambda k: F.contains(t, k))), F.lit(False))
