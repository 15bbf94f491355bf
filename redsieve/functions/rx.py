"""Regular-expression matches with offsets, which Spark has no built-in for.

The pieces between matches and the matches, zipped, add up to the text; folds over
them give every match its place. Offsets count code points. Patterns are Java's;
(?U) makes its classes Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: So many matches are placed by one fold, which copies what it has at each step.
AT_ONCE = 64


def _placed(steps: str, base: str) -> str:
    """Of steps (gap, match), in turn from code point base on, the matches as MATCH."""
    begin, end = "acc.at + length(s.`0`)", "acc.at + length(s.`0`) + length(s.`1`)"
    found = f"named_struct('at', {end}, 'out', concat(acc.out, array(named_struct('start', {begin}, 'end', {end}, 'text', s.`1`))))"
    return f"aggregate({steps}, named_struct('at', {base}, 'out', cast(array() as {MATCH})), (acc, s) -> if(s.`1` is null, acc, {found}), acc -> acc.out)"


def _in_parts(steps: str) -> str:
    """The same for many steps, in parts whose lengths are summed first, so that work is not in the square of their number."""
    parts = f"transform(sequence(0, int(floor((size({steps}) - 1) / {AT_ONCE}))), i -> slice({steps}, i * {AT_ONCE} + 1, {AT_ONCE}))"
    size = "aggregate(part, 0, (n, s) -> n + length(s.`0`) + coalesce(length(s.`1`), 0))"
    bases = f"aggregate({parts}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, part) -> named_struct('at', acc.at + {size}, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    return f"flatten(zip_with({parts}, {bases}, (part, base) -> {_placed('part', 'base')}))"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_in(text: str, pattern: str) -> Column:
    """All matches of pattern in text as MATCH, leftmost first and non-overlapping; both are SQL. A null text or pattern gives none.

    It is SQL, as an expression that is put together from Python takes a call for each of its parts.
    """
    steps = f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))"
    # a lambda's variable, so that the text is matched once
    placed = f"get(transform(array({steps}), z -> if(size(z) <= {AT_ONCE}, {_placed('z', '0')}, {_in_parts('z')})), 0)"
    return F.expr(f"coalesce({placed}, cast(array() as {MATCH}))")


def spans_of(text: Column | str, pattern: Column | str) -> Column:
    """spans_in() of a column by name and a pattern, or, for values within lambdas, which are short, one fold."""
    if isinstance(text, str) and isinstance(pattern, str):
        return spans_in(f"`{text}`", quoted(pattern))
    text, pattern = _col(text), F.lit(pattern) if isinstance(pattern, str) else pattern
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + F.length(z["g"])
        end = begin + F.length(z["m"])
        found = F.struct(begin.alias("start"), end.alias("end"), z["m"].alias("text"))
        return F.when(z["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out")))

    return F.coalesce(F.aggregate(steps, start, step, lambda acc: acc["out"]), F.array().cast(MATCH))


def has(text: Column | str, pattern: str) -> Column:
    return F.coalesce(_col(text).rlike(pattern), F.lit(False))


def escape(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"([\\.\[\]{}()*+?^$|&\-#])", r"\\$1")


def literal(text: str) -> str:
    """A pattern for exactly this text, in Java and in RE2 alike."""
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|&-#/" else c for c in text)


def any_of(words: tuple[str, ...], longest_first: bool = False) -> str:
    ordered = sorted(words, key=len, reverse=True) if longest_first else words
    return "|".join(map(literal, ordered))


def slice_of(text: Column | str, start: Column, end: Column) -> Column:
    """text[start:end] by code points from 0."""
    text = _col(text)
    return F.substring(text, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def window_of(text: Column | str, start: Column, end: Column) -> Column:
    """text[start:end] behind one character more of the kind that stands there, so that a window cut from within a word doesn't begin one: a small letter, "0" or a blank."""
    text = _col(text)
    before = F.when(start > 0, slice_of(text, start - 1, start)).otherwise(F.lit(""))
    kind = F.when(before.rlike(r"\p{Ll}"), F.lit("ß")).when(before.rlike(r"[\p{L}\p{M}\p{N}]"), F.lit("0")).otherwise(F.lit(" "))
    return F.concat(kind, slice_of(text, start, end))
