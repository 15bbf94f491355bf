"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation's turns, in order, drive the machine; it tells whether the order of
roles is right, and each turn emits three segments: the mark that opens it, its
text and the mark that closes it. Only texts of roles with loss carry the loss
flag. Control strings inside texts are escaped, so that what is emitted can be
read back: every escape character, and the first character of each of the
template's control strings, gets an escape character before it, and a character
that stands within a control string is kept apart from the next one.

What is read back comes from the emitted text alone: turns are found by their marks,
roles and texts by undoing the escapes; only the loss mask is taken from the segments.

Turns are sorted on disk and streamed, so one conversation may be of any length. Its turns
are read in one task, as the digest over them is one chain.

Defined results: null text and null role are empty; a null turn comes first, ties
in turn go by role, then text; repeated rows are turns of their own; rows with a
null conv_id are one conversation; a wrong order is reported in `valid`, and formatted
all the same; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import ids_as_long, ids_as_text

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """open has a place for the role; moves: (state, role) -> state; final: states that a conversation may end in."""

    open: str = "### {role}: "
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    loss: frozenset = frozenset({"assistant"})
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: frozenset = frozenset({"answered"})

    def escaped(self, text: str) -> str:
        """Every character of a control string, and the escape character itself, behind an escape character."""
        pattern = "|".join(map(re.escape, (ESCAPE, *self.control)))
        return re.sub(pattern, lambda m: "".join(ESCAPE + c for c in m[0]), text)

    def unescaped(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def opening(self, role: str) -> str:
        return self.open.replace("{role}", self.escaped(role).replace(":", ESCAPE + ":"))

    def _first(self, mark: str, text: str) -> int:
        """Where a mark begins that is not escaped, or -1."""
        for m in re.finditer(rf"\\.|{re.escape(mark)}", text, re.DOTALL):
            if m[0] == mark:
                return m.start()
        return -1

    def turn_of(self, emitted: str) -> tuple[str, str, str] | None:
        """Role, text and what is left behind the first whole turn of what was emitted; None if its closing mark isn't there yet."""
        before, after = self.open.split("{role}")
        end = self._first(self.close, emitted)
        if end < 0:
            return None
        body = emitted[:end]
        at = self._first(after, body[len(before) :])
        if not body.startswith(before) or at < 0:
            raise ValueError("a turn without its opening mark")
        at += len(before)
        return self.unescaped(body[len(before) : at]), self.unescaped(body[at + len(after) :]), emitted[end + len(self.close) :]


#: Ids are text on their way through Python.
SEGMENTS = "conv_id string, turn string, seq long, part string, text string, loss boolean, valid boolean"
DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (SEGMENTS) of all conversations. `valid` tells, up to this segment, whether roles came in order; the closing
    mark of the last turn tells it of the whole: `seq` is -1 there.

    Segments of a conversation are in one partition, in order and next to each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, good, seq, held = object(), template.start, True, 0, None
        for batch in batches:
            out = []
            for c, turn, role, text in batch.itertuples(index=False, name=None):
                role, text = ("" if x is None else x for x in (role, text))
                if c != conv:
                    if held:
                        out.append((*held[:2], -1, *held[3:6], good and state in template.final))
                    conv, state, good, seq, held = c, template.start, True, 0, None
                elif held:
                    out.append(held)
                after = template.moves.get((state, role))
                good, state = good and after is not None, after or state
                out.append((c, turn, seq, "open", template.opening(role), False, good))
                out.append((c, turn, seq + 1, "text", template.escaped(text), role in template.loss, good))
                held = (c, turn, seq + 2, "close", template.close, False, good)
                seq += 3
                if len(out) >= 5000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)
        if held:
            yield _frame([(*held[:2], -1, *held[3:6], good and state in template.final)])

    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "turn", "seq", "part", "text", "loss", "valid"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ids_as_long(ids_as_text(ordered, "conv_id", "turn").mapInPandas(run, SEGMENTS), "conv_id", "turn")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """DIGESTS of each conversation, from its segments as format_conversations() leaves them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = chars = loss_chars = 0
        turns, loss, left = hashlib.sha256(), hashlib.sha256(), ""
        for batch in batches:
            out = []
            for c, _, seq, _, text, flag, valid in batch.itertuples(index=False, name=None):
                chars += len(text)
                left += text
                if flag:
                    plain = template.unescaped(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
                # text is added piece by piece, so whole turns are looked for only where a closing mark may have ended
                while left and text.endswith(template.close[-1]) and (turn := template.turn_of(left)):
                    role, said, left = turn
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if seq == -1:
                    if left:
                        raise ValueError("a turn without its closing mark")
                    out.append((c, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    n = chars = loss_chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return ids_as_long(ids_as_text(segments, "conv_id", "turn").mapInPandas(run, DIGESTS), "conv_id")
