"""BPE encoding and decoding by a deterministic automaton over tokens.

A state of the automaton is the token that was read last, an arc the token that may
come next. It starts with the symbols, any of which may follow any other, and is
compiled by a gadget for each merge (u, v) -> uv, in order, which does three things:
the state after u loses its arc v; the state after uv is added, with the arcs that the
state after v has at that moment; and every state with an arc u gets an arc uv. What
remains accepts exactly the sequences that the merges produce, one for each word.

With 49,000 tokens there would be some two thousand million arcs, nearly all of them
copies. So a gadget writes down what it changes: the arc that is lost and its merge,
the state that a new state is a copy of, the arc that a new arc goes with, and when. From
these the arcs of the transition table are filled in as words ask for them: an arc
is missing if it, or one that it was copied from, was lost before it was copied.

A word is encoded by running the automaton over it from its start. A tree of the
tokens' bytes tells which tokens begin at a position, and the table which of them the state
there has arcs for; the longest is taken first. As a beginning of a word is accepted in one way only, a position
that leads nowhere is left for good. Decoding emits the labels of the arcs.

Normal form, pre-splitting, special tokens and decoder are those of the vocabulary's file; a
component that isn't known here is an error. Pieces between white space don't touch each
other, so a worker remembers those it has seen.

Defined results: null text is empty, and an empty text has no tokens; texts are
encoded whole; rows are independent, so ties and repeats need nothing; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .util import ids_as_long, ids_as_text

VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
#: A worker remembers so many pieces, and so many of the words that they are split into.
PIECE_CACHE = 120_000
WORD_CACHE = 150_000
#: And so many entries of the transition table, besides those that gadgets wrote.
KNOWN_ARCS = 250_000
NEVER = 1 << 60

#: Fixed values. The vocabulary's library tells letters and digits by Unicode 16, later ones are marks to it; and
#: it lower-cases by Unicode 17, which has these capitals besides Python's.
_LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: By character, so a final sigma is lower-cased as any other.
_LOWER = {0x3A3: 0x3C3} | _CAPITALS

_SPACE = regex.compile(r"\s+")


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeAutomaton:
    """States are numbered by their tokens; START, before any token, has all arcs."""

    START = -1

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], end: str = WORD_END):
        self.labels: dict[int, str] = {i: s for s, i in vocabulary.items()}
        #: state << 20 | arc -> the merge whose gadget took it.
        self.lost: dict[int, int] = {}
        #: state -> the state that it is a copy of, and arc -> the arc that it goes with, with the merge that made either.
        self.copy_of: dict[int, tuple[int, int] | None] = {}
        self.goes_with: dict[int, tuple[int, int] | None] = {}
        #: The transition table: state << 20 | arc -> is it there?
        self.table: dict[int, bool] = {}
        made = {left + right for left, right in merges}
        for label, token in vocabulary.items():
            if label not in made:
                self.copy_of[token] = self.goes_with[token] = None
        for merge, (left, right) in enumerate(merges):
            self._gadget(merge, vocabulary[left], vocabulary[right], vocabulary[left + right])
        #: The tokens' bytes as a tree: node << 9 | byte -> node, with 256 for the end of a word; and node -> token.
        self.next: dict[int, int] = {}
        self.token: dict[int, int] = {}
        chars = {c: b for b, c in enumerate(_byte_chars())}
        for token in self.copy_of:
            label = self.labels[token]
            node = 0
            for step in [chars[c] for c in label.removesuffix(end)] + [256] * label.endswith(end):
                node = self.next.setdefault(node << 9 | step, len(self.next) + 1)
            self.token[node] = token

    def _gadget(self, merge: int, u: int, v: int, uv: int) -> None:
        """One merge; where the state after u has no arc v, there is nothing to merge and no state is added."""
        if u not in self.copy_of or v not in self.copy_of or not self._filled(u, v):
            return
        self.lost[u << 20 | v] = merge
        self.table[u << 20 | v] = False
        self.copy_of[uv], self.goes_with[uv] = (v, merge), (u, merge)

    def _filled(self, state: int, arc: int) -> bool:
        """Has the state the arc, by all merges so far?"""
        of, before = state, NEVER
        while True:
            with_, until = arc, NEVER
            while True:
                taken = self.lost.get(of << 20 | with_)
                # a state is copied before its merge takes arcs, an arc goes with one that its merge has left: no x follows xx by xx
                if taken is not None and taken < before and taken <= until:
                    return False
                if (further := self.goes_with[with_]) is None:
                    break
                # made by ever earlier merges, so the last one decides
                with_, until = further
            if (further := self.copy_of[of]) is None:
                return True
            of, before = further

    def has(self, state: int, arc: int) -> bool:
        """Has the state the arc? The table remembers."""
        key = state << 20 | arc
        there = self.table.get(key)
        if there is None:
            there = self._filled(state, arc)
            if len(self.table) < KNOWN_ARCS:
                self.table[key] = there
        return there

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        n, step, token, known = len(word), self.next.get, self.token.get, self.table.get
        at, state, out, ends, left, nowhere = 0, self.START, [], [], [], set()
        while at < n:
            # the tokens that begin here, the longest last
            node, arcs = 0, []
            for end in range(at, n):
                node = step(node << 9 | word[end])
                if node is None:
                    break
                if end + 1 < n:
                    if (arc := token(node)) is not None:
                        arcs.append((arc, end + 1))
                elif (last := step(node << 9 | 256)) is not None and (arc := token(last)) is not None:
                    arcs.append((arc, n))
            while True:
                if not arcs:
                    # back to the state before, which goes on with its next shorter token
                    nowhere.add(at)
                    out.pop()
                    ends.pop()
                    arcs = left.pop()
                    at, state = (ends[-1], out[-1]) if out else (0, self.START)
                    continue
                arc, end = arcs.pop()
                if end in nowhere:
                    continue
                if at:
                    there = known(state << 20 | arc)
                    if there is None:
                        there = self.has(state, arc)
                    if not there:
                        continue
                break
            out.append(arc)
            ends.append(end)
            left.append(arcs)
            at, state = end, arc
        return out


def _normaliser(spec: dict | None):
    """A function of text without white space, as the file's normalizer declares it."""
    if spec is None:
        return lambda text: text
    kind = spec["type"]
    if kind == "Sequence":
        steps = [_normaliser(s) for s in spec["normalizers"]]

        def all_of(text: str) -> str:
            for step in steps:
                text = step(text)
            return text

        return all_of
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return lambda text: unicodedata.normalize(kind, text)
    if kind == "Lowercase":
        return lambda text: text.lower() if text.isascii() else text.translate(_LOWER).lower()
    if kind == "Replace":
        pattern, new = _pattern(spec["pattern"]), spec["content"]
        if pattern.pattern == r"\s+" and not new.strip():
            # white space is where pieces end
            return lambda text: text
        return lambda text: pattern.sub(lambda _: new, text)
    raise NotImplementedError(f"normalizer {kind}")


def _pattern(spec: dict) -> regex.Pattern:
    """A declared pattern, whose letters and numbers are those of the library's Unicode tables."""
    text = spec["Regex"] if "Regex" in spec else regex.escape(spec["String"])
    for c in "LN":
        text = text.replace(rf"\p{{{c}}}", rf"[\p{{{c}}}--[{_LATER}]]")
    return regex.compile(text, regex.V1)


def _splitter(spec: dict) -> Callable[[str], list[str]]:
    """A function that gives what the pre-tokenizer keeps of a text: matches of its pattern, as bytes; all else goes."""
    first, *rest = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"] or [(r["type"], r["use_regex"], r["add_prefix_space"]) for r in rest] != [("ByteLevel", False, False)]:
        raise NotImplementedError(f"pre-tokenizer {spec}")
    pattern = _pattern(first["pattern"])
    if pattern.search(" \t\r\n\x85\u2003"):
        raise NotImplementedError("words with white space in them")
    plain = first["pattern"].get("Regex", "")
    if "\\" in re.sub(r"\[[^\]]*\]", "", plain) or not plain:
        return pattern.findall
    # the same for ASCII, where its classes are short
    for name, of in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9"), (r"\s", r" \t-\r")):
        plain = plain.replace(name, of)
    ascii_only = re.compile(plain)
    return lambda text: ascii_only.findall(text) if text.isascii() else pattern.findall(text)


class _Pieces(dict):
    """The ids of pieces, worked out when they are first asked for; so many short ones are remembered."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < PIECE_CACHE and len(piece) < 64:
            self[piece] = ids
        return ids


class WordTokenizer:
    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise NotImplementedError("a model with options that aren't known here")
        if spec["decoder"] is not None or spec["post_processor"] is not None:
            raise NotImplementedError("a decoder or post-processor")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise NotImplementedError("added tokens with options")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = MergeAutomaton(merges, dict(model["vocab"]), model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._normal, self._words = _normaliser(spec["normalizer"]), _splitter(spec["pre_tokenizer"])
        self.pieces = _Pieces(self._piece)
        self.words: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        out = b""
        for word in self._words(self._normal(piece)):
            ids = self.words.get(word)
            if ids is None:
                ids = array("I", self.automaton.encode(word.encode("utf-8"))).tobytes()
                if len(self.words) < WORD_CACHE and len(word) < 64:
                    self.words[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = self._special.split(text) if any(s in text for s in self.special) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            out += map(self.pieces.__getitem__, _SPACE.split(part) if not part.isascii() or _ODD.search(part) else part.split())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs; without a decoder in the file, they are set apart by blanks."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


#: White space for str.split() and not for the vocabulary's pattern.
_ODD = re.compile("[\x1c-\x1f]")


def load(name: str = VOCABULARY) -> WordTokenizer:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return WordTokenizer(json.load(file))


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(name: str) -> WordTokenizer:
    if name not in _LOADED:
        _LOADED[name] = load(name)
    return _LOADED[name]


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [tokenizer.encode(t or "") for t in batch["text"]]})

    return ids_as_long(ids_as_text(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id string, ids binary"), "doc_id")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [tokenizer.decode(i) for i in batch["ids"]]})

    return ids_as_long(ids_as_text(encoded.select("doc_id", "ids"), "doc_id").mapInPandas(run, "doc_id string, text string"), "doc_id")


def digest(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tokenizer.encode(text or "")
                out.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tokenizer.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = ids_as_text(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return ids_as_long(made, "doc_id")
