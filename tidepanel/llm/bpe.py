"""Operator 8: byte-pair encoding and decoding by a merge automaton.

``MergeAutomaton.compile`` adds one gadget for every merge, in order. Before any merge there is one
state with a loop for every base symbol. The gadget of merge t, ``(u, v) -> w``, redirects the path
u v: w gets a state of its own that is v's state as it stands then (``base`` and ``since``), w's arc
leaves the states that u's arc leaves then (``arc_of``), and v's arc is taken out of u's state
(``removed[u][v] = t``). So states stand for the last token read, the automaton is deterministic, and
its accepted paths are exactly the token sequences that the merges give. Arcs are kept in this
factored form and filled into a table as they are first used.

A word is encoded by following those arcs: for each of its prefixes there is one accepted path, and
its last token is looked up from the paths of the shorter prefixes. Decoding emits the arcs' labels.

Nulls: a null text counts as empty (no tokens); a null doc_id is kept. Repeated rows give equal
values. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import chunks

#: Unicode white space, as the tokenizer's pattern language has it (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
CHUNK = re.compile(rf"[^{SPACES}]+")
#: str.split() also parts at these, which are no white space there.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Encoded words that a worker keeps for its next rows, in two generations of at most this many each.
CACHED_WORDS = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton over tokens whose paths are the results of the merges."""

    def __init__(self, tokens: dict[str, int]):
        self.ids = tokens
        n = max(tokens.values(), default=-1) + 1
        self.base, self.arc_of, self.since = [-1] * n, [-1] * n, [-1] * n
        self.removed: list[dict[int, int]] = [{} for _ in range(n)]
        self.labels = [""] * n
        for text, i in tokens.items():
            self.labels[i] = text
        self.arcs: dict[int, bool] = {}
        self.trees: dict[str, dict] = {}

    @classmethod
    def compile(cls, tokens: dict[str, int], merges: list[tuple[str, str]]) -> MergeAutomaton:
        made = cls(tokens)
        for t, (u, v) in enumerate(merges):
            made.add_gadget(t, tokens[u], tokens[v], tokens[u + v])
        return made

    def add_gadget(self, t: int, u: int, v: int, w: int) -> None:
        if self.since[w] >= 0:
            raise ValueError(f"two merges make {self.labels[w]!r}")
        self.base[w], self.arc_of[w], self.since[w] = v, u, t
        self.removed[u][v] = t

    def _arc(self, state: int, label: int) -> bool:
        """Is there an arc ``label`` out of ``state``? Read off the gadgets; callers keep the answer in the table."""
        until_state = 1 << 62
        while state >= 0:
            gone = self.removed[state]
            if gone:
                part, until = label, 1 << 62
                while part >= 0:
                    t = gone.get(part)
                    # at one moment pairs merge from the left, so the state's own part goes first and the label's last
                    if t is not None and t < until_state and t <= until:
                        return False
                    until, part = self.since[part], self.arc_of[part]
            until_state, state = self.since[state], self.base[state]
        return True

    def _spell(self, end: str) -> dict:
        """A tree of all labels: edges are symbols and the end mark, None holds the token."""
        root: dict = {}
        for text, token in self.ids.items():
            node = root
            for c in text[: -len(end)] if end and text.endswith(end) else text:
                node = node.setdefault(c, {})
            if end and text.endswith(end):
                node = node.setdefault(end, {})
            node[None] = token
        return root

    def encode(self, word: str, end: str = "") -> list[int]:
        """Token ids of a pre-split word of base symbols; ``end`` is the mark that its last symbol carries."""
        root = self.trees.get(end)
        if root is None:
            root = self.trees[end] = self._spell(end)
        n, arcs, arc = len(word), self.arcs, self._arc
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            state = last[start]
            if start and state < 0:
                continue
            node = root
            for stop in range(start + 1, n + 1):
                node = node.get(word[stop - 1])
                if node is None:
                    break
                if stop == n and end:
                    node = node.get(end)
                    if node is None:
                        break
                if last[stop] < 0:
                    token = node.get(None)
                    if token is None:
                        continue
                    if start:
                        key = state << 32 | token
                        known = arcs.get(key)
                        if known is None:
                            known = arcs[key] = arc(state, token)
                        if not known:
                            continue
                    last[stop], begin[stop] = token, start
        if n and last[n] < 0:
            raise ValueError(f"{word!r} has symbols outside the vocabulary")
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at = begin[at]
        return out[::-1]


class WordTokenizer:
    """The whole way from text to ids and back for a vocabulary file whose words end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton.compile(model["vocab"], merges)
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.letters = byte_letters()
        self.strings = dict(enumerate(self.automaton.labels)) | {i: s for s, i in self.special.items()}
        self.splits = re.compile("|".join(f"({re.escape(s)})" for s in self.special) or r"(?!)")
        self.words: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.old_words: dict[str, tuple[bytes, str]] = {}
        self.old_pieces: dict[str, tuple[bytes, str]] = {}

    def _piece(self, piece: str) -> tuple[bytes, str]:
        made = self.pieces.get(piece)
        if made is not None:
            return made
        made = self.old_pieces.get(piece)
        if made is None:
            ids = self.automaton.encode("".join(map(self.letters.__getitem__, piece.encode())), self.end)
            made = pack(f"<{len(ids)}I", *ids), self.decode(ids)
        if len(piece) <= 64:
            if len(self.pieces) >= CACHED_WORDS:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = made
        return made

    def _word(self, word: str) -> tuple[bytes, str]:
        made = self.old_words.get(word)
        if made is None:
            plain = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
            if plain.isalpha():
                made = self._piece(plain)
            else:
                done = [self._piece(piece) for piece in PIECES.findall(plain)]
                made = b"".join([i for i, _ in done]), " ".join([s for _, s in done])
        if len(word) <= 64:
            if len(self.words) >= CACHED_WORDS:
                self.old_words, self.words = self.words, {}
            if len(self.automaton.arcs) >= 4 * CACHED_WORDS:
                self.automaton.arcs.clear()
            self.words[word] = made
        return made

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if "<|" in text and (parts := self.splits.split(text))[1:]:
            done = [(np.array([self.special[x]], "<u4").tobytes(), x) if x in self.special else self.encode(x) for x in parts if x]
            return b"".join(i for i, _ in done), " ".join(s for i, s in done if i)
        words = text.split() if not any(c in text for c in SEPARATORS) else CHUNK.findall(text)
        get = self.words.get
        found = [get(w) or self._word(w) for w in words]
        return b"".join([i for i, _ in found]), " ".join([s for _, s in found])

    def decode(self, ids) -> str:
        """Emit the label of every arc; labels are joined by one space, as the file asks for no other decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One compiled automaton for each Python worker."""
    return WordTokenizer(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded for every text."""

    def run(batches):
        coder = tokenizer(path)
        for part in chunks(batches):
            done = [coder.encode(x or "") for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([i for i, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
