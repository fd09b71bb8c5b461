"""Operator 4: packing token sequences by bin completion.

Texts are encoded as they are read and cut into pieces; only longer documents are cut. The packing
itself depends on the pieces' lengths alone, so Spark counts the pieces of each length and the search
runs over that histogram, which has as many entries as a sequence has tokens, whatever the corpus.

Bin completion: the largest remaining piece opens a sequence and undominated fillings of the rest are
enumerated within the waste that a packing of fewer sequences than the incumbent leaves: no further
piece fits, and no set of pieces could be exchanged for one longer piece that is left (``_undominated``).
The best-fit packing is the first incumbent. The search deepens: it keeps 1, 3, 9 and at last all
fillings of a piece and goes back over them, each pass for one sequence less than the incumbent, until
the lower bound (``least_sequences``) is met, a pass without cuts proves the incumbent the best, or
``steps`` are used up. In the passes that keep some, a filling is used as often as its lengths last;
in the last one any number of times. ``steps=None`` searches until the result is proven. The ``pack``
of a corpus uses ``STEPS``, and at most as many fillings as that bounds are sent to the executors.

Each piece then takes its place by its rank among the pieces of its length: the rank within its task,
written with the piece, plus the number of such pieces in earlier tasks.

Nulls: a null text is the end token alone; a null doc_id is kept. Repeated rows are packed each. An
empty table gives an empty packing. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.chunks import chunks
from tidepanel.llm.store import sized, written

LENGTH, END = 1024, 2
#: Steps for a whole search and for the fillings of one piece in a pass that keeps some of them.
STEPS, NODE_STEPS = 400_000, 4000
#: Runs of this many blanks are encoded by another library, as the pattern can't go back over them.
LONG_RUN = 50_000
#: Encoded words that a worker keeps; they are dropped together at this many.
CACHED_WORDS = 400_000


class ByteTokenizer:
    """Ids of a byte-level vocabulary, little-endian unsigned 32-bit integers.

    Words between single spaces are encoded once and kept: no merge crosses a space that a visible
    character follows. A text with other runs of white space is encoded as a whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        from tidepanel.llm.bpe import byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: i for i, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        #: The split of byte-level vocabularies (fixed value).
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.words: dict[str, bytes] = {}
        self.path, self.slow = path, None

    def _ids(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
            from tokenizers import Tokenizer

            self.slow = self.slow or Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.coder.encode(text, allowed_special="all"), "<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace() or "<|" in word:
            return None
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        made = self._ids(" " + word)
        if len(word) <= 64:
            self.words[word] = made
        return made

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first[-1:].isspace() or not rest or not first:
            return self._ids(text)
        get = self.words.get
        found = [get(w) or self._word(w) for w in rest]
        if None in found or "<|" in first:
            return self._ids(text)
        return self._ids(first) + b"".join(found)


@lru_cache(2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task and the rank there among pieces of that length."""

    def run(batches):
        coder, task = tokenizer(path), TaskContext.get().partitionId()
        ranks = [0] * (length + 1)
        tail = np.array([END], "<u4").tobytes()
        for part in chunks(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = coder.encode(text or "") + tail
                n = len(ids) // 4
                start = 0
                for k in range(-(-n // length)):
                    size = (n - 1) % length + 1 if k == 0 else length
                    rows.append((doc, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, ranks[size]))
                    ranks[size] += 1
                    start += size
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


Packing = list[tuple[int, dict[int, int]]]


def least_sequences(counts: list[int], length: int = LENGTH) -> int:
    """A lower bound on the sequences of any packing: by all tokens, and for each k by the pieces of at least k."""
    n = np.array([*counts, *[0] * (length + 1 - len(counts))], object)
    size = np.arange(length + 1)
    total = int((n * size).sum())
    best = -(-total // length)
    for k in range(length // 2 + 1):
        alone, half, small = size > length - k, (size > length // 2) & (size <= length - k), (size >= k) & (size <= length // 2)
        room = int(n[half].sum()) * length - int((n * size)[half].sum())
        best = max(best, int(n[alone].sum()) + int(n[half].sum()) + max(0, -(-(int((n * size)[small].sum()) - room) // length)))
    return best


def _smeared(bits: int, by: int) -> int:
    """The bits moved up by 0, 1, ... ``by`` places, together."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def _undominated(items: list[tuple[int, int]], waste: int, left: int) -> bool:
    """Whether no set of the items could be exchanged for one piece among ``left`` (a bit for each length) that is longer, or as long as two or more."""
    if left & ((2 << waste) - 2):
        return False
    one = several = 0
    for size, n in items:
        for _ in range(n):
            several |= (several | one) << size
            one |= 1 << size
    return not (left & (_smeared(several, waste) | (_smeared(one << 1, waste - 1) if waste else 0)))


class _Steps:
    """What is left of a search's steps, and whether something has been cut."""

    def __init__(self, total: float):
        self.left, self.cut = total, False


def fillings(counts: list[int], room: int, allowed: int, kept: int | None, steps: _Steps) -> list[tuple[int, list[tuple[int, int]]]]:
    """Undominated fillings of ``room`` with at most ``allowed`` tokens of waste, least waste first: (waste, [(length, pieces)]).

    With ``kept``, that many at most, and within NODE_STEPS.
    """
    rising = [s for s in range(1, min(room, len(counts) - 1) + 1) if counts[s]]
    sums = [0]
    for s in rising:
        sums.append(sums[-1] + s * counts[s])
    every = sum(1 << s for s in range(1, len(counts)) if counts[s])
    found: list[tuple[int, list[tuple[int, int]]]] = []
    least = steps.left - NODE_STEPS if kept else 0
    perfect = 0

    def go(items: list[tuple[int, int]], space: int, below: int) -> bool:
        """Whether to stop."""
        nonlocal perfect
        steps.left -= 1
        if steps.left <= least:
            steps.cut = True
            return True
        top = bisect_right(rising, min(space, below))
        if sums[top] < space - allowed:
            return False
        if not top:
            left = every
            for size, n in items:
                if n == counts[size]:
                    left ^= 1 << size
            if _undominated(items, space, left):
                found.append((space, items))
                perfect += space == 0
                if kept and perfect >= kept:
                    steps.cut = True
                    return True
            return False
        for k in range(top - 1, -1, -1):
            size = rising[k]
            most = min(counts[size], space // size)
            for n in range(most, 0 if k else most - 1, -1):
                if go([*items, (size, n)], space - size * n, size - 1):
                    return True
        return False

    go([], room, room)
    found.sort(key=lambda x: (x[0], sum(n for _, n in x[1]), [-s for s, _ in x[1]]))
    if kept and len(found) > kept:
        steps.cut = True
        found = found[:kept]
    return found


def best_fit(counts: list[int], length: int = LENGTH) -> Packing:
    """Longest piece first into the fullest sequence that has room, over the histogram."""
    counts, out = list(counts), []
    for size in range(length, 0, -1):
        while counts[size]:
            made, room, s = {size: 1}, length - size, size
            while room:
                s = min(s, room)
                while s and counts[s] <= made.get(s, 0):
                    s -= 1
                if not s:
                    break
                made[s] = made.get(s, 0) + 1
                room -= s
            times = min(counts[s] // n for s, n in made.items())
            for s, n in made.items():
                counts[s] -= n * times
            out.append((times, made))
    return out


def _search(counts: list[int], length: int, target: int, kept: int | None, steps: _Steps) -> Packing | None:
    """A packing of at most ``target`` sequences, depth first; None if there is none or ``steps`` has run out or been cut."""
    state = list(counts)
    allowed = target * length - sum(s * n for s, n in enumerate(counts))
    seen: set[tuple[int, ...]] = set()
    path: list[list] = []  # choices left, times, pieces, waste
    barred = None
    while allowed >= 0:
        largest = next((s for s in range(length, 0, -1) if state[s]), 0)
        if not largest:
            return [(times, made) for _, times, made, _ in path]
        key = tuple(state)
        choices = []
        if key not in seen or barred is not None:
            if kept is None and barred is None and len(seen) < 1 << 16:
                seen.add(key)
            state[largest] -= 1
            for lost, items in fillings(state, length - largest, min(allowed, length), kept, steps):
                made = dict(items)
                made[largest] = made.get(largest, 0) + 1
                if made != barred:
                    most = min((counts_left + (s == largest)) // made[s] for s in made for counts_left in (state[s],))
                    most = min(most, allowed // lost) if lost else most
                    choices += [(t, made, lost, t < most) for t in range(most, 0 if kept is None else most - 1, -1)]
            state[largest] += 1
        path.append([iter(choices), 0, {}, 0])
        while path:
            if steps.left <= 0:
                steps.cut = True
                return None
            top = path[-1]
            for s, n in top[2].items():
                state[s] += n * top[1]
            allowed += top[3]
            chosen = next(top[0], None)
            if chosen is None:
                path.pop()
                continue
            times, made, lost, fewer = chosen
            top[1:] = [times, made, lost * times]
            for s, n in made.items():
                state[s] -= n * times
            allowed -= lost * times
            barred = made if fewer else None
            break
        else:
            return None
    return None


def complete(counts: list[int], length: int = LENGTH, steps: int | None = STEPS) -> Packing:
    """Sequences for a histogram of lengths (``counts[size]`` pieces): [(times, {size: pieces})]. Without ``steps``, a packing proven to have the fewest."""
    size = lambda packing: sum(t for t, _ in packing)
    best, least = best_fit(counts, length), least_sequences(counts, length)
    if steps is None:
        for target in range(least, size(best)):
            if (made := _search(counts, length, target, None, _Steps(float("inf")))) is not None:
                return made
        return best
    for kept in (1, 3, 9, None):
        share = _Steps(steps / 4)
        while size(best) > least:
            share.cut = False
            made = _search(counts, length, size(best) - 1, kept, share)
            if made is None:
                if not share.cut:
                    return best  # proven
                break
            best = made
    return best


def _places(packing: Packing, length: int) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, pieces a sequence, first sequence, place in the sequence)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used = [0] * (length + 1)
    first = 0
    for times, made in packing:
        at = 0
        for s, n in made.items():
            out.setdefault(s, []).append((used[s], n, first, at))
            used[s] += n * times
            at += n * s
        first += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    made = written(pieces(docs, path, length), "pieces")
    tasks = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = [0] * (length + 1)
    for size, n in made.groupBy("length").count().collect():
        counts[size] = n
    places = spark.sparkContext.broadcast(_places(complete(counts, length), length))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = written(tasks.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "ranks")

    def run(batches):
        for part in batches:
            sizes = part.column("length").to_numpy()
            ranks = part.column("rank").to_numpy() + part.column("earlier").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes).tolist():
                rows, mine = places.value[s], sizes == s
                r = ranks[mine]
                begin, n, first, at = rows[np.searchsorted(rows[:, 0], r, side="right") - 1].T
                sequence[mine] = first + (r - begin) // n
                offset[mine] = at + (r - begin) % n * s
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sequence), pa.array(offset)], [*part.schema.names[:5], "sequence_id", "offset"])

    ranked = made.join(sized(earlier, 24), ["task", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "earlier").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
