"""Operator 12: which words of a corpus stand in phrases of a benchmark, by an FM-index for each shard.

``index`` cuts the texts into shards of about a million words and writes for each one a full-text index: the
words' suffix order (prefix doubling), its Burrows-Wheeler sequence as a wavelet matrix with rank
counts, and every 16th suffix position. An index knows nothing of any phrases and can be
kept and searched again. ``search`` takes all phrases of a block backwards through the ranks of a
shard at once, locates their occurrences by walking to the nearest sampled position, and merges these
into removal spans.

Texts are laid out as pieces of 256 words that overlap by ``REACH - 1``, each with a mark of its own at its
end; so no suffix is compared over more than a piece, copies included, and no phrase of up to ``REACH``
words is lost between two. Shards hold less than 2**20 symbols however long a text is. Nothing of the
corpus is shuffled or leaves its task but the results. Phrases go to the tasks in blocks of a
bounded number; with more than one block the index is written once in the shared folder.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased, and known by 64
bits (``chunks.Words.hashes``); of v different words about v^2 / 2^65 pairs share a value.

Nulls: a null text has no words; a null doc_id is kept; a null item_id is the empty string. Repeated rows
are searched each; items that repeat an id are one item with the phrases of all. An empty benchmark
hits nothing, an empty corpus gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import LOWER, Words, chunks, text_bytes
from tidepanel.llm.store import written

#: Words of a phrase, and of the longest phrase that an index can be searched for.
SIZE = REACH = 10
PIECE = 256
#: Symbols of a shard; three numbers below it (one of them doubled) fill the 64 bits of a sort key.
SHARD = (1 << 20) - 1
#: Bytes of text that make up one row of the index.
SHARD_BYTES = 4 << 20
SAMPLED = 16
#: Phrase rows in a block: 10 words of 8 bytes and an item's name each.
BLOCK = 1 << 17
#: Occurrences that are located at once.
LOCATED = 1 << 19

_BREAK = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _BREAK[_a:_b] = False
_U = np.uint64


class Terms(Words):
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased texts."""

    def __init__(self, texts: pa.Array):
        self.data, at = text_bytes(texts)
        self.data = LOWER[self.data]
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(_BREAK[self.data], out=inside[1 : n + 1])
        border = np.zeros(n + 1, bool)
        border[at] = True
        edge = (inside[1:] != inside[:-1]) | border
        self.starts = np.flatnonzero(edge & inside[1:])
        self.ends = np.flatnonzero(edge & inside[:-1])
        self.first = np.searchsorted(self.starts, at)


# --- building ---------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols whose marks (0) differ from each other by their place and sort first; the last one is a mark."""
    n = len(symbols)
    bits = max(n.bit_length(), 1)
    b, low = _U(bits), _U((1 << bits) - 1)
    marks = symbols == 0
    first = np.where(marks, np.cumsum(marks) - 1, symbols + np.int64(marks.sum())).astype(np.uint64)
    place = np.arange(n, dtype=np.uint64)
    key = first << (b + _U(1))
    key[:-1] |= first[1:]
    key = np.sort((key << b) | place)
    rank = np.zeros(n, np.uint64)
    old = np.zeros(n, np.int64)  # where the group that was sorted begins
    base = np.zeros(n, np.uint64)  # and its rank
    h = 2
    while True:
        where = (key & low).astype(np.int64)
        top = key >> b
        new = np.ones(len(key), bool)
        new[1:] = top[1:] != top[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[where] = base + (at - old).astype(np.uint64)
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = where[~alone]
        if not len(open_):
            break
        base = rank[open_]
        # an open suffix has no mark among its first h symbols, so the one h further on exists
        key = np.sort((((base << b) | rank[open_ + h]) << b) | open_.astype(np.uint64))
        base = key >> (b + b)
        fresh = np.ones(len(key), bool)
        fresh[1:] = base[1:] != base[:-1]
        old = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        h *= 2
    order = np.empty(n, np.int64)
    order[rank.astype(np.int64)] = np.arange(n)
    return order


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in 64-bit words (one more at the end), and the ones before each word."""
    size = len(bits) // 64 + 1
    held = np.zeros(8 * size, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    held[: len(packed)] = packed
    words = held.view("<u8")
    ones = np.bitwise_count(words).astype(np.int32)
    return words, np.cumsum(ones, dtype=np.int32) - ones


def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Ones among the first i bits."""
    at = i >> 6
    return before[at] + np.bitwise_count(words[at] & ((_U(1) << (i & 63).astype(np.uint64)) - _U(1)))


def _mirrored(symbols: np.ndarray, levels: int) -> np.ndarray:
    out = np.zeros_like(symbols)
    for k in range(levels):
        out |= ((symbols >> k) & 1) << (levels - 1 - k)
    return out


class Shard:
    """The FM-index of a sequence of words in pieces."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.__dict__.update(arrays)
        self.levels = len(self.words)

    @classmethod
    def build(cls, hashes: np.ndarray, row: np.ndarray, word: np.ndarray, size: np.ndarray) -> Shard:
        """Of the pieces hashes[k] (one after the other, ``size`` words each), which begin at a row's word."""
        coded = pc.dictionary_encode(pa.array(hashes))
        own = coded.dictionary.to_numpy()
        order = np.argsort(own)
        number = np.empty(len(own), np.int32)
        number[order] = np.arange(1, len(own) + 1)
        at = np.cumsum(size + 1) - size - 1
        symbols = np.zeros(int(size.sum()) + len(size), np.int32)
        offset = np.arange(len(symbols)) - np.repeat(at, size + 1)
        symbols[offset < np.repeat(size, size + 1)] = number[coded.indices.to_numpy()]
        suffixes = suffix_order(symbols)
        levels = max(len(own).bit_length(), 1)
        counts = np.bincount(symbols, minlength=len(own) + 1)
        mirrored = np.argsort(_mirrored(np.arange(len(own) + 1), levels))
        ends = np.empty(len(own) + 1, np.int64)
        ends[mirrored] = np.cumsum(counts[mirrored]) - counts[mirrored]
        # what a level has moved to the right, the next one reads there
        held, words, before, zeros = symbols[suffixes - 1], [], [], []
        for k in reversed(range(levels)):
            bits = (held >> k) & 1 == 1
            w, b = _packed(bits)
            words.append(w)
            before.append(b)
            zeros.append(len(bits) - int(bits.sum()))
            held = np.concatenate([held[~bits], held[bits]])
        sampled = (offset % SAMPLED == 0)[suffixes]
        marked, marked_before = _packed(sampled)
        return cls({"alphabet": own[order], "begins": np.cumsum(counts) - counts, "ends": ends, "words": np.stack(words), "before": np.stack(before), "zeros": np.array(zeros), "marked": marked, "marked_before": marked_before, "samples": suffixes[sampled].astype(np.int32), "at": at, "row": row, "word": word})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as found:
            return cls({k: found[k] for k in found.files})

    # --- searching ----------------------------------------------------------------------------

    def _before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The row of the suffix order that stands for the i-th preceding ``symbol``: first row of the symbol, plus its occurrences before row i."""
        for k in range(self.levels):
            ones = _ones(self.words[k], self.before[k], i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return self.begins[symbol] + i - self.ends[symbol]

    def _back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer than row i's."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            ones = _ones(self.words[k], self.before[k], i)
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & _U(1) == 1
            symbol = symbol << 1 | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return self.begins[symbol] + i - self.ends[symbol]

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (numbers) that occur, with the rows of the suffix order that begin with them (from, to)."""
        if not len(self.alphabet):
            return (np.zeros(0, np.int64),) * 3
        symbol = np.searchsorted(self.alphabet, phrases)
        known = self.alphabet[np.minimum(symbol, len(self.alphabet) - 1)] == phrases
        left = np.flatnonzero((known | (np.arange(phrases.shape[1]) >= sizes[:, None])).all(1))
        symbol = symbol[left] + 1
        sizes = sizes[left]
        lo, hi = np.zeros(len(left), np.int64), np.full(len(left), self.length, np.int64)
        for k in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > k)
            c = symbol[on, sizes[on] - 1 - k]
            lo[on], hi[on] = self._before(c, lo[on]), self._before(c, hi[on])
            keep = lo < hi
            left, symbol, sizes, lo, hi = left[keep], symbol[keep], sizes[keep], lo[keep], hi[keep]
        return left, lo, hi

    @property
    def length(self) -> int:
        return int(self.zeros[0]) + int(np.bitwise_count(self.words[0]).sum())

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text row and word number of each row of the suffix order."""
        found = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            hit = (self.marked[rows >> 6] >> (rows & 63).astype(np.uint64)) & _U(1) == 1
            found[left[hit]] = self.samples[_ones(self.marked, self.marked_before, rows[hit])] + steps
            left, rows, steps = left[~hit], self._back(rows[~hit]), steps + 1
        piece = np.searchsorted(self.at, found, side="right") - 1
        return self.row[piece], self.word[piece] + found - self.at[piece]


def shards(texts: pa.Array) -> tuple[np.ndarray, Iterator[Shard]]:
    """Words of each text, and the indexes of all texts in a row."""
    terms = Terms(texts)
    counts, hashes = terms.counts, terms.hashes()

    def made() -> Iterator[Shard]:
        step = PIECE - REACH + 1
        n = np.where(counts > 0, np.maximum(-(-(counts - REACH + 1) // step), 1), 0)
        row = np.repeat(np.arange(len(counts)), n)
        word = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
        size = np.minimum(counts[row] - word, PIECE)
        filled = np.cumsum(size + 1)
        begin = 0
        while begin < len(row):
            end = int(np.searchsorted(filled, (filled[begin - 1] if begin else 0) + SHARD, side="right"))
            s = size[begin:end]
            start = terms.first[row[begin:end]] + word[begin:end]
            take = np.arange(int(s.sum())) + np.repeat(start - (np.cumsum(s) - s), s)
            yield Shard.build(hashes[take], row[begin:end], word[begin:end], s)
            begin = end

    return counts, made()


_INDEX = "part long, doc_ids array<long>, n_words array<long>, shards array<binary>"


def index(docs: DataFrame) -> DataFrame:
    """One row for each few megabytes of text: part (a number), doc_ids and n_words of its texts, shards (FM-indexes)."""

    def run(batches):
        part = (TaskContext.get().partitionId()) << 32
        for batch in chunks(batches, limit=SHARD_BYTES):
            counts, made = shards(batch.column("text"))
            yield pa.RecordBatch.from_pylist([{"part": part, "doc_ids": batch.column("doc_id").to_pylist(), "n_words": counts.tolist(), "shards": [s.dump() for s in made]}], pa.schema([("part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("shards", pa.list_(pa.binary()))]))
            part += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _INDEX)


# --- phrases and results ----------------------------------------------------------------------


def phrases(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct item (text), words (64-bit values, one after the other): every ``size`` words in a row of item_id's text; all words where they are fewer."""

    def run(batches):
        for batch in chunks(batches):
            terms = Terms(batch.column("text"))
            values = terms.hashes().astype("<u8")
            own, at, n = [], [], []
            for k, (a, b) in enumerate(zip(terms.first[:-1].tolist(), terms.first[1:].tolist(), strict=True)):
                own.append(np.full(max(b - a - size + 1, min(b - a, 1)), k))
                at.append(a + np.arange(len(own[-1])))
                n.append(np.full(len(own[-1]), min(b - a, size)))
            own, at, n = (np.concatenate(x).astype(np.int64) for x in (own, at, n))
            words = [values[i : i + j].tobytes() for i, j in zip(at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(own)), pa.array(words, pa.binary())], ["item", "words"])

    if size > REACH:
        raise ValueError(f"phrases have {REACH} words at most")
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words binary").distinct()


_FOUND = "part long, row long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows with those that meet or overlap made one."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(row * wide + stop)  # a later row lies beyond all of an earlier one
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * wide + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], reach[last] - row[at] * wide


def _block(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases (padded), their sizes, and the items of each: names, and from where to where in them."""
    by_words: dict[bytes, list[str]] = {}
    for r in rows:
        by_words.setdefault(bytes(r["words"]), []).append(r["item"])
    sizes = np.array([len(w) // 8 for w in by_words], np.int64)
    table = np.zeros((len(by_words), int(sizes.max(initial=1))), _U)
    for k, w in enumerate(by_words):
        table[k, : sizes[k]] = np.frombuffer(w, "<u8")
    names = np.array([x for v in by_words.values() for x in v], object)
    ends = np.cumsum([len(v) for v in by_words.values()])
    return table, sizes, names, np.concatenate([[0], ends]).astype(np.int64), ends


def _occurrences(shard: Shard, table: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, text row, first word) of all occurrences, some at a time."""
    which, lo, hi = shard.ranges(table, sizes)
    ends = np.cumsum(hi - lo)
    for a in range(0, int(ends[-1]) if len(ends) else 0, LOCATED):
        at = np.arange(a, min(a + LOCATED, int(ends[-1])))
        k = np.searchsorted(ends, at, side="right")
        yield which[k], *shard.locate(hi[k] - (ends[k] - at))


def _searched(made: DataFrame, rows: list) -> DataFrame:
    table, sizes, names, first, last = _block(rows)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                texts = len(r["doc_ids"])
                spans = [(np.zeros(0, np.int64),) * 3]
                hits = np.zeros((0, 2), np.int64)
                for data in r["shards"] if len(sizes) else ():
                    for phrase, row, word in _occurrences(Shard.load(data), table, sizes):
                        spans.append(merged(row, word, word + sizes[phrase]))
                        hits = np.unique(np.concatenate([hits, np.column_stack([row, phrase])]), axis=0)
                row, start, stop = merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                at = np.searchsorted(row, np.arange(texts + 1))
                pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)
                items: list[list[str]] = [[] for _ in range(texts)]
                cut = np.searchsorted(hits[:, 0], np.arange(texts + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    items[k] = sorted({x for p in hits[cut[k] : cut[k + 1], 1].tolist() for x in names[first[p] : last[p]]})
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * texts, pa.int64()), pa.array(np.arange(texts)), pa.array(r["doc_ids"], pa.int64()), pa.array(r["n_words"], pa.int64()), lists.cast(_SPANS), pa.array(items, pa.list_(pa.string()))], ["part", "row", "doc_id", "n_words", "spans", "items"])

    return made.mapInArrow(run, _FOUND)


def search(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (removal spans of words: start, stop), items (sorted) for each text of an index.

    ``wanted`` are ``phrases``. Each block of them, of about ``BLOCK`` rows, is searched in the whole index.
    """
    wanted = written(wanted, "phrases")
    blocks = max(-(-wanted.count() // BLOCK), 1)
    if blocks > 1:
        made = written(made, "fm-index")
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        rows = _searched(made, wanted.where(F.col("block") == k).collect())
        found = rows if found is None else found.unionByName(rows)
    if blocks > 1:
        found = found.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("spans", _joined("spans"))
    return found.select("doc_id", "n_words", "spans", "items")


def _joined(spans: str):
    """Spans of several blocks as one sorted list without overlaps."""
    return F.expr(
        f"aggregate(array_sort({spans}), cast(array() as array<struct<start:bigint,stop:bigint>>), (a, s) -> "
        "if(size(a) > 0 and s.start <= element_at(a, -1).stop, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, s.stop)))), "
        "concat(a, array(s))))"
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``search`` of ``docs`` for all phrases of ``items`` (item_id, text)."""
    return search(index(docs), phrases(items, size))
