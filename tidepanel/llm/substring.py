"""Operator 9: removal of passages that a document with a smaller doc_id has, too.

Rabin-Karp values of every window of 50 words are computed with numpy as the texts are read, dealt
to buckets by value and compared there by Spark's grouping: a bucket finds the smallest doc_id of each
value and reports the other documents that hold it. Windows that differ fall into buckets independently,
even around a phrase that many documents share. A bucket reports one row for each group of documents
that it has hits in, not one for each document; a second grouping gathers the hits of a document.
Each document's reported windows then merge into maximal intervals, whose words are removed.

A window is known by 96 bits: two polynomials modulo a prime at different bases, of which the first
deals it to its bucket. For n windows about n*n / 2**97 unlike pairs share both (below 0.001 at 10**13
windows), and no structure of the words makes them meet. A task sends each value once for a chunk of texts, with its smallest doc_id; the chunk's other holders
are known to be repeats at once and travel as such, dealt evenly. Values that a task meets again, in the
same chunk or a later one, are held back (``Held``) and sent once each when the task ends, so a bucket
gets an entry of a passage that all documents share from each task, not from each chunk. Values of a chunk for one bucket travel as one binary row (12 bytes a
window). The number of buckets follows the size of the texts (``BUCKET_BYTES``), so a bucket's memory
doesn't grow with the corpus.

Nulls: a null text has no words; a document whose doc_id is null neither removes words nor loses any.
Texts of fewer than 50 words lose none. Rows that repeat a doc_id count as one document and lose the
same windows. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import BASES, Words, chunks, mix, windows
from tidepanel.llm.store import attach, text_size, written

WINDOW = 50
#: Bytes of text whose windows make one bucket on average.
BUCKET_BYTES = 8 << 20
#: Buckets of windows for each group of documents in which hits are gathered.
GROUP_BUCKETS = 2
#: Bytes of text in which a task merges equal windows before it sends them.
MERGE_BYTES = 2 << 20
#: Bits by which a task remembers the values it has sent, and values it holds back before it sends them after all.
SEEN_BITS, HOLD = 28, 1 << 18

#: A window's two values.
VALUE = np.dtype([("v", "<u8"), ("w", "<u4")])

SENT = "bucket int, known boolean, docs binary, counts binary, hashes binary"
HITS = "place int, docs binary, counts binary, hashes binary"


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[at], np.diff(np.append(at, len(ids))).astype(np.int32)


def _values(words: np.ndarray, size: int) -> np.ndarray:
    """Both values of every window over a run of words."""
    first = windows(words, size)
    out = np.empty(len(first), VALUE)
    out["v"], out["w"] = first, windows(words, size, BASES[1]) & np.uint64(0xFFFFFFFF)
    return out


def _least(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, then document; which entries begin a value; which have a larger document than its first."""
    v, w = np.ascontiguousarray(values["v"]), np.ascontiguousarray(values["w"])
    order = np.lexsort((docs, w, v))
    v, w, d = v[order], w[order], docs[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, new, d > least


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones."""
    hit = np.isin(values["v"], known["v"])
    at = np.flatnonzero(hit)
    both = set(known.tolist())
    hit[at] = [x in both for x in values[at].tolist()]
    return hit


def _windows(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window values and doc_ids of a chunk; rows without a doc_id have none."""
    words = Words(part.column("text"), lower=False)
    values, owner = _values(words.hashes(), size), words.owners()
    ids = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False)
    ok = owner[: len(values)] == owner[size - 1 :] if len(values) else np.zeros(0, bool)
    if part.column("doc_id").null_count:
        ok &= part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[owner[: len(values)]]
    return values[ok], ids[owner[: len(values)][ok]]


def _small(numbers: np.ndarray) -> bytes:
    """Numbers as compressed differences; sorted doc_ids and runs of short counts take a byte or two each."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(numbers, prepend=numbers.dtype.type(0)).tobytes())


def _numbers(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), kind), dtype=kind)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and doc_ids of the entries in the rows of a table."""
    v = np.concatenate([np.frombuffer(x.as_buffer(), VALUE) for x in table["hashes"]])
    d = np.concatenate([np.repeat(_numbers(i, np.int64), _numbers(n, np.int32)) for i, n in zip(table["docs"], table["counts"], strict=True)])
    return v, d


def _dealt(v: np.ndarray, d: np.ndarray, to: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """One row (place, docs, counts, hashes) for each place that entries go to."""
    by = np.lexsort((d, to))
    v, d, to = v[by], d[by], to[by]
    rows = []
    for part in np.split(np.arange(len(to)), np.flatnonzero(to[1:] != to[:-1]) + 1) if len(to) else []:
        s = slice(part[0], part[-1] + 1)
        own, counts = _runs(d[s])
        rows.append((int(to[s.start]), _small(own), _small(counts), v[s].tobytes()))
    return rows


class Held:
    """Values that a task has met more than once, each with the smallest doc_id so far.

    Which values are held back decides only what is sent, never what is found: a value that was sent
    before it came again is compared once more in its bucket, and so is one that leaves when the table is full.
    """

    def __init__(self) -> None:
        self.seen = np.zeros(1 << SEEN_BITS >> 3, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.v, self.d = np.zeros(0, VALUE), np.zeros(0, np.int64)

    def again(self, v: np.ndarray) -> np.ndarray:
        """Which values came before (or share a bit with one that did); all are remembered."""
        bit = (mix(v["v"], 9) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
        mask = np.left_shift(1, bit & 7).astype(np.uint8)
        before = (self.seen[bit >> 3] & mask) > 0
        np.bitwise_or.at(self.seen, bit >> 3, mask)
        return before

    def take(self, v: np.ndarray, d: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values in order, each once with its smallest doc_id, and which of them stand in another document of the chunk.

        Returns what is to be sent now, and (value, doc_id) pairs that are repeats of a held value.
        """
        at = np.searchsorted(self.v["v"], v["v"])
        held = at < len(self.v)
        held[held] = self.v[at[held]] == v[held]
        mine, old, new = at[held], self.d[at[held]], d[held]
        more = old != new
        more_v, more_d = v[held][more], np.maximum(old, new)[more]
        self.d[mine] = np.minimum(old, new)
        v, d, keep = v[~held], d[~held], repeated[~held]
        keep = keep | self.again(v)
        if keep.any():
            both, docs = np.concatenate([self.v, v[keep]]), np.concatenate([self.d, d[keep]])
            order = np.argsort(both["v"], kind="stable")
            self.v, self.d = both[order], docs[order]
        return v[~keep], d[~keep], more_v, more_d


def sent(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """The windows of all chunks, dealt to buckets by value."""
    kinds = {"bucket": pa.int32(), "known": pa.bool_(), "docs": pa.binary(), "counts": pa.binary(), "hashes": pa.binary()}

    def batch(known, v, d, to):
        rows = [(b, known, *row) for b, *row in _dealt(v, d, to)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def by_value(v, d):
        return batch(False, v, d, ((v["v"] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64))

    def send(batches):
        held = Held()
        for part in chunks(batches, limit=MERGE_BYTES):
            values, ids = _windows(part, size)
            if not len(values):
                continue
            order, new, repeat = _least(values, ids)
            v, d = values[order], ids[order]
            shared = np.bincount(np.cumsum(new) - 1, repeat) > 0
            now_v, now_d, more_v, more_d = held.take(v[new], d[new], shared)
            more_v, more_d = np.concatenate([v[repeat], more_v]), np.concatenate([d[repeat], more_d])
            if len(more_v):
                # holders that the task itself shows to be repeats: dealt evenly, not by value
                yield batch(True, more_v, more_d, np.full(len(more_d), more_d.min() % buckets))
            if len(now_v):
                yield by_value(now_v, now_d)
            if len(held.v) > HOLD:
                yield by_value(held.v, held.d)
                held.clear()
        if len(held.v):
            yield by_value(held.v, held.d)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(send, SENT)


def hits(rows: DataFrame, groups: int) -> DataFrame:
    """The windows of ``sent`` that a smaller doc_id has, too, dealt to groups of documents."""

    def compare(table: pa.Table) -> pa.Table:
        found = []
        for known in (False, True):
            part = table.filter(pc.equal(table["known"], known))
            if not part.num_rows:
                continue
            v, d = _entries(part)
            if not known:
                order, _, repeat = _least(v, d)
                v, d = v[order][repeat], d[order][repeat]
            found += _dealt(v, d, (mix(d.view(np.uint64), 5) % np.uint64(groups)).astype(np.int64))
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["place", "docs", "counts", "hashes"])

    return rows.groupBy("bucket").applyInArrow(compare, HITS)


def repeated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, hashes (list of binaries): the windows that begin in a document with a smaller doc_id, too."""
    buckets = max(1, -(-text_size(docs) // BUCKET_BYTES))

    def gather(table: pa.Table) -> pa.Table:
        v, d = _entries(table)
        by = np.argsort(d, kind="stable")
        own, counts = _runs(d[by])
        data, ends = v[by].tobytes(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64) * VALUE.itemsize])
        return pa.table({"doc_id": pa.array(own), "hashes": pa.array([[data[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.binary()))})

    # as many partitions as buckets, so that a task's share doesn't grow with the corpus
    found = hits(sent(docs, size, buckets).repartition(buckets, "bucket"), -(-buckets // GROUP_BUCKETS))
    return found.groupBy("place").applyInArrow(gather, "doc_id long, hashes array<binary>")


def without_repeats(docs: DataFrame, size: int = WINDOW, layout: bool = False) -> DataFrame:
    """The documents with the columns n_words, n_removed, removed (intervals of words) and kept added.

    ``docs`` has doc_id and text; its other columns travel along in one struct named ``rest``, if there
    is one. ``kept`` is the kept words joined by one space; with ``layout``, the text itself with the
    removed intervals cut out. No window loses words on account of what is left after a removal.
    """
    found = written(repeated(docs, size), "repeats")
    names = ["doc_id", "text", *(["rest"] if "rest" in docs.columns else [])]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *names[2:])
    out = ["doc_id", *names[2:], "n_words", "n_removed", "removed", "kept"]

    def run(batches):
        for part in chunks(batches):
            words, texts = Words(part.column("text"), lower=False), part.column("text").to_pylist()
            hashes = None
            counts, lost, spans, kept = words.counts, [], [], []
            for k, (text, gone) in enumerate(zip(texts, part.column("repeats").to_pylist(), strict=True)):
                a, b = words.first[k], words.first[k + 1]
                data = (text or "").encode()
                if not gone:
                    lost.append(0)
                    spans.append([])
                    kept.append(data if layout else b" ".join(data.split()))
                    continue
                if hashes is None:
                    hashes = words.hashes()
                hit = _among(_values(hashes[a:b], size), np.frombuffer(b"".join(gone), VALUE))
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, np.flatnonzero(hit), 1)
                np.add.at(cover, np.flatnonzero(hit) + size, -1)
                covered = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(covered, prepend=False, append=False)).reshape(-1, 2)
                lost.append(int(covered.sum()))
                spans.append([{"begin": int(x), "end": int(y)} for x, y in edges])
                if layout:
                    base = words.starts[a] - _leading(data)
                    cuts = [(words.starts[a + x] - base, words.starts[a + y] - base if a + y < b else len(data)) for x, y in edges.tolist()]
                    at = [0, *(p for cut in cuts for p in cut), len(data)]
                    kept.append(b"".join(data[p:q] for p, q in zip(at[::2], at[1::2], strict=True)))
                else:
                    kept.append(b" ".join(compress(data.split(), (~covered).tolist())))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("doc_id", *names[2:])]
                + [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                out,
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *names[2:])) + ", n_words long, n_removed long, removed array<struct<begin:long,end:long>>, kept string"
    return attach(rows, found.withColumnRenamed("hashes", "repeats")).select(*names, "repeats").mapInArrow(run, schema)


def _leading(data: bytes) -> int:
    """Bytes of white space before the first word."""
    return len(data) - len(data.lstrip())
