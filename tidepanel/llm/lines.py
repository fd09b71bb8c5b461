"""Operator 2: reversible line dedup with sharded cuckoo filters over exact reference counts.

``LineIndex`` holds three tables in the shared folder: the references (line key, document), the exact
counts (documents holding a key, and the largest doc_id among them), and one cuckoo filter a shard
with the keys that reach ``holders`` documents. Inserting documents adds references; deleting them
takes references away; both recount the touched keys only and insert or delete in the filters just
those keys that cross the threshold, so deleting what was inserted gives the former results back.

To clean documents, tasks probe their lines in the filters and pass on only lines that may be
repeated; those are joined with the exact counts, so a filter's false positives do no harm. The
filters are sent to the tasks if their measured size is within ``FILTER_BYTES``; beyond it the lines
are sent to the filters: lines and filter of a shard meet in one group, a shard with many lines in
several groups with a copy of its filter each, so a line that many documents share is spread. Both
ways return the same lines. Filters have ``SHARD_KEYS`` keys on average; when updates double that,
the keys are dealt to more shards. A line that many documents share meets its count in a join whose
skewed partitions Spark splits; counting aggregates before the shuffle.

A key is a line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, known by 128 bits of its hash.

Nulls: a null or empty text is one empty line; a document whose doc_id is null is returned as it is.
Rows that repeat a doc_id are one holder and lose the same lines. An empty table gives an
empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import chunks
from tidepanel.llm.store import attach, sized, written

SHORTEST, HOLDERS = 40, 5
SHARD_KEYS = 50_000
#: Filters are sent to all tasks up to this size; beyond it, lines that meet one copy of a filter.
FILTER_BYTES, PROBED_LINES = 64 << 20, 1 << 20
STRIPPED = b" \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """16 bytes for a line that is long enough (in code points), else None."""
    if len(line) < shortest:
        return None
    key = line.strip(STRIPPED)
    if len(key) < shortest or not key.isascii() and len(key.decode()) < shortest:
        return None
    return xxhash.xxh3_128_digest(key.lower())


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints, four to a bucket, in one of two buckets for each key."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / 4 / 0.85))))
        return cls(np.zeros((buckets, 4), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, 4).copy())

    def _at(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (k2 & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (k1 >> np.uint64(20)) & mask
        return mark, first, first ^ self._step(mark, mask)

    @staticmethod
    def _step(mark, mask):
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)) & mask

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self._at(k1, k2)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if the table is too full; the caller then builds a larger one from the exact table."""
        marks, firsts, seconds = (x.tolist() for x in self._at(k1, k2))
        mask = np.uint64(len(self.table) - 1)
        step = self._step(np.arange(1 << 16, dtype=np.uint16), mask).tolist()
        rows = self.table.tolist()
        turn = 0
        for mark, a, b in zip(marks, firsts, seconds, strict=True):
            for _ in range(500):
                row = rows[a] if 0 in rows[a] else rows[b] if 0 in rows[b] else None
                if row is not None:
                    row[row.index(0)] = mark
                    break
                turn = (turn + 1) & 3
                a = b if turn & 1 else a
                mark, rows[a][turn] = rows[a][turn], mark
                a ^= step[mark]
                b = a
            else:
                return False
        self.table[:] = rows
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take one fingerprint of each key out; only keys that were inserted may be given."""
        for mark, a, b in zip(*(x.tolist() for x in self._at(k1, k2)), strict=True):
            for i in (a, b):
                at = np.flatnonzero(self.table[i] == mark)
                if len(at):
                    self.table[i, at[0]] = 0
                    break

    def bytes(self) -> bytes:
        return self.table.tobytes()


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table[c].to_numpy().astype(np.int64).view(np.uint64) for c in KEY)


def _full(k1: np.ndarray, k2: np.ndarray) -> Cuckoo:
    size = len(k1)
    while True:
        made = Cuckoo.sized(size)
        if made.insert(k1, k2):
            return made
        size *= 2


def references(docs: DataFrame, shortest: int = SHORTEST, shared=None, shards: int = 1) -> DataFrame:
    """doc_id, k1, k2: the distinct long lines of each document; with filters, only those that pass them."""

    def run(batches):
        filters = {s: Cuckoo.from_bytes(x) for s, x in shared.value.items()} if shared is not None else None
        for part in chunks(batches):
            ids, keys = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = {k for line in text.encode().split(b"\n") if (k := line_key(line, shortest))}
                keys.extend(found)
                ids.extend([doc] * len(found))
            pair = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            ids = np.array(ids, np.int64)
            if filters is not None and len(ids):
                shard, keep = (pair[:, 1] % np.uint64(shards)).astype(np.int64), np.zeros(len(ids), bool)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        mine = np.flatnonzero(shard == s)
                        keep[mine] = filters[s].has(pair[mine, 0], pair[mine, 1])
                pair, ids = pair[keep], ids[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["doc_id", *KEY])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def _shard(shards: int):
    """k2 as an unsigned number, modulo the number of shards."""
    return (F.conv(F.hex("k2"), 16, 10).cast("decimal(20,0)") % shards).cast("int")


@dataclass
class LineIndex:
    """Exact references and counts, and the filters of the repeated keys."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    holders: int = HOLDERS
    shortest: int = SHORTEST

    @classmethod
    def build(cls, docs: DataFrame, holders: int = HOLDERS, shortest: int = SHORTEST) -> LineIndex:
        # rows that repeat a doc_id are one holder
        refs = written(references(docs, shortest).dropDuplicates(), "line-refs")
        counts = written(_counted(refs).where(F.col("n") >= holders), "line-counts")
        shards = max(1, -(-counts.count() // SHARD_KEYS))
        return cls(refs, counts, cls._filters(counts, shards), shards, holders, shortest)

    @staticmethod
    def _filters(repeated: DataFrame, shards: int) -> DataFrame:
        def fill(table: pa.Table) -> pa.Table:
            return pa.table({"shard": table["shard"].slice(0, 1), "filter": pa.array([_full(*_keys(table)).bytes()], pa.binary())})

        made = repeated.select(_shard(shards).alias("shard"), *KEY).groupBy("shard").applyInArrow(fill, "shard int, filter binary")
        return written(made, "line-filters")

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """Recount the touched keys from the references and move those that cross the threshold in the filters."""
        refs = written(refs, "line-refs")
        touched = written(touched.select(*KEY).distinct(), "line-touched")
        now = _counted(refs.join(touched, KEY, "left_semi")).where(F.col("n") >= self.holders)
        counts = written(self.counts.join(touched, KEY, "left_anti").unionByName(now), "line-counts")
        keys = counts.count()
        if keys > 2 * SHARD_KEYS * self.shards:
            shards = -(-keys // SHARD_KEYS)
            return LineIndex(refs, counts, self._filters(counts, shards), shards, self.holders, self.shortest)
        move = lambda a, b, sign: a.join(b, KEY, "left_anti").select(_shard(self.shards).alias("shard"), *KEY, F.lit(sign).alias("sign"))
        moves = move(counts, self.counts, 1).unionByName(move(self.counts, counts, -1))
        everything = counts.select(_shard(self.shards).alias("shard"), *KEY)
        changed = moves.select("shard").distinct()
        keys = moves.unionByName(everything.join(changed, "shard", "left_semi").withColumn("sign", F.lit(0)))

        def turn(key, old: pa.Table, new: pa.Table) -> pa.Table:
            if not new.num_rows:
                return old.select(["shard", "filter"])
            k1, k2 = _keys(new)
            sign = new["sign"].to_numpy()
            made = Cuckoo.from_bytes(old["filter"][0].as_py()) if old.num_rows else Cuckoo.sized(0)
            made.delete(k1[sign < 0], k2[sign < 0])
            if not made.insert(k1[sign > 0], k2[sign > 0]):
                made = _full(k1[sign == 0], k2[sign == 0])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.bytes()], pa.binary())})

        filters = written(self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(turn, "shard int, filter binary"), "line-filters")
        return LineIndex(refs, counts, filters, self.shards, self.holders, self.shortest)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents; references that it has already are not counted twice."""
        new = written(references(docs, self.shortest).join(self.refs, ["doc_id", *KEY], "left_anti").dropDuplicates(), "line-refs")
        return self._changed(self.refs.unionByName(new), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of the table ``ids`` (column doc_id)."""
        gone = self.refs.join(ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
        return self._changed(self.refs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), gone)

    def repeats(self, docs: DataFrame) -> DataFrame:
        """doc_id, lines: keys of each document that the counts have with a larger doc_id."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= FILTER_BYTES:
            shared = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})
            maybe = references(docs, self.shortest, shared, self.shards)
        else:
            maybe = self._probed(written(references(docs, self.shortest), "lines"))
        hit = maybe.join(self.counts, KEY).where(F.col("last") > F.col("doc_id"))
        # rows that repeat a doc_id find the same keys
        return hit.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("lines"))

    def _probed(self, refs: DataFrame) -> DataFrame:
        """The references that pass the filters, which they meet by shard."""
        rows = refs.select("doc_id", *KEY, _shard(self.shards).alias("shard"))
        copies = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBED_LINES).cast("int").alias("copies"))
        copies = sized(written(copies, "line-copies"), 16)
        rows = rows.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
        filters = self.filters.join(copies, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))

        def probe(lines: pa.Table, held: pa.Table) -> pa.Table:
            found = lines.select(["doc_id", *KEY])
            if not held.num_rows:
                return found.slice(0, 0)
            return found.filter(pa.array(Cuckoo.from_bytes(held["filter"][0].as_py()).has(*_keys(found))))

        return rows.groupBy("shard", "copy").cogroup(filters.groupBy("shard", "copy")).applyInArrow(probe, "doc_id long, k1 long, k2 long")

    def clean(self, docs: DataFrame) -> DataFrame:
        """The documents (doc_id, and rest if there) with n_lines, n_dropped and the kept lines."""
        names = ["doc_id", *(["rest"] if "rest" in docs.columns else [])]
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *names[1:])
        shortest = self.shortest

        def run(batches):
            for part in chunks(batches):
                n_lines, n_dropped, kept = [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column("lines").to_pylist(), strict=True):
                    data = (text or "").encode()
                    n_lines.append(data.count(b"\n") + 1)
                    if gone:
                        lost = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in gone}
                        left = [x for x in data.split(b"\n") if line_key(x, shortest) not in lost]
                        n_dropped.append(n_lines[-1] - len(left))
                        data = b"\n".join(left)
                    else:
                        n_dropped.append(0)
                    kept.append(data)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_lines", "n_dropped", "kept"]
                )

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        found = written(self.repeats(docs), "line-repeats")
        return attach(rows, found).select("doc_id", "text", *names[1:], "lines").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_lines long, n_dropped long, kept string")
