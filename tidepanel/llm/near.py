"""Operator 7: near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Texts become sets of word shingles (64-bit values, see ``chunks.windows``). Documents with equal sets
   form a class with a number of its own, so copies never meet in pairs.
2. Each class has ``BANDS * ROWS`` MinHash values; classes that agree in a whole band share a bucket.
   A pair at the threshold of 0.8 misses all 32 bands of 4 values with probability 5e-8.
3. Every class is paired with the first of its buckets (as many pairs as members). Pairs are compared
   in batches of MinHash values; after each batch those whose posterior probability of reaching the
   threshold is below ``MISS`` are dropped. The others are decided by the exact sizes of intersection
   and union, and the links make components.
4. Only buckets that hold more than one component are looked at again. Their members are laid out in
   pairs of blocks (the largest component of a bucket meets only the others, so a large group of copies
   with a few strangers costs one row a member) and compared by batches inside the tasks, which report which components may be
   linked (a spanning forest, so at most as many rows as members). The members of such a group of
   components are laid out in pairs of blocks again, with their sets, and all pairs across components
   that pass the batches are decided exactly inside the tasks, which report a spanning forest of the
   links. No pair within a component is compared, none across is left out, and no task emits all pairs.
   Where a bucket or group has more than a block of members beside its largest component, it is split first
   by its members' rarest MinHash values (``_narrowed``) if that lays out fewer rows, so unlike documents that
   share a passage hardly meet.

Tables between steps are written to the shared folder. Shingle sets are made only for classes that
share a bucket. Nothing of the size of the corpus goes to the driver.

Nulls: a null or empty text has no shingles and is linked with nothing; a document whose doc_id is
null is kept with a null component. Repeated rows fall into one class. Rows of one doc_id with
different texts are one document: whatever any of them is linked with is reachable from it, and each
row keeps its own n_shingles. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import Words, chunks, shingle_sets
from tidepanel.llm.store import sized, written

BANDS, ROWS, STEP = 32, 4, 32
MISS = 1e-6
BLOCK = 512

_DRAW = np.random.default_rng(20240229)
_A, _B = (_DRAW.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(part.column("text"), lower=True)
    return shingle_sets(words.hashes(), words.first, size)


def _digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that stand for each set, as two signed numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (128 bits that stand for the set), minima (MinHash values)."""

    def run(batches):
        for part in chunks(batches):
            values, at = _sets(part, size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            minima = np.zeros((part.num_rows, BANDS * ROWS), np.uint32)
            low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
            if len(full):
                for k in range(BANDS * ROWS):
                    minima[full, k] = np.minimum.reduceat(low * _A[k] + high * _B[k], at[full])
            digests = _digests(values, at)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([m.tobytes() for m in minima], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "minima"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, minima binary")


def least_matches(similar: float, miss: float = MISS) -> list[int]:
    """After each batch: the fewest equal values with which a pair may still reach ``similar``.

    With a uniform prior, the posterior probability of similarity >= t after m of n equal values is
    the probability that a binomial(n + 1, t) variable is at most m.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        out.append(m)
    return out


def alike(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b compared batch by batch: (indices that survive, their equal values)."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        s = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (a[left, s] == b[left, s]).sum(1)
        ok = equal >= m
        left, equal = left[ok], equal[ok]
    return left, equal


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def _survivors(pairs: DataFrame, classes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of classes that pass the sequential comparison."""
    least = least_matches(similar)

    def run(batches):
        for part in batches:
            left, _ = alike(_minima(part.column("ma")), _minima(part.column("mb")), least)
            yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(left)), part.column("b").take(pa.array(left))], ["a", "b"])

    own = classes.select("rep", "minima")
    both = pairs.join(own.toDF("a", "ma"), "a").join(own.toDF("b", "mb"), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, by their whole sets."""

    def run(batches):
        for part in batches:
            keep = []
            for x, y in zip(part.column("sa"), part.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # each end brings its set along
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def shingles(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rep, set (sorted 64-bit values) of the classes ``ids`` (rep, doc_id of a member, d1, d2)."""

    def run(batches):
        for part in chunks(batches):
            values, at = _sets(part, size)
            own = (_digests(values, at) == np.stack([part.column(c).to_numpy() for c in ("d1", "d2")], 1)).all(1)
            sets = pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rep"), sets], ["rep", "set"]).filter(pa.array(own))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.join(sized(ids, 40), "doc_id").select("text", "rep", "d1", "d2").mapInArrow(run, "rep long, set binary").dropDuplicates(["rep"])


class _Joined:
    """Which labels have been joined so far within a task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    """Keys with several components: main (the largest one), n_main and n (members of it and of all)."""
    sizes = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy(key).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"))
    return sizes.where("comps > 1").drop("comps")


def _tokens(members: DataFrame) -> DataFrame:
    """rep, comp, token: each MinHash value of the members (rep, comp, minima) together with its place."""
    place = np.arange(BANDS * ROWS, dtype=np.int64) << 32

    def run(batches):
        for part in batches:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                of = pa.array(np.repeat(np.arange(some.num_rows), BANDS * ROWS))
                token = pa.array((_minima(some.column("minima")).astype(np.int64) | place).ravel())
                yield pa.RecordBatch.from_arrays([some.column("rep").take(of), some.column("comp").take(of), token], ["rep", "comp", "token"])

    return members.select("rep", "comp", "minima").mapInArrow(run, "rep long, comp long, token long")


def _dealt(sizes: DataFrame) -> DataFrame:
    """Sizes with few and many (blocks of the members beside the main component, and of its own)."""
    return sizes.withColumn("few", F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")).withColumn("many", F.ceil(F.col("n_main") / BLOCK).cast("int"))


def _counted(tokens: DataFrame, members: int) -> DataFrame:
    """Tokens that two members or more have, with n, how many have them.

    Tokens of more than a thousandth of the members are 1000 * BANDS * ROWS at most, so they are broadcast;
    the join that shuffles the others has no larger group than that thousandth.
    """
    counts = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "tokens")
    often = F.broadcast(counts.where(F.col("n") * 1000 > members))
    seldom = tokens.join(often, "token", "left_anti").join(counts.where(F.col("n") * 1000 <= members), "token")
    return tokens.join(often, "token").unionByName(seldom)


def _narrowed(rows: DataFrame, key: str, classes: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, rep, comp) and the sizes of their keys, with keys split that have more than a block of members beside their largest component.

    Pairs that pass all batches agree in at least m values. With all values in one order, each member
    keeps its ``values - m + 1`` first ones: two members that agree in m values then have one of them in
    common, so no pair that could pass is lost. The order is by rising count, so what many members share (a
    passage of all, say) is hardly ever among them; values of one member alone are not kept at all.

    Members that are all nearly alike share their rarest values, too. So a key is split only if its members
    have fewer rows in blocks of the split than in those of the key; both ways find the same pairs.
    """
    sizes = written(_sizes(rows, key), "sizes")
    large = written(_dealt(sizes).where(F.col("n") - F.col("n_main") > BLOCK), "large")
    if large.isEmpty():
        return rows, sizes
    mine = rows.join(sized(large.select(key), 8), key, "left_semi").select(key, "rep", "comp")
    members = written(mine.select("rep", "comp").distinct().join(classes.select("rep", "minima"), "rep"), "members-of-large")
    kept = _counted(_tokens(members), members.count()).groupBy("rep", "comp").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    first = F.slice("t", 1, F.greatest(F.size("t") - (least_matches(similar)[-1] - 1), F.lit(0)))
    split = written(kept.select("rep", "comp", F.explode(first).alias("t")).select(F.xxhash64("t.token").alias(key), "rep", "comp"), "split")

    blocks = F.when(F.col("comp") == F.col("main"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    cost = split.join(_dealt(_sizes(split, key)), key).groupBy("rep").agg(F.sum(blocks).alias("cost"))
    cost = mine.join(cost, "rep", "left").groupBy(key).agg(F.sum(F.coalesce("cost", F.lit(0))).alias("cost"))
    others = F.col("n") - F.col("n_main")
    hot = large.join(cost, key).where(F.col("cost") < others * (F.col("few") + F.col("many")) + F.col("n_main") * F.col("few"))
    hot = written(hot.select(key), "hot-keys")
    if hot.isEmpty():
        return rows, sizes
    hot = sized(hot, 8)
    split = split.join(mine.join(hot, key, "left_semi").select("rep").distinct(), "rep", "left_semi").select(key, "rep", "comp")
    apart = rows.join(hot, key, "left_anti").select(key, "rep", "comp").unionByName(split)
    return apart, sizes.join(hot, key, "left_anti").unionByName(_sizes(split, key))


def _blocks(rows: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Rows (key, rep, comp) dealt to pairs of blocks (p <= q): two rows of one key and different components meet in one pair.

    The members of a key's largest component have blocks of their own, which meet only the others'.
    Keys with a single component are left out.
    """
    few, many, main, draw = F.col("few"), F.col("many"), F.col("comp") == F.col("main"), F.xxhash64("rep")
    rows = rows.join(_dealt(_sizes(rows, key) if sizes is None else sizes), key)
    rows = rows.withColumn("mine", F.when(main, few + F.pmod(draw, many)).otherwise(F.pmod(draw, few)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, few - 1).otherwise(few + many - 1))))
    return rows.select(key, "rep", "comp", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))


def _by_blocks(rows: DataFrame, key: str, numbers: list[str], binaries: list[str], links) -> DataFrame:
    """(a, b) that ``links`` finds in the rows of each pair of blocks; a task streams its rows, two blocks at a time."""
    names = [key, "p", "q", "mine", *numbers]
    rows = rows.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "rep").select(*names, *binaries)

    def run(batches):
        held = None
        for part in batches:
            now = {c: part.column(c).to_numpy() for c in names} | {c: np.array(part.column(c).to_pylist(), object) for c in binaries}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            if not len(now["rep"]):
                continue
            group = np.stack([now[c] for c in (key, "p", "q")], 1)
            edges = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1])
            found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in links({c: v[a:b] for c, v in now.items()})]
            held = {c: v[edges[-1] :] for c, v in now.items()}
            if found:
                yield _pairs(found)
        found = list(links(held)) if held is not None else []
        if found:
            yield _pairs(found)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _partners(g: dict[str, np.ndarray], minima: np.ndarray, i: int, least: list[int]) -> np.ndarray:
    """Later members of the other block (or of one block with itself) in other components that pass the comparison with member i."""
    later = np.arange(len(minima)) > i
    to = np.flatnonzero(later & (g["comp"] != g["comp"][i]) & ((g["mine"] != g["mine"][i]) | (g["p"] == g["q"])))
    if not len(to):
        return to
    left, _ = alike(np.broadcast_to(minima[i], (len(to), minima.shape[1])), minima[to], least)
    return to[left]


def _maybe(members: DataFrame, labels: DataFrame, classes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of components that hold bucket mates which may be linked; within a task, a spanning forest of them."""
    least = least_matches(similar)
    own = members.join(labels.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    rows, sizes = _narrowed(own.select("key", "rep", "comp"), "key", classes, similar)
    rows = _blocks(rows, "key", sizes).join(classes.select("rep", "minima"), "rep")

    def links(g):
        minima = np.frombuffer(b"".join(g["minima"]), np.uint32).reshape(-1, BANDS * ROWS)
        joined = _Joined()
        for i in range(len(minima)):
            for k in np.unique(g["comp"][_partners(g, minima, i, least)]).tolist():
                if joined.join(int(g["comp"][i]), k):
                    yield int(g["comp"][i]), k

    return _by_blocks(rows, "key", ["rep", "comp"], ["minima"], links)


def _decided(maybe: DataFrame, members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, similar: float, percent: int) -> DataFrame:
    """Links (a, b) across the components of each group of ``maybe``, by whole sets; within a task, a spanning forest of them."""
    least = least_matches(similar)
    wide = components(maybe).toDF("comp", "wide")
    own = members.select("rep").distinct().join(labels.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    own = written(own.join(wide, "comp"), "undecided")
    rows, sizes = _narrowed(own.select("wide", "rep", "comp"), "wide", classes, similar)
    rows = _blocks(rows, "wide", sizes).join(classes.select("rep", "minima"), "rep").join(sets, "rep")

    def links(g):
        minima = np.frombuffer(b"".join(g["minima"]), np.uint32).reshape(-1, BANDS * ROWS)
        full = [np.frombuffer(x, np.uint64) for x in g["set"]]
        joined = _Joined()
        for i in range(len(full)):
            to = _partners(g, minima, i, least)
            if not len(to):
                continue
            sizes = np.array([len(full[k]) for k in to])
            every = np.concatenate([full[k] for k in to])
            at = np.minimum(np.searchsorted(full[i], every), len(full[i]) - 1)
            shared = np.add.reduceat((full[i][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for k in to[100 * shared >= percent * (len(full[i]) + sizes - shared)].tolist():
                if joined.join(int(g["comp"][i]), int(g["comp"][k])):
                    yield int(g["rep"][i]), int(g["rep"][k])

    return _by_blocks(rows, "wide", ["rep", "comp"], ["minima", "set"], links)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of the edges (a, b).

    Each round takes the least label among neighbours and then the label of one's label, so paths
    shorten by half; rounds end when no label changes.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    before = None
    while True:
        state = labels.agg(F.sum(F.col("c").cast("decimal(38,0)")), F.count(F.lit(1))).first()
        if state[1] == 0 or before is not None and state == before:
            return labels.toDF("node", "comp")
        before = state
        near = both.join(labels.toDF("v", "cv"), "v").groupBy("u").agg(F.min("cv").alias("m"))
        hooked = written(labels.join(near, "u").select("u", F.least("c", "m").alias("c")), "labels")
        labels = written(hooked.join(hooked.toDF("c", "cc"), "c").select("u", F.least("c", "cc").alias("c")), "labels")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows. Documents are linked if 100 * intersection >= percent * union."""
    similar = percent / 100
    made = written(signatures(docs, size), "signatures")
    linked = made.where("doc_id is not null and n_shingles > 0")
    classes = linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("minima").alias("minima"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("minima"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    postings = classes.select("rep", F.explode(keys).alias("key"))
    shared = postings.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(postings.join(shared.select("key", "first"), "key"), "members")
    ids = written(members.select("rep").distinct().join(classes.select("rep", "doc_id", "d1", "d2"), "rep"), "candidates")
    sets = written(shingles(docs, ids, size), "sets")

    star = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    edges = written(_exact(_survivors(star, classes, similar), sets, percent).unionByName(_same_document(linked, classes)), "links")
    labels = components(edges)
    maybe = written(_maybe(members.select("key", "rep"), labels, classes, similar), "maybe")
    if not maybe.isEmpty():
        more = written(_decided(maybe, members, labels, classes, sets, similar, percent), "links")
        labels = components(edges.unionByName(more))

    joined = labels.toDF("rep", "comp").join(classes.select("rep", "doc_id"), "rep")
    least = joined.groupBy("comp").agg(F.min("doc_id").alias("least"))
    of = classes.select("d1", "d2", "doc_id", "rep").join(joined.select("rep", "comp").join(least, "comp").select("rep", "least"), "rep", "left")
    of = of.select("d1", "d2", F.coalesce("least", "doc_id").alias("component_id"))
    rows = made.select("doc_id", "n_shingles", "d1", "d2")
    apart = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    together = rows.where("doc_id is not null and n_shingles > 0").join(of, ["d1", "d2"], "left").select("doc_id", "n_shingles", "component_id")
    return together.unionByName(apart)


def _same_document(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that hold different texts of one doc_id."""
    digest = F.struct("d1", "d2")
    several = written(linked.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    own = linked.join(sized(several, 8), "doc_id", "left_semi").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep").distinct()
    return own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
