"""Histogram gradient boosting on squared error, with every sum made by Spark.

Features are cut once into at most 255 bins by their quantiles and the rows packed into blocks of
bins. A level of a tree is one job: each task adds up residuals and counts by feature, node and bin. Of two
nodes with one parent only the one with fewer rows is counted; the other is the parent less that one. The tasks'
partial histograms are added up by the driver while all of them take ``DRIVER_BYTES`` at most, else by
the cluster, of which the driver gets one row a feature. Residuals are counted in whole multiples of a small
unit, so sums and differences, and with them trees, are the same at any partitioning and in both places.

The driver holds the trees (``leaves`` at most, a few numbers each), the histograms of one level (16 bytes a
node, feature and bin) and the validation curve. A tree is
applied to the rows once, when it is done: the blocks with what is left of the target are held by the
executors (memory, else disk), so a level costs the same in every round. Every ``KEEP`` rounds they are
written, so that plans stay short, and lost executors cost no more than the rounds since.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.tables import shared_dir, stored

#: Rows of a block, rows of a task at most, rows that are sorted at a time for the bins, and rounds between two writes of the blocks.
BLOCK, TASK, SORTED, KEEP = 1 << 16, 1 << 22, 1 << 20, 20
#: Partial histograms of a level that the driver adds up itself; more are added up by the cluster.
DRIVER_BYTES = 64 << 20
#: Residuals are counted in units of 2**-UNIT of the target's largest distance from its mean; 2**(52 - UNIT) rows add up exactly.
UNIT = 22


@dataclass(frozen=True)
class Settings:
    """patience: rounds without a better validation error after which the search ends; None looks at all rounds."""

    rounds: int = 600
    rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    leaf: int = 200
    l2: float = 1.0
    bins: int = 255
    patience: int | None = None


@dataclass
class Tree:
    """Nodes as lists; feature -1 marks a leaf. A row goes left if its bin is ``cut`` at most."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (x: one row of bins a feature)."""
        out = np.zeros(x.shape[1], np.uint8 if len(self.feature) <= 256 else np.int32)
        there = {0: np.ones(x.shape[1], bool)}
        for node, f in enumerate(self.feature):  # children come after their parents
            here = there.pop(node)
            if f < 0:
                out += here * out.dtype.type(node)
            else:
                down = x[f] <= self.cut[node]
                there[self.left[node]], there[self.right[node]] = here & down, here & ~down
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """The value of each row's leaf."""
        return np.array(self.value).take(self.reached(x))

    def add(self, value: float) -> int:
        for column, start in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(start)
        return len(self.value) - 1


@dataclass
class Model:
    """features with their bin edges, the mean that trees start from, the trees, and the error after each on held rows."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    errors: list[float]
    settings: Settings

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left").astype(np.uint8) for e, c in zip(self.edges, columns, strict=True)])

    def predicted(self, x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape[1], self.base)
        for t in self.trees:
            out += t.values(x)
        return out

    def column(self) -> Column:
        """The prediction as a column over the features; null if one of them is."""
        model = self

        @F.pandas_udf("double")
        def predict(rows: pd.DataFrame) -> pd.Series:
            whole = rows.notna().all(axis=1).to_numpy()
            out = np.full(len(rows), np.nan)
            if whole.any():
                out[whole] = model.predicted(model.bins([rows[f].to_numpy(float)[whole] for f in model.features]))
            return pd.Series(out)

        return predict(F.struct(*self.features))


def filled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A task's rows as tables of ``most`` rows, the last one with the rest."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            kept.append(batch.slice(at, most - n))
            at, n = at + kept[-1].num_rows, n + kept[-1].num_rows
            if n == most:
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)


def edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Bin borders: distinct quantiles of each feature, the largest value left out.

    A task sorts ``SORTED`` rows at a time and sends, by feature, ``points`` of their values at most, each with the number of rows up to it since the
    one before; a feature's values meet in one group. Ranks are exact where there are no more rows than that, else off by one in ``points`` at most.
    """
    points = 100 * bins
    kind = "feature int, values binary, rows binary"

    def sent(k: int, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["feature", "values", "rows"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in filled(batches, SORTED):
            n = table.num_rows
            upto = np.arange(1, min(n, points) + 1) * n // min(n, points)
            for k, f in enumerate(features):
                yield sent(k, np.sort(table.column(f).to_numpy().astype(float))[upto - 1], np.diff(upto, prepend=0))

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(v.as_buffer()), np.frombuffer(n.as_buffer(), np.int64)) for b in batches for v, n in zip(b.column("values"), b.column("rows"), strict=True)]
        values, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(n[order])
        ranks = np.ceil(np.arange(1, bins) / bins * upto[-1])
        found = np.unique(values[np.searchsorted(upto, ranks)])
        yield sent(key[0].as_py(), found[found < values[-1]], upto[-1:])

    found = {r["feature"]: np.frombuffer(bytes(r["values"])).tolist() for r in rows.select(*features).mapInArrow(sort, kind).groupBy("feature").applyInArrow(meet, kind).collect()}
    return [found.get(k, []) for k in range(len(features))]


Block = tuple[np.ndarray, np.ndarray, int]


def _packed(rows: DataFrame, model: Model, target: str, held: Column) -> DataFrame:
    """Blocks of rows: x (a byte a feature and row), rest (the target less the prediction, doubles); the first ``train`` rows are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in filled(batches, BLOCK):
            of = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            late = of("_held").astype(bool)
            order = np.argsort(late, kind="stable")
            x = model.bins([of(c).astype(float)[order] for c in model.features])
            cells = x.tobytes(), (of(target).astype(float)[order] - model.base).tobytes(), len(late) - int(late.sum())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.binary(), pa.binary(), pa.int32()), strict=True)], ["x", "rest", "train"])

    return rows.select(*model.features, target, held.alias("_held")).mapInArrow(run, "x binary, rest binary, train int")


def _blocks(packed: DataFrame, d: int) -> RDD[Block]:
    """The blocks as arrays, which tasks get as they are held: a level reads all of them and should not convert them."""
    return packed.rdd.map(lambda r: (np.frombuffer(r["x"], np.uint8).reshape(d, -1), np.frombuffer(r["rest"], np.float64), r["train"])).persist(StorageLevel.MEMORY_AND_DISK_DESER)


def _level(blocks: RDD[Block], model: Model, tree: Tree, counted: list[int], unit: float, tasks: int) -> tuple[np.ndarray, np.ndarray, tuple[float, int]]:
    """Sums and counts by counted node (a leaf so far), feature and bin; at a tree's root also the held rows' squared error and number."""
    d, b, root = len(model.features), model.settings.bins, counted == [0]

    def count(found: Iterator[Block]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        size = len(counted) * b
        sums, counts = np.zeros((d, size)), np.zeros((d, size), np.int64)
        wrong, late = np.zeros(1), np.zeros(1, np.int64)
        wanted, place = np.zeros(len(tree.value), bool), np.zeros(len(tree.value), np.intp)
        wanted[counted], place[counted] = True, np.arange(0, size, b)
        for x, rest, train in found:
            if root:
                wrong += (rest[train:] ** 2).sum()
                late += len(rest) - train
            x, rest = x[:, :train], rest[:train]
            if not root:
                node = tree.reached(x)
                on = np.flatnonzero(wanted.take(node))
                first, rest = place.take(node.take(on)), rest.take(on)
            residual = np.rint(rest / unit)
            for k in range(d):
                cell = x[k].astype(np.intp) if root else x[k].take(on) + first
                sums[k] += np.bincount(cell, residual, size)
                counts[k] += np.bincount(cell, minlength=size)
        yield -1, (wrong, late)
        yield from ((k, (sums[k], counts[k])) for k in range(d))

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    parts = blocks.mapPartitions(count)
    if tasks * len(counted) * d * b * 16 > DRIVER_BYTES:
        parts = parts.reduceByKey(both, min(tasks, d + 1))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, part in parts.collect():
        found[k] = both(found[k], part) if k in found else part
    sums, counts = (np.stack([found[k][i] for k in range(d)]).reshape(d, -1, b).swapaxes(0, 1) for i in range(2))
    return sums, counts, (float(found[-1][0][0]), int(found[-1][1][0]))


def _cuts(sums: np.ndarray, counts: np.ndarray, s: Settings, unit: float) -> list[dict]:
    """The best cut of each node from its histograms (node, feature, bin); the first feature and bin if gains are equal."""
    all_g, all_n = sums[:, 0].sum(-1), counts[:, 0].sum(-1)
    left_g, left_n = np.cumsum(sums, -1)[..., :-1], np.cumsum(counts, -1)[..., :-1]
    score = lambda a, m: (a * unit) ** 2 / (m + s.l2)
    total_g, total_n = all_g[:, None, None], all_n[:, None, None]
    gain = score(left_g, left_n) + score(total_g - left_g, total_n - left_n) - score(total_g, total_n)
    gain[(left_n < s.leaf) | (total_n - left_n < s.leaf)] = -1.0
    out = []
    for i, of in enumerate(gain):
        f, at = np.unravel_index(of.argmax(), of.shape)
        out.append({"feature": int(f), "gain": float(of[f, at]), "cut": int(at), "left_sum": float(left_g[i, f, at]), "left_n": int(left_n[i, f, at]), "sum": float(all_g[i]), "n": int(all_n[i])})
    return out


def _grown(blocks: RDD[Block], model: Model, unit: float, tasks: int, error: list[float]) -> Tree:
    """One tree on the residuals of the trees so far; ``error`` gets the mean squared error of the held rows before it."""
    s, full = model.settings, Tree()
    full.add(0.0)
    sums, counts, (wrong, n) = _level(blocks, model, full, [0], unit, tasks)
    if n:
        error.append(wrong / n)
    cuts, totals = {}, {}
    known = {0: (sums[0], counts[0])}
    for level in range(s.depth):
        fresh = []
        for node, r in zip(known, _cuts(*map(np.stack, zip(*known.values(), strict=True)), s, unit), strict=True):
            totals[node] = r["sum"], r["n"]
            if r["gain"] > 0 and r["n"] >= 2 * s.leaf:
                cuts[node] = r["gain"]
                full.feature[node], full.cut[node] = r["feature"], r["cut"]
                left, right = full.left[node], full.right[node] = full.add(0.0), full.add(0.0)
                totals[left] = r["left_sum"], r["left_n"]
                totals[right] = r["sum"] - r["left_sum"], r["n"] - r["left_n"]
                small, large = sorted((left, right), key=lambda k: totals[k][1])
                if totals[large][1] >= 2 * s.leaf:
                    fresh.append((node, small, large))
        if not fresh or level == s.depth - 1:
            break
        sums, counts, _ = _level(blocks, model, full, [small for _, small, _ in fresh], unit, tasks)
        new = {}
        for (node, small, large), g, n in zip(fresh, sums, counts, strict=True):
            new[small], new[large] = (g, n), (known[node][0] - g, known[node][1] - n)
        known = {k: new[k] for k in sorted(new) if totals[k][1] >= 2 * s.leaf}
    return _pruned(full, cuts, totals, s, unit)


def _pruned(full: Tree, cuts: dict[int, float], totals: dict[int, tuple[float, int]], s: Settings, unit: float) -> Tree:
    """The part of a tree that its cuts of the largest gain make, up to the number of leaves."""
    value = lambda k: s.rate * totals[k][0] * unit / (totals[k][1] + s.l2) if k in totals else 0.0
    out = Tree()
    root = out.add(value(0))
    heap = [(-cuts[0], 0, root)] if 0 in cuts else []
    leaves = 1
    while heap and leaves < s.leaves:
        _, node, mine = heapq.heappop(heap)
        out.feature[mine], out.cut[mine] = full.feature[node], full.cut[node]
        for side in ("left", "right"):
            child = getattr(full, side)[node]
            at = out.add(value(child))
            getattr(out, side)[mine] = at
            if child in cuts:
                heapq.heappush(heap, (-cuts[child], child, at))
        leaves += 1
    return out


def _advanced(blocks: RDD[Block], tree: Tree, write: bool) -> RDD[Block]:
    """The blocks with one more tree taken off what is left of the target, held by the executors and, if so wanted, written as well."""

    def run(found: Iterator[Block]) -> Iterator[Block]:
        for x, rest, train in found:
            yield x, rest - tree.values(x), train

    moved = blocks.mapPartitions(run, True).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    if write:
        moved.checkpoint()
    return moved


def fit(rows: DataFrame, features: list[str], target: str, held: Column, settings: Settings = Settings()) -> Model:
    """Trees on the rows that are not ``held``, with the held rows' error after each; rows must be complete.

    With ``patience`` it ends that many rounds after the least error. Without held rows there are no errors and all rounds are made.
    """
    whole = rows.withColumn("_held", F.coalesce(held, F.lit(False)))
    train = whole.where(~F.col("_held"))
    found = train.agg(F.avg(target).alias("mean"), F.min(target).alias("low"), F.max(target).alias("high"), F.count(F.lit(1)).alias("n")).first()
    base = float(found["mean"] or 0.0)
    unit = max(found["high"] - base, base - found["low"], 1e-300) * 2.0**-UNIT if found["n"] else 1.0
    model = Model(features, edges(train, features, settings.bins), base, [], [], settings)
    if not found["n"]:
        return model
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    cores = context.defaultParallelism
    packed = _packed(whole, model, target, F.col("_held")).repartition(cores * -(-whole.count() // (cores * TASK)))
    blocks = _blocks(stored(packed, "boosting"), len(features))
    tasks = blocks.getNumPartitions()
    errors: list[float] = []  # before each tree
    before = blocks
    while len(model.trees) < settings.rounds:
        tree = _grown(blocks, model, unit, tasks, errors)
        before.unpersist()  # these blocks have been made from it by now
        model.trees.append(tree)
        before, blocks = blocks, _advanced(blocks, tree, len(model.trees) % KEEP == 0)
        best = int(np.argmin(errors)) if errors else 0
        if settings.patience and errors and len(errors) - 1 - best >= settings.patience:
            break
    _, _, (wrong, n) = _level(blocks, model, Tree([-1], [0], [0], [0], [0.0]), [0], unit, tasks)
    last = [wrong / n] if n else []
    before.unpersist()
    blocks.unpersist()
    model.errors = [*errors, *last][1:]
    return model


def to_rows(spark: SparkSession, model: Model) -> DataFrame:
    """The trees as a table: tree, node, feature (null: leaf), cut (the value that goes left at most), left, right, value; tree -1 is the start."""
    out = [(-1, 0, None, None, None, None, model.base)]
    for k, t in enumerate(model.trees):
        for node, (f, c, a, b, v) in enumerate(zip(t.feature, t.cut, t.left, t.right, t.value, strict=True)):
            out.append((k, node, *((model.features[f], model.edges[f][c], a, b) if f >= 0 else (None,) * 4), v))
    return spark.createDataFrame(out, "tree int, node int, feature string, cut double, left int, right int, value double")


def from_rows(rows: DataFrame, features: list[str], settings: Settings = Settings()) -> Model:
    """The model of ``to_rows`` (of bounded size: trees times twice their leaves)."""
    found = rows.orderBy("tree", "node").collect()
    at = {f: k for k, f in enumerate(features)}
    edges_ = [sorted({r["cut"] for r in found if r["feature"] == f}) for f in features]
    trees: dict[int, Tree] = {}
    for r in found:
        if r["tree"] >= 0:
            t = trees.setdefault(r["tree"], Tree())
            node = t.add(r["value"])
            if r["feature"] is not None:
                f = at[r["feature"]]
                t.feature[node], t.cut[node], t.left[node], t.right[node] = f, edges_[f].index(r["cut"]), r["left"], r["right"]
    base = next((r["value"] for r in found if r["tree"] < 0), 0.0)
    return Model(features, edges_, base, [trees[k] for k in sorted(trees)], [], settings)
