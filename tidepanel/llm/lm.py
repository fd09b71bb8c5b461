"""Operator 10: scoring by a log-bilinear language model trained with noise-contrastive estimation.

Spark counts all training tokens. The ``SHORT`` most frequent ones and the end of text are classes of
their own; all others fall into ``ENDINGS`` classes by their last two bytes, inside which a token has
its add-one share of the class's count (an unseen token the share of one); the counts that these shares
come from grow with the corpus, the classes don't. The model predicts the class from a representation
of what stands before: r = sum of position weights * vectors of the ``CONTEXT`` classes before, plus the
mean topic vector of the last ``WINDOW`` tokens of the text; score = r . target vector + bias,
normalised over all classes by batched matrix products.

Texts are encoded once, as class numbers. Training goes over all training texts in each of ``ROUNDS``
rounds: encoded texts are dealt to shards by a hash, ``SHARD_TOKENS`` each, so neither shards nor the
order in them depend on how the table is laid out; a task runs a shard in batches against noise drawn
from the class counts, and Spark averages the shards' parameters, weighted by tokens, in whole numbers
so that no order of summing changes them.

What is sent to tasks is bounded by parameters: the model, and the counts of the ``FREQUENT`` most
frequent tokens. Counts of all other tokens are looked up by a join with the table of all counts;
texts send one row for each of their distinct infrequent tokens. Tokens are known by 64-bit hashes.

Nulls: a null text is empty (its end is its only token); a null doc_id doesn't train and isn't held
out. Rows that repeat a doc_id are scored each. Without training texts all counts are 0 and the model
is uniform. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import Words, chunks
from tidepanel.llm.store import written

SHORT, ENDINGS, CONTEXT, WINDOW, SIZE = 256, 256, 2, 64, 16
FREQUENT = 1 << 16
ROUNDS, BATCH, NOISE, RATE, SHARD_TOKENS = 2, 4096, 32, 0.05, 2_000_000
#: Tokens that are scored at once, rows of a product; parameters are averaged in units of 2**-20.
BLOCK, ROWS, UNIT = 1 << 15, 128, 1 << 20
#: Bytes of text in which a task merges equal tokens before it sends their counts.
MERGE_BYTES = 4 << 20
END = np.int64(-0x4B1D5EED0E0F0A11)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, text) of every token of a chunk in order; each text's last token is its end."""
    words = Words(part.column("text"), lower=True)
    hashes = words.hashes().view(np.int64)
    last = words.data[words.ends - 1].astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
    before = np.where(words.ends - 2 >= words.starts, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64) if len(hashes) else last
    ending = (last * 31 + before * 7) % ENDINGS
    at = words.first[1:]
    return np.insert(hashes, at, END), np.insert(ending, at, 0), np.repeat(np.arange(len(at)), words.counts + 1)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, at, n = np.unique(keys, return_index=True, return_counts=True)
    return values, at, n


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (hash), ending, n over all rows."""

    def run(batches):
        for part in chunks(batches, limit=MERGE_BYTES):
            hashes, ending, _ = tokens(part)
            values, at, n = _tally(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(ending[at].astype(np.int32)), pa.array(n)], ["token", "ending", "n"])

    made = docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, ending int, n long")
    return made.groupBy("token").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


class Classes:
    """From token hashes to class numbers and counts."""

    def __init__(self, frequent: list[tuple[int, int, int]], total: int, distinct: int, by_ending: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.known = np.array(sorted(frequent), np.int64).reshape(-1, 3)
        rank = sorted((-n, t) for t, _, n in frequent if t != END)[:SHORT]
        self.short = np.array(sorted([t for _, t in rank] + [int(END)]), np.int64)
        counts = dict((t, n) for t, _, n in frequent)
        short_n = [counts.get(int(t), 0) for t in self.short]
        # of each ending: tokens and their occurrences outside the short list
        inside = {int(t) for t in self.short}
        number, weight = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for e, (v, n) in by_ending.items():
            number[e], weight[e] = v, n
        for t, e, n in frequent:
            if t in inside:
                number[e] -= 1
                weight[e] -= n
        self.share = weight + number + 1
        self.size = len(self.short) + ENDINGS
        noise = np.concatenate([np.array(short_n, float), weight]) + 1
        self.noise = noise / noise.sum()

    def of(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.short, hashes), len(self.short) - 1)
        return np.where(self.short[at] == hashes, at, len(self.short) + ending)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of the frequent tokens, -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known[:, 0], hashes), len(self.known) - 1)
        return np.where(self.known[at, 0] == hashes, self.known[at, 2], -1)


def blocks(pieces: Iterable[tuple[np.ndarray, int]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(classes, text, first) of runs of ``size`` tokens of (classes, number) texts in a row.

    A run begins with up to WINDOW tokens of the one before, which only serve as context; its own
    tokens begin at ``first``. Runs depend on the texts alone, not on how they arrive.
    """
    held_c, held_o, n, first = [], [], 0, 0
    for classes, number in pieces:
        held_c.append(classes)
        held_o.append(np.full(len(classes), number, np.int64))
        n += len(classes)
        if n < size + first:
            continue
        c, o, at = np.concatenate(held_c), np.concatenate(held_o), 0
        while n - at >= size + first:
            yield c[at : at + first + size], o[at : at + first + size], first
            at, first = at + first + size - min(WINDOW, first + size), min(WINDOW, first + size)
        held_c, held_o, n = [c[at:]], [o[at:]], n - at
    if n > first:
        yield np.concatenate(held_c), np.concatenate(held_o), first


class LogBilinear:
    """Parameters as one matrix with rows of SIZE: context and topic vectors (with one for the start of a text), target vectors, position weights, biases."""

    def __init__(self, classes: Classes, flat: np.ndarray | None = None):
        m = self.m = classes.size
        if flat is None:
            draw = np.random.default_rng(7)
            flat = draw.normal(0, 0.1, (3 * m + 2 + CONTEXT + -(-m // SIZE), SIZE)).astype(np.float32)
            flat[3 * m + 2 : 3 * m + 2 + CONTEXT] = 1
            bias = np.zeros(flat[3 * m + 2 + CONTEXT :].size, np.float32)
            bias[:m] = np.log(classes.noise)
            flat[3 * m + 2 + CONTEXT :] = bias.reshape(-1, SIZE)
        self.flat = flat
        self.context, self.topic, self.target, self.weights, self.bias = self.views(flat)
        self.noise = np.cumsum(classes.noise)
        self.log_noise = np.log(classes.noise).astype(np.float32)

    def views(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        m = self.m
        ends = (m + 1, 2 * m + 2, 3 * m + 2, 3 * m + 2 + CONTEXT)
        return (*(flat[a:b] for a, b in zip((0, *ends), ends, strict=False)), flat[ends[-1] :].reshape(-1)[:m])

    def _before(self, classes: np.ndarray, owner: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The CONTEXT classes before each token, nearest first; where each token's window begins, and its weight."""
        before = []
        for k in range(1, CONTEXT + 1):
            at = np.full(len(classes), self.m)
            same = owner[k:] == owner[:-k]
            at[k:][same] = classes[:-k][same]
            before.append(at)
        place = np.arange(len(classes))
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]]))
        begin = np.maximum(np.repeat(new, np.diff(np.append(new, len(owner)))), place - WINDOW)
        return before, begin, 1 / np.sqrt(np.maximum(place - begin, 1) * float(WINDOW))

    def predicted(self, classes: np.ndarray, before: list[np.ndarray], begin: np.ndarray, weight: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(classes) + 1, SIZE))
        np.cumsum(self.topic.astype(float).take(classes, axis=0), axis=0, out=sums[1:])
        window = sums[:-1] - sums.take(begin, axis=0)
        window *= weight[:, None]
        out = window.astype(np.float32)
        for k in range(CONTEXT):
            out += (self.weights[k] * self.context).take(before[k], axis=0)
        return out

    def train(self, classes: np.ndarray, owner: np.ndarray, first: int, draw: np.random.Generator, slopes: np.ndarray) -> None:
        """One step of NCE on the tokens from ``first`` on; ``slopes`` holds the sums of squared gradients (Adagrad)."""
        before, begin, weight = self._before(classes, owner)
        guess = self.predicted(classes, before, begin, weight)[first:]
        own, n = classes[first:], len(classes)
        noise = np.minimum(np.searchsorted(self.noise, draw.random(NOISE)), self.m - 1)
        many = np.float32(np.log(NOISE))
        target = self.target.take(own, axis=0)
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", guess, target) + (self.bias - self.log_noise)[own] - many, -30, 30)))
        false = guess @ self.target[noise].T
        false += (self.bias - self.log_noise)[noise] - many
        down = np.exp(np.clip(-false, -30, 30, out=false), out=false)
        down += 1
        np.divide(-1, down, out=down)
        slope = np.zeros((n, SIZE), np.float32)
        slope[first:] = up[:, None] * target + down @ self.target[noise]

        grad = np.zeros_like(self.flat)
        g_context, g_topic, g_target, g_weights, g_bias = self.views(grad)
        # one row for each token of the run: what it contributes as target, in windows and as context
        parts = np.zeros((n, 3 * SIZE + 1), np.float32)
        parts[first:, :SIZE] = up[:, None] * guess
        parts[first:, -1] = up
        sums = np.zeros((n + 1, SIZE))
        np.cumsum(slope * weight[:, None], axis=0, out=sums[1:])
        parts[:, SIZE : 2 * SIZE] = sums[np.cumsum(np.bincount(begin, minlength=n))] - sums[1:]
        for k in range(CONTEXT):
            g_weights[k] = np.einsum("ij,ij->j", slope, self.context.take(before[k], axis=0))
            by = slope * self.weights[k]
            outside = np.flatnonzero(before[k] == self.m)
            g_context[self.m] += by[outside].sum(0)
            by[outside] = 0
            parts[: n - k - 1, 2 * SIZE : -1] += by[k + 1 :]
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        rows = classes[order]
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, rows = np.add.reduceat(parts.take(order, axis=0), at, axis=0), rows[at]
        g_target[rows], g_topic[rows], g_bias[rows] = total[:, :SIZE], total[:, SIZE : 2 * SIZE], total[:, -1]
        g_context[rows] += total[:, 2 * SIZE : -1]
        np.add.at(g_target, noise, down.T @ guess)
        np.add.at(g_bias, noise, down.sum(0))
        slopes += grad * grad
        self.flat += RATE * grad / np.sqrt(slopes)

    def log_probability(self, classes: np.ndarray, owner: np.ndarray, first: int = 0) -> np.ndarray:
        """Natural logarithm of each class from ``first`` on after what stands before it; sums to one over the classes."""
        guess = self.predicted(classes, *self._before(classes, owner))[first:]
        own = classes[first:]
        found = np.einsum("ij,ij->i", guess, self.target[own]) + self.bias[own]
        # scores less a bound that no score of the row exceeds, in one product
        bound = np.sqrt(np.einsum("ij,ij->i", guess, guess) * np.einsum("ij,ij->i", self.target, self.target).max()) + self.bias.max()
        ones = np.ones(self.m, np.float32)
        right = np.ascontiguousarray(np.concatenate([self.target, self.bias[:, None], ones[:, None]], axis=1).T)
        left = np.concatenate([guess, np.ones((len(guess), 1), np.float32), -bound[:, None]], axis=1)
        sums = np.empty(len(own), np.float32)
        room = np.empty((ROWS, self.m), np.float32)
        for at in range(0, len(own), ROWS):
            s = np.matmul(left[at : at + ROWS], right, out=room[: len(own) - at])
            np.matmul(np.exp(s, out=s), ones, out=sums[at : at + ROWS])
        out = found - bound - np.log(np.maximum(sums, 1e-45)).astype(float)
        for at in np.flatnonzero(sums < 1e-20).tolist():  # the bound is far above the scores
            s = self.target @ guess[at] + self.bias
            out[at] = found[at] - s.max() - np.log(np.exp(s - s.max()).sum())
        return out


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Class numbers of every encoded text, and its number in the task."""
    number = 0
    for part in batches:
        column = part.column("classes").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) // 2
        codes = np.frombuffer(data, np.uint16, int(ends[-1] - ends[0]), int(ends[0]) * 2).astype(np.int64) if ends[-1] > ends[0] else np.zeros(0, np.int64)
        ends = (ends - ends[0]).tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield codes[a:b], number
            number += 1


def fit(encoded: DataFrame, classes: Classes, total: int) -> np.ndarray:
    """Parameters after ROUNDS of averaged training over all encoded texts (columns share, doc_id, classes)."""
    spark = encoded.sparkSession
    flat = LogBilinear(classes).flat
    shards = max(1, -(-total // SHARD_TOKENS))
    rows = encoded.repartition(shards, "share").sortWithinPartitions("share", "doc_id").select("classes")
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((classes, flat))

        def run(batches, shared=shared, k=k):
            known, start = shared.value
            model, draw = LogBilinear(known, start.copy()), np.random.default_rng(11 + k)
            slopes, seen = np.ones_like(model.flat), 0
            for own, owner, first in blocks(_texts(batches), BATCH):
                model.train(own, owner, first, draw, slopes)
                seen += len(own) - first
            if seen:
                weight = max(1, round(256 * seen / SHARD_TOKENS))
                values = (np.rint(model.flat * UNIT).astype(np.int64) * weight).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([weight] * len(values), pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["row", "weight", "v"])

        made = rows.mapInArrow(run, "row int, weight long, v array<long>")
        means = made.groupBy("row").agg(F.sum("weight").alias("weight"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)))
        found = means.collect()
        if found:
            flat = flat.copy()
            for r in found:
                flat[r["row"]] = np.array(r[2:], float) / (r["weight"] * UNIT)
    return flat


def scores(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of all rows; rows with ``train`` are learned from."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), train.alias("train"))
    learn = texts.where("train")
    counts = written(count_tokens(learn), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    by_ending = {r["ending"]: (r["v"], r["n"]) for r in counts.groupBy("ending").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()}
    # the end always goes along: in tables of few, long documents it is rarer than many words
    frequent = [tuple(r) for r in counts.orderBy(F.col("token") != int(END), F.desc("n"), "token").limit(FREQUENT).select("token", "ending", "n").collect()]
    classes = Classes(frequent, total, distinct, by_ending)
    vocabulary = spark.sparkContext.broadcast(classes)
    floor = float(np.log10(total + distinct + 1))

    def encode(batches):
        known = vocabulary.value
        none = pa.nulls
        for part in chunks(batches):
            hashes, ending, owner = tokens(part)
            n = part.num_rows
            own = known.of(hashes, ending)
            c = known.counts(hashes)
            rare = own >= len(known.short)
            here = np.log10(np.maximum(c, 0) + 1.0)
            inside = np.where(rare, here - np.log10(known.share[np.where(rare, own - len(known.short), 0)]), 0.0)
            sums = lambda x: np.bincount(owner, x, n)
            data, ends = own.astype(np.uint16).tobytes(), np.searchsorted(owner, np.arange(n + 1)) * 2
            texts = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            head = [part.column(c) for c in HEAD]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array(np.bincount(owner, minlength=n)), pa.array(sums(c > 0).astype(np.int64)), pa.array(sums(here) - floor * sums(np.ones(len(owner)))), pa.array(sums(inside)), texts, none(n, pa.int64()), none(n, pa.int64())],
                OUT,
            )
            far = np.flatnonzero(c < 0)
            if len(far):
                order = far[np.lexsort((hashes[far], owner[far]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                at = np.flatnonzero(new)
                k = len(at)
                blank = [none(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([head[0].take(pa.array(owner[order][at])), *blank, pa.array(hashes[order][at]), pa.array(np.diff(np.append(at, len(order))))], OUT)

    HEAD = ["row", "doc_id", "train", "share"]
    OUT = [*HEAD, "n_tokens", "known", "base", "inside", "classes", "token", "times"]
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", F.xxhash64("text", "doc_id").alias("share"), "text")
    made = written(rows.mapInArrow(encode, "row long, doc_id long, train boolean, share long, n_tokens long, known long, base double, inside double, classes binary, token long, times long"), "encoded")
    coded = made.where("token is null")
    flat = fit(coded.where("train").select("share", "doc_id", "classes"), classes, total)
    shared = spark.sparkContext.broadcast((classes, flat))

    def score(batches):
        model = LogBilinear(*shared.value)
        for part in batches:
            sums = np.zeros(part.num_rows)
            for own, owner, first in blocks(_texts([part]), BLOCK):
                sums += np.bincount(owner[first:], model.log_probability(own, owner, first), part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(sums / np.log(10) + part.column("inside").to_numpy())], [*part.schema.names[:-2], "model"])

    whole = coded.select("row", "doc_id", "n_tokens", "known", "base", "inside", "classes").mapInArrow(score, "row long, doc_id long, n_tokens long, known long, base double, model double")
    rare = made.where("token is not null").select("row", "token", "times").join(counts.select("token", "n"), "token", "left")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0)).alias("logs"))
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return whole.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
