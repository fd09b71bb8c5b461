"""Operator 1: language identification by rank-order profiles of character n-grams.

Training counts the n-grams (1 to 3 letters of the lower-cased text, words padded by a blank) of
every labelled text and keeps each language's ``PROFILE`` most frequent in rank order. A text's own
ranking is compared with each profile by the sum of out-of-place distances (``PROFILE`` for an
n-gram that the profile lacks); the nearest language wins, ties go to the name that sorts first.

Counting is one pass whose tasks emit n-gram counts, summed by Spark. Profiles are sent to the
executors ``LANGUAGES`` languages at a time, ``PROFILE`` rows each, whatever the size of the corpus; if
there are more, each further block of languages is one more pass over the texts and the nearest of all
blocks wins, so the result doesn't depend on the blocks.

Nulls: a text that is null or has no letter is ``und`` with score 0; rows with a null language don't
train; a null doc_id is kept. If nothing trains, every text is ``und``. Repeated rows count as often
as they occur. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.chunks import CHUNK_BYTES, chunks

PROFILE = 300
#: Languages whose profiles are sent at once.
LANGUAGES = 1000
#: Distinct n-grams that a counting task holds before it emits them.
HELD = 1 << 20
SALTS = 16
BLANK = 1


def _letters() -> np.ndarray:
    """For each of the first 65,536 code points: itself if a letter, else BLANK."""
    return np.array([c if chr(c).isalpha() and c > BLANK else BLANK for c in range(1 << 16)], np.uint64)


_LETTER: np.ndarray | None = None


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every n-gram occurrence. Letters beyond 65,536 are folded to their low 16 bits."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    # NUL before, between and after the texts keeps them apart
    line = "\x00" + "\x00".join((x or "").replace("\x00", " ").lower() for x in texts) + "\x00"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _LETTER[points & 0xFFFF]
    if (points > 0xFFFF).any():
        far = np.flatnonzero(points > 0xFFFF)
        alpha = np.array([chr(c).isalpha() for c in points[far].tolist()])
        codes[far] = np.where(alpha, np.maximum(points[far] & 0xFFFF, 2), BLANK).astype(np.uint64)
    border = points == 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK) | border[1:]
    codes, owner = codes[keep], (np.cumsum(border) - 1)[keep]
    letter = codes != BLANK
    pairs = (codes[:-1] << np.uint64(16)) | codes[1:]
    triples = (pairs[:-1] << np.uint64(16)) | codes[2:]
    first, second, middle = letter[:-1], letter[1:] & ~letter[:-1], letter[1:-1]
    return (
        np.concatenate([owner[letter], owner[:-1][first], owner[1:][second], owner[1:-1][middle]]),
        np.concatenate([codes[letter], pairs[first], pairs[second], triples[middle]]),
    )


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def profiles(docs: DataFrame) -> DataFrame:
    """lang, gram, place (0 for the most frequent) from the columns text and lang of all rows."""

    def run(batches):
        held: dict[tuple[str, int], int] = {}

        def rows():
            names, grams = zip(*held, strict=True) if held else ((), ())
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grams, pa.int64()), pa.array(held.values(), pa.int64())], ["lang", "gram", "n"])
            held.clear()
            return made

        for part in chunks(batches):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                _, grams = ngrams([t for t, own in zip(texts, langs, strict=True) if own == lang])
                for g, n in zip(*(x.tolist() for x in _counted(grams)), strict=True):
                    held[lang, g] = held.get((lang, g), 0) + n
            if len(held) >= HELD:
                yield rows()
        yield rows()

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each salted share first, so that no task ranks all n-grams of a language
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(share)).where(F.col("place") <= PROFILE)
    return best.withColumn("place", F.row_number().over(whole) - 1).where(F.col("place") < PROFILE).select("lang", "gram", "place")


class Ranker:
    """The profiles as a table of places, and the comparison of texts with it."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.uint64)
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, np.uint64(gram)), column[lang]] = place

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 - distance / (the largest distance that its ranking can have)."""
        owner, grams = ngrams(texts)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not len(owner) or not self.langs:
            return names, score
        keys, n = _counted((owner.astype(np.uint64) << np.uint64(48)) | grams)
        of, gram = (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1)
        # most frequent first within each text; equal counts by n-gram, as keys are sorted
        order = np.argsort((of << 32) + ((1 << 31) - n), kind="stable")
        of, gram = of[order], gram[order]
        begin = np.searchsorted(of, np.arange(len(texts)))
        place = np.arange(len(of)) - begin[of]
        top = place < PROFILE
        of, gram, place = of[top], gram[top], place[top]
        row = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        row[self.grams[row] != gram] = len(self.grams)
        known = self.places[row]
        away = np.where(known < 0, PROFILE, np.abs(known - place[:, None]))
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        total = np.add.reduceat(away, begin, axis=0)
        best = total.argmin(1)
        most = np.diff(np.append(begin, len(of))) * PROFILE
        for text, b in zip(of[begin].tolist(), best.tolist(), strict=True):
            names[text] = self.langs[b]
        score[of[begin]] = np.clip(1 - total[np.arange(len(best)), best] / most, 0, 1)
        return names, score


def _blocks(profile: DataFrame) -> list[list[tuple[str, int, int]]]:
    """The profiles of up to LANGUAGES languages each, by name."""
    from tidepanel.llm.store import written

    profile = written(profile, "profiles")
    names = profile.select("lang").distinct()
    if names.count() <= LANGUAGES:
        return [[tuple(r) for r in profile.collect()]]
    blocks, last = [], None
    while True:
        ahead = names if last is None else names.where(F.col("lang") > last)
        mine = [r["lang"] for r in ahead.orderBy("lang").limit(LANGUAGES).collect()]
        if not mine:
            return blocks
        blocks.append([tuple(r) for r in profile.where(F.col("lang").between(mine[0], mine[-1])).collect()])
        last = mine[-1]


def predicted(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score added; clashing columns are replaced."""
    return _ranked(docs, _blocks(profile))


def _ranked(docs: DataFrame, blocks: list[list[tuple]]) -> DataFrame:
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double"

    def one(rows: DataFrame, block: list, names: list[str], schema: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            ranker = Ranker(shared.value)
            for part in chunks(batches, limit=CHUNK_BYTES // 2):
                # the text's number takes 16 of a key's bits
                for at in range(0, part.num_rows, 1 << 15):
                    piece = part.slice(at, 1 << 15)
                    found, score = ranker.predict(piece.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

        return rows.select(*names).mapInArrow(run, schema)

    if len(blocks) == 1:
        return one(docs, blocks[0], names, schema)
    from tidepanel.llm.store import written

    rows = written(docs.select(*names).withColumn("_row", F.monotonically_increasing_id()), "texts")
    best = None
    for k, block in enumerate(blocks):
        made = one(rows, block, ["text", "_row"], "text string, _row long, lang_pred string, score double").select("_row", "lang_pred", "score", F.lit(k).alias("_block"))
        best = made if best is None else best.unionByName(made)
    # the nearest wins, ties go to the name that sorts first, as within a block
    best = best.groupBy("_row").agg(F.max_by(F.struct("lang_pred", "score"), F.struct("score", -F.col("_block"))).alias("best"))
    return rows.join(best, "_row").select(*names, "best.lang_pred", "best.score")


def identify(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    return predicted(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), profile).select("doc_id", "lang_pred", "score")


def accepted(docs: DataFrame, profile: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a letter and scores at least ``least`` in its language.

    If no language was learned, nothing can be told about a text with a letter and all of these stay.
    """
    others = [c for c in docs.columns if c != "text"]
    blocks = _blocks(profile)  # counts the corpus, once
    found = _ranked(docs.select(F.col("text").cast("string").alias("text"), *([F.struct(*others).alias("rest")] if others else [])), blocks)
    known = F.lit(bool(blocks[0]))
    told = F.when(known, (F.col("lang_pred") != "und") & (F.col("score") >= least)).otherwise(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return found.where(told).select(*("text" if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
