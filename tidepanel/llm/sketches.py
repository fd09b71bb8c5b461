"""Operator 6: bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's distinct shingles (5 words;
a text with fewer has its whole sequence as one, one without words has an empty sketch). Sketches of
parts merge to the sketch of the whole. From two sketches: resemblance is the share of the union's k
smallest that both hold, and containment and the number of distinct shingles follow from the k-th
smallest as the k-minimum-values estimate. Sketches that are not full are exact sets.

``with_next`` gives each document the text of the next one in descending order of doc_id without a
global sort: documents go to ranges of doc_id of about equal size in bytes, and the first document of
each range is sent to the range before it as well. The borders are quantiles of doc_ids that occur in
proportion to their bytes; they only decide which task works on a document. The number of ranges follows
the size of the texts without a bound, so a range doesn't grow with the corpus.

Nulls: a null text is empty; null doc_ids come last in the order, by the hash of their text. Rows that repeat a doc_id follow
each other by the hash of their text. A lone document is its own next one. An empty table gives an
empty one. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.store import sized, written

SHINGLE, K = 5, 128
SPLIT = r"[\x20\x09-\x0D]+"
#: Bytes of text in a range of documents; a document's range is found in steps of about FAN comparisons, the first FAN**2
#: borders in the plan itself and those within in a table; points for each border by which it is set.
RANGE_BYTES, FAN, POINTS = 16 << 20, 32, 64


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPLIT), ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles; ``words`` should be a column of its own, as it is used several times."""
    at = lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, size)))
    return F.slice(F.transform(words, at), F.lit(1), F.greatest(F.size(words) - (size - 1), F.least(F.size(words), F.lit(1))))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact if the sketch is not full."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of intersection over union; 1 for two empty sketches."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.greatest(F.size(both), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    common = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct(a, k), F.lit(1.0))))


def _points(rows: DataFrame, each: int) -> DataFrame:
    """doc_id, once for every ``each`` bytes of its text, the rest by a draw from its hash."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(_bytes() / each + draw).cast("int")
    return rows.where("doc_id is not null").withColumn("times", times).where("times > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))))


def _bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def _quantiles(n: int) -> Column:
    return F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))


def _ranged(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``part``, and how many numbers of parts make a group of them (FAN**2 groups or few more).

    ``part`` is the number of a range of doc_ids of about equal bytes, rising with doc_id; null doc_ids have
    ranges below 0, rising with the hash.
    """
    total, empty = rows.agg(F.coalesce(F.sum(_bytes()), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), _bytes())), F.lit(0))).first()
    n, nulls = max(1, -(-(total - empty) // RANGE_BYTES)), max(1, -(-empty // RANGE_BYTES))
    cells = min(n, FAN**2)
    inner = -(-n // cells)
    found = _points(rows, max(1, (total - empty) // (cells * POINTS))).agg(_quantiles(cells)).first()[0] if cells > 1 else None
    low = [-(1 << 63), *sorted(set(found or ()))]
    share = (F.col("hash") / float(1 << 63) + 1) / 2
    null_part = F.greatest(F.least(F.floor(share * nulls), F.lit(nulls - 1)), F.lit(0)) - nulls
    rows = rows.withColumn("cell", F.when(F.col("doc_id").isNotNull(), _place(low, F.col("doc_id"))).cast("long"))
    place = F.lit(0)
    if inner > 1:
        points = _points(rows.select("doc_id", "text", "cell"), max(1, (total - empty) // (n * POINTS)))
        points = points.withColumn("cell", _place(low, F.col("doc_id")).cast("long"))
        borders = points.groupBy("cell").agg(F.sort_array(F.array_distinct(_quantiles(inner))).alias("borders"))
        step = max(1, int(inner**0.5))
        borders = written(borders.withColumn("heads", F.filter("borders", lambda _, i: i % step == 0)), "borders")
        rows = rows.join(sized(borders, 10 * inner + 100), "cell", "left")
        heads = F.size(F.filter("heads", lambda b: b <= F.col("doc_id")))
        within = F.filter(F.slice("borders", (F.greatest(heads, F.lit(1)) - 1) * step + 1, step), lambda b: b <= F.col("doc_id"))
        place = F.coalesce((F.greatest(heads, F.lit(1)) - 1) * step + F.size(within), F.lit(0))
    part = F.when(F.col("doc_id").isNull(), null_part.cast("long")).otherwise(F.col("cell") * inner + place)
    return rows.withColumn("part", part).select("doc_id", "text", "hash", "part"), -(-(n + nulls) // FAN**2)


def _place(low: list[int], x: Column) -> Column:
    """How many of the sorted borders (FAN**2 at most) are at most x, less one; found in two steps."""
    step = -(-len(low) // FAN)
    count = lambda part: F.size(F.filter(F.array(*map(F.lit, part)), lambda b: b <= x))
    if step == 1:
        return count(low) - 1
    parts = F.array(*(F.array(*map(F.lit, low[k : k + step])) for k in range(0, len(low), step)))
    return F.get(F.transform(F.array(count(low[::step]) - 1), lambda k: k * step + F.size(F.filter(F.get(parts, k), lambda b: b <= x)) - 1), F.lit(0))


def _above(heads: DataFrame, span: int) -> DataFrame:
    """``heads`` (a written table, one row a part) with ``above``, the next part that has documents; the last one's is the first.

    Parts are followed within groups of ``span`` numbers, and one row a group gives the next group's first.
    """
    heads = heads.withColumn("group", F.floor(F.col("part") / span))
    order = Window.orderBy("group")  # over a row for each group, whose number is bounded
    first = heads.groupBy("group").agg(F.min("part").alias("least"))
    first = first.select("group", F.coalesce(F.lead("least").over(order), F.first("least").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("onward"))
    within = F.lead("part").over(Window.partitionBy("group").orderBy("part"))
    return heads.withColumn("within", within).join(F.broadcast(first), "group").withColumn("above", F.coalesce("within", "onward"))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, next_text, and ``extra`` rows (an edge's copy, to be dropped in the end); the window used."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows, span = _ranged(rows)
    heads = written(rows.groupBy("part").agg(F.max(F.struct("doc_id", "hash")).alias("head")), "heads")
    # the range above holds the documents before this one's first, so that first goes there too
    heads = written(_above(heads, span).select(F.col("part").alias("own"), "head", "above"), "ranges")
    first = (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("hash") == F.col("head.hash"))
    copied = rows.join(sized(heads, 40), first, "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    places = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("part"), F.lit(True).alias("extra"))))
    dealt = copied.select("doc_id", "text", "hash", F.explode(places).alias("place")).select("doc_id", "text", "hash", "place.part", "place.extra")
    window = Window.partitionBy("part").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("hash"))
    return dealt.withColumn("next_text", F.lead("text").over(window)), window


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (the last half replaced by the next document's begin), sketch, edited_sketch, next_sketch."""
    rows, window = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", (F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, int(n_chars - half))"), F.expr("left(coalesce(next_text, ''), half)")))
    rows = rows.select("part", "extra", "doc_id", "hash", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), word_hashes(F.col("text")).alias("words"), word_hashes(F.col("edited")).alias("edited_words"))
    rows = rows.select(
        "part", "extra", "doc_id", "hash", "n_chars", "edited_sha256",
        bottom(shingle_hashes(F.col("words"))).alias("sketch"),
        bottom(shingle_hashes(F.col("edited_words"))).alias("edited_sketch"),
    )
    return rows.withColumn("next_sketch", F.lead("sketch").over(window)).where(~F.col("extra")).drop("part", "extra", "hash")


def text_of(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))
