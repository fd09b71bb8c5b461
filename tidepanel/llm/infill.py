"""Operator 11: fill-in-middle forms of texts, cut at line borders by one regular expression a row.

``transform`` counts a text's units (lines, by default) with ``regexp_count``. Two hashes of its doc_id
give the cuts a <= b in units, and a pattern made for the row, with the possessive groups ``(unit){a}``
and ``(unit){b-a}``, takes prefix, middle and suffix in one match: the replacement writes them in the
order of the form. Possessive groups never give back a unit, so a match is one pass and needs no stack,
whatever the number of units. ``restore`` undoes it. Everything stays in built-in functions, nothing
is shuffled, and a text is held whole by one task only.

Nulls: a null text is the empty one; a null doc_id counts as an empty number in the hash. An empty text, or one that
holds a mark, is left plain. Repeated rows are cut alike. An empty table gives an empty one. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One unit of a text: a line with its end, or the last line without one.
LINE = r"[^\n]*+\n|[^\n]++"
#: Marks in front of prefix, suffix and middle (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Out of a hundred texts: those that are cut, and of these those with the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of 32 bits of sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _pattern(a: Column, between: Column, unit: str) -> Column:
    parts = [rf"(?s)\A((?:{unit}){{", a, rf"}}+)((?:{unit}){{", between, r"}+)(.*+)\z"]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, unit: str = LINE) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), output, prefix_chars, middle_chars (code points; null if plain).

    ``unit`` is a pattern whose matches, one after the other, make up any whole text.
    """
    h = hashes(F.col("doc_id"), seed)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumns({"form": form, "_a": F.least(*cuts), "_b": F.greatest(*cuts)})
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    made = F.regexp_replace("text", _pattern(F.col("_a"), F.col("_b") - F.col("_a"), unit), order)
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(made))
    prefix, middle, _ = _parts(F.col("output"), F.col("form"))
    chars = {f"{name}_chars": F.when(F.col("form") != "plain", F.char_length(part).cast("long")) for name, part in (("prefix", prefix), ("middle", middle))}
    return rows.withColumns(chars).select("doc_id", "n", "form", "output", *chars)


def _parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a text that is not plain; each form starts with a mark."""
    cells = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = form == "psm"
    first, second, third = (F.get(cells, F.lit(k)) for k in (1, 2, 3))
    return F.when(psm, first).otherwise(second), third, F.when(psm, second).otherwise(first)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of."""
    return F.when(form == "plain", output).otherwise(F.concat(*_parts(output, form)))
