"""Daily bar files in two layouts, as one canonical panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("open", "high", "low", "close", "prevclose", "volume", "turnover", "trades")
SERIES = ("EQ", "BE")
PREFIX = "INE"


@dataclass(frozen=True)
class Layout:
    """Names of a layout's columns for the canonical ones (fixed values of the file formats)."""

    name: str
    columns: dict[str, str] = field(hash=False)
    #: The column of a file's own day, and how it is written.
    day: tuple[str, str]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.columns.values())


LEGACY = Layout(
    "legacy",
    {"symbol": "SYMBOL", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "prevclose": "PREVCLOSE", "volume": "TOTTRDQTY", "turnover": "TOTTRDVAL", "trades": "TOTALTRADES", "isin": "ISIN"},
    ("TIMESTAMP", "dd-MMM-yyyy"),
)
NEWER = Layout(
    "newer",
    {"symbol": "TckrSymb", "series": "SctySrs", "kind": "FinInstrmTp", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "prevclose": "PrvsClsgPric", "volume": "TtlTradgVol", "turnover": "TtlTrfVal", "trades": "TtlNbOfTxsExctd", "isin": "ISIN"},
    ("TradDt", "yyyy-MM-dd"),
)
#: Where a path tells the day, first match first, and how it is written there (fixed values of published names).
DAYS = ((r"day=(\d{8})", "yyyyMMdd"), (r"(\d{8})[^/]*$", "yyyyMMdd"), (r"(?i)(\d{2}[a-z]{3}\d{4})[^/]*$", "ddMMMyyyy"))


def canonical(rows: DataFrame, layout: Layout) -> DataFrame:
    """Text columns of a layout (and date) to the panel: series and identifier filters, trimmed text, numbers or null."""
    text = {k: F.trim(F.col(f"`{v}`")) for k, v in layout.columns.items()}
    rows = rows.where(text["series"].isin(*SERIES) & text["isin"].startswith(PREFIX))
    rows = rows.where(text["kind"] == "STK") if "kind" in text else rows
    return rows.select("date", text["symbol"].alias("symbol"), text["isin"].alias("isin"), *(text[n].try_cast("double").alias(n) for n in NUMBERS))


def _cells(line: Column) -> Column:
    """The trimmed cells of a CSV line; a comma inside quotes is part of its cell."""
    plain, quoted = F.split(line, ","), F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    bare = F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain), lambda c: F.regexp_replace(c, '^[\\s\ufeff]*"?\\s*|\\s*"?\\s*$', ""))
    return F.when(F.rlike(line, F.lit('["\\s\ufeff]')), bare).otherwise(plain)  # most lines have nothing to strip


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Daily CSV files of any layout as (panel, report).

    A file's layout is told by its header, wherever that names all columns of one, and cells are taken
    by name, so their order, further columns and trailing commas don't matter. The day stands in the
    file's path (``DAYS``: day=yyyymmdd, yyyymmdd or ddMMMyyyy in its name), or else in the layout's own
    column of each row. Damaged values are null.

    The report has a row for each file: file, layout, rows read, day (the first one), status ("read",
    "no date", "no header" or "unreadable"). Only files that are read give bars; a row of theirs without a day gives none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("_metadata.file_path").alias("file"))
    text = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).text(paths)
    # inline makes columns of cells and layout: what reads them later, filters too, splits no line again
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))
    lines = text.select(F.col("_metadata.file_path").alias("file"), "value", once(_cells(F.col("value")), "cells"))
    kind = F.lit(None).cast("string")
    for layout in (LEGACY, NEWER):
        names = F.forall(F.array(*map(F.lit, layout.columns.values())), lambda n: F.array_contains("cells", n))
        kind = F.when(F.contains("value", F.lit(layout.columns["isin"])) & names, layout.name).otherwise(kind)
    lines = lines.select("file", "cells", once(kind, "layout"))
    heads = lines.where("layout is not null").groupBy("file").agg(F.min(F.struct("layout", "cells")).alias("head"))
    rows = lines.where("layout is null").drop("layout").join(F.broadcast(heads), "file")  # one row a file
    at = lambda n: F.get("cells", F.array_position("head.cells", n).cast("int") - 1)
    told = F.coalesce(*(F.try_to_date(F.nullif(F.regexp_extract("file", pattern, 1), F.lit("")), form) for pattern, form in DAYS))
    own = F.coalesce(*(F.when(F.col("head.layout") == x.name, F.try_to_date(at(x.day[0]), x.day[1])) for x in (LEGACY, NEWER)))
    rows = rows.withColumn("date", F.coalesce(told, own))
    panel = None
    for layout in (LEGACY, NEWER):
        mine = rows.where((F.col("head.layout") == layout.name) & F.col("date").isNotNull()).select("date", *(at(n).alias(n) for n in layout.columns.values()))
        mine = canonical(mine, layout)
        panel = mine if panel is None else panel.unionByName(mine)
    seen = lines.groupBy("file").agg(F.count_if(F.col("layout").isNull()).alias("rows"))
    days = rows.groupBy("file").agg(F.min("date").alias("day"))
    found = files.join(seen, "file", "left").join(heads.select("file", "head.layout"), "file", "left").join(days, "file", "left")
    dated = F.col("day").isNotNull() | (F.coalesce("rows", F.lit(0)) == 0)
    status = F.when(F.col("layout").isNotNull() & dated, "read").when(F.col("layout").isNotNull(), "no date").when(F.col("rows").isNotNull(), "no header").otherwise("unreadable")
    return panel, found.select("file", "layout", F.coalesce("rows", F.lit(0)).alias("rows"), "day", status.alias("status"))


class MissingDaysError(RuntimeError):
    """Days of a range could not be loaded."""


def load_files(spark: SparkSession, paths: list[str], first: str, last: str, expected: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The bars of daily files between two days, from ``read``.

    With ``strict``, a file that can't be read, and a day of ``expected`` (column date) in the range without a
    bar raise ``MissingDaysError``, which names the first five; else they are left out.
    """
    panel, report = read(spark, paths)
    panel = panel.where(F.col("date").between(first, last))
    if strict:
        bad = [f"{r['file']} ({r['status']})" for r in report.where("status <> 'read'").orderBy("file").limit(5).collect()]
        if expected is not None:
            absent = expected.select("date").distinct().where(F.col("date").between(first, last)).join(panel.select("date").distinct(), "date", "left_anti")
            bad += [str(r["date"]) for r in absent.orderBy("date").limit(5).collect()]
        if bad:
            raise MissingDaysError(f"could not load {', '.join(bad[:5])}")
    return panel


def write(bars: DataFrame, path: str, layout: Layout) -> None:
    """Bars (with series, and kind where the layout names it) as one CSV file a day, with header, in folders day=yyyymmdd."""
    rows = bars.select(F.date_format("date", "yyyyMMdd").alias("day"), *(F.col(k).cast("string").alias(v) for k, v in layout.columns.items()))
    rows.repartition("day").write.partitionBy("day").option("header", True).mode("overwrite").csv(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """The panel as Parquet in canonical order: ranges of days, by date and symbol within."""
    panel.repartitionByRange("date").sortWithinPartitions("date", "symbol").write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A result table (ledger, coefficients, metrics, predictions, shortlist) as CSV with header, in the order given."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


#: Names of an index-level file's columns for the canonical ones (fixed values of the file format).
INDEX_COLUMNS = {"index_name": "Index Name", "open": "Open Index Value", "high": "High Index Value", "low": "Low Index Value", "close": "Closing Index Value", "pe": "P/E", "pb": "P/B", "div_yield": "Div Yield"}
CONSTITUENTS = {"name": "Company Name", "symbol": "Symbol", "isin": "ISIN Code"}


def read_named(spark: SparkSession, paths: list[str], columns: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """CSV files with headers by trimmed names (files of one header each call); a column that they lack is null, damaged numbers are null."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", False).csv(paths)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    kept = [c for c in rows.columns if c not in columns.values()]
    out = [F.trim(F.col(f"`{v}`")) if v in rows.columns else F.lit(None).cast("string") for v in columns.values()]
    return rows.select(*(F.col(f"`{c}`") for c in kept), *((x.try_cast("double") if k in numbers else x).alias(k) for k, x in zip(columns, out, strict=True)))


def to_lines(bars: DataFrame, layout: Layout) -> DataFrame:
    """date, line: bars as text lines of a layout."""
    return bars.select("date", F.to_csv(F.struct(*(F.col(k).cast("string").alias(v) for k, v in layout.columns.items()))).alias("line"))


def parse(lines: DataFrame, layout: Layout) -> DataFrame:
    """The panel from date, line."""
    return canonical(lines.select("date", F.from_csv("line", layout.schema()).alias("r")).select("date", "r.*"), layout)


def load_range(parts: dict[str, DataFrame], first: str, last: str, expected: DataFrame | None = None) -> DataFrame:
    """Lines of both layouts between two days as one panel.

    With ``expected`` (column date), a day of it without a bar raises when the result is computed.
    """
    layouts = {LEGACY.name: LEGACY, NEWER.name: NEWER}
    made = None
    for name, lines in parts.items():
        rows = parse(lines.where(F.col("date").between(first, last)), layouts[name])
        made = rows if made is None else made.unionByName(rows)
    if expected is not None:
        absent = expected.join(made.select("date").distinct(), "date", "left_anti").agg(F.count(F.lit(1)).alias("absent"))
        made = made.crossJoin(F.broadcast(absent)).where(F.assert_true(F.col("absent") == 0, F.lit("days are missing")).isNull()).drop("absent")
    return made
