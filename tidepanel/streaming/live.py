"""Incremental refresh and live monitoring with Structured Streaming; every step has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import exists

ZONE = "Asia/Kolkata"


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and fresh rows, the fresh one where both have a key.

    Of several fresh rows of a key the last to arrive wins: by the column ``arrival`` if ``fresh`` has one
    (it is dropped), else the row that sorts last by its values, so the result is always the same.
    """
    given = "arrival" in fresh.columns and "arrival" not in stored.columns
    others = F.struct(*(c for c in stored.columns if c not in keys))
    seq = F.col("arrival").cast("long") if given else F.lit(0).cast("long")
    rows = stored.withColumns({"_new": F.lit(0), "_seq": F.lit(0).cast("long")}).unionByName(fresh.withColumns({"_new": F.lit(1), "_seq": seq}).drop(*(["arrival"] if given else [])))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("_seq"), F.desc(others))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new", "_seq")


def append_new(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sessions after the last stored one are added; rows of stored sessions are left as they are."""
    last = stored.agg(F.max("date").alias("last"))
    return stored.unionByName(fresh.join(F.broadcast(last), F.col("date") > F.col("last")).drop("last"))


def append_result(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: sessions_added, latest, sessions, bars after ``append_new``; nothing new adds 0."""
    last = stored.agg(F.max("date").alias("last"))
    rows = append_new(stored, fresh).join(F.broadcast(last))
    added = F.count_distinct(F.when(F.col("date") > F.col("last"), F.col("date")))
    return rows.agg(added.alias("sessions_added"), F.max("date").alias("latest"), F.count_distinct("date").alias("sessions"), F.count(F.lit(1)).alias("bars"))


class StaleDataError(RuntimeError):
    """The newest session is older than allowed."""


def require_fresh(panel: DataFrame, today: Column, most: int = 5) -> None:
    """Raise ``StaleDataError`` if the newest session is more than ``most`` calendar days old, or there is none."""
    found = freshness(panel, today, most).first()
    if not found["fresh"]:
        raise StaleDataError(f"latest session {found['last']} is {found['age_days']} days old (limit {most})")


#: When a row came: the batch, then the file's time and name, then the place in the file.
ARRIVAL = "struct<batch:bigint,time:timestamp,file:string,row:bigint>"


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of a key the one that arrived last (column ``arrival``)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("arrival"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_append(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str]) -> None:
    """Drain newly landed Parquet files into a panel partitioned by year (see ``appended``); the last correction of a key wins.

    Rows keep when they arrived, so of several corrections in one batch, one file or different batches the latest
    counts, whatever its values; a batch that is run again changes nothing. Only touched years are rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = F.struct(F.lit(number).cast("long").alias("batch"), "_file.file_modification_time", "_file.file_path", "_file.row_index")
        batch = batch.select("*", order.cast(ARRIVAL).alias("arrival"), F.year("date").alias("year")).drop("_file")
        years = [r["year"] for r in batch.select("year").distinct().collect()]
        if not years:
            return
        if exists(spark, target):
            batch = spark.read.parquet(target).where(F.col("year").isin(years)).select(*batch.columns).unionByName(batch)
        # the rewritten partitions are read above, so their rows are held outside the target first
        held = f"{checkpoint}-held"
        newest(batch, keys).write.mode("overwrite").parquet(held)
        spark.read.parquet(held).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(target)

    files = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    stream = spark.readStream.schema(schema).parquet(source).select("*", files.alias("_file"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended(spark: SparkSession, target: str) -> DataFrame:
    """The panel that ``run_append`` keeps."""
    return spark.read.parquet(target).drop("arrival", "year")


def freshness(panel: DataFrame, today: Column, most: int = 5) -> DataFrame:
    """last, age_days, fresh: whether the newest session is at most ``most`` calendar days before ``today`` (which may use the panel's other columns)."""
    names = [c for c in panel.columns if c != "date"]
    rows = panel.agg(F.max("date").alias("last"), *(F.max(c).alias(c) for c in names))
    age = F.date_diff(today, F.col("last"))
    return rows.select("last", age.alias("age_days"), F.coalesce(age <= most, F.lit(False)).alias("fresh"))


def market_open(ts: Column) -> Column:
    """Weekday and 09:15 to 15:30 local, both inclusive."""
    local = F.from_utc_timestamp(ts, ZONE)
    minute = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return (F.weekday(local) < 5) & minute.between(9 * 3600 + 15 * 60, 15 * 3600 + 30 * 60)


def session_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def previous_close(ticks: DataFrame) -> DataFrame:
    """symbol, prev_close: the last price before the newest local day; the last but one where there is none."""
    rows = ticks.where("price is not null").withColumn("day", session_date(F.col("ts")))
    rows = rows.join(F.broadcast(rows.agg(F.max("day").alias("today"))))
    nth = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = rows.withColumn("n", F.row_number().over(nth))
    earlier = F.col("day") < F.col("today")
    close = F.coalesce(F.max_by(F.when(earlier, F.col("price")), F.when(earlier, F.col("ts"))), F.max(F.when(F.col("n") == 2, F.col("price"))))
    return rows.groupBy("symbol").agg(close.alias("prev_close"))


def latest_price(ticks: DataFrame) -> DataFrame:
    """symbol, price, last_bar; as a stream this is an update-mode aggregate."""
    return ticks.where("price is not null").groupBy("symbol").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("last_bar"))


def bars_5m(ticks: DataFrame) -> DataFrame:
    """symbol, start, open, high, low, close, n of five-minute windows. For streams see ``run_bars_5m``."""
    w = F.window("ts", "5 minutes")
    out = ticks.groupBy("symbol", w).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def run_bars_5m(spark: SparkSession, ticks: DataFrame, target: str, checkpoint: str, late: str = "10 minutes") -> DataFrame:
    """Drain a stream of ticks (symbol, ts, price) into five-minute bars and return the bars so far.

    A tick that repeats within the watermark counts once, and one that is later than ``late`` against the
    newest seen is left out. A window is written again in each batch that adds to it; its last state
    (of most ticks) is the bar, so windows that are still open are there, too.
    """
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts", "price"])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    bars_5m(ticks).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{target}/batch=*")
    w = Window.partitionBy("symbol", "start").orderBy(F.desc("n"), F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


#: What the feed appends to a symbol (a fixed value of its format).
SUFFIX = ".NS"


def wide_ticks(files: DataFrame) -> DataFrame:
    """symbol, ts, price of wide intraday files, one row a file (column value, as the text source gives with wholetext).

    A file's first line names its time column and one column a symbol, with or without the feed's suffix; each file has
    columns of its own. Empty and damaged cells give nothing, so lines without any value don't either.
    """
    cells = lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c))
    lines = F.split("value", "\r?\n")
    # inline makes columns of head and lines, so that a file is split once and its lines carry the head, not the text
    split = F.inline(F.array(F.struct(cells(F.get(lines, F.lit(0))).alias("head"), F.slice(lines, 2, 1 << 30).alias("lines"))))
    rows = files.select(split).select("head", F.explode("lines").alias("line"))
    rows = rows.select("head", cells(F.col("line")).alias("cells")).withColumn("ts", F.try_to_timestamp(F.get("cells", F.lit(0))))
    rows = rows.where("ts is not null").select("ts", F.explode(F.filter(F.slice(F.arrays_zip("head", "cells"), 2, 1 << 30), lambda c: c["cells"] != "")).alias("c"))
    symbol = F.when(F.endswith("c.head", F.lit(SUFFIX)), F.expr(f"left(c.head, length(c.head) - {len(SUFFIX)})")).otherwise(F.col("c.head"))
    return rows.select(symbol.alias("symbol"), "ts", F.col("c.cells").try_cast("double").alias("price")).where("price is not null and symbol <> ''")


def _newest_batch(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    found = [int(x.getPath().getName().removeprefix("batch=")) for x in store.listStatus(place) if x.getPath().getName().startswith("batch=")]
    return max((n for n in found if before is None or n < before), default=None)


def _quote(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A symbol's newest price of the day (us: its time); the state ends with the day, which is told once."""
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"symbol": [key[0]], "price": [0.0], "us": [0], "expired": [True]})
        return
    price, us, ends = state.get if state.exists else (None, None, None)
    for rows in parts:
        top = rows.sort_values(["us", "price"]).iloc[-1]
        if us is None or top["us"] >= us:
            price, us, ends = float(top["price"]), int(top["us"]), int(top["ends"])
    over = ends <= state.getCurrentWatermarkMs()
    if over and state.exists:
        state.remove()
    if not over:
        state.update((price, us, ends))
        state.setTimeoutTimestamp(ends)
    yield pd.DataFrame({"symbol": [key[0]], "price": [price], "us": [us], "expired": [over]})


def run_monitor(spark: SparkSession, ticks: DataFrame, previous: DataFrame, forecasts: DataFrame, target: str, checkpoint: str, late: str = "10 minutes", hot: float = 2.5) -> None:
    """Drain a stream of ticks (symbol, ts, price) into the monitor's tables; see ``monitored``.

    A symbol's last price is state, carried on while others tick and dropped by a timer when its local day is over.
    Each batch writes the quotes (the batch before's, with what changed), the scores against ``previous``
    and ``forecasts`` of the newest day, and the JSON document under its own number, so a batch that is run
    again overwrites itself. Without quotes the document says that there are none.
    """
    end = F.to_utc_timestamp(F.date_add(session_date(F.col("ts")), 1).cast("timestamp_ntz").cast("timestamp"), ZONE)
    rows = ticks.where("price is not null and ts is not null").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price")
    rows = rows.select("symbol", "ts", "price", F.unix_micros("ts").alias("us"), F.unix_millis(end).alias("ends")).withWatermark("ts", late)
    quotes = rows.groupBy("symbol").applyInPandasWithState(_quote, "symbol string, price double, us long, expired boolean", "price double, us long, ends long", "update", "EventTimeTimeout")

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.select("symbol", "price", F.timestamp_micros("us").alias("last_bar"), "expired").persist()
        now = fresh.where("not expired").drop("expired")
        last = _newest_batch(spark, f"{target}/quotes", number)
        if last is not None:
            now = spark.read.parquet(f"{target}/quotes/batch={last}").join(fresh.select("symbol"), "symbol", "left_anti").unionByName(now)
        now.write.mode("overwrite").parquet(f"{target}/quotes/batch={number}")
        now = spark.read.schema(now.schema).parquet(f"{target}/quotes/batch={number}").withColumn("day", session_date(F.col("last_bar")))
        today = now.join(F.broadcast(now.agg(F.max("day").alias("day"))), "day").drop("day")
        surprise(today, previous, forecasts).write.mode("overwrite").parquet(f"{target}/scored/batch={number}")
        live_payload(spark.read.parquet(f"{target}/scored/batch={number}"), hot).write.mode("overwrite").text(f"{target}/payload/batch={number}")
        fresh.unpersist()

    quotes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def monitored(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """The scores and the document (column payload) of the newest batch of ``run_monitor``."""
    n = _newest_batch(spark, f"{target}/payload")
    return spark.read.parquet(f"{target}/scored/batch={n}"), spark.read.text(f"{target}/payload/batch={n}").withColumnRenamed("value", "payload")


def surprise(latest: DataFrame, previous: DataFrame, forecasts: DataFrame) -> DataFrame:
    """symbol, price, prev_close, move, expected_move, surprise: today's move over what the yearly forecast (percent) implies for a day."""
    rows = latest.join(previous, "symbol").join(forecasts, "symbol").where("prev_close > 0 and forecast > 0")
    move = F.col("price") / F.col("prev_close") - 1
    expected = F.col("forecast") / 100 / sqrt(252) * sqrt(2 / pi)
    return rows.select("symbol", "price", "prev_close", "last_bar", move.alias("move"), "forecast", expected.alias("expected_move"), (F.abs(move) / expected).alias("surprise"))


def live_payload(scored: DataFrame, hot: float = 2.5, top: int = 25) -> DataFrame:
    """One JSON document; an empty feed says so."""
    ranked = scored.orderBy(F.desc("surprise"), "symbol").limit(top)
    rows = ranked.agg(F.sort_array(F.collect_list(F.struct(F.col("surprise"), "symbol", "price", "prev_close", "move")), asc=False).alias("rows"))
    head = scored.agg(F.max("last_bar").alias("last_bar"), F.count(F.lit(1)).alias("scored"), F.count_if(F.col("surprise") >= hot).alias("hot"))
    both = head.crossJoin(F.broadcast(rows)).withColumn("available", F.col("scored") > 0).withColumn("reason", F.when(F.col("scored") == 0, "feed is empty"))
    return both.select(F.to_json(F.struct("available", "reason", "last_bar", "scored", "hot", "rows")).alias("payload"))
