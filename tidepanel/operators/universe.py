"""Liquidity-ranked universes as of every formation date, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.config import Config
from tidepanel.functions.tables import dealt
from tidepanel.operators.calendar import covering


def spread(panel: DataFrame, forms: DataFrame, window: int) -> DataFrame:
    """Each bar once for every formation whose trailing window holds it (form_date, form_s added)."""
    return panel.join(F.broadcast(covering(forms, window)), "s")


def formation_stats(panel: DataFrame, forms: DataFrame, window: int) -> DataFrame:
    """form_date, isin, symbol, median_turnover, n_days, last_close, window_days, trading_frac, traded (on the date itself).

    Bars are dealt by isin before they are spread, so each is sent once, not once for every formation that sees it.
    """
    rows = spread(dealt(panel.select("isin", "s", "symbol", "turnover", "close"), "isin", panel.count()), forms, window)
    stats = rows.groupBy("form_date", "form_s", "isin").agg(
        F.max_by("symbol", "s").alias("symbol"),
        F.median("turnover").alias("median_turnover"),
        F.size(F.collect_set("s")).cast("long").alias("n_days"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("s"))).alias("last_close"),
        (F.max("s") == F.col("form_s")).alias("traded"),
    )
    days = F.least(F.col("form_s") + 1, F.lit(window))
    return stats.withColumn("window_days", days.cast("long")).withColumn("trading_frac", F.col("n_days") / F.col("window_days"))


def universe(stats: DataFrame, cfg: Config) -> DataFrame:
    """form_date, isin, symbol, median_turnover, rank of the eligible names, best first; ties by isin."""
    ok = stats.where("traded").where((F.col("trading_frac") >= cfg.min_trading_frac) & (F.col("median_turnover") >= cfg.min_turnover))
    w = Window.partitionBy("form_date").orderBy(F.desc("median_turnover"), "isin")
    ranked = ok.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= cfg.universe_size)
    return ranked.select("form_date", "form_s", "isin", "symbol", "median_turnover", "rank")


def churn(members: DataFrame) -> DataFrame:
    """form_date, n_new, size, churn of every formation but the first: names that the one before lacked."""
    dates = members.select("form_date").distinct().withColumn("previous", F.lag("form_date").over(Window.orderBy("form_date")))
    rows = members.select("form_date", "isin").join(F.broadcast(dates.where("previous is not null")), "form_date")
    before = members.select(F.col("form_date").alias("previous"), "isin", F.lit(1).alias("old"))
    rows = rows.join(before, ["previous", "isin"], "left")
    size, new = F.count(F.lit(1)), F.count(F.lit(1)) - F.count("old")
    return rows.groupBy("form_date").agg(new.alias("n_new"), size.alias("size"), (new / size).alias("churn"))


def survivorship(members: DataFrame) -> DataFrame:
    """One row: sizes over formations, names that were ever members, members of the last formation, and names gone since."""
    sizes = members.groupBy("form_date").agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"))
    last = members.agg(F.max("form_date").alias("last"))
    ever = members.groupBy("isin").agg(F.max("form_date").alias("d")).crossJoin(F.broadcast(last))
    names = ever.agg(F.count(F.lit(1)).alias("ever"), F.count_if(F.col("d") == F.col("last")).alias("latest"))
    return size.crossJoin(F.broadcast(names)).withColumn("gone", F.col("ever") - F.col("latest"))


def overlap(members: DataFrame, published: DataFrame) -> DataFrame:
    """One row: share of a published list (symbol) that the members hold; null if the list is empty."""
    theirs = published.select("symbol").distinct()
    hit = theirs.join(members.select("symbol").distinct().withColumn("mine", F.lit(1)), "symbol", "left")
    return hit.agg(F.count("mine").alias("shared"), F.count(F.lit(1)).alias("published"), F.try_divide(F.count("mine"), F.count(F.lit(1))).alias("overlap"))
