"""Volatility features, target and baselines: trailing windows over one partitioning by isin."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.config import Config
from tidepanel.functions.tables import dealt
from tidepanel.operators.adjust import returns

def by_s() -> Window:
    return Window.partitionBy("isin").orderBy("s")


def trailing(n: int) -> Window:
    return by_s().rangeBetween(-(n - 1), 0)


def realized(window: int, year: int) -> Column:
    """Annualised deviation of ``ret`` over trailing sessions, with at least half of them (3 at least)."""
    w = trailing(window)
    return F.when(F.count("ret").over(w) >= max(3, window // 2), F.stddev_samp("ret").over(w) * sqrt(year))


#: Sessions whose weights are counted from one point; lambda to this power is below what a sum can hold.
EWMA_BLOCK = 2000


def ewma(lam: float, year: int, minimum: int, sessions: int | None = None) -> Column:
    """Exponentially weighted volatility; weights decay by sessions. Column ``age`` counts sessions since the isin's first.

    Weights grow from the beginning of a block of sessions, so they stay in range on series of any
    length; the block before comes in with its own decay and earlier ones weigh less than 1e-50. Where the
    calendar has no more ``sessions`` than a block, there is one block, which needs no order of its own.
    """
    block = F.floor(F.col("age") / EWMA_BLOCK)
    every = by_s().rowsBetween(Window.unboundedPreceding, 0)
    one = sessions is not None and sessions <= EWMA_BLOCK
    own = Window.partitionBy("isin", block).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("isin").orderBy(block).rangeBetween(-1, -1)
    weight = F.pow(F.lit(lam), -F.pmod(F.col("age"), F.lit(EWMA_BLOCK)))

    def total(x: Column) -> Column:
        if one:
            return F.coalesce(F.sum(x).over(every), F.lit(0.0))
        return F.coalesce(F.sum(x).over(own), F.lit(0.0)) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) * lam**EWMA_BLOCK

    mean = total(F.col("ret") * F.col("ret") * weight) / total(F.when(F.col("ret").isNotNull(), weight))
    return F.when(F.count("ret").over(every) >= minimum, F.sqrt(mean * year))


def parkinson(window: int, year: int, minimum: int) -> Column:
    """Volatility from the day's range; a bar without a positive ordered range doesn't count."""
    w = trailing(window)
    ratio = F.when((F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low")), F.ln(F.when(F.col("low") > 0, F.col("high") / F.col("low"))))
    square = ratio * ratio / (4 * log(2))
    return F.when(F.count(square).over(w) >= minimum, F.sqrt(F.avg(square).over(w) * year))


def forward(horizon: int, year: int) -> Column:
    """The target: deviation of the next ``horizon`` sessions' returns, with at least half of them."""
    w = by_s().rangeBetween(1, horizon)
    return F.when(F.count("ret").over(w) >= horizon // 2, F.stddev_samp("ret").over(w) * sqrt(year))


def past_return(n: int) -> Column:
    """Return since exactly n sessions ago; null if there was no bar."""
    then = F.first_value("adj_close").over(by_s().rangeBetween(-n, -n))
    return F.when(then > 0, F.col("adj_close") / then - 1)


def turnover_ratio(short: int, long: int) -> Column:
    a, b = trailing(short), trailing(long)
    low = F.when(F.count("turnover").over(a) >= max(2, short // 2), F.avg("turnover").over(a))
    high = F.when(F.count("turnover").over(b) >= long // 2, F.avg("turnover").over(b))
    return F.try_divide(low, high)


FEATURES = ["rv_1", "rv_2", "rv_3", "rv_4", "ewma", "parkinson", "ret_long", "ret_short", "market_rv", "ratio_1_3", "ratio_2_4", "vs_market", "turnover_ratio"]


def windowed(panel: DataFrame, cfg: Config) -> DataFrame:
    """One row a bar with the features of its own isin and forward_vol; windows of cfg.windows (rv_1 to rv_4)."""
    w1, w2, w3, w4 = cfg.windows
    y = cfg.year
    size = panel.agg(F.count(F.lit(1)).alias("n"), (F.max("s") - F.min("s") + 1).alias("sessions")).first()
    panel = dealt(panel.select("date", "s", "isin", "symbol", "high", "low", "turnover", "adj_close"), "isin", size["n"])
    first = F.min("s").over(by_s().rowsBetween(Window.unboundedPreceding, 0))
    rows = returns(panel, cap=cfg.return_cap).withColumn("age", F.col("s") - first)
    return rows.select(
        "date", "s", "isin", "symbol", "ret",
        realized(w1, y).alias("rv_1"), realized(w2, y).alias("rv_2"), realized(w3, y).alias("rv_3"), realized(w4, y).alias("rv_4"),
        ewma(cfg.ewma_lambda, y, min(20, w2), size["sessions"] or 0).alias("ewma"),
        parkinson(w2, y, max(2, w2 // 2)).alias("parkinson"),
        past_return(w2).alias("ret_long"), past_return(w1).alias("ret_short"),
        turnover_ratio(w1, w3).alias("turnover_ratio"),
        forward(cfg.horizon, y).alias("forward_vol"),
    )


def market(rows: DataFrame) -> DataFrame:
    """date, market_rv: the median of rv_2 on each date."""
    return rows.groupBy("date").agg(F.median("rv_2").alias("market_rv"))


def against(rows: DataFrame, market: DataFrame) -> DataFrame:
    """The rows of ``windowed`` with the market's volatility, the ratios and anchor."""
    rows = rows.join(F.broadcast(market), "date")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return rows.withColumns({"ratio_1_3": ratio("rv_1", "rv_3"), "ratio_2_4": ratio("rv_2", "rv_4"), "vs_market": ratio("rv_2", "market_rv"), "anchor": F.col("ewma")})


def features(panel: DataFrame, cfg: Config) -> DataFrame:
    """One row a bar with all features, forward_vol and anchor; callers with large panels write ``windowed`` first, which is read twice."""
    rows = windowed(panel, cfg)
    return against(rows, market(rows))


def usable(rows: DataFrame, require_target: bool = True) -> DataFrame:
    """Feature rows with a usable anchor (and target, unless the newest rows are wanted) and target_log_ratio."""
    rows = rows.where(F.col("anchor") > 1e-6)
    rows = rows.where(F.col("forward_vol") > 1e-6) if require_target else rows
    return rows.withColumn("target_log_ratio", F.when(F.col("forward_vol") > 1e-6, F.ln(F.when(F.col("forward_vol") > 0, F.col("forward_vol") / F.col("anchor")))))


def split(rows: DataFrame, horizon_days: int, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """The rows with ``part`` (train, valid, test) by distinct dates; rows in the purge gap before a boundary go."""
    dates = rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = dates.agg(F.count(F.lit(1)).alias("n"))
    marked = dates.crossJoin(F.broadcast(n))
    bounds = marked.agg(
        F.max(F.when(F.col("i") == F.floor(F.col("n") * train), F.col("date"))).alias("t1"),
        F.max(F.when(F.col("i") == F.floor(F.col("n") * (train + valid)), F.col("date"))).alias("t2"),
    )
    part = (
        F.when(F.col("date") <= F.date_sub("t1", horizon_days), "train")
        .when((F.col("date") > F.col("t1")) & (F.col("date") <= F.date_sub("t2", horizon_days)), "valid")
        .when(F.col("date") > F.col("t2"), "test")
    )
    return rows.crossJoin(F.broadcast(bounds)).withColumn("part", part).where("part is not null").drop("t1", "t2")


def grid(rows: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th distinct date, so that forward windows don't overlap."""
    dates = rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    return rows.join(F.broadcast(dates.where(F.col("i") % step == 0).select("date")), "date", "left_semi")
