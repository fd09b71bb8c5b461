"""Data-quality reports over panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def panel_shape(panel: DataFrame) -> DataFrame:
    """One row: size, range, identities, null closes and the number of names a day."""
    whole = panel.agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("isin").alias("isins"),
        F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("close").isNull()).alias("null_closes"),
    )
    days = panel.groupBy("date").agg(F.count(F.lit(1)).alias("k")).agg(F.min("k").alias("names_min"), F.median("k").alias("names_median"), F.max("k").alias("names_max"))
    return whole.crossJoin(F.broadcast(days))


def symbol_reuse(panel: DataFrame, top: int = 10) -> DataFrame:
    """symbol, isins of the symbols that stood for most identities."""
    return panel.groupBy("symbol").agg(F.count_distinct("isin").alias("isins")).where("isins > 1").orderBy(F.desc("isins"), "symbol").limit(top)


def action_stats(actions: DataFrame, cal: DataFrame, sessions_a_year: float) -> DataFrame:
    """One row: number, yearly rate and distribution of the factors."""
    q = F.percentile("factor", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    found = actions.agg(F.count(F.lit(1)).alias("n"), F.avg("factor").alias("mean"), q.alias("q")).crossJoin(F.broadcast(cal.agg(F.count(F.lit(1)).alias("sessions"))))
    return found.select("n", (F.col("n") / (F.col("sessions") / sessions_a_year)).alias("per_year"), "mean", *(F.col("q")[i].alias(p) for i, p in enumerate(("p05", "p25", "p50", "p75", "p95"))))


def return_quality(panel: DataFrame, crash: float = -0.4) -> DataFrame:
    """One row: raw against adjusted returns from bar to bar: number, deviation, days below ``crash``."""
    w = Window.partitionBy("isin").orderBy("s")
    rows = panel.select((F.col("close") / F.lag("close").over(w) - 1).alias("raw"), (F.col("adj_close") / F.lag("adj_close").over(w) - 1).alias("adjusted"))
    return rows.agg(*(x for c in ("raw", "adjusted") for x in (F.count(c).alias(f"n_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.count_if(F.col(c) < crash).alias(f"crashes_{c}"))))


def smallest_actions(actions: DataFrame, top: int = 8) -> DataFrame:
    """isin, date, factor of the most drastic actions."""
    return actions.orderBy("factor", "isin", "date").limit(top)
