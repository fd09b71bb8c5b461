"""Trailing factors, winsorised z-scores within the universe, and composites, for all formations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.config import Config
from tidepanel.operators.adjust import returns
from tidepanel.operators.universe import spread

#: Signs of the price factors: higher is better after the sign (fixed values).
PRICE_SIGNS = {"mom_long": 1, "mom_short": 1, "vol": -1, "reversal": -1, "illiq": 1}


def _at(back: Column | int) -> Column:
    """adj_close of the bar ``back`` sessions before formation."""
    return F.max(F.when(F.col("form_s") - F.col("s") == back, F.col("adj_close")))


def price_factors(panel: DataFrame, forms: DataFrame, cfg: Config, members: DataFrame | None = None) -> DataFrame:
    """form_date, isin and the raw factors from one grouping; with members, exactly their rows.

    A history shorter by one session than lookback + skip + 1 answers with its oldest session. Bars of names that
    are never members are left out before anything is sent.
    """
    if members is not None:
        panel = panel.join(members.select("isin").distinct(), "isin", "left_semi")
    longest = max(cfg.long_momentum + cfg.skip + 1, cfg.vol_window + 1, cfg.reversal + 1)
    rows = spread(returns(panel, cap=None), forms, longest)
    oldest = lambda back: F.least(F.lit(back), F.col("form_s"))

    def change(now: Column, then: Column) -> Column:
        return F.when(then > 0, now / then - 1)

    def momentum(lookback: int) -> Column:
        enough = F.col("form_s") + 1 >= lookback + cfg.skip
        return F.when(enough, change(_at(cfg.skip), _at(oldest(lookback + cfg.skip))))

    within = lambda n: F.col("form_s") - F.col("s") < n
    vol = F.stddev_samp(F.when(within(cfg.vol_window), F.col("ret"))) * F.sqrt(F.lit(float(cfg.year)))
    cost = F.try_divide(F.abs("ret"), F.col("turnover"))
    found = rows.groupBy("form_date", "form_s", "isin").agg(
        momentum(cfg.long_momentum).alias("mom_long"),
        momentum(cfg.short_momentum).alias("mom_short"),
        F.when(F.col("form_s") + 1 >= cfg.vol_history, vol).alias("vol"),
        F.when(F.col("form_s") >= 1, change(_at(0), _at(oldest(cfg.reversal)))).alias("reversal"),
        (F.avg(F.when(within(cfg.vol_window), cost)) * 1e6).alias("illiq"),
    )
    found = found.drop("form_s")
    return found if members is None else members.select("form_date", "isin").join(found, ["form_date", "isin"], "left")


def zscores(rows: DataFrame, signs: dict[str, int], cfg: Config) -> DataFrame:
    """z_<factor> of every factor: clipped at the winsor quantiles of its date, standardised there, signed.

    Dates with fewer than z_minimum values give null; no spread gives 0.
    """
    if missing := [f for f in signs if f not in rows.columns]:
        raise KeyError(f"unknown factors: {missing}")
    bounds = rows.groupBy("form_date").agg(*(F.percentile(f, F.array(F.lit(cfg.winsor), F.lit(1 - cfg.winsor))).alias(f"q_{f}") for f in signs))
    clipped = rows.join(F.broadcast(bounds), "form_date")
    clipped = clipped.withColumns({f"c_{f}": F.when(F.col(f).isNotNull(), F.greatest(F.least(F.col(f), F.col(f"q_{f}")[1]), F.col(f"q_{f}")[0])) for f in signs})
    sums = [x for f in signs for x in (F.count(f"c_{f}").alias(f"n_{f}"), F.avg(f"c_{f}").alias(f"m_{f}"), F.stddev_samp(f"c_{f}").alias(f"s_{f}"))]
    moments = clipped.groupBy("form_date").agg(*sums)
    both = clipped.join(F.broadcast(moments), "form_date")
    z = {}
    for f, sign in signs.items():
        plain = F.when(F.col(f"s_{f}") > 0, (F.col(f"c_{f}") - F.col(f"m_{f}")) / F.col(f"s_{f}")).otherwise(F.lit(0.0))
        z[f"z_{f}"] = F.when((F.col(f"n_{f}") >= cfg.z_minimum) & F.col(f"c_{f}").isNotNull(), plain * sign)
    return both.select(*rows.columns, *(c.alias(k) for k, c in z.items()))


def composite(rows: DataFrame, factors: list[str], require_all: bool = True) -> DataFrame:
    """The rows with ``composite``: the mean z of the selected factors; all of them, or half at least, must be there."""
    z = [F.col(f"z_{f}") for f in factors]
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in z))
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in z))
    enough = n == len(z) if require_all else (n >= len(z) / 2) & (n > 0)
    return rows.withColumn("composite", F.when(enough, total / n))


def with_extra(price: DataFrame, extra: DataFrame, price_signs: dict[str, int], extra_signs: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """Price factors with further ones aligned to the same rows; names must not collide and every one needs a sign."""
    if clash := set(price_signs) & set(extra_signs):
        raise KeyError(f"extra factors collide with price factors: {sorted(clash)}")
    if missing := set(extra.columns) - {"form_date", "isin"} - set(extra_signs):
        raise ValueError(f"no sign for {sorted(missing)}")
    return price.join(extra, ["form_date", "isin"], "left"), price_signs | extra_signs
