"""Information coefficients, performance statistics, forecast scores and significance."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1 within keys; equal values share their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def ic(rows: DataFrame, minimum: int = 30) -> DataFrame:
    """factor, form_date, n, size, ic: Spearman correlation of x with ret for each factor and date.

    ``rows``: factor, form_date, isin, x, ret (null where unknown); size counts all rows.
    """
    keys = ["factor", "form_date"]
    sized = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("x is not null and ret is not null")
    # values that differ by rounding noise alone tie
    sized = sized.withColumns({"x": F.round("x", 10), "ret": F.round("ret", 10)})
    ranked = sized.withColumns({"rx": average_rank("x", keys), "rr": average_rank("ret", keys)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.corr("rx", "rr").alias("ic")).where(F.col("n") >= minimum)


def ic_table(ics: DataFrame) -> DataFrame:
    """factor, mean_ic, t_stat (null without spread), hit_rate, n, coverage."""
    sd = F.stddev_samp("ic")
    return ics.groupBy("factor").agg(
        F.avg("ic").alias("mean_ic"),
        F.when(sd > 0, F.avg("ic") / F.when(sd > 0, sd) * F.sqrt(F.count("ic"))).alias("t_stat"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"),
        F.count("ic").alias("n"),
        F.avg(F.col("n") / F.col("size")).alias("coverage"),
    )


def _verdict(t: Column, least: float) -> Column:
    return F.when(t >= least, "kept").when(t <= -least, "wrong sign").otherwise("noise")


def select_factors(table: DataFrame, least: float = 2.0) -> DataFrame:
    """factor, t_stat, verdict: kept, wrong sign or noise."""
    return table.select("factor", "t_stat", _verdict(F.col("t_stat"), least).alias("verdict"))


def fold_verdicts(ics: DataFrame, least: float = 2.0) -> DataFrame:
    """fold, factor, n, t_stat, verdict: each year of ``ics`` (factor, form_date, ic) is a fold, judged by the formations before it alone."""
    folds = ics.select(F.year("form_date").alias("fold")).distinct()
    past = ics.withColumn("year", F.year("form_date")).join(F.broadcast(folds), F.col("year") < F.col("fold"))
    sd = F.stddev_samp("ic")
    t = F.when(sd > 0, F.avg("ic") / F.when(sd > 0, sd) * F.sqrt(F.count("ic")))
    table = past.groupBy("fold", "factor").agg(F.count("ic").alias("n"), t.alias("t_stat"))
    return table.withColumn("verdict", _verdict(F.col("t_stat"), least))


def out_of_sample(z: DataFrame, verdicts: DataFrame) -> DataFrame:
    """fold, form_date, isin, composite: the mean z of the factors that a formation's fold kept, if half of them are there.

    ``z``: form_date, isin, factor, z. The choice stays in the plan: kept factors are a join on (fold, factor).
    """
    kept = verdicts.where("verdict = 'kept'").select("fold", "factor", F.count(F.lit(1)).over(Window.partitionBy("fold")).alias("k"))
    rows = z.where("z is not null").withColumn("fold", F.year("form_date")).join(F.broadcast(kept), ["fold", "factor"])
    found = rows.groupBy("fold", "form_date", "isin").agg(F.avg("z").alias("composite"), (F.count("z") >= F.max("k") / 2).alias("_half"))
    return found.where("_half").drop("_half")


def equity(rows: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """Running equity, its peak and the drawdown; the starting capital is no peak."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", F.product(1 + F.col(ret)).over(w)).withColumn("peak", F.max("equity").over(w))
    return rows.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def cagr(ret: str, year: int = 12) -> Column:
    total = F.product(1 + F.col(ret))
    return F.when(total > 0, F.pow(F.when(total > 0, total), year / F.count(ret)) - 1)


def sharpe(ret: str, risk_free: float, year: int = 12) -> Column:
    sd = F.stddev_samp(ret)
    return F.when(sd >= 1e-12, (F.avg(ret) - ((1 + risk_free) ** (1 / year) - 1)) / F.when(sd >= 1e-12, sd) * sqrt(year))


def summary(rows: DataFrame, keys: list[str], order: str, ret: str, risk_free: float) -> DataFrame:
    """keys, n, cagr, vol, sharpe, max_drawdown, hit_rate, best, worst."""
    return equity(rows, keys, order, ret).groupBy(*keys).agg(
        F.count(ret).alias("n"), cagr(ret).alias("cagr"), (F.stddev_samp(ret) * sqrt(12)).alias("vol"), sharpe(ret, risk_free).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), F.max(ret).alias("best"), F.min(ret).alias("worst"),
    )


def align(daily: DataFrame, exits: DataFrame, keys: list[str]) -> DataFrame:
    """Returns of sessions compounded over (previous exit, exit]; the first exit gives no row."""
    spans = exits.select("exit").distinct().withColumn("after", F.lag("exit").over(Window.orderBy("exit"))).where("after is not null")
    rows = daily.join(F.broadcast(spans), (F.col("date") > F.col("after")) & (F.col("date") <= F.col("exit")))
    return rows.groupBy(*keys, "exit").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def forecast_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, rmse, mae, corr, bias of pred against actual over complete pairs."""
    e = F.col("pred") - F.col("actual")
    return rows.where("pred is not null and actual is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.corr("pred", "actual").alias("corr"), F.avg(e).alias("bias")
    )


def binomial_tail(wins: str, n: str) -> Column:
    """P(at least ``wins`` of ``n`` fair coins), summed over logarithms."""
    log_choose = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i <= k, F.ln((F.col(n) - k + i) / i)).otherwise(F.lit(0.0)))
    return F.aggregate(F.sequence(F.col(wins), F.col(n)), F.lit(0.0), lambda a, k: a + F.exp(log_choose(k) - F.col(n) * F.ln(F.lit(2.0))))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite cosine series."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos, sin = F.cos(theta), F.sin(theta)

    def series(first: Column, start: int) -> Column:
        """first + first * (start / (start + 1)) cos^2 + ... up to cos^(df - 2)."""
        steps = F.when(df >= start + 3, F.sequence(F.lit(start), df - 3, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps.cast("array<int>"), F.struct(first.alias("s"), first.alias("x")), lambda a, k: F.struct((a["s"] + a["x"] * k / (k + 1) * cos * cos).alias("s"), (a["x"] * k / (k + 1) * cos * cos).alias("x")), lambda a: a["s"])

    even = sin * series(F.lit(1.0), 1)
    odd = F.lit(2 / pi) * (theta + F.when(df > 1, sin * series(cos, 2)).otherwise(F.lit(0.0)))
    return 1 - F.when(df % 2 == 0, even).otherwise(odd)


def paired_t(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, t_stat, p of the mean of ``value`` against 0."""
    found = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    found = found.withColumn("t_stat", F.col("mean") / F.col("sd") * F.sqrt("n"))
    return found.select("n", "mean", "t_stat", t_two_sided(F.col("t_stat"), (F.col("n") - 1).cast("int")).alias("p"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, corr, p of Pearson's correlation."""
    found = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"))
    t = F.col("corr") * F.sqrt((F.col("n") - 2) / (1 - F.col("corr") * F.col("corr")))
    return found.select("n", "corr", t_two_sided(t, (F.col("n") - 2).cast("int")).alias("p"))
