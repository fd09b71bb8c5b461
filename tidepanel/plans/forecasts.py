"""Queries over volatility features, forecasts and their significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.tables import once
from tidepanel.operators import boosting, metrics, models, volatility
from tidepanel.operators.boosting import Settings
from tidepanel.plans.registry import config, cte, panel, query, rounded

cte(
    vraw="""SELECT *, s - MIN(s) OVER (PARTITION BY isin) AS age, CASE WHEN high > 0 AND low > 0 AND high >= low THEN power(ln(high / low), 2) / (4 * ln(2)) END AS rng FROM ret""",
    vol="""SELECT date, s, isin, symbol, ret, adj_close, turnover,
        CASE WHEN COUNT(ret) OVER w4 >= 3 THEN stddev_samp(ret) OVER w4 * sqrt(252) END AS rv_1, CASE WHEN COUNT(ret) OVER w13 >= 6 THEN stddev_samp(ret) OVER w13 * sqrt(252) END AS rv_2,
        CASE WHEN COUNT(ret) OVER w26 >= 13 THEN stddev_samp(ret) OVER w26 * sqrt(252) END AS rv_3, CASE WHEN COUNT(ret) OVER w52 >= 26 THEN stddev_samp(ret) OVER w52 * sqrt(252) END AS rv_4,
        CASE WHEN COUNT(ret) OVER wall >= 13 THEN sqrt(SUM(ret * ret * power(0.94, -age)) OVER wall / SUM(CASE WHEN ret IS NOT NULL THEN power(0.94, -age) END) OVER wall * 252) END AS ewma,
        CASE WHEN COUNT(rng) OVER w13 >= 6 THEN sqrt(AVG(rng) OVER w13 * 252) END AS parkinson,
        adj_close / NULLIF(MAX(adj_close) OVER p13, 0) - 1 AS ret_long, adj_close / NULLIF(MAX(adj_close) OVER p4, 0) - 1 AS ret_short,
        CASE WHEN COUNT(turnover) OVER w4 >= 2 THEN AVG(turnover) OVER w4 END / CASE WHEN COUNT(turnover) OVER w26 >= 13 THEN AVG(turnover) OVER w26 END AS turnover_ratio,
        CASE WHEN COUNT(ret) OVER f4 >= 2 THEN stddev_samp(ret) OVER f4 * sqrt(252) END AS forward_vol FROM vraw
        WINDOW w4 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), w13 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 12 PRECEDING AND CURRENT ROW),
        w26 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 25 PRECEDING AND CURRENT ROW), w52 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 51 PRECEDING AND CURRENT ROW),
        wall AS (PARTITION BY isin ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p13 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 13 PRECEDING AND 13 PRECEDING),
        p4 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING), f4 AS (PARTITION BY isin ORDER BY s RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""",
    feat="SELECT v.*, m.market_rv, rv_1 / NULLIF(rv_3, 0) AS ratio_1_3, rv_2 / NULLIF(rv_4, 0) AS ratio_2_4, rv_2 / NULLIF(m.market_rv, 0) AS vs_market FROM vol v JOIN (SELECT date, MEDIAN(rv_2) AS market_rv FROM vol GROUP BY 1) m ON m.date = v.date",
    dset="SELECT *, ewma AS anchor, ln(forward_vol / ewma) AS target_log_ratio FROM feat WHERE ewma > 1e-6 AND forward_vol > 1e-6",
    ddates="SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM dset)",
    bounds="SELECT MAX(CASE WHEN i = floor(n * 0.7) THEN date END) AS t1, MAX(CASE WHEN i = floor(n * 0.85) THEN date END) AS t2 FROM ddates",
    parts="SELECT * FROM (SELECT d.*, CASE WHEN date <= t1 - 44 THEN 'train' WHEN date > t1 AND date <= t2 - 44 THEN 'valid' WHEN date > t2 THEN 'test' END AS part FROM dset d, bounds) WHERE part IS NOT NULL",
    tgrid="SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM parts WHERE part = 'test')) WHERE i % 4 = 0",
    evald="SELECT p.* FROM parts p JOIN tgrid USING (date) WHERE part = 'test'",
    fc="""SELECT date, isin, 'persistence' AS model, rv_2 AS pred, forward_vol AS actual, anchor FROM evald UNION ALL SELECT date, isin, 'ewma', anchor, forward_vol, anchor FROM evald
        UNION ALL SELECT date, isin, 'blend', (rv_2 + rv_4 + anchor) / 3, forward_vol, anchor FROM evald""",
    perdate="""SELECT date, COUNT(*) AS n, sqrt(AVG(power((rv_2 + rv_4 + anchor) / 3 - forward_vol, 2))) AS rmse_a, sqrt(AVG(power(anchor - forward_vol, 2))) AS rmse_b, MEDIAN(forward_vol) AS realised, MEDIAN(rv_2) AS prior FROM evald
        WHERE rv_2 IS NOT NULL AND rv_4 IS NOT NULL GROUP BY 1""",
    pdate="SELECT *, 100 * (1 - rmse_a / rmse_b) AS improvement, realised / prior - 1 AS vol_change FROM perdate",
)


@once
def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.windowed(panel(spark, sf_dir), config(spark, sf_dir))


@once
def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.market(_windowed(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.against(_windowed(spark, sf_dir), _market(spark, sf_dir))


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.usable(_features(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = config(spark, sf_dir)
    return volatility.split(_dataset(spark, sf_dir), int(cfg.horizon * 7 * 1.6))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.grid(_parts(spark, sf_dir).where("part = 'test'"), config(spark, sf_dir).horizon)


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir)
    blend = (F.col("rv_2") + F.col("rv_4") + F.col("anchor")) / 3
    models_ = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), c.alias("pred")) for n, c in (("persistence", F.col("rv_2")), ("ewma", F.col("anchor")), ("blend", blend)))))
    return rows.select("date", "isin", F.col("forward_vol").alias("actual"), "anchor", models_.alias("m")).select("date", "isin", "actual", "anchor", "m.model", "m.pred")


def _per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    blend = (F.col("rv_2") + F.col("rv_4") + F.col("anchor")) / 3
    return models.per_date(_evaluated(spark, sf_dir).select("date", blend.alias("a"), F.col("anchor").alias("b"), F.col("forward_vol").alias("actual"), F.col("rv_2").alias("before")))


R = lambda *cols, digits=6: ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query(f"SELECT date, isin, {R('rv_1', 'rv_2', 'rv_3', 'rv_4')} FROM vol")
def rolling_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("date", "isin", "rv_1", "rv_2", "rv_3", "rv_4"))


@query(f"SELECT date, isin, {R('ewma')} FROM vol")
def ewma_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("date", "isin", "ewma"))


@query(f"SELECT date, isin, {R('parkinson')} FROM vol")
def parkinson_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("date", "isin", "parkinson"))


@query(f"SELECT date, isin, {R('forward_vol')} FROM vol")
def forward_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("date", "isin", "forward_vol"))


@query(f"SELECT date, isin, {R('ret_long', 'ret_short', 'turnover_ratio')} FROM vol")
def trailing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over n sessions and the turnover ratio."""
    return rounded(_features(spark, sf_dir).select("date", "isin", "ret_long", "ret_short", "turnover_ratio"))


@query("SELECT DISTINCT date, round(market_rv, 6) AS market_rv FROM feat")
def market_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("date", "market_rv").distinct())


@query(f"SELECT date, isin, {R('ratio_1_3', 'ratio_2_4', 'vs_market')} FROM feat")
def vol_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("date", "isin", "ratio_1_3", "ratio_2_4", "vs_market"))


@query(f"SELECT date, isin, {R(*volatility.FEATURES, 'forward_vol', 'target_log_ratio', digits=5)} FROM dset")
def vol_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_dataset(spark, sf_dir).select("date", "isin", *volatility.FEATURES, "forward_vol", "target_log_ratio"), 5)


@query("SELECT part, COUNT(*) AS n, COUNT(DISTINCT date) AS dates, MIN(date) AS first, MAX(date) AS last FROM parts GROUP BY 1")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("SELECT date FROM tgrid")
def nonoverlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("date").distinct()


@query("SELECT date, isin, model, round(pred, 6) AS pred, round(actual, 6) AS actual FROM fc")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_forecasts(spark, sf_dir).select("date", "isin", "model", "pred", "actual"))


@query("SELECT date, isin, round(anchor * exp(ln(pred / anchor)), 6) AS level, round(pred / anchor - 1, 6) AS change FROM fc WHERE model = 'blend' AND pred IS NOT NULL")
def forecast_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and change of a forecast given as a log ratio to the anchor."""
    rows = _forecasts(spark, sf_dir).where("model = 'blend' and pred is not null").withColumn("log_ratio", F.ln(F.col("pred") / F.col("anchor")))
    return rounded(models.level(rows).select("date", "isin", "level", "change"))


@query("""SELECT model, COUNT(*) AS n, round(sqrt(AVG(power(pred - actual, 2))), 6) AS rmse, round(AVG(abs(pred - actual)), 6) AS mae, round(corr(pred, actual), 6) AS corr, round(AVG(pred - actual), 6) AS bias FROM fc WHERE pred IS NOT NULL GROUP BY 1""")
def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.forecast_scores(_forecasts(spark, sf_dir), ["model"]))


@query("""SELECT round(1 - b.rmse / p.rmse, 6) AS over_persistence, round(1 - b.rmse / e.rmse, 6) AS over_ewma FROM (SELECT sqrt(AVG(power(pred - actual, 2))) AS rmse FROM fc WHERE model = 'blend') b,
    (SELECT sqrt(AVG(power(pred - actual, 2))) AS rmse FROM fc WHERE model = 'persistence') p, (SELECT sqrt(AVG(power(pred - actual, 2))) AS rmse FROM fc WHERE model = 'ewma') e""")
def relative_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.forecast_scores(_forecasts(spark, sf_dir), ["model"])
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    return rounded(scores.agg((1 - of("blend") / of("persistence")).alias("over_persistence"), (1 - of("blend") / of("ewma")).alias("over_ewma")))


@query(f"SELECT date, n, {R('rmse_a', 'rmse_b', 'realised', 'prior', 'improvement', 'vol_change')} FROM pdate")
def per_date_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_per_date(spark, sf_dir))


@query("""SELECT wins, n, round(list_sum(list_transform(range(wins, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 8) AS p FROM (SELECT COUNT(*) FILTER (improvement > 0) AS wins, COUNT(*) AS n FROM pdate)""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which the first forecast was better, and the chance of as many by coin."""
    found = _per_date(spark, sf_dir).agg(F.count_if(F.col("improvement") > 0).alias("wins"), F.count(F.lit(1)).alias("n"))
    return rounded(found.withColumn("p", metrics.binomial_tail("wins", "n")), 8)


@query("SELECT COUNT(*) AS n, round(AVG(d), 6) AS mean, round(AVG(d) / stddev_samp(d) * sqrt(COUNT(*)), 6) AS t_stat FROM (SELECT rmse_a - rmse_b AS d FROM pdate)")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.paired_t(_per_date(spark, sf_dir).withColumn("d", F.col("rmse_a") - F.col("rmse_b")), "d").drop("p"))


def _two_sided(t: str, df: str) -> str:
    """Student's two-sided probability in SQL: Simpson's rule over the density."""
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * power(1 + power(abs({t}) * k / 2000.0, 2) / {df}, -({df} + 1) / 2.0)"
    return f"1 - 2 * abs({t}) / 6000.0 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density}))"


@query(f"SELECT n, round(mean, 8) AS mean, round(t, 8) AS t_stat, round({_two_sided('t', '(n - 1)')}, 8) AS p FROM (SELECT COUNT(*) AS n, AVG(d) AS mean, AVG(d) / stddev_samp(d) * sqrt(COUNT(*)) AS t FROM (SELECT rmse_a - rmse_b AS d FROM pdate))")
def paired_t_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with its two-sided probability."""
    return rounded(metrics.paired_t(_per_date(spark, sf_dir).withColumn("d", F.col("rmse_a") - F.col("rmse_b")), "d"), 8)


@query(f"SELECT n, round(r, 8) AS corr, round({_two_sided('t', '(n - 2)')}, 8) AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT COUNT(*) AS n, corr(vol_change, improvement) AS r FROM pdate))")
def regime_corr_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime's correlation with its two-sided probability."""
    return rounded(metrics.correlation(_per_date(spark, sf_dir), "vol_change", "improvement"), 8)


@query("SELECT COUNT(*) AS n, round(corr(vol_change, improvement), 6) AS corr FROM pdate")
def regime_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.correlation(_per_date(spark, sf_dir), "vol_change", "improvement").drop("p"))


@query("SELECT round(AVG(improvement) FILTER (vol_change > 0), 6) AS rose, COUNT(*) FILTER (vol_change > 0) AS n_rose, round(AVG(improvement) FILTER (vol_change <= 0), 6) AS fell, COUNT(*) FILTER (vol_change <= 0) AS n_fell FROM pdate")
def regime_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.col("vol_change") > 0
    return rounded(_per_date(spark, sf_dir).agg(F.avg(F.when(up, F.col("improvement"))).alias("rose"), F.count_if(up).alias("n_rose"), F.avg(F.when(~up, F.col("improvement"))).alias("fell"), F.count_if(~up).alias("n_fell")))


@query("""SELECT isin, round(pred, 6) AS forecast, r AS place FROM (SELECT isin, pred, ROW_NUMBER() OVER (ORDER BY pred, isin) AS r, COUNT(*) OVER () AS n FROM fc WHERE model = 'blend' AND pred IS NOT NULL AND date = (SELECT MAX(date) FROM fc))
    WHERE (r - 1) % greatest(1, n // 20) = 0 ORDER BY r LIMIT 12""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every so-manieth name by forecast on the newest date (a report of twelve)."""
    return rounded(models.systematic(_newest(spark, sf_dir), "pred", 20, 12).select("isin", F.col("pred").alias("forecast"), "place"))


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date").where("model = 'blend' and pred is not null")


@query("SELECT isin, round(100 * w, 6) AS inverse, round(100.0 / n, 6) AS equal, round(100 * w - 100.0 / n, 6) AS difference FROM (SELECT isin, (1 / pred) / SUM(1 / pred) OVER () AS w, COUNT(*) OVER () AS n FROM fc WHERE model = 'blend' AND pred IS NOT NULL AND date = (SELECT MAX(date) FROM fc))")
def sizing_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-forecast against equal sizes of the newest date, in percent."""
    return rounded(models.sizing(_newest(spark, sf_dir), "pred"))


@query("SELECT isin FROM (SELECT DISTINCT isin FROM adj) ORDER BY md5(isin || ':7'), isin LIMIT 25")
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed draw of 25 instruments by hash (a sampling operator)."""
    return models.subsample(panel(spark, sf_dir).select("isin").distinct(), 25, 7)


#: Boosting as by default (600 rounds, depth 6, 31 leaves of 200 rows, L2 of 1); the search ends 50 rounds after the least validation error.
SETTINGS = Settings(patience=50)


@once
def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final model's trees, and the validation curve under the tree numbers from -2 downwards."""
    probe, final = models.fitted(_parts(spark, sf_dir), volatility.FEATURES, SETTINGS)
    curve = spark.createDataFrame([(-2 - k, 0, e) for k, e in enumerate(probe.errors)], "tree int, node int, value double")
    return boosting.to_rows(spark, final).unionByName(curve, allowMissingColumns=True)


def _model(spark: SparkSession, sf_dir: str) -> boosting.Model:
    return boosting.from_rows(_model_rows(spark, sf_dir).where("tree > -2"), volatility.FEATURES, SETTINGS)


@query()
def gbt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation error after each round, and whether it is the number of rounds that was taken."""
    curve = _model_rows(spark, sf_dir).where("tree < -1").select((-1 - F.col("tree")).alias("round"), F.sqrt("value").alias("rmse"))
    least = curve.agg(F.min_by("round", F.struct("rmse", "round")).alias("best"))
    return rounded(curve.join(F.broadcast(least)).select("round", "rmse", (F.col("round") == F.col("best")).alias("taken")))


@query()
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the log ratio: rounds by validation error, refit on train and valid, scored beside the baselines."""
    rows = models.boosted(_parts(spark, sf_dir), config(spark, sf_dir).horizon, _model(spark, sf_dir))
    return rounded(models.scored(rows, ["trees", "ewma", "persistence"]))


@query()
def gbt_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees against the anchor on each test date, and what came after what was before."""
    rows = models.boosted(_parts(spark, sf_dir), config(spark, sf_dir).horizon, _model(spark, sf_dir))
    return rounded(models.per_date(rows.select("date", F.col("trees").alias("a"), F.col("ewma").alias("b"), "actual", F.col("ewma").alias("before"))))


@query()
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of R2 when one feature is permuted over all rows of the test grid, for every feature."""
    return rounded(models.importance(_parts(spark, sf_dir), config(spark, sf_dir).horizon, _model(spark, sf_dir)))


@query("SELECT t.trained, t.today, date_diff('day', t.trained, t.today) AS age_days, t.trained IS NULL OR date_diff('day', t.trained, t.today) > 30 AS retrain FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS trained, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 AS INT) AS DATE) AS today FROM orders) t")
def model_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether models of many ages are due; some are absent."""
    when, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(key % 5 > 0, when).alias("trained"), F.date_add(when, (key % 61).cast("int")).alias("today"))
    return rounded(models.age(rows, 30))


@query("SELECT MAX(date) AS trained, MAX(date) + 12 AS today, 12 AS age_days, false AS retrain FROM bars")
def model_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of a model trained on the newest session, twelve days later."""
    meta = panel(spark, sf_dir).agg(F.max("date").alias("trained"))
    return rounded(models.age(meta.withColumn("today", F.date_add("trained", 12)), 30))

