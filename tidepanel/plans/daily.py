"""Queries over the daily panel with the thresholds that ``Config()`` has for daily data: universe, factors, ledger and GARCH."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.config import Config
from tidepanel.functions.tables import once
from tidepanel.operators import adjust, backtest, factors, models, portfolio, universe, volatility
from tidepanel.operators import calendar as cal_ops
from tidepanel.plans.registry import CTES, copied, cte, query, rounded
from tidepanel.plans.research import LEDGER, NAMES, R
from tidepanel.sources import adapters

CFG = Config()

_CHAIN = ["bars", "cal", "mends", "reb", "spans", "hand", "links", "linked", "factored", "adj", "step", "raw_ret", "ret", "stats", "uni", "fac", "flong", "qz", "clipped", "zlong", "comp", "fwd", "ranked", "chosen", "book", "books", "bookk", "turns", "led"]
_CHANGES = {
    "bars": [(adapters.BARS, adapters.DAILY)],
    "reb": [("s >= 60", "s >= 300")],
    "stats": [("form_s - 25", "form_s - 125"), (", 26)", ", 126)")],
    "uni": [(">= 0.6", ">= 0.9"), ("1e4", "1e7"), ("(SELECT u FROM cfg)", "500")],
    "fac": [("= 52", "= 252"), ("< 26", "< 126"), ("= 26", "= 126"), ("- 52 AND", "- 252 AND"), ("= 4 ", "= 21 ")],
    "zlong": [("(SELECT zmin FROM cfg)", "10")],
    "chosen": [("(SELECT h FROM cfg)", "30")],
    "books": [(CTES["books"], "SELECT 'equal' AS variant, period, isin, weight, ret FROM book")],
}
copied("d", _CHAIN, _CHANGES)


@once
def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.prepared(adapters.daily(spark, sf_dir), CFG)


@once
def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_ops.rebalances(_panel(spark, sf_dir).select("date", "s").distinct(), CFG.warmup)


@once
def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.universe(universe.formation_stats(_panel(spark, sf_dir), _forms(spark, sf_dir), CFG.formation), CFG)


@once
def _zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.zscores(factors.price_factors(_panel(spark, sf_dir), _forms(spark, sf_dir), CFG, _members(spark, sf_dir)), factors.PRICE_SIGNS, CFG)


@query("SELECT form_date, isin, symbol, round(median_turnover, 4) AS median_turnover, rank FROM duni")
def daily_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_members(spark, sf_dir).drop("form_s"), 4)


@query(f"SELECT form_date, isin, {R(*NAMES)} FROM dfac")
def daily_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_zscores(spark, sf_dir).select("form_date", "isin", *NAMES))


@query("SELECT form_date, isin, round(call, 6) AS composite FROM dcomp")
def daily_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.composite(_zscores(spark, sf_dir), NAMES).select("form_date", "isin", "composite"))


@query(f"SELECT {LEDGER} FROM dled")
def daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factors.composite(_zscores(spark, sf_dir), NAMES).join(F.broadcast(_forms(spark, sf_dir).select("form_date", "period")), "form_date")
    books = portfolio.equal_weights(portfolio.top_n(rows, CFG.holdings, ["period"]), ["period"]).select("period", "isin", "weight")
    books = backtest.tradable(books, backtest.forward_returns(_panel(spark, sf_dir), _forms(spark, sf_dir)), []).withColumn("variant", F.lit("equal"))
    return rounded(backtest.ledger(books, _forms(spark, sf_dir), CFG.cost_bps, ["variant"]).drop("variant"), 10)


# --- GARCH beside the baselines ------------------------------------------------------------------

SEARCH = models.GarchSearch()


def _pass(k: int, before: str) -> str:
    """The best point of the k-th grid around that of ``before``, by a fold over each series."""
    (a0, a1), (p0, p1), (wa, wp) = SEARCH.alpha, SEARCH.persistence, (w * SEARCH.shrink**k for w in SEARCH.width)
    steps = ", ".join(f"({s})" for s in SEARCH.steps)
    return f"""SELECT isin, date, arg_min({{'a': a, 'p': p, 'h': f.h, 'l': f.l, 'gain': was - f.l}}, f.l) AS best FROM (SELECT *, list_reduce(xs, lambda s, e: {{'h': (1 - p) * v + a * e.x + (p - a) * s.h, 'l': s.l + ln(s.h) + e.x / s.h, 'x': CAST(0 AS DOUBLE)}}, {{'h': v, 'l': CAST(0 AS DOUBLE), 'x': CAST(0 AS DOUBLE)}}) AS f FROM
        (SELECT b.isin, b.date, g.v, g.xs, b.best.l AS was, least(greatest(least(b.best.a + i * {wa!r}, {a1}), {a0}), greatest(least(b.best.p + j * {wp!r}, {p1}), {p0})) AS a, greatest(least(b.best.p + j * {wp!r}, {p1}), {p0}) AS p
         FROM {before} b JOIN gseries g ON g.isin = b.isin AND g.date = b.date, (VALUES {steps}) x(i), (VALUES {steps}) y(j))) GROUP BY 1, 2"""


_W = "PARTITION BY isin ORDER BY s"
cte(
    dvol=f"""SELECT date, s, isin, ret, CASE WHEN COUNT(ret) OVER w21 >= 10 THEN stddev_samp(ret) OVER w21 * sqrt(252) END AS rv_2, CASE WHEN COUNT(ret) OVER wall >= 20 THEN sqrt(SUM(ret * ret * power(0.94, -(age % 2000))) OVER wall / SUM(CASE WHEN ret IS NOT NULL THEN power(0.94, -(age % 2000)) END) OVER wall * 252) END AS ewma,
        CASE WHEN COUNT(ret) OVER f21 >= 10 THEN stddev_samp(ret) OVER f21 * sqrt(252) END AS forward_vol FROM (SELECT *, s - MIN(s) OVER (PARTITION BY isin) AS age FROM dret)
        WINDOW w21 AS ({_W} RANGE BETWEEN 20 PRECEDING AND CURRENT ROW), wall AS (PARTITION BY isin, age // 2000 ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f21 AS ({_W} RANGE BETWEEN 1 FOLLOWING AND 21 FOLLOWING)""",
    dset_="SELECT * FROM dvol WHERE rv_2 IS NOT NULL AND forward_vol > 1e-6 AND s % 2000 > 400",
    gdates="SELECT date, s FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date, s FROM dset_ WHERE s >= 1300)) WHERE i % 42 = 0",
    gret="SELECT isin, s, ret FROM dret WHERE ret IS NOT NULL",
    gmean="SELECT r.isin, d.date, d.s, COUNT(*) AS n, AVG(ret) AS m, var_pop(ret) AS v FROM gret r JOIN gdates d ON r.s <= d.s GROUP BY 1, 2, 3 HAVING COUNT(*) >= 500",
    gseries="SELECT g.isin, g.date, n, v, list({'h': CAST(0 AS DOUBLE), 'l': CAST(0 AS DOUBLE), 'x': power(ret - m, 2)} ORDER BY r.s) AS xs FROM gmean g JOIN gret r ON r.isin = g.isin AND r.s <= g.s WHERE v > 0 GROUP BY 1, 2, 3, 4",
    gpass0=f"SELECT isin, date, {{'a': {SEARCH.centre[0]}, 'p': {SEARCH.centre[1]}, 'l': CAST('inf' AS DOUBLE)}} AS best FROM gseries",
    **{f"gpass{k + 1}": _pass(k, f"gpass{k}") for k in range(SEARCH.passes)},
    gfit=f"""SELECT g.isin, g.date, g.n, best.a AS alpha, best.p - best.a AS beta, best.gain <= {SEARCH.tolerance} AND best.a > {SEARCH.alpha[0]} AND best.a < least({SEARCH.alpha[1]}, best.p) AND best.p > {SEARCH.persistence[0]} AND best.p < {SEARCH.persistence[1]} AS converged,
        sqrt(v + (best.h - v) * (1 - power(best.p, 21)) / (21 * (1 - best.p))) * sqrt(252) AS forecast FROM gpass{SEARCH.passes} b JOIN gseries g ON g.isin = b.isin AND g.date = b.date""",
    gfc="""SELECT m.model, m.pred, forward_vol AS actual FROM gfit g JOIN dset_ d ON d.isin = g.isin AND d.date = g.date, LATERAL (VALUES ('garch', g.forecast), ('ewma', d.ewma), ('persistence', d.rv_2)) m(model, pred) WHERE g.converged""",
)


@once
def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.features(_panel(spark, sf_dir), CFG)


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a past and a future; the first sessions of a block of weights are left to the operator's own test."""
    return _features(spark, sf_dir).where(F.col("rv_2").isNotNull() & (F.col("forward_vol") > 1e-6) & (F.col("s") % volatility.EWMA_BLOCK > 400))


@once
def _garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of all nations on every 42nd session of the panel's second half."""
    dates = volatility.grid(_usable(spark, sf_dir).where("s >= 1300").select("date", "s").distinct(), 42)
    return models.garch(volatility.returns(_panel(spark, sf_dir)), dates, CFG.horizon, CFG.year, 500, SEARCH)


@query("SELECT isin, date, n, round(alpha, 9) AS alpha, round(beta, 9) AS beta, converged, round(forecast, 9) AS forecast FROM gfit")
def garch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GARCH(1,1) of every instrument and evaluation date with 500 returns at least."""
    return rounded(_garch(spark, sf_dir), 9)


@query("SELECT model, COUNT(*) AS n, round(sqrt(AVG(power(pred - actual, 2))), 6) AS rmse, round(AVG(abs(pred - actual)), 6) AS mae, round(corr(pred, actual), 6) AS corr, round(AVG(pred - actual), 6) AS bias FROM gfc GROUP BY 1")
def garch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods scored on the rows where the fit converged."""
    rows = _garch(spark, sf_dir).where("converged").select("isin", "date", F.col("forecast").alias("garch"))
    rows = rows.join(_usable(spark, sf_dir).select("isin", "date", "ewma", F.col("rv_2").alias("persistence"), F.col("forward_vol").alias("actual")), ["isin", "date"])
    return rounded(models.scored(rows, ["garch", "ewma", "persistence"]))
