"""Queries over factors, information coefficients, books and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import once, shared_dir
from tidepanel.operators import backtest, factors, metrics, portfolio
from tidepanel.plans.panel import forms, members
from tidepanel.plans.registry import config, cte, panel, query, rounded
from tidepanel.sources import adapters, layouts

NAMES = list(factors.PRICE_SIGNS)

cte(
    fac="""SELECT u.form_date, u.isin, MAX(CASE WHEN u.form_s - a.s = 4 THEN adj_close END) / NULLIF(MAX(CASE WHEN u.form_s - a.s = 52 THEN adj_close END), 0) - 1 AS mom_long,
        MAX(CASE WHEN u.form_s - a.s = 4 THEN adj_close END) / NULLIF(MAX(CASE WHEN u.form_s - a.s = 26 THEN adj_close END), 0) - 1 AS mom_short,
        stddev_samp(CASE WHEN u.form_s - a.s < 26 THEN r0 END) * sqrt(252.0) AS vol,
        MAX(CASE WHEN u.form_s - a.s = 0 THEN adj_close END) / NULLIF(MAX(CASE WHEN u.form_s - a.s = 4 THEN adj_close END), 0) - 1 AS reversal,
        AVG(CASE WHEN u.form_s - a.s < 26 THEN abs(r0) / NULLIF(turnover, 0) END) * 1e6 AS illiq
        FROM uni u LEFT JOIN raw_ret a ON a.isin = u.isin AND a.s BETWEEN u.form_s - 52 AND u.form_s GROUP BY 1, 2""",
    flong="\nUNION ALL ".join(f"SELECT form_date, isin, '{f}' AS factor, {f} AS x, {s} AS sign FROM fac" for f, s in factors.PRICE_SIGNS.items()),
    qz="SELECT factor, form_date, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM flong GROUP BY 1, 2",
    clipped="SELECT f.*, CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END AS c FROM flong f JOIN qz USING (factor, form_date)",
    zlong="""SELECT c.factor, c.form_date, c.isin, c.x, CASE WHEN n >= (SELECT zmin FROM cfg) AND c.c IS NOT NULL THEN CASE WHEN sd > 0 THEN (c.c - m) / sd ELSE 0 END * sign END AS z
        FROM clipped c JOIN (SELECT factor, form_date, COUNT(c) AS n, AVG(c) AS m, stddev_samp(c) AS sd FROM clipped GROUP BY 1, 2) USING (factor, form_date)""",
    comp="SELECT form_date, isin, CASE WHEN COUNT(z) = 5 THEN SUM(z) / 5 END AS call, CASE WHEN COUNT(z) >= 2.5 THEN AVG(z) END AS chalf FROM zlong GROUP BY 1, 2",
    fwd="""SELECT form_date, period, isin, last / start - 1 AS ret FROM (SELECT r.form_date, r.period, a.isin, MAX(CASE WHEN a.s = r.entry_s THEN adj_close END) AS start, arg_max(adj_close, a.s) AS last
        FROM reb r JOIN adj a ON a.s BETWEEN r.entry_s AND r.exit_s GROUP BY 1, 2, 3) WHERE start IS NOT NULL""",
    ranked="SELECT c.form_date, r.period, c.isin, call AS score, ROW_NUMBER() OVER (PARTITION BY c.form_date ORDER BY call DESC, c.isin) AS rank FROM comp c JOIN reb r ON r.form_date = c.form_date WHERE call IS NOT NULL",
    chosen="SELECT ranked.*, fac.vol FROM ranked JOIN fac USING (form_date, isin) WHERE rank <= (SELECT h FROM cfg)",
    book="SELECT c.period, c.isin, 1.0 / COUNT(*) OVER (PARTITION BY c.period) AS weight, ret FROM chosen c JOIN fwd f ON f.period = c.period AND f.isin = c.isin",
    eqbook="SELECT u.period, u.isin, 1.0 / COUNT(*) OVER (PARTITION BY u.period) AS weight, ret FROM (SELECT uni.*, reb.period FROM uni JOIN reb USING (form_date)) u JOIN fwd f ON f.period = u.period AND f.isin = u.isin",
    invbook="""SELECT period, isin, CASE WHEN k IS NULL OR i <= k THEN cap ELSE w * (1 - k * cap) / restk END AS weight FROM (SELECT *, MAX(CASE WHEN i = k + 1 THEN rest END) OVER (PARTITION BY period) AS restk FROM
        (SELECT *, MIN(CASE WHEN w * (1 - (i - 1) * cap) <= cap * rest * (1 + 1e-12) THEN i - 1 END) OVER (PARTITION BY period) AS k FROM
        (SELECT *, greatest(0.10, 1.0 / COUNT(*) OVER (PARTITION BY period)) AS cap, ROW_NUMBER() OVER (PARTITION BY period ORDER BY w DESC, isin) AS i, SUM(w) OVER (PARTITION BY period ORDER BY w DESC, isin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM
        (SELECT period, isin, inv / SUM(inv) OVER (PARTITION BY period) AS w FROM (SELECT period, isin, 1 / greatest(COALESCE(vol, MEDIAN(vol) OVER (PARTITION BY period), 1.0), 0.10) AS inv FROM chosen)))))""",
    sector="SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_nationkey % 6 < 5 THEN 'sector' || (s_nationkey % 6) END AS sector FROM supplier",
    labelled="""SELECT b.period, b.isin, b.weight, u.symbol, COALESCE(s.sector, 'unclassified:' || b.isin) AS sector FROM invbook b JOIN reb r ON r.period = b.period
        JOIN uni u ON u.form_date = r.form_date AND u.isin = b.isin LEFT JOIN sector s ON s.symbol = u.symbol""",
    grp="SELECT period, sector, SUM(weight) AS w FROM labelled GROUP BY 1, 2",
    grpcap="""SELECT period, sector, CASE WHEN k IS NULL OR i <= k THEN cap ELSE w * (1 - k * cap) / restk END / w AS scale FROM (SELECT *, MAX(CASE WHEN i = k + 1 THEN rest END) OVER (PARTITION BY period) AS restk FROM
        (SELECT *, MIN(CASE WHEN w * (1 - (i - 1) * cap) <= cap * rest * (1 + 1e-12) THEN i - 1 END) OVER (PARTITION BY period) AS k FROM
        (SELECT *, greatest(0.25, 1.0 / COUNT(*) OVER (PARTITION BY period)) AS cap, ROW_NUMBER() OVER (PARTITION BY period ORDER BY w DESC, sector) AS i, SUM(w) OVER (PARTITION BY period ORDER BY w DESC, sector ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM grp)))""",
    groupbook="SELECT l.period, l.isin, l.symbol, l.sector, l.weight * scale AS weight FROM labelled l JOIN grpcap g ON g.period = l.period AND g.sector = l.sector",
    books="""SELECT 'equal' AS variant, period, isin, weight, ret FROM book UNION ALL SELECT 'universe', period, isin, weight, ret FROM eqbook
        UNION ALL SELECT 'inverse', b.period, b.isin, b.weight / SUM(b.weight) OVER (PARTITION BY b.period), f.ret FROM invbook b JOIN fwd f ON f.period = b.period AND f.isin = b.isin""",
    bookk="SELECT b.*, k FROM books b JOIN (SELECT variant, period, ROW_NUMBER() OVER (PARTITION BY variant ORDER BY period) AS k FROM (SELECT DISTINCT variant, period FROM books)) d ON d.variant = b.variant AND d.period = b.period",
    turns="""SELECT variant, k, SUM(abs(COALESCE(w, 0) - COALESCE(o, 0))) / 2 AS turnover FROM (SELECT COALESCE(a.variant, b.variant) AS variant, COALESCE(a.k, b.k + 1) AS k, a.weight AS w, b.weight AS o
        FROM bookk a FULL JOIN bookk b ON a.variant = b.variant AND a.k = b.k + 1 AND a.isin = b.isin) WHERE k <= (SELECT MAX(k) FROM bookk m WHERE m.variant = variant) GROUP BY 1, 2""",
    led="""SELECT variant, form_date, entry, exit, n_holdings, gross_return, turnover, cost, net_return, product(1 + gross_return) OVER w AS gross_equity, product(1 + net_return) OVER w AS net_equity FROM
        (SELECT *, gross_return - cost AS net_return FROM (SELECT g.variant, r.form_date, r.entry, r.exit, n_holdings, gross_return, turnover, turnover * 2 * 35.0 / 1e4 AS cost FROM
        (SELECT variant, period, k, COUNT(*) AS n_holdings, SUM(weight * ret) AS gross_return FROM bookk GROUP BY 1, 2, 3) g JOIN turns t ON t.variant = g.variant AND t.k = g.k JOIN reb r ON r.period = g.period))
        WINDOW w AS (PARTITION BY variant ORDER BY form_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    icpair="SELECT z.factor, z.form_date, z.isin, round(z.z, 10) AS x, round(f.ret, 10) AS ret, COUNT(*) OVER (PARTITION BY z.factor, z.form_date) AS size FROM (SELECT factor, form_date, isin, z FROM zlong UNION ALL SELECT 'composite', form_date, isin, call FROM comp) z LEFT JOIN fwd f ON f.form_date = z.form_date AND f.isin = z.isin",
    icr="""SELECT *, RANK() OVER (PARTITION BY factor, form_date ORDER BY x) + (COUNT(*) OVER (PARTITION BY factor, form_date, x) - 1) / 2 AS rx, RANK() OVER (PARTITION BY factor, form_date ORDER BY ret) + (COUNT(*) OVER (PARTITION BY factor, form_date, ret) - 1) / 2 AS rr FROM icpair WHERE x IS NOT NULL AND ret IS NOT NULL""",
    ics="SELECT factor, form_date, COUNT(*) AS n, MAX(size) AS size, corr(rx, rr) AS ic FROM icr GROUP BY 1, 2 HAVING COUNT(*) >= 30",
    ict="SELECT factor, AVG(ic) AS mean_ic, AVG(ic) / NULLIF(stddev_samp(ic), 0) * sqrt(COUNT(ic)) AS t_stat, AVG(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, COUNT(ic) AS n, AVG(n / size) AS coverage FROM ics GROUP BY 1",
    idx=adapters.INDEX_LEVELS,
    idxret="SELECT date, index_name, close / LAG(close) OVER (PARTITION BY index_name ORDER BY date) - 1 AS price, div_yield FROM idx",
    tot="SELECT date, index_name, price, price + COALESCE(div_yield, 0) / 100 / 252 AS total FROM idxret WHERE price IS NOT NULL",
)


@once
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.price_factors(panel(spark, sf_dir), forms(spark, sf_dir), config(spark, sf_dir), members(spark, sf_dir))


@once
def _zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.zscores(_raw(spark, sf_dir), factors.PRICE_SIGNS, config(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, require_all: bool = True) -> DataFrame:
    return factors.composite(_zscores(spark, sf_dir), NAMES, require_all)


@once
def _fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.forward_returns(panel(spark, sf_dir), forms(spark, sf_dir))


@once
def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("form_date", "isin", "composite", "vol").join(F.broadcast(forms(spark, sf_dir).select("form_date", "period")), "form_date")
    return portfolio.top_n(rows, config(spark, sf_dir).holdings, ["form_date", "period"])


def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = config(spark, sf_dir)
    return portfolio.inverse_vol_weights(_chosen(spark, sf_dir), ["period"], "vol", cfg.max_weight, cfg.floor_vol)


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    label = F.when(F.col("s_nationkey") % 6 < 5, F.concat(F.lit("sector"), (F.col("s_nationkey") % 6).cast("string")))
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), label.alias("sector"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with symbol and sector; a name without one is its own group."""
    rows = _inverse(spark, sf_dir).join(members(spark, sf_dir).select("form_date", "isin", "symbol"), ["form_date", "isin"])
    rows = rows.join(_sectors(spark, sf_dir), "symbol", "left")
    return rows.withColumn("sector", F.coalesce("sector", F.concat(F.lit("unclassified:"), F.col("isin"))))


def _books(spark: SparkSession, sf_dir: str, variants: tuple[str, ...] = ("equal", "universe", "inverse")) -> DataFrame:
    """All variants under one key, run in one job."""
    fwd = _fwd(spark, sf_dir)
    made = None
    for variant in variants:
        if variant == "equal":
            w = portfolio.equal_weights(_chosen(spark, sf_dir), ["period"])
        elif variant == "universe":
            w = portfolio.equal_weights(members(spark, sf_dir).join(F.broadcast(forms(spark, sf_dir).select("form_date", "period")), "form_date"), ["period"])
        else:
            w = _inverse(spark, sf_dir)
        rows = backtest.tradable(w.select("period", "isin", "weight"), fwd, []).withColumn("variant", F.lit(variant))
        made = rows if made is None else made.unionByName(rows)
    return made


def _ledger(spark: SparkSession, sf_dir: str, variants: tuple[str, ...] = ("equal", "universe", "inverse")) -> DataFrame:
    return backtest.ledger(_books(spark, sf_dir, variants), forms(spark, sf_dir), config(spark, sf_dir).cost_bps, ["variant"])


R = lambda *cols, digits=6: ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
LEDGER = f"form_date, entry, exit, n_holdings, {R('gross_return', 'turnover', 'cost', 'net_return', 'gross_equity', 'net_equity', digits=10)}"


@query(f"SELECT form_date, isin, {R(*NAMES)} FROM fac")
def price_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_raw(spark, sf_dir))


@query(f"SELECT form_date, isin, {R('mom_long', 'mom_short')} FROM fac")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_raw(spark, sf_dir).select("form_date", "isin", "mom_long", "mom_short"))


@query("SELECT form_date, isin, " + ", ".join(f"round(MAX(CASE WHEN factor = '{f}' THEN z END), 6) AS z_{f}" for f in NAMES) + " FROM zlong GROUP BY 1, 2")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("form_date", "isin", *(f"z_{f}" for f in NAMES)))


@query("SELECT form_date, isin, round(call, 6) AS composite FROM comp")
def composite_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("form_date", "isin", "composite"))


@query("SELECT form_date, isin, round(chalf, 6) AS composite FROM comp")
def composite_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir, require_all=False).select("form_date", "isin", "composite"))


@query("SELECT factor, round(AVG(c), 6) AS mean, round(MIN(c), 6) AS low, round(MAX(c), 6) AS high FROM (SELECT factor, form_date, COUNT(x) / COUNT(*) AS c FROM flong GROUP BY 1, 2) GROUP BY 1")
def factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of members with a value, over formations."""
    rows = _raw(spark, sf_dir).unpivot(["form_date", "isin"], NAMES, "factor", "x")
    shares = rows.groupBy("factor", "form_date").agg((F.count("x") / F.count(F.lit(1))).alias("c"))
    return rounded(shares.groupBy("factor").agg(F.avg("c").alias("mean"), F.min("c").alias("low"), F.max("c").alias("high")))


@query("SELECT form_date, period, isin, round(ret, 6) AS ret FROM fwd")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fwd(spark, sf_dir))


def _ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("form_date", "isin", *(F.col(f"z_{f}").alias(f) for f in NAMES), "composite")
    rows = scored.unpivot(["form_date", "isin"], [*NAMES, "composite"], "factor", "x")
    return metrics.ic(rows.join(_fwd(spark, sf_dir).select("form_date", "isin", "ret"), ["form_date", "isin"], "left"))


@query("SELECT factor, form_date, n, size, round(ic, 6) AS ic FROM ics")
def ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ics(spark, sf_dir))


@query(f"SELECT factor, {R('mean_ic', 't_stat', 'hit_rate')}, n FROM ict")
def ic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ic_table(_ics(spark, sf_dir)).drop("coverage"))


@query(f"SELECT factor, {R('mean_ic', 't_stat', 'hit_rate')}, n, {R('coverage')} FROM ict")
def ic_table_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ic_table(_ics(spark, sf_dir)))


@query("SELECT factor, round(t_stat, 6) AS t_stat, CASE WHEN t_stat >= 2.0 THEN 'kept' WHEN t_stat <= -2.0 THEN 'wrong sign' ELSE 'noise' END AS verdict FROM ict")
def factor_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.select_factors(metrics.ic_table(_ics(spark, sf_dir))))


@query("SELECT form_date, isin, round(score, 6) AS composite, rank FROM chosen")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_chosen(spark, sf_dir).select("form_date", "isin", "composite", "rank"))


@query("""SELECT n.period, n.isin, n.rank, n.kept FROM (SELECT r.period, r.isin, r.rank, (b.isin IS NOT NULL AND r.rank <= CAST(FLOOR((SELECT h FROM cfg) * 1.5) AS BIGINT)) AS kept,
    ROW_NUMBER() OVER (PARTITION BY r.period ORDER BY (b.isin IS NOT NULL AND r.rank <= CAST(FLOOR((SELECT h FROM cfg) * 1.5) AS BIGINT)) DESC, r.rank) AS i FROM ranked r LEFT JOIN chosen b ON b.period = r.period - 1 AND b.isin = r.isin) n WHERE i <= (SELECT h FROM cfg)""")
def buffer_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One buffered step of every period from the strict book of the period before."""
    cfg = config(spark, sf_dir)
    rows = _scored(spark, sf_dir).select("form_date", "isin", "composite").join(F.broadcast(forms(spark, sf_dir).select("form_date", "period")), "form_date")
    ranked = portfolio.top_n(rows, 1 << 30, ["form_date", "period"])
    held = _chosen(spark, sf_dir).select((F.col("period") + 1).alias("period"), "isin")
    return portfolio.buffer_step(ranked, held, cfg.holdings, cfg.buffer, ["period"]).select("period", "isin", "rank", "kept")


@query("SELECT period, isin, round(weight, 6) AS weight FROM invbook")
def inverse_vol_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_inverse(spark, sf_dir).select("period", "isin", "weight"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.cap_by_group(_labelled(spark, sf_dir).select("period", "isin", "symbol", "sector", "weight"), ["period"], "sector", config(spark, sf_dir).max_group)


@query("SELECT period, isin, sector, round(weight, 6) AS weight FROM groupbook")
def group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grouped(spark, sf_dir).select("period", "isin", "sector", "weight"))


@query("SELECT isin, symbol, sector, round(weight, 6) AS weight FROM groupbook WHERE period = (SELECT MAX(period) FROM groupbook)")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest capped book with what a reader wants to see."""
    rows = _grouped(spark, sf_dir)
    return rounded(rows.join(F.broadcast(forms(spark, sf_dir).agg(F.max("period").alias("period"))), "period").select("isin", "symbol", "sector", "weight"))


@query("SELECT period, isin, round(weight, 6) AS weight FROM groupbook")
def build_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection, sizing and group caps in one."""
    return rounded(_grouped(spark, sf_dir).select("period", "isin", "weight"))


@query("SELECT sector, round(SUM(weight), 6) AS weight FROM groupbook WHERE period = (SELECT MAX(period) FROM groupbook) GROUP BY 1")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir)
    return rounded(rows.join(F.broadcast(forms(spark, sf_dir).agg(F.max("period").alias("period"))), "period").groupBy("sector").agg(F.sum("weight").alias("weight")))


@query("SELECT k, round(turnover, 6) AS turnover FROM turns WHERE variant = 'equal'")
def book_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.turnover(_books(spark, sf_dir, ("equal",)), ["variant"]).drop("variant"))


@query(f"SELECT {LEDGER} FROM led WHERE variant = 'equal'")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir, ("equal",)).drop("variant"), 10)


@query(f"SELECT {LEDGER} FROM led WHERE variant = 'universe'")
def equal_weight_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir, ("universe",)).drop("variant"), 10)


@query(f"SELECT variant, {LEDGER} FROM led")
def variant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir), 10)


cte(
    curve="SELECT *, MAX(net_equity) OVER (PARTITION BY variant ORDER BY exit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM led",
    perf="""SELECT variant, COUNT(*) AS n, CASE WHEN product(1 + net_return) > 0 THEN power(product(1 + net_return), 12.0 / COUNT(*)) - 1 END AS cagr, stddev_samp(net_return) * sqrt(12) AS vol,
        (AVG(net_return) - (power(1.06, 1.0 / 12) - 1)) / NULLIF(stddev_samp(net_return), 0) * sqrt(12) AS sharpe, MIN(net_equity / peak - 1) AS max_drawdown, AVG(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, MAX(net_return) AS best, MIN(net_return) AS worst FROM curve GROUP BY 1""",
)


def _perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_ledger(spark, sf_dir), ["variant"], "exit", "net_return", config(spark, sf_dir).risk_free)


@query(f"SELECT variant, n, {R('cagr', 'vol', 'sharpe', 'max_drawdown', 'hit_rate', 'best', 'worst')} FROM perf")
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_perf(spark, sf_dir))


@query(f"SELECT variant, {R('cagr')} FROM perf")
def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir).groupBy("variant").agg(metrics.cagr("net_return").alias("cagr")))


@query(f"SELECT variant, {R('sharpe')} FROM perf")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir).groupBy("variant").agg(metrics.sharpe("net_return", config(spark, sf_dir).risk_free).alias("sharpe")))


@query(f"SELECT variant, {R('max_drawdown')} FROM perf")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.equity(_ledger(spark, sf_dir), ["variant"], "exit", "net_return").groupBy("variant").agg(F.min("drawdown").alias("max_drawdown")))


@query("SELECT variant, exit, round(net_equity, 6) AS equity, round(peak, 6) AS peak, round(net_equity / peak - 1, 6) AS drawdown FROM curve")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.equity(_ledger(spark, sf_dir), ["variant"], "exit", "net_return").select("variant", "exit", "equity", "peak", "drawdown"))


@query("SELECT arg_max(variant, sharpe) AS variant, round(MAX(sharpe), 6) AS sharpe FROM perf")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant of the best Sharpe ratio."""
    return rounded(_perf(spark, sf_dir).agg(F.max_by("variant", "sharpe").alias("variant"), F.max("sharpe").alias("sharpe")))


@query("SELECT variant, round(AVG(turnover), 6) AS turnover, round(AVG(cost) * 12, 6) AS drag FROM led GROUP BY 1")
def cost_drag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir).groupBy("variant").agg(F.avg("turnover").alias("turnover"), (F.avg("cost") * 12).alias("drag")))


@query("SELECT date, index_name, round(close, 6) AS close, round(div_yield, 6) AS div_yield, CAST(NULL AS DOUBLE) AS pe FROM idx")
def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index levels read with a fixed schema; columns that a file lacks are null."""
    rows = adapters.index_levels(spark, sf_dir)
    empty = spark.createDataFrame([], "date date, index_name string, close double, div_yield double, pe double")
    return rounded(empty.unionByName(rows, allowMissingColumns=True))


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("index_name").orderBy("date")
    rows = adapters.index_levels(spark, sf_dir).withColumn("price", F.col("close") / F.lag("close").over(w) - 1).where("price is not null")
    return rows.select("date", "index_name", "price", (F.col("price") + F.coalesce("div_yield", F.lit(0.0)) / 100 / 252).alias("total"))


@query("SELECT date, index_name, round(price, 6) AS price, round(total, 6) AS total FROM tot")
def total_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price returns with the dividend yield spread over the year."""
    return rounded(_total(spark, sf_dir))


@query("""SELECT index_name, x.exit, round(product(1 + total) - 1, 6) AS ret FROM (SELECT exit, LAG(exit) OVER (ORDER BY exit) AS after FROM (SELECT DISTINCT exit FROM reb)) x
    JOIN tot t ON t.date > x.after AND t.date <= x.exit WHERE after IS NOT NULL GROUP BY 1, 2""")
def align_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index returns on the grid of the books."""
    return rounded(metrics.align(_total(spark, sf_dir).select("date", "index_name", F.col("total").alias("ret")), forms(spark, sf_dir), ["index_name"]))


HOOKED = """WITH sc AS (SELECT r.form_date, r.period, u.isin, round(a.adj_close / b.adj_close - 1, 9) AS score FROM uni u JOIN reb r ON r.form_date = u.form_date JOIN adj a ON a.isin = u.isin AND a.s = u.form_s JOIN adj b ON b.isin = u.isin AND b.s = u.form_s - 26
    WHERE r.form_date BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY form_date ORDER BY score DESC, isin) AS k FROM sc)
SELECT b.form_date, COUNT(*) AS n_holdings, round(SUM(ret * (11 - k)) / SUM(11 - k), 6) AS gross_return FROM best b JOIN fwd f ON f.period = b.period AND f.isin = b.isin WHERE k <= 10 GROUP BY 1"""


@query("SELECT * FROM (" + HOOKED + ")")
def hooked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with a universe, score and weights of its own: the ten best of 26 sessions, weighted by rank, formed from 1994 to 1997."""

    def score(bars: DataFrame, dates: DataFrame) -> DataFrame:
        ends = F.broadcast(dates.select("form_date", "form_s"))
        now = bars.join(ends, F.col("s") == F.col("form_s")).select("form_date", "isin", "adj_close")
        was = bars.join(ends, F.col("s") == F.col("form_s") - 26).select("form_date", "isin", F.col("adj_close").alias("was"))
        return now.join(was, ["form_date", "isin"]).select("form_date", "isin", F.round(F.col("adj_close") / F.col("was") - 1, 9).alias("score"))

    def weights(scores: DataFrame) -> DataFrame:
        best = portfolio.top_n(scores, 10, ["period"], "score")
        return best.withColumn("weight", (11 - F.col("rank")) / F.sum(11 - F.col("rank")).over(Window.partitionBy("period")))

    dates = backtest.clip(forms(spark, sf_dir), "1994-01-01", "1997-12-31")
    found = backtest.run(panel(spark, sf_dir), dates, lambda bars, dates: members(spark, sf_dir), score, weights, config(spark, sf_dir).cost_bps)
    return rounded(found.select("form_date", "n_holdings", "gross_return"))


@query("SELECT form_date, entry, exit FROM reb WHERE form_date BETWEEN DATE '1993-06-01' AND DATE '1998-06-30' AND form_date <= (SELECT MAX(broadcast_date) FROM fil)")
def clipped_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebalances between two days, and none after the newest filing."""
    last = adapters.filings(spark, sf_dir).agg(F.max("broadcast_date"))
    return backtest.clip(forms(spark, sf_dir), "1993-06-01", "1998-06-30", last).select("form_date", "entry", "exit")


@query(f"SELECT {LEDGER} FROM led WHERE variant = 'equal'")
def ledger_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as CSV and read back."""
    rows, place = ledger(spark, sf_dir), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    layouts.write_csv(rows, place, ["form_date"])
    return spark.read.schema(rows.schema).option("header", True).csv(place)


@query("SELECT date, index_name, round(close, 6) AS close, round(div_yield, 6) AS div_yield, CAST(NULL AS DOUBLE) AS pe FROM idx")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index levels written as CSV files with the publisher's column names and read back by them."""
    names, place = layouts.INDEX_COLUMNS, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows = adapters.index_levels(spark, sf_dir)
    layouts.write_csv(rows.select("date", *(F.col(c).cast("string").alias(f" {names[c]}") for c in ("index_name", "close", "div_yield"))), place, ["date"])
    found = layouts.read_named(spark, [place], names, tuple(c for c in names if c != "index_name"))
    return rounded(found.select(F.col("date").cast("date").alias("date"), "index_name", "close", "div_yield", "pe"))


@query("SELECT s_name AS name, 'S' || s_suppkey AS symbol, 'INE' || s_suppkey || 'A' AS isin FROM supplier")
def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published list of members written as CSV and read back by trimmed names."""
    place = f"{shared_dir(spark)}/members-{uuid.uuid4().hex}"
    key = F.col("s_suppkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("Company Name "), F.concat(F.lit("S"), key).alias(" Symbol"), F.concat(F.lit("INE"), key, F.lit("A")).alias("ISIN Code"))
    layouts.write_csv(rows, place, [" Symbol"])
    return layouts.read_named(spark, [place], layouts.CONSTITUENTS)


@query("SELECT isin, symbol, round(median_turnover, 6) AS median_turnover FROM uni WHERE form_date = (SELECT MAX(form_date) FROM uni) ORDER BY uni.median_turnover DESC, isin LIMIT 25")
def most_liquid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most liquid members of the last formation."""
    rows = members(spark, sf_dir)
    rows = rows.join(F.broadcast(rows.agg(F.max("form_date").alias("form_date"))), "form_date")
    return rounded(rows.orderBy(F.desc("median_turnover"), "isin").limit(25).select("isin", "symbol", "median_turnover"))


@query("SELECT isin, round(vol, 6) AS vol FROM fac WHERE form_date = (SELECT MAX(form_date) FROM fac) AND vol IS NOT NULL ORDER BY fac.vol, isin LIMIT 20")
def calmest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 members of the last formation with the least volatility."""
    rows = _raw(spark, sf_dir)
    rows = rows.join(F.broadcast(rows.agg(F.max("form_date").alias("form_date"))), "form_date")
    return rounded(rows.where("vol is not null").orderBy("vol", "isin").limit(20).select("isin", "vol"))
