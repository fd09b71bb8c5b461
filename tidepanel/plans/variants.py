"""Queries over books with memory, grids of variants from a table, and selection of factors out of sample."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import backtest, metrics, portfolio, universe
from tidepanel.plans.panel import forms
from tidepanel.plans.registry import CTES, config, cte, panel, query, rounded
from tidepanel.plans.research import LEDGER, NAMES, R, _fwd, _ics, _raw, _scored, _total, _zscores

#: Factor sets, sizes, buffers and sizings: every row is a variant of the grid.
SETS = {"all": tuple(NAMES), "calm momentum": ("mom_long", "vol"), "trading": ("reversal", "illiq", "mom_short")}
GRID = [(f"{name} {n} x{mult} {sizing}", name, n, mult, sizing) for name in SETS for n, mult in ((10, 1.0), (10, 2.0), (20, 1.5)) for sizing in ("equal", "inverse")]
INDEXES = ("AMERICA", "ASIA")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}" for x in r) + ")" for r in rows)


def ledger_ctes(prefix: str, books: str) -> None:
    """The CTEs from books to performance for a table of books of its own."""
    names = ("books", "bookk", "turns", "led", "curve", "perf")
    for name in names:
        text = books if name == "books" else CTES[name]
        CTES[prefix + name] = re.sub(rf"\b({'|'.join(names)})\b", rf"{prefix}\1", text) if name != "books" else text


def memory_ctes(prefix: str, params: str, cand: str) -> None:
    """CTEs of books that keep held names: ``params`` has variant, n, mult, sizing; ``cand`` has variant, period, isin, rank, ret, vol."""
    p = prefix
    CTES[f"{p}params"], CTES[f"{p}cand"] = params, cand
    CTES[f"{p}names"] = f"SELECT variant, period, list(isin ORDER BY rank) AS names, list(isin ORDER BY rank) FILTER (ret IS NOT NULL) AS tradable FROM {p}cand GROUP BY 1, 2"
    CTES[f"{p}walk"] = f"""WITH RECURSIVE walk AS (SELECT variant, n, CAST(-1 AS BIGINT) AS period, CAST([] AS VARCHAR[]) AS sel, CAST([] AS VARCHAR[]) AS held FROM {p}params UNION ALL
        SELECT variant, n, period, sel, CASE WHEN len(book) > 0 THEN book ELSE held END FROM (SELECT *, list_filter(sel, lambda x: list_contains(tradable, x)) AS book FROM
        (SELECT variant, n, period, held, tradable, list_concat(kept, list_filter(names, lambda x: NOT list_contains(kept, x))[1:n - len(kept)]) AS sel FROM
        (SELECT w.variant, w.n, w.period + 1 AS period, w.held, coalesce(c.names, []) AS names, coalesce(c.tradable, []) AS tradable, list_filter(coalesce(c.names, []), lambda x: list_contains(w.held, x))[1:w.n] AS kept
         FROM walk w LEFT JOIN {p}names c ON c.variant = w.variant AND c.period = w.period + 1 WHERE w.period < (SELECT MAX(period) FROM reb)))))
        SELECT variant, period, unnest(sel) AS isin FROM walk"""
    CTES[f"{p}size"] = f"""SELECT variant, period, isin, ret, CASE WHEN sizing = 'equal' THEN 1.0 WHEN k IS NULL OR i <= k THEN cap ELSE w * (1 - k * cap) / restk END AS w FROM (SELECT *, MAX(CASE WHEN i = k + 1 THEN rest END) OVER (PARTITION BY variant, period) AS restk FROM
        (SELECT *, MIN(CASE WHEN w * (1 - (i - 1) * cap) <= cap * rest * (1 + 1e-12) THEN i - 1 END) OVER (PARTITION BY variant, period) AS k FROM
        (SELECT *, greatest(0.10, 1.0 / COUNT(*) OVER (PARTITION BY variant, period)) AS cap, ROW_NUMBER() OVER (PARTITION BY variant, period ORDER BY w DESC, isin) AS i, SUM(w) OVER (PARTITION BY variant, period ORDER BY w DESC, isin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM
        (SELECT variant, period, isin, ret, sizing, inv / SUM(inv) OVER (PARTITION BY variant, period) AS w FROM (SELECT w.variant, w.period, w.isin, c.ret, m.sizing, 1 / greatest(COALESCE(vol, MEDIAN(vol) OVER (PARTITION BY w.variant, w.period), 1.0), 0.10) AS inv
         FROM {p}walk w JOIN {p}cand c ON c.variant = w.variant AND c.period = w.period AND c.isin = w.isin JOIN {p}params m ON m.variant = w.variant)))))"""
    ledger_ctes(p, f"SELECT variant, period, isin, w / SUM(w) OVER (PARTITION BY variant, period) AS weight, ret FROM {p}size WHERE ret IS NOT NULL")


memory_ctes(
    "buf",
    f"SELECT *, (SELECT h FROM cfg) AS n, 'equal' AS sizing FROM (VALUES {_values([(f'buffer {m}', m) for m in (1.0, 1.5, 2.0)])}) t(variant, mult)",
    "SELECT p.variant, r.period, r.isin, r.rank, f.ret, CAST(NULL AS DOUBLE) AS vol FROM ranked r JOIN bufparams p ON r.rank <= floor(p.n * p.mult) LEFT JOIN fwd f ON f.period = r.period AND f.isin = r.isin",
)
cte(
    gridsets=f"SELECT * FROM (VALUES {_values([(name, f, len(fs)) for name, fs in SETS.items() for f in fs])}) t(fset, factor, k)",
    gridscore="SELECT fset, form_date, isin, round(AVG(z), 10) AS score FROM zlong JOIN gridsets USING (factor) WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= MAX(k) / 2",
    gridrank="SELECT fset, s.form_date, r.period, isin, ROW_NUMBER() OVER (PARTITION BY fset, s.form_date ORDER BY score DESC, isin) AS rank FROM gridscore s JOIN reb r ON r.form_date = s.form_date",
)
memory_ctes(
    "grid",
    f"SELECT * FROM (VALUES {_values(GRID)}) t(variant, fset, n, mult, sizing)",
    """SELECT p.variant, g.period, g.isin, g.rank, f.ret, fac.vol FROM gridrank g JOIN gridparams p ON p.fset = g.fset AND g.rank <= floor(p.n * p.mult) LEFT JOIN fwd f ON f.period = g.period AND f.isin = g.isin
        JOIN fac ON fac.form_date = g.form_date AND fac.isin = g.isin""",
)
cte(
    bench=f"""SELECT variant, exit, product(1 + r) - 1 AS net_return FROM (SELECT exit, LAG(exit) OVER (ORDER BY exit) AS after FROM (SELECT DISTINCT exit FROM reb)) x JOIN
        (SELECT date, index_name || ' price' AS variant, price AS r FROM tot UNION ALL SELECT date, index_name || ' total return', total FROM tot) t ON t.date > x.after AND t.date <= x.exit
        WHERE after IS NOT NULL AND split_part(variant, ' ', 1) IN ({", ".join(f"'{i}'" for i in INDEXES)}) GROUP BY 1, 2""",
    benchled="SELECT variant, exit, net_return, product(1 + net_return) OVER (PARTITION BY variant ORDER BY exit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS net_equity FROM (SELECT variant, exit, net_return FROM gridled UNION ALL SELECT variant, exit, net_return FROM led WHERE variant = 'universe' UNION ALL SELECT * FROM bench)",
    benchcurve="SELECT *, MAX(net_equity) OVER (PARTITION BY variant ORDER BY exit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM benchled",
    benchperf=CTES["perf"].replace("FROM curve", "FROM benchcurve"),
)


@query(f"SELECT variant, {LEDGER} FROM bufled")
def buffered_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of books with buffers of 1, 1.5 and 2."""
    cfg = config(spark, sf_dir)
    rows = _scored(spark, sf_dir).select("form_date", "isin", "composite").join(F.broadcast(forms(spark, sf_dir).select("form_date", "period")), "form_date")
    rows = portfolio.top_n(rows, 2 * cfg.holdings, ["form_date", "period"]).join(_fwd(spark, sf_dir).select("period", "isin", "ret"), ["period", "isin"], "left")
    variants = F.explode(F.array(*(F.struct(F.lit(f"buffer {m}").alias("variant"), F.lit(m).alias("mult")) for m in (1.0, 1.5, 2.0))))
    rows = rows.select("period", "isin", "rank", "ret", variants.alias("v")).select("period", "isin", "rank", "ret", "v.variant", "v.mult").where(F.col("rank") <= F.floor(F.col("mult") * cfg.holdings))
    return rounded(backtest.ledger(portfolio.buffered_books(rows, cfg.holdings), forms(spark, sf_dir), cfg.cost_bps, ["variant"]), 10)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form_date, isin, factor, z."""
    z = _zscores(spark, sf_dir).select("form_date", "isin", *(F.col(f"z_{f}").alias(f) for f in NAMES))
    return z.unpivot(["form_date", "isin"], NAMES, "factor", "z").where("z is not null")


def _grid_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of the grid as one plan: factor sets and parameters are small tables that the scores are joined with."""
    cfg = config(spark, sf_dir)
    sets = spark.createDataFrame([(name, f, len(fs)) for name, fs in SETS.items() for f in fs], "fset string, factor string, k int")
    params = spark.createDataFrame(GRID, "variant string, fset string, n int, mult double, sizing string")
    scores = _long(spark, sf_dir).join(F.broadcast(sets), "factor").groupBy("fset", "form_date", "isin").agg(F.round(F.avg("z"), 10).alias("score"), (F.count("z") >= F.max("k") / 2).alias("half")).where("half")
    scores = scores.join(F.broadcast(forms(spark, sf_dir).select("form_date", "period")), "form_date")
    ranked = portfolio.top_n(scores, max(int(n * mult) for _, _, n, mult, _ in GRID), ["fset", "form_date", "period"], "score")
    ranked = ranked.join(_fwd(spark, sf_dir).select("period", "isin", "ret"), ["period", "isin"], "left").join(_raw(spark, sf_dir).select("form_date", "isin", "vol"), ["form_date", "isin"])
    ranked = ranked.join(F.broadcast(params), "fset").where(F.col("rank") <= F.floor(F.col("n") * F.col("mult")))
    ranked = ranked.select("variant", "period", "isin", "rank", "ret", "vol", "n", "mult", "sizing")
    books = portfolio.folded_books(ranked, portfolio.sized_buffer(cfg.max_weight, cfg.floor_vol))
    return backtest.ledger(books, forms(spark, sf_dir), cfg.cost_bps, ["variant"])


@query(f"SELECT variant, {LEDGER} FROM gridled")
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of eighteen variants: factor sets by size, buffer and sizing."""
    return rounded(_grid_ledger(spark, sf_dir), 10)


@query(f"SELECT variant, n, {R('cagr', 'vol', 'sharpe', 'max_drawdown', 'hit_rate', 'best', 'worst')} FROM benchperf")
def variant_grid_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of the grid beside the equal-weight universe and indexes, by price and with dividends."""
    from tidepanel.plans.research import _ledger

    total = _total(spark, sf_dir).where(F.col("index_name").isin(*INDEXES))
    kinds = total.unpivot(["date", "index_name"], ["price", "total"], "kind", "ret")
    named = F.concat("index_name", F.when(F.col("kind") == "price", " price").otherwise(" total return"))
    indexes = metrics.align(kinds.select("date", named.alias("variant"), "ret"), forms(spark, sf_dir), ["variant"]).withColumnRenamed("ret", "net_return")
    books = _grid_ledger(spark, sf_dir).unionByName(_ledger(spark, sf_dir, ("universe",))).select("variant", "exit", "net_return")
    return rounded(metrics.summary(books.unionByName(indexes), ["variant"], "exit", "net_return", config(spark, sf_dir).risk_free))


#: Names of the run below, the rank to which a held one stays, and what share of its held weight it keeps.
HELD_N, HELD_RANK, HELD_SHARE = 10, 15, 0.5

cte(
    heldrank="""SELECT r.period, isin, ROW_NUMBER() OVER (PARTITION BY r.period ORDER BY score DESC, isin) AS rank FROM (SELECT s.form_date, s.isin, round(a.adj_close / b.adj_close - 1, 9) AS score FROM stats s
        JOIN adj a ON a.isin = s.isin AND a.s = s.form_s JOIN adj b ON b.isin = s.isin AND b.s = s.form_s - 26 WHERE s.traded AND s.n_days >= 20) q JOIN reb r USING (form_date) WHERE score IS NOT NULL""",
    heldlist=f"SELECT h.period, list(h.isin ORDER BY rank) AS names, list(h.isin ORDER BY rank) FILTER (ret IS NOT NULL) AS tradable FROM heldrank h LEFT JOIN fwd f ON f.period = h.period AND f.isin = h.isin WHERE rank <= {HELD_RANK} GROUP BY 1",
    heldwalk=f"""WITH RECURSIVE walk AS (SELECT CAST(-1 AS BIGINT) AS period, CAST([] AS VARCHAR[]) AS book, CAST([] AS DOUBLE[]) AS weights, CAST([] AS VARCHAR[]) AS held, CAST([] AS DOUBLE[]) AS hw UNION ALL
        SELECT period, book, weights, CASE WHEN len(book) > 0 THEN book ELSE held END, CASE WHEN len(book) > 0 THEN weights ELSE hw END FROM
        (SELECT period, book, list_transform(raw, lambda x: x / list_sum(raw)) AS weights, held, hw FROM
        (SELECT *, list_transform(book, lambda x: (1 - {HELD_SHARE}) / len(sel) + {HELD_SHARE} * coalesce(hw[list_position(held, x)], 0)) AS raw FROM
        (SELECT *, list_filter(sel, lambda x: list_contains(tradable, x)) AS book FROM
        (SELECT period, held, hw, tradable, list_concat(kept, list_filter(names, lambda x: NOT list_contains(kept, x))[1:{HELD_N} - len(kept)]) AS sel FROM
        (SELECT w.period + 1 AS period, w.held, w.hw, coalesce(c.names, []) AS names, coalesce(c.tradable, []) AS tradable, list_filter(coalesce(c.names, []), lambda x: list_contains(w.held, x))[1:{HELD_N}] AS kept
         FROM walk w LEFT JOIN heldlist c ON c.period = w.period + 1 WHERE w.period < (SELECT MAX(period) FROM reb)))))))
        SELECT 'run' AS variant, period, unnest(book) AS isin, unnest(weights) AS weight FROM walk""",
)
ledger_ctes("held", "SELECT w.variant, w.period, w.isin, w.weight, f.ret FROM heldwalk w JOIN fwd f ON f.period = w.period AND f.isin = w.isin")


@query(f"SELECT variant, {LEDGER} FROM heldled")
def held_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose universe comes from the bars and whose weights move half way from the held book's to equal ones."""

    def often(bars: DataFrame, dates: DataFrame) -> DataFrame:
        return universe.formation_stats(bars, dates, 26).where("traded and n_days >= 20").select("form_date", "isin")

    def change(bars: DataFrame, dates: DataFrame) -> DataFrame:
        ends = F.broadcast(dates.select("form_date", "form_s"))
        now = bars.join(ends, F.col("s") == F.col("form_s")).select("form_date", "isin", "adj_close")
        was = bars.join(ends, F.col("s") == F.col("form_s") - 26).select("form_date", "isin", F.col("adj_close").alias("was"))
        return now.join(was, ["form_date", "isin"]).select("form_date", "isin", F.round(F.col("adj_close") / F.col("was") - 1, 9).alias("score"))

    share, n, mult, keep = HELD_SHARE, HELD_N, HELD_RANK / HELD_N, portfolio.kept_and_filled

    def weigh(now, held: dict) -> dict:
        chosen = keep(now, held, n, mult)
        return {i: (1 - share) / len(chosen) + share * held.get(i, 0.0) for i in chosen}

    return rounded(backtest.run_held(panel(spark, sf_dir), forms(spark, sf_dir), often, change, weigh, config(spark, sf_dir).cost_bps, deepest=HELD_RANK), 10)


cte(
    foldt="""SELECT fold, factor, COUNT(ic) AS n, AVG(ic) / NULLIF(stddev_samp(ic), 0) * sqrt(COUNT(ic)) AS t_stat FROM ics JOIN (SELECT DISTINCT year(form_date) AS fold FROM ics) y ON year(form_date) < fold WHERE factor <> 'composite' GROUP BY 1, 2""",
    foldv="SELECT *, CASE WHEN t_stat >= 1.0 THEN 'kept' WHEN t_stat <= -1.0 THEN 'wrong sign' ELSE 'noise' END AS verdict FROM foldt",
    oos="""SELECT fold, form_date, isin, AVG(z) AS composite FROM zlong z JOIN (SELECT fold, factor, COUNT(*) OVER (PARTITION BY fold) AS k FROM foldv WHERE verdict = 'kept') v ON v.fold = year(z.form_date) AND v.factor = z.factor
        WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= MAX(k) / 2""",
    oosrank="SELECT o.form_date, r.period, o.isin, ROW_NUMBER() OVER (PARTITION BY o.form_date ORDER BY round(composite, 10) DESC, o.isin) AS rank FROM oos o JOIN reb r ON r.form_date = o.form_date",
)
ledger_ctes("oos", "SELECT 'out of sample' AS variant, o.period, o.isin, 1.0 / COUNT(*) OVER (PARTITION BY o.period) AS weight, ret FROM oosrank o JOIN fwd f ON f.period = o.period AND f.isin = o.isin WHERE rank <= (SELECT h FROM cfg)")

#: The least t statistic that keeps a factor: 1 on the short history of the test panels (``select_factors`` has 2 by default).
LEAST_T = 1.0


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fold_verdicts(_ics(spark, sf_dir).where("factor <> 'composite'"), LEAST_T)


def _oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.out_of_sample(_long(spark, sf_dir), _verdicts(spark, sf_dir))


@query("SELECT fold, factor, n, round(t_stat, 6) AS t_stat, verdict FROM foldv")
def fold_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each year would have kept, judged by the years before."""
    return rounded(_verdicts(spark, sf_dir))


@query("SELECT fold, form_date, isin, round(composite, 6) AS composite FROM oos")
def oos_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite of the factors that were kept beforehand."""
    return rounded(_oos(spark, sf_dir))


@query(f"SELECT variant, {LEDGER} FROM oosled")
def oos_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the best names by the out-of-sample composite."""
    cfg = config(spark, sf_dir)
    rows = _oos(spark, sf_dir).withColumn("composite", F.round("composite", 10)).join(F.broadcast(forms(spark, sf_dir).select("form_date", "period")), "form_date")
    books = portfolio.equal_weights(portfolio.top_n(rows, cfg.holdings, ["period"]), ["period"])
    books = backtest.tradable(books.select("period", "isin", "weight"), _fwd(spark, sf_dir), []).withColumn("variant", F.lit("out of sample"))
    return rounded(backtest.ledger(books, forms(spark, sf_dir), cfg.cost_bps, ["variant"]), 10)
