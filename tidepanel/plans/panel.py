"""Queries over the bar panel: sources, calendar, identities, adjustment, quality, universe."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import once, shared_dir
from tidepanel.operators import adjust, quality, universe
from tidepanel.operators import calendar as cal_ops
from tidepanel.plans.registry import bars_table, config, cte, panel, query, rounded
from tidepanel.sources import adapters, layouts

cte(
    bars=adapters.BARS,
    cfg="SELECT 500 AS u, 10 AS zmin, 30 AS h",
    cal="SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS s FROM (SELECT DISTINCT date FROM bars)",
    mends="SELECT CAST(date_trunc('month', date) AS DATE) AS month, MAX(date) AS date, MAX(s) AS s FROM cal GROUP BY 1",
    reb="""SELECT *, ROW_NUMBER() OVER (ORDER BY form_s) - 1 AS period FROM (SELECT m.date AS form_date, m.s AS form_s, c.date AS entry, m.s + 1 AS entry_s,
        m.nx AS exit, m.nxs AS exit_s FROM (SELECT date, s, LEAD(date) OVER (ORDER BY s) AS nx, LEAD(s) OVER (ORDER BY s) AS nxs FROM mends WHERE s >= 60) m JOIN cal c ON c.s = m.s + 1 WHERE c.date < m.nx)""",
    spans="SELECT symbol, isin, MIN(date) AS d0, MAX(date) AS d1 FROM bars GROUP BY 1, 2",
    hand="""SELECT isin, arg_max(nx, symbol) AS to_isin FROM (SELECT p.symbol, p.isin, LEAD(p.isin) OVER w AS nx, LEAD(a.s) OVER w AS ns, b.s AS s1 FROM spans p JOIN cal a ON a.date = d0 JOIN cal b ON b.date = d1
        WINDOW w AS (PARTITION BY p.symbol ORDER BY d0, p.isin)) WHERE ns = s1 + 1 AND nx <> isin GROUP BY isin""",
    links="""WITH RECURSIVE walk AS (SELECT isin, isin AS place, 0 AS n FROM (SELECT DISTINCT isin FROM bars) UNION ALL SELECT walk.isin, h.to_isin, n + 1 FROM walk JOIN hand h ON h.isin = walk.place WHERE n < 1000)
        SELECT isin, arg_max(place, n) AS canonical_isin FROM walk GROUP BY isin""",
    linked="SELECT b.* EXCLUDE (isin), b.isin AS original_isin, l.canonical_isin AS isin, c.s FROM bars b JOIN links l ON b.isin = l.isin JOIN cal c ON c.date = b.date",
    factored="""SELECT *, CASE WHEN abs(g - 1) > 0.02 THEN g ELSE 1.0 END AS factor FROM (SELECT *, CASE WHEN f BETWEEN 0.02 AND 2.0 THEN f ELSE 1.0 END AS g
        FROM (SELECT *, CASE WHEN LAG(close) OVER (PARTITION BY isin ORDER BY date) > 0 THEN prevclose / LAG(close) OVER (PARTITION BY isin ORDER BY date) END AS f FROM linked))""",
    adj="""SELECT *, close * adj_factor AS adj_close FROM (SELECT *, COALESCE(product(factor) OVER (PARTITION BY isin ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS adj_factor FROM factored)""",
    step="SELECT *, LAG(adj_close) OVER w AS before, LAG(s) OVER w AS prior FROM adj WINDOW w AS (PARTITION BY isin ORDER BY s)",
    raw_ret="SELECT *, CASE WHEN s - prior = 1 AND before > 0 THEN adj_close / before - 1 END AS r0 FROM step",
    ret="SELECT *, CASE WHEN abs(r0) <= 0.5 THEN r0 END AS ret FROM raw_ret",
    stats="""SELECT r.form_date, r.form_s, a.isin, arg_max(a.symbol, a.s) AS symbol, MEDIAN(a.turnover) AS median_turnover, COUNT(DISTINCT a.s) AS n_days, arg_max(a.close, a.s) AS last_close,
        MAX(a.s) = r.form_s AS traded, LEAST(r.form_s + 1, 26) AS window_days, COUNT(DISTINCT a.s) / LEAST(r.form_s + 1, 26) AS trading_frac
        FROM reb r JOIN adj a ON a.s BETWEEN r.form_s - 25 AND r.form_s GROUP BY r.form_date, r.form_s, a.isin""",
    uni="""SELECT form_date, form_s, isin, symbol, median_turnover, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY form_date ORDER BY median_turnover DESC, isin) AS rank
        FROM stats WHERE traded AND trading_frac >= 0.6 AND median_turnover >= 1e4) WHERE rank <= (SELECT u FROM cfg)""",
)

BAR_LIST = "date, symbol, isin, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(prevclose, 6) AS prevclose, round(volume, 6) AS volume, round(turnover, 6) AS turnover, CAST(trades AS DOUBLE) AS trades"


@query(f"SELECT {BAR_LIST} FROM bars WHERE trades % 7 <> 0")
def bars_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as lines of the older daily layout and read back; other series than equity are dropped."""
    rows = bars_table(spark, sf_dir).withColumn("series", F.when(F.col("trades") % 7 == 0, "BL").otherwise("EQ"))
    return rounded(layouts.parse(layouts.to_lines(rows, layouts.LEGACY), layouts.LEGACY))


@query(f"SELECT {BAR_LIST} FROM bars WHERE trades % 5 <> 0")
def bars_udiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the newer layout, which names its instrument type."""
    rows = bars_table(spark, sf_dir).withColumn("series", F.lit("EQ")).withColumn("kind", F.when(F.col("trades") % 5 == 0, "IDX").otherwise("STK"))
    return rounded(layouts.parse(layouts.to_lines(rows, layouts.NEWER), layouts.NEWER))


@query(f"SELECT {BAR_LIST} FROM bars WHERE trades % 7 <> 0")
def bars_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as daily CSV files, up to 1994 in the older layout and from then on in the newer one, and read back by their headers."""
    rows = bars_table(spark, sf_dir).withColumn("series", F.when(F.col("trades") % 7 == 0, "BL").otherwise("EQ")).withColumn("kind", F.lit("STK"))
    place = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    layouts.write(rows.where("date < date'1995-01-01'"), f"{place}/old", layouts.LEGACY)
    layouts.write(rows.where("date >= date'1995-01-01'"), f"{place}/new", layouts.NEWER)
    return rounded(layouts.read(spark, [f"{place}/old", f"{place}/new"])[0])


@query("SELECT date, symbol, round(close, 6) AS close FROM bars")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written in canonical order and read back."""
    place = f"{shared_dir(spark)}/canonical-{uuid.uuid4().hex}"
    layouts.write_panel(bars_table(spark, sf_dir).select("date", "symbol", "close"), place)
    return rounded(spark.read.parquet(place))


@query(f"SELECT {BAR_LIST} FROM bars WHERE date BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'")
def load_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of days over both layouts: the older one before 1995, the newer one from then on."""
    rows = bars_table(spark, sf_dir).where(F.col("date").between("1993-01-01", "1995-12-31")).withColumn("series", F.lit("EQ")).withColumn("kind", F.lit("STK"))
    old = layouts.to_lines(rows.where("date < date'1995-01-01'"), layouts.LEGACY)
    new = layouts.to_lines(rows.where("date >= date'1995-01-01'"), layouts.NEWER)
    return rounded(layouts.load_range({"legacy": old, "newer": new}, "1993-01-01", "1995-12-31"))


@query("SELECT date, s FROM cal")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_ops.calendar(bars_table(spark, sf_dir))


@query("SELECT month, date, s FROM mends")
def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_ops.month_ends(calendar(spark, sf_dir))


@query("SELECT form_date, form_s, entry, entry_s, exit, exit_s, period FROM reb")
def rebalance_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_ops.rebalances(calendar(spark, sf_dir), config(spark, sf_dir).warmup)


@query("SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS d FROM cal) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT date FROM cal)")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_ops.missing_days(calendar(spark, sf_dir))


@query("""SELECT *, (full_year AND NOT gap BETWEEN 10 AND 20) AS flagged FROM (SELECT w.year, COALESCE(n, 0) AS sessions, weekdays, weekdays - COALESCE(n, 0) AS gap, full_year FROM
    (SELECT year(d) AS year, COUNT(*) AS weekdays, bool_and(make_date(year(d), 1, 1) >= a AND make_date(year(d), 12, 31) <= b) AS full_year
     FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d, a, b FROM (SELECT MIN(date) AS a, MAX(date) AS b FROM cal)) WHERE isodow(d) < 6 GROUP BY 1) w
    LEFT JOIN (SELECT year(date) AS year, COUNT(*) AS n FROM cal GROUP BY 1) c ON c.year = w.year)""".replace("SELECT *, (", "SELECT year, sessions, weekdays, gap, (", 1))
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cal_ops.coverage_by_year(calendar(spark, sf_dir)))


@query("SELECT isin, canonical_isin FROM links")
def isin_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.isin_links(bars_table(spark, sf_dir))


@query("SELECT date, symbol, original_isin, isin FROM linked")
def apply_isin_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_table(spark, sf_dir)
    return adjust.apply_links(bars, adjust.isin_links(bars)).select("date", "symbol", "original_isin", "isin")


@query("SELECT isin, date, round(factor, 6) AS factor FROM factored WHERE factor <> 1")
def detect_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_table(spark, sf_dir)
    return rounded(adjust.detect_actions(adjust.apply_links(bars, adjust.isin_links(bars))))


@query("SELECT date, isin, round(close, 6) AS close, round(adj_factor, 6) AS adj_factor, round(adj_close, 6) AS adj_close FROM adj")
def adjusted_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir).select("date", "isin", "close", "adj_factor", "adj_close"))


@query("SELECT date, isin, round(ret, 6) AS ret_null, round(CASE WHEN abs(rr) <= 0.5 THEN rr END, 6) AS ret_row FROM (SELECT *, CASE WHEN before > 0 THEN adj_close / before - 1 END AS rr FROM ret)")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adjust.returns(panel(spark, sf_dir)).withColumnRenamed("ret", "ret_null")
    return rounded(adjust.returns(rows, gap="row").select("date", "isin", "ret_null", F.col("ret").alias("ret_row")))


@query("""SELECT c.date, f.isin, round(CASE WHEN abs(r) <= 0.5 THEN r END, 6) AS ret FROM (SELECT s, isin, px / LAG(px) OVER (PARTITION BY isin ORDER BY s) - 1 AS r FROM
    (SELECT g.s, g.isin, last_value(a.adj_close IGNORE NULLS) OVER (PARTITION BY g.isin ORDER BY g.s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px
     FROM (SELECT c.s, x.isin FROM (SELECT isin, MIN(s) AS s0 FROM adj GROUP BY 1) x JOIN cal c ON c.s >= x.s0) g LEFT JOIN adj a ON a.isin = g.isin AND a.s = g.s)) f JOIN cal c ON c.s = f.s""")
def padded_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjust.padded(panel(spark, sf_dir)).select("date", "isin", "ret"))


@query("SELECT date, isin, s FROM adj WHERE s > (SELECT MAX(s) FROM cal) - 26")
def trailing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the newest 26 sessions."""
    rows = panel(spark, sf_dir)
    return rows.join(F.broadcast(rows.agg(F.max("s").alias("top"))), F.col("s") > F.col("top") - 26).select("date", "isin", "s")


@query("""SELECT COUNT(*) AS n, MIN(date) AS first, MAX(date) AS last, COUNT(DISTINCT isin) AS isins, COUNT(DISTINCT symbol) AS symbols, COUNT(*) FILTER (close IS NULL) AS null_closes,
    (SELECT MIN(k) FROM (SELECT COUNT(*) AS k FROM bars GROUP BY date)) AS names_min, (SELECT MEDIAN(k) FROM (SELECT COUNT(*) AS k FROM bars GROUP BY date)) AS names_median,
    (SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM bars GROUP BY date)) AS names_max FROM bars""")
def panel_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.panel_shape(bars_table(spark, sf_dir))


@query("SELECT symbol, COUNT(DISTINCT isin) AS isins FROM bars GROUP BY symbol HAVING COUNT(DISTINCT isin) > 1 ORDER BY isins DESC, symbol LIMIT 10")
def symbol_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.symbol_reuse(bars_table(spark, sf_dir))


@query("""SELECT COUNT(*) AS n, round(COUNT(*) / ((SELECT COUNT(*) FROM cal) / 52.0), 6) AS per_year, round(AVG(factor), 6) AS mean, round(quantile_cont(factor, 0.05), 6) AS p05, round(quantile_cont(factor, 0.25), 6) AS p25,
    round(quantile_cont(factor, 0.5), 6) AS p50, round(quantile_cont(factor, 0.75), 6) AS p75, round(quantile_cont(factor, 0.95), 6) AS p95 FROM factored WHERE factor <> 1""")
def action_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_table(spark, sf_dir)
    actions = adjust.detect_actions(adjust.apply_links(bars, adjust.isin_links(bars)))
    return rounded(quality.action_stats(actions, cal_ops.calendar(bars), 52.0))


@query("SELECT isin, date, round(factor, 6) AS factor FROM (SELECT isin, date, round(factor, 6) AS factor FROM factored WHERE factor <> 1) ORDER BY factor, isin, date LIMIT 8")
def smallest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most drastic corporate actions."""
    return quality.smallest_actions(detect_actions(spark, sf_dir))


@query("""SELECT COUNT(raw) AS n_raw, round(stddev_samp(raw), 6) AS std_raw, COUNT(*) FILTER (raw < -0.4) AS crashes_raw, COUNT(fix) AS n_adjusted, round(stddev_samp(fix), 6) AS std_adjusted, COUNT(*) FILTER (fix < -0.4) AS crashes_adjusted
    FROM (SELECT close / LAG(close) OVER w - 1 AS raw, adj_close / LAG(adj_close) OVER w - 1 AS fix FROM adj WINDOW w AS (PARTITION BY isin ORDER BY s))""")
def return_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.return_quality(panel(spark, sf_dir)))


@once
def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_ops.calendar(bars_table(spark, sf_dir))


@once
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebalances after the warm-up."""
    return cal_ops.rebalances(_calendar(spark, sf_dir), config(spark, sf_dir).warmup)


@once
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg, rows = config(spark, sf_dir), panel(spark, sf_dir)
    return universe.formation_stats(rows, forms(spark, sf_dir), cfg.formation)


@once
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.universe(_stats(spark, sf_dir), config(spark, sf_dir))


@query("SELECT form_date, isin, symbol, round(median_turnover, 6) AS median_turnover, n_days, round(last_close, 6) AS last_close, window_days, round(trading_frac, 6) AS trading_frac, traded FROM stats")
def formation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stats(spark, sf_dir).drop("form_s").select("form_date", "isin", "symbol", "median_turnover", "n_days", "last_close", "window_days", "trading_frac", "traded"))


@query("SELECT form_date, isin, symbol, round(median_turnover, 6) AS median_turnover, rank FROM uni")
def universe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(members(spark, sf_dir).drop("form_s"))


@query("SELECT isin, symbol, round(median_turnover, 6) AS median_turnover, rank FROM uni WHERE form_date = (SELECT MAX(form_date) FROM uni)")
def universe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members as of the last formation."""
    cfg, rows = config(spark, sf_dir), panel(spark, sf_dir)
    every = forms(spark, sf_dir)
    last = every.join(F.broadcast(every.agg(F.max("form_s").alias("form_s"))), "form_s")
    return rounded(universe.universe(universe.formation_stats(rows, last, cfg.formation), cfg).select("isin", "symbol", "median_turnover", "rank"))


@query("SELECT form_date, isin, rank FROM (SELECT form_date, isin, ROW_NUMBER() OVER (PARTITION BY form_date ORDER BY median_turnover DESC, isin) AS rank FROM stats WHERE traded AND trading_frac >= 0.6 AND median_turnover >= 1e4) WHERE rank <= 25")
def universe_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universes of the 25 most liquid names."""
    return universe.universe(_stats(spark, sf_dir), replace(config(spark, sf_dir), universe_size=25)).select("form_date", "isin", "rank")


@query("""SELECT a.form_date, COUNT(*) - COUNT(b.isin) AS n_new, COUNT(*) AS size, round((COUNT(*) - COUNT(b.isin)) / COUNT(*), 6) AS churn FROM uni a
    JOIN (SELECT form_date, LAG(form_date) OVER (ORDER BY form_date) AS p FROM (SELECT DISTINCT form_date FROM uni)) d ON d.form_date = a.form_date AND p IS NOT NULL
    LEFT JOIN uni b ON b.form_date = d.p AND b.isin = a.isin GROUP BY 1""")
def universe_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(universe.churn(members(spark, sf_dir)))


@query("""SELECT min_size, median_size, max_size, ever, latest, ever - latest AS gone FROM (SELECT MIN(n) AS min_size, MEDIAN(n) AS median_size, MAX(n) AS max_size FROM (SELECT COUNT(*) AS n FROM uni GROUP BY form_date)),
    (SELECT COUNT(DISTINCT isin) AS ever, COUNT(DISTINCT CASE WHEN form_date = (SELECT MAX(form_date) FROM uni) THEN isin END) AS latest FROM uni)""")
def survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(universe.survivorship(members(spark, sf_dir)))


@query("""SELECT COUNT(m.symbol) AS shared, COUNT(*) AS published, round(COUNT(m.symbol) / COUNT(*), 6) AS overlap FROM (SELECT DISTINCT 'S' || s_suppkey AS symbol FROM supplier WHERE s_nationkey < 15) p
    LEFT JOIN (SELECT DISTINCT symbol FROM uni WHERE form_date = (SELECT MAX(form_date) FROM uni)) m ON m.symbol = p.symbol""")
def index_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last universe against a published list (suppliers of fifteen nations)."""
    listed = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 15").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return rounded(universe.overlap(universe_latest(spark, sf_dir), listed))


@query("SELECT DISTINCT isin, symbol FROM uni")
def ever_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("isin", "symbol").distinct()


@query("SELECT MAX(date) AS last_session FROM bars")
def last_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of the stored panel's date column alone."""
    return panel(spark, sf_dir).select("date").agg(F.max("date").alias("last_session"))


@query("SELECT a.date, a.isin FROM adj a WHERE EXISTS (SELECT 1 FROM uni u JOIN reb r ON r.form_date = u.form_date WHERE u.isin = a.isin AND a.s BETWEEN r.form_s AND r.exit_s)")
def membership_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars inside a membership span [formation, next formation]; sessions map to their formations, so the semi-join is by equality."""
    inside = forms(spark, sf_dir).select("form_date", F.explode(F.sequence("form_s", "exit_s")).alias("s"))
    spans = members(spark, sf_dir).select("form_date", "isin").join(F.broadcast(inside), "form_date").select("isin", "s")
    return panel(spark, sf_dir).join(spans, ["isin", "s"], "left_semi").select("date", "isin")
