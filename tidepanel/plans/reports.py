"""Queries over filings, upserts and the live monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import once, shared_dir, stored
from tidepanel.operators import filings as ops
from tidepanel.plans.panel import forms
from tidepanel.plans.registry import bars_table, config, cte, query, rounded
from tidepanel.sources import adapters
from tidepanel.streaming import live

cte(
    fil=adapters.FILINGS,
    tick=adapters.TICKS,
    xmls=adapters.XML,
    asdates="SELECT form_date AS as_of FROM reb",
    vis="SELECT f.*, a.as_of FROM fil f JOIN asdates a ON f.broadcast_date <= a.as_of",
    pickc="SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin, period_end ORDER BY consolidated DESC, broadcast_date DESC) AS pn FROM vis) WHERE pn = 1",
    pickb="SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin, period_end ORDER BY broadcast_date DESC, consolidated DESC) AS pn FROM vis) WHERE pn = 1",
    fasof="SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin ORDER BY period_end DESC, broadcast_date DESC) AS fn FROM pickc WHERE as_of - period_end <= 400) WHERE fn = 1",
    pickbs="SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin, period_end ORDER BY consolidated DESC, broadcast_date DESC) AS pn FROM vis WHERE net_worth IS NOT NULL AND as_of - period_end <= 550) WHERE pn = 1",
    bsrc="SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin ORDER BY period_end DESC, broadcast_date DESC) AS fn FROM pickbs) WHERE fn = 1",
    carried="SELECT f.as_of, f.isin, f.period_end, COALESCE(f.net_worth, b.net_worth) AS net_worth, COALESCE(f.total_debt, b.total_debt) AS total_debt, b.as_of - b.period_end AS balance_sheet_age_days, f.shares_outstanding FROM fasof f LEFT JOIN bsrc b ON b.as_of = f.as_of AND b.isin = f.isin",
    rec="SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin ORDER BY period_end DESC) AS rn FROM pickc",
    ttm="SELECT as_of, isin, SUM(pat) AS ttm_pat, SUM(revenue) AS ttm_revenue FROM rec WHERE rn <= 4 GROUP BY 1, 2 HAVING COUNT(*) = 4 AND COUNT(pat) = 4 AND MAX(period_end) - MIN(period_end) BETWEEN 240 AND 460",
    caps="SELECT f.as_of, f.isin, b.close * f.shares_outstanding AS market_cap FROM fasof f JOIN bars b ON b.date = f.as_of AND b.isin = f.isin WHERE b.close * f.shares_outstanding > 0",
    ffac="""SELECT c.as_of, c.isin, t.ttm_pat / m.market_cap AS earnings_yield, CASE WHEN c.net_worth > 0 THEN c.net_worth / m.market_cap END AS book_to_price, CASE WHEN c.net_worth > 0 THEN t.ttm_pat / c.net_worth END AS roe,
        CASE WHEN t.ttm_revenue > 0 THEN t.ttm_pat / t.ttm_revenue END AS gross_margin, CASE WHEN c.net_worth > 0 THEN c.total_debt / c.net_worth END AS debt_to_equity FROM carried c LEFT JOIN caps m ON m.as_of = c.as_of AND m.isin = c.isin LEFT JOIN ttm t ON t.as_of = c.as_of AND t.isin = c.isin""",
    stab="SELECT as_of, isin, 1 / greatest(stddev_samp(pat) / AVG(abs(pat)), 0.02) AS earnings_stability FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin ORDER BY period_end DESC) AS rn FROM pickb) WHERE rn <= 8 GROUP BY 1, 2 HAVING COUNT(pat) >= 6 AND AVG(abs(pat)) > 0",
    gro="SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of, isin ORDER BY period_end DESC) AS rn FROM pickb WHERE net_worth IS NOT NULL) WHERE rn <= 6",
    growth="""SELECT as_of, isin, now / was - 1 AS asset_growth FROM (SELECT n.as_of, n.isin, n.net_worth AS now, p.net_worth AS was, abs(p.period_end - (n.period_end - 365)) AS gap, ROW_NUMBER() OVER (PARTITION BY n.as_of, n.isin ORDER BY abs(p.period_end - (n.period_end - 365)), p.rn) AS k
        FROM gro n JOIN gro p ON p.as_of = n.as_of AND p.isin = n.isin AND p.rn > 1 WHERE n.rn = 1 AND (SELECT MAX(rn) FROM gro g WHERE g.as_of = n.as_of AND g.isin = n.isin) >= 5) WHERE k = 1 AND gap <= 75 AND was > 0""",
    tday="SELECT *, CAST(ts + INTERVAL '330' MINUTE AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM tick",
    prev="SELECT symbol, COALESCE(arg_max(price, ts) FILTER (day < (SELECT MAX(day) FROM tday)), MAX(price) FILTER (n = 2)) AS prev_close FROM tday GROUP BY 1",
    lastp="SELECT symbol, arg_max(price, ts) AS price, MAX(ts) AS last_bar FROM tick GROUP BY 1",
    fore="SELECT DISTINCT CONCAT('U', CAST(user_id AS VARCHAR)) AS symbol, 20.0 + user_id % 40 AS forecast FROM events",
    surp="""SELECT l.symbol, price, prev_close, last_bar, price / prev_close - 1 AS move, forecast, forecast / 100 / sqrt(252) * sqrt(2 / pi()) AS expected_move, abs(price / prev_close - 1) / (forecast / 100 / sqrt(252) * sqrt(2 / pi())) AS surprise
        FROM lastp l JOIN prev p ON p.symbol = l.symbol JOIN fore f ON f.symbol = l.symbol WHERE prev_close > 0""",
)


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark, sf_dir).select(F.col("form_date").alias("as_of"))


@once
def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings, written once: what is known and at which dates are taken from them apart."""
    return adapters.filings(spark, sf_dir)


@once
def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.as_of(_filings(spark, sf_dir), _dates(spark, sf_dir), config(spark, sf_dir).filing_age)


@once
def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.carry_balance_sheet(_found(spark, sf_dir), _filings(spark, sf_dir), _dates(spark, sf_dir), config(spark, sf_dir).balance_age)


def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_table(spark, sf_dir)
    return ops.market_caps(_found(spark, sf_dir), bars, bars.select("date").distinct())


R = lambda *cols, digits=6: ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
RATIOS = ("earnings_yield", "book_to_price", "roe", "gross_margin", "debt_to_equity")


@query("SELECT isin, period_end, broadcast_date, consolidated, round(pat, 4) AS pat FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY isin, period_end ORDER BY consolidated DESC, broadcast_date DESC) AS pn FROM fil) WHERE pn = 1")
def pick_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.pick_per_period(adapters.filings(spark, sf_dir), []).select("isin", "period_end", "broadcast_date", "consolidated", "pat"), 4)


@query("SELECT as_of, isin, period_end, broadcast_date, consolidated, round(pat, 4) AS pat FROM fasof")
def filings_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_found(spark, sf_dir).select("as_of", "isin", "period_end", "broadcast_date", "consolidated", "pat"), 4)


@query("SELECT as_of, isin, round(net_worth, 4) AS net_worth, round(total_debt, 4) AS total_debt, balance_sheet_age_days FROM carried")
def balance_sheet_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_carried(spark, sf_dir).select("as_of", "isin", "net_worth", "total_debt", "balance_sheet_age_days"), 4)


@query("SELECT as_of, isin, round(ttm_pat, 4) AS ttm FROM ttm")
def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.trailing_sum(_filings(spark, sf_dir), _dates(spark, sf_dir), "pat"), 4)


@query(f"SELECT as_of, isin, {R('earnings_stability')} FROM stab")
def earnings_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.earnings_stability(_filings(spark, sf_dir), _dates(spark, sf_dir)))


@query(f"SELECT as_of, isin, {R('asset_growth')} FROM growth")
def asset_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.asset_growth(_filings(spark, sf_dir), _dates(spark, sf_dir)))


@query("SELECT as_of, isin, round(market_cap, 4) AS market_cap FROM caps")
def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_caps(spark, sf_dir), 4)


@query(f"SELECT as_of, isin, {R(*RATIOS)} FROM ffac")
def fund_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, d = _filings(spark, sf_dir), _dates(spark, sf_dir)
    return rounded(ops.fund_factors(_carried(spark, sf_dir), _caps(spark, sf_dir), ops.trailing_sum(f, d, "pat"), ops.trailing_sum(f, d, "revenue")))


@query("""SELECT COUNT(*) AS n, round(AVG(CASE WHEN consolidated THEN 1.0 ELSE 0.0 END), 6) AS consolidated, round(AVG(lag), 6) AS mean, round(quantile_cont(lag, 0.25), 6) AS p25, round(quantile_cont(lag, 0.5), 6) AS p50, round(quantile_cont(lag, 0.9), 6) AS p90,
    round(quantile_cont(lag, 0.99), 6) AS p99, round(AVG(CASE WHEN lag > 120 THEN 1.0 ELSE 0.0 END), 6) AS late FROM (SELECT consolidated, broadcast_date - period_end AS lag FROM fil)""")
def reporting_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.reporting_lag(adapters.filings(spark, sf_dir)))


@query("SELECT COUNT(DISTINCT (isin, period_end)) AS quarters, round(AVG(CASE WHEN net_worth IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS net_worth, round(AVG(CASE WHEN pat IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS pat FROM fil")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.field_coverage(adapters.filings(spark, sf_dir), ["net_worth", "pat"]))


@query("""SELECT isin, symbol, CAST(broadcast_date AS TIMESTAMP) + INTERVAL '10' HOUR AS broadcast_date, consolidated, true AS audited, CONCAT('https://host/xbrl/', symbol, '.XML') AS xbrl_url, CAST(shares_outstanding AS BIGINT) AS seq FROM fil WHERE shares_outstanding % 3 <> 0""")
def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing metadata written as JSON lines and read back; links that are no documents are dropped."""
    link = F.when(F.col("shares_outstanding") % 3 == 0, "-").otherwise(F.concat(F.lit("https://host/xbrl/"), F.col("symbol"), F.lit(".XML")))
    when = F.date_format(F.col("broadcast_date").cast("timestamp") + F.expr("interval 10 hours"), "dd-MMM-yyyy HH:mm:ss")
    record = F.struct("isin", "symbol", link.alias("xbrl"), when.alias("broadCastDate"), F.when(F.col("consolidated"), "Consolidated").otherwise("Standalone").alias("consolidated"), F.lit("Audited").alias("audited"), F.col("shares_outstanding").cast("long").cast("string").alias("seqNumber"))
    return ops.index_rows(adapters.filings(spark, sf_dir).select(F.to_json(record).alias("record")))


@query("""SELECT o_orderkey AS doc_id, d AS period_start, CAST(d + INTERVAL '89' DAY AS DATE) AS period_end, 89 AS quarter_days, c * 1000 AS revenue, CASE WHEN o_orderkey % 4 <> 0 THEN c END AS pat,
    CASE WHEN o_orderkey % 6 <> 0 AND c <> 0 THEN c END AS shares_outstanding, c + CASE WHEN o_orderkey % 2 = 0 THEN c ELSE 0 END AS net_worth, CASE WHEN o_orderkey % 8 <> 0 THEN c END AS total_debt, CAST(d + INTERVAL '89' DAY AS DATE) AS balance_sheet_date
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DOUBLE) AS c FROM orders) WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def xbrl_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly records of documents with several spans and instants; those without a quarter, without dates or damaged give none."""
    found = ops.quarter_facts(adapters.xml_documents(spark, sf_dir))
    return rounded(found.select("doc_id", "period_start", "period_end", "quarter_days", "revenue", "pat", "shares_outstanding", "net_worth", "total_debt", "balance_sheet_date"))


@query("SELECT isin, symbol, CAST(broadcast_date AS TIMESTAMP) + INTERVAL '10' HOUR AS broadcast_date, consolidated FROM fil WHERE strftime(broadcast_date, '%Y-%m') BETWEEN '1994-01' AND '1996-12'")
def filing_index_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of three years, month files of JSON lines written and read back by month."""
    when = F.date_format(F.col("broadcast_date").cast("timestamp") + F.expr("interval 10 hours"), "dd-MMM-yyyy HH:mm:ss")
    record = F.struct("isin", "symbol", F.lit("https://host/xbrl/a.xml").alias("xbrl"), when.alias("broadCastDate"), F.when(F.col("consolidated"), "Consolidated").otherwise("Standalone").alias("consolidated"))
    place = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows = adapters.filings(spark, sf_dir).select(F.date_format("broadcast_date", "yyyy-MM").alias("month"), F.to_json(record).alias("value"))
    rows.repartition("month").write.partitionBy("month").text(place)
    stored = spark.read.schema("value string, month string").text(place).withColumnRenamed("value", "record")
    return ops.index_months(stored, "1994-01", "1996-12").select("isin", "symbol", "broadcast_date", "consolidated")


@query("SELECT year(broadcast_date) AS year, COUNT(*) AS n FROM fil GROUP BY 1")
def filings_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.per_year(adapters.filings(spark, sf_dir))


@query("SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) / CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS shares_outstanding, round(o_custkey + COALESCE(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, 0), 4) AS net_worth, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 4) END AS total_debt FROM orders")
def derived_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    rows = o.select(key.alias("k"), F.col("o_custkey").cast("double").alias("paid_up"), (key % 4).cast("double").alias("face_value"), F.when(key % 3 > 0, F.col("o_totalprice")).alias("other_equity"), F.when(key % 5 > 0, F.col("o_totalprice")).alias("borrowings_noncurrent"), F.lit(None).cast("double").alias("borrowings_current"))
    done = ops.derived(rows)
    return done.select("k", "shares_outstanding", F.round("net_worth", 4).alias("net_worth"), F.round("total_debt", 4).alias("total_debt"))


@query("SELECT b.date, b.isin, round(CASE WHEN b.date = (SELECT MAX(date) FROM bars) THEN b.close * 1.01 ELSE b.close END, 6) AS close FROM bars b")
def upsert_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest session re-published with corrected closes; the correction wins."""
    bars = bars_table(spark, sf_dir).select("date", "isin", "close")
    fresh = bars.join(F.broadcast(bars.agg(F.max("date").alias("date"))), "date").withColumn("close", F.col("close") * 1.01).select("date", "isin", "close")
    return rounded(live.upsert(bars, fresh, ["date", "isin"]))


@query("SELECT date, isin, round(close, 6) AS close FROM bars")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel cut ten sessions early, brought up to date; stored sessions are not added again."""
    bars = bars_table(spark, sf_dir).select("date", "isin", "close")
    cut = F.broadcast(bars.agg(F.date_sub(F.max("date"), 70).alias("cut")))
    return rounded(live.append_new(bars.join(cut, F.col("date") <= F.col("cut")).drop("cut"), bars))


@query("SELECT date, isin, round(CASE WHEN isin LIKE '%7A' THEN close / 3 WHEN isin LIKE '%3A' AND date >= (SELECT MAX(date) - 200 FROM bars) THEN close * 0.9 ELSE close END, 6) AS close FROM bars")
def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel drained from files in three waves, with corrections of a key inside a file, a batch and over batches; the last one is often the smallest."""
    place = f"{shared_dir(spark)}/append-{uuid.uuid4().hex}"
    bars = bars_table(spark, sf_dir).select("date", "isin", "close")
    cut = F.broadcast(bars.agg(F.date_sub(F.max("date"), 200).alias("cut")))
    bars = stored(bars.join(cut).select("date", "isin", "close", "cut"), "append-bars")
    old, new, close = F.col("date") < F.col("cut"), F.col("date") >= F.col("cut"), F.col("close")

    def land(rows: DataFrame, value) -> None:
        rows.select("date", "isin", value.alias("close")).write.mode("append").parquet(f"{place}/in")

    def drain() -> DataFrame:
        live.run_append(spark, f"{place}/in", bars.drop("cut").schema, f"{place}/panel", f"{place}/cp", ["date", "isin"])
        return live.appended(spark, f"{place}/panel")

    land(bars.where(old), close * 5)
    land(bars.where(old).sortWithinPartitions("date"), close)  # the same keys again in the first batch
    drain()
    sevens = bars.where(F.col("isin").endswith("7A"))
    land(bars.where(new), close)
    land(sevens.where(old), close * 9)
    land(sevens.withColumn("k", F.explode(F.array(F.lit(4), F.lit(2)))).coalesce(1), close * F.col("k"))
    drain()
    land(sevens, close / 3)
    land(bars.where(new & F.col("isin").endswith("3A")), close * 0.9)
    return rounded(drain())


@query("""SELECT COUNT(DISTINCT date) FILTER (date > cut) AS sessions_added, MAX(date) AS latest, COUNT(DISTINCT date) AS sessions, COUNT(*) AS bars
    FROM bars, (SELECT CAST(MAX(date) - INTERVAL '70' DAY AS DATE) AS cut FROM bars)""")
def append_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append added and what the panel holds after it."""
    bars = bars_table(spark, sf_dir).select("date", "isin", "close")
    cut = F.broadcast(bars.agg(F.date_sub(F.max("date"), 70).alias("cut")))
    return live.append_result(bars.join(cut, F.col("date") <= F.col("cut")).drop("cut"), bars)


@query("""SELECT date AS last, date_diff('day', date, (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders)) AS age_days, date_diff('day', date, (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders)) <= 5 AS fresh
    FROM (SELECT MAX(date) AS date FROM bars WHERE date < (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders))""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age of the panel on the day of the newest order."""
    today = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max(F.col("o_orderdate").cast("date")).alias("today"))
    rows = bars_table(spark, sf_dir).select("date").join(F.broadcast(today), F.col("date") < F.col("today"))
    return rounded(live.freshness(rows, F.col("today")))


@query("SELECT symbol, ts, round(price, 6) AS price, isodow(ts + INTERVAL '330' MINUTE) < 6 AND CAST(ts + INTERVAL '330' MINUTE AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00.999999' AS open FROM tick")
def market_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adapters.ticks(spark, sf_dir).withColumn("open", live.market_open(F.col("ts"))))


@query("SELECT symbol, time_bucket(INTERVAL '5' MINUTE, ts) AS start, round(arg_min(price, ts), 6) AS open, round(MAX(price), 6) AS high, round(MIN(price), 6) AS low, round(arg_max(price, ts), 6) AS close, COUNT(*) AS n FROM (SELECT DISTINCT symbol, ts, price FROM tick) GROUP BY 1, 2")
def bars_5m_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of ticks that arrive as files of a stream, repeated ticks dropped, under a watermark."""
    place = f"{shared_dir(spark)}/ticks-{uuid.uuid4().hex}"
    ticks = adapters.ticks(spark, sf_dir)
    ticks.unionByName(ticks.where("price > 100")).write.parquet(f"{place}/in")
    bars = live.run_bars_5m(spark, spark.readStream.schema(ticks.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/cp")
    return rounded(bars.withColumn("start", F.col("start").cast(ticks.schema["ts"].dataType)))


#: Symbols of a wide file, on average. A file also ends with its month, so none grows with the feed.
WIDE = 64


def land_wide(ticks: DataFrame, place: str) -> None:
    """Ticks as wide files: a header with the symbols of a file under the feed's names, and one line a time.

    Symbols are dealt over as many files as ``WIDE`` asks for, so lines keep their width however many symbols there are.
    """
    files = max(12, -(-ticks.select("symbol").distinct().count() // WIDE))
    key = ["file", "month"]
    dealt = ticks.select(F.pmod(F.xxhash64("symbol"), F.lit(files)).alias("file"), F.date_format("ts", "yyyyMM").alias("month"), "symbol", F.col("ts").cast("string").alias("ts"), "price")
    one = dealt.repartition(*key).groupBy(*key, "symbol", "ts").agg(F.max("price").alias("price"))
    names = one.groupBy(*key).agg(F.sort_array(F.collect_set("symbol")).alias("names"))
    lines = one.groupBy(*key, "ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "price"))).alias("m")).join(names, key)
    cells = F.transform("names", lambda s: F.coalesce(F.try_element_at("m", s).cast("string"), F.lit("")))
    text = lines.select(*key, "names", "ts", F.concat_ws(",", "ts", cells).alias("line"))
    text = text.groupBy(*key).agg(F.concat_ws(",", F.lit("Datetime"), F.transform(F.first("names"), lambda s: F.concat(s, F.lit(live.SUFFIX)))).alias("head"), F.sort_array(F.collect_list("line")).alias("lines"))
    text.select(*key, F.concat_ws("\n", "head", F.array_join("lines", "\n")).alias("value")).write.partitionBy(*key).text(place)


@query("SELECT symbol, time_bucket(INTERVAL '5' MINUTE, ts) AS start, round(arg_min(price, ts), 6) AS open, round(MAX(price), 6) AS high, round(MIN(price), 6) AS low, round(arg_max(price, ts), 6) AS close, COUNT(*) AS n FROM (SELECT symbol, ts, MAX(price) AS price FROM tick GROUP BY 1, 2) GROUP BY 1, 2")
def bars_5m_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of a stream of wide files, each with columns of its own."""
    place = f"{shared_dir(spark)}/wide-{uuid.uuid4().hex}"
    ticks = adapters.ticks(spark, sf_dir)
    land_wide(ticks, f"{place}/in")
    files = spark.readStream.text(f"{place}/in", wholetext=True)
    bars = live.run_bars_5m(spark, live.wide_ticks(files), f"{place}/out", f"{place}/cp")
    return rounded(bars.withColumn("start", F.col("start").cast(ticks.schema["ts"].dataType)))


@query("SELECT symbol, round(price, 6) AS price, round(move, 6) AS move, round(surprise, 6) AS surprise FROM surp WHERE CAST(last_bar + INTERVAL '330' MINUTE AS DATE) = (SELECT CAST(MAX(ts) + INTERVAL '330' MINUTE AS DATE) FROM tick)")
def monitor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live monitor over ticks that land in three waves after an empty one; prices of earlier days have expired."""
    place = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    ticks = adapters.ticks(spark, sf_dir)
    thirds = F.ntile(3).over(Window.orderBy("day"))  # one row a day
    days = ticks.select(live.session_date(F.col("ts")).alias("day")).distinct().withColumn("wave", thirds)
    waved = stored(ticks.withColumn("day", live.session_date(F.col("ts"))).join(F.broadcast(days), "day"), "waves")
    for wave in range(4):
        waved.where(F.col("wave") == wave).select("symbol", "ts", "price").write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(ticks.schema).parquet(f"{place}/in")
        live.run_monitor(spark, stream, live.previous_close(ticks), _forecasts(spark, sf_dir), f"{place}/out", f"{place}/cp")
    return rounded(live.monitored(spark, f"{place}/out")[0].select("symbol", "price", "move", "surprise"))


@query("SELECT symbol, round(prev_close, 6) AS prev_close FROM prev")
def previous_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(live.previous_close(adapters.ticks(spark, sf_dir)))


@query("SELECT symbol, time_bucket(INTERVAL '5' MINUTE, ts) AS start, round(arg_min(price, ts), 6) AS open, round(MAX(price), 6) AS high, round(MIN(price), 6) AS low, round(arg_max(price, ts), 6) AS close, COUNT(*) AS n FROM tick GROUP BY 1, 2")
def bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(live.bars_5m(adapters.ticks(spark, sf_dir)))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), (20.0 + F.col("user_id") % 40).alias("forecast")).distinct()


def _surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = adapters.ticks(spark, sf_dir)
    return live.surprise(live.latest_price(ticks), live.previous_close(ticks), _forecasts(spark, sf_dir))


@query(f"SELECT symbol, {R('price', 'prev_close', 'move', 'expected_move', 'surprise')} FROM surp")
def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_surprise(spark, sf_dir).select("symbol", "price", "prev_close", "move", "expected_move", "surprise"))


@query("SELECT symbol, round(surprise, 6) AS surprise FROM surp ORDER BY surp.surprise DESC, symbol LIMIT 25")
def top_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_surprise(spark, sf_dir).orderBy(F.desc("surprise"), "symbol").limit(25).select("symbol", "surprise"))


@query("SELECT COUNT(*) AS scored, COUNT(*) FILTER (surprise >= 2.5) AS hot FROM surp")
def hot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surprise(spark, sf_dir).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("surprise") >= 2.5).alias("hot"))


@query()
def live_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor's JSON document."""
    return live.live_payload(_surprise(spark, sf_dir))


PAYLOAD = "available boolean, reason string, scored long, hot long, rows array<struct<symbol:string,price:double,move:double,surprise:double>>"


@query("""SELECT true AS available, (SELECT COUNT(*) FROM surp) AS scored, (SELECT COUNT(*) FROM surp WHERE surprise >= 2.5) AS hot, symbol, round(price, 6) AS price, round(move, 6) AS move, round(surprise, 6) AS surprise
    FROM (SELECT * FROM surp ORDER BY surprise DESC, symbol LIMIT 25)""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor's document read back."""
    doc = live_payload(spark, sf_dir).select(F.from_json("payload", PAYLOAD).alias("d")).select("d.*")
    return rounded(doc.select("available", "scored", "hot", F.explode("rows").alias("r")).select("available", "scored", "hot", "r.*"))
