"""Panel-shaped tables derived from the star-schema tables; one SQL text serves Spark and other engines, but for the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import dealt
from tidepanel.operators.calendar import calendar, indexed

BARS = """WITH cell AS (SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    AVG(l_discount) - 0.05 AS r, SUM(l_extendedprice) AS turnover, SUM(l_quantity) AS volume,
    COUNT(*) AS trades, MAX(l_tax) AS tx, MIN(l_tax) AS tn
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS s FROM (SELECT DISTINCT date FROM cell) q),
c AS (SELECT cell.*, cal.s, ROW_NUMBER() OVER (PARTITION BY k ORDER BY cell.date) AS n,
    SUM(r) OVER (PARTITION BY k ORDER BY cell.date) AS cr,
    CASE WHEN (k * 7 + cal.s) % 97 = 0 THEN 1 ELSE 0 END AS ex
  FROM cell JOIN cal ON cell.date = cal.date),
d AS (SELECT c.*, SUM(CASE WHEN n = 1 THEN 0 ELSE ex END) OVER (PARTITION BY k ORDER BY date) AS nsplit FROM c),
e AS (SELECT d.*, 100 * EXP(cr) * POWER(0.5, nsplit) AS close FROM d)
SELECT date, CONCAT('S', CAST(k AS VARCHAR(20))) AS symbol,
  CONCAT('INE', CAST(k AS VARCHAR(20)), CASE WHEN k % 5 IN (0, 1) AND s >= 180 THEN 'B' ELSE 'A' END) AS isin,
  close AS open, close * (1 + tx) AS high, close * (1 - tn / 2) AS low, close,
  COALESCE(100 * EXP(LAG(cr) OVER (PARTITION BY k ORDER BY date)) * POWER(0.5, nsplit), close) AS prevclose,
  volume, turnover, trades
FROM e WHERE NOT (k % 5 = 1 AND s BETWEEN 170 AND 185)"""

#: Daily bars of the suppliers' nations; each line trades on three days, so that most nations trade on most days.
DAILY = """WITH t AS (SELECT s_nationkey AS k, CAST(l_shipdate AS DATE) AS d, l_discount, l_extendedprice, l_quantity, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
f AS (SELECT k, d AS date, l_discount, l_extendedprice, l_quantity, l_tax FROM t UNION ALL SELECT k, CAST(d + INTERVAL '30' DAY AS DATE), l_discount, l_extendedprice, l_quantity, l_tax FROM t
  UNION ALL SELECT k, CAST(d + INTERVAL '61' DAY AS DATE), l_discount, l_extendedprice, l_quantity, l_tax FROM t),
cell AS (SELECT k, date, (AVG(l_discount) - 0.05) * (1 + EXTRACT(month FROM date) % 3) / 2 AS r, 1000 * SUM(l_extendedprice) AS turnover, SUM(l_quantity) AS volume, COUNT(*) AS trades, MAX(l_tax) AS tx, MIN(l_tax) AS tn FROM f GROUP BY 1, 2),
c AS (SELECT *, 100 * EXP(SUM(r) OVER (PARTITION BY k ORDER BY date)) AS close FROM cell)
SELECT date, CONCAT('N', CAST(k AS VARCHAR(20))) AS symbol, CONCAT('INE', CAST(k AS VARCHAR(20)), 'N') AS isin, close AS open, close * (1 + tx / 4) AS high, close * (1 - tn / 4) AS low, close,
  COALESCE(LAG(close) OVER (PARTITION BY k ORDER BY date), close) AS prevclose, volume, turnover, trades FROM c"""

FILINGS = """WITH q AS (SELECT o_custkey % (SELECT COUNT(*) FROM supplier) AS k,
    CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start,
    CASE WHEN o_orderstatus = 'F' THEN true ELSE false END AS consolidated,
    SUM(o_totalprice) AS revenue, SUM(o_totalprice * ((o_orderkey % 7) - 1)) / 50 AS pat, COUNT(*) AS n
  FROM orders GROUP BY 1, 2, 3)
SELECT CONCAT('INE', CAST(k AS VARCHAR(20)), 'A') AS isin, CONCAT('S', CAST(k AS VARCHAR(20))) AS symbol,
  period_start, last_day(period_start + INTERVAL '2' MONTH) AS period_end,
  CAST(last_day(period_start + INTERVAL '2' MONTH) + CAST(30 + (k * 13 + n * 5) % 60 + CASE WHEN consolidated THEN 10 ELSE 0 END AS INT) AS DATE) AS broadcast_date,
  consolidated, revenue, pat,
  CASE WHEN EXTRACT(month FROM period_start) IN (1, 7) THEN revenue * 2 - 100000.0 * (k % 3) END AS net_worth,
  CASE WHEN EXTRACT(month FROM period_start) IN (1, 7) THEN revenue * 0.5 END AS total_debt,
  CAST(1000 + k % 50 AS DOUBLE) AS shares_outstanding
FROM q"""

INDEX_LEVELS = """WITH r AS (SELECT n_regionkey AS g, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, AVG(l_discount) - 0.05 AS r
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT date, r_name AS index_name, 1000 * EXP(SUM(r) OVER (PARTITION BY g ORDER BY date)) AS close,
  CAST(1 + g * 0.1 AS DOUBLE) AS div_yield FROM r JOIN region ON g = r_regionkey"""

TICKS = """SELECT CONCAT('U', CAST(user_id AS VARCHAR(20))) AS symbol, ts, 100 + value AS price FROM events WHERE event_type <> 'error'"""

_DAY = "CAST(CAST({} AS DATE) AS VARCHAR(20))"
_FACT = "'<in:{} contextRef=\"{}\">', {}, '</in:{}>'"


def _fact(tag: str, context: str, value: str) -> str:
    return _FACT.format(tag, context, value, tag)


#: One document an order: a quarter, a longer quarter, the year to date and two instants; some lack dates or don't parse.
XML = f"""SELECT k AS doc_id, CONCAT('<x xmlns:in="http://x" xmlns:b="http://b">',
 '<b:context id="I0"><b:period><b:instant>', {_DAY.format("d - INTERVAL '200' DAY")}, '</b:instant></b:period></b:context><b:context id="I1"><b:period><b:instant>', {_DAY.format("e")}, '</b:instant></b:period></b:context>',
 CASE WHEN k % 11 = 0 THEN '' ELSE CONCAT({_fact("DateOfStartOfReportingPeriod", "FourD", _DAY.format("d - INTERVAL '91' DAY"))}, {_fact("DateOfStartOfReportingPeriod", "OneD", _DAY.format("d"))}, {_fact("DateOfStartOfReportingPeriod", "Alt", _DAY.format("d"))}) END,
 {_fact("DateOfEndOfReportingPeriod", "OneD", _DAY.format("e"))}, {_fact("DateOfEndOfReportingPeriod", "FourD", _DAY.format("e"))}, {_fact("DateOfEndOfReportingPeriod", "Alt", _DAY.format("e + INTERVAL '6' DAY"))},
 {_fact("RevenueFromOperations", "OneD", "CONCAT(c, ',000')")}, {_fact("RevenueFromOperations", "FourD", "CONCAT(c, ',999')")}, {_fact("ProfitLossForPeriod", "FourD", "c")},
 CASE WHEN k % 4 = 0 THEN '' ELSE CONCAT({_fact("ProfitLossForPeriod", "OneD", "c")}) END,
 {_fact("PaidUpValueOfEquityShareCapital", "OneD", "CONCAT(c, '0')")}, {_fact("FaceValueOfEquityShareCapital", "OneD", "CASE WHEN k % 6 = 0 THEN '0' ELSE '10' END")},
 {_fact("EquityShareCapital", "I1", "c")}, {_fact("EquityShareCapital", "I0", "'1'")}, CASE WHEN k % 2 = 0 THEN CONCAT({_fact("OtherEquity", "I1", "c")}) ELSE '' END,
 {_fact("BorrowingsNoncurrent", "I0", "c")}, {_fact("BorrowingsCurrent", "I1", "CASE WHEN k % 8 = 0 THEN 'n/a' ELSE c END")}, CASE WHEN k % 13 = 0 THEN '' ELSE '</x>' END) AS doc
FROM (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR(20)) AS c, CAST(o_orderdate AS DATE) AS d,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + INTERVAL '120' DAY ELSE CAST(o_orderdate AS DATE) + INTERVAL '89' DAY END AS e FROM orders) q"""

TABLES = {
    DAILY: ("lineitem", "supplier"),
    FILINGS: ("orders", "supplier"),
    INDEX_LEVELS: ("lineitem", "supplier", "nation", "region"),
    TICKS: ("events",),
}


def _over(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an adapter over the tables of ``sf_dir``."""
    for name in TABLES[text]:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``BARS`` by one shuffle: lines are dealt by supplier, and cells, running sums and lags follow in the same task."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    week = lambda day: F.trunc(day, "week").alias("date")
    lines = table.select(F.col("l_suppkey").alias("k"), week(F.to_date("l_shipdate")), "l_discount", "l_extendedprice", "l_quantity", "l_tax")
    days = table.select(F.to_date("l_shipdate").alias("day")).distinct()
    cells = dealt(lines, "k", table.count(), 1 << 19).groupBy("k", "date").agg(
        (F.avg("l_discount") - 0.05).alias("r"), F.sum("l_extendedprice").alias("turnover"), F.sum("l_quantity").alias("volume"),
        F.count(F.lit(1)).alias("trades"), F.max("l_tax").alias("tx"), F.min("l_tax").alias("tn"),
    )
    w = Window.partitionBy("k").orderBy("date")
    k, s = F.col("k"), F.col("s")
    ex = F.when((F.row_number().over(w) > 1) & ((k * 7 + s) % 97 == 0), 1).otherwise(0)
    rows = indexed(cells, calendar(days.select(week("day")))).withColumns({"cr": F.sum("r").over(w), "ex": ex}).withColumn("half", F.pow(F.lit(0.5), F.sum("ex").over(w)))
    rows = rows.where(~((k % 5 == 1) & s.between(170, 185)))  # lags go over the weeks that are left
    rows = rows.withColumns({"close": 100 * F.exp("cr") * F.col("half"), "before": 100 * F.exp(F.lag("cr").over(w)) * F.col("half")})
    name = k.cast("string")
    isin = F.concat(F.lit("INE"), name, F.when((k % 5).isin(0, 1) & (s >= 180), "B").otherwise("A"))
    return rows.select(
        "date", F.concat(F.lit("S"), name).alias("symbol"), isin.alias("isin"), F.col("close").alias("open"), (F.col("close") * (1 + F.col("tx"))).alias("high"), (F.col("close") * (1 - F.col("tn") / 2)).alias("low"), "close",
        F.coalesce("before", "close").alias("prevclose"), "volume", "turnover", "trades",
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, DAILY)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, FILINGS)


def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, INDEX_LEVELS)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, TICKS)


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document an order, written (and then read) by as many tasks as there are documents for, however few files the orders are in."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dealt(orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", orders.count(), 1 << 16).createOrReplaceTempView("orders")
    return spark.sql(XML)
