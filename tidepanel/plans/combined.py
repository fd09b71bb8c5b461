"""Queries that combine price and fundamental factors, and the report document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import factors
from tidepanel.operators import filings as ops
from tidepanel.plans.registry import CTES, config, cte, query, rounded
from tidepanel.plans.reports import RATIOS, _dates, _filings, fund_factors
from tidepanel.plans.research import NAMES, _perf, _raw, exposure, ic_table, shortlist

EXTRA = {f: ops.FUND_SIGNS[f] for f in RATIOS}

cte(
    elong="SELECT * FROM flong UNION ALL "
    + " UNION ALL ".join(f"SELECT u.form_date, u.isin, '{f}' AS factor, round(f.{f}, 6) AS x, {s} AS sign FROM uni u LEFT JOIN ffac f ON f.as_of = u.form_date AND f.isin = u.isin" for f, s in EXTRA.items()),
    eclip="SELECT f.*, CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END AS c FROM elong f JOIN (SELECT factor, form_date, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM elong GROUP BY 1, 2) q USING (factor, form_date)",
    ez="""SELECT c.factor, c.form_date, c.isin, CASE WHEN n >= (SELECT zmin FROM cfg) AND c.c IS NOT NULL THEN CASE WHEN sd > 0 THEN (c.c - m) / sd ELSE 0 END * sign END AS z
        FROM eclip c JOIN (SELECT factor, form_date, COUNT(c) AS n, AVG(c) AS m, stddev_samp(c) AS sd FROM eclip GROUP BY 1, 2) USING (factor, form_date)""",
)


@query("SELECT form_date, isin, round(CASE WHEN COUNT(z) >= 5 THEN AVG(z) END, 5) AS composite FROM ez GROUP BY 1, 2")
def fund_plus_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite over price and fundamental factors standardised over the same members; half of them must be there."""
    extra = fund_factors(spark, sf_dir).withColumnRenamed("as_of", "form_date")
    rows, signs = factors.with_extra(_raw(spark, sf_dir), extra, factors.PRICE_SIGNS, EXTRA)
    z = factors.zscores(rows, signs, config(spark, sf_dir))
    return rounded(factors.composite(z, [*NAMES, *EXTRA], require_all=False).select("form_date", "isin", "composite"), 5)


ALL = EXTRA | {f: ops.FUND_SIGNS[f] for f in ("earnings_stability", "asset_growth")}

cte(
    along="SELECT * FROM elong UNION ALL "
    + " UNION ALL ".join(f"SELECT u.form_date, u.isin, '{f}' AS factor, round(t.{f}, 6) AS x, {ALL[f]} AS sign FROM uni u LEFT JOIN {table} t ON t.as_of = u.form_date AND t.isin = u.isin" for f, table in (("earnings_stability", "stab"), ("asset_growth", "growth"))),
    aclip=CTES["eclip"].replace("elong", "along"),
    az=CTES["ez"].replace("eclip", "aclip"),
)


@query("SELECT form_date, isin, round(CASE WHEN COUNT(z) >= 6 THEN AVG(z) END, 5) AS composite FROM az GROUP BY 1, 2")
def all_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite over the five price factors and all seven fundamentals; half of the twelve must be there."""
    f, d = _filings(spark, sf_dir), _dates(spark, sf_dir)
    more = rounded(ops.earnings_stability(f, d)).join(rounded(ops.asset_growth(f, d)), ["as_of", "isin"], "full")
    extra = fund_factors(spark, sf_dir).join(more, ["as_of", "isin"], "full").withColumnRenamed("as_of", "form_date")
    rows, signs = factors.with_extra(_raw(spark, sf_dir), extra.select("form_date", "isin", *ALL), factors.PRICE_SIGNS, ALL)
    z = factors.zscores(rows, signs, config(spark, sf_dir))
    return rounded(factors.composite(z, [*NAMES, *ALL], require_all=False).select("form_date", "isin", "composite"), 5)


def _section(rows: DataFrame, name: str, key: str) -> DataFrame:
    """A table as one array of records, by ``key``."""
    return rows.agg(F.sort_array(F.collect_list(F.struct(key, *(c for c in rows.columns if c != key)))).alias(name))


@query()
def report_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as one nested JSON document: performance, factors, the newest book's sectors and names."""
    book = F.struct(F.col("sectors"), F.col("names")).alias("book")
    parts = _section(rounded(_perf(spark, sf_dir)), "performance", "variant").join(_section(ic_table(spark, sf_dir), "factors", "factor"))
    parts = parts.join(_section(exposure(spark, sf_dir), "sectors", "sector")).join(_section(shortlist(spark, sf_dir), "names", "isin"))
    return parts.select(F.to_json(F.struct("performance", "factors", book)).alias("document"))


REPORT = "performance array<struct<variant:string,cagr:double,sharpe:double>>, factors array<struct<factor:string,mean_ic:double>>, book struct<sectors:array<struct<sector:string,weight:double>>,names:array<struct<isin:string,weight:double>>>"


@query("""SELECT 'performance' AS section, variant AS name, round(sharpe, 6) AS value FROM perf UNION ALL SELECT 'factors', factor, round(mean_ic, 6) FROM ict
    UNION ALL SELECT 'sectors', sector, round(SUM(weight), 6) FROM groupbook WHERE period = (SELECT MAX(period) FROM groupbook) GROUP BY sector UNION ALL SELECT 'names', isin, round(weight, 6) FROM groupbook WHERE period = (SELECT MAX(period) FROM groupbook)""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report document read back, section by section."""
    doc = report_doc(spark, sf_dir).select(F.from_json("document", REPORT).alias("d")).select("d.performance", "d.factors", "d.book.sectors", "d.book.names")
    parts = [doc.select(F.lit(s).alias("section"), F.explode(s).alias("r")).select("section", F.col(f"r.{k}").alias("name"), F.col(f"r.{v}").alias("value")) for s, k, v in (("performance", "variant", "sharpe"), ("factors", "factor", "mean_ic"), ("sectors", "sector", "weight"), ("names", "isin", "weight"))]
    return reduce(DataFrame.unionByName, parts)
