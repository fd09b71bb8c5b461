"""Company filings by publication date: visibility, revisions, balance-sheet carry, trailing sums, fundamental factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import dealt

FUND_SIGNS = {"earnings_yield": 1, "book_to_price": 1, "roe": 1, "gross_margin": 1, "debt_to_equity": -1, "earnings_stability": 1, "asset_growth": -1}
BALANCE = ("net_worth", "total_debt")


def visible(filings: DataFrame) -> DataFrame:
    """Every filing once for each date (as_of) from its own on at which its company published: what is known can only change there.

    The join is by isin; a company's filings meet its own publication dates only, whatever the calendar.
    """
    events = filings.select("isin", F.col("broadcast_date").alias("as_of")).distinct()
    return filings.join(events, "isin").where(F.col("broadcast_date") <= F.col("as_of"))


def at_dates(found: DataFrame, filings: DataFrame, dates: DataFrame) -> DataFrame:
    """``found`` (as_of = a publication date, isin, ...) as it stands on each date: the company's last publication on or before it decides.

    A merge by one sort within each isin; a date on which the last publication has no row in ``found`` gives none.
    """
    names = [c for c in found.columns if c not in ("as_of", "isin")]
    events = filings.select("isin", F.col("broadcast_date").alias("as_of")).distinct()
    known = events.join(found.withColumn("_hit", F.lit(True)), ["isin", "as_of"], "left")
    known = known.select("isin", "as_of", F.lit(0).alias("_kind"), F.struct("_hit", *names).alias("_state"))
    every = dates.agg(F.collect_set("as_of").alias("_dates"))  # one row; as-of dates are sessions of one calendar
    asked = events.select("isin").distinct().join(F.broadcast(every)).select("isin", F.explode("_dates").alias("as_of"), F.lit(1).alias("_kind"), F.lit(None).cast(known.schema["_state"].dataType).alias("_state"))
    w = Window.partitionBy("isin").orderBy("as_of", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(known.unionByName(asked), "isin", filings.count(), 1 << 16).withColumn("_state", F.last("_state", ignorenulls=True).over(w))
    return rows.where("_kind = 1 and _state._hit").select("as_of", "isin", *(F.col(f"_state.{c}").alias(c) for c in names))


def pick_per_period(filings: DataFrame, keys: list[str], prefer_consolidated: bool = True) -> DataFrame:
    """One filing for each isin and period: consolidated first, then the latest broadcast."""
    order = [F.desc("consolidated")] if prefer_consolidated else []
    w = Window.partitionBy(*keys, "isin", "period_end").orderBy(*order, F.desc("broadcast_date"), F.desc("consolidated"))
    return filings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(filings: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "isin").orderBy(F.desc("period_end"), F.desc("broadcast_date"))
    return filings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of(filings: DataFrame, dates: DataFrame, max_age: int) -> DataFrame:
    """The newest period's filing of each isin that was public and not stale on each date (if the newest is stale, so are all)."""
    rows = at_dates(newest(filings), filings, dates)
    return rows.where(F.date_diff("as_of", "period_end") <= max_age)


def carry_balance_sheet(found: DataFrame, filings: DataFrame, dates: DataFrame, max_age: int) -> DataFrame:
    """Missing balance-sheet items from the newest public filing that has a net worth; its age in balance_sheet_age_days."""
    have = filings.where("net_worth is not null")
    rows = at_dates(newest(have).select("as_of", "isin", "period_end", *BALANCE), have, dates)
    age = F.date_diff("as_of", "period_end").cast("long")
    source = rows.where(age <= max_age).select("as_of", "isin", age.alias("balance_sheet_age_days"), *(F.col(c).alias(f"_{c}") for c in BALANCE))
    rows = found.join(source, ["as_of", "isin"], "left")
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in BALANCE}).drop(*(f"_{c}" for c in BALANCE))


def newest(filings: DataFrame) -> DataFrame:
    """The newest period's filing that ``pick_per_period`` prefers, at each date (as_of) at which its company published.

    It is the largest by period, kind and publication of those so far, so a running maximum finds it: no filing meets another.
    """
    rows = filings.where("isin is not null and broadcast_date is not null")
    w = Window.partitionBy("isin").orderBy("broadcast_date").rangeBetween(Window.unboundedPreceding, 0)
    best = F.max_by(F.struct(*filings.columns), F.struct("period_end", "consolidated", "broadcast_date")).over(w)
    found = dealt(rows, "isin", filings.count(), 1 << 16).select(best.alias("_best"), F.col("broadcast_date").alias("as_of"), F.col("isin").alias("_isin")).dropDuplicates(["_isin", "as_of"])
    return found.select("_best.*", "as_of")


def _recent(filings: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("as_of", "isin").orderBy(F.desc("period_end"))
    return filings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def trailing_sum(filings: DataFrame, dates: DataFrame, column: str) -> DataFrame:
    """as_of, isin, ttm: the four newest periods' sum, if all are there and span about a year."""
    rows = _recent(pick_per_period(visible(filings), ["as_of"]), 4)
    span = F.date_diff(F.max("period_end"), F.min("period_end"))
    found = rows.groupBy("as_of", "isin").agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("k"), span.alias("span"), F.sum(column).alias("ttm"))
    return at_dates(found.where("n = 4 and k = 4 and span between 240 and 460").select("as_of", "isin", "ttm"), filings, dates)


def earnings_stability(filings: DataFrame, dates: DataFrame, floor: float = 0.02) -> DataFrame:
    """as_of, isin, earnings_stability over the eight newest periods, six at least; the last broadcast counts."""
    rows = _recent(pick_per_period(visible(filings), ["as_of"], prefer_consolidated=False), 8)
    found = rows.groupBy("as_of", "isin").agg(F.count("pat").alias("n"), F.stddev_samp("pat").alias("sd"), F.avg(F.abs("pat")).alias("scale")).where("n >= 6 and scale > 0")
    return at_dates(found.select("as_of", "isin", (1 / F.greatest(F.col("sd") / F.col("scale"), F.lit(floor))).alias("earnings_stability")), filings, dates)


def asset_growth(filings: DataFrame, dates: DataFrame) -> DataFrame:
    """as_of, isin, asset_growth: net worth against the observation nearest to a year before, within 75 days."""
    rows = pick_per_period(visible(filings), ["as_of"], prefer_consolidated=False).where("net_worth is not null")
    rows = _recent(rows, 6)
    now = rows.where("_r = 1").select("as_of", "isin", F.col("period_end").alias("now_end"), F.col("net_worth").alias("now"))
    enough = rows.groupBy("as_of", "isin").agg(F.max("_r").alias("n")).where("n >= 5").select("as_of", "isin")
    gap = F.abs(F.date_diff("period_end", F.date_sub("now_end", 365)))
    prior = rows.where("_r > 1").join(now, ["as_of", "isin"]).withColumn("gap", gap)
    best = prior.groupBy("as_of", "isin", "now").agg(F.min_by(F.struct("net_worth", "gap"), F.struct("gap", "_r")).alias("p"))
    best = best.where("p.gap <= 75 and p.net_worth > 0").join(enough, ["as_of", "isin"], "left_semi")
    return at_dates(best.select("as_of", "isin", (F.col("now") / F.col("p.net_worth") - 1).alias("asset_growth")), filings, dates)


def market_caps(found: DataFrame, bars: DataFrame, cal: DataFrame) -> DataFrame:
    """as_of, isin, market_cap: raw close of the last session on or before the date times visible shares."""
    dates = found.select("as_of").distinct()
    session = cal.join(F.broadcast(dates), F.col("date") <= F.col("as_of")).groupBy("as_of").agg(F.max("date").alias("date"))
    prices = bars.select("date", "isin", "close").join(F.broadcast(session), "date")
    rows = found.select("as_of", "isin", "shares_outstanding").join(prices, ["as_of", "isin"])
    return rows.withColumn("market_cap", F.col("close") * F.col("shares_outstanding")).where("market_cap > 0").select("as_of", "isin", "market_cap")


def fund_factors(carried: DataFrame, caps: DataFrame, pat: DataFrame, revenue: DataFrame) -> DataFrame:
    """as_of, isin and the ratios; denominators that aren't positive give null."""
    rows = carried.select("as_of", "isin", *BALANCE).join(caps, ["as_of", "isin"], "left")
    rows = rows.join(pat.withColumnRenamed("ttm", "ttm_pat"), ["as_of", "isin"], "left").join(revenue.withColumnRenamed("ttm", "ttm_revenue"), ["as_of", "isin"], "left")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b)))
    book = F.when(F.col("net_worth") > 0, over("net_worth", "market_cap"))
    return rows.select("as_of", "isin", over("ttm_pat", "market_cap").alias("earnings_yield"), book.alias("book_to_price"), over("ttm_pat", "net_worth").alias("roe"), over("ttm_pat", "ttm_revenue").alias("gross_margin"), over("total_debt", "net_worth").alias("debt_to_equity"))


def derived(rows: DataFrame, capital: str = "paid_up") -> DataFrame:
    """shares_outstanding, net_worth (``capital`` and other equity), total_debt from reported items; a sum is null only if both parts are."""
    both = lambda a, b: F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    shares = F.when(F.col("face_value") > 0, F.col("paid_up") / F.when(F.col("face_value") > 0, F.col("face_value")))
    return rows.withColumns({"shares_outstanding": shares, "net_worth": both(capital, "other_equity"), "total_debt": both("borrowings_noncurrent", "borrowings_current")})


def reporting_lag(filings: DataFrame) -> DataFrame:
    """One row: share of consolidated filings and the distribution of days from period end to publication."""
    rows = filings.withColumn("lag", F.date_diff("broadcast_date", "period_end"))
    q = F.percentile("lag", F.array(*map(F.lit, (0.25, 0.5, 0.9, 0.99))))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("consolidated").cast("double")).alias("consolidated"), F.avg("lag").alias("mean"), q.alias("q"), F.avg((F.col("lag") > 120).cast("double")).alias("late"))
    return found.select("n", "consolidated", "mean", *(F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p90", "p99"))), "late")


def field_coverage(filings: DataFrame, fields: list[str]) -> DataFrame:
    """One row: distinct (isin, period) and the share of rows that have each field."""
    return filings.agg(F.count_distinct("isin", "period_end").alias("quarters"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in fields))


def index_rows(records: DataFrame) -> DataFrame:
    """Filing metadata from JSON lines (column ``record``): rows without isin, publication time or a document link are dropped."""
    r = F.from_json("record", "isin string, symbol string, xbrl string, broadCastDate string, consolidated string, audited string, seqNumber string")
    rows = records.select(r.alias("r")).select("r.*")
    when = F.coalesce(*(F.try_to_timestamp("broadCastDate", F.lit(f)) for f in ("dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")))
    link = F.lower("xbrl")
    rows = rows.withColumn("broadcast_date", when).where(F.col("isin").isNotNull() & (F.trim("isin") != "") & F.col("broadcast_date").isNotNull() & link.endswith(".xml") & link.contains("/xbrl/"))
    flag = lambda c, yes: F.lower(F.trim(c)) == yes
    return rows.select(F.trim("isin").alias("isin"), "symbol", "broadcast_date", flag("consolidated", "consolidated").alias("consolidated"), flag("audited", "audited").alias("audited"), F.col("xbrl").alias("xbrl_url"), F.col("seqNumber").try_cast("long").alias("seq"))


#: Element names of the facts (fixed values of the documents).
FLOWS = {"revenue": "RevenueFromOperations", "other_income": "OtherIncome", "pbt": "ProfitBeforeTax", "tax": "TaxExpense", "pat": "ProfitLossForPeriod", "depreciation": "DepreciationDepletionAndAmortisationExpense", "finance_cost": "FinanceCosts", "paid_up": "PaidUpValueOfEquityShareCapital", "face_value": "FaceValueOfEquityShareCapital", "cfo": "CashFlowsFromUsedInOperatingActivities"}
STOCKS = {"share_capital": "EquityShareCapital", "other_equity": "OtherEquity", "borrowings_noncurrent": "BorrowingsNoncurrent", "borrowings_current": "BorrowingsCurrent"}
START, END = "DateOfStartOfReportingPeriod", "DateOfEndOfReportingPeriod"


def quarter_facts(documents: DataFrame) -> DataFrame:
    """One quarter's record of each document (doc_id, doc) that has one.

    The period of a context is what its reported start and end dates say, not what the context itself
    claims. The quarter is the shortest span of 60 to 100 days; flow items come from its context, stock
    items from the instant context nearest to its end. Of facts that repeat, the last counts. Documents
    that don't parse, or have no such dates, give no row.
    """
    fact = "array<struct<_contextRef: string, _VALUE: string>>"
    tags = [START, END, *FLOWS.values(), *STOCKS.values()]
    schema = ", ".join(f"{t} {fact}" for t in tags) + ", context array<struct<_id: string, period: struct<instant: string>>>, _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
    # inline makes a column of what was parsed, so that no filter or later field parses a document again
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))
    rows = documents.select("doc_id", once(F.from_xml("doc", schema, options), "x")).where("x._bad is null")

    def value(tag: str, context: Column) -> Column:
        """The last non-empty value that the tag has in a context."""
        return F.trim(F.get(F.reverse(F.filter(f"x.{tag}", lambda f: (f["_contextRef"] == context) & (F.trim(f["_VALUE"]) != ""))), F.lit(0))["_VALUE"])

    def spans(f: Column, i: Column) -> Column:
        begin, end = F.try_to_date(F.trim(f["_VALUE"])), F.try_to_date(value(END, f["_contextRef"]))
        return F.struct(F.date_diff(end, begin).alias("days"), i.alias("i"), f["_contextRef"].alias("context"), begin.alias("begin"), end.alias("end"))

    def instants(c: Column, i: Column) -> Column:
        day = F.try_to_date(F.trim(c["period"]["instant"]))
        return F.struct(F.abs(F.date_diff(day, F.col("q.end"))).alias("gap"), i.alias("i"), c["_id"].alias("context"), day.alias("day"))

    rows = rows.select("doc_id", "x", once(F.array_min(F.filter(F.transform(f"x.{START}", spans), lambda s: s["days"].between(60, 100))), "q")).where("q is not null")
    rows = rows.withColumn("b", F.array_min(F.filter(F.transform("x.context", instants), lambda s: s["gap"].isNotNull())))
    number = lambda tag, c: F.replace(value(tag, F.col(c)), F.lit(","), F.lit("")).try_cast("double")
    facts = rows.select(
        "doc_id", F.col("q.begin").alias("period_start"), F.col("q.end").alias("period_end"), F.col("q.days").alias("quarter_days"),
        *(number(tag, "q.context").alias(name) for name, tag in FLOWS.items()),
        *(number(tag, "b.context").alias(name) for name, tag in STOCKS.items()),
        F.col("b.day").alias("balance_sheet_date"),
    )
    # a document that reports no paid-up capital tells nothing of its shares
    return derived(facts, "share_capital").withColumn("shares_outstanding", F.when(F.col("paid_up") != 0, F.col("shares_outstanding")))


def index_months(records: DataFrame, first: str, last: str) -> DataFrame:
    """The filing index of the months first to last (yyyy-MM) from records (month, record), by isin and publication."""
    rows = index_rows(records.where(F.col("month").between(first, last)))
    return rows.repartitionByRange("isin", "broadcast_date").sortWithinPartitions("isin", "broadcast_date")


def per_year(filings: DataFrame) -> DataFrame:
    """year, n: filings published in each year."""
    return filings.groupBy(F.year("broadcast_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
