"""Panel operators: closed-form values, causality under truncation, accounting identities, streaming."""

from __future__ import annotations

import datetime as dt
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.config import WEEKLY
from tidepanel.functions.tables import dealt, stored
from tidepanel.operators import adjust, backtest, factors, filings, metrics, models, portfolio, universe, volatility
from tidepanel.operators import calendar as cal
from tidepanel.plans.reports import WIDE, land_wide
from tidepanel.sources import layouts
from tidepanel.streaming import live

CFG = replace(WEEKLY, universe_size=5, holdings=5, z_minimum=5)


def sessions(n: int) -> list[dt.date]:
    out, d = [], dt.date(2020, 1, 6)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def bars(n: int = 120, names: int = 6, split_at: int | None = None, switch_at: int | None = None, gap: int = 0) -> list[tuple]:
    draw, rows = random.Random(0), []
    for k in range(names):
        close = 100.0
        for i, d in enumerate(sessions(n)):
            before, step = close, 1 + draw.gauss(0.0005 * (k + 1), 0.01)
            if k == 0 and i == split_at:
                before, close = before / 2, close / 2
            close *= step
            isin = f"INE{k}" + ("B" if k == 1 and switch_at is not None and i >= switch_at + gap else "A")
            if k == 1 and switch_at is not None and switch_at <= i < switch_at + gap:
                continue
            rows.append((d, f"S{k}", isin, close, close * 1.01, close * 0.99, close, before if i else close, 10.0, 1e9 / (k + 1), 5.0))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "date date, symbol string, isin string, open double, high double, low double, close double, prevclose double, volume double, turnover double, trades double")


def test_split_is_bridged(spark):
    panel = table(spark, bars(split_at=60))
    actions = adjust.detect_actions(panel).collect()
    assert len(actions) == 1 and actions[0]["factor"] == pytest.approx(0.5)
    rows = adjust.adjusted(panel).where("isin = 'INE0A'").orderBy("date").collect()
    assert rows[0]["adj_close"] == pytest.approx(rows[0]["close"] / 2) and rows[-1]["adj_close"] == rows[-1]["close"]


def test_only_adjacent_identities_are_linked(spark):
    near = dict(map(tuple, adjust.isin_links(table(spark, bars(switch_at=50))).collect()))
    far = dict(map(tuple, adjust.isin_links(table(spark, bars(switch_at=50, gap=10))).collect()))
    assert near["INE1A"] == "INE1B" and far["INE1A"] == "INE1A" and near["INE0A"] == "INE0A"


def test_returns_by_gap_mode(spark):
    d = sessions(5)
    rows = [(d[i], "S", "INEX", p, p, p, p, p, 1.0, 1.0, 1.0) for i, p in ((0, 1.0), (1, 2.0), (3, 3.0))] + [(x, "T", "INEY", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for x in d]
    panel = cal.indexed(table(spark, rows).withColumn("adj_close", F.col("close")))
    one = lambda df: [r["ret"] for r in df.where("isin = 'INEX'").orderBy("s").collect()]
    assert one(adjust.returns(panel, "null", None)) == [None, 1.0, None]
    assert one(adjust.returns(panel, "row", None)) == [None, 1.0, 0.5]
    assert one(adjust.padded(panel, None)) == [None, 1.0, 0.0, 0.5, 0.0]


def causal(spark, make, cut: int):
    """The result at a date is the same on the whole panel and on one that ends there."""
    rows = bars(130)
    last = sessions(130)[cut]
    full, part = make(table(spark, rows)), make(table(spark, [r for r in rows if r[0] <= last]))
    pick = lambda df: sorted(map(str, df.where(F.col("date") == F.lit(last)).collect()))
    assert pick(full) == pick(part) and pick(full)


def test_features_do_not_see_the_future(spark):
    causal(spark, lambda p: volatility.features(adjust.prepared(p), CFG).select("date", "isin", *(F.round(c, 9).alias(c) for c in volatility.FEATURES)), 100)


def test_target_sees_only_the_future(spark):
    p = volatility.features(adjust.prepared(table(spark, bars(60))), CFG)
    assert p.agg(F.max(F.when(F.col("forward_vol").isNotNull(), F.col("s")))).first()[0] == 57


def test_factors_and_universe_are_causal(spark):
    def make(p):
        panel = adjust.prepared(p)
        forms = cal.month_ends(cal.calendar(p)).select(F.col("date").alias("form_date"), F.col("s").alias("form_s")).where("form_s >= 60")
        members = universe.universe(universe.formation_stats(panel, forms, CFG.formation), CFG)
        raw = factors.price_factors(panel, forms, CFG, members)
        return raw.select(F.col("form_date").alias("date"), "isin", *(F.round(c, 9).alias(c) for c in factors.PRICE_SIGNS))

    ends = [i for i in range(60, 129) if sessions(130)[i].month != sessions(130)[i + 1].month]
    causal(spark, make, ends[1])


def sent(df) -> list[str]:
    """What the plan deals out by keys."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_bars_are_sent_once_not_once_a_formation(spark, tmp_path):
    p = cal.indexed(table(spark, bars(130)).withColumn("adj_close", F.col("close")))
    p.write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    forms = spark.createDataFrame([(d, s) for s, d in enumerate(sessions(130)) if s % 20 == 19], "form_date date, form_s long")
    plain = universe.formation_stats(p, forms, 26)
    assert len(sent(plain)) == 1 and re.fullmatch(r"isin#\d+", sent(plain)[0])
    doubled = universe.formation_stats(p.union(p), forms, 26)  # sessions count once, whatever the bars
    assert [r["n_days"] for r in doubled.orderBy("form_date", "isin").collect()] == [r["n_days"] for r in plain.orderBy("form_date", "isin").collect()]


def test_tasks_grow_in_number_not_in_size(spark):
    assert dealt(spark.range(10), "id", 10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt(spark.range(10), "id", 1 << 24).rdd.getNumPartitions() == 64


def test_weights_sum_to_one_and_respect_caps(spark):
    draw = random.Random(4)
    rows = [(p, f"n{i}", draw.choice([None, draw.random() ** 3]), f"g{i % 3}") for p in range(20) for i in range(12)]
    chosen = spark.createDataFrame(rows, "period long, isin string, vol double, sector string")
    w = portfolio.inverse_vol_weights(chosen, ["period"], "vol", 0.12, 0.01)
    for r in w.groupBy("period").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect():
        assert r["s"] == pytest.approx(1) and r["m"] <= 0.12 + 1e-9
    g = portfolio.cap_by_group(w, ["period"], "sector", 0.4).groupBy("period", "sector").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] <= 0.4 + 1e-9 for r in g)


def test_water_filling_equals_the_loop(spark):
    draw = random.Random(9)
    for n, cap in ((5, 0.3), (8, 0.2), (4, 0.25)):
        inv = [draw.random() ** 2 + 0.01 for _ in range(n)]
        w = [x / sum(inv) for x in inv]
        locked = [False] * n
        for _ in range(n + 1):
            over = [x > cap + 1e-12 and not lk for x, lk in zip(w, locked)]
            if not any(over):
                break
            locked = [a or b for a, b in zip(locked, over)]
            rest = 1 - cap * sum(locked)
            free = sum(x for x, lk in zip(w, locked) if not lk)
            w = [cap if lk else rest * x / free for x, lk in zip(w, locked)]
        df = spark.createDataFrame([(0, f"n{i}", 1 / x) for i, x in enumerate(inv)], "period long, isin string, vol double")
        got = {r["isin"]: r["weight"] for r in portfolio.inverse_vol_weights(df, ["period"], "vol", cap, 1e-9).collect()}
        assert [got[f"n{i}"] for i in range(n)] == pytest.approx(w)


def test_full_rotation_costs_both_sides(spark):
    d = sessions(4)
    books = spark.createDataFrame([(0, "a", 1.0, 0.1), (1, "b", 1.0, 0.2)], "period long, isin string, weight double, ret double").withColumn("v", F.lit(1))
    forms = spark.createDataFrame([(0, d[0], d[1], d[2]), (1, d[1], d[2], d[3])], "period long, form_date date, entry date, exit date")
    rows = backtest.ledger(books, forms, 35.0, ["v"]).orderBy("form_date").collect()
    assert [r["turnover"] for r in rows] == [0.5, 1.0] and rows[1]["cost"] == pytest.approx(0.007)
    assert rows[1]["net_equity"] == pytest.approx(1.0965 * 1.193)


def test_delisted_name_keeps_its_last_price(spark):
    d = sessions(6)
    panel = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 1.0), ("b", 1, 10.0), ("b", 4, 11.0), ("c", 2, 5.0)], "isin string, s long, adj_close double")
    forms = spark.createDataFrame([(d[0], 0, 1, 4)], "form_date date, period long, entry_s long, exit_s long")
    got = {r["isin"]: r["ret"] for r in backtest.forward_returns(panel, forms).collect()}
    assert got["a"] == pytest.approx(-0.9) and got["b"] == pytest.approx(0.1) and "c" not in got


def test_buffered_books_equal_a_loop(spark):
    draw = random.Random(1)
    rows = [(f"m{m}", m, p, f"n{i}", r + 1, 0.01) for m in (1.0, 2.0) for p in range(6) for r, i in enumerate(draw.sample(range(12), 12)) if r < int(4 * m)]
    got = portfolio.buffered_books(spark.createDataFrame(rows, "variant string, mult double, period long, isin string, rank long, ret double"), 4).collect()
    for m in (1.0, 2.0):
        held: list[str] = []
        for p in range(6):
            order = [r[3] for r in sorted((r for r in rows if r[1] == m and r[2] == p), key=lambda r: r[4])]
            keep = [i for i in order if i in held][:4]
            held = keep + [i for i in order if i not in keep][: 4 - len(keep)]
            assert {r["isin"] for r in got if r["variant"] == f"m{m}" and r["period"] == p} == set(held)


def t_density(t: float, df: int) -> float:
    from math import gamma, pi, sqrt

    return gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2)) * (1 + t * t / df) ** (-(df + 1) / 2)


def test_drawdown_and_significance(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, -0.5), (3, 0.0)], "t int, r double").withColumn("v", F.lit(1))
    assert metrics.equity(rows, ["v"], "t", "r").agg(F.min("drawdown")).first()[0] == pytest.approx(-0.5)
    one = spark.createDataFrame([(16, 19)], "wins long, n long")
    assert one.select(metrics.binomial_tail("wins", "n")).first()[0] == pytest.approx(0.00221, abs=1e-5)
    for t, df in ((-4.45, 18), (1.3, 7), (0.5, 1), (2.0, 2), (1.0, 3)):
        steps = 200_000
        inside = sum(t_density((k + 0.5) / steps * abs(t), df) for k in range(steps)) / steps * abs(t)
        got = one.select(metrics.t_two_sided(F.lit(t), F.lit(df))).first()[0]
        assert got == pytest.approx(1 - 2 * inside, abs=1e-6)


def test_layout_files(spark, tmp_path):
    (tmp_path / "cm20200106.csv").write_text("SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,\n AB , EQ,1,2,x,1.5,1.4,1,10,15,06-JAN-2020,3,INE1,\nCD,GB,1,2,1,1.5,1,1,10,15,d,3,INE2,\nEF,EQ,1,2,1,1.5,1,1,10,15,d,3,IN9,\n")
    (tmp_path / "cm20200107.csv").write_text("\ufeffISIN , SYMBOL,CLOSE,SERIES,OPEN,HIGH,LOW,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TOTALTRADES\nINE1,AB,2.5,BE,1,2,1,1,10,15,3\n")
    newer = ["ISIN", "FinInstrmTp", "Extra", *[v for k, v in layouts.NEWER.columns.items() if k not in ("isin", "kind")]]
    cells = {"ISIN": "INE1", "FinInstrmTp": "STK", "Extra": '"a, b"', "TckrSymb": "AB", "SctySrs": "EQ"}
    (tmp_path / "new20240108.csv").write_text(",".join(newer) + "\n" + ",".join(cells.get(c, "7") for c in newer) + "\n" + ",".join({**cells, "FinInstrmTp": "IDX"}.get(c, "7") for c in newer) + "\n")
    (tmp_path / "odd20200109.csv").write_text("a,b\n1,2\n")
    (tmp_path / "cut20200110.csv.gz").write_bytes(b"\x1f\x8bnot a zip file")
    panel, report = layouts.read(spark, [str(tmp_path)])
    rows = {r["date"]: r for r in panel.collect()}
    assert set(rows) == {dt.date(2020, 1, 6), dt.date(2020, 1, 7), dt.date(2024, 1, 8)} and panel.count() == 3
    assert rows[dt.date(2020, 1, 6)]["symbol"] == "AB" and rows[dt.date(2020, 1, 6)]["low"] is None and rows[dt.date(2020, 1, 6)]["high"] == 2.0
    assert rows[dt.date(2020, 1, 7)]["close"] == 2.5 and rows[dt.date(2024, 1, 8)]["turnover"] == 7.0
    told = {r["file"].rsplit("/", 1)[1][:3]: (r["layout"], r["status"]) for r in report.collect()}
    assert report.count() == 5 and told["new"] == ("newer", "read") and told["odd"] == (None, "no header") and told["cut"] == (None, "unreadable")


def test_identities_are_followed_through_other_symbols(spark):
    d = sessions(50)
    names = [("S1", "A", 0, 9), ("S1", "B", 10, 19), ("S2", "B", 20, 24), ("S2", "C", 25, 29), ("S3", "C", 30, 34), ("S3", "D", 35, 49), ("S4", "E", 0, 5)]
    rows = [(d[k], s, i, *[1.0] * 8) for s, i, a, b in names for k in range(a, b + 1)]
    got = dict(map(tuple, adjust.isin_links(table(spark, rows)).collect()))
    assert got == {"A": "D", "B": "D", "C": "D", "D": "D", "E": "E"}


def test_ewma_of_long_series(spark):
    from tidepanel.operators import volatility

    rows = spark.range(15_000).select(F.lit("a").alias("isin"), F.col("id").alias("s"), F.col("id").alias("age"), F.when(F.col("id") % 3 > 0, F.sin("id") / 50).alias("ret"))
    got = [r["v"] for r in rows.withColumn("v", volatility.ewma(0.94, 252, 10)).orderBy("s").collect()]
    up = down = 0.0
    for k in range(15_000):
        up, down = up * 0.94, down * 0.94
        if k % 3:
            up, down = up + (np.sin(k) / 50) ** 2, down + 1
        if k > 30 and k % 997 < 3 or k > 14_990:
            assert got[k] == pytest.approx(np.sqrt(up / down * 252), rel=1e-9)


def test_windows_of_a_panel_are_sorted_once(spark):
    panel = stored(adjust.prepared(table(spark, bars(60))), "panel")
    rows = volatility.windowed(panel, CFG)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "date" not in sent(rows)  # nor is the market's median in it, which reads it once it is written
    market = volatility.market(stored(rows, "windowed"))
    assert "Window" not in market._jdf.queryExecution().executedPlan().toString()


def test_quarter_facts(spark):
    def doc(*facts, instants=()):
        days = "".join(f'<b:context id="{i}"><b:entity/><b:period><b:instant>{day}</b:instant></b:period></b:context>' for i, day in instants)
        return '<x xmlns:in="http://x" xmlns:b="http://b">' + days + "".join(f'<in:{t} contextRef="{c}">{v}</in:{t}>' for t, c, v in facts) + "</x>"

    start, end = filings.START, filings.END
    year = [(start, "FourD", "2020-04-01"), (end, "FourD", "2020-12-31"), ("RevenueFromOperations", "FourD", "900")]
    rows = [
        (1, doc(*year, (start, "OneD", "2020-10-01"), (end, "OneD", "2020-12-31"), ("RevenueFromOperations", "OneD", "1,300.5"), ("EquityShareCapital", "I2", "5"), ("EquityShareCapital", "I1", "7"), instants=[("I1", "2020-12-30"), ("I2", "2020-03-31")])),
        (2, doc(*year)),
        (3, doc(("RevenueFromOperations", "OneD", "3"))),
        (4, doc(*year)[:-3]),
        (5, doc((start, "A", "2020-10-01"), (end, "A", "2020-12-31"), (start, "B", "2020-10-01"), (end, "B", "2020-12-20"), ("ProfitLossForPeriod", "B", "x"))),
        (6, ""),
        (7, None),
    ]
    got = {r["doc_id"]: r for r in filings.quarter_facts(spark.createDataFrame(rows, "doc_id long, doc string")).collect()}
    assert set(got) == {1, 5}
    assert (got[1]["revenue"], got[1]["share_capital"], got[1]["net_worth"], got[1]["total_debt"], got[1]["quarter_days"]) == (1300.5, 7.0, 7.0, None, 91)
    assert got[1]["balance_sheet_date"] == dt.date(2020, 12, 30)
    assert (got[5]["quarter_days"], got[5]["pat"], got[5]["balance_sheet_date"]) == (80, None, None)


def test_stale_panels_raise(spark):
    panel = spark.createDataFrame([(dt.date(2024, 1, 5),)], "date date")
    live.require_fresh(panel, F.lit("2024-01-10").cast("date"))
    with pytest.raises(live.StaleDataError):
        live.require_fresh(panel, F.lit("2024-01-11").cast("date"))
    with pytest.raises(live.StaleDataError):
        live.require_fresh(panel.limit(0), F.lit("2024-01-06").cast("date"))


def test_files_are_read_by_trimmed_names(spark, tmp_path):
    (tmp_path / "ind.csv").write_text(" Index Name ,Closing Index Value,Div Yield\n Fifty ,10.5,-\n")
    r = layouts.read_named(spark, [str(tmp_path / "ind.csv")], layouts.INDEX_COLUMNS, ("open", "high", "low", "close", "pe", "pb", "div_yield")).first()
    assert (r["index_name"], r["close"], r["div_yield"], r["open"], r["pe"]) == ("Fifty", 10.5, None, None, None)
    (tmp_path / "list.csv").write_text("Company Name, Industry ,Symbol,Series,ISIN Code\nA Ltd,Oil,AA,EQ,INE1\n")
    r = layouts.read_named(spark, [str(tmp_path / "list.csv")], layouts.CONSTITUENTS).first()
    assert (r["name"], r["symbol"], r["isin"], r["Industry"]) == ("A Ltd", "AA", "INE1", "Oil")


def test_the_last_correction_of_a_batch_wins(spark):
    stored = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, v double")
    fresh = spark.createDataFrame([(1, 9.0, 1), (1, 3.0, 2)], "k int, v double, arrival int")
    assert {r["k"]: r["v"] for r in live.upsert(stored, fresh, ["k"]).collect()} == {1: 3.0, 2: 1.0}
    assert {r["k"]: r["v"] for r in live.upsert(stored, fresh.drop("arrival"), ["k"]).collect()} == {1: 9.0, 2: 1.0}


def test_streamed_append_takes_corrections(spark, tmp_path):
    schema = "date date, isin string, close double"
    d = sessions(5)
    src = tmp_path / "in"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    go = lambda: live.run_append(spark, str(src), spark.createDataFrame([], schema).schema, str(tmp_path / "panel"), str(tmp_path / "cp"), ["date", "isin"])
    put([(d[0], "a", 1.0), (d[1], "a", 2.0)])
    go()
    put([(d[1], "a", 999.0), (d[2], "a", 3.0)])
    go()
    go()
    got = {r["date"]: r["close"] for r in live.appended(spark, str(tmp_path / "panel")).collect()}
    assert got == {d[0]: 1.0, d[1]: 999.0, d[2]: 3.0}


def test_market_hours(spark):
    times = ["2024-01-05 03:44:59", "2024-01-05 03:45:00", "2024-01-05 10:00:00", "2024-01-05 10:00:01", "2024-01-06 05:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(live.market_open(F.to_timestamp("t")).alias("o")).collect()
    assert [r["o"] for r in rows] == [False, True, True, False, False]


def test_surprise_and_empty_feed(spark):
    now = dt.datetime(2024, 1, 5, 5)
    latest = spark.createDataFrame([("A", 110.0, now)], "symbol string, price double, last_bar timestamp")
    prev = spark.createDataFrame([("A", 100.0)], "symbol string, prev_close double")
    fore = spark.createDataFrame([("A", 20.0)], "symbol string, forecast double")
    r = live.surprise(latest, prev, fore).first()
    assert r["surprise"] == pytest.approx(0.1 / (0.2 / 252**0.5 * (2 / 3.141592653589793) ** 0.5))
    assert '"available":false' in live.live_payload(live.surprise(latest, prev, fore).limit(0)).first()[0]


def test_garch_finds_known_parameters(spark):
    rows = []
    for name, alpha, beta in (("a", 0.15, 0.8), ("b", 0.1, 0.6)):
        draw, h = np.random.default_rng(7), 1e-4
        for s in range(6000):
            r = 0.001 + draw.normal() * h**0.5
            rows.append((name, s, float(r)))
            h = 1e-4 * (1 - alpha - beta) + alpha * (r - 0.001) ** 2 + beta * h
    rows += [("flat", s, 0.0) for s in range(700)] + [("short", s, 0.01) for s in range(99)]
    dates = spark.createDataFrame([(dt.date(2022, 1, 1), 5999), (dt.date(2021, 1, 1), 3000), (dt.date(2018, 1, 1), 50)], "date date, s long")
    frame = spark.createDataFrame(rows, "isin string, s long, ret double")
    got = {(r["isin"], r["n"]): r for r in models.garch(frame, dates, 4, 252, 100).collect()}
    assert set(got) == {("a", 6000), ("a", 3001), ("b", 6000), ("b", 3001)}  # no fit without variance or observations
    for name, alpha, beta in (("a", 0.15, 0.8), ("b", 0.1, 0.6)):
        r = got[name, 6000]
        assert r["converged"] and r["alpha"] == pytest.approx(alpha, abs=0.03) and r["beta"] == pytest.approx(beta, abs=0.1), r
    alone = models.garch(frame.where("s <= 3000"), dates.where("s = 3000"), 4, 252, 100).where("isin = 'a'").first()
    assert alone["forecast"] == pytest.approx(got["a", 3001]["forecast"])  # nothing later than its date counts
    assert models.garch(frame.limit(0), dates, 4, 252).count() == 0


def test_garch_search_equals_plain_loops():
    draw = np.random.default_rng(1)
    ret = draw.normal(size=80) * 0.01 * (1 + (np.arange(80) // 20) % 2)
    search = models.GarchSearch(passes=3)
    (a, p, converged, v, after), none = models._garch_fits(ret, np.array([70, 80]), search)[0], models._garch_fits(np.zeros(9), np.array([9]), search)[0]
    x, best, point = ret[:70], None, search.centre
    for k in range(3):
        best = None
        for i in search.steps:
            for j in search.steps:
                q = min(max(point[1] + j * search.width[1] * 0.5**k, 0.05), 0.999)
                b = min(min(max(point[0] + i * search.width[0] * 0.5**k, 0.001), 0.4), q)
                h, loss = x.var(), 0.0
                for r in x - x.mean():
                    loss, h = loss + np.log(h) + r * r / h, (1 - q) * x.var() + b * r * r + (q - b) * h
                if best is None or loss < best[0] - 1e-12:
                    best = (loss, b, q, h, max(abs(i), abs(j)) < 1)
        point = best[1:3]
    assert none is None and (a, p, v, after) == pytest.approx((*point, x.var(), best[3])) and isinstance(converged, bool)


def test_the_newest_filing_is_a_running_maximum(spark):
    draw = random.Random(8)
    d0 = dt.date(2020, 1, 1)
    seen, rows = set(), []
    for _ in range(300):
        key = (f"n{draw.randrange(5)}", d0 + dt.timedelta(days=91 * draw.randrange(6)), draw.random() < 0.5, d0 + dt.timedelta(days=draw.randrange(700)))
        if key not in seen:
            seen.add(key)
            rows.append((*key, float(len(rows))))
    rows.append(("n0", d0, True, None, -1.0))
    f = spark.createDataFrame(rows, "isin string, period_end date, consolidated boolean, broadcast_date date, pat double")
    want = filings.latest(filings.pick_per_period(filings.visible(f), ["as_of"]), ["as_of"])
    got = filings.newest(f)
    order = ["isin", "as_of", "period_end", "consolidated", "broadcast_date", "pat"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    assert len(sent(got)) == 1 and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_documents_and_lines_are_parsed_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<x/>")], "doc_id long, doc string")
    plan = filings.quarter_facts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    (tmp_path / "a20240105.csv").write_text("x\n")
    plan = layouts.read(spark, [str(tmp_path)])[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 12  # three of one reading of the lines, for the headers and each layout


def test_wide_files_are_unpivoted_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Datetime,AA.NS, B-B.NS ,CC\n2024-01-05 09:15:00,1,,x\n2024-01-05 09:20:00,,,\nodd,1,2,3\n2024-01-05 09:25:00,2.5,3,4\n")
    (tmp_path / "b.csv").write_text("Datetime,DD.NS\r\n2024-01-05 09:15:00,7\r\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("Datetime,AA.NS\n")
    got = live.wide_ticks(spark.read.text(str(tmp_path), wholetext=True)).collect()
    assert sorted((r["symbol"], r["ts"].minute, r["price"]) for r in got) == [("AA", 15, 1.0), ("AA", 25, 2.5), ("B-B", 25, 3.0), ("CC", 25, 4.0), ("DD", 15, 7.0)]


def test_wide_files_keep_their_width_however_many_symbols(spark, tmp_path):
    draw = random.Random(3)
    rows = [(f"U{k}", dt.datetime(2024, 1 + k % 2, 5, 9, draw.randrange(60), k % 60), float(k)) for k in range(4000)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double")
    land_wide(ticks, str(tmp_path / "in"))
    files = list((tmp_path / "in").rglob("*.txt"))
    assert max(len(f.read_text().split("\n")[0].split(",")) for f in files) < 2 * WIDE
    found = live.wide_ticks(spark.read.text(str(tmp_path / "in"), wholetext=True))
    assert sorted(map(tuple, found.select("symbol", "ts", "price").collect())) == sorted(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    carried = [line for line in plan.splitlines() if "explode(lines" in line]
    assert len(carried) == 1 and "value" not in carried[0]  # a line does not carry its file


def test_the_monitor_carries_prices_through_the_day_only(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    previous = spark.createDataFrame([("A", 100.0), ("B", 100.0), ("C", 100.0)], "symbol string, prev_close double")
    forecasts = spark.createDataFrame([(s, 20.0) for s in "ABC"], "symbol string, forecast double")

    def wave(*rows):
        spark.createDataFrame([(s, dt.datetime(2024, 1, d, h), p) for s, d, h, p in rows], schema).write.mode("append").parquet(src)
        live.run_monitor(spark, spark.readStream.schema(schema).parquet(src), previous, forecasts, out, cp)
        scored, document = live.monitored(spark, out)
        return {r["symbol"]: r["price"] for r in scored.collect()}, document.first()["payload"]

    got, text = wave()  # a file without ticks
    assert got == {} and '"available":false' in text
    got, text = wave(("A", 4, 5, 101.0), ("B", 4, 5, 90.0), ("A", 4, 4, 1.0))
    assert got == {"A": 101.0, "B": 90.0} and '"available":true' in text and '"scored":2' in text
    assert wave(("C", 4, 6, 105.0), ("A", 4, 4, 2.0))[0] == {"A": 101.0, "B": 90.0, "C": 105.0}  # carried on; a late tick changes nothing
    assert wave(("C", 5, 5, 99.0))[0] == {"C": 99.0}  # the next day
    assert wave(("A", 5, 6, 98.0))[0] == {"A": 98.0, "C": 99.0}


def test_stored_tables_follow_their_folder(spark, tmp_path):
    from tidepanel.functions import tables

    made = []

    @tables.once
    def doubled(spark, folder):
        made.append(folder)
        return spark.read.parquet(f"{folder}/t.parquet").selectExpr("2 * id as id")

    place = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{place}/t.parquet")
    assert [doubled(spark, place).count(), doubled(spark, place).count(), len(made)] == [3, 3, 1]
    spark.range(5).write.mode("overwrite").parquet(f"{place}/t.parquet")
    assert [doubled(spark, place).count(), len(made)] == [5, 2]
    tables.forget(spark)
    assert [doubled(spark, place).count(), len(made)] == [5, 3]


def test_a_run_takes_the_callers_functions(spark):
    panel = cal.indexed(adjust.adjusted(table(spark, bars(n=160))))
    dates = cal.rebalances(cal.calendar(panel), 20)
    top = lambda scores: portfolio.equal_weights(portfolio.top_n(scores, 2, ["period"], "score"), ["period"])
    held = lambda p, f: p.join(F.broadcast(f), p.s == f.form_s).where("isin <> 'INE5A'").select("form_date", "isin")
    score = lambda p, f: p.join(F.broadcast(f), p.s == f.form_s).select("form_date", "isin", F.substring("isin", 4, 1).cast("double").alias("score"))
    got = backtest.run(panel, dates, held, score, top, 35.0).orderBy("form_date").collect()
    fwd = backtest.forward_returns(panel, dates).where("isin in ('INE4A', 'INE3A')").groupBy("form_date").agg(F.avg("ret").alias("r")).collect()
    want = {r["form_date"]: r["r"] for r in fwd}
    assert len(got) == len(want) > 3 and all(r["gross_return"] == pytest.approx(want[r["form_date"]]) and r["n_holdings"] == 2 for r in got)
    assert got[0]["turnover"] == pytest.approx(0.5) and all(r["turnover"] == pytest.approx(0) for r in got[1:])
    assert backtest.clip(dates, start=str(got[1]["form_date"])).count() == len(got) - 1 + (dates.count() - len(got))
