"""Boosting, importance, books with memory, out-of-sample selection, and the append by arrival."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import adjust, backtest, boosting, metrics, models, portfolio
from tidepanel.operators import calendar as cal
from tidepanel.sources import layouts
from tidepanel.streaming import live

# --- boosting ------------------------------------------------------------------------------------

FEATURES = ["a", "b", "c"]


def table(spark, n: int = 900):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(n, 3)).round(2)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + 0.1 * draw.normal(size=n)
    held = (np.arange(n) % 4 == 0).astype(int)
    rows = [(*map(float, r), float(t), int(h)) for r, t, h in zip(x, y, held, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, held int"), x, y, held > 0


def plain_boosting(x, y, held, edges, s: boosting.Settings):
    """The same trees by a recursion over masks, with residuals in whole units."""
    base = y[~held].mean()
    unit = max(y[~held].max() - base, base - y[~held].min()) * 2.0**-boosting.UNIT
    bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], 1)
    f, errors = np.full(len(y), base), []
    for _ in range(s.rounds):
        g = np.where(held, 0, np.rint((y - f) / unit)) * unit
        score = lambda m: g[m].sum() ** 2 / ((m & ~held).sum() + s.l2)  # noqa: B023, E731

        def cut(m, depth):
            best = None
            if depth < s.depth and (m & ~held).sum() >= 2 * s.leaf:
                for k in range(x.shape[1]):
                    for b in range(len(edges[k])):
                        left, right = m & (bins[:, k] <= b), m & (bins[:, k] > b)
                        if min((left & ~held).sum(), (right & ~held).sum()) >= s.leaf:
                            gain = score(left) + score(right) - score(m)  # noqa: B023
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, left, right)
            return best

        leaves = [(np.ones(len(y), bool), 0, None)]
        leaves = [(m, d, cut(m, d)) for m, d, _ in leaves]
        while len(leaves) < s.leaves and any(c for *_, c in leaves):
            k = max((k for k in range(len(leaves)) if leaves[k][2]), key=lambda k: leaves[k][2][0])  # noqa: B023
            _, d, (_, left, right) = leaves.pop(k)
            leaves += [(left, d + 1, cut(left, d + 1)), (right, d + 1, cut(right, d + 1))]
        for m, _, _ in leaves:
            f = f + np.where(m, s.rate * g[m].sum() / ((m & ~held).sum() + s.l2), 0)
        errors.append(((y - f)[held] ** 2).mean())
    return f, errors


@pytest.mark.parametrize(("driver", "keep", "leaves"), [(64 << 20, 20, 31), (0, 3, 5)])
def test_boosting_equals_plain_numpy(spark, monkeypatch, driver, keep, leaves):
    monkeypatch.setattr(boosting, "DRIVER_BYTES", driver)
    monkeypatch.setattr(boosting, "KEEP", keep)
    monkeypatch.setattr(boosting, "BLOCK", 100)
    df, x, y, held = table(spark)
    s = boosting.Settings(rounds=5, rate=0.3, depth=3, leaves=leaves, leaf=25, bins=20)
    model = boosting.fit(df.repartition(3), FEATURES, "y", F.col("held") == 1, s)
    f, errors = plain_boosting(x, y, held, model.edges, s)
    assert np.allclose(model.errors, errors, rtol=1e-9)
    again = boosting.from_rows(boosting.to_rows(spark, model), FEATURES, s)
    for m in (model, again):
        got = df.withColumn("p", m.column()).select("p").toPandas()["p"].to_numpy()
        assert np.allclose(got, f, rtol=1e-9)
    one = boosting.fit(df.coalesce(1), FEATURES, "y", F.col("held") == 1, s)
    assert one.trees == model.trees  # whatever the partitioning
    assert df.limit(1).withColumn("a", F.lit(None).cast("double")).select(model.column()).first()[0] is None


def test_a_level_costs_the_same_in_every_round(spark, monkeypatch):
    seen, level = [], boosting._level

    def counted(*args, **kw):
        seen.append(sum(isinstance(t, boosting.Tree) for a in args for t in (a if isinstance(a, list) else [a])))
        return level(*args, **kw)

    monkeypatch.setattr(boosting, "_level", counted)
    df, *_ = table(spark)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    model = boosting.fit(df, FEATURES, "y", F.col("held") == 1, boosting.Settings(rounds=6, depth=2, leaf=25))
    assert len(model.trees) == 6 and set(seen) == {1}  # only the tree that grows is looked up, not those before it
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_a_level_counts_the_smaller_of_two_nodes(spark, monkeypatch):
    seen, level = [], boosting._level

    def counted(blocks, model, tree, nodes, *rest):
        sums, counts, wrong = level(blocks, model, tree, nodes, *rest)
        seen.append((nodes, int(counts[:, 0].sum())))
        return sums, counts, wrong

    monkeypatch.setattr(boosting, "_level", counted)
    df, _, _, held = table(spark)
    boosting.fit(df, FEATURES, "y", F.col("held") == 1, boosting.Settings(rounds=2, depth=4, leaf=25))
    train = int((~held).sum())
    assert len(seen) == 9 and all(n == train if nodes == [0] else n <= train // 2 for nodes, n in seen)  # the other node is the difference


def test_rounds_write_the_rows_once(spark, monkeypatch):
    written, stored = [], boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda df, name: written.append(name) or stored(df, name))
    monkeypatch.setattr(boosting, "KEEP", 2)
    df, *_ = table(spark)
    model = boosting.fit(df, FEATURES, "y", F.col("held") == 1, boosting.Settings(rounds=5, depth=2, leaf=25))
    assert len(model.trees) == 5 and written == ["boosting"]  # later rounds hold arrays and checkpoint them; no table is read and converted again


def test_a_block_takes_the_rows_of_several_batches(spark):
    df, x, y, held = table(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        model = boosting.Model(FEATURES, [[0.0]] * 3, 0.5, [], [], boosting.Settings())
        got = boosting._packed(df.coalesce(1), model, "y", F.col("held") == 1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = np.argsort(held, kind="stable")
    assert len(got) == 1 and got[0]["train"] == (~held).sum()
    assert np.array_equal(np.frombuffer(got[0]["rest"]), (y - 0.5)[order]) and np.array_equal(np.frombuffer(got[0]["x"], np.uint8).reshape(3, -1), (x > 0).T[:, order])


@pytest.mark.parametrize("sorted_", [1 << 20, 700])
def test_bin_borders_are_quantiles(spark, monkeypatch, sorted_):
    monkeypatch.setattr(boosting, "SORTED", sorted_, raising=False)
    draw = np.random.default_rng(5)
    a, b = draw.normal(size=4000), draw.integers(0, 3, 4000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(3)
    exact = np.sort(a)[np.ceil(np.arange(1, 255) / 255 * 4000).astype(int) - 1]
    plan = []
    monkeypatch.setattr(type(df), "agg", lambda self, *c: plan.append(c))  # no sketch that takes the rows one by one
    assert np.array_equal(boosting.edges(df, ["a", "b"], 255)[0], exact) and boosting.edges(df, ["a", "b"], 255)[1] == [0.0, 1.0]
    got = np.searchsorted(np.sort(a), boosting.edges(df, ["a"], 5)[0], side="right")  # 500 values of each 700 rows
    assert np.abs(got - 4000 * np.arange(1, 5) / 5).max() <= (4000 / 500 + 1 if sorted_ == 700 else 9) and not plan


def test_boosting_of_odd_tables(spark):
    df, *_ = table(spark, 60)
    s = boosting.Settings(rounds=3)  # 200 rows a leaf: no cut is allowed
    model = boosting.fit(df, FEATURES, "y", F.lit(False), s)
    mean = df.agg(F.avg("y")).first()[0]
    assert len(model.trees) == 3 and model.errors == [] and df.select(model.column().alias("p")).agg(F.max(F.abs(F.col("p") - mean))).first()[0] < 1e-6
    empty = boosting.fit(df.limit(0), FEATURES, "y", F.lit(False), s)
    assert empty.trees == [] and df.select(empty.column()).first()[0] == 0.0
    flat = boosting.fit(df.withColumn("a", F.lit(1.0)), ["a"], "y", F.col("held") == 1, boosting.Settings(rounds=60, leaf=2, patience=2))
    assert flat.edges == [[]] and len(flat.trees) < 60  # patience ends it


def test_places_of_a_whole_order(spark):
    rows = spark.range(1000).select(F.col("id"), F.xxhash64("id").alias("h"))
    got = {r["id"]: r["place"] for r in models.placed(rows.repartition(5), "h", "id").collect()}
    want = [r["id"] for r in rows.orderBy("h", "id").collect()]
    assert [got[i] for i in want] == list(range(1000))


def test_importance_equals_brute_force(spark):
    df, x, y, _ = table(spark, 600)
    start = dt.date(2020, 1, 1)
    parts = df.withColumn("i", F.monotonically_increasing_id())
    parts = df.coalesce(1).withColumn("i", F.monotonically_increasing_id()).select(F.lit("test").alias("part"), F.date_add(F.lit(start), (F.col("i") % 6).cast("int")).alias("date"), F.col("i").cast("string").alias("isin"), *FEATURES, F.col("y").alias(models.TARGET))
    model = boosting.fit(df, FEATURES, "y", F.lit(False), boosting.Settings(rounds=8, rate=0.3, leaf=20))
    got = {r["feature"]: r["mean_drop"] for r in models.importance(parts, 2, model, repeats=3).collect()}
    rows = parts.where(F.date_diff("date", F.lit(start)) % 2 == 0).select("date", "isin", *FEATURES, models.TARGET, *(F.xxhash64("isin", "date", F.lit(r)).alias(f"h{r}") for r in range(3))).toPandas()
    rows = rows.sort_values(["date", "isin"]).reset_index(drop=True)
    of = lambda t: model.predicted(model.bins([t[f].to_numpy() for f in FEATURES]))
    t = rows[models.TARGET].to_numpy()
    r2 = lambda p: 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    for f in FEATURES:
        drops = []
        for r in range(3):
            other = rows.sort_values([f"h{r}", "isin", "date"]).reset_index(drop=True)
            drops.append(r2(of(rows)) - r2(of(rows.assign(**{f: other[f]}))))
        assert got[f] == pytest.approx(np.mean(drops), rel=1e-9)


def test_repeats_of_a_permutation_are_predicted_together(monkeypatch):
    draw = np.random.default_rng(4)
    model = boosting.Model(["a", "b"], [[0.0], [0.0]], 0.5, [boosting.Tree([0, -1, -1], [0, 0, 0], [1, 0, 0], [2, 0, 0], [0.0, -1.0, 1.0])], [], boosting.Settings())
    cells = {c: draw.normal(size=90) for c in ("a", "b", "p_a", "p_b", models.TARGET)}
    seen, predicted = [], boosting.Model.predicted
    monkeypatch.setattr(boosting.Model, "predicted", lambda self, x: seen.append(x.shape[1]) or predicted(self, x))
    got = models.permuted(model, pa.table({"repeat": pa.array(np.arange(90) % 3, pa.int32()), **cells}))
    assert seen == [90] * 3  # as they are, and with one feature permuted
    for (r, k), e in got.items():
        a = cells["p_a" if k == 0 else "a"]
        assert e == pytest.approx((((0.5 + np.where(a > 0, 1.0, -1.0) - cells[models.TARGET])[r::3]) ** 2).sum())
    assert len(got) == 9


def test_models_are_stored_and_retrained(spark, tmp_path):
    df, *_ = table(spark, 400)
    place = f"file://{tmp_path}/model"
    today = dt.date(2024, 3, 1)
    assert models.load(spark, place) is None and models.due(spark, place, today, 30) == (True, "absent")
    model = boosting.fit(df, FEATURES, "y", F.lit(False), boosting.Settings(rounds=4, leaf=30))
    models.save(model, spark, place, dt.date(2024, 2, 20))
    back, meta = models.load(spark, place)
    assert (meta.first()["trained"], meta.first()["trees"]) == (dt.date(2024, 2, 20), 4)
    assert df.select((model.column() - back.column()).alias("d")).agg(F.max(F.abs("d"))).first()[0] < 1e-12
    assert models.due(spark, place, today, 30) == (False, "fresh")
    assert models.due(spark, place, today, 30, forced=True) == (True, "forced")
    assert models.due(spark, place, today, 5) == (True, "old")


def test_only_complete_rows_count(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (0.0, None)], "a double, b double")
    assert [tuple(r) for r in models.complete(rows, ["a", "b"]).collect()] == [(1.0, 2.0)]


# --- books with memory ---------------------------------------------------------------------------


def ranks(n: int = 12, periods: int = 7, seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    out = []
    for p in range(periods):
        if p == 3:
            continue  # a period without names
        for r, i in enumerate(draw.sample(range(n), n)):
            out.append((p, f"n{i}", r + 1, None if draw.random() < 0.2 else draw.gauss(0, 0.05), draw.choice([None, 0.05, 0.2, 0.6])))
    return out


def test_weights_that_see_the_held_book_equal_a_loop(spark):
    rows = ranks()
    variants = [("v1", 4, 1.0, "equal"), ("v2", 4, 2.0, "inverse"), ("v3", 9, 1.3, "inverse")]
    frame = spark.createDataFrame([(*r, *v) for r in rows for v in variants], "period long, isin string, rank long, ret double, vol double, variant string, n int, mult double, sizing string").repartition(4)
    weigh = portfolio.sized_buffer(0.3, 0.1)
    mixed = lambda now, held: {i: w + held.get(i, 0.0) for i, w in weigh(now, held).items()}
    got = {(r["variant"], r["period"], r["isin"]): r["weight"] for r in portfolio.folded_books(frame, mixed).collect()}
    want = {}
    for name, n, mult, sizing in variants:
        held: dict[str, float] = {}
        for p in sorted({r[0] for r in rows}):
            now = sorted((r for r in rows if r[0] == p), key=lambda r: r[2])
            kept = [r for r in now if r[1] in held and r[2] <= int(n * mult)][:n]
            chosen = kept + [r for r in now if r not in kept][: n - len(kept)]
            if sizing == "equal":
                w = {r[1]: 1 / n for r in chosen}
            else:
                known = sorted(r[4] for r in chosen if r[4] is not None)
                middle = float(np.median(known)) if known else 1.0
                w = {r[1]: 1 / max(r[4] if r[4] is not None else middle, 0.1) for r in chosen}
                w = {k: v / sum(w.values()) for k, v in w.items()}
                cap = max(0.3, 1 / len(w))
                for _ in range(200):  # pour what is over the cap onto the others, until nothing is
                    over = sum(max(v - cap, 0) for v in w.values())
                    room = {k: v for k, v in w.items() if v < cap - 1e-15}
                    w = {k: min(v, cap) for k, v in w.items()}
                    for k in room:
                        w[k] += over * room[k] / sum(room.values())
            w = {k: v + held.get(k, 0.0) for k, v in w.items()}
            w = {r[1]: w[r[1]] for r in chosen if r[3] is not None}
            if w:
                held = {k: v / sum(w.values()) for k, v in w.items()}
                want |= {(name, p, k): v for k, v in held.items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_books_inverse_weights_equal_those_of_many(spark):
    draw = random.Random(2)
    risks = [[draw.choice([None, 0.02, 0.1, 0.3, 2.0]) for _ in range(n)] for n in (1, 3, 8, 30)]
    rows = [(k, f"n{i}", r) for k, rs in enumerate(risks) for i, r in enumerate(rs)]
    many = portfolio.inverse_vol_weights(spark.createDataFrame(rows, "period int, isin string, vol double"), ["period"], "vol", 0.1, 0.1)
    got = {(r["period"], r["isin"]): r["weight"] for r in many.collect()}
    for k, rs in enumerate(risks):
        one = portfolio.capped_inverse(pd.Series(rs, index=[f"n{i}" for i in range(len(rs))], dtype=float), 0.1, 0.1)
        assert all(got[k, i] == pytest.approx(w) for i, w in one.items()) and one.sum() == pytest.approx(1.0)


def test_a_run_with_memory_takes_variants(spark):
    d = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(200)]
    draw = random.Random(4)
    bars = [(d[s], s, f"n{i}", 100 * (1 + 0.02 * draw.gauss(0, 1)) + s * i / 50) for i in range(6) for s in range(200)]
    panel = spark.createDataFrame(bars, "date date, s long, isin string, adj_close double")
    dates = cal.rebalances(panel.select("date", "s").distinct(), 20)
    everyone = lambda p, f: p.join(F.broadcast(f), p.s == f.form_s).select("form_date", "isin")
    score = lambda p, f: p.join(F.broadcast(f), p.s == f.form_s).select("form_date", "isin", F.col("adj_close").alias("score"))
    variants = spark.createDataFrame([("tight", 1.0), ("loose", 3.0)], "variant string, mult double")
    weigh = lambda now, held: dict.fromkeys(portfolio.kept_and_filled(now, held, 2, float(now["mult"].iloc[0])), 1.0)
    got = backtest.run_held(panel, dates, everyone, score, weigh, 35.0, variants).collect()
    turned = {v: sum(r["turnover"] for r in got if r["variant"] == v) for v in ("tight", "loose")}
    assert turned["loose"] == pytest.approx(0.5) and turned["tight"] > turned["loose"]  # the loose book never sells
    assert all(r["n_holdings"] == 2 for r in got)


def test_folds_are_judged_by_earlier_years_only(spark):
    rows = [(f, dt.date(y, m, 28), v) for f, by_year in (("up", {2020: 0.1, 2021: 0.1, 2022: -9.0}), ("down", {2020: -0.1, 2021: -0.1, 2022: 9.0})) for y, c in by_year.items() for m in range(1, 7) for v in [c + m / 1000]]
    ics = spark.createDataFrame(rows, "factor string, form_date date, ic double")
    verdicts = metrics.fold_verdicts(ics)
    got = {(r["fold"], r["factor"]): (r["n"], r["verdict"]) for r in verdicts.collect()}
    assert got == {(2021, "up"): (6, "kept"), (2022, "up"): (12, "kept"), (2021, "down"): (6, "wrong sign"), (2022, "down"): (12, "wrong sign")}
    z = spark.createDataFrame([(dt.date(2022, 1, 28), "x", "up", 2.0), (dt.date(2022, 1, 28), "x", "down", 5.0), (dt.date(2020, 1, 28), "x", "up", 1.0), (dt.date(2022, 1, 28), "y", "up", None)], "form_date date, isin string, factor string, z double")
    assert [(r["fold"], r["isin"], r["composite"]) for r in metrics.out_of_sample(z, verdicts).collect()] == [(2022, "x", 2.0)]


# --- identities, files, append --------------------------------------------------------------------


def test_a_circle_of_identities_raises(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    spans = [("S1", "A", 0, 9), ("S1", "B", 10, 14), ("S2", "B", 15, 19), ("S2", "A", 20, 24), ("S3", "C", 0, 4), ("S3", "D", 5, 24)]
    rows = [(days[k], s, i) for s, i, a, b in spans for k in range(a, b + 1)]
    with pytest.raises(adjust.LinkCycleError, match="A, B$"):
        adjust.isin_links(spark.createDataFrame(rows, "date date, symbol string, isin string"))
    got = adjust.isin_links(spark.createDataFrame([r for r in rows if r[1] != "S2"], "date date, symbol string, isin string"))
    assert {r["isin"]: r["canonical_isin"] for r in got.collect()} == {"A": "B", "B": "B", "C": "D", "D": "D"}


def test_published_names_dates_and_reports(spark, tmp_path):
    place = tmp_path / "a folder with blanks"
    place.mkdir()
    head = ",".join(layouts.LEGACY.columns.values())
    line = "AB,EQ,1,2,1,1.5,1,10,15,3,INE1"
    (place / "cm06JAN2020bhav.csv").write_text(f"{head}\n{line}\n")
    (place / "plain.csv").write_text(f"{head},TIMESTAMP\n{line},07-JAN-2020\n{line},odd\n")
    (place / "undated.csv").write_text(f"{head}\n{line}\n")
    newer = [*layouts.NEWER.columns.values(), "TradDt"]
    cells = {"FinInstrmTp": "STK", "TckrSymb": "AB", "SctySrs": "EQ", "ISIN": "INE1", "TradDt": "2024-07-09"}
    (place / "BhavCopy_NSE_CM_0_0_0_20240708_F_0000.csv").write_text(",".join(newer) + "\n" + ",".join(cells.get(c, "7") for c in newer) + "\n")
    (place / "other.csv").write_text(",".join(newer) + "\n" + ",".join(cells.get(c, "7") for c in newer) + "\n")
    panel, report = layouts.read(spark, [str(place)])
    assert sorted(r["date"] for r in panel.collect()) == [dt.date(2020, 1, 6), dt.date(2020, 1, 7), dt.date(2024, 7, 8), dt.date(2024, 7, 9)]
    told = {r["file"].rsplit("/", 1)[1][:5]: (r["rows"], r["status"], r["day"]) for r in report.collect()}
    assert told == {"cm06J": (1, "read", dt.date(2020, 1, 6)), "plain": (2, "read", dt.date(2020, 1, 7)), "undat": (1, "no date", None), "BhavC": (1, "read", dt.date(2024, 7, 8)), "other": (1, "read", dt.date(2024, 7, 9))}
    with pytest.raises(layouts.MissingDaysError, match="no date"):
        layouts.load_files(spark, [str(place)], "2020-01-01", "2020-12-31")
    assert layouts.load_files(spark, [str(place)], "2020-01-01", "2020-12-31", strict=False).count() == 2
    good = [str(place / n) for n in ("cm06JAN2020bhav.csv", "plain.csv")]
    days = spark.createDataFrame([(dt.date(2020, 1, k),) for k in (6, 7)], "date date")
    assert layouts.load_files(spark, good, "2020-01-06", "2020-01-07", days).count() == 2
    with pytest.raises(layouts.MissingDaysError, match="2020-01-08"):
        layouts.load_files(spark, good, "2020-01-06", "2020-01-08", days.unionByName(spark.createDataFrame([(dt.date(2020, 1, 8),)], "date date")))


def test_panel_files_are_in_canonical_order(spark, tmp_path):
    draw = random.Random(6)
    rows = [(dt.date(2020, 1, 1 + draw.randrange(9)), f"s{draw.randrange(40)}") for _ in range(400)]
    layouts.write_panel(spark.createDataFrame(rows, "date date, symbol string").repartition(4), str(tmp_path / "p"))
    parts = [pd.read_parquet(f) for f in sorted((tmp_path / "p").glob("*.parquet"))]
    got = [tuple(r) for p in parts for r in p.itertuples(index=False)]
    assert got == sorted(rows)


def test_the_last_arrival_wins_whatever_its_value(spark, tmp_path):
    schema = "date date, isin string, close double"
    d = [dt.date(2020, 1, 6 + k) for k in range(4)]
    src, kind = tmp_path / "in", spark.createDataFrame([], schema).schema

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)

    def go() -> list:
        live.run_append(spark, str(src), kind, str(tmp_path / "panel"), str(tmp_path / "cp"), ["date", "isin"])
        return sorted((r["date"], r["isin"], r["close"]) for r in live.appended(spark, str(tmp_path / "panel")).collect())

    put((d[0], "a", 10.0), (d[1], "a", 1.0))
    put((d[0], "a", 9.0))  # the first batch holds a key twice
    assert go() == [(d[0], "a", 9.0), (d[1], "a", 1.0)]
    put((d[0], "a", 20.0))
    put((d[0], "a", 5.0), (d[2], "b", 1.0), (d[2], "b", 0.5))  # the later file, and the later row of a file, win
    assert go() == [(d[0], "a", 5.0), (d[1], "a", 1.0), (d[2], "b", 0.5)]
    put((d[0], "a", 4.0), (d[3], "c", None))
    assert go() == [(d[0], "a", 4.0), (d[1], "a", 1.0), (d[2], "b", 0.5), (d[3], "c", None)]

