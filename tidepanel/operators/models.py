"""Forecast models and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import exists, stored
from tidepanel.operators import boosting, volatility
from tidepanel.operators.boosting import Settings

TARGET = "target_log_ratio"


def per_date(rows: DataFrame) -> DataFrame:
    """Two forecasts (a, b) of ``actual`` scored within each date, with the medians of what came and what was before."""
    rows = rows.where("a is not null and b is not null and actual is not null")
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("actual")) * (F.col(c) - F.col("actual"))))
    found = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), rmse("a").alias("rmse_a"), rmse("b").alias("rmse_b"), F.median("actual").alias("realised"), F.median("before").alias("prior"))
    return found.withColumns({"improvement": 100 * (1 - F.col("rmse_a") / F.col("rmse_b")), "vol_change": F.col("realised") / F.col("prior") - 1})


def level(rows: DataFrame) -> DataFrame:
    """Forecast level and change from a predicted log ratio to the anchor."""
    rows = rows.withColumn("level", F.col("anchor") * F.exp("log_ratio"))
    return rows.withColumn("change", F.col("level") / F.col("anchor") - 1)


def systematic(rows: DataFrame, by: str, steps: int, top: int) -> DataFrame:
    """Every max(1, n // steps)-th row in order of ``by``, the first ``top`` of them; for one date's rows."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(by, "isin")).cast("long")).crossJoin(F.broadcast(n))
    return placed.where((F.col("place") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / steps)) == 0).orderBy("place").limit(top)


def sizing(rows: DataFrame, risk: str) -> DataFrame:
    """isin, inverse, equal, difference: sizes in percent."""
    total = rows.agg(F.sum(1 / F.col(risk)).alias("total"), F.count(F.lit(1)).alias("n"))
    inverse, equal = 100 / F.col(risk) / F.col("total"), 100 / F.col("n")
    return rows.crossJoin(F.broadcast(total)).select("isin", inverse.alias("inverse"), equal.alias("equal"), (inverse - equal).alias("difference"))


def subsample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows whose digest with the seed is smallest: the same draw at every run and in every engine."""
    return rows.orderBy(F.md5(F.concat("isin", F.lit(f":{seed}")).cast("binary")), "isin").limit(n)


def fitted(parts: DataFrame, features: list[str], settings: Settings = Settings()) -> tuple[boosting.Model, boosting.Model]:
    """The model on the train rows, whose errors are those of the valid rows, and the final one on both.

    The final one has as many trees as gave the least validation error.
    """
    rows = stored(complete(parts, [*features, TARGET]).where("part in ('train', 'valid')").select("part", TARGET, *features), "model-rows")
    probe = boosting.fit(rows, features, TARGET, F.col("part") == "valid", settings)
    best = min(range(len(probe.errors)), key=probe.errors.__getitem__) + 1 if probe.errors else settings.rounds
    return probe, boosting.fit(rows, features, TARGET, F.lit(False), replace(settings, rounds=best, patience=None))


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that have a (finite) value in all of the columns."""
    there = [F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")), F.lit(False)) for c in columns]
    return rows.where(reduce(lambda a, b: a & b, there))


def boosted(parts: DataFrame, horizon: int, model: boosting.Model) -> DataFrame:
    """date, isin, actual, trees, ewma, persistence: forecasts of the non-overlapping test dates."""
    test = volatility.grid(complete(parts.where("part = 'test'"), [*model.features, TARGET]), horizon)
    return test.select("date", "isin", F.col("forward_vol").alias("actual"), (F.col("anchor") * F.exp(model.column())).alias("trees"), F.col("anchor").alias("ewma"), F.col("rv_2").alias("persistence"))


def scored(rows: DataFrame, models: list[str]) -> DataFrame:
    """model, n, rmse, mae, corr, bias of forecasts that stand side by side, over the rows that have all of them."""
    from tidepanel.operators.metrics import forecast_scores

    both = rows.where(reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in models)))
    return forecast_scores(both.unpivot(["actual"], models, "model", "pred"), ["model"])


def placed(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with ``place``, from 0 in the whole order: ranges are sorted and counted, so no task holds all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id() % (1 << 33)}), "placed")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def permuted(model: boosting.Model, rows: pa.Table) -> dict[tuple[int, int], float]:
    """Squared errors by repeat and feature (-1: none) whose value is that of the column with p_ before its name; all repeats' rows are predicted together."""
    of = lambda c: rows.column(c).to_numpy().astype(float)
    x, other = (model.bins([of(c + f) for f in model.features]) for c in ("", "p_"))
    repeat, y = rows.column("repeat").to_numpy(), of(TARGET)
    there, out = np.unique(repeat), {}
    for k in range(-1, len(model.features)):
        mixed = x.copy()
        if k >= 0:
            mixed[k] = other[k]
        sums = np.bincount(repeat, (model.predicted(mixed) - y) ** 2)
        out |= {(int(r), k): float(sums[r]) for r in there}
    return out


def importance(parts: DataFrame, horizon: int, model: boosting.Model, repeats: int = 5) -> DataFrame:
    """feature, mean_drop, sd: R2 on the non-overlapping test dates less that with the feature's values permuted over all rows, over repeats.

    A permutation gives each row the values of the row that has its place in another order, by a hash of the repeat.
    """
    features = model.features
    test = complete(parts.where("part = 'test'"), [*features, TARGET])
    test = placed(volatility.grid(test, horizon).select("date", "isin", TARGET, *features), "date", "isin")
    size = test.agg(F.count(F.lit(1)).alias("n"), (F.var_pop(TARGET) * F.count(F.lit(1))).alias("spread"))
    again = test.drop("place").withColumn("repeat", F.explode(F.array(*map(F.lit, range(repeats)))))
    drawn = placed(again, "repeat", F.xxhash64("isin", "date", "repeat"), "isin", "date").join(F.broadcast(size))
    drawn = drawn.select("repeat", (F.col("place") - F.col("repeat") * F.col("n")).alias("place"), *(F.col(f).alias(f"p_{f}") for f in features))

    def errors(batches):
        total = {}
        for table in boosting.filled(batches, boosting.BLOCK):
            for at, e in permuted(model, table).items():
                total[at] = total.get(at, 0.0) + e
        rows = [(r, k, e) for (r, k), e in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("repeat", "k", "error"), r, strict=True)) for r in rows], pa.schema([("repeat", pa.int32()), ("k", pa.int32()), ("error", pa.float64())]))

    parts_ = test.join(drawn, "place").select("repeat", TARGET, *features, *(f"p_{f}" for f in features)).mapInArrow(errors, "repeat int, k int, error double")
    sums = parts_.groupBy("repeat", "k").agg(F.sum("error").alias("error"))
    base = sums.where("k < 0").select("repeat", F.col("error").alias("plain"))
    drop = sums.where("k >= 0").join(base, "repeat").join(F.broadcast(size)).withColumn("drop", (F.col("error") - F.col("plain")) / F.col("spread"))
    named = F.get(F.array(*map(F.lit, features)), F.col("k"))
    return drop.groupBy(named.alias("feature")).agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("sd"))


@dataclass(frozen=True)
class GarchSearch:
    """A grid of (alpha, alpha + beta) that narrows around its best point: centre, half-widths, passes, and the region's borders.

    tolerance is what the last pass may still take off minus twice the log-likelihood of a fit that has converged.
    """

    centre: tuple[float, float] = (0.12, 0.84)
    width: tuple[float, float] = (0.1, 0.15)
    passes: int = 6
    shrink: float = 0.5
    alpha: tuple[float, float] = (0.001, 0.4)
    persistence: tuple[float, float] = (0.05, 0.999)
    steps: tuple[float, ...] = (-1.0, -0.5, 0.0, 0.5, 1.0)
    tolerance: float = 0.1


_GARCH = "isin string, date date, n long, alpha double, beta double, converged boolean, forecast double"


def garch(rows: DataFrame, dates: DataFrame, horizon: int, year: int, minimum: int = 500, search: GarchSearch = GarchSearch()) -> DataFrame:
    """isin, date, n, alpha, beta, converged, forecast as of each evaluation date (date, s), from at least ``minimum`` returns up to it.

    GARCH(1,1) of the returns about their mean, with the long-run variance as measured: the likeliest point of a grid
    over (alpha, alpha + beta), which is searched again in half the width around it, ``passes`` times. All dates
    and candidates of an instrument go through one recursion over its sessions at once; a candidate's state is its
    variance and its loss. ``converged`` says that the last pass gained less than the tolerance and its best point lies inside the region.
    The mean variance of the next ``horizon`` sessions follows in closed form. A group is one
    instrument's returns, bounded by the calendar.
    """
    every = dates.agg(F.array_sort(F.collect_set(F.struct("s", "date"))).alias("d"))
    series = rows.where("ret is not null").groupBy("isin").agg(F.array_sort(F.collect_list(F.struct("s", "ret"))).alias("x"))
    series = series.select("isin", "x.s", "x.ret").where(F.size("s") >= minimum).join(F.broadcast(every)).select("isin", "s", "ret", F.col("d.s").alias("ends"), F.col("d.date").alias("dates"))

    def fits(batches):
        for batch in batches:
            for one in batch.to_pylist():
                ret, upto = np.array(one["ret"]), np.searchsorted(one["s"], one["ends"], side="right")
                on = np.flatnonzero(upto >= minimum)
                found = _garch_fits(ret, upto[on], search)
                keep = [k for k in range(len(on)) if found[k] is not None]
                cells = [(one["isin"], one["dates"][on[k]], int(upto[on[k]]), *_garch_forecast(found[k], horizon, year)) for k in keep]
                names = [c.split()[0] for c in _GARCH.split(", ")]
                kinds = [pa.string(), pa.date32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True) if cells else [[]] * 7, kinds, strict=True)], names)

    return series.mapInArrow(fits, _GARCH)


def _garch_fits(ret: np.ndarray, upto: np.ndarray, search: GarchSearch) -> list[tuple | None]:
    """(alpha, persistence, converged, variance, next variance) for the returns up to each end; None without variance."""
    if not len(upto):
        return []
    mean, v = (np.array([f(ret[:n]) for n in upto]) for f in (np.mean, np.var))
    start = np.where(v > 0, v, 1.0)
    grid = np.array([(i, j) for i in search.steps for j in search.steps])
    best, ends = np.tile(np.array(search.centre), (len(upto), 1)), np.arange(len(upto))
    least = np.full(len(upto), np.inf)
    for k in range(search.passes):
        points = best[:, None, :] + grid * np.array(search.width) * search.shrink**k
        p = np.clip(points[..., 1], *search.persistence)
        a = np.minimum(np.clip(points[..., 0], *search.alpha), p)
        loss, after = _garch_losses(ret, upto, mean, start, a, p)
        at = loss.argmin(1)
        gain, least = least - loss[ends, at], loss[ends, at]
        best = np.column_stack([a[ends, at], p[ends, at]])
    alpha, persistence = best.T
    inside = (gain <= search.tolerance) & (alpha > search.alpha[0]) & (alpha < np.minimum(search.alpha[1], persistence)) & (persistence > search.persistence[0]) & (persistence < search.persistence[1])
    return [(float(alpha[d]), float(persistence[d]), bool(inside[d]), float(v[d]), float(after[d, at[d]])) if v[d] > 0 else None for d in ends]


def _garch_losses(ret: np.ndarray, upto: np.ndarray, mean: np.ndarray, start: np.ndarray, a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minus twice the log-likelihood (but for a constant) of each end's candidates, and their variance one session later."""
    h = np.repeat(start[:, None], a.shape[1], 1)
    base, b, total = (1 - p) * h, p - a, np.zeros_like(h)
    loss, after = np.zeros_like(h), np.zeros_like(h)
    for t in range(int(upto.max())):
        e = ((ret[t] - mean) ** 2)[:, None]
        total += np.log(h) + e / h
        h = base + a * e + b * h
        done = upto == t + 1
        if done.any():
            loss[done], after[done] = total[done], h[done]
    return loss, after


def _garch_forecast(fit: tuple, horizon: int, year: int) -> tuple[float, float, bool, float]:
    a, p, converged, v, after = fit
    mean = v + (after - v) * (1 - p**horizon) / (horizon * (1 - p))
    return a, p - a, converged, sqrt(mean) * sqrt(year)


def age(rows: DataFrame, most: int) -> DataFrame:
    """trained, today, age_days, retrain: whether a model is too old or there is none."""
    days = F.date_diff("today", "trained")
    return rows.select("trained", "today", days.alias("age_days"), F.coalesce(days > most, F.lit(True)).alias("retrain"))


def save(model: boosting.Model, spark: SparkSession, path: str, trained) -> None:
    """A model's trees with its metadata beside them: trained (a date), trees, features."""
    boosting.to_rows(spark, model).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(trained, len(model.trees), model.features)], "trained date, trees long, features array<string>").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[boosting.Model, DataFrame] | None:
    """The model and its metadata; None if there is none (the metadata is written last)."""
    if not exists(spark, f"{path}/meta"):
        return None
    meta = spark.read.parquet(f"{path}/meta")
    return boosting.from_rows(spark.read.parquet(f"{path}/trees"), meta.first()["features"]), meta


def due(spark: SparkSession, path: str, today, most: int, forced: bool = False) -> tuple[bool, str]:
    """Whether to train, and why: absent, forced, old (more than ``most`` days) or fresh."""
    found = load(spark, path)
    if found is None:
        return True, "absent"
    old = age(found[1].select("trained", F.lit(today).cast("date").alias("today")), most).first()["retrain"]
    return (True, "forced") if forced else (old, "old" if old else "fresh")
