"""Selection and sizing of books, for every period and variant at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def top_n(scores: DataFrame, n: int, keys: list[str], score: str = "composite") -> DataFrame:
    """The n best of each key with ``rank``; ties by isin."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "isin")
    return scores.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def equal_weights(chosen: DataFrame, keys: list[str]) -> DataFrame:
    return chosen.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _capped(rows: DataFrame, keys: list[str], name: str, cap: F.Column, order: str) -> DataFrame:
    """``share`` of rows summing to one a key, none above ``cap``: the largest at the cap, the rest scaled.

    With shares sorted downwards, the number of capped ones is the least k for which scaling the rest
    to what the capped leave puts none above the cap; suffix sums are windows.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc(name), order)
    rows = rows.withColumn("_i", F.row_number().over(down)).withColumn("_rest", F.sum(name).over(down.rowsBetween(0, Window.unboundedFollowing))).withColumn("_cap", cap)
    fits = F.col(name) * (1 - (F.col("_i") - 1) * F.col("_cap")) <= F.col("_cap") * F.col("_rest") * (1 + EPS)
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_k", F.min(F.when(fits, F.col("_i") - 1)).over(whole))
    rows = rows.withColumn("_scale", F.max(F.when(F.col("_i") == F.col("_k") + 1, (1 - F.col("_k") * F.col("_cap")) / F.col("_rest"))).over(whole))
    share = F.when(F.col("_k").isNull() | (F.col("_i") <= F.col("_k")), F.col("_cap")).otherwise(F.col(name) * F.col("_scale"))
    return rows.withColumn("share", share).drop("_i", "_rest", "_cap", "_k", "_scale")


def inverse_vol_weights(chosen: DataFrame, keys: list[str], risk: str, max_weight: float, floor: float) -> DataFrame:
    """``weight`` inverse to risk: missing risk is the median of the chosen, no risk at all means equal weights; capped."""
    whole = Window.partitionBy(*keys)
    filled = F.coalesce(F.col(risk), F.median(risk).over(whole), F.lit(1.0))
    rows = chosen.withColumn("_inv", 1 / F.greatest(filled, F.lit(floor))).withColumn("_w", F.col("_inv") / F.sum("_inv").over(whole))
    cap = F.greatest(F.lit(max_weight), F.lit(1.0) / F.count(F.lit(1)).over(whole))
    return _capped(rows, keys, "_w", cap, "isin").withColumnRenamed("share", "weight").drop("_inv", "_w")


def cap_by_group(weights: DataFrame, keys: list[str], group: str, max_group: float) -> DataFrame:
    """Weights scaled so that no group holds more than max_group (or an equal share, if that is infeasible)."""
    totals = weights.groupBy(*keys, group).agg(F.sum("weight").alias("_total"))
    cap = F.greatest(F.lit(max_group), F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    shares = _capped(totals, keys, "_total", cap, group).select(*keys, group, (F.col("share") / F.col("_total")).alias("_scale"))
    return weights.join(shares, [*keys, group]).withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale")


def buffer_step(ranked: DataFrame, held: DataFrame, n: int, mult: float, keys: list[str]) -> DataFrame:
    """One rebalance of a buffered book: held names stay while their rank is within n * mult, the best others fill up."""
    rows = ranked.join(held.select(*keys, "isin", F.lit(True).alias("_held")), [*keys, "isin"], "left")
    keep = F.col("_held").isNotNull() & (F.col("rank") <= int(n * mult))
    w = Window.partitionBy(*keys).orderBy(F.desc(keep), "rank")
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).withColumn("kept", keep).drop("_i", "_held")


#: A weight function that sees the book: (one period's rows of a variant by rank, held weights by isin) to weights by isin.
WeightFn = Callable[[pd.DataFrame, dict[str, float]], dict[str, float]]


def folded_books(ranked: DataFrame, weight_fn: WeightFn) -> DataFrame:
    """variant, period, isin, weight, ret of books that depend on the book before.

    ``ranked``: variant, period, isin, rank, ret (null if not tradable) and whatever ``weight_fn`` reads, a
    variant's parameters among them. Each variant is folded in order of its periods: names that can't be
    traded leave the weights, the others are scaled to one, and what remains is held into the next period; a
    period without a book leaves the held one as it is. A variant's group has its ranked rows only, so leave
    out ranks that can't be chosen.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        out = []
        for period, now in rows.sort_values(["period", "rank"]).groupby("period", sort=True):
            ret = dict(zip(now["isin"], now["ret"], strict=True))
            book = {i: w for i, w in weight_fn(now, held).items() if pd.notna(ret[i]) and w > 0}
            if book:
                total = sum(book.values())
                held = {i: w / total for i, w in book.items()}
                out.append(pd.DataFrame({"variant": rows["variant"].iloc[0], "period": period, "isin": list(held), "weight": list(held.values()), "ret": [ret[i] for i in held]}))
        return pd.concat(out) if out else pd.DataFrame({"variant": [], "period": [], "isin": [], "weight": [], "ret": []})

    return ranked.groupBy("variant").applyInPandas(fold, "variant string, period long, isin string, weight double, ret double")


def kept_and_filled(now: pd.DataFrame, held: dict[str, float], n: int, mult: float) -> list[str]:
    """Held names while their rank is within n * mult, and the best others up to n."""
    kept = [i for i, r in zip(now["isin"], now["rank"], strict=True) if i in held and r <= int(n * mult)][:n]
    have = set(kept)
    return kept + [i for i in now["isin"] if i not in have][: n - len(kept)]


def capped_inverse(risk: pd.Series, max_weight: float, floor: float) -> pd.Series:
    """Weights of one book inverse to risk, as ``inverse_vol_weights`` gives for many."""
    middle = risk.median() if risk.notna().any() else 1.0
    w = 1 / risk.fillna(middle).clip(lower=floor)
    w, cap = w / w.sum(), max(max_weight, 1 / len(w))
    top: set = set()
    while True:
        rest = [i for i in w.index if i not in top]
        left = (1 - cap * len(top)) / w[rest].sum() if rest else 0.0
        over = [i for i in rest if w[i] * left > cap * (1 + EPS)]
        if not over:
            return pd.Series({i: cap if i in top else w[i] * left for i in w.index})
        top.update(over)


def sized_buffer(max_weight: float, floor: float) -> WeightFn:
    """A weight function over the columns n, mult (buffer), sizing (equal or inverse) and vol of its rows."""

    def weigh(now: pd.DataFrame, held: dict[str, float]) -> dict[str, float]:
        first = now.iloc[0]
        chosen = kept_and_filled(now, held, int(first["n"]), float(first["mult"]))
        if first["sizing"] == "inverse":
            return capped_inverse(now.set_index("isin").loc[chosen, "vol"].astype(float), max_weight, floor).to_dict()
        return dict.fromkeys(chosen, 1.0 / len(chosen))

    return weigh


def buffered_books(ranked: DataFrame, n: int) -> DataFrame:
    """variant, period, isin, weight, ret of equal-weight books with a buffer; ``ranked`` has mult beside the columns of ``folded_books``."""
    return folded_books(ranked, lambda now, held: dict.fromkeys(kept_and_filled(now, held, n, float(now["mult"].iloc[0])), 1.0))
