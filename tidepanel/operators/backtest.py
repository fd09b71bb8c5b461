"""Forward returns, cost-aware ledgers and variant comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.portfolio import WeightFn, folded_books, top_n


def forward_returns(panel: DataFrame, forms: DataFrame) -> DataFrame:
    """form_date, period, isin, ret from the entry close to the last close up to the exit; no entry bar, no row.

    Holding windows are disjoint, so sessions map to one period and the returns are one grouping.
    """
    inside = forms.select("form_date", "period", "entry_s", F.explode(F.sequence("entry_s", "exit_s")).alias("s"))
    rows = panel.select("isin", "s", "adj_close").where("adj_close is not null").join(F.broadcast(inside), "s")
    found = rows.groupBy("form_date", "period", "isin").agg(F.max(F.when(F.col("s") == F.col("entry_s"), F.col("adj_close"))).alias("start"), F.max_by("adj_close", "s").alias("end"))
    return found.where("start is not null").select("form_date", "period", "isin", (F.col("end") / F.col("start") - 1).alias("ret"))


def tradable(weights: DataFrame, fwd: DataFrame, keys: list[str]) -> DataFrame:
    """Books without the names that had no entry bar, weights spread over the others."""
    rows = weights.join(fwd.select("period", "isin", "ret"), ["period", "isin"])
    return rows.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys, "period")))


def turnover(books: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, turnover: half the sum of weight changes against the book before (k numbers the books of a key)."""
    numbered = books.select(*keys, "period").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("period")))
    now = books.join(F.broadcast(numbered), [*keys, "period"]).select(*keys, "k", "isin", "weight")
    last = numbered.groupBy(*keys).agg(F.max("k").alias("top"))
    before = now.withColumn("k", F.col("k") + 1).withColumnRenamed("weight", "old").join(F.broadcast(last), keys).where(F.col("k") <= F.col("top")).drop("top")
    both = now.join(before, [*keys, "k", "isin"], "full_outer")
    return both.groupBy(*keys, "k").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("turnover"))


def ledger(books: DataFrame, forms: DataFrame, cost_bps: float, keys: list[str]) -> DataFrame:
    """One row a key and period: size, gross return, turnover, cost, net return and running equities.

    ``books``: keys, period, isin, weight, ret. The first book pays for half a turn.
    """
    numbered = books.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n_holdings"), F.sum(F.col("weight") * F.col("ret")).alias("gross_return"))
    numbered = numbered.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("period")))
    rows = numbered.join(turnover(books, keys), [*keys, "k"]).join(F.broadcast(forms.select("period", "form_date", "entry", "exit")), "period")
    rows = rows.withColumn("cost", F.col("turnover") * 2 * cost_bps / 1e4).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"gross_equity": F.product(1 + F.col("gross_return")).over(w), "net_equity": F.product(1 + F.col("net_return")).over(w)})
    return rows.select(*keys, "form_date", "entry", "exit", "n_holdings", "gross_return", "turnover", "cost", "net_return", "gross_equity", "net_equity")


def clip(forms: DataFrame, start: str | None = None, end: str | None = None, last: DataFrame | None = None) -> DataFrame:
    """Rebalances formed within start and end, and not after the one date in ``last`` (of the newest filing, say)."""
    rows = forms if start is None else forms.where(F.col("form_date") >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.where(F.col("form_date") <= F.lit(end).cast("date"))
    if last is None:
        return rows
    return rows.join(F.broadcast(last.toDF("_last")), F.col("form_date") <= F.col("_last")).drop("_last")


Hook = Callable[[DataFrame, DataFrame], DataFrame]


def _scored(panel: DataFrame, forms: DataFrame, universe_fn: Hook, score_fn: Hook) -> DataFrame:
    """form_date, period, isin, score of the universe's names that have one."""
    scores = score_fn(panel, forms).where("score is not null").join(universe_fn(panel, forms).select("form_date", "isin"), ["form_date", "isin"], "left_semi")
    return scores.join(F.broadcast(forms.select("form_date", "period")), "form_date").select("form_date", "period", "isin", "score")


def run(panel: DataFrame, forms: DataFrame, universe_fn: Hook, score_fn: Hook, weight_fn: Callable[[DataFrame], DataFrame], cost_bps: float) -> DataFrame:
    """The ledger of a walk-forward run with the caller's own functions, each over all dates at once.

    universe_fn(panel, forms) gives form_date, isin; score_fn(panel, forms) gives form_date, isin, score from
    bars up to each form_date; weight_fn(scores) takes form_date, period, isin, score of the universe and
    gives period, isin, weight of the books (names without a score don't come). For weights that depend on the
    held book see ``run_held``.
    """
    books = weight_fn(_scored(panel, forms, universe_fn, score_fn)).select(F.lit("run").alias("variant"), "period", "isin", "weight")
    return ledger(tradable(books, forward_returns(panel, forms), ["variant"]), forms, cost_bps, ["variant"]).drop("variant")


def run_held(panel: DataFrame, forms: DataFrame, universe_fn: Hook, score_fn: Hook, weight_fn: WeightFn, cost_bps: float, variants: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """The ledger of ``run`` with a weight function that sees the held book: (rows of a period, held) to weights.

    Scores, ranks and returns of all dates are made in one plan; only the fold over periods is in order
    (``folded_books``). ``variants`` (variant and parameters, a small table) runs all of them at once, its columns
    beside the rows of each. ``deepest`` is the last rank that a book may hold, all by default.
    """
    ranked = top_n(_scored(panel, forms, universe_fn, score_fn), deepest or (1 << 31) - 1, ["period"], "score")
    ranked = ranked.join(forward_returns(panel, forms).select("period", "isin", "ret"), ["period", "isin"], "left")
    ranked = ranked.withColumn("variant", F.lit("run")) if variants is None else ranked.crossJoin(F.broadcast(variants))
    return ledger(folded_books(ranked, weight_fn), forms, cost_bps, ["variant"])
