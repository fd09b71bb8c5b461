"""Identity links, corporate actions and back-adjusted prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.config import Config
from tidepanel.functions.tables import dealt, stored
from tidepanel.operators.calendar import calendar, indexed


class LinkCycleError(ValueError):
    """Identities hand over to each other in a circle."""


def by_date() -> Window:
    return Window.partitionBy("isin").orderBy("date")


def isin_links(panel: DataFrame) -> DataFrame:
    """isin, canonical_isin of every isin: the last identity of its chain of handovers (``handed``), or itself."""
    return panel.select("isin").distinct().join(handed(panel), "isin", "left").withColumn("canonical_isin", F.coalesce("canonical_isin", "isin"))


def handed(panel: DataFrame) -> DataFrame:
    """isin, canonical_isin of the isins that hand over: the last identity of the chain, through any number of symbols.

    A handover is a symbol's next identity that begins exactly one session after the former ends; of
    several, the one under the symbol that sorts last counts. Links (few: one for each handover) are
    followed to their ends by joining them with themselves, which doubles their reach each time. A cycle of
    handovers has no end: ``LinkCycleError`` names its identities.
    """
    cal = F.broadcast(calendar(panel))
    spans = panel.groupBy("symbol", "isin").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    spans = spans.join(cal.toDF("first", "first_s"), "first").join(cal.toDF("last", "last_s"), "last")
    w = Window.partitionBy("symbol").orderBy("first", "isin")
    steps = spans.withColumn("to", F.when(F.lead("first_s").over(w) == F.col("last_s") + 1, F.lead("isin").over(w))).where("to <> isin")
    links = first = stored(steps.groupBy("isin").agg(F.max_by("to", "symbol").alias("to")), "links")
    n, reach = links.count(), 1
    while reach <= n:
        hop = links.select(F.col("isin").alias("to"), F.col("to").alias("far"))
        further = stored(links.join(hop, "to", "left").select("isin", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "links")
        links, reach = further.select("isin", "to"), reach * 2
        if further.where("moved").isEmpty():
            break
    # after as many steps as there are links a chain has ended; what can still move goes round
    endless = links.join(first.select(F.col("isin").alias("to")), "to", "left_semi").orderBy("isin").limit(20).collect()
    if endless:
        raise LinkCycleError(f"handovers go in a circle: {', '.join(r['isin'] for r in endless)}")
    return links.select("isin", F.col("to").alias("canonical_isin"))


def apply_links(panel: DataFrame, links: DataFrame) -> DataFrame:
    """The panel under canonical identities, with original_isin."""
    rows = panel.withColumnRenamed("isin", "original_isin").join(links.withColumnRenamed("isin", "original_isin"), "original_isin", "left")
    return rows.withColumn("isin", F.coalesce("canonical_isin", "original_isin")).drop("canonical_isin")


def _factor(cfg: Config):
    prior = F.lag("close").over(by_date())
    f = F.when(prior > 0, F.col("prevclose") / prior)
    f = F.when(f.between(cfg.action_low, cfg.action_high), f).otherwise(F.lit(1.0))
    return F.when(F.abs(f - 1) > cfg.action_tolerance, f).otherwise(F.lit(1.0))


def detect_actions(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """isin, date, factor of every corporate action: a close restated by the next session's previous close."""
    return panel.select("isin", "date", _factor(cfg).alias("factor")).where(F.col("factor") != 1)


def adjusted(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The panel with adj_factor (product of all later factors) and adj_close; the last adj_close is the close."""
    later = Window.partitionBy("isin").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    rows = panel.withColumn("factor", _factor(cfg)).withColumn("adj_factor", F.coalesce(F.product("factor").over(later), F.lit(1.0)))
    return rows.withColumn("adj_close", F.col("close") * F.col("adj_factor")).drop("factor")


def prepared(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Linked, adjusted and indexed: what all later operators take.

    The panel is joined with the few identities that hand over, and dealt by isin once; the calendar is that of the panel as given.
    """
    linked = apply_links(panel, handed(panel))
    return indexed(adjusted(dealt(linked, "isin", panel.count()), cfg), calendar(panel))


def returns(panel: DataFrame, gap: str = "null", cap: float | None = 0.5) -> DataFrame:
    """The (indexed, adjusted) panel with ``ret``, beyond +-cap null.

    gap: "null" gives no return over a missing session, "row" goes from bar to bar. For "pad" see ``padded``.
    """
    w = Window.partitionBy("isin").orderBy("s")
    before, prior = F.lag("adj_close").over(w), F.lag("s").over(w)
    r = F.when(before > 0, F.col("adj_close") / before - 1)
    r = F.when(F.col("s") - prior == 1, r) if gap == "null" else r
    return panel.withColumn("ret", r if cap is None else F.when(F.abs(r) <= cap, r))


def padded(panel: DataFrame, cap: float | None = 0.5) -> DataFrame:
    """date, s, isin, adj_close, ret on every session from an isin's first to the calendar's last; the last price is carried, so a gap returns 0."""
    cal = calendar(panel)
    first = panel.groupBy("isin").agg(F.min("s").alias("from"))
    grid = first.join(F.broadcast(cal.toDF("date", "s")), F.col("s") >= F.col("from"))
    rows = grid.join(panel.select("isin", "s", "adj_close"), ["isin", "s"], "left")
    w = Window.partitionBy("isin").orderBy("s")
    rows = rows.withColumn("adj_close", F.last("adj_close", ignorenulls=True).over(w))
    r = F.col("adj_close") / F.lag("adj_close").over(w) - 1
    return rows.select("date", "s", "isin", "adj_close", (r if cap is None else F.when(F.abs(r) <= cap, r)).alias("ret"))
