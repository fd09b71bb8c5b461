"""Trading calendar: observed sessions with a dense index, and what follows from it.

Only the calendar (one row a session) is ever ordered globally; panels get the index by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """date, s: the distinct dates of the panel and their 0-based index."""
    return panel.select("date").distinct().withColumn("s", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def indexed(panel: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """The panel with the session index ``s``."""
    return panel.join(F.broadcast(calendar(panel) if cal is None else cal), "date")


def month_ends(cal: DataFrame) -> DataFrame:
    """month, date, s: the last observed session of every calendar month."""
    return cal.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"), F.max("s").alias("s"))


def rebalances(cal: DataFrame, warmup: int = 0) -> DataFrame:
    """form_date, form_s, entry, entry_s, exit, exit_s, period: entry one session after formation, exit at the next month end."""
    ends = month_ends(cal).where(F.col("s") >= warmup)
    w = Window.orderBy("s")
    nxt = cal.select((F.col("s") - 1).alias("s"), F.col("date").alias("entry"))
    rows = ends.select(F.col("date").alias("form_date"), "s", F.lead("date").over(w).alias("exit"), F.lead("s").over(w).alias("exit_s"))
    rows = rows.join(nxt, "s").where(F.col("entry") < F.col("exit"))
    return rows.select("form_date", F.col("s").alias("form_s"), "entry", (F.col("s") + 1).alias("entry_s"), "exit", "exit_s", (F.row_number().over(w) - 1).cast("long").alias("period"))


def covering(forms: DataFrame, window: int) -> DataFrame:
    """s, form_date, form_s: the formations whose trailing ``window`` sessions hold session s (calendar-sized)."""
    f = forms.select("form_date", "form_s")
    spread = f.select("form_date", "form_s", F.explode(F.sequence(F.greatest(F.col("form_s") - (window - 1), F.lit(0)), F.col("form_s"))).alias("s"))
    return spread.select("s", "form_date", "form_s")


def missing_days(cal: DataFrame, weekdays_only: bool = True) -> DataFrame:
    """date: calendar days between the first and last session without one."""
    span = cal.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    days = days.where(F.weekday("date") < 5) if weekdays_only else days
    return days.join(F.broadcast(cal.select("date")), "date", "left_anti")


def coverage_by_year(cal: DataFrame) -> DataFrame:
    """year, sessions, weekdays, gap, flagged (a full year whose gap is outside 10 to 20)."""
    bounds = cal.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date"), "a", "b").where(F.weekday("date") < 5)
    full = (F.make_date("year", F.lit(1), F.lit(1)) >= F.col("a")) & (F.make_date("year", F.lit(12), F.lit(31)) <= F.col("b"))
    weekdays = days.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("weekdays"), F.first("a").alias("a"), F.first("b").alias("b"))
    sessions = cal.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("sessions"))
    rows = weekdays.join(sessions, "year", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    gap = F.col("weekdays") - F.col("sessions")
    return rows.select("year", "sessions", "weekdays", gap.alias("gap"), (full & ~gap.between(10, 20)).alias("flagged"))
