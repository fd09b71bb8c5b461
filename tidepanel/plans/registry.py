"""Registered queries with their SQL counterpart, put together from named common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.config import WEEKLY, Config
from tidepanel.functions.tables import once
from tidepanel.operators.adjust import prepared
from tidepanel.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Without the CTEs; ``all_sql`` puts them in front.
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(**texts: str) -> None:
    CTES.update(texts)


def copied(prefix: str, names: list[str], changes: dict[str, list[tuple[str, str]]]) -> None:
    """Further CTEs like those named, under a prefix, that read each other; ``changes`` are replacements in the text of some."""
    ends = "ON|USING|WHERE|GROUP|ORDER|JOIN|LEFT|FULL|CROSS|WINDOW|HAVING|QUALIFY|UNION|LIMIT"
    for name in names:
        text = CTES[name]
        for old, new in changes.get(name, []):
            if old not in text:
                raise ValueError(f"{name} does not contain {old}")
            text = text.replace(old, new)
        one = rf"\b(FROM|JOIN) ({'|'.join(names)})\b(?! (?!(?:{ends})\b)[A-Za-z])"
        text = re.sub(one, rf"\1 {prefix}\2 AS \2", text)
        CTES[prefix + name] = re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b(?! AS \2\b)", rf"\1 {prefix}\2", text)


def with_ctes(text: str) -> str:
    """The text with exactly the CTEs that it uses, directly or through others, in front."""
    used: dict[str, str] = {}

    def visit(t: str, seen: tuple[str, ...] = ()) -> None:
        for name, own in CTES.items():
            inner = re.search(rf"\b{name} AS \(", t)  # the text's own table of that name
            if name not in used and name not in seen and not inner and re.search(rf"\b{name}\b", t):
                visit(own, (*seen, name))
                used[name] = own

    visit(text)
    if not used:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in used.items()) + "\n" + text


def all_sql() -> dict[str, str]:
    """Complete SQL of every registered query that has one."""
    return {name: with_ctes(text) for name, text in SQL.items()}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of the same result."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def config(spark: SparkSession, sf_dir: str) -> Config:
    """The thresholds of the weekly panel's queries."""
    return WEEKLY


@once
def bars_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly bars, written once: calendar, spans and links of an identity start from it several times."""
    return adapters.bars(spark, sf_dir)


@once
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked, adjusted and indexed bar panel."""
    return prepared(bars_table(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, all integers as long, so that results compare by value."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, digits) if kind in ("double", "float") else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(*out)
