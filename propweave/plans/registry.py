"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propweave.plans.fixtures import Tables
from propweave.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, if given, the equivalent SQL."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add


def with_views(sql: str) -> str:
    """Put the named fixture views a statement uses in front of it as a WITH clause."""
    names: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in names:
                visit(VIEWS[name])
                if name not in names:
                    names.append(name)
    visit(sql)
    if not names:
        return sql.strip()
    heads = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[5:]}"
    return f"with {heads}\n{body}"


def r6(c: str | Column) -> Column:
    """Doubles are compared to six places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


def text(c: str | Column, sep: str = " ") -> Column:
    """Array column as text, so that results compare the same in every engine."""
    a = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)
