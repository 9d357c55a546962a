"""Catalogue of registered queries and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ctes import CTES
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROUND_DP = 6
_UNIT = 10.0**ROUND_DP


def rounded(c: Column) -> Column:
    """Half up at the sixth decimal of the product in binary, as SQL's round of a double goes: a tie in decimals falls alike in both engines."""
    whole = F.round(c * _UNIT)
    return F.when(F.abs(whole) < float("inf"), whole / _UNIT).otherwise(c)


def presentable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, instants to ISO text, so that engines compare alike."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double")) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_ctes(sql: str) -> str:
    """Prefix the statement with the named views it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its oracle if SQL can say it."""
    def deco(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(Views(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return deco
