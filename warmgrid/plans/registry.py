"""Query registry: one Spark callable and, where SQL can say it, one oracle.

Both sides are projected to the same declared output columns so results can be
compared value by value: floats are rounded to four decimals, dates and times
become text, counts become 64-bit integers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmgrid.sources.fixture_tables import ORACLE_TABLES, FixtureTables

NUDGE = 1e-9


@dataclass(frozen=True)
class Query:
    name: str
    survey_ids: tuple[str, ...]
    out: dict[str, str]
    build: Callable[[FixtureTables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, out: str, sql: str | None = None):
    """Register a query; ``out`` lists ``column:type`` with i, f, s, d, t or b."""

    def wrap(fn):
        assert name not in QUERIES, name
        cols = dict(x.split(":") for x in out.split())
        QUERIES[name] = Query(name, tuple(ids.split()), cols, fn, sql)
        return fn

    return wrap


def _spark_col(name: str, kind: str):
    col = F.col(name)
    if kind == "i":
        col = col.cast("bigint")
    elif kind == "f":
        col = F.round(col.cast("double") + F.lit(NUDGE), 4) + F.lit(0.0)
    elif kind == "d":
        col = F.date_format(col, "yyyy-MM-dd")
    elif kind == "t":
        col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    elif kind == "s":
        col = col.cast("string")
    elif kind == "b":
        col = col.cast("boolean")
    return col.alias(name)


def _sql_col(name: str, kind: str) -> str:
    body = {
        "i": f"CAST({name} AS BIGINT)",
        "f": f"round(CAST({name} AS DOUBLE) + 1e-9, 4) + CAST(0.0 AS DOUBLE)",
        "d": f"strftime({name}, '%Y-%m-%d')",
        "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "s": f"CAST({name} AS VARCHAR)",
        "b": f"CAST({name} AS BOOLEAN)",
    }[kind]
    return f"{body} AS {name}"


def spark_query(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q.build(FixtureTables(spark, sf_dir))
        return df.select(*[_spark_col(n, k) for n, k in q.out.items()])

    return run


def _needed(body: str) -> list[str]:
    """Names of the shared tables ``body`` refers to, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in ORACLE_TABLES:
            if name not in order and re.search(rf"\b{name}\b", text):
                if ORACLE_TABLES[name] is text:
                    continue
                visit(ORACLE_TABLES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return order


def oracle_text(q: Query) -> str:
    ctes = [f"{n} AS ({ORACLE_TABLES[n]})" for n in _needed(q.sql)]
    ctes.append(f"final_result AS ({q.sql})")
    cols = ", ".join(_sql_col(n, k) for n, k in q.out.items())
    # RECURSIVE only permits recursive members; plain ones are unaffected
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {cols} FROM final_result"
