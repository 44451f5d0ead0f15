"""Registry of named queries, each with the columns it shows and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TEXT: dict[str, str] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple((c.split(":") + [""])[:2]) for c in columns.split()]


def _show(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Fixed output types: i whole number, d<n> double rounded to n digits, s text, b boolean, none as it is."""
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind.startswith("d"):
            c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        elif kind == "b":
            c = c.cast("boolean")
        out.append(c.alias(name))
    return df.select(*out)


def _show_sql(text: str, columns: list[tuple[str, str]]) -> str:
    out = []
    for name, kind in columns:
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "s":
            c = f"CAST({c} AS VARCHAR)"
        elif kind.startswith("d"):
            c = f"round(CAST({c} AS DOUBLE), {int(kind[1:] or 6)}) + 0E0"
        elif kind == "b":
            c = f"CAST({c} AS BOOLEAN)"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM (\n{text}\n) AS shown"


def query(name: str, columns: str, sql: str | None = None, needs: str = "", extra: dict | None = None):
    """Register ``fn(views)``; ``sql`` may use the views named in ``needs``."""
    cols = _parse(columns)

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: _show(fn(Views(spark, folder)), cols)
        if sql is not None:
            SQL_TEXT[name] = _show_sql(with_views(needs, sql, extra), cols)
        return fn

    return add


def load_all() -> None:
    from meterlake.plans import (  # noqa: F401
        base_queries,
        join_queries,
        window_queries,
        rollup_queries,
        peer_grid_queries,
        score_queries,
        forecast_queries,
        stream_queries,
        structure_queries,
    )
