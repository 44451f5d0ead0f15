"""Filters, searches, sorts, top-k, pages and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status names of callers and as stored; action names and the state they lead to
STATUS_NAMES = {"open": "Open", "assigned": "Assigned", "suppressed": "Snoozed", "closed": "Resolved"}
ACTION_STATES = {"assign": "Assigned", "snooze": "Snoozed", "close": "Resolved", "reopen": "Open"}
MAP_LINK = "https://www.google.com/maps/search/?api=1&query="


def filter_alerts(alerts: DataFrame, risk: str = "all", status: str = "all") -> DataFrame:
    out = alerts
    if risk != "all":
        out = out.where(F.lower("severity") == risk.lower())
    if status != "all":
        out = out.where(F.col("status") == STATUS_NAMES.get(status.lower(), status))
    return out


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    joined = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return df.where(F.contains(F.lower(joined), F.lit(text.lower()))).select(*columns)


def map_link(latitude: Column, longitude: Column) -> Column:
    return F.concat(F.lit(MAP_LINK), latitude, F.lit(","), longitude)


def top(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Sort and limit together: Spark keeps only ``rows`` rows per task before the merge."""
    return df.orderBy(*order).limit(rows)


def last_ascending(df: DataFrame, newest_first: list[Column], rows: int, ascending: list[Column]) -> DataFrame:
    return df.orderBy(*newest_first).limit(rows).orderBy(*ascending)


def top_per_key(df: DataFrame, keys: Sequence[str], order: list[Column], rows: int) -> DataFrame:
    """First ``rows`` rows per key. Spark limits each group in every task before the shuffle (window group limit),
    so at most tasks x rows rows of one key meet, however large the key is. The session's limit for that is raised
    where more rows are wanted."""
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    if rows > int(df.sparkSession.conf.get(limit, "1000")):
        df.sparkSession.conf.set(limit, str(rows))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows)


def clamp(asked: int, cap: int) -> int:
    return max(1, min(asked, cap))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page and the total row count; the total is a scalar subquery, the page a bounded top-k."""
    total = df.groupBy().agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def differences(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows only in one side, with multiplicity, and the rows in both (as a set)."""
    return (
        other.exceptAll(base).withColumn("side", F.lit("added"))
        .unionByName(base.exceptAll(other).withColumn("side", F.lit("removed")))
        .unionByName(base.intersect(other).withColumn("side", F.lit("both")))
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_best"))
    return best.select(*keys, "_best.*")
