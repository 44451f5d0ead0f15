"""Sketches stored per day and merged over any range of days, so that no reading is read twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers (as a power of two) of a distinct-count sketch, and items of a quantile sketch.
HLL_BITS, KLL_ITEMS = 12, 400
#: What a sketch of this size may be off: share of the count (3 deviations), and rank.
COUNT_ERROR, RANK_ERROR = 0.05, 0.02


def daily_sketches(rows: DataFrame, keys: Sequence[str], ts: str, item: str, value: str) -> DataFrame:
    """(keys, date, rows, items, values): one sketch of the distinct items and one of the values per key and day.

    Tasks send sketches of a few kilobytes, however many rows a key has. Null items and values are left out.
    """
    return rows.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(item, HLL_BITS).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_ITEMS).alias("values"),
    )


def merged(sketches: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Sketches of several days or keys as one; merging in any order gives estimates of the same quality."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def distinct_items(items: Column | str = "items") -> Column:
    return F.hll_sketch_estimate(items)


def value_at(share: float, values: Column | str = "values") -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(share))


def share_below(value: Column, values: Column | str = "values") -> Column:
    return F.kll_sketch_get_rank_double(values, value)
