"""Cleaning and resampling of meter readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scaling import quantiles


def dense_grid(slots: DataFrame, key: str, ts: str, step: str) -> DataFrame:
    """All slots between the first and last one of each key; absent ones hold nulls.

    ``slots`` has at most one row per key and slot, so afterwards no key has more rows than the time range has
    slots: the bound that lets the per-key windows below stay plain.
    """
    span = slots.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    every = span.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(ts))
    return every.join(slots, [key, ts], "left")


def keep_best(df: DataFrame, keys: Sequence[str], prefer: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``prefer``. A plain aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in prefer]
    best = df.groupBy(*keys).agg(F.max(F.struct(*prefer, *rest)).alias("_best"), F.count(F.lit(1)).alias("copies"))
    return best.select(*keys, "_best.*", "copies")


def is_gap(kwh: str = "kwh", status: str = "communication_status") -> Column:
    return F.col(kwh).isNull() | F.coalesce(F.col(status) == 2, F.lit(False))


def fill_from_series(grid: DataFrame, week_slots: int = 168) -> DataFrame:
    """Stages 1 and 2: mean of both neighbours (as read), then the same slot one week before."""
    w = Window.partitionBy("meter_id").orderBy("hour_ts")
    gap = is_gap()
    one = grid.withColumns(
        {
            "was_gap": gap,
            "kwh_1": F.when(gap, (F.lag("kwh").over(w) + F.lead("kwh").over(w)) / 2).otherwise(F.col("kwh")),
        }
    )
    return one.withColumn("kwh_2", F.coalesce("kwh_1", F.lag("kwh_1", week_slots).over(w)))


def day_type(ts: str) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def peer_medians(observed: DataFrame, peers: DataFrame, kwh: str = "kwh") -> DataFrame:
    """Exact median per peer group, hour and day type, without gathering a group's values in one buffer."""
    rows = observed.join(peers.select("meter_id", "peer_cluster_id"), "meter_id").where(
        F.col("peer_cluster_id").isNotNull()
    )
    keyed = rows.select(
        "peer_cluster_id", F.hour("hour_ts").alias("hour"), day_type("hour_ts").alias("is_weekend"), F.col(kwh).alias("_x")
    )
    return quantiles(keyed, ["peer_cluster_id", "hour", "is_weekend"], "_x", {"peer_median": 0.5})


def impute(grid: DataFrame, peers: DataFrame, week_slots: int = 168, observed: DataFrame | None = None) -> DataFrame:
    """Three-stage cascade. ``imputation_stage`` is 0 for rows as read, null where nothing could fill the gap.

    ``observed`` may name the slots before densifying, which saves building the grid once more for the medians.
    """
    extra = [c for c in grid.columns if c not in ("meter_id", "hour_ts", "kwh")]
    filled = fill_from_series(grid, week_slots)
    medians = peer_medians((grid if observed is None else observed).where(~is_gap()), peers)
    rows = filled.join(peers.select("meter_id", "peer_cluster_id"), "meter_id", "left").withColumns(
        {"hour": F.hour("hour_ts"), "is_weekend": day_type("hour_ts")}
    )
    out = rows.join(medians, ["peer_cluster_id", "hour", "is_weekend"], "left")
    stage = (
        F.when(~F.col("was_gap"), 0)
        .when(F.col("kwh_1").isNotNull(), 1)
        .when(F.col("kwh_2").isNotNull(), 2)
        .when(F.col("peer_median").isNotNull(), 3)
    )
    return out.select(
        "meter_id",
        "hour_ts",
        F.col("kwh").alias("kwh_read"),
        F.coalesce("kwh_2", "peer_median").alias("kwh"),
        F.col("was_gap").alias("is_imputed"),
        stage.alias("imputation_stage"),
        *extra,
    )


def drop_values(grid: DataFrame, one_in: int = 10) -> DataFrame:
    """Hide about one value in ``one_in`` by a fixed rule on the key; the truth stays in ``kwh_true``."""
    hours = F.floor(F.unix_timestamp("hour_ts") / 3600)
    hide = F.pmod(F.col("meter_id") * 31 + hours * 17, F.lit(one_in)) == 0
    return grid.withColumn("kwh_true", F.col("kwh")).withColumn("kwh", F.when(~hide, F.col("kwh")))


def quality_counts(readings: DataFrame, low: float, high: float) -> DataFrame:
    return readings.groupBy("meter_id", F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("kwh").isNull()).alias("null_kwh"),
        F.count_if((F.col("kwh") < low) | (F.col("kwh") > high)).alias("out_of_range_kwh"),
        F.count_if(F.col("voltage_v") > 224).alias("high_voltage"),
    )


def clip_negative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def completeness(slots: DataFrame) -> DataFrame:
    """Expected and received slots per meter and day, from a dense grid with a ``readings`` count."""
    return slots.groupBy("meter_id", F.to_date("hour_ts").alias("date")).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("readings").alias("received"),
        F.coalesce(F.sum("readings"), F.lit(0)).alias("rows"),
        F.count_if(F.col("readings").isNotNull() & F.col("kwh").isNull()).alias("null_slots"),
        F.coalesce(F.sum(F.col("readings") - 1), F.lit(0)).alias("duplicates"),
    ).withColumns(
        {
            "missing": F.col("expected") - F.col("received"),
            "completeness_pct": F.col("received") * 100.0 / F.col("expected"),
            "quality_score": F.greatest(
                F.lit(0.0), (F.col("received") - F.col("null_slots")) / F.col("expected").cast("double")
            ),
        }
    )
