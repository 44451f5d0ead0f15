"""Joins between readings, registers, grid, weather, calendar, alerts and audits.

No side carries a broadcast hint: adaptive execution broadcasts a side once its measured size is below the
session's threshold, and splits skewed sides of the shuffled joins otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scaling import join_null_safe, running

# Event names and types that get a flag of their own
HOLIDAY_TYPES = ("national_holiday", "state_holiday")


def calendar_flags(calendar: DataFrame) -> DataFrame:
    """One row per date with a flag per kind of event and the summed demand impact."""
    kind, name = F.col("event_type"), F.col("event_name")
    return calendar.groupBy("date").agg(
        F.bool_or(kind == "national_holiday").alias("is_national_holiday"),
        F.bool_or(kind == "state_holiday").alias("is_state_holiday"),
        F.bool_or(kind.isin(*HOLIDAY_TYPES)).alias("is_holiday"),
        F.bool_or(kind == "industrial_shutdown").alias("is_shutdown"),
        F.bool_or(name == "Ugadi").alias("is_ugadi"),
        F.bool_or(name == "Deepawali").alias("is_deepawali"),
        F.bool_or(name.contains("Ramadan")).alias("is_ramadan"),
        F.bool_or(name.contains("IPL")).alias("is_ipl_evening"),
        F.sum("expected_demand_impact").alias("total_demand_impact"),
    )


def with_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    flags = calendar_flags(calendar)
    filled = {c: F.coalesce(c, F.lit(False)) for c in flags.columns if c.startswith("is_")}
    filled["total_demand_impact"] = F.coalesce("total_demand_impact", F.lit(0.0))
    return df.join(flags, "date", "left").withColumns(filled)


def with_zone_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Impact and event count per (date, zone); an event without zones counts in every zone."""
    split = calendar.withColumn("zone", F.explode_outer(F.split("zones_csv", ",")))
    per_zone = split.where(F.col("zone").isNotNull()).groupBy("date", "zone").agg(
        F.sum("expected_demand_impact").alias("_zi"), F.count(F.lit(1)).alias("_zn")
    )
    everywhere = split.where(F.col("zone").isNull()).groupBy("date").agg(
        F.sum("expected_demand_impact").alias("_ai"), F.count(F.lit(1)).alias("_an")
    )
    out = df.join(everywhere, "date", "left").join(per_zone, ["date", "zone"], "left")
    zero = F.lit(0)
    return out.withColumns(
        {
            "zone_demand_impact": F.coalesce("_zi", F.lit(0.0)) + F.coalesce("_ai", F.lit(0.0)),
            "zone_events": F.coalesce("_zn", zero) + F.coalesce("_an", zero),
        }
    ).drop("_zi", "_zn", "_ai", "_an")


def peer_statistics(slots: DataFrame, peers: DataFrame) -> DataFrame:
    rows = slots.join(peers.select("meter_id", "peer_cluster_id"), "meter_id").where(F.col("peer_cluster_id").isNotNull())
    return rows.groupBy("peer_cluster_id", "hour_ts").agg(
        F.avg("kwh").alias("peer_mean"),
        F.stddev("kwh").alias("peer_std"),
        F.percentile_approx("kwh", 0.5).alias("peer_median"),
    )


def with_peers(slots: DataFrame, peers: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Peer statistics of the same slot, deviation ratio and z-score; meters without a group keep nulls.

    ``stats`` may be the written ``peer_statistics`` of the slots: a table known to be small moves instead of the slots.
    """
    stats = (peer_statistics(slots, peers) if stats is None else stats).withColumnRenamed("peer_cluster_id", "_pk")
    rows = slots.join(peers.select("meter_id", "peer_cluster_id"), "meter_id", "left")
    # meters without a group get keys of their own, so that nulls do not gather in one partition
    rows = rows.withColumn("_pk", F.coalesce(F.col("peer_cluster_id").cast("bigint"), -1 - F.col("meter_id")))
    stats = stats.withColumn("_pk", F.col("_pk").cast("bigint"))
    out = rows.join(stats, ["_pk", "hour_ts"], "left").drop("_pk")
    return out.withColumns(
        {
            "peer_dev_ratio": F.when(F.col("peer_mean") > 0, F.col("kwh") / F.col("peer_mean")),
            "z_vs_peer": F.when(F.col("peer_std") > 0, (F.col("kwh") - F.col("peer_mean")) / F.col("peer_std")),
        }
    )


def feeder_balance(slots: DataFrame, topology: DataFrame, feeder: DataFrame, loss_limit: float = 0.08) -> DataFrame:
    """Input against billed energy per feeder and slot: loss ratio, loss label, input-below-metered check."""
    billed = (
        slots.select("meter_id", "hour_ts", "kwh")
        .join(topology.select("meter_id", "feeder_id"), "meter_id")
        .groupBy("feeder_id", F.col("hour_ts").alias("timestamp"))
        .agg(F.sum("kwh").alias("billed_kwh"))
    )
    out = feeder.join(billed, ["feeder_id", "timestamp"], "left")
    ratio = F.when(F.col("feeder_input_kwh") > 0, (F.col("feeder_input_kwh") - F.col("billed_kwh")) / F.col("feeder_input_kwh"))
    return out.withColumns(
        {
            "upstream_loss_ratio": ratio,
            "loss_violation": ratio > loss_limit,
            "input_covers_metered": F.col("feeder_input_kwh") >= F.col("billed_kwh"),
        }
    )


def with_topology(slots: DataFrame, topology: DataFrame, feeder: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    """Place in the grid, input and loss of the feeder; ``balance`` may be the written ``feeder_balance`` of the slots."""
    balance = (feeder_balance(slots, topology, feeder) if balance is None else balance).select(
        "feeder_id", F.col("timestamp").alias("hour_ts"), "feeder_input_kwh", "upstream_loss_ratio"
    )
    rows = slots.join(topology.select("meter_id", "feeder_id", "transformer_id", "transformer_rated_kva"), "meter_id", "left")
    return rows.join(balance, ["feeder_id", "hour_ts"], "left").withColumn(
        "feeder_load_share", F.when(F.col("feeder_input_kwh") > 0, F.col("kwh") / F.col("feeder_input_kwh"))
    )


def with_weather(slots: DataFrame, weather: DataFrame, registry: DataFrame) -> DataFrame:
    """Zone weather of the slot's hour; finer weather is first averaged to one row per zone and hour."""
    hourly = weather.groupBy(F.col("zone_id").alias("zone"), F.date_trunc("hour", "timestamp").alias("hour_ts")).agg(
        F.avg("temp_c").alias("temp_c"), F.avg("humidity_pct").alias("humidity_pct"), F.sum("rainfall_mm").alias("rainfall_mm")
    )
    rows = slots.join(registry.select("meter_id", "zone"), "meter_id", "left")
    return rows.join(hourly, ["zone", "hour_ts"], "left")


def valid_topology(daily: DataFrame, topology: DataFrame) -> DataFrame:
    """Topology row in force on the day: equal meter, valid_from <= date < valid_to (open when null)."""
    t = topology.select(F.col("meter_id").alias("_m"), "transformer_id", "transformer_rated_kva", "valid_from", "valid_to")
    inside = (F.col("valid_from") <= F.col("date")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to")))
    return daily.join(t, (F.col("meter_id") == F.col("_m")) & inside, "left").drop("_m")


def near_dates(events: DataFrame, days: int) -> DataFrame:
    """All dates within ``days`` of an event, once each."""
    span = F.sequence(F.date_sub("date", days), F.date_add("date", days))
    return events.select(F.explode(span).alias("date")).distinct()


def explained(changes: DataFrame, calendar: DataFrame, days: int = 2) -> DataFrame:
    return changes.join(near_dates(calendar, days), "date", "left_semi")


def unexplained(changes: DataFrame, calendar: DataFrame, days: int = 2) -> DataFrame:
    return changes.join(near_dates(calendar, days), "date", "left_anti")


def listed(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, size: int = 200) -> DataFrame:
    """Ordered lists per key in segments of at most ``size`` items, so that no list outgrows a row."""
    numbered = running(df, keys, bucket, order, number="_i", small=True).withColumn("segment", F.floor((F.col("_i") - 1) / size))
    lists = numbered.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(F.struct("_i", value.alias("item")))).alias("_l"))
    return lists.select(*keys, "segment", F.transform("_l", lambda x: x["item"]).alias("items"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, bucket: str = "hour") -> DataFrame:
    """Last right value at or before each left row.

    Both sides are cut by time bucket; the last value of the earlier buckets is carried in by a small table,
    so a key's whole history is never one window.
    """
    tag = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    add = right.select(key, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = tag.unionByName(add, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, ts))
    last = both.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(ts))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(key, "_b").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry"))
    # a null key or time equals none, so such a row stays and gets no value
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    rows = join_null_safe(both, carried, [key, "_b"]).withColumn(out, F.when(known, seen))
    return rows.where(F.col("_side") == 1).drop("_side", "_v", "_b", "_carry")
