"""Grid topology and energy balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scaling import neighbours
from meterlake.operators.features import risk_from_load
from meterlake.operators.forecast import haversine_km


def nodes(loads: DataFrame) -> DataFrame:
    """Substations once each, then feeders with their parent and risk."""
    sub = loads.groupBy("substation_id").agg(F.sum("meter_count").alias("meter_count"), F.max("load_pct").alias("load_pct"))
    sub = sub.select(
        F.col("substation_id").alias("id"), F.lit("Substation").alias("type"), F.lit(None).cast("string").alias("parent"), "meter_count", "load_pct"
    )
    feeder = loads.select(
        F.col("feeder_id").alias("id"), F.lit("Feeder").alias("type"), F.col("substation_id").alias("parent"), "meter_count", "load_pct"
    )
    return sub.unionByName(feeder).withColumn("risk", risk_from_load(F.col("load_pct")))


def edges(loads: DataFrame) -> DataFrame:
    return loads.select(F.col("substation_id").alias("source"), F.col("feeder_id").alias("target"), F.col("meter_count").alias("weight"))


def shared_transformers(topology: DataFrame) -> DataFrame:
    """Meters that share a transformer, as links meter-transformer in both directions.

    Two meters are neighbours when they link to one transformer, and each meter has ``group_size - 1`` neighbours.
    The links are as many as the meters, where a list of neighbour pairs would grow with the square of a group.
    Feeders with one meter and transformers with one meter have no links.
    """
    t = topology.select("meter_id", "feeder_id", "transformer_id").distinct()
    per_feeder = t.groupBy("feeder_id").agg(F.countDistinct("meter_id").alias("_n")).where(F.col("_n") >= 2)
    per_dt = t.groupBy("feeder_id", "transformer_id").agg(F.countDistinct("meter_id").alias("group_size")).where(F.col("group_size") >= 2)
    links = t.join(per_feeder.select("feeder_id"), "feeder_id").join(per_dt, ["feeder_id", "transformer_id"])
    meter = F.concat(F.lit("M-"), "meter_id")
    ends = F.array(
        F.struct(meter.alias("source"), F.col("transformer_id").alias("target")),
        F.struct(F.col("transformer_id").alias("source"), meter.alias("target")),
    )
    return links.withColumn("_e", F.explode(ends)).select("feeder_id", "_e.source", "_e.target", "group_size")


def neighbour_means(features: DataFrame, topology: DataFrame, vector: str = "profile") -> DataFrame:
    """Mean feature vector of the other meters on the same transformer, and the gap to it.

    Equal to averaging over all neighbour pairs, computed from one sum per transformer and position.
    """
    t = topology.select("meter_id", "feeder_id", "transformer_id").distinct()
    cells = features.join(t, "meter_id").select("meter_id", "feeder_id", "transformer_id", F.posexplode(vector).alias("pos", "x"))
    sums = cells.groupBy("feeder_id", "transformer_id", "pos").agg(F.sum("x").alias("_s"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    # the few positions spread a large group over as many keys
    out = cells.join(sums, ["feeder_id", "transformer_id", "pos"])
    mean = (F.col("_s") - F.col("x")) / (F.col("_n") - 1)
    return out.select("meter_id", "feeder_id", "pos", "x", mean.alias("neighbour_mean"), (F.col("x") - mean).alias("gap"))


def two_hops(features: DataFrame, topology: DataFrame, vector: str = "profile") -> DataFrame:
    once = neighbour_means(features, topology, vector)
    again = once.groupBy("meter_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "neighbour_mean"))), lambda c: c["neighbour_mean"]).alias(vector))
    return neighbour_means(again, topology, vector)


def feeder_pool(features: DataFrame, topology: DataFrame, vector: str = "profile") -> DataFrame:
    t = topology.select("meter_id", "feeder_id").distinct()
    cells = features.join(t, "meter_id").select("feeder_id", F.posexplode(vector).alias("pos", "x"))
    return cells.groupBy("feeder_id", "pos").agg(F.avg("x").alias("pooled"))


def propagate_labels(balance: DataFrame, slots: DataFrame, topology: DataFrame) -> DataFrame:
    """Feeder loss label on all its meters; the meter with the largest share above the feeder's mean is the suspect."""
    bad = balance.groupBy("feeder_id").agg(
        F.coalesce((F.sum("feeder_input_kwh") - F.sum("billed_kwh")) / F.sum("feeder_input_kwh"), F.lit(0.0)).alias("loss_ratio")
    ).withColumn("feeder_label", (F.col("loss_ratio") > 0.08).cast("int"))
    use = slots.groupBy("meter_id").agg(F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("kwh"))
    rows = use.join(topology.select("meter_id", "feeder_id"), "meter_id").join(bad, "feeder_id")
    stats = rows.groupBy("feeder_id").agg(
        F.avg("kwh").alias("_m"), F.max(F.struct(F.round("kwh", 6), -F.col("meter_id"))).alias("_top")
    )
    out = rows.join(stats, "feeder_id").withColumn("share_deviation", F.col("kwh") - F.col("_m"))
    return out.withColumn("suspect", (F.col("feeder_label") == 1) & (-F.col("meter_id") == F.col("_top")["col2"])).drop("_m", "_top")


def physics_violation(balance: DataFrame) -> DataFrame:
    """Mean excess of metered over input energy, relative to mean input, per feeder."""
    excess = F.greatest(F.coalesce("billed_kwh", F.lit(0.0)) - F.col("feeder_input_kwh"), F.lit(0.0))
    return balance.groupBy("feeder_id").agg(
        F.count_if(excess > 0).alias("violations"), (F.avg(excess) / (F.avg("feeder_input_kwh") + 1e-8)).alias("physics_loss")
    )


def loading_table(loads: DataFrame, rows: int = 16) -> DataFrame:
    """Most loaded feeders with input and metered energy and a loss that falls back on the balance."""
    fallback = F.greatest(F.lit(0.0), 100 - F.try_divide("metered_kwh", F.greatest("input_kwh", F.lit(1.0))) * 100)
    out = loads.orderBy(F.desc(F.round("load_pct", 6)), F.asc("feeder_id")).limit(rows)
    return out.withColumn("loss_shown", F.coalesce(F.nullif("loss_pct", F.lit(0.0)), fallback))


def transformer_loading(slots: DataFrame, topology: DataFrame) -> DataFrame:
    """Peak hourly demand against the summed rating of the meters' transformer."""
    t = topology.select("meter_id", "transformer_id", "transformer_rated_kva")
    rated = t.groupBy("transformer_id").agg(F.max("transformer_rated_kva").alias("rated_kva"))
    demand = slots.select("meter_id", "hour_ts", "kvah").join(t.select("meter_id", "transformer_id"), "meter_id")
    demand = demand.groupBy("transformer_id", "hour_ts").agg(F.sum("kvah").alias("kva")).groupBy("transformer_id").agg(
        F.max("kva").alias("peak_kva"), F.avg("kva").alias("mean_kva")
    )
    return demand.join(rated, "transformer_id").withColumn("peak_loading", F.col("peak_kva") / F.col("rated_kva"))


def zone_polygons(zones: DataFrame, half: float = 0.018) -> DataFrame:
    """GeoJSON text of a closed square around each zone's centroid."""
    lon, lat = F.col("lon"), F.col("lat")
    corner = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    ring = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in corner])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return zones.select("zone", "risk", ring.alias("ring"), F.to_json(shape).alias("geometry"))


def route_legs(stops: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """Distance from each stop to the next one in visiting order; a route is a chain, so no stop pairs are made."""
    rows = neighbours(stops, keys, bucket, order, ["latitude", "longitude", "alert_id"], following=True)
    leg = haversine_km(F.col("latitude"), F.col("longitude"), F.col("next_latitude"), F.col("next_longitude"))
    return rows.withColumn("leg_km", leg).withColumnRenamed("next_alert_id", "next_stop")


def descendants(meters: DataFrame, usage: DataFrame, balance: DataFrame) -> DataFrame:
    """Every node of the four levels, down to the meters, with its meters, transformers and energy below it."""
    rows = meters.select("meter_id", "substation_id", "feeder_id", "transformer_id").join(usage, "meter_id", "left")
    inp = balance.groupBy("feeder_id").agg(F.sum("feeder_input_kwh").alias("input_kwh"))
    node = F.explode(
        F.array(
            F.struct(F.lit(1).alias("depth"), F.col("substation_id").alias("node")),
            F.struct(F.lit(2).alias("depth"), F.col("feeder_id").alias("node")),
            F.struct(F.lit(3).alias("depth"), F.concat_ws("/", "feeder_id", "transformer_id").alias("node")),
            F.struct(F.lit(4).alias("depth"), F.col("meter_id").cast("string").alias("node")),
        )
    )
    below = rows.withColumn("_n", node).groupBy("_n.depth", "_n.node").agg(
        F.count(F.lit(1)).alias("meters"), F.countDistinct("transformer_id").alias("transformers"), F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("kwh")
    )
    owner = rows.select("feeder_id", "substation_id").distinct().join(inp, "feeder_id")
    fed = owner.select(F.lit(2).alias("depth"), F.col("feeder_id").alias("node"), "input_kwh").unionByName(
        owner.groupBy(F.lit(1).alias("depth"), F.col("substation_id").alias("node")).agg(F.sum("input_kwh").alias("input_kwh"))
    )
    return below.join(fed, ["depth", "node"], "left").withColumn("loss_ratio", F.try_divide(F.col("input_kwh") - F.col("kwh"), F.col("input_kwh")))
