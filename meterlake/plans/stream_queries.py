"""Streaming jobs (L). Each runs over the whole event table until nothing is left and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.plans.catalog import query
from meterlake.plans.rollup_queries import HOURLY_COLS, HOURLY_ROLLUP
from meterlake.sources.storage import shared_folder
from meterlake.streaming import jobs


def stream(v):
    return jobs.stream_readings(v.spark, v.folder)


def closed(moment: str, delay: str) -> str:
    """Watermarks keep milliseconds; windows at or before them are out."""
    return f"{moment} <= (SELECT date_trunc('milliseconds', max(timestamp)) - INTERVAL {delay} FROM readings)"


@query(
    "l1_stream_deduplication",
    "date:s readings:i kwh:d4",
    """SELECT CAST(timestamp AS DATE) AS date, count(*) AS readings, sum(kwh) AS kwh FROM (
    SELECT timestamp, meter_id, any_value(kwh) AS kwh FROM readings GROUP BY 1, 2) GROUP BY 1""",
    "readings",
)
def _(v):
    # every reading arrives twice
    twice = stream(v).unionByName(stream(v))
    rows = jobs.run_to_table(jobs.without_copies(twice), "dedup")
    return rows.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("readings"), F.sum("kwh").alias("kwh"))


@query(
    "l2_stream_hourly_rollup",
    HOURLY_COLS,
    f"SELECT * FROM ({HOURLY_ROLLUP}) WHERE {closed('hour + INTERVAL 1 HOUR', '3 DAY')}",
    "readings",
)
def _(v):
    return jobs.run_to_table(jobs.hourly_rollup(stream(v)), "rollup")


@query(
    "l3_stream_sliding_feeder_load",
    "feeder_id window_start:s billed_kwh:d readings:i",
    f"""SELECT * FROM (SELECT feeder_id, time_bucket(INTERVAL 15 MINUTE, timestamp) - INTERVAL 15 MINUTE * k AS window_start, sum(kwh) AS billed_kwh, count(*) AS readings
    FROM readings JOIN meters USING (meter_id), range(4) t(k) GROUP BY 1, 2) WHERE {closed('window_start + INTERVAL 1 HOUR', '3 HOUR')}""",
    "readings meters",
)
def _(v):
    return jobs.run_to_table(jobs.sliding_feeder_load(stream(v), v.meters), "sliding")


@query(
    "l4_stream_outage_sessions",
    "meter_id:i session_start:s session_end:s failures:i",
    f"""SELECT * FROM (SELECT meter_id, min(timestamp) AS session_start, max(timestamp) + INTERVAL 6 HOUR AS session_end, count(*) AS failures FROM (
    SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY meter_id ORDER BY timestamp, reading_id) AS s FROM (
    SELECT *, coalesce(timestamp > lag(timestamp) OVER (PARTITION BY meter_id ORDER BY timestamp, reading_id) + INTERVAL 6 HOUR, true) AS fresh
    FROM readings WHERE communication_status = 2)) GROUP BY meter_id, s)
    WHERE session_end <= (SELECT date_trunc('milliseconds', max(timestamp)) - INTERVAL 1 DAY FROM readings WHERE communication_status = 2)""",
    "readings",
)
def _(v):
    return jobs.run_to_table(jobs.outage_sessions(stream(v)), "sessions")


@query("l5_stream_changepoints", "meter_id:i position:i timestamp:s probability:d")
def _(v):
    return jobs.run_to_table(jobs.stateful_changepoints(stream(v)), "breaks")


@query("l5_ordered_changepoints", "meter_id:i position:i timestamp:s probability:d")
def _(v):
    return jobs.run_to_table(jobs.ordered_changepoints(stream(v)), "ordered-breaks", jobs.ROCKS)


@query(
    "l6_stream_static_join",
    "zone consumer_type readings:i kwh:d4",
    "SELECT zone, consumer_type, count(*) AS readings, sum(kwh) AS kwh FROM readings LEFT JOIN meters USING (meter_id) GROUP BY 1, 2",
    "readings meters",
)
def _(v):
    rows = jobs.run_to_table(jobs.enriched(stream(v), v.meters), "enriched")
    return rows.groupBy("zone", "consumer_type").agg(F.count(F.lit(1)).alias("readings"), F.sum("kwh").alias("kwh"))


@query(
    "l7_stream_late_rows",
    "input_rows:i dropped_rows:i kept_rows:i",
    "SELECT 2 * count(*) AS input_rows, count(*) AS dropped_rows, count(DISTINCT (meter_id, timestamp)) AS kept_rows FROM readings",
    "readings",
)
def _(v):
    # a second delivery, made after the first one was processed, repeats every reading 40 days late
    path, out = shared_folder(v.spark, "deliveries"), shared_folder(v.spark, "late")
    rows = v.readings.select("reading_id", "meter_id", "timestamp", "kwh")
    rows.write.parquet(path)
    source = v.spark.readStream.schema(rows.schema).parquet(path)
    first = jobs.run_counted(jobs.without_copies(source), out)
    rows.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 40 DAYS")).write.mode("append").parquet(path)
    second = jobs.run_counted(jobs.without_copies(source), out)
    kept = v.spark.read.schema(rows.schema).parquet(f"{out}/data")
    return kept.groupBy().agg(
        F.lit(first["input_rows"] + second["input_rows"]).alias("input_rows"),
        F.lit(first["dropped_rows"] + second["dropped_rows"]).alias("dropped_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
    )


@query(
    "l8_stream_stream_join",
    "reading_id:i feeder_id timestamp:s kwh:d feeder_input_kwh:d",
    """SELECT reading_id, f.feeder_id, r.timestamp, kwh, feeder_input_kwh FROM readings r JOIN meters m ON m.meter_id = r.meter_id
    JOIN feeder_readings f ON f.feeder_id = m.feeder_id AND f.timestamp = date_trunc('hour', r.timestamp)""",
    "readings meters feeder_readings",
)
def _(v):
    path = shared_folder(v.spark, "telemetry")
    v.feeder_readings.write.parquet(path)
    telemetry = v.spark.readStream.schema(v.feeder_readings.schema).parquet(path)
    return jobs.run_to_table(jobs.feeder_matches(stream(v), v.meters, telemetry), "matches")


@query(
    "l9_stream_idempotent_sink",
    "date:s readings:i kwh:d4",
    "SELECT CAST(timestamp AS DATE) AS date, count(*) AS readings, sum(kwh) AS kwh FROM readings GROUP BY 1",
    "readings",
)
def _(v):
    rows = jobs.write_batches(stream(v), "batches")
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("readings"), F.sum("kwh").alias("kwh"))
