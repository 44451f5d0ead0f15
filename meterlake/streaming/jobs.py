"""Structured Streaming jobs over meter readings."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meterlake.functions.kernels import Changepoints
from meterlake.sources.storage import shared_folder
from meterlake.sources.views import Views


class StreamViews(Views):
    """The same view definitions over a stream of the event table."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        schema = self.spark.read.parquet(f"{self.folder}/events.parquet").schema
        # a folder of files in production; the glob also matches the single file of the sample data
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/events*.parquet")


def stream_readings(spark: SparkSession, folder: str) -> DataFrame:
    return StreamViews(spark, folder).readings


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, name: str, store: str | None = None) -> DataFrame:
    """Process all available input into Parquet with an exactly-once sink, then read the result.

    ``store`` names the state store of this query; others keep the session's.
    """
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    try:
        q = (
            stream.writeStream.format("parquet")
            .option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    finally:
        if store:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def without_copies(readings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated (meter, timestamp) readings; state is kept for ``delay`` only."""
    return readings.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["meter_id", "timestamp"])


def hourly_rollup(readings: DataFrame, delay: str = "3 days") -> DataFrame:
    """Tumbling hourly rollup; an hour is emitted once, when nothing later than ``delay`` can still change it."""
    return (
        readings.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 hour").alias("w"), "meter_id")
        .agg(
            F.avg("kwh").alias("avg_kwh"),
            F.sum("kwh").alias("total_kwh"),
            F.max("kwh").alias("peak_kwh"),
            F.min("kwh").alias("min_kwh"),
            F.stddev("kwh").alias("std_kwh"),
            F.count(F.lit(1)).alias("reading_count"),
            F.count_if(F.col("kwh").isNull() | (F.col("communication_status") > 0)).alias("imputed_count"),
        )
        .select("meter_id", F.col("w.start").alias("hour"), "avg_kwh", "total_kwh", "peak_kwh", "min_kwh", "std_kwh", "reading_count", "imputed_count")
    )


def sliding_feeder_load(readings: DataFrame, registry: DataFrame, delay: str = "3 hours") -> DataFrame:
    """Metered energy per feeder in one-hour windows that start every 15 minutes."""
    rows = readings.withWatermark("timestamp", delay).join(registry.select("meter_id", "feeder_id"), "meter_id")
    return (
        rows.groupBy("feeder_id", F.window("timestamp", "1 hour", "15 minutes").alias("w"))
        .agg(F.sum("kwh").alias("billed_kwh"), F.count(F.lit(1)).alias("readings"))
        .select("feeder_id", F.col("w.start").alias("window_start"), "billed_kwh", "readings")
    )


def outage_sessions(readings: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Runs of failed communication per meter, ended by ``gap`` without another failure."""
    rows = readings.where(F.col("communication_status") == 2).withWatermark("timestamp", delay)
    return (
        rows.groupBy("meter_id", F.session_window("timestamp", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select("meter_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "failures")
    )


def enriched(readings: DataFrame, registry: DataFrame) -> DataFrame:
    return readings.join(registry.select("meter_id", "zone", "consumer_type", "feeder_id"), "meter_id", "left")


def stateful_changepoints(readings: DataFrame, detector: Changepoints | None = None) -> DataFrame:
    """Breaks per meter, with the detector's run-length table as state of bounded size.

    Rows of a meter inside one micro-batch are put in time order; order between batches is the source's.
    """
    d = detector or Changepoints()

    def advance(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = pickle.loads(state.get[1]) if state.exists else None  # noqa: S301 (our own state)
        base = state.get[0] if state.exists else 0
        rows = pd.concat(list(chunks)).sort_values(["timestamp", "reading_id"])
        masses, breaks, new = d.scan(rows["kwh"].to_numpy(), old)
        state.update((base + len(rows), pickle.dumps(new)))
        at = np.flatnonzero(breaks)
        yield pd.DataFrame(
            {
                "meter_id": np.full(len(at), key[0]),
                "position": base + at + 1,
                "timestamp": rows["timestamp"].to_numpy()[at],
                "probability": masses[at],
            }
        )

    rows = readings.where(F.col("kwh").isNotNull()).select("meter_id", "timestamp", "reading_id", "kwh")
    return rows.groupBy("meter_id").applyInPandasWithState(
        advance,
        "meter_id bigint, position bigint, timestamp timestamp, probability double",
        "seen bigint, table binary",
        "append",
        GroupStateTimeout.NoTimeout,
    )


HOUR_MS = 3_600_000
HOUR_US = HOUR_MS * 1000
BUFFERED = np.dtype([("t", "<i8"), ("id", "<i8"), ("x", "<f8")])


class OrderedChangepoints(StatefulProcessor):
    """The detector behind an ordering buffer: rows wait until the watermark has closed their hour.

    State of a meter: the detector's table, the number of rows it has seen, the last closed hour, the hour its timer
    waits for, and its open rows, 24 bytes each, a list entry per delivered part. One timer a meter, for its first open
    hour, hands all closed hours to the detector in order, so a micro-batch costs a few calls to the store a meter and
    not some for every hour. Files and batches out of order give the breaks of the ordered series. Rows of a closed
    hour are late and left out.
    """

    def __init__(self, detector: Changepoints):
        self.detector = detector

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", "seen bigint, closed bigint, due bigint, table binary")
        self.open = handle.getListState("open", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, closed, due, blob = self.table.get() if self.table.exists() else (0, None, None, None)
        parts, first = [], due
        for part in rows:
            at = part["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64)
            got = np.empty(len(part), BUFFERED)
            got["t"], got["id"], got["x"] = at, part["reading_id"], part["kwh"]
            if closed is not None:
                got = got[got["t"] // HOUR_US > closed]
            if len(got):
                parts.append((got.tobytes(),))
                hour = int(got["t"].min() // HOUR_US)
                first = hour if first is None else min(first, hour)
        if parts:
            self.open.appendList(parts)
        if first != due:
            if due is not None:
                self.handle.deleteTimer((due + 1) * HOUR_MS)
            self.handle.registerTimer((first + 1) * HOUR_MS)
            self.table.update((seen, closed, first, blob))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer fires once the watermark has passed it, so hours that end below the watermark are closed as well
        end = max(expiredTimerInfo.getExpiryTimeInMs() // HOUR_MS, (timerValues.getCurrentWatermarkInMs() - 1) // HOUR_MS)
        seen, closed, _, blob = self.table.get()
        held = np.sort(np.frombuffer(b"".join(r[0] for r in self.open.get()), BUFFERED), order=["t", "id", "x"])
        cut = int(np.searchsorted(held["t"], end * HOUR_US))
        got, rest = held[:cut], held[cut:]
        if len(rest):
            self.open.put([(rest.tobytes(),)])
        else:
            self.open.clear()
        due = int(rest["t"][0] // HOUR_US) if len(rest) else None
        if due is not None:
            self.handle.registerTimer((due + 1) * HOUR_MS)
        if len(got):
            masses, breaks, state = self.detector.scan(got["x"], pickle.loads(blob) if blob else None)  # noqa: S301 (our own state)
            blob, closed = pickle.dumps(state), int(got["t"][-1] // HOUR_US)
            at = np.flatnonzero(breaks)
            if len(at):
                yield pd.DataFrame(
                    {"meter_id": np.full(len(at), key[0]), "position": seen + at + 1, "timestamp": got["t"][at].astype("datetime64[us]"), "probability": masses[at]}
                )
        self.table.update((seen + len(got), closed, due, blob))

    def close(self) -> None:
        pass


def ordered_changepoints(readings: DataFrame, delay: str = "1 day", detector: Changepoints | None = None) -> DataFrame:
    """Breaks per meter that do not hang on the order of arrival, up to ``delay`` behind the newest reading."""
    rows = readings.where(F.col("kwh").isNotNull() & F.col("meter_id").isNotNull() & F.col("timestamp").isNotNull())
    rows = rows.select("meter_id", "timestamp", "reading_id", "kwh").withWatermark("timestamp", delay)
    return rows.groupBy("meter_id").transformWithStateInPandas(
        OrderedChangepoints(detector or Changepoints()),
        "meter_id bigint, position bigint, timestamp timestamp, probability double",
        "Append",
        "EventTime",
    )


def feeder_matches(readings: DataFrame, registry: DataFrame, telemetry: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Readings joined with their feeder's telemetry of the same hour; both sides are streams with watermarks.

    The calendar hour is part of the join key, so a reading meets the telemetry of its hour and not all that is held of
    its feeder. Telemetry that is not on the hour reaches into two of them and stands under both.
    """
    left = readings.join(registry.select("meter_id", "feeder_id"), "meter_id").withWatermark("timestamp", delay)
    left = left.withColumn("_h", F.date_trunc("hour", "timestamp"))
    last = F.col("timestamp") + F.expr("INTERVAL 1 HOUR") - F.expr("INTERVAL 1 MICROSECOND")
    hours = F.array_distinct(F.array(F.date_trunc("hour", "timestamp"), F.date_trunc("hour", last)))
    right = telemetry.withWatermark("timestamp", delay).select(
        F.col("feeder_id").alias("_f"), F.col("timestamp").alias("fed_at"), "feeder_input_kwh", F.explode(hours).alias("_fh")
    )
    same_hour = (F.col("timestamp") >= F.col("fed_at")) & (F.col("timestamp") < F.col("fed_at") + F.expr("INTERVAL 1 HOUR"))
    return left.join(right, (F.col("feeder_id") == F.col("_f")) & (F.col("_h") == F.col("_fh")) & same_hour).select(
        "reading_id", "meter_id", "feeder_id", "timestamp", "kwh", "feeder_input_kwh"
    )


def run_counted(stream: DataFrame, path: str) -> dict[str, int]:
    """Process what is new since the last run at ``path``; count the rows read and those the watermark turned away.

    Spark keeps the progress of a limited number of micro-batches; the limit is raised for the run, and a run that
    reaches it is an error, never a smaller count.
    """
    most = 100_000
    stream.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(most))
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    seen = {"input_rows": 0, "dropped_rows": 0}
    progress = q.recentProgress
    if len(progress) >= most:
        raise RuntimeError("more micro-batches than progress records")
    for p in progress:
        seen["input_rows"] += int(p["numInputRows"])
        seen["dropped_rows"] += sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])
    return seen


def write_batches(stream: DataFrame, name: str) -> DataFrame:
    """Micro-batches into (date, batch) partitions that a repeated batch overwrites: each row lands once."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        (
            batch.withColumns({"date": F.to_date("timestamp"), "batch": F.lit(number)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "batch")
            .parquet(f"{path}/data")
        )

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/data")
