"""Streaming jobs over several time-ordered files equal their batch twins."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from meterlake.operators import models
from meterlake.streaming import jobs

SCHEMA = "meter_id bigint, timestamp timestamp, reading_id bigint, kwh double, communication_status int"
START = dt.datetime(2024, 1, 1)


def deliver(spark, tmp_path, rows, files):
    """Files with increasing modification times, read one per micro-batch."""
    import os

    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        name = tmp_path / f"d{i}.parquet"
        p = pd.DataFrame([rows[j] for j in part], columns=["meter_id", "timestamp", "reading_id", "kwh", "communication_status"])
        p["timestamp"] = p["timestamp"].dt.tz_localize("UTC")
        p["communication_status"] = p["communication_status"].astype("int32")
        p.to_parquet(name, coerce_timestamps="us")
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_stateful_changepoints_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        for m in (1, 2, 3):
            x = rng.normal(10, 1) + (8 if m == 1 and i >= 250 else 0)
            rows.append((m, START + dt.timedelta(hours=i), i, float(x), 0))
    got = jobs.run_to_table(jobs.stateful_changepoints(deliver(spark, tmp_path, rows, 5)), "t").toPandas()
    batch = models.changepoints(spark.createDataFrame(rows, SCHEMA), "meter_id", "timestamp", "kwh").toPandas()
    key = ["meter_id", "position"]
    got, batch = got.sort_values(key).reset_index(drop=True), batch.sort_values(key).reset_index(drop=True)
    assert len(batch) and got[key].equals(batch[key]) and np.allclose(got["probability"], batch["probability"])


def test_ordered_changepoints_equal_batch_whatever_the_order(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(m, START + dt.timedelta(minutes=20 * i), i, float(rng.normal(10, 1) + (8 if m == 1 and i >= 250 else 0)), 0) for i in range(400) for m in (1, 2)]
    # every row may come up to 120 places late, which is well within the delay
    mixed = [rows[i] for i in np.argsort(np.arange(len(rows)) + rng.uniform(0, 120, len(rows)))]
    assert mixed != rows
    mixed.append((1, START, 9999, 500.0, 0))  # far too late: left out
    got = jobs.run_to_table(jobs.ordered_changepoints(deliver(spark, tmp_path, mixed, 5)), "t", jobs.ROCKS).toPandas()
    batch = models.changepoints(spark.createDataFrame(rows, SCHEMA), "meter_id", "timestamp", "kwh").toPandas()
    newest = max(r[1] for r in rows)
    batch = batch[batch["timestamp"] < (newest - dt.timedelta(days=1)).replace(minute=0)]  # later hours are still open
    key = ["meter_id", "position"]
    got, batch = got.sort_values(key).reset_index(drop=True), batch.sort_values(key).reset_index(drop=True)
    assert len(batch) and got[key].equals(batch[key]) and np.allclose(got["probability"], batch["probability"])
    assert (got["timestamp"] == batch["timestamp"]).all()


def test_hourly_rollup_over_files_with_late_rows(spark, tmp_path):
    rows = [(1, START + dt.timedelta(hours=i), i, float(i), 0) for i in range(200)]
    # within the allowed delay
    rows.insert(150, (1, START + dt.timedelta(hours=110), 900, 5.0, 0))
    # far beyond it
    rows.append((1, START, 901, 99.0, 0))
    got = jobs.run_to_table(jobs.hourly_rollup(deliver(spark, tmp_path, rows, 4), "2 days"), "t").toPandas().set_index("hour")
    assert got.loc[START + dt.timedelta(hours=110), "reading_count"] == 2
    assert got.loc[START, "total_kwh"] == 0.0
    assert got.index.is_unique and len(got) == 200 - 1 - 48


def test_idempotent_sink_keeps_rows_of_one_day_in_two_batches(spark, tmp_path):
    rows = [(1, START + dt.timedelta(hours=i), i, 1.0, 0) for i in range(30)]
    got = jobs.write_batches(deliver(spark, tmp_path, rows, 3), "t")
    assert got.count() == 30 and got.select("batch").distinct().count() == 3
