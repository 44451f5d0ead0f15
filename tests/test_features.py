"""Cleaning and features on hand-made series: gaps, equal stamps, nulls, single rows, empty frames."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions import text
from meterlake.operators import clean, features, grid, joins, ranking
from meterlake.sources import storage

START = dt.datetime(2024, 1, 1)
SLOT = "meter_id bigint, hour_ts timestamp, kwh double, communication_status int"


def hours(values, meter=1, status=None):
    return [(meter, START + dt.timedelta(hours=i), v, (status or {}).get(i, 0)) for i, v in enumerate(values) if v != "absent"]


@pytest.fixture
def peers_of(spark):
    return spark.createDataFrame([(1, 7), (2, 7)], "meter_id bigint, peer_cluster_id int")


def test_imputation_cascade(spark, peers_of):
    values = [float(i % 24) for i in range(24 * 9)]
    values[5] = "absent"  # both neighbours known
    for i in range(180, 183):
        values[i] = "absent"  # inner slots need last week
    values[10] = None
    other = hours([1.0] * 48, meter=2)
    slots = spark.createDataFrame(hours(values, status={30: 2}) + other, SLOT)
    g = clean.dense_grid(slots, "meter_id", "hour_ts", "1 hour")
    assert g.count() == 24 * 9 + 48
    got = clean.impute(g, peers_of).where("meter_id = 1").orderBy("hour_ts").toPandas()
    assert got["imputation_stage"][5] == 1 and got["kwh"][5] == 5.0
    assert got["imputation_stage"][10] == 1 and got["kwh"][10] == 10.0
    assert got["imputation_stage"][30] == 1 and bool(got["is_imputed"][30])
    assert got["imputation_stage"][181] == 2 and got["kwh"][181] == float(181 % 24)
    assert got["imputation_stage"][0] == 0 and not bool(got["is_imputed"][0])


def test_peer_median_is_the_last_resort(spark, peers_of):
    slots = spark.createDataFrame(hours([4.0, "absent", "absent", "absent", 4.0]) + hours([1.0, 2.0, 3.0, 5.0, 1.0], meter=2), SLOT)
    g = clean.dense_grid(slots, "meter_id", "hour_ts", "1 hour")
    got = clean.impute(g, peers_of).where("meter_id = 1").orderBy("hour_ts").toPandas()
    assert got["imputation_stage"].tolist() == [0, 3, 3, 3, 0]
    assert got["kwh"].tolist() == [4.0, 2.0, 3.0, 5.0, 4.0]


def test_rolling_equals_pandas(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(300) < 0.2, np.nan, rng.normal(50, 5, 300).round(2))
    x[100:120] = 3.0  # a constant run
    rows = [(1, START + dt.timedelta(hours=i), None if np.isnan(v) else float(v), 0) for i, v in enumerate(x)]
    got = features.rolling(spark.createDataFrame(rows, SLOT), "kwh", [4, 24, 7]).orderBy("hour_ts").toPandas()
    s = pd.Series(x)
    for k in (4, 7, 24):
        r = s.rolling(k + 1, min_periods=1)
        assert np.allclose(got[f"roll_mean_{k}"], r.mean(), equal_nan=True)
        assert np.allclose(got[f"roll_max_{k}"].astype(float), r.max(), equal_nan=True)
        assert np.allclose(got[f"roll_std_{k}"].astype(float), s.rolling(k + 1, min_periods=2).std(), atol=1e-5, equal_nan=True)
    assert (got["roll_std_4"][104:120] == 0).all()


def test_first_reading_has_no_rollback(spark):
    rows = [(1, START + dt.timedelta(minutes=i), i, c) for i, c in enumerate([5.0, 6.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "meter_id bigint, timestamp timestamp, reading_id bigint, cumulative_kwh double")
    got = [r["cumulative_rollback"] for r in features.rollback(df).orderBy("timestamp").collect()]
    assert got == [None, False, True, False]


def test_runs(spark):
    rows = [(1, i, s) for i, s in enumerate([True, True, False, True])]
    df = spark.createDataFrame(rows, "meter_id bigint, t bigint, s boolean")
    plain = sorted((r["run_start"], r["run_length"], r["s"]) for r in features.runs(df, ["meter_id"], ["t"], "s").collect())
    cut = sorted((r["run_start"], r["run_length"], r["s"]) for r in features.runs(df, ["meter_id"], ["t"], "s", F.col("t")).collect())
    assert plain == cut == [(0, 2, True), (2, 1, False), (3, 1, True)]


def test_finer_weather_does_not_multiply_rows(spark):
    slots = spark.createDataFrame([(1, START, 2.0)], "meter_id bigint, hour_ts timestamp, kwh double")
    weather = spark.createDataFrame(
        [("Z", START, 20.0, 50.0, 1.0), ("Z", START + dt.timedelta(minutes=30), 22.0, 60.0, 1.0)],
        "zone_id string, timestamp timestamp, temp_c double, humidity_pct double, rainfall_mm double",
    )
    reg = spark.createDataFrame([(1, "Z")], "meter_id bigint, zone string")
    got = joins.with_weather(slots, weather, reg).collect()
    assert len(got) == 1 and got[0]["temp_c"] == 21.0 and got[0]["rainfall_mm"] == 2.0


def test_peer_join_keeps_meters_without_group(spark):
    slots = spark.createDataFrame([(1, START, 2.0), (2, START, 4.0), (3, START, 9.0)], "meter_id bigint, hour_ts timestamp, kwh double")
    p = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "meter_id bigint, peer_cluster_id int")
    got = {r["meter_id"]: r for r in joins.with_peers(slots, p).collect()}
    assert len(got) == 3 and got[3]["peer_mean"] is None and got[1]["peer_mean"] == 3.0


def test_as_of_takes_the_last_value_across_buckets(spark):
    left = spark.createDataFrame([("a", START + dt.timedelta(days=3), 1), ("a", START - dt.timedelta(days=1), 2), ("b", START, 3)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("a", START, 1.5), ("a", START + dt.timedelta(days=1), 2.5)], "k string, t timestamp, v double")
    got = {r["id"]: r["out"] for r in joins.as_of(left, right, "k", "t", "v", "out").collect()}
    assert got == {1: 2.5, 2: None, 3: None}


def test_neighbour_means_equal_pairs(spark):
    rng = np.random.default_rng(8)
    vec = {m: rng.normal(size=3) for m in range(9)}
    topo = spark.createDataFrame([(m, "F", "T0" if m < 6 else f"T{m % 2}x") for m in range(9)], "meter_id bigint, feeder_id string, transformer_id string")
    df = spark.createDataFrame([(m, [float(x) for x in v]) for m, v in vec.items()], "meter_id bigint, profile array<double>")
    got = {(r["meter_id"], r["pos"]): r["neighbour_mean"] for r in grid.neighbour_means(df, topo).collect()}
    group = {m: [o for o in range(9) if o != m and (o < 6) == (m < 6) and (m < 6 or o % 2 == m % 2)] for m in range(9)}
    for m, others in group.items():
        for p in range(3):
            if others:
                assert got[(m, p)] == pytest.approx(np.mean([vec[o][p] for o in others]))
            else:
                assert (m, p) not in got
    links = grid.shared_transformers(topo)
    assert links.count() == 2 * (6 + 2)


def test_empty_frames(spark, peers_of):
    none = spark.createDataFrame([], SLOT)
    assert clean.impute(clean.dense_grid(none, "meter_id", "hour_ts", "1 hour"), peers_of).count() == 0
    assert features.rolling(none, "kwh", [4]).count() == 0
    assert joins.with_peers(none, peers_of).count() == 0


def test_keep_best_collapses_copies(spark):
    df = spark.createDataFrame([(1, 5, 0.1), (1, 7, 0.2), (1, 7, 0.3), (2, 1, 0.4)], "k int, t int, x double")
    got = {r["k"]: (r["t"], r["x"], r["copies"]) for r in clean.keep_best(df, ["k"], ["t"]).collect()}
    assert got == {1: (7, 0.3, 3), 2: (1, 0.4, 1)}


def test_csv_with_byte_order_mark_and_missing_file(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    path = tmp_path / "x.csv"
    path.write_bytes("﻿a,b\nu,1\n".encode())
    assert [tuple(r) for r in storage.read_csv(spark, str(path), schema).collect()] == [("u", 1)]
    assert storage.read_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0


def test_repeated_day_lands_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "x int, date date")
    assert storage.append_by_date(df, path) == 2
    storage.overwrite_dates(df.where("x = 2"), path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("see MTR-00123 now", "see MTR...23 now"),
        ("METER-77-X9 gone", "MET...X9 gone"),
        ("SM_9ABC and sm99x", "SM_...BC and sm9...9x"),
        ("MTR-1", "MTR-1"),
        ("no id", "no id"),
    ],
)
def test_masking(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.mask_text(F.col("t"))).first()[0] == want


def test_redaction_walks_nested_columns(spark):
    df = spark.createDataFrame(
        [(("MTR-00123", 12.5), list(range(100)), "call MTR-00123", "ABC")],
        "inner struct<meterId:string, lat:double>, many array<int>, note string, meter_id string",
    )
    r = text.redact(df).first()
    assert r["inner"]["meterId"] == "MTR...23" and r["inner"]["lat"] == "[redacted]"
    assert len(r["many"]) == 80 and r["note"] == "call MTR...23" and r["meter_id"] == "[masked-meter]"


def test_clamp_and_filters(spark):
    assert [ranking.clamp(n, 240) for n in (-5, 0, 7, 999)] == [1, 1, 7, 240]
    df = spark.createDataFrame([(1, "High", "Snoozed"), (2, "Low", "Open")], "alert_id int, severity string, status string")
    assert [r[0] for r in ranking.filter_alerts(df, "HIGH", "suppressed").collect()] == [1]
    assert ranking.filter_alerts(df).count() == 2
    many = spark.range(6000).selectExpr("id % 2 AS k", "id AS v")
    top = ranking.top_per_key(many, ["k"], [F.desc("v")], 2500)
    assert top.count() == 5000 and top.agg(F.min("v")).first()[0] == 1000


def test_rolling_forgets_what_left_the_frame(spark):
    """One far value among constant ones: deviation and mean are those of the built-in window, before and after it."""
    from pyspark.sql import Window

    from meterlake.operators.features import rolling

    df = spark.sql("SELECT 1 AS meter_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) AS hour_ts, CASE WHEN id = 17 THEN 1e7 WHEN id % 13 = 5 THEN NULL ELSE 3.1 END AS kwh FROM range(60)")
    df = df.unionByName(df.selectExpr("2 AS meter_id", "hour_ts", "kwh * hour(hour_ts) AS kwh"))
    widths = [1, 4, 7, 24]
    made = {f"{n}_{k}": f("kwh").over(Window.partitionBy("meter_id").orderBy("hour_ts").rowsBetween(-k, 0)) for k in widths for n, f in (("m", F.avg), ("s", F.stddev), ("t", F.max))}
    for r in rolling(df, "kwh", widths).withColumns(made).collect():
        for k in widths:
            for got, want in ((r[f"roll_mean_{k}"], r[f"m_{k}"]), (r[f"roll_std_{k}"], r[f"s_{k}"]), (r[f"roll_max_{k}"], r[f"t_{k}"])):
                assert (got is None) == (want is None) and (got is None or abs(got - want) <= 1e-9 * max(1, abs(want)))


def test_runs_of_nulls_are_runs(spark):
    from meterlake.operators.features import runs

    states = [None, None, "a", "a", None, None, None, "b"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)] + [(None, 0, None), (None, 1, None)], "k int, t int, s string")
    want = sorted([(1, None, 2), (1, "a", 2), (1, None, 3), (1, "b", 1), (None, None, 2)], key=repr)
    for bucket in (None, F.floor(F.col("t") / 3)):
        got = runs(df, ["k"], ["t"], "s", bucket).collect()
        assert sorted([(r.k, r.s, r.run_length) for r in got], key=repr) == want


def test_long_chain_shows_every_deletion(spark):
    from meterlake.operators import audit

    n = 2 * audit.SEGMENT_ROWS + 50
    log = spark.range(n).selectExpr("7 AS alert_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS at", "id AS step", "'p' || id AS payload")
    rows = audit.chain(log, "alert_id", F.date_trunc("month", "at"), ["at", "step"], "payload").cache()
    heads = audit.segment_heads(rows, "alert_id").cache()
    assert heads.count() == 3 and audit.broken_segments(rows, heads, "alert_id").count() == 0 and audit.broken_links(rows, "alert_id", "payload").count() == 0
    size = audit.SEGMENT_ROWS
    for lost in (f"position BETWEEN {size - 49} AND {size}", f"position BETWEEN {size + 1} AND {2 * size}", f"position > {n - 5}", "position = 1", f"position > {2 * size}"):
        left = rows.where(f"NOT ({lost})")
        assert audit.broken_segments(left, heads, "alert_id").count() > 0, lost


def test_feature_table_rolls_once_and_deals_wide_rows_by_meter(spark):
    """Group values come from the narrow slots: rolled rows are made once and are dealt out by meter, never by group or hour."""
    from meterlake.plans import reports
    from meterlake.sources.views import Views

    folder = os.environ.get("METERLAKE_TEST_DATA", "/root/testdata/sf0.001")
    plan = reports.feature_table(Views(spark, folder), "2024-01-24", "2024-01-31")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == 1
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and plan.index(line) < plan.index("MapInArrow ")]
    assert not [line for line in wide if "hour_ts" in line.split("ENSURE")[0]]
