"""Kernels and model jobs on small planted cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions.kernels import Changepoints, dtw
from meterlake.operators import audit, explain, forecast, models, peers


def slow_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return np.sqrt(d[-1, -1])


def test_dtw_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 7)), rng.normal(size=(5, 9))
    assert np.allclose(dtw(a, b), [slow_dtw(x, y) for x, y in zip(a, b)])
    assert np.allclose(dtw(a, a), 0)


def meta_rows(spark, n=600):
    """Two of the nine detectors tell theft; one column is null throughout, as a detector without an opinion leaves it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 9))
    p = 1 / (1 + np.exp(-(3 * x[:, 0] + 3 * x[:, 5])))
    rows = [(i, *[None if j == 4 else float(v) for j, v in enumerate(r)], int(rng.random() < q)) for i, (r, q) in enumerate(zip(x, p))]
    return spark.createDataFrame(rows, ", ".join(["id bigint", *[f"{c} double" for c in models.META_FEATURES], "label int"]))


def test_meta_classifier_ranks_and_calibrates(spark):
    df = meta_rows(spark)
    out = models.meta_classifier(df.where("id % 2 = 0"), df.where("id % 2 = 1"), models.META_FEATURES, "label").toPandas()
    assert len(out) == 300 and out["theft_probability"].between(0, 1).all()
    ranks = out["theft_probability"].rank()
    pos = out["label"] == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9
    for low, high in ((0, 0.3), (0.7, 1.01)):
        part = out[out["theft_probability"].between(low, high, inclusive="left")]
        assert abs(part["theft_probability"].mean() - part["label"].mean()) < 0.12
    again = models.meta_classifier(df.where("id % 2 = 0"), df.where("id % 2 = 1"), models.META_FEATURES, "label").toPandas()
    # sums of the fit may be added in another order; a score at the edge of a step may then change it
    gaps = np.abs(out.sort_values("id")["theft_probability"].to_numpy() - again.sort_values("id")["theft_probability"].to_numpy())
    assert (gaps < 1e-6).mean() > 0.97


def test_meta_classifier_with_one_label_or_none(spark):
    df = meta_rows(spark, 40).withColumn("label", F.lit(1))
    one = models.meta_classifier(df, df, models.META_FEATURES, "label").toPandas()
    assert (one["theft_probability"] == 1).all()
    none = models.meta_classifier(df.where("false"), df, models.META_FEATURES, "label").toPandas()
    assert none["theft_probability"].isna().all() and len(none) == 40


def series(shift_at=None, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 1, n)
    if shift_at:
        x[shift_at:] += 8
    return x


def test_changepoint_is_found_near_the_shift():
    _, breaks, _ = Changepoints().scan(series(250))
    assert any(240 <= i <= 260 for i in np.flatnonzero(breaks))
    _, none, _ = Changepoints().scan(series())
    assert not none[20:].any()


def test_changepoint_state_can_be_carried():
    x = series(250)
    whole = Changepoints().scan(x)
    first = Changepoints().scan(x[:137])
    second = Changepoints().scan(x[137:], first[2])
    assert np.allclose(np.concatenate([first[0], second[0]]), whole[0])
    assert (np.concatenate([first[1], second[1]]) == whole[1]).all()


def test_batch_changepoints(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(m, start + dt.timedelta(hours=i), float(v)) for m, at in ((1, 250), (2, None)) for i, v in enumerate(series(at))]
    df = spark.createDataFrame(rows, "meter_id bigint, hour_ts timestamp, kwh double")
    found = models.changepoints(df, "meter_id", "hour_ts", "kwh").toPandas()
    one = found[found["meter_id"] == 1]
    assert ((one["position"] >= 245) & (one["position"] <= 265)).any()
    recent = models.recent_changepoint(df, models.changepoints(df, "meter_id", "hour_ts", "kwh"), "meter_id", "hour_ts", 168)
    assert {r["meter_id"]: r["recent_changepoint"] for r in recent.collect()}[1] is True


def test_changepoint_function_gives_the_same_rows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(m, start + dt.timedelta(hours=i), None if i % 37 == 0 else float(v)) for m, at in ((1, 250), (2, None), (3, 120)) for i, v in enumerate(series(at, seed=m))]
    df = spark.createDataFrame(rows[::-1], "meter_id bigint, hour_ts timestamp, kwh double")
    spark.udtf.register("changepoints", models.ChangepointTable)
    got = spark.sql("SELECT * FROM changepoints(TABLE(SELECT * FROM {df}) PARTITION BY meter_id ORDER BY hour_ts)", df=df)
    key = ["meter_id", "position"]
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (got, models.changepoints(df, "meter_id", "hour_ts", "kwh")))
    assert len(b) and a[key].equals(b[key]) and (a["hour_ts"] == b["hour_ts"]).all() and np.allclose(a["probability"], b["probability"])


def test_isolation_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 29)), rng.normal(6, 1, size=(10, 29))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")
    forest = models.IsolationForest(trees=50, sample=128).fit(df.where("id < 500"), ["id"], "vector")
    scored = forest.score(df, "vector", "s").toPandas().sort_values("s", ascending=False)
    assert set(range(500, 510)) <= set(scored["id"].head(51))
    again = models.IsolationForest(trees=50, sample=128).fit(df.where("id < 500").repartition(7), ["id"], "vector")
    assert all(np.array_equal(a, b) for a, b in zip(forest.grown, again.grown))


def test_reconstruction_error_finds_odd_shapes(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 24)) + rng.normal(0, 0.05, size=(300, 24))
    base[-3:] = rng.normal(0, 2, size=(3, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(base)], "id bigint, profile array<double>")
    top = models.reconstruction_errors(df, "profile", 4).orderBy(F.desc("recon_error")).limit(5).toPandas()
    assert {297, 298, 299} <= set(top["id"])


def test_two_shapes_fall_into_two_groups(spark):
    h = np.arange(24)
    rng = np.random.default_rng(4)
    # 24 equal hours shape the profile; the two groups differ in frequency, which warping cannot hide
    shapes = [np.sin(2 * np.pi * h / 24) if m < 20 else np.sin(2 * np.pi * 4 * h / 24) for m in range(40)]
    df = spark.createDataFrame(
        [(m, [float(v) for v in s + rng.normal(0, 0.05, 24)]) for m, s in enumerate(shapes)], "meter_id bigint, profile array<double>"
    )
    d = peers.landmark_distances(df, 40).toPandas()
    same = d[(d["meter_id"] // 20 == d["landmark_id"] // 20) & (d["meter_id"] != d["landmark_id"])]["distance"]
    other = d[d["meter_id"] // 20 != d["landmark_id"] // 20]["distance"]
    assert same.max() < other.min()
    a = peers.affinities(peers.landmark_distances(df, 40))
    groups = peers.group_by_affinity(a, 2).toPandas().set_index("meter_id")["cluster"].sort_index()
    assert groups.loc[:19].nunique() == 1 and groups.loc[20:].nunique() == 1 and groups.loc[0] != groups.loc[20]


def test_quantile_forecasts_do_not_cross(spark):
    rows = [("Z", 10.0, 9.0, True), ("Z", 5.0, 9.0, True), ("Z", 7.0, 0.5, False), ("Y", 1.0, 1.0, True), ("Y", 2.0, 1.0, False)]
    df = spark.createDataFrame(rows, "zone string, actual_mw double, p50 double, is_calibration boolean")
    out = models.quantile_forecast(df).toPandas()
    assert len(out) == 5 and (out["p10"] <= out["p50"]).all() and (out["p50"] <= out["p90"]).all() and (out["p10"] >= 0).all()


def causal_rows(drop_on_shutdown: bool):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rng = np.random.default_rng(6)
    rows = []
    for i, d in enumerate(days):
        low = i >= 33
        kwh = (70.0 if low else 100.0) + float(rng.normal(0, 0.5))
        rows.append((1, d, kwh, 0.0, 0, int(low and drop_on_shutdown), 0, 0.0, 0))
    return rows


@pytest.mark.parametrize("explained", [True, False])
def test_known_causes_decide_escalation(spark, explained):
    schema = "meter_id bigint, date date, kwh double, temperature_delta double, is_holiday int, is_shutdown int, is_ramadan int, rainfall_mm double, season int"
    causes = spark.createDataFrame(causal_rows(explained), schema)
    measured = explain.drop_measure(causes.select("meter_id", "date", "kwh"))
    line = explain.decision(models.cause_effects(causes, measured)).first()
    assert line["drop_fraction"] > 0.25
    assert line["escalate"] is (not explained)
    assert (line["explained_fraction"] > 0.9) is explained


def test_too_little_history_escalates(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0) for i in range(10)]
    df = spark.createDataFrame(rows, "meter_id bigint, date date, kwh double")
    out = explain.decision(explain.drop_measure(df)).first()
    assert out["escalate"] is True and out["reason"] == "Insufficient data"


def chain_rows(spark, n=6):
    rows = [("m", i, f'{{"step":{i}}}') for i in range(n)]
    return spark.createDataFrame(rows, "key string, at bigint, payload string")


def test_chain_verifies_and_tampering_shows(spark, monkeypatch):
    monkeypatch.setattr(audit, "SEGMENT_ROWS", 4)
    log = audit.chain(chain_rows(spark), "key", F.floor(F.col("at") / 2), ["at"], "payload")
    assert audit.broken_links(log, "key", "payload").count() == 0
    assert {r["segment"] for r in log.collect()} == {0, 1}
    bad = log.withColumn("payload", F.when(F.col("position") == 2, '{"step":9}').otherwise(F.col("payload")))
    assert [r["position"] for r in audit.broken_links(bad, "key", "payload").collect()] == [2]


def test_chain_hash_is_sha256_of_previous_and_payload(spark):
    import hashlib

    first = audit.chain(chain_rows(spark), "key", F.floor(F.col("at") / 2), ["at"], "payload").orderBy("position").first()
    assert first["prev_hash"] == "genesis:m:0"
    assert first["entry_hash"] == hashlib.sha256((first["prev_hash"] + first["payload"]).encode()).hexdigest()


def test_walk_forward_skips_folds_without_history(spark):
    days = pd.date_range("2024-01-01", periods=44)
    df = spark.createDataFrame([(d.date(),) for d in days], "forecast_date date")
    got = forecast.walk_forward(df, "forecast_date").toPandas()
    assert set(got["fold"]) == {2, 3}
    for _, part in got.groupby("fold"):
        assert part[part["part"] == "train"]["forecast_date"].max() < part[part["part"] == "validation"]["forecast_date"].min()
        assert (part["part"] == "validation").sum() == 7
