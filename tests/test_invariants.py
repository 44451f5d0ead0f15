"""What the queries without SQL must satisfy, held against plain numpy on their own input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.functions.kernels import Changepoints
from meterlake.operators import models, peers
from meterlake.plans import catalog, peer_grid_queries, score_queries
from meterlake.sources.views import Views
from tests.conftest import FOLDER
from tests.test_models import slow_dtw

catalog.load_all()


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, FOLDER)


def rows(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).toPandas()


def test_landmark_distances_are_dtw(spark, v):
    got = rows(spark, "h3_landmark_dtw")
    shape = {r.meter_id: np.array(r.profile) for r in peers.profile_vectors(peer_grid_queries.profile_rows(v)).collect()}
    assert len(got) == len(shape) * got["landmark_id"].nunique()
    for r in got.sample(60, random_state=1).itertuples():
        assert r.distance == pytest.approx(slow_dtw(shape[r.meter_id], shape[r.landmark_id]), abs=1e-6)
    assert (got[got["meter_id"] == got["landmark_id"]]["distance"] == 0).all()


def pooled(x, y):
    """Weighted pool of adjacent violators, by its definition: max over starts of the min over ends of block means."""
    levels = np.unique(x)
    n = np.array([(x == a).sum() for a in levels], float)
    m = np.array([y[x == a].mean() for a in levels])
    total, weight = np.concatenate(([0], np.cumsum(m * n))), np.concatenate(([0], np.cumsum(n)))
    mean = lambda i, j: (total[j + 1] - total[i]) / (weight[j + 1] - weight[i])
    return levels, np.array([max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1)) for k in range(len(levels))])


def test_calibration_is_an_isotonic_fit_on_the_other_folds(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 25, 200) / 25
    df = spark.createDataFrame([(i, float(a), int(rng.random() < a)) for i, a in enumerate(s)], "alert_id bigint, score double, label int")
    got = models.calibrate(df, "score", "label", "p").withColumn("fold", F.pmod(F.xxhash64("alert_id"), F.lit(5))).toPandas()
    assert len(got) == 200
    for fold, part in got.groupby("fold"):
        rest = got[got["fold"] != fold]
        levels, fit = pooled(rest["score"].to_numpy(), rest["label"].to_numpy(float))
        assert np.allclose(part["p"], np.interp(part["score"], levels, fit), atol=1e-9)


def test_calibration_query_keeps_every_labelled_alert(spark, v):
    got = rows(spark, "i4_isotonic_calibration")
    assert len(got) == score_queries.labelled(v).count()
    assert got["calibrated"].dropna().between(0, 1).all()


def test_reconstruction_errors_equal_numpy(spark, v):
    got = rows(spark, "i6_reconstruction_error")
    base = score_queries.reconstructed(v).select("meter_id", F.col("date").cast("string").alias("date"), "profile").toPandas()
    x = np.vstack(base["profile"])
    std = x.std(axis=0, ddof=1)
    z = np.divide(x - x.mean(axis=0), std, out=np.zeros_like(x), where=std > 0)
    _, vec = np.linalg.eigh(np.cov(z.T))
    pc = vec[:, -16:]
    base["want"] = ((z - z @ pc @ pc.T) ** 2).mean(axis=1)
    both = got.merge(base, on=["meter_id", "date"])
    assert len(both) == len(got) and np.allclose(both["recon_error"], both["want"], atol=1e-5)


def test_changepoints_equal_one_series_at_a_time(spark, v):
    hours = v.hourly.where("kwh IS NOT NULL").select("meter_id", "hour_ts", "kwh").toPandas().sort_values(["meter_id", "hour_ts"])
    want = set()
    for meter, part in hours.groupby("meter_id"):
        _, breaks, _ = Changepoints().scan(part["kwh"].to_numpy())
        want |= {(meter, int(i) + 1) for i in np.flatnonzero(breaks)}
    got = rows(spark, "i13_changepoints")
    assert {(r.meter_id, r.position) for r in got.itertuples()} == want and want
    recent = rows(spark, "i14_recent_changepoint")
    assert set(recent["meter_id"]) == set(v.hourly.select("meter_id").distinct().toPandas()["meter_id"])
    assert set(recent[recent["last_changepoint"].notna()]["meter_id"]) == {m for m, _ in want}


def test_median_forecast_beats_the_trailing_mean(spark, v):
    got = models.median_forecast(v.forecasts, iterations=60).where("NOT is_train")
    errors = got.agg(F.avg(F.abs(F.col("actual_mw") - F.col("p50"))), F.avg(F.abs(F.col("actual_mw") - F.col("forecast_mw")))).first()
    assert errors[0] < errors[1]


def test_group_number_is_bounded_and_spectrum_starts_at_zero(spark):
    got = rows(spark, "h6_eigengap")
    assert got["eigenvalue"].is_monotonic_increasing and abs(got["eigenvalue"].iloc[0]) < 1e-6
    assert got[got["best"]]["k"].between(5, 40).all() and got["best"].sum() == 1
