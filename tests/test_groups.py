"""Spectrum, group counts and power iteration on planted groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import peers


def planted(spark, groups, each, spread=0.25):
    rng = np.random.default_rng(groups)
    centres = rng.normal(size=(groups, 6)) * 4
    rows = [(g * each + i, g, [float(v) for v in centres[g] + rng.normal(0, spread, 6)]) for g in range(groups) for i in range(each)]
    return spark.createDataFrame(rows, "meter_id bigint, cluster int, profile array<double>")


def affinity(rows, landmarks, width=1.5):
    few = peers.landmarks(rows, landmarks)
    pairs = rows.withColumn("_l", F.explode(few)).select("meter_id", F.col("_l.meter_id").alias("landmark_id"), peers.euclidean(F.col("profile"), F.col("_l.profile")).alias("d"))
    return pairs.withColumn("affinity", F.exp(-F.col("d") * F.col("d") / (2 * width * width)))


def test_seven_groups_give_seven(spark):
    rows = planted(spark, 7, 30)
    a = affinity(rows, 60).cache()
    out = peers.group_count_by_gap(a, least=2, most=20).collect()
    assert [r.k for r in out if r.best] == [7]
    wide = a.toPandas().pivot(index="meter_id", columns="landmark_id", values="affinity").to_numpy()
    z = wide / wide.sum(axis=1, keepdims=True)
    z = z / np.sqrt(z.sum(axis=0))
    full = np.sort(1 - np.clip(np.linalg.eigvalsh(z @ z.T), 0, 1))  # of all meters by all meters
    assert np.allclose([r.eigenvalue for r in out], full[: len(out)], atol=1e-9)
    assert abs(out[0].eigenvalue) < 1e-9
    assert [r.k for r in peers.group_count_by_gap(a, least=9, most=20).collect() if r.best] == [9]


def test_power_iteration_finds_planted_groups(spark):
    rows = planted(spark, 4, 40)
    a = affinity(rows, 40)
    found = peers.power_iteration_groups(a, 4)
    assert found.count() == 160
    assert peers.agreement(found, rows).first()["adjusted_rand"] > 0.95
    assert peers.agreement(found, peers.group_by_affinity(a, 4)).first()["adjusted_rand"] > 0.95


@pytest.mark.parametrize("labels, want", [([0, 0, 1, 1], 1.0), ([5, 5, 2, 2], 1.0), ([0, 1, 0, 1], -0.5)])
def test_agreement(spark, labels, want):
    a = spark.createDataFrame(list(enumerate([0, 0, 1, 1])), "meter_id bigint, cluster int")
    b = spark.createDataFrame(list(enumerate(labels)), "meter_id bigint, cluster int")
    assert peers.agreement(a, b).first()["adjusted_rand"] == pytest.approx(want)
