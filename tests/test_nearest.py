"""Nearest sites against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import nearest

SCHEMA = "zone string, site bigint, latitude double, longitude double"


def km(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return round(2 * 6371 * math.asin(min(1.0, math.sqrt(h))), 9)


def plain(rows):
    rows = {(z, i, p, q) for z, i, p, q in rows if None not in (i, p, q)}
    out = {}
    for z, i, p, q in rows:
        near = sorted((km((p, q), (r, s)), j) for y, j, r, s in rows if y == z and j != i)
        out[z, i] = (near[0][1], near[0][0]) if near else (None, None)
    return out


def found(df):
    rows = nearest.nearest_other(df, ["zone"], "site").collect()
    out = {(r.zone, r.site): (r.nearest, r.km) for r in rows}
    assert len(out) == len(rows)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, (i, d) in want.items():
        assert got[k][0] == i and (d is None) == (got[k][1] is None) and (d is None or abs(got[k][1] - d) <= 2e-9), (k, got[k], (i, d))


def test_equal_to_all_pairs(spark):
    rng = random.Random(3)
    rows = [("world", i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(150)]
    rows += [("town", i, 12.8 + rng.randrange(40) / 400, 77.4 + rng.randrange(40) / 300) for i in range(250)]  # a lattice: ties and shared places
    rows += [("date line", i, rng.uniform(-1, 1), (179.5 + rng.uniform(0, 1) + 180) % 360 - 180) for i in range(60)]
    rows += [("poles", i, rng.choice([-90.0, 90.0, 89.99, -89.999]), rng.uniform(-180, 180)) for i in range(40)]
    rows += [("one", 1, 3.0, 4.0), ("one place", 1, 3.0, 4.0), ("one place", 2, 3.0, 4.0), ("one place", 3, 3.0, 4.0)]
    rows += [("far", 1, 0.0, 0.0), ("far", 2, 0.0, 180.0), (None, 5, 1.0, 1.0), (None, 6, 1.0, 1.5), ("odd", None, 1.0, 1.0), ("odd", 7, None, 1.0)]
    rows += rows[:5]
    same(found(spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit(1)).withColumn("km", F.lit(1))), plain(rows))
    assert nearest.nearest_other(spark.createDataFrame([], SCHEMA), ["zone"], "site").collect() == []


def test_one_hot_cell(spark):
    """Half of all sites stand within 100 m; a far site must not meet each of them in ring after ring."""
    rng = random.Random(5)
    rows = [("z", i, 10 + rng.uniform(0, 1e-3), 20 + rng.uniform(0, 1e-3)) for i in range(400)]
    rows += [("z", 600 + i, rng.uniform(0, 30), rng.uniform(0, 40)) for i in range(300)] + [("z", 1200, 10.2, 20.3)]
    df = spark.createDataFrame(rows, SCHEMA)
    places = df.select("zone", "latitude", "longitude")
    level = nearest._start_level(places, ["zone"], "latitude", "longitude", nearest.CELL_PLACES)
    x, y = nearest._cell(F.col("latitude"), F.col("longitude"), level)
    assert df.groupBy("zone", x, y).count().agg(F.max("count")).first()[0] <= nearest.CELL_PLACES
    same(found(df), plain(rows))


@pytest.mark.parametrize("level", [2, 5, 9])
def test_certain_distance_is_a_lower_bound(spark, level):
    rng = random.Random(level)
    rows = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(40)]
    a = spark.createDataFrame(rows, "p double, q double")
    x, y = nearest._cell(F.col("p"), F.col("q"), level)
    got = a.select("p", "q", x.alias("x"), y.alias("y"), nearest._certain_km(F.col("p"), F.col("q"), level).alias("certain")).collect()
    n = 2**level
    for r in got:
        for s in got:
            inside = (s.x - r.x + 1) % n <= 2 and abs(s.y - r.y) <= 1
            assert inside or km((r.p, r.q), (s.p, s.q)) >= r.certain - 1e-6
