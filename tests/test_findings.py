"""One case per finding of a review; each failed before its change."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from types import SimpleNamespace

from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def test_zero_step_is_no_rollback(spark):
    """three readings of an hour in another order than that of their times, then an hour without a change."""
    from meterlake.functions.scaling import running
    from meterlake.operators import features

    minutes = [(0, 0.01), (2, 0.07), (1, 0.04), (60, 0.0), (120, 1.0)]
    rows = [(m, i, START + dt.timedelta(minutes=at), x) for m in range(8) for i, (at, x) in enumerate(minutes)]
    df = spark.createDataFrame(rows, "meter_id bigint, reading_id bigint, timestamp timestamp, step double").coalesce(1)
    register = running(df, ["meter_id"], F.date_trunc("hour", "timestamp"), ["timestamp", "reading_id"], sums={"cumulative_kwh": "step"})
    got = features.rollback(register).collect()
    assert len(got) == len(rows) and not any(r.cumulative_rollback for r in got)


def test_twice_the_mean_is_no_change(spark):
    """a day of exactly twice the mean day, whatever the order of the sum."""
    from meterlake.plans.join_queries import changes

    orders = list(itertools.permutations([0.1, 0.01, 0.04]))
    days = [(m, START + dt.timedelta(days=d), x) for m, values in enumerate(orders) for d, x in enumerate(values)]
    days += [(100, START, 1.0), (100, START + dt.timedelta(days=1), 1.0), (100, START + dt.timedelta(days=2), 4.1)]
    v = SimpleNamespace(readings=spark.createDataFrame(days, "meter_id bigint, timestamp timestamp, kwh double"))
    assert [(r.meter_id, r.kwh) for r in changes(v).collect()] == [(100, 4.1)]


def test_slope_of_a_constant_cause(spark):
    """the slope on a cause that never varied is NaN, as SQL's regr_slope; with one day, too."""
    from meterlake.operators import explain

    rows = [(1, START, 3.0, 0.0), (1, START + dt.timedelta(days=1), 5.0, 0.0), (2, START, 1.0, 4.0), (3, START, 1.0, 0.0), (3, START + dt.timedelta(days=1), 3.0, 4.0)]
    df = spark.createDataFrame(rows, "meter_id bigint, date timestamp, kwh double, rain double")
    got = {r.meter_id: r.slope for r in explain.single_effect(df, "rain").collect()}
    assert math.isnan(got[1]) and math.isnan(got[2]) and got[3] == 0.5


def test_log_order_is_total(spark):
    """steps of equal time, alert and number are logged in one order, however the rows arrive."""
    from meterlake.plans.structure_queries import zone_log

    rows = [("Z", 1, START, 2, p, 5, "Pass") for p in range(40)]
    names = "zone string, related_alert_id bigint, action_timestamp timestamp, step int, part_id bigint, inspector_id bigint, outcome string"
    logs = [zone_log(SimpleNamespace(audits=spark.createDataFrame(r, names).coalesce(1))).orderBy("position").collect() for r in (rows, rows[::-1])]
    assert logs[0] == logs[1]


def test_series_side_by_side():
    """series scanned together give the breaks of each alone, over the cut of the run lengths, too."""
    import numpy as np

    from meterlake.functions.kernels import Changepoints

    rng = np.random.default_rng(3)
    series = [np.concatenate([rng.normal(10, 1, a), rng.normal(20, 1, b)]) for a, b in ((250, 150), (5, 0), (60, 60), (1, 0), (340, 40))] + [np.array([])]
    d, found = Changepoints(), 0
    for x, (at, mass) in zip(series, Changepoints().scan_many(series), strict=True):
        masses, breaks, _ = d.scan(x)
        assert at.tolist() == np.flatnonzero(breaks).tolist() and np.allclose(mass, masses[at])
        found += len(at)
    assert found >= 3 and Changepoints().scan_many([]) == []


def test_one_timer_a_meter(spark):
    """a batch of many hours costs a meter a few calls to the state store, not some for every hour."""
    import numpy as np
    import pandas as pd

    from meterlake.functions.kernels import Changepoints
    from meterlake.streaming import jobs

    calls = []

    class Cell:
        value, rows = None, ()

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.value = args[0]
                elif name in ("appendList", "put"):
                    self.rows = (*self.rows, *args[0]) if name == "appendList" else tuple(args[0])
                elif name == "clear":
                    self.rows = ()
                elif name == "exists":
                    return self.value is not None
                elif name == "get":
                    return self.value if self.value is not None else iter(self.rows)
                elif name in ("getValueState", "getListState"):
                    return Cell()
                return None

            return call

    job = jobs.OrderedChangepoints(Changepoints())
    job.init(Cell())
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(10, 1, 250), rng.normal(18, 1, 50)])
    part = pd.DataFrame({"timestamp": pd.date_range(START, periods=300, freq="h"), "reading_id": range(300), "kwh": x})
    list(job.handleInputRows((7,), iter([part.sample(frac=1, random_state=1)]), None))
    first = int(part["timestamp"][0].value // 3_600_000_000_000 + 1) * 3_600_000
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: first + 290 * 3_600_000 + 1)
    got = pd.concat(job.handleExpiredTimer((7,), now, SimpleNamespace(getExpiryTimeInMs=lambda: first)))
    assert got["position"].tolist() == [int(i) + 1 for i in np.flatnonzero(Changepoints().scan(x[:291])[1])]
    assert len(calls) <= 20


def test_rolling_sorts_once(spark):
    """one numbering, so one shuffle and one sort, for all widths, with the frames of plain windows; a null meter is a meter."""
    from pyspark.sql import Window

    from meterlake.operators import features

    rows = [(m, START + dt.timedelta(hours=i), None if (i * 7 + m) % 5 == 0 or 20 < i < 40 else float((i * 37 + m) % 11) + (1e9 if i == 50 else 0.0)) for m in range(30) for i in range(100 if m else 1)]
    rows = [(m or None, t, x) for m, t, x in rows]
    got = features.rolling(spark.createDataFrame(rows, "meter_id bigint, hour_ts timestamp, kwh double"), "kwh", [1, 4, 24])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Sort" not in plan
    for k in (1, 4, 24):
        w = Window.partitionBy("meter_id").orderBy("hour_ts").rowsBetween(-k, 0)
        want = got.select("meter_id", "hour_ts", *[f"roll_{c}_{k}" for c in ("mean", "std", "max")], F.avg("kwh").over(w).alias("m"), F.stddev("kwh").over(w).alias("s"), F.max("kwh").over(w).alias("t"))
        found = want.collect()
        assert len(found) == len(rows)
        for r in found:
            for a, b in ((r[2], r.m), (r[3], r.s), (r[4], r.t)):
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6 if r.t > 1e8 else 1e-9))


def test_passages_at_the_threshold_are_found():
    """F8: 50 words of which three changed near the ends, and 200 words with a long stretch between their seeds."""
    import numpy as np

    from meterlake.llm import substring

    def found(size, changed, segments):
        a = np.arange(size + 80)
        b = a.copy()
        b[:40], b[40 + size :] = -1 - a[:40], -1 - a[40 + size :]
        b[[40 + i for i in changed]] = -1000
        return [(x0, x1) for x0, x1, _, _, _ in substring.align(a, b, segments)]

    assert found(50, (2, 4, 46), [(50, 50, 20)]) == [(40, 90)]
    assert found(50, (), [(50, 50, 20)]) == [(40, 90)]
    x = np.array([40, 47, 140, 150])
    parts = substring.joined(substring.chain(x, x))
    assert [[s[0] for s in p] for p in parts] == [[40, 140]]
    assert len(substring.joined(substring.chain(x, x + np.array([0, 0, 900, 900])))) == 2


def test_stream_join_by_the_hour(spark, tmp_path):
    """the hour is part of the key of the stream join; telemetry off the hour is met in both its hours."""
    from meterlake.streaming import jobs

    minute = lambda m: START + dt.timedelta(minutes=m)
    readings = spark.createDataFrame([(i, 1, minute(7 * i), 1.0) for i in range(40)], "reading_id bigint, meter_id bigint, timestamp timestamp, kwh double")
    telemetry = spark.createDataFrame([("F", minute(m), float(m)) for m in (0, 60, 75, 120)], "feeder_id string, timestamp timestamp, feeder_input_kwh double")
    meters = spark.createDataFrame([(1, "F")], "meter_id bigint, feeder_id string")
    sides = []
    for name, df in (("readings", readings), ("telemetry", telemetry)):
        df.write.parquet(f"{tmp_path}/{name}")
        sides.append(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}"))
    joined = jobs.feeder_matches(sides[0], meters, sides[1])
    join = next(line for line in joined._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in line and "_f#" in line)
    assert "(_h#" in join
    got = sorted((r.reading_id, r.feeder_input_kwh) for r in jobs.run_to_table(joined, "matches").collect())
    assert got == sorted((i, float(m)) for i in range(40) for m in (0, 60, 75, 120) if m <= 7 * i < m + 60)


def test_forest_scores_side_by_side():
    """rows go down a tree a level at a time and get what a walk of one row gives, in fewer steps."""
    import numpy as np

    from meterlake.functions import kernels

    rng = np.random.default_rng(3)
    x = np.where(rng.random((500, 9)) < 0.5, 0.0, rng.normal(size=(500, 9)))
    trees = [kernels.grow_tree(x[rng.choice(500, 64)], k, 64) for k in range(5)] + [kernels.grow_tree(x[:1], 9, 64)]

    def walk(t, row):
        at = 0
        while t[at, 0] >= 0:
            value = sum(row[int(f)] * w for f, w in zip(t[at, 4:6], t[at, 6:8]))
            at = int(t[at, 0] if value <= t[at, 2] else t[at, 1])
        return t[at, 3]

    x = np.vstack([x, np.full((1, 9), np.nan)])
    for t in trees:
        assert kernels.tree_depths(t, x).tolist() == [walk(t, row) for row in x]
    assert kernels.tree_depths(trees[0], x[:0]).tolist() == []
    # scores do not hang on how rows are cut into portions
    many = np.vstack([x] * 20)
    assert len(many) > kernels.TOGETHER
    assert np.array_equal(kernels.forest_scores(trees, 64.0, many), np.concatenate([kernels.forest_scores(trees, 64.0, x)] * 20))


def test_running_deals_rows_out_once(spark):
    """Wide rows are dealt out once for numbers and offsets; nulls as in a plain window."""
    from pyspark.sql import Window

    from meterlake.functions.scaling import running

    rows = [(k, d, i) for i, (k, d) in enumerate(itertools.product([None, 0, 1], [None, dt.date(1970, 1, 1), dt.date(2024, 1, 2)])) for _ in range(3)]
    df = spark.createDataFrame([(k, d, i, 3 * i + j) for j in range(2) for k, d, i in rows], "k bigint, d date, i int, x bigint")
    df = df.withColumn("id", F.monotonically_increasing_id())
    plain = Window.partitionBy("k")
    for small, down in itertools.product((False, True), (False, True)):
        got = running(df, ["k"], F.col("d"), ["d", "id"], number="n", sums={"s": "x"}, descending=down, small=small)
        assert got.columns == [*df.columns, "n", "s"]
        w = plain.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c in ("d", "id")])
        want = df.withColumns({"n": F.row_number().over(w), "s": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))})
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = running(df, ["k"], F.col("d"), ["d", "id"], number="n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 4


def test_peak_of_twice_the_mean_is_no_bypass(spark, tmp_path):
    """a day whose peak is exactly twice its mean is no bypass, whatever the order of the sum; a little more is one."""
    from meterlake.plans import catalog

    catalog.load_all()
    kwh = [80.68, 17.49, 107.52, 34.82, 80.03, 2.02]
    days = list(enumerate(itertools.islice(itertools.permutations(kwh), 0, 720, 9))) + [(100, [*kwh[:4], 80.01, 2.02])]
    events = [(10 * m + h, START + dt.timedelta(hours=h), m, "view", x, '{"k": 1}') for m, day in days for h, x in enumerate(day)]
    tables = {
        "events": (events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
        "customer": ([(m, 1, 0.0, "BUILDING") for m, _ in days], "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.meter_id: r.anomaly_kind for r in catalog.QUERIES["i16_pattern_rules"](spark, str(tmp_path)).collect()}
    assert len(got) == len(days) and [m for m, kind in got.items() if kind == "bypass"] == [100]


def test_demand_rows_read_forecasts_once(spark):
    """what comes before the demand rows, a pass over all orders, is computed once."""
    from meterlake.operators import models

    days = [(z, (START + dt.timedelta(days=d)).date(), 100.0 + 7 * d % 13, 101.0) for z in "AB" for d in range(40)]
    source = spark.createDataFrame(days, "zone string, forecast_date date, actual_mw double, forecast_mw double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = models._demand_rows(source.mapInPandas(count, source.schema))
    assert rows.count() == len(days) and rows.where("is_train").count() == 64
    assert seen.value == len(days)


def test_power_steps_send_no_meters(spark, monkeypatch):
    """steps of the walk join nothing by meter, so no meter's value is broadcast; the values are those of a plain walk."""
    import numpy as np

    from meterlake.operators import peers

    w = np.random.default_rng(2).uniform(0.1, 1.0, (60, 7))
    affinity = spark.createDataFrame([(m, 100 + k, float(w[m, k])) for m in range(60) for k in range(7)], "meter_id bigint, landmark_id bigint, affinity double")
    plans, tables, settle = [], [], peers.settle

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables.append(settle(df, name))
        return tables[-1]

    monkeypatch.setattr(peers, "settle", watched)
    got = peers.power_iteration_groups(affinity, 3, nearest=4, starts=2, rounds=3).collect()
    assert len(got) == 60 and not any("Join" in p for p in plans)
    w = np.where(np.argsort(np.argsort(-w, axis=1), axis=1) < 4, w, 0.0)
    start = [F.pmod(F.xxhash64("id", F.lit(42 + i)), F.lit(2**32)) / F.lit(float(2**32)) for i in range(2)]
    x = np.array(spark.range(60).orderBy("id").select(*start).collect())
    for _ in range(3):
        x = w @ (w.T @ x / w.sum(0)[:, None]) / w.sum(1)[:, None]
    walked = np.array(tables[-2].orderBy("meter_id").select("x0", "x1").collect())
    assert np.allclose(walked, x, rtol=0, atol=1e-12)
