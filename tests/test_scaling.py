"""The bucketed helpers against plain pandas, with one key holding a third of the rows and many equal values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions.scaling import neighbours, ntile, quantiles, ranks, running


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    return pd.DataFrame(
        {"k": key.astype("int64"), "t": rng.integers(0, 500, n).astype("int64"), "id": np.arange(n, dtype="int64"), "x": np.round(rng.normal(size=n), 1)}
    )


def test_running(spark, rows):
    got = running(spark.createDataFrame(rows), ["k"], F.floor(F.col("t") / 50), ["t", "id"], number="n", sums={"s": "x"}).toPandas()
    want = rows.sort_values(["t", "id"]).copy()
    want["n"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["x"].cumsum()
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert (both["n"] == both["n_w"]).all() and np.allclose(both["s"], both["s_w"])


def test_running_without_keys_descending(spark, rows):
    got = running(spark.createDataFrame(rows), [], F.floor(F.col("t") / 50), ["t", "id"], number="n", descending=True).toPandas()
    want = rows.sort_values(["t", "id"], ascending=False).reset_index(drop=True)
    want["w"] = want.index + 1
    both = got.merge(want[["id", "w"]], on="id")
    assert (both["n"] == both["w"]).all()


def test_neighbours(spark, rows):
    got = neighbours(spark.createDataFrame(rows), ["k"], F.floor(F.col("t") / 7), ["t", "id"], ["x"], following=True).toPandas()
    want = rows.sort_values(["t", "id"]).copy()
    want["p"] = want.groupby("k")["x"].shift(1)
    want["q"] = want.groupby("k")["x"].shift(-1)
    both = got.merge(want[["id", "p", "q"]], on="id")
    pd.testing.assert_series_equal(both["prev_x"], both["p"], check_names=False)
    pd.testing.assert_series_equal(both["next_x"], both["q"], check_names=False)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("piece", [1 << 15, 60, 3])
def test_quantiles(spark, rows, keys, piece):
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = quantiles(spark.createDataFrame(rows), keys, "x", points, cuts=8, piece=piece).toPandas()
    groups = [((), rows)] if not keys else list(rows.groupby("k"))
    assert len(got) == len(groups)
    for key, part in groups:
        line = got if not keys else got[got["k"] == key]
        for name, p in points.items():
            assert line[name].iloc[0] == pytest.approx(np.quantile(part["x"], p))


def test_ranks_and_tiles(spark, rows):
    got = ranks(spark.createDataFrame(rows), ["k"], "x", "id", [-1, 0, 1])
    got = got.withColumn("tile", ntile(7, F.col("row_number"), F.col("group_rows"))).toPandas().set_index("id")
    for _, part in rows.groupby("k"):
        r = part.set_index("id")
        lines = got.loc[r.index]
        assert (lines["rank"] == r["x"].rank(method="min", ascending=False)).all()
        assert (lines["dense_rank"] == r["x"].rank(method="dense", ascending=False)).all()
        order = r.reset_index().sort_values(["x", "id"], ascending=[False, True])["id"].tolist()
        assert (lines.loc[order, "row_number"].to_numpy() == np.arange(1, len(order) + 1)).all()
        tiles = np.concatenate([np.full(len(c), i + 1) for i, c in enumerate(np.array_split(np.arange(len(order)), 7))])
        assert (lines.loc[order, "tile"].to_numpy() == tiles).all()


def test_empty_input(spark, rows):
    none = spark.createDataFrame(rows).where("false")
    assert running(none, ["k"], F.col("t"), ["t", "id"], number="n").count() == 0
    assert neighbours(none, ["k"], F.col("t"), ["t", "id"], ["x"]).count() == 0
    assert quantiles(none, ["k"], "x", {"m": 0.5}).count() == 0
    assert quantiles(none, [], "x", {"m": 0.5}).first()["m"] is None


@pytest.fixture(scope="module")
def holes(spark):
    """Rows with null keys, order values and values."""
    rng = np.random.default_rng(6)
    pick = lambda x: None if rng.random() < 0.2 else x
    rows = [(pick(int(rng.integers(3))), pick(int(rng.integers(40))), i, pick(float(rng.integers(9)))) for i in range(300)]
    return spark.createDataFrame(rows, "k bigint, t bigint, id bigint, x double").cache()


def same(got, want, columns):
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(got) == rows(want)


def test_nulls_as_in_plain_windows(holes):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "id")
    bucket = F.floor(F.col("t") / 7)
    want = holes.withColumns({"n": F.row_number().over(w), "s": F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), "prev_x": F.lag("x").over(w), "next_x": F.lead("x").over(w)})
    same(running(holes, ["k"], bucket, ["t", "id"], number="n", sums={"s": "x"}), want, ["id", "n", "s"])
    same(neighbours(holes, ["k"], bucket, ["t", "id"], ["x"], following=True), want, ["id", "prev_x", "next_x"])


def test_null_scores_are_ranked_last(holes):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy(F.desc("x"))
    want = holes.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "row_number": F.row_number().over(Window.partitionBy("k").orderBy(F.desc("x"), "id"))})
    same(ranks(holes, ["k"], "x", "id", [2.0, 5.0]), want, ["id", "rank", "dense_rank", "row_number"])


def test_quantiles_of_a_null_group(holes):
    want = holes.groupBy("k").agg(F.expr("percentile(x, 0.3)").alias("q"))
    same(quantiles(holes, ["k"], "x", {"q": 0.3}, cuts=4).withColumn("q", F.round("q", 9)), want.withColumn("q", F.round("q", 9)), ["k", "q"])


def test_quantiles_order_a_small_part_of_many_values(spark):
    """10^6 distinct values of one key: what is left to order for three points is a bounded share."""
    from meterlake.functions import scaling

    df = spark.range(1_000_000).selectExpr("1 AS k", "cast((id * 7919) % 1000003 AS double) AS x")
    got = quantiles(df, ["k"], "x", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    values = np.sort((np.arange(1_000_000, dtype=np.int64) * 7919) % 1000003)
    assert [got.a, got.b, got.c] == pytest.approx(np.quantile(values, [0.01, 0.5, 0.99]))
    rows = df.selectExpr("k", "x AS _v", "1L AS _c", "0L AS _g", "0L AS _off", "1000000L AS _total")
    for _ in range(2):
        rows = scaling._cut_again(rows, ["k"], [F.floor(F.lit(p) * 999_999) for p in (0.01, 0.5, 0.99)], 64)
    assert rows.count() < 5_000


def test_as_of_keeps_rows_without_key(spark):
    from meterlake.operators.joins import as_of

    left = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 10:00'), (NULL, timestamp'2024-01-01 10:00'), (1, NULL) AS t(k, ts)")
    right = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 07:00', 5.0D), (NULL, timestamp'2024-01-01 07:00', 9.0D) AS t(k, ts, v)")
    got = as_of(left, right, "k", "ts", "v", "seen").collect()
    assert sorted(repr((r.k, r.ts is None, r.seen)) for r in got) == sorted(map(repr, [(1, False, 5.0), (None, False, None), (1, True, None)]))
