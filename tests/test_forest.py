"""The forest on histograms against plain versions, MLlib's and planted cases."""

from __future__ import annotations

import datetime as dt
import uuid
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from meterlake.operators import forest, models
from meterlake.plans import reports, score_queries

NAMES = ["a", "b", "c", "d"]


def planted(spark, rows=1500, seed=3, swap=False):
    """Theft on days with a large ``a`` and a small ``b``; ``c`` is mostly zero, ``d`` is noise with nulls."""
    rng = np.random.default_rng(seed)
    a, b, d = rng.normal(size=(3, rows))
    c = np.where(rng.random(rows) < 0.9, 0.0, rng.random(rows))
    y = (a - b + rng.normal(size=rows) > 2.2).astype(int) if not swap else (b - a > 2).astype(int)
    day = dt.date(2024, 1, 1)
    cells = [
        (i, day + dt.timedelta(days=i // 50), float(p), float(q), float(r), None if i % 11 == 0 else float(s), int(t))
        for i, (p, q, r, s, t) in enumerate(zip(a, b, c, d, y, strict=True))
    ]
    return spark.createDataFrame(cells, "meter_id bigint, date date, a double, b double, c double, d double, y int")


def auc(rows):
    scores, labels = np.array([r["supervised"] for r in rows]), np.array([r["y"] for r in rows])
    gaps = scores[labels == 1][:, None] - scores[labels == 0][None, :]
    return ((gaps > 0) + 0.5 * (gaps == 0)).mean()


def impurity(n, weights):
    w = np.asarray(n) * weights
    return 1 - (w**2).sum() / w.sum() ** 2


def plain_split(x, y, n, drawn, bins, weights, least):
    total = np.array([n[y == k].sum() for k in (0, 1)])
    best = (0.0, -1, 0)
    for f in drawn:
        for cut in range(bins - 1):
            left = np.array([n[(y == k) & (x[:, f] <= cut)].sum() for k in (0, 1)])
            right = total - left
            if min(left.sum(), right.sum()) < least:
                continue
            part = (left * weights).sum() / (total * weights).sum()
            gain = round(impurity(total, weights) - part * impurity(left, weights) - (1 - part) * impurity(right, weights), 12)
            if gain > best[0] + 1e-11:
                best = (gain, f, cut)
    return best


def test_forest_equals_plain_trees(spark, monkeypatch):
    """The same bags and drawn features, one node after the other; held rows and steps cut the table in pieces."""
    df = planted(spark, 300).fillna(0.0, NAMES)
    rows = df.orderBy("meter_id").collect()
    weights, bins, depth = np.array([0.6, 3.0]), 8, 3
    model = forest.fit_forest(df.repartition(3), "meter_id", NAMES, "y", tuple(weights), trees=5, depth=depth, bins=bins, seed=1)
    x = forest.binned(model.edges, [np.array([r[c] for r in rows]) for c in NAMES])
    y, ids = np.array([r["y"] for r in rows]), np.arange(len(rows))
    shares = np.zeros(len(rows))
    for t in range(5):
        n = forest.bags(ids, t // forest.DRAWS, 1)[:, t % forest.DRAWS].astype(int)
        tree, members, raw = {}, {0: ids}, {}
        for node in range(2 ** (depth + 1) - 1):
            own = members.get(node)
            if own is None:
                continue
            raw[node] = np.array([n[own][y[own] == k].sum() for k in (0, 1)])
            d = (node + 1).bit_length() - 1
            if d == depth or raw[node].min() == 0:
                continue
            drawn = np.sort(np.random.default_rng([1, t, d]).random((2**d, len(NAMES))).argsort(axis=1)[node - 2**d + 1, :2])
            gain, f, cut = plain_split(x[own], y[own], n[own], drawn, bins, weights, 2)
            if f >= 0:
                tree[node] = (f, cut, gain)
                members[2 * node + 1], members[2 * node + 2] = own[x[own, f] <= cut], own[x[own, f] > cut]
        says = {k: (v * weights)[1] > (v * weights)[0] for k, v in raw.items()}
        for node in sorted(tree, reverse=True):
            if 2 * node + 1 not in tree and 2 * node + 2 not in tree and says[2 * node + 1] == says[2 * node + 2]:
                del tree[node]
        assert {i: (int(model.feature[t, i]), int(model.cut[t, i])) for i in np.flatnonzero(model.feature[t] >= 0)} == {k: v[:2] for k, v in tree.items()}
        assert all(np.isclose(model.gain[t, k], v[2]) for k, v in tree.items())
        for i in ids:
            node = 0
            while node in tree:
                node = 2 * node + 1 + int(x[i, tree[node][0]] > tree[node][1])
            shares[i] += (raw[node] * weights)[1] / (raw[node] * weights).sum() / 5
    got = model.score(df, "supervised").orderBy("meter_id").collect()
    assert np.allclose([r["supervised"] for r in got], shares)
    monkeypatch.setattr(forest, "STEP_ROWS", 7)
    assert (forest.bags(ids, 0, 1)[5:9] == forest.bags(ids[5:9], 0, 1)).all()


def test_counts_of_held_rows_add_up(monkeypatch):
    """Rows held in pieces give the counts of all; a node's pieces may lie in several batches."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    ids, y, x = np.arange(500), rng.integers(0, 2, 500), rng.integers(0, 6, (500, 4)).astype(np.uint8)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(y[a:b].astype(np.int32)), pa.array([r.tobytes() for r in x[a:b]], pa.binary())], ["id", "y", "bins"])
    chosen = np.array([[0, 2], [1, 3], [0, 1]])
    feature, cut = np.full((3, 7), -1), np.zeros((3, 7), np.int64)

    def splits(batches):
        run = forest._counts(feature, cut, 0, [np.zeros(1, np.int64)] * 3, [chosen[i : i + 1] for i in range(3)], 6, 9)
        cells = pa.Table.from_batches(run(iter(batches))).sort_by("node")
        out = [forest._splits(chosen, 6, (1.0, 1.0), 2)(iter(cells.to_batches(max_chunksize=k))) for k in (1, 2, 100)]
        return [pa.Table.from_batches(o).to_pylist() for o in out]

    whole = splits([batch(0, 500)])
    monkeypatch.setattr(forest, "HELD_ROWS", 60)
    monkeypatch.setattr(forest, "STEP_ROWS", 11)
    pieces = splits([batch(i, i + 50) for i in range(0, 500, 50)])
    assert all(p == whole[0] for p in [*whole, *pieces]) and [r["node"] for r in whole[0]] == [0, 1, 2]


def test_bags_are_poisson_and_independent():
    n = np.concatenate([forest.bags(np.arange(200_000), g, 42) for g in range(2)], axis=1).astype(float)
    assert np.allclose(n.mean(axis=0), 1, atol=0.01) and np.allclose(n.var(axis=0), 1, atol=0.02)
    assert np.abs(np.corrcoef(n.T) - np.eye(8)).max() < 0.01
    assert abs(np.corrcoef(n[:-1, 0], n[1:, 0])[0, 1]) < 0.01


def test_edges_follow_frequent_values():
    rng = np.random.default_rng(1)
    x = np.where(rng.random(50_000) < 0.9, 0.0, rng.random(50_000) - 0.3)
    pieces = [forest.summary(p, np.ones(len(p)), 256) for p in np.split(x, 10)]
    assert all(len(v) < 4 * 256 and c.sum() == 5000 for v, c in pieces)
    assert all(c[v == 0][0] == (p == 0).sum() for (v, c), p in zip(pieces, np.split(x, 10), strict=True))
    v, c = (np.concatenate(p) for p in zip(*pieces, strict=True))
    edges = forest.edges_of(*forest.summary(v, c, len(v)), 32)
    parts = np.bincount(np.searchsorted(edges, x), minlength=32)
    assert len(edges) <= 31 and (parts == (x == 0).sum()).any()  # zero alone
    assert np.sort(parts)[-2] < 2.5 * (x != 0).sum() / 30
    assert forest.edges_of(np.array([1.0, 2.0, 5.0]), np.array([1, 90, 1]), 32).tolist() == [1.0, 2.0]
    assert len(forest.edges_of(np.array([4.0]), np.array([9]), 32)) == 0


def test_as_good_as_mllibs_forest(spark):
    df = planted(spark, 3000).fillna(0.0, NAMES)
    model, scored, train = models.theft_classifier(df, NAMES, "y", "date", ["meter_id"], trees=40, depth=6)
    later = scored.collect()
    assert len(later) == 600 and train.count() == 2400
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    weighed = VectorAssembler(inputCols=NAMES, outputCol="x").transform(train.withColumn("w", F.when(F.col("y") == 1, 1200 / n[1]).otherwise(1200 / n[0])))
    other = RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="w", numTrees=40, maxDepth=6, minInstancesPerNode=2, seed=42).fit(weighed)
    theirs = other.transform(VectorAssembler(inputCols=NAMES, outputCol="x").transform(scored.drop("supervised")))
    theirs = theirs.withColumn("supervised", vector_to_array("probability")[1]).collect()
    assert auc(later) > auc(theirs) - 0.02 and auc(later) > 0.85
    gaps = {r["meter_id"]: r["supervised"] for r in theirs}
    assert np.mean([abs(gaps[r["meter_id"]] - r["supervised"]) for r in later]) < 0.06
    assert np.abs(model.importances() - other.featureImportances.toArray()).max() < 0.1
    assert np.isclose(model.importances().sum(), 1)


def test_scores_do_not_hang_on_partitions(spark):
    df = planted(spark)
    found = []
    for parts in (1, 7):
        _, scored, _ = models.theft_classifier(df.repartition(parts), NAMES, "y", "date", ["meter_id"], trees=12, depth=5)
        found.append({r["meter_id"]: r["supervised"] for r in scored.collect()})
    assert found[0] == found[1]


def test_days_are_made_once(spark, tmp_path):
    """The days come from several joins and aggregates of all readings; no later pass may make them again."""
    df, seen = planted(spark, 400), str(tmp_path)

    def noted(batches):
        for b in batches:
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(b)))
            yield b

    _, scored, _ = models.theft_classifier(df.mapInPandas(noted, df.schema), NAMES, "y", "date", ["meter_id"], trees=2, depth=2)
    assert scored.count() == 80
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 400


def test_theft_follows_its_tables(spark, monkeypatch):
    """A second call on a folder whose tables changed must not return the days scored before."""
    v = SimpleNamespace(spark=spark, folder="/nowhere/theft")
    monkeypatch.setattr(score_queries, "Views", lambda *_: v, raising=False)
    monkeypatch.setattr(reports, "THEFT_FEATURES", NAMES)
    fit = models.theft_classifier
    monkeypatch.setattr(models, "theft_classifier", lambda *a: fit(*a, trees=4, depth=3))
    for rows in (200, 300):
        monkeypatch.setattr(reports, "theft_days", lambda _, n=rows: planted(spark, n).withColumnRenamed("y", "theft_label"))
        assert score_queries.theft(v)[1].count() == rows // 5


def test_odd_tables(spark):
    df = planted(spark, 100)
    with pytest.raises(Exception, match="labels must be"):
        models.theft_classifier(df.withColumn("y", F.when(F.col("meter_id") != 3, F.col("y"))), NAMES, "y", "date", ["meter_id"], trees=2, depth=2)
    with pytest.raises(ValueError):
        models.theft_classifier(df.where("false"), NAMES, "y", "date", ["meter_id"], trees=2, depth=2)
    model, scored, _ = models.theft_classifier(df.withColumn("y", F.lit(0)), NAMES, "y", "date", ["meter_id"], trees=2, depth=2)
    assert {r["supervised"] for r in scored.collect()} == {0.0} and (model.importances() == 0).all()
