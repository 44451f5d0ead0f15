"""Quantile trees and their contributions against plain versions and planted cases."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.functions.kernels import leaf_boxes, path_shapley
from meterlake.functions.scaling import quantiles
from meterlake.operators import boosting


def expected(tree, x, known, node=0):
    """Value of a node if only some features are known: other splits are weighed by the rows that passed them."""
    if node >= 2**tree.depth - 1:
        return tree.value[node - (2**tree.depth - 1)]
    left, right = 2 * node + 1, 2 * node + 2
    if tree.cover[left] == tree.cover[node] or tree.feature[node] in known:
        return expected(tree, x, known, left if x[tree.feature[node]] <= tree.cut[node] else right)
    part = tree.cover[left] / tree.cover[node]
    return part * expected(tree, x, known, left) + (1 - part) * expected(tree, x, known, right)


def enumerated(tree, x, width):
    phi = np.zeros(width)
    for i in range(width):
        others = [f for f in range(width) if f != i]
        for k in range(width):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width)
                phi[i] += w * (expected(tree, x, {*s, i}) - expected(tree, x, set(s)))
    return phi


def random_tree(rng, depth, width, x):
    """As a fit makes them: a split either parts the rows of its node or sends all of them left."""
    n = 2**depth - 1
    tree = boosting.Tree(depth, rng.integers(0, width, n), rng.integers(0, 6, n), rng.normal(size=2**depth), np.zeros(2 * n + 1, np.int64))
    for d in range(depth + 1):
        np.add.at(tree.cover, 2**d - 1 + tree.nodes(x, d), 1)
        if d < depth:
            below = np.bincount(tree.nodes(x, d + 1), minlength=2 ** (d + 1)).reshape(-1, 2)
            tree.cut[2**d - 1 : 2 ** (d + 1) - 1][below.min(axis=1) == 0] = 99
    return tree


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_contributions_equal_enumeration(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 7, size=(80, 5))
    trees = [random_tree(rng, depth, 5, x) for _ in range(4)]
    boxes = [b for t in trees for b in leaf_boxes(t.feature, t.cut, t.value, t.cover, t.depth)]
    got = path_shapley(boxes, x, 5)
    for row in range(25):
        assert np.allclose(got[row], sum(enumerated(t, x[row], 5) for t in trees))
    total = sum(t.predict(x) for t in trees)
    assert np.allclose(got.sum(axis=1), total - sum(b.value * b.share for b in boxes))
    assert np.isclose(sum(b.value * b.share for b in boxes), total.mean())


def test_best_splits_equal_a_plain_search():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 30, size=(4, 3, 8))
    n[:, 1:] = n[:, :1]
    above = rng.binomial(n, 0.3)
    above[:, :, 4:] = n[:, :, 4:]
    feature, cut = boosting._best_splits(n, above, 0.9, 5)
    for node in range(4):
        best = (-1.0, -1, 8)
        for f in range(3):
            for b in range(7):
                sides = [(n[node, f, s].sum(), above[node, f, s].sum()) for s in (slice(0, b + 1), slice(b + 1, 8))]
                if min(c for c, _ in sides) < 5:
                    continue
                slopes = [(0.9 * u - 0.1 * (c - u), c) for c, u in sides]
                gain = sum(g * g / c for g, c in slopes) - sum(g for g, _ in slopes) ** 2 / sum(c for _, c in slopes)
                if round(gain, 9) > best[0] and round(gain, 9) > 0:
                    best = (round(gain, 9), f, b)
        assert (feature[node], cut[node]) == best[1:]


@pytest.fixture(scope="module")
def uneven(spark):
    """Level and spread depend on x and on a group; plain residual quantiles see neither spread."""
    rng = np.random.default_rng(6)
    x, group, noise = rng.uniform(0, 10, 3000), rng.integers(0, 3, 3000), rng.normal(size=3000)
    y = 20 + 3 * x + (0.3 + 0.8 * x) * noise * (1 + group)
    rows = [(i, float(a) if i % 49 else None, float(g), float(v), i % 5 != 0) for i, (a, g, v) in enumerate(zip(x, group, y))]
    df = spark.createDataFrame(rows, "id bigint, x double, g double, y double, is_train boolean")
    model = boosting.fit_quantiles(df.where("is_train"), ["x", "g"], "y", trees=25)
    return df, model


def losses(df, names, qs=(0.1, 0.5, 0.9)):
    return [df.agg(F.avg(boosting.pinball(F.col("y"), F.col(c), q))).first()[0] for c, q in zip(names, qs)]


def test_quantile_trees_beat_residual_quantiles(uneven):
    df, model = uneven
    names = ["p10", "p50", "p90"]
    out = model.predict(df, names).where("NOT is_train").cache()
    assert out.where("p10 > p50 OR p50 > p90 OR p10 < 0").count() == 0
    cover = out.agg(F.avg(((F.col("y") >= F.col("p10")) & (F.col("y") <= F.col("p90"))).cast("double"))).first()[0]
    assert abs(cover - 0.8) <= 0.05
    fitted = model.predict(df, names).where("is_train").withColumn("r", F.col("y") - F.col("p50"))
    pads = quantiles(fitted, ["g"], "r", {"lo": 0.1, "hi": 0.9})
    plain = out.join(pads, "g").withColumns({"l": F.col("p50") + F.col("lo"), "h": F.col("p50") + F.col("hi")})
    own, other = losses(out, names), losses(plain, ["l", "p50", "h"])
    assert own[0] < 0.97 * other[0] and own[2] < 0.97 * other[2]


def test_fits_agree_whatever_the_partitions(uneven):
    df, model = uneven
    again = boosting.fit_quantiles(df.where("is_train").repartition(7), ["x", "g"], "y", trees=3)
    for own, other in zip(model.trees, again.trees):
        for a, b in zip(own[:3], other):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)


def test_contributions_add_up(uneven):
    df, model = uneven
    out = model.contributions(model.predict(df.limit(400), ["p10", "p50", "p90"], floor=-1e9), 0.9).collect()
    plain = {r.id: r for r in out}
    assert all(abs(sum(s.shap_value for s in r.shap) - (r.raw_prediction - r.base_value)) < 1e-9 for r in out)
    assert sum(abs(r.raw_prediction - r.p90) < 1e-9 for r in out) > 390  # where sorting changed nothing
    assert all([abs(s.shap_value) for s in r.shap] == sorted((abs(s.shap_value) for s in r.shap), reverse=True) for r in out)
    assert {s.direction for r in out for s in r.shap if s.shap_value > 0} == {"increased"}
    assert np.mean([r.shap[0].feature == "x" for r in plain.values()]) > 0.5


def test_no_rows_is_an_error(uneven, spark):
    df, _ = uneven
    with pytest.raises(ValueError):
        boosting.fit_quantiles(df.where("false"), ["x"], "y")
    one = boosting.fit_quantiles(df.where("is_train").limit(3), ["x", "g"], "y", trees=2)
    assert one.predict(df.limit(2), ["a", "b", "c"]).count() == 2
