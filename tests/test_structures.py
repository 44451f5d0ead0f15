"""Hash trees, descent, merged sketches and payloads on small planted cases."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import hierarchy, merkle, sketches
from meterlake.sources import payloads

LOG = "key string, position bigint, payload string"


def log(spark, sizes: dict):
    return spark.createDataFrame([(k, i + 1, f"{k}-{i}") for k, n in sizes.items() for i in range(n)], LOG)


def plain_root(payload_list):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [h("leaf:" + p) for p in payload_list]
    while len(level) > 1:
        level = [h(f"node:{len(level[i : i + 16])}:" + "".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0]


SIZES = {"a": 1, "b": 16, "c": 17, "d": 300, None: 40}


def test_roots(spark):
    df = log(spark, SIZES)
    got = {r.key: (r.hash, r.leaves) for r in merkle.roots(merkle.tree(df.repartition(5), ["key"], "position", "payload"), ["key"]).collect()}
    assert got == {k: (plain_root([f"{k}-{i}" for i in range(n)]), n) for k, n in SIZES.items()}
    assert merkle.tree(df.where("false"), ["key"], "position", "payload").count() == 0


def changed(rows, key, edit):
    own = [p for k, _, p in rows if k == key]
    edit(own)
    return [r for r in rows if r[0] != key] + [(key, i + 1, p) for i, p in enumerate(own)]


@pytest.mark.parametrize(
    "key, edit, kind, first",
    [
        ("d", lambda x: x.pop(), "entries removed", 300),
        ("d", lambda x: x.pop(0), "entries removed", 1),
        ("d", lambda x: x.__delitem__(slice(160, 176)), "entries removed", 161),
        ("c", lambda x: x.insert(8, "new"), "entries added", 9),
        ("b", lambda x: x.append("new"), "entries added", 17),
        (None, lambda x: x.__setitem__(20, "other"), "entries changed", 21),
        ("b", lambda x: x.reverse(), "entries changed", 1),
        ("a", lambda x: x.clear(), "chain removed", 1),
        ("e", lambda x: x.append("new"), "chain added", 1),
    ],
)
def test_every_change_shows(spark, key, edit, kind, first):
    rows = [tuple(r) for r in log(spark, SIZES).collect()]
    kept = merkle.tree(log(spark, SIZES), ["key"], "position", "payload")
    now = spark.createDataFrame(changed(rows, key, edit), LOG)
    nodes = merkle.tree(now, ["key"], "position", "payload", merkle.height(kept))
    assert [(r.key, r.kind, r.first_position) for r in merkle.differences(kept, nodes, ["key"]).collect()] == [(key, kind, first)]


def test_proofs(spark):
    df = log(spark, SIZES)
    nodes = merkle.tree(df, ["key"], "position", "payload")
    top = {r.key: r.hash for r in nodes.where(F.col("level") == merkle.height(nodes)).collect()}
    asked = merkle.proofs(nodes, df, ["key"], "position").cache()
    assert asked.count() == sum(SIZES.values())
    root = F.coalesce(*[F.when(F.col("key").eqNullSafe(F.lit(k)), F.lit(h)) for k, h in top.items()])
    ok = lambda p, i: asked.where(~merkle.proved(p, i, F.col("proof"), root)).count()
    assert ok(F.col("payload"), F.col("position")) == 0
    assert ok(F.concat("payload", F.lit("x")), F.col("position")) == sum(SIZES.values())
    assert asked.where("key = 'd'").where(merkle.proved(F.col("payload"), F.col("position") + 1, F.col("proof"), root)).count() == 0
    alone = log(spark, {"z": 1})
    one = merkle.tree(alone, ["key"], "position", "payload")
    assert merkle.proofs(one, alone, ["key"], "position").select(merkle.proved(F.col("payload"), F.col("position"), F.col("proof"), F.lit(plain_root(["z-0"])))).first()[0]


def plain_ancestors(links):
    up = {}
    for a, b in links:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = {}
    for a in up:
        level, steps = {a}, 0
        while level:
            steps += 1
            level = {c for b in level for c in up.get(b, ())} - {c for (x, c) in out if x == a}
            out.update({(a, c): steps for c in level})
    return out


def test_ancestors_with_cycles(spark):
    rng = random.Random(1)
    links = [(f"d{i}", f"d{i - 1}") for i in range(1, 7)] + [(f"x{i}", f"d{rng.randrange(7)}") for i in range(30)]
    links += [("p", "q"), ("q", "r"), ("r", "p"), ("under", "p"), ("lower", "under"), ("self", "self"), (None, "d0"), ("d0", None), ("d1", "d0")]
    df = spark.createDataFrame(links, "node string, parent string")
    got = {(r.node, r.ancestor): r.steps for r in hierarchy.ancestors(df).collect()}
    assert got == plain_ancestors(links)
    facts = spark.createDataFrame([(f"x{i}", 1.0) for i in range(30)], "node string, v double")
    rows = {r.node: r for r in hierarchy.sums_below(df, facts, {"v": F.sum("v")}).collect()}
    assert rows["d0"].depth == 0 and rows["d0"].v == 30 and rows["d0"].descendants == 36 and not rows["d0"].on_cycle
    assert rows["p"].on_cycle and rows["p"].depth is None and rows["p"].descendants == 4
    assert rows["under"].depth is None and not rows["under"].on_cycle
    assert hierarchy.ancestors(df.where("false")).count() == 0


def test_long_chain_takes_few_rounds(spark):
    df = spark.createDataFrame([(i, i - 1) for i in range(1, 60)], "node bigint, parent bigint")
    assert hierarchy.ancestors(df).where("node = 59").count() == 59


def test_merged_sketches_equal_one_sketch(spark):
    rows = spark.range(0, 40_000).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3001).alias("m"), F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100.0).alias("x")
    )
    days = sketches.daily_sketches(rows, [], "ts", "m", "x")
    out = sketches.merged(days, []).select("rows", sketches.distinct_items().alias("n"), *[sketches.value_at(q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)], sketches.share_below(F.lit(250.0)).alias("s")).first()
    assert out.rows == 40_000 and abs(out.n - 3001) <= sketches.COUNT_ERROR * 3001
    for q, v in ((0.1, out.q10), (0.5, out.q50), (0.9, out.q90)):
        exact = rows.where("x IS NOT NULL").agg(F.avg((F.col("x") <= v).cast("double"))).first()[0]
        assert abs(exact - q) <= sketches.RANK_ERROR
    assert abs(out.s - 0.25) <= sketches.RANK_ERROR


def test_payloads(spark):
    texts = [
        None, "", "{", "[1]", "3", '{"type":"Feature"}', '{"type":"Feature","geometry":null}', '{"type":"Point","coordinates":[1,2]}',
        '{"type":"Feature","properties":{"a":1,"b":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1.5,0],[0,0]],[]]}}', '{"type":"Polygon","coordinates":[[1,2]]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.f for r in df.select("id", payloads.feature(F.col("text")).alias("f")).collect()}
    assert [got[i] for i in range(5)] == [None] * 5
    assert got[5].kind is None and got[6].rings is None and got[7].rings == [[[1.0, 2.0]]]
    assert got[8].kind == "Polygon" and got[8].rings == [[[0, 0], [1.5, 0], [0, 0]], []] and got[8].properties == {"a": "1", "b": "x"}
    assert got[9].kind == "Polygon" and got[9].rings == [[]]
    assert payloads.positions(df, "text", ["id"]).groupBy("id").count().orderBy("id").collect() == [(7, 1), (8, 3)]
    whole = {"forecasting": {"status": "trained", "train_rows": 5, "mape": 0.1, "features": ["a"]}, "anomaly_detection": {"feature_importance": [{"feature": "f"}]}}
    rows = spark.createDataFrame([(json.dumps(whole),), ("{}",), ("no",), (None,)], "text string")
    first, *others = payloads.training_summary(rows, "text").collect()
    assert (first.forecast_status, first.anomaly_status, first.train_rows, first.features, first.best_feature) == ("trained", payloads.NOT_TRAINED, 5, 1, "f")
    assert all(r.forecast_status == payloads.NOT_TRAINED and r.mape is None and r.features == 0 for r in others)


def test_stored_order_changes_no_node(spark):
    """Logs in order, backwards and in pieces have the same nodes and proofs; leaves of a stored log are not shuffled."""
    sizes = {"a": 700, "b": 16, None: 33}
    rows = [tuple(r) for r in log(spark, sizes).collect()]
    seen = set()
    for order, parts in ((rows, 1), (rows[::-1], 1), (rows, 7)):
        df = spark.createDataFrame(order, LOG).coalesce(1) if parts == 1 else spark.createDataFrame(order, LOG).repartition(parts)
        nodes = merkle.tree(df, ["key"], "position", "payload")
        asked = merkle.proofs(nodes, df.where("position % 5 = 1"), ["key"], "position")
        proofs = tuple(sorted((str(r.key), r.position, tuple((s.level, tuple(s.hashes)) for s in r.proof)) for r in asked.collect()))
        seen.add((tuple(sorted((str(r.key), r.level, r.idx, r.hash, r.leaves) for r in nodes.collect())), proofs))
    assert len(seen) == 1
    levels = {}
    for _, level, idx, h, _ in [x for x in next(iter(seen))[0] if x[0] == "a"]:
        levels.setdefault(level, {})[idx] = h
    for key, position, proof in next(iter(seen))[1]:
        if key == "a":
            for level, hashes in proof:
                up = (position - 1) // 16 ** (level + 1)
                assert hashes == tuple(levels[level][i] for i in range(16 * up, 16 * up + 16) if i in levels[level])
            assert [level for level, _ in proof] == [0, 1, 2]


def test_few_leaves_of_an_ordered_log_are_dealt_out(spark):
    df = spark.range(1, 20_001, numPartitions=2).select(F.lit("k").alias("key"), F.col("id").alias("position"), F.col("id").cast("string").alias("payload"))
    leaves = df.select("key", (F.col("position") - 1).alias("idx"), F.unhex(merkle.leaf_hash(F.col("payload"))).alias("hash"))
    assert merkle._pieces(leaves, ["key"], True).where("not whole").count() <= 8
