"""Spelling variants, hard negatives and source mixes against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import mining, mixing, queries, spelling
from tests.conftest import FOLDER
from tests.llm.conftest import ODD

LETTERS = "abcdeé"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_words(docs: list[tuple]) -> dict[str, int]:
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and distance(w, x) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_dict(df) -> dict[str, tuple]:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_edit(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("shard_words, shard_asks", [(4096, 50_000), (7, 20)])
def test_variants(spark, shard_words, shard_asks):
    rng = random.Random(5)
    words = {"".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 7))) for _ in range(500)}
    words |= {"a" * k for k in (5, 14, 15, 16, 17, 18, 40, 41, 3000, 3001)} | {"a" * 20 + "b" * k for k in range(14, 19)}
    words |= {"".join(rng.sample("abcdefghij", 10)) for _ in range(60)} | {"漢字", "漢", "", "𝒳𝒴", "𝒳"}
    words = {w: rng.choice([5, 6, 30, 150, 151, 800]) for w in sorted(words)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = plain_variants(words)
    pairs = [(r.word, r.near) for r in spelling.near_words(df, shard_words, shard_asks).collect()]
    assert len(pairs) == len(set(pairs))
    assert Counter(w for w, _ in pairs) == Counter({w: x[3] for w, x in want.items() if x[3]})
    assert as_dict(spelling.variants(df)) == want


def test_chains_of_forms(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 9}
    got = as_dict(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got == plain_variants(words)
    assert {got[w][1] for w in words if w != "zzzzzz"} == {"abbbbb"}


def test_words_of_texts(spark, make_docs):
    rng = random.Random(2)
    base = ["Wonderful", "wonderful", "ÉCOLIÈRE", "écolière", "straße×÷", "Zusammen", "Ñandúes", "abcdef", "ABCDEFG", "Ωmega", "naïveté", "_under_score", "12letters34"]
    texts = [" ".join(rng.choice(base) + rng.choice(["", ".", "-", "s"]) for _ in range(120)) for _ in range(90)] + ODD
    ids = [rng.choice([i, i, 3, None]) for i in range(len(texts))]
    df = make_docs(texts, ids, extra=True)
    want = plain_words(list(zip(ids, texts)))
    assert {r.word: r.n for r in spelling.words(df).collect()} == want
    assert any(w not in {b.lower() for b in base} for w in want)
    assert as_dict(spelling.spelling_variants(df)) == plain_variants(want)
    assert spelling.spelling_variants(make_docs([])).collect() == []


def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = as_dict(queries.QUERIES["op11_spelling_variants"](spark, FOLDER))
    words = plain_words(docs)
    assert {w: x[2] for w, x in got.items()} == words
    some = sorted(words)[::9]  # the loop over all words is slow; each of these is held against all
    for w in some:
        near = [x for x in words if abs(len(x) - len(w)) <= 1 and distance(w, x) == 1]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * words[w] else None
        assert (got[w][0], got[w][3]) == (form, len(near))


# ---- hard negatives


def plain_negatives(rows: list[tuple], is_anchor, k=5) -> set[tuple]:
    rows = list(dict.fromkeys((i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)))
    out = []
    for i, y, a in (r for r in rows if is_anchor(r[0])):
        scored = sorted((-sum(p * q for p, q in zip(a, v)), j, z) for j, z, v in rows if len(v) == len(a))
        for s, j, _ in [x for x in scored if x[2] == y and x[1] != i][:k]:
            fits = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fits[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for c in ("v", "key", "slab", "block", "n", "ids", "rows", "place", "rank", "positives"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def found(df) -> list[tuple]:
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        v = (rng.normal(size=6) + [1, 0, 0, 0, 0, 0]).astype(np.float32).round(1).tolist()  # coarse values give many ties
        rows.append((i, v, int(rng.choice([0, 0, 0, 1, 2, -1]))))
    rows += [(5000 + i, rows[0][1], 1) for i in range(400)]  # one common vector
    rows += [(9000, [1.0, 2.0], 0), (9001, [1.0, 1.5], 0), (9002, [1.0, 1.25], 1), (9003, [], 0), (9050, [], 0), (9004, None, 0), (9005, [1.0] * 6, None)]
    rows += [(9006, [float("nan")] * 6, 0), (9007, [float("inf")] + [0.0] * 5, 1), (9008, [None] + [1.0] * 5, 1), (None, [1.0] * 6, 0)]
    rows += [rows[3]] * 50 + [(100, rows[7][1], 1)]  # repeated rows, and one id with another vector
    is_anchor = lambda i: i % 50 == 0
    got = found(mining.hard_negatives(mining.prepared(vectors(spark, rows)), F.col("vec_id") % 50 == 0))
    assert got == plain_negatives(rows, is_anchor) and len(got) > 300
    assert found(mining.hard_negatives(mining.prepared(vectors(spark, rows)), F.lit(False))) == []
    assert found(mining.hard_negatives(mining.prepared(vectors(spark, [])), F.col("vec_id") % 50 == 0)) == []


@pytest.mark.parametrize("dim, leaf", [(1, 3), (4, 5), (40, 8)])
def test_tree_search(dim, leaf):
    rng = np.random.default_rng(dim)
    rows = rng.integers(-4, 5, size=(700, dim))
    ids = rng.permutation(700)
    pages = mining.tiles(rows, leaf)
    assert sorted(np.concatenate(pages).tolist()) == list(range(700)) and max(map(len, pages)) <= leaf
    held = [{"ids": ids[p].astype(np.int64).tobytes(), "rows": rows[p].astype(np.int64).tobytes(), "low": rows[p].min(axis=0).tobytes(), "high": rows[p].max(axis=0).tobytes()} for p in pages]
    trees = [mining.Tree(held[:50], dim), mining.Tree(held[50:], dim)]
    for _ in range(60):
        a = rng.integers(-4, 5, size=dim)
        scores = sorted(((int(s), int(i)) for s, i in zip(rows @ a, ids)), key=lambda x: (-x[0], x[1]))
        windows = [(None, None), (3, 9), (scores[20][0], scores[3][0]), (10**6, None)]
        want = [[x for x in scores if (lo is None or x[0] >= lo) and (hi is None or x[0] <= hi)][:5] for lo, hi in windows]
        assert mining.search(trees, a, windows, 5) == want
        assert mining.search(trees, a, windows[:1], 5, own=scores[0][1]) == [scores[1:6]]


def test_tiles_keep_neighbours_together():
    rows = np.random.default_rng(1).integers(0, 1000, size=(4096, 2))
    spans = [np.ptp(rows[p], axis=0).max() for p in mining.tiles(rows, 64)]
    assert np.median(spans) < 250  # 8 x 8 tiles of about 125


# ---- mixing


def plain_mix(rows: list[tuple], weights=(5, 2, 1), most=3) -> dict[int, tuple]:
    """By row number: (size, source_size, target, taken); levels by bisection, cuts by sorting."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    total, by = Counter(), defaultdict(Counter)
    marks = []
    for (doc_id, source, text), n in zip(rows, sizes):
        marks.append(int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:15], 16))
        total[source] += n
        by[source][marks[-1]] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    low, high = 0.0, float(sum(total.values()) * most + 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], most * total[s]) for s in order) < sum(total.values()) else (low, level)
    goal = {s: min(high * weight[s], most * total[s]) for s in order}
    out = {}
    for k, ((_, s, _), n) in enumerate(zip(rows, sizes)):
        out[k] = (n, total[s], goal[s], marks[k])
    return out, goal, by


def test_mix(spark, make_docs):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", "", None, "tiny"])
        rows.append((rng.choice([i, i, i, 7, None]), source, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60) if source != "tiny" else 1))))
    rows += [(10_000 + k, "empty", t) for k, t in enumerate([None, "", " \n\t "])] + [(20_000 + k, "a", t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("clash")).withColumn("mark", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = mixing.mix(df.repartition(5)).collect()
    want, goal, by = plain_mix(rows)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((rows[k][0], n, s) for k, (n, s, _, _) in want.items())
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source], rel=1e-9, abs=1e-6)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source, marks in by.items():
        largest = max(marks.values())
        assert abs(taken[source] - goal[source]) <= largest / 2 + 1e-6, source
    again = mixing.mix(df.repartition(11)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(make_docs([])).collect() == []
    assert [r.taken for r in mixing.mix(make_docs([None, ""])).collect()] == [0, 0]


def test_larger_targets_take_what_smaller_take(spark, make_docs):
    docs = make_docs([f"text {i} " * (i % 9 + 1) for i in range(300)], langs=None).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 2))
    some = {r.doc_id: r.copies for r in mixing.mix(docs, weights=(1, 2)).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix(docs, weights=(2, 2)).collect()}
    assert all(some[i] <= more[i] for i in some if i % 2 == 0) and sum(more.values()) > 0


def test_mix_stays_native(spark, make_docs):
    plan = mixing.mix(make_docs(["a b", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
