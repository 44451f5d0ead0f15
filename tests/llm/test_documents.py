"""Operators on documents: brute-force counterparts, odd rows, ties, empty tables, clashing columns."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import decontam, langid, packing, pii, quality, simhash, substring, toxicity
from meterlake.llm.common import sampled
from meterlake.llm.components import components
from tests.conftest import FOLDER
from tests.llm.conftest import ODD

BREAK = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, words: int = 3000) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


# ---------------------------------------------------------------- language


def test_language(spark, make_docs):
    rng = random.Random(1)
    kinds = {"aa": "ba da ga lama tana", "bb": "zo vu xi quoz vurx", "cc": "straße möß größer üß"}
    texts, langs = [], []
    for _ in range(300):
        lang = rng.choice(list(kinds))
        texts.append(" ".join(rng.choice(kinds[lang].split()) for _ in range(20)))
        langs.append(lang)
    model = langid.learned(make_docs(texts, langs=langs))
    rows = langid.predict(make_docs(texts + ODD, langs=langs + [None] * len(ODD), extra=True), model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(by) == len(texts) + len(ODD)
    assert np.mean([by[i].lang_pred == x for i, x in enumerate(langs)]) > 0.98
    for i, t in enumerate(ODD, len(texts)):
        assert (by[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")), t
        assert 0 <= by[i].score <= 1


def test_language_without_labels(spark, make_docs):
    empty = make_docs([])
    assert langid.predict(empty, langid.learned(empty)).count() == 0
    row = langid.predict(make_docs(["some text"]), langid.learned(empty)).first()
    assert (row.lang, row.lang_pred, row.score) == ("und", "und", 0.0)


def brute_mean(text: str, table: np.ndarray) -> np.ndarray:
    """Mean row of the table over runs of 2 to 4 bytes of a text, signs and digits as blanks, read one by one."""
    low = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode())
    rows = []
    for n in langid.GRAMS:
        for i in range(len(low) - n + 1):
            run = low[i : i + n]
            if (32 in run[1:-1]) if n > 2 else run == b"  ":
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for b in run:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            rows.append(table[(h ^ h >> 15) % langid.BUCKETS])
    return np.mean(rows, axis=0) if rows else np.zeros(table.shape[1])


def test_language_scores_by_loop():
    rng = random.Random(3)
    table = np.random.default_rng(3).normal(size=(langid.BUCKETS, 3))
    texts = ["", "a", "7", " a  b ", "it's 12,5 km", "é ñ 漢字 🙂"] + ["".join(rng.choice("abé漢Z 1.'") for _ in range(rng.randrange(60))) for _ in range(60)]
    for t, got in zip(texts, langid._mean_scores(texts, table)):
        assert np.allclose(got, brute_mean(t, table)), t
        buckets, counts = langid.bag(t)
        if len(buckets):
            assert np.allclose(counts @ table[buckets] / counts.sum(), got)


def test_language_fit_reads_whole_texts(spark, make_docs):
    filler = "1234567890 " * 300  # no letters for 3300 characters on both sides of the middle, then words at one end
    words = {"aa": "ba da ga lama tana ", "bb": "zo vu xi quoz vurx "}
    texts = [f"{filler}{filler}{words[x] * 3}" if i % 2 else f"{words[x] * 3}{filler}{filler}" for i in range(40) for x in words]
    model = langid.learned(make_docs(texts, langs=list(words) * 40))
    rows = langid.predict(make_docs(list(words.values()), langs=list(words)), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["aa", "bb"]


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs([f"text {i}" if i % 2 else "same" for i in range(4000)], ids=[i if i % 2 else 0 for i in range(4000)])
    some = sampled(docs, {True: 200, False: 50}, F.col("text") == "same", "doc_id", "text")
    kinds = {r.same: r.n for r in some.groupBy((F.col("text") == "same").alias("same")).agg(F.countDistinct("h").alias("n")).collect()}
    assert kinds[True] == 1 and 50 <= kinds[False] <= 150
    assert some.where("text != 'same'").exceptAll(sampled(docs.repartition(7), {False: 50}, F.col("text") == "same", "doc_id", "text")).count() == 0
    assert sampled(make_docs([]), {True: 5}, F.lit(True), "text").count() == 0
    for model in (langid.learned(docs, fit_docs=30), langid.learned(make_docs(["same"] * 50, ids=[1] * 50))):
        assert model.langs == ["en"]


# ---------------------------------------------------------------- quality


def brute_quality(text: str | None) -> tuple:
    t = text or ""
    words = BREAK.findall(t)
    lines = [x for x in t.split("\n") if BREAK.search(x)]
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, make_docs):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("a b c d # *".split()) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["a b c d e\n" * 3 + "x\n\n \nx", "one two three four five six one two three four five", "one two three four five one two three four five"]
    rows = quality.assess(make_docs(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.assess(make_docs([])).count() == 0
    assert quality.assess(make_docs(["a b", "a b"], ids=[1, 1])).count() == 2


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text: str | None) -> int:
    words = BREAK.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps: dict[int, int]) -> dict[int, int]:
    up = {i: i for i in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def test_simhash(spark, make_docs):
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(20):
        base = prose(rng, 300)
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    rows = simhash.classes(make_docs(texts, extra=True)).collect()
    fps = {r.doc_id: r.fp & (2**64 - 1) for r in rows}
    assert fps == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in rows} == brute_classes(fps)


def similarity(a: str | None, b: str | None) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (BREAK.findall((t or "").lower()) for t in (a, b)))
    return len(x & y) / len(x | y)


def test_keep_one_of_near_copies(spark, make_docs):
    rng = random.Random(13)
    texts: list = []
    for _ in range(40):
        base = prose(rng, rng.choice([60, 300, 1500]))
        for c in range(4):
            copy = list(base)
            for _ in range(c * len(base) // 300):  # up to one word in a hundred
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    texts += ODD
    kept = {r.doc_id for r in simhash.keep_one(make_docs(texts, extra=True)).collect()}
    first = {i for i, t in enumerate(texts) if not any(similarity(t, u) >= 0.9 for u in texts[:i])}
    assert first <= kept  # nothing goes that has no near copy before it
    assert len(kept - first) <= 6  # and of 120 near copies 95 in 100 go: the sketches of short texts are rough


def test_near_copies_at_the_threshold(spark, make_docs):
    """Pairs just above and just below a similarity of 0.8, by length: changes of one word, or of a block at the end."""
    rng = random.Random(31)
    texts, near = [], {}
    for words in (15, 30, 60, 200, 1000):
        for want in (0.62, 0.72, 0.78, 0.8, 0.83, 0.9):
            for spread in (True, False):
                for _ in range(8):
                    base = [f"{len(texts)}.{k}" for k in range(words)]
                    copy, last = list(base), list(base)
                    places = rng.sample(range(words), words) if spread else range(words - 1, -1, -1)
                    for k in places:
                        copy[k] = f"new.{k}"
                        if similarity(" ".join(base), " ".join(copy)) < want:
                            break
                        last = list(copy)
                    if last == base and want >= 0.8:
                        continue
                    used = last if want >= 0.8 else copy
                    near[len(texts)] = (words, similarity(" ".join(base), " ".join(used)))
                    texts += [" ".join(base), " ".join(used)]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(texts)).collect()}
    wrong = [i for i, (_, s) in near.items() if s < 0.8 and got[i] == got[i + 1]]
    assert not wrong
    for words in (15, 30, 60, 200, 1000):
        alike = [i for i, (n, s) in near.items() if n == words and s >= 0.8]
        assert len(alike) >= 16 and all(got[i] == got[i + 1] for i in alike), words


def test_simhash_repeated_and_missing_ids(spark, make_docs):
    df = make_docs(["a b c d e", "a b c d e", "a b c d e", "q r s t u v"], ids=[5, 5, None, None])
    rows = simhash.classes(df).collect()
    assert len(rows) == 4 and sorted(r.component_id or -1 for r in rows) == [-1, 5, 5, 5]
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(df).collect()) == [-1, -1, 5]
    assert simhash.classes(make_docs([])).count() == 0 and simhash.keep_one(make_docs([])).count() == 0


def test_near_pairs_any_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in base], np.uint64) for k in range(1, 8)])
    n = len(fps)
    for radius in (0, 3, 4, 6, 8):
        got = {(int(i), int(j)) for a, b in simhash.near_pairs(fps, np.arange(n) + 1, np.full(n, n), radius) for i, j in zip(a, b)}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_large_bucket_is_dealt_out_in_chunks(spark):
    """Fingerprints in one ball, in chunks of 40: no link is lost."""
    rng = random.Random(4)
    fps = sorted({sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(300)} | {0})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(df, chunk=40), "a", "b").collect()}
    want = brute_classes({f: f for f in fps})
    assert {f: roots.get(f, f) for f in fps} == want


def test_one_fingerprint_with_many_nodes_is_dealt_out(spark):
    """Near copies with equal fingerprints: no task gets more than two chunks of them, give or take the hashing."""
    keys = spark.range(2000).selectExpr("1L as key", "id as node", "7L as fp")
    sizes = spark.createDataFrame([(1, 2000)], "key bigint, n bigint")
    rows = simhash._dealt(keys, sizes, 100, "node").groupBy("one", "two").count().collect()
    assert len(rows) == 20 * 21 // 2 and max(r["count"] for r in rows) <= 2 * 150


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    up = {i: i for p in pairs for i in p if i is not None}
    for _ in range(len(up)):
        for a, b in pairs:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: up[i] for p in pairs for i in p if p[0] is not None and p[0] != p[1]}


# ---------------------------------------------------------------- decontamination


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination(spark, make_docs):
    rng = random.Random(6)
    item = "A train leaves Boston at 40 km per hour and meets the bus from Denver after 3 hours so how far apart are Boston and Denver"
    other = "A train leaves Berlin at 95 km per hour and meets the bus from Munich after 7 hours so how far apart are Berlin and Munich"
    mixed = "A train leaves Berlin at 95 km per hour and meets the bus from Munich after 7 hours so how far apart are Lima and Quito"
    fill = " ".join(prose(rng, 60))
    texts = [f"{fill}. {item}. {fill}", f"{fill}. {other}. {fill}", f"{fill}. {mixed} {fill}", fill, item.upper().lower(), *ODD]
    docs = make_docs(texts, extra=True)
    items = bench(spark, [(1, item), (1, item), (2, "too short"), (3, None), (None, "x"), (4, " ".join(prose(rng, 30)))])
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, items).collect()}
    assert (0, 1) in got and got[0, 1].kind == "exact"
    assert (1, 1) in got and got[1, 1].kind == "changed" and got[1, 1].n_changed == 4
    assert (2, 1) not in got or got[2, 1].share < got[1, 1].share  # one city stands for two
    assert all(d in (0, 1, 2, 4) for d, _ in got)
    left = {r.doc_id for r in decontam.clean(docs, items).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}
    assert decontam.matches(make_docs([]), items).count() == 0
    assert decontam.matches(docs, bench(spark, [])).count() == 0
    assert decontam.matches(make_docs([item, item], ids=[9, 9]), items).count() == 1


def test_short_items_and_arithmetic_inside_texts(spark, make_docs):
    rng = random.Random(16)
    a, b = " ".join(prose(rng, 40)), " ".join(prose(rng, 40))
    short = ["who wrote the old book", "name the largest moon", "What is 12 * 7 + 3 ?", "Boston beats Denver twice", "yes"]
    sums = "1 + 2 = 3 and 4 + 5 = 9 and 6 + 7 = 13 so 8 + 9 = 17"
    items = bench(spark, list(enumerate([*short, sums])))
    texts = [f"{a} {t} {b}" for t in [*short, sums]] + [f"{a} What is 13 * 7 + 3 ? {b}", f"{a} {sums.replace('1', '6')} {b}", "yes"]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(make_docs(texts), items).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 5), (8, 4)}


def test_one_item_several_times_in_a_text(spark, make_docs):
    rng = random.Random(17)
    form = "a train leaves {} at {} km per hour and meets the bus from {} after {} hours so how far apart is the depot in {} from {} miles"
    fills = [[rng.choice(["Oslo", "Rome", "Lima", "Bonn", "Kiev", "Cork"]) + rng.choice("abcdef") if k in (0, 2, 4) else rng.randrange(10, 10**6) for k in range(6)] for _ in range(61)]
    fill = [" ".join(prose(rng, 40)) for _ in range(3)]
    item = form.format(*fills[0])
    texts = [f"{fill[0]} {form.format(*x)} {fill[1]} {form.format(*y)} {fill[2]}" for x, y in zip(fills[1:31], fills[31:])]
    texts += [f"{fill[0]} {form.format(*x)} {fill[1]} {item} {fill[2]}" for x in fills[1:31]]
    got = {r.doc_id: r for r in decontam.matches(make_docs(texts), bench(spark, [(1, item)])).collect()}
    assert set(got) == set(range(60)) and all(r.share == 1 for r in got.values())
    assert all(got[i].kind == ("changed" if i < 30 else "exact") for i in got)


def test_planted_benchmark_items_are_found(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in r.text}
    assert want and want <= got and len(got - want) <= 3


# ---------------------------------------------------------------- passages


def test_passages(spark, make_docs):
    rng = random.Random(7)
    p, q = prose(rng, 80), prose(rng, 55)
    fuzzy = list(p)
    for i in (12, 40, 66):
        fuzzy[i] = "changed"
    fuzzy.insert(50, "added")
    j = lambda *parts: " ".join(w for x in parts for w in x)
    texts = [j(prose(rng, 100), p, prose(rng, 50)), j(prose(rng, 30), fuzzy, prose(rng, 90)), j(prose(rng, 5), p), j(q, prose(rng, 70), q), j(prose(rng, 40), q[:40]), *ODD]
    rows = substring.passages(make_docs(texts, extra=True)).collect()
    got = {(r.doc_id, r.other_id): r for r in rows if r.doc_id < 5}
    assert set(got) == {(1, 0), (2, 0), (3, 3)}
    assert (got[2, 0].start, got[2, 0].stop, got[2, 0].other_start, got[2, 0].identity) == (5, 85, 100, 1.0)
    assert (got[1, 0].start, got[1, 0].stop) == (30, 111) and 0.9 < got[1, 0].identity < 1
    assert (got[3, 3].start, got[3, 3].stop, got[3, 3].other_start) == (125, 180, 0)
    assert substring.passages(make_docs([])).count() == 0
    assert substring.passages(make_docs([texts[0], texts[0]], ids=[1, 1])).where("doc_id != other_id").count() == 0


@pytest.mark.parametrize("size, equal, least", [(60, 0.9, 0.95), (100, 0.87, 0.95), (100, 0.8, 0.85), (200, 0.8, 0.95)])
def test_recall_of_fuzzy_passages(spark, make_docs, size, equal, least):
    """Planted pairs with words replaced at random places; each is held against the places where it was planted."""
    rng = random.Random(size)
    word = lambda: f"w{rng.getrandbits(40)}"
    texts, pairs = [], 60
    for _ in range(pairs):
        p = [word() for _ in range(size)]
        q = list(p)
        for i in rng.sample(range(2, size - 2), round((1 - equal) * size)):
            q[i] = word()
        texts += [" ".join([word() for _ in range(40)] + x + [word() for _ in range(30)]) for x in (p, q)]
    found = 0
    for r in substring.passages(make_docs(texts)).collect():
        assert r.doc_id == r.other_id + 1 and r.other_id % 2 == 0  # nothing but what was planted
        own, other = (len(set(range(a, b)) & set(range(40, 40 + size))) for a, b in ((r.start, r.stop), (r.other_start, r.other_stop)))
        found += min(own, other) >= 0.8 * size
    assert found >= least * pairs


def test_common_runs_of_fifty_words_are_covered(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen: dict[tuple, list[tuple[int, int]]] = {}
    for r in docs.collect():
        words = r.text.lower().split()
        for i in range(len(words) - 49):
            seen.setdefault(tuple(words[i : i + 50]), []).append((r.doc_id, i))
    covered: dict[int, set[int]] = {}
    for r in substring.passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        covered.setdefault(r.other_id, set()).update(range(r.other_start, r.other_stop))
    shared = [places for places in seen.values() if len(places) > 1]
    assert shared
    missed = {d for places in shared for d, i in places if not covered.get(d, set()) >= set(range(i + 5, i + 45))}
    assert not missed


# ---------------------------------------------------------------- toxicity


def test_marginals_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    length, step = np.array([5, 2, 1]), rng.normal(0, 1, (2, 2))
    inside = np.arange(5) < length[:, None]
    unary = np.where(inside, rng.normal(0, 2, (3, 5)), 0)
    _, one, _ = toxicity.marginals(unary, length, step)
    quick = toxicity.Tagger(toxicity.Model({}, step, np.zeros(4)))._chain(unary, length)
    assert np.allclose(one[inside], quick[inside])
    for r, n in enumerate(length):
        total, sums = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            p = np.exp(sum(unary[r, k] * y[k] for k in range(n)) + sum(step[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            sums += p * np.array(y)
        assert np.allclose(sums / total, one[r, :n])


@pytest.fixture(scope="module")
def toxic_sample():
    rng = random.Random(8)
    texts, y = [], []
    for i in range(600):
        words = prose(rng, 40, 400)
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["idiot", "scum.", "Moron,", "vilexa", "vilexob"])
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    return texts, y


def test_toxicity(spark, make_docs, toxic_sample):
    texts, y = toxic_sample
    labels = spark.createDataFrame([(i, None, v) for i, v in enumerate(y) if i < 400] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = make_docs(texts + ODD, extra=True)
    model = toxicity.learned(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert np.mean([(rows[i].score >= 0.7) == bool(y[i]) for i in range(400, 600)]) > 0.97
    for i in range(400, 600):
        for s in rows[i].spans:
            assert y[i] and any(w in texts[i][s.start : s.stop].lower() for w in ("idiot", "scum", "moron", "vilex"))
    assert all(0 <= rows[len(texts) + k].score < 0.7 for k in range(len(ODD)))
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.score < 0.7}


def test_toxic_words_late_in_long_texts(spark, make_docs):
    rng = random.Random(18)
    texts = []
    for i in range(240):
        words = prose(rng, 1000, 400)  # about 4700 characters
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(850, 1000)] = rng.choice(["idiot", "scum.", "Moron,"])
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, quality int, toxic int")
    docs = make_docs(texts)
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.learned(docs, labels)).collect()}
    assert all((rows[i].score >= 0.7) == (i % 4 == 0) for i in range(160, 240))


def test_toxicity_without_labels(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.learned(make_docs(["a b"]), empty)
    assert all(r.score < 0.7 for r in toxicity.score(make_docs(["a b", None]), model).collect())
    assert toxicity.score(make_docs([]), model).count() == 0


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t: str) -> list:
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab@@..1234567890+-() ,é") for _ in range(80)) for _ in range(5000)]
    for t in texts + ["4111 1111 1111 1111", "a@b.c@d.e@f.gh", "@d.e@f.g", "1.2.3.4.5.6.7.8", "300.1.1.1"]:
        assert pii.base_spans(t) == brute_spans(t), t


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in pii._start(rng).p.items()}
    ids, tags = rng.integers(0, pii.CLASSES, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, g = pii.loss(p, ids, tags)
    for k, v in p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        v[at] += 1e-4
        up = pii.loss(p, ids, tags)[0]
        v[at] -= 2e-4
        down = pii.loss(p, ids, tags)[0]
        v[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-4, k


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.learned(spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 2 = 0"))


def test_network_accuracy(spark, pii_model):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 2 = 1").collect()]
    ids, tags = pii.labelled(texts, 400, seed=77)
    best = pii.decode(pii_model, ids)
    assert (best == tags).mean() > 0.93 and (best == tags)[tags > 0].mean() > 0.8


def test_personal_data(spark, make_docs, pii_model):
    texts = ["write to jo.doe@mail.example.com now", "call +1 (826) 555-4081 190.137.223.204 today", "nothing here", "long " * 500 + "x@y.org", *ODD]
    docs = make_docs(texts, extra=True)
    rows = {r.doc_id: r for r in pii.find(docs, pii_model).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.stop, s.kind) for s in rows[i].base] == brute_spans(t or "")
        assert {(s.start, s.stop, s.kind) for s in rows[i].base} <= {(s.start, s.stop, s.kind) for s in rows[i].spans}
    assert rows[2].spans == []
    masked = {r.doc_id: r for r in pii.redact(docs, pii_model).collect()}
    assert masked[0].text == "write to <EMAIL> now" and masked[0].n_chars == 20
    assert masked[3].text.endswith("<EMAIL>") and masked[4].text is None and masked[2].text == texts[2]
    assert pii.find(make_docs([]), pii_model).count() == 0
    assert pii.find(make_docs(["a@b.cd"] * 2, ids=[None, None]), pii_model).count() == 2


def test_added_spans(spark, pii_model):
    """Every kind written in ways of four countries, put into held-out texts: found whole at least 85 times in 100 from 150 texts."""
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 2 = 1 and length(text) > 200").collect()]
    rng = np.random.default_rng(99)
    hit = {k: [] for k in range(4)}
    for i in range(600):
        t, k = texts[i % len(texts)], i % 4
        made, at = pii._made(rng, k), max(0, t.rfind(" ", 0, int(rng.integers(60, len(t)))))
        found = pii.all_spans([f"{t[:at]} {made} {t[at:]}"], pii_model)[0][1]
        hit[k].append(any((a, b) == (at + 1, at + 1 + len(made)) for a, b, _ in found))
    assert min(np.mean(x) for x in hit.values()) >= 0.85, {k: np.mean(x) for k, x in hit.items()}
    added = [s for t, (base, every) in zip(texts, pii.all_spans(texts, pii_model)) for s in every if s not in base]
    assert len(added) <= len(texts) // 50


def test_runs_are_decoded_to_their_ends(spark, pii_model):
    """Tagged runs over several windows are those of decoding every window of the text."""
    rng = random.Random(4)
    parts = ["word", "a.b", "name @ department.long-subdomain.example.org", "x" * 60 + "@y.de", "06 12 34 56 78", "-" * 70]
    texts = [" ".join(rng.choice(parts) for _ in range(30)) for _ in range(20)]
    for t, got in zip(texts, pii.network_spans(texts, pii_model)):
        c = np.array([ord(x) for x in t])
        tags = np.zeros(len(t), int)
        for g in range(-(-len(t) // pii.STEP)):
            ids = np.full((1, pii.WIDTH), pii.PAD, np.int16)
            a = g * pii.STEP - pii.MARGIN
            part = c[max(a, 0) : a + pii.WIDTH]
            ids[0, max(-a, 0) : max(-a, 0) + len(part)] = pii.classes(part)
            own = tags[g * pii.STEP : (g + 1) * pii.STEP]
            own[:] = pii.decode(pii_model, ids)[0, pii.MARGIN : pii.MARGIN + pii.STEP][: len(own)]
        assert got == pii.tag_runs(t, tags), t


def test_personal_data_fit_on_odd_tables(spark, make_docs):
    for docs in (make_docs([]), make_docs(ODD[:5]), make_docs(["the same text with 1 digit in it"] * 40, ids=[None] * 40)):
        assert pii.learned(docs, windows=256).p["embed"].shape[0] == pii.CLASSES


# ---------------------------------------------------------------- packing


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        points = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 30))))
        cost = rng.integers(0, 9, 31)
        best = [0] + [10**9] * 30
        for j in range(1, 31):
            best[j] = min(best[i] + 16 - (points[j] - points[i]) + cost[j] for i in range(j) if points[j] - points[i] <= 16)
        chosen = [0, *packing.cuts(points, cost, 16)]
        assert sum(16 - (points[b] - points[a]) + cost[b] for a, b in zip(chosen, chosen[1:])) == best[30]


def test_packing(spark, make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    texts = ODD + ["<|endoftext|> hello", "a<|endoftext|><|endoftext|>b <|endoftext|", "<|endoftext|>"] + [" ".join(prose(rng, rng.randrange(1, 700))) + rng.choice([".", "\n", " <|endoftext|> "]) for _ in range(60)]
    rows = packing.pack(make_docs(texts, extra=True), with_ids=True).collect()
    pieces: dict[int, list] = {}
    windows: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        at = 0
        for r in own:
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
    for part in windows.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(make_docs([])).count() == 0
    assert packing.pack(make_docs(["a", "a"], ids=[None, None])).count() == 2
