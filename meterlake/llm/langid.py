"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import by_block, sampled

#: Subwords are runs of 2, 3 and 4 bytes of words in lower case, a blank at each end.
GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
EMBED = 16
#: Labelled texts that the fit uses at most, each as a whole.
FIT_DOCS = 4000
#: Share of right answers that the accepted ones should have at least.
PRECISION = 0.98
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = ord(" ")  # signs and digits part words
_LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def subwords(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bucket of every subword of the joined texts, and the text of each, one pair of arrays per length."""
    raw = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    b = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), sizes)
    letter = b != ord(" ")
    wide = b.astype(np.uint32)
    found, owners = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ wide[k : m + k]) * np.uint32(0x01000193)
        # blanks only at the ends of a run; a text has one at each end, so no run of three or more spans two texts
        keep = np.logical_and.reduce([letter[k : m + k] for k in range(1, n - 1)]) if n > 2 else letter[:m] | letter[1 : m + 1]
        at = np.flatnonzero(keep)
        found.append(((h[at] ^ (h[at] >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    return found, owners


Bag = tuple[np.ndarray, np.ndarray]  # distinct buckets of a text and how often each stands there


def bag(text: str) -> Bag:
    """What the fit needs of a text: at most BUCKETS pairs, however long the text is."""
    found, _ = subwords([text])
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)


@dataclass
class Model:
    """``table`` is embedding times softmax weights for each bucket; ``scale`` and ``least`` calibrate and reject."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: float
    least: float


def _mean_scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean over the subwords of a text of their rows of the table; zeros without subwords."""
    out = np.zeros((len(texts), table.shape[1]))
    count = np.zeros(len(texts))
    for found, owner in zip(*subwords(texts)):
        if len(found):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[starts]] += np.add.reduceat(table[found], starts, axis=0, dtype=np.float64)
            count[owner[starts]] += np.diff(np.append(starts, len(owner)))
    return out / np.maximum(count, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[Bag, str]], epochs: int = 8, batch: int = 16, rate: float = 8.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on (bag, lang) pairs; one pair in five is kept back to calibrate.

    The softmax is scaled (one temperature, by maximum likelihood on what was kept back), and answers are accepted
    from the least calibrated probability at which PRECISION of the accepted were right.
    """
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    k = max(len(langs), 1)
    embed = rng.uniform(-1 / EMBED, 1 / EMBED, (BUCKETS, EMBED)).astype(np.float32)
    out, bias = np.zeros((EMBED, k), np.float32), np.zeros(k, np.float32)
    y = np.array([langs.index(lang) for _, lang in rows], np.int64)
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    bags = [b for (b, _), _ in rows]
    shares = [(n / max(n.sum(), 1)).astype(np.float32) for (_, n), _ in rows]
    steps, total = 0, epochs * max(1, len(train) // batch)
    for _ in range(epochs if len(langs) > 1 else 0):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            speed = rate * max(0.05, 1 - steps / total)
            steps += 1
            sizes = np.array([len(bags[i]) for i in part])
            part, sizes = part[sizes > 0], sizes[sizes > 0]
            if not len(part):
                continue
            flat, share = (np.concatenate([x[i] for i in part]) for x in (bags, shares))
            mean = np.add.reduceat(embed[flat] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            p = _softmax(mean @ out + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ out.T
            out -= 0.1 * speed * (mean.T @ p).astype(np.float32)
            bias -= 0.01 * speed * p.sum(0).astype(np.float32)
            np.subtract.at(embed, flat, (speed * np.repeat(back, sizes, axis=0) * share[:, None]).astype(np.float32))
    table = embed @ out
    scale, least = 1.0, 0.0
    if held.any() and len(langs) > 1:
        scores = np.array([shares[i] @ table[bags[i]] for i in np.flatnonzero(held)]) + bias
        truth = y[held]
        scale = float(min(np.geomspace(0.25, 16, 25), key=lambda s: -np.log(_softmax(s * scores)[np.arange(len(truth)), truth] + 1e-12).mean()))
        p = _softmax(scale * scores)
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum(p.argmax(1)[order] == truth[order]) / np.arange(1, len(truth) + 1)
        good = np.flatnonzero(right >= PRECISION)
        least = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return Model(langs, table.astype(np.float32), bias, scale, least)


def learned(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on at most ``fit_docs`` whole texts with a letter, chosen by hash among rows whose text and lang are not null.

    ``docs`` must hold only rows that may be learned from. Rows alike in id, lang and text count once. Texts become
    bags of subwords in Spark tasks; the driver gets only those. An empty table gives a model without languages.
    """
    rows = docs.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    some = sampled(rows, {True: fit_docs}, F.lit(True), "doc_id", "lang", "text").select("h", "lang", "text")

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        found = [bag(t) for t in texts]
        sides = [pa.array([b[k].astype(np.int32) for b in found], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *sides], names=["h", "lang", "buckets", "counts"])

    bags = some.mapInArrow(by_block(run), "h bigint, lang string, buckets array<int>, counts array<int>").dropDuplicates(["h"]).toArrow()
    order = np.argsort(bags.column("h").to_numpy(), kind="stable")[:fit_docs].tolist()
    both = lambda i: tuple(bags.column(c)[i].values.to_numpy() for c in ("buckets", "counts"))
    return fit([(both(i), bags.column("lang")[i].as_py()) for i in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (und if rejected), lang_pred (before rejection), score, accepted of every row, from whole texts.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned.
    score is the calibrated probability. Repeated rows each get a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        has = rows.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
        p = _softmax(m.scale * (_mean_scores(texts, m.table) + m.bias))
        best, top = p.argmax(1), np.where(has, p.max(1), 0.0)
        names = [m.langs[b] if h else UNKNOWN for b, h in zip(best, has)]
        fine = has & (top >= m.least)
        final = [n if f else UNKNOWN for n, f in zip(names, fine)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(final, pa.string()), pa.array(names, pa.string()), pa.array(top), pa.array(fine)],
            names=["doc_id", "lang", "lang_pred", "score", "accepted"],
        )

    seen = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return seen.mapInArrow(by_block(run), "doc_id bigint, lang string, lang_pred string, score double, accepted boolean")
