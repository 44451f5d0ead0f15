"""Toxic spans by a linear-chain conditional random field, summed up to a score per document."""

from __future__ import annotations

import math
import re
import string
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import by_block, hashed_order
from meterlake.sources.storage import settle

#: Labelled documents that the fit uses at most (half of them toxic), each as a whole.
FIT_DOCS = 4000
#: Longest chain in tokens; a longer sentence is cut into several.
CHAIN = 64
THRESHOLD = 0.7
#: A span is reported where the marginal of its tokens reaches this.
SPAN = 0.5
#: Tokens remembered per Python worker.
MEMO = 200_000

#: Symbols that are not part of a word at its ends.
_SYMBOLS = string.punctuation + "«»“”„‘’…–—¿¡"
_TOKEN = re.compile(r"\S+")


def core(token: str) -> str:
    """A token in lower case without symbols at its ends."""
    return token.lower().strip(_SYMBOLS)


def _features(word: str) -> list[str]:
    """The whole word and its beginnings of 3 to 7 characters, for inflected and compound words.

    A seventh feature, the empty one, belongs to every token.
    """
    return ["=" + word, *(word[:k] for k in range(3, min(len(word), 7) + 1))]


@dataclass
class Model:
    """unary: feature weights of label 1 against 0; step[a, b]: from label a to b; out: document weights."""

    unary: dict[str, float]
    step: np.ndarray
    out: np.ndarray


def marginals(unary: np.ndarray, length: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for chains in rows (padded): log partition, P(label 1), P(label a, next label b).

    Label 0 has unary score 0. Everything is in log space; chains are masked beyond their length.
    """
    n, t = unary.shape
    lse = np.logaddexp
    alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    alpha[0, :, 1] = unary[:, 0]
    for k in range(1, t):
        on = (k < length)[:, None]
        new = np.stack([lse(alpha[k - 1, :, 0] + step[0, b], alpha[k - 1, :, 1] + step[1, b]) for b in (0, 1)], 1)
        new[:, 1] += unary[:, k]
        alpha[k] = np.where(on, new, alpha[k - 1])
    for k in range(t - 2, -1, -1):
        on = (k + 1 < length)[:, None]
        new = np.stack([lse(step[a, 0] + beta[k + 1, :, 0], step[a, 1] + unary[:, k + 1] + beta[k + 1, :, 1]) for a in (0, 1)], 1)
        beta[k] = np.where(on, new, 0.0)
    z = lse(alpha[-1, :, 0], alpha[-1, :, 1])
    one = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z, 0.0)).T
    pair = np.zeros((n, max(t - 1, 0), 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            score = alpha[:-1, :, a] + step[a, b] + beta[1:, :, b] + (unary.T[1:] if b else 0.0) - z
            pair[:, :, a, b] = np.exp(np.minimum(score, 0.0)).T
    inside = np.arange(t) < length[:, None]
    pair *= inside[:, 1:, None, None]
    return z, one * inside, pair


def chains(tokens: list[str]) -> list[int]:
    """Start of every chain: after a token that ends a sentence, or after CHAIN tokens."""
    starts, last = [], 0
    for i, t in enumerate(tokens):
        if t[-1] in ".!?" or i + 1 - last == CHAIN:
            starts.append(last)
            last = i + 1
    if last < len(tokens):
        starts.append(last)
    return starts


def _marks(docs: list[tuple[list[str], int]]) -> tuple[set[str], set[str]]:
    """Features that mark label 1 in the fitted sample; and the features of the field: marks and frequent words.

    Texts with a feature are counted by the distinct neighbours of its first place, so copies of a text count once.
    A mark must be more frequent in toxic texts than chance allows among so many features. A beginning is dropped
    where one longer feature accounts for nearly all of it with fewer clean texts.
    """
    seen: Counter[str] = Counter()
    cores = {t: core(t) for t in {t for tokens, _ in docs for t in tokens}}
    for tokens, y in docs:
        if y:
            seen.update({f for w in {cores[t] for t in tokens} for f in _features(w)})
    known = {f for f, n in seen.items() if n >= 3}
    tested = max(len(seen), 1)
    del seen
    of = {w: [f for f in _features(w) if f in known] for w in set(cores.values())}
    index = {f: i for i, f in enumerate(sorted(known))}
    around = (array("Q"), array("Q"))  # feature and neighbours in one number: 8 bytes a place
    weight = [set(), set()]
    for tokens, y in docs:
        words = [cores[t] for t in tokens]
        weight[y].add(zlib.crc32(" ".join(words[:20]).encode()))
        done: set[str] = set()
        met: set[str] = set()
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            if w not in met:
                met.add(w)
                if new := [f for f in of[w] if f not in done]:
                    place = zlib.crc32(f"{before} {after}".encode())
                    done.update(new)
                    for f in new:
                        around[y].append(index[f] << 32 | place)
    counts = [np.bincount((np.unique(np.frombuffer(x, np.uint64)) >> np.uint64(32)).astype(np.int64), minlength=len(index)).tolist() for x in around]
    toxic, clean = ({f: n for f, n in zip(index, c) if n} for c in (counts[1], counts[0]))
    share = len(weight[1]) / max(1, len(weight[0]) + len(weight[1]))
    bar = math.log(tested) + 4.6  # one false mark in a hundred fits
    marks = set()
    for f, t in toxic.items():
        n = t + clean.get(f, 0)
        p = t / n
        if 0 < share < 1 and p > max(0.9, share):
            gain = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
            if t >= 3 and n * gain >= bar:
                marks.add(f)
    longer = set()
    for f in marks:
        word = f.removeprefix("=")
        for k in range(3, len(word) + f.startswith("=")):
            if toxic[f] >= 0.9 * toxic.get(word[:k], 1e9) and clean.get(f, 0) < clean.get(word[:k], 0):
                longer.add(word[:k])
    marks -= longer
    return marks, marks | {f for f in known if f[0] == "="}


def fit(rows: list[tuple[str, int]], epochs: int = 15, rate: float = 0.3, seed: int = 3) -> Model:
    """A tagger from (text, toxic 0/1) pairs, without document weights. Tokens are labelled from the documents: those of a
    toxic text that have a mark. Without any mark the unary weights stay 0.
    """
    once: dict[str, str] = {}  # equal tokens are one object, as whole texts must fit the driver
    docs = [([once.setdefault(w, w) for w in t.split()], int(y)) for t, y in rows]
    del once
    marks, known = _marks(docs)
    rng = np.random.default_rng(seed)
    hot, cold = [], []
    marked = {t for tokens, y in docs if y for t in tokens if not marks.isdisjoint(_features(core(t)))}
    for tokens, y in docs:
        starts = [*chains(tokens), len(tokens)]
        for a, b in zip(starts, starts[1:]):
            labels = [int(y and t in marked) for t in tokens[a:b]]
            (hot if any(labels) else cold).append((tokens[a:b], labels))
    cold = [cold[i] for i in rng.permutation(len(cold))[: max(2000, 3 * len(hot))]]
    sample = [(hot + cold)[i] for i in rng.permutation(len(hot) + len(cold))]
    place = {"": 1} | {f: i + 2 for i, f in enumerate(sorted(known))}  # 0: none
    ids: dict[str, list[int]] = {}
    for t in {t for tokens, _ in sample for t in tokens}:
        own = [place.get(f, 0) for f in ["", *_features(core(t))]]
        ids[t] = own + [0] * (7 - len(own))
    unary, step = np.zeros(len(place) + 1), np.zeros((2, 2))
    g_unary, g_step = np.full(len(unary), 1e-6), np.full((2, 2), 1e-6)
    batches = []
    for i in range(0, len(sample) if marks else 0, 256):
        part = sample[i : i + 256]
        length = np.array([len(x) for x, _ in part])
        feats = np.zeros((len(part), int(length.max()), 7), np.int32)
        want = np.zeros(feats.shape[:2])
        for r, (tokens, labels) in enumerate(part):
            feats[r, : len(tokens)] = [ids[t] for t in tokens]
            want[r, : len(labels)] = labels
        batches.append((feats, want, length))
    for _ in range(epochs):
        for feats, want, length in batches:
            inside = np.arange(want.shape[1]) < length[:, None]
            _, one, pair = marginals(unary[feats].sum(2), length, step)
            error = (one - want) * inside
            grad = np.bincount(feats.ravel(), np.repeat(error.ravel(), 7), len(unary)) / len(length) + 1e-4 * unary
            grad[0] = 0
            a, b, on = want[:, :-1], want[:, 1:], inside[:, 1:]
            seen = np.array([[((1 - a) * (1 - b) * on).sum(), ((1 - a) * b * on).sum()], [(a * (1 - b) * on).sum(), (a * b * on).sum()]])
            grad_step = (pair.sum((0, 1)) - seen) / len(length)
            g_unary += grad**2
            g_step += grad_step**2
            unary -= rate * grad / np.sqrt(g_unary)
            step -= rate * grad_step / np.sqrt(g_step)
    return Model({f: float(unary[i]) for f, i in place.items() if abs(unary[i]) > 1e-3}, step, np.zeros(4))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; with no rows the weights give a low score."""
    w = np.zeros(x.shape[1])
    if not len(x):
        w[0] = -3.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + ridge * w), -3, 3)
    return w


def summary(m: np.ndarray) -> list[float]:
    """Of the token marginals of a document: largest, log of their sum, share."""
    m = np.where(m >= 0.3, m, 0.0)  # else the many small ones of a long text would add up
    return [float(m.max()), float(np.log1p(m.sum())), float(m.mean())] if len(m) else [0.0, 0.0, 0.0]


class _Memo(dict):
    """Unary score of a token, plus ENDS where the token ends a sentence."""

    ENDS = 1000.0

    def __init__(self, unary: dict[str, float]):
        super().__init__()
        self.weight = unary.get
        self.common = unary.get("", 0.0)
        self.starts = {f[:3] for f in unary if f[:1] not in ("", "=")}

    def __missing__(self, token: str) -> float:
        word = core(token)
        got = self.common + self.weight("=" + word, 0.0)
        if word[:3] in self.starts:
            got += sum(self.weight(word[:k], 0.0) for k in range(3, min(len(word), 7) + 1))
        got = min(100.0, max(-100.0, got)) + self.ENDS * (token[-1] in ".!?")
        if len(self) < MEMO:
            self[token] = got
        return got


class Tagger:
    """Marginals of whole token lists, many documents at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = _Memo(model.unary)

    def tag(self, docs: list[list[str]]) -> list[np.ndarray]:
        flat = [t for d in docs for t in d]
        scores = np.fromiter(map(self.memo.__getitem__, flat), float, len(flat))
        ends = scores > _Memo.ENDS / 2
        scores[ends] -= _Memo.ENDS
        sizes = np.array([len(d) for d in docs], np.int64)
        first = np.cumsum(sizes) - sizes
        cut = np.zeros(len(flat) + 1, bool)
        cut[1:][ends] = True
        cut[first[sizes > 0]] = True
        starts = np.flatnonzero(cut[:-1])
        length = np.diff(np.append(starts, len(flat)))
        if len(length) and length.max() > CHAIN:  # as chains() cuts them
            pieces = -(-length // CHAIN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, length = np.repeat(starts, pieces) + nth * CHAIN, np.minimum(np.repeat(length, pieces) - nth * CHAIN, CHAIN)
        out = np.zeros(len(flat))
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            width = int(length[part].max())
            at = starts[part][:, None] + np.arange(width)
            inside = np.arange(width) < length[part][:, None]
            at = np.where(inside, at, 0)
            out[at[inside]] = self._chain(np.where(inside, scores[at], 0.0), length[part])[inside]
        return np.split(out, np.cumsum(sizes)[:-1]) if len(docs) else []

    def _chain(self, unary: np.ndarray, length: np.ndarray) -> np.ndarray:
        """P(label 1) as in marginals(), from the log odds alone: two running ratios instead of four sums."""
        s = self.model.step
        n, t = unary.shape
        u = np.ascontiguousarray(unary.T)
        fore, back = np.empty((t, n)), np.zeros((t, n))
        fore[0] = u[0]

        def passed(r: np.ndarray, m: np.ndarray) -> np.ndarray:
            e = np.exp(np.clip(r, -40, 40))
            return np.log((m[0, 1] + e * m[1, 1]) / (m[0, 0] + e * m[1, 0]))

        m = np.exp(s - s.max())
        for k in range(1, t):
            fore[k] = passed(fore[k - 1], m) + u[k]
        for k in range(t - 2, -1, -1):
            back[k] = np.where(k + 1 < length, passed(back[k + 1] + u[k + 1], m.T), 0.0)
        return (1 / (1 + np.exp(-np.clip(fore + back, -40, 40)))).T

    def score(self, marks: list[np.ndarray]) -> np.ndarray:
        x = np.array([[1.0, *summary(m)] for m in marks]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.model.out, -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on a sample of labelled rows, bounded by rows only: at most ``fit_docs``, each text as a whole.

    ``labels`` must hold only rows that may be learned from. Rows are taken in a fixed hash order, toxic ones first
    up to a half. Null ids and labels are left out; an id with several labels counts as toxic if one says so. The
    sample is tagged in Spark tasks, which return three numbers for each text to the fit of the document weights.
    """
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    y = y.select(F.col("doc_id").alias("id"), "y", hashed_order("doc_id").alias("h"))
    some = y.where("y = 1").orderBy("h", "id").limit(fit_docs // 2).unionByName(y.where("y = 0").orderBy("h", "id").limit(fit_docs // 2))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = settle(texts.join(some, "id").select(F.col("y").cast("double").alias("y"), "text", "h", "id"), "toxicity-sample")
    rows = sample.collect()
    model = fit([(r.text, int(r.y)) for r in sorted(rows, key=lambda r: (r.h, r.id, r.text))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        found = np.array([summary(m) for m in Tagger(shared.value).tag([t.split() for t in texts])]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c.copy()) for c in found.T)], names=["y", "most", "total", "mean"])

    found = sample.mapInArrow(by_block(run), "y double, most double, total double, mean double").collect()
    found = np.array(sorted(map(tuple, found)), float).reshape(-1, 4)
    model.out = _logistic(np.hstack([np.ones((len(found), 1)), found[:, 1:]]), found[:, 0])
    return model


_TAGGERS: dict[int, Tagger] = {}


def tagger(model: Model) -> Tagger:
    """One per Python worker and model, so that its memo serves several tasks."""
    key = hash((tuple(model.unary.items()), model.out.tobytes()))
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(model)
    return _TAGGERS[key]


def spans(text: str, marks: np.ndarray, least: float = SPAN) -> list[tuple[int, int]]:
    """Code-point ranges of neighbouring tokens whose marginal reaches ``least``."""
    out: list[tuple[int, int]] = []
    if len(marks) and marks.max() >= least:
        before = -2
        for k, m in enumerate(_TOKEN.finditer(text)):
            if marks[k] >= least:
                if k == before + 1:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append(m.span())
                before = k
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), spans (array of start and end in code points) of every row, from whole texts.

    Null and empty texts get the base rate of texts without toxic tokens. Repeated rows each get a row; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        own = tagger(shared.value)
        marks = own.tag([t.split() for t in texts])
        found = [[{"start": a, "stop": b} for a, b in spans(t, m)] for t, m in zip(texts, marks)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own.score(marks)), pa.array(found, kind)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(by_block(run), "doc_id bigint, score double, spans array<struct<start: bigint, stop: bigint>>")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns; no join is needed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        own = tagger(shared.value)
        yield rows.filter(pa.array(own.score(own.tag([t.split() for t in texts])) < threshold))

    return docs.mapInArrow(by_block(run), docs.schema)
