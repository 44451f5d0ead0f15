"""Random forests of two classes on histograms: all trees grow a level in one pass over the rows.

Rows stay in their partitions, as bins. A task counts, a tree at a time, the rows of its bag by node, drawn feature, bin
and class. The counts of a node are added up and searched in one place; the driver sees the chosen splits and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.sources.storage import settle

#: Rows that a task holds at once, and rows of one step, whose arrays stay in the processor's cache.
HELD_ROWS, STEP_ROWS = 1 << 20, 1 << 15

#: Trees that draw from one hash of a row, 16 bits each.
DRAWS = 4

#: Nodes searched for a split at once.
SEARCHED = 1024

#: Points that sum up a feature's values in a task.
POINTS = 4096

#: Poisson counts of mean 1 by 16 random bits.
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Forest:
    """Full binary trees side by side: node i has the children 2 i + 1 and 2 i + 2; a row goes left if its bin is at most ``cut``.

    ``feature`` is -1 at a leaf. ``counts`` are rows of the bag by class (axes: tree, node, class).
    """

    features: list[str]
    edges: list[np.ndarray]
    weights: tuple[float, float]
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    def shares(self) -> np.ndarray:
        """Weighted part of class 1 by tree and node."""
        w = self.counts * np.array(self.weights)
        return w[:, :, 1] / np.maximum(w.sum(axis=2), 1e-300)

    def pruned(self) -> Forest:
        """Where two leaves of one parent say the same class, the parent is the leaf."""
        feature, says = self.feature.copy(), self.shares() > 0.5
        for d in reversed(range(self.depth)):
            at = np.arange(2**d - 1, 2 ** (d + 1) - 1)
            left, right = 2 * at + 1, 2 * at + 2
            same = says[:, left] == says[:, right]
            if d + 1 < self.depth:
                same &= (feature[:, left] < 0) & (feature[:, right] < 0)
            feature[:, at] = np.where(same, -1, feature[:, at])
        return Forest(self.features, self.edges, self.weights, self.depth, feature, self.cut, self.gain, self.counts)

    def importances(self) -> np.ndarray:
        """Gain of a feature's splits, weighted by the rows of the node; every tree has the same say."""
        each = np.where(self.feature >= 0, self.gain * (self.counts[:, : self.feature.shape[1]] * np.array(self.weights)).sum(axis=2), 0.0)
        found = np.zeros(len(self.features))
        for own, scaled in zip(self.feature, each, strict=True):
            if scaled.sum() > 0:
                found += np.bincount(np.maximum(own, 0), weights=scaled, minlength=len(found)) / scaled.sum()
        return found / found.sum() if found.sum() else found

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Mean over the trees of the share of class 1 in a row's leaf. A null or NaN feature is an error."""
        edges, depth, value, trees = self.edges, self.depth, self.shares(), range(len(self.feature))
        for i in range(2**depth - 1):  # what does not split sends its rows left, with its own share
            value[:, 2 * i + 1] = np.where(self.feature[:, i] < 0, value[:, i], value[:, 2 * i + 1])
        feature, cut = routes(self.feature, self.cut)
        last = np.ascontiguousarray(value[:, 2**depth - 1 :])

        @F.pandas_udf("double")
        def scored(rows: pd.DataFrame) -> pd.Series:
            x = binned(edges, [rows.iloc[:, i].to_numpy(float) for i in range(len(edges))])
            flat, starts, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
            for t in trees:
                total += last[t].take(positions(feature[t], cut[t], flat, starts, depth))
            return pd.Series(total / len(trees))

        return df.withColumn(out, scored(F.struct(*[F.col(c).cast("double") for c in self.features])))


def binned(edges: list[np.ndarray], columns: Sequence[np.ndarray]) -> np.ndarray:
    """Number of edges below each value, a row's features next to each other."""
    if any(np.isnan(c).any() for c in columns):
        raise ValueError("features must not be null or NaN")
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, columns, strict=True)], axis=1).astype(np.uint8)


def routes(feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of every node as rows pass it; what does not split sends all left."""
    return np.maximum(feature, 0).astype(np.int64), np.where(feature < 0, 255, cut).astype(np.uint8)


def positions(feature: np.ndarray, cut: np.ndarray, flat: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Position among the nodes of a depth of the rows that begin at ``starts``."""
    at = np.zeros(len(starts), np.int64)
    for _ in range(depth):
        right = flat.take(starts + feature.take(at)) > cut.take(at)
        at *= 2
        at += 1
        at += right
    return at - (2**depth - 1)


def bags(ids: np.ndarray, group: int, seed: int) -> np.ndarray:
    """How often each row is in the bags of ``DRAWS`` trees. It hangs on the row's number alone, wherever the row is."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.random.default_rng([seed, group]).integers(2**64, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return POISSON[(z ^ (z >> np.uint64(31))).view(np.uint16)].reshape(-1, DRAWS)


def summary(values: np.ndarray, counts: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values, each standing for those between it and the one before, and how many they are.

    No point stands for more than one of ``points`` equal parts, except a value that is more than that by itself. Such a
    value stands for nothing but itself, so frequent values keep their exact counts.
    """
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, weights=counts).astype(np.int64)
    if len(values) > points:
        alone = counts * points > counts.sum()
        part = (np.cumsum(counts) - 1) * points // counts.sum()
        last = np.flatnonzero(np.r_[(part[1:] != part[:-1]) | alone[1:] | alone[:-1], True])
        values, counts = values[last], np.add.reduceat(counts, np.r_[0, last[:-1] + 1])
    return values, counts


def edges_of(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` edges of sorted values. One of more than a part of all gets its own bin, and the rest is cut without it."""
    if len(values) <= bins:
        return values[:-1]
    full = counts * bins > counts.sum()
    while True:
        own = np.flatnonzero(full)
        bounds = np.unique(np.r_[own - 1, own])
        bounds = bounds[(bounds >= 0) & (bounds < len(values) - 1)]
        if len(bounds) < bins:
            break
        full &= counts > counts[full].min()  # the fullest keep theirs
    rest, n, parts = values[~full], np.cumsum(counts[~full]), bins - len(bounds)
    return np.unique(np.concatenate([values[bounds], rest[np.searchsorted(n, n[-1] * np.arange(1, parts) / parts)]]))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Edges of every feature from all rows: tasks sum up the values they hold, and the summaries meet by feature."""
    width = len(features)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def points(parts: list) -> pa.RecordBatch:
            found = [summary(np.concatenate(c), np.ones(sum(map(len, c))), POINTS) for c in zip(*parts, strict=True)]
            at = np.repeat(np.arange(width, dtype=np.int32), [len(v) for v, _ in found])
            return pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]], ["feature", "value", "n"])

        parts, held = [], 0
        for b in batches:
            if b.num_rows:
                parts.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
                held += b.num_rows
            if held >= HELD_ROWS // 4:
                yield points(parts)
                parts, held = [], 0
        if parts:
            yield points(parts)

    def cut(keys: tuple, found: pd.DataFrame) -> pd.DataFrame:
        values, counts = summary(found["value"].to_numpy(), found["n"].to_numpy(), len(found))
        return pd.DataFrame({"feature": [keys[0]], "edges": [edges_of(values, counts, bins).tolist()]})

    parts = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(summed, "feature int, value double, n bigint")
    got = parts.groupBy("feature").applyInPandas(cut, "feature int, edges array<double>").collect()  # a row a feature
    return [np.array(r["edges"]) for r in sorted(got, key=lambda r: r["feature"])]


def _bins(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not np.isin(b.column(1).to_numpy(zero_copy_only=False), (0, 1)).all():
                raise ValueError("labels must be 0 or 1, not null")
            x = binned(edges, [b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(edges))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "bins"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, classes and bins of up to about ``HELD_ROWS`` rows at a time."""
    parts, rows = [], 0
    for b in batches:
        if b.num_rows:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), x))
            rows += b.num_rows
        if rows >= HELD_ROWS:
            yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            parts, rows = [], 0
    if parts:
        yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _counts(feature: np.ndarray, cut: np.ndarray, level: int, growing: list[np.ndarray], chosen: list[np.ndarray], bins: int, seed: int):
    """Rows of the bag by growing node of a level, drawn feature, bin and class; one row out per node and held rows."""
    feature, cut = routes(feature, cut)
    trees = len(feature)
    slots = np.full((trees, 2**level), -1)
    for t, own in enumerate(growing):
        slots[t, own] = np.arange(len(own))
    drawn = [np.ascontiguousarray(c.T).astype(np.int64) for c in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, x in _held(batches):
            width = x.shape[1]
            for group in range(0, trees, DRAWS):
                own = [t for t in range(group, min(group + DRAWS, trees)) if len(growing[t])]
                sums = {t: np.zeros((len(drawn[t]), len(growing[t]) * bins * 2)) for t in own}
                for i in range(0, len(ids) if own else 0, STEP_ROWS):
                    flat, label = x[i : i + STEP_ROWS].ravel(), y[i : i + STEP_ROWS]
                    times = bags(ids[i : i + STEP_ROWS], group // DRAWS, seed)
                    for t in own:
                        n = np.ascontiguousarray(times[:, t - group])
                        at = np.flatnonzero(n)
                        starts = at * width
                        slot = slots[t].take(positions(feature[t], cut[t], flat, starts, level))
                        live = slot >= 0
                        if not live.all():
                            at, starts, slot = at[live], starts[live], slot[live]
                        weight, base = n.take(at).astype(float), slot * (2 * bins) + label.take(at)
                        for j, f in enumerate(drawn[t]):
                            cell = base + 2 * flat.take(starts + f.take(slot)).astype(np.int64)
                            sums[t][j] += np.bincount(cell, weights=weight, minlength=sums[t].shape[1])
                for t in own:
                    cells = sums[t].reshape(len(drawn[t]), len(growing[t]), -1).transpose(1, 0, 2).astype(np.int32)
                    seen = np.flatnonzero(cells.any(axis=(1, 2)))
                    nodes = pa.array((t * 2**level + growing[t][seen]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([nodes, pa.array([cells[s].tobytes() for s in seen], pa.binary())], ["node", "cells"])

    return run


def best_splits(n: np.ndarray, weights: Sequence[float], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Drawn feature (-1: none helps), last bin on the left, gain and counts on the left (axes in: node, feature, bin, class).

    The gain is what a split takes off the weighted Gini impurity; either side has ``least`` rows. Ties: first feature, lowest bin.
    """

    def impure(w: np.ndarray) -> np.ndarray:
        return 1 - (w**2).sum(axis=-1) / np.maximum(w.sum(axis=-1), 1e-300) ** 2

    left = n.cumsum(axis=2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    right, w = total - left, np.array(weights)
    part = (left * w).sum(axis=-1) / np.maximum((total * w).sum(axis=-1), 1e-300)
    gain = impure(total * w) - part * impure(left * w) - (1 - part) * impure(right * w)
    gain = np.where((left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least), np.round(gain, 12), 0.0).reshape(len(n), -1)
    at, rows = gain.argmax(axis=1), np.arange(len(n))
    best, cuts = gain[rows, at], n.shape[2] - 1
    return np.where(best > 0, at // cuts, -1), at % cuts, best, left.reshape(len(n), -1, 2)[rows, at]


def _splits(chosen: np.ndarray, bins: int, weights: Sequence[float], least: int):
    """Adds up the counts of each node, whose rows come one after the other, and looks for its split."""
    names = ["node", "feature", "cut", "gain", "n0", "n1", "l0", "l1"]

    def found(nodes: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(nodes), SEARCHED):
            own = nodes[i : i + SEARCHED]
            n = cells[i : i + SEARCHED].reshape(len(own), -1, bins, 2)
            drawn, cut, gain, left = best_splits(n, weights, least)
            feature = np.where(drawn < 0, -1, chosen[own, np.maximum(drawn, 0)])
            total = n[:, 0].sum(axis=1)
            columns = [own, feature, cut, gain, total[:, 0], total[:, 1], left[:, 0], left[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64 if k == 3 else np.int64)) for k, c in enumerate(columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.zeros(0, np.int64), np.zeros((0, 0), np.int64)  # a node whose rows may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            nodes = b.column(0).to_numpy().astype(np.int64)
            cells = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32).reshape(len(nodes), -1)
            starts = np.flatnonzero(np.diff(nodes, prepend=-1))
            nodes, cells = nodes[starts], np.add.reduceat(cells, starts, dtype=np.int64)
            if len(last) and last[0] == nodes[0]:
                cells[0] += held[0]
            else:
                yield from found(last, held)
            yield from found(nodes[:-1], cells[:-1])
            last, held = nodes[-1:], cells[-1:]
        yield from found(last, held)

    return run


def fit_forest(
    train: DataFrame, number: str, features: Sequence[str], label: str, weights: tuple[float, float],
    trees: int = 220, depth: int = 10, bins: int = 32, least: int = 2, seed: int = 42,
) -> Forest:
    """Trees on Poisson bags of all rows; a node looks at the square root of the features, drawn for it.

    ``number`` tells rows apart and decides their bags, ``label`` is 0 or 1 and ``weights`` are those of the two classes.
    A tree takes ``depth`` levels, each one pass for all trees; the result does not hang on how rows are laid out.
    Nulls in features or label, and a table without rows, are errors.
    """
    features = list(features)
    rows = train.select(F.col(number).cast("bigint").alias("id"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    if rows.isEmpty():
        raise ValueError("no rows to fit")
    edges = bin_edges(rows, features, bins)
    # dealt out evenly, as all of a task's work follows its rows
    rows = settle(rows.mapInArrow(_bins(edges), "id bigint, y int, bins binary").repartition("id"), "binned")
    inner, width, each = 2**depth - 1, len(features), math.ceil(math.sqrt(len(features)))
    feature, cut, gain = np.full((trees, inner), -1), np.zeros((trees, inner), np.int64), np.zeros((trees, inner))
    counts = np.zeros((trees, 2 * inner + 1, 2), np.int64)
    growing = [np.zeros(1, np.int64) for _ in range(trees)]
    for d in range(depth):
        chosen = np.zeros((trees * 2**d, each), np.int64)
        for t, own in enumerate(growing):
            drawn = np.random.default_rng([seed, t, d]).random((2**d, width)).argsort(axis=1)[own, :each]
            chosen[t * 2**d + own] = np.sort(drawn, axis=1)
        own = [chosen[t * 2**d + g] for t, g in enumerate(growing)]
        part = rows.mapInArrow(_counts(feature, cut, d, growing, own, bins, seed), "node int, cells binary")
        found = part.repartition("node").sortWithinPartitions("node").mapInArrow(
            _splits(chosen, bins, weights, least), "node bigint, feature bigint, cut bigint, gain double, n0 bigint, n1 bigint, l0 bigint, l1 bigint"
        ).toArrow()
        got = {c: found.column(c).to_numpy() for c in found.column_names}
        t, at = got["node"] // 2**d, got["node"] % 2**d + 2**d - 1
        total, left = np.stack([got["n0"], got["n1"]], axis=1), np.stack([got["l0"], got["l1"]], axis=1)
        feature[t, at], cut[t, at], gain[t, at], counts[t, at] = got["feature"], got["cut"], got["gain"], total
        split = got["feature"] >= 0
        t, at, total, left = t[split], at[split], total[split], left[split]
        counts[t, 2 * at + 1], counts[t, 2 * at + 2] = left, total - left
        below = counts[:, 2 ** (d + 1) - 1 : 2 ** (d + 2) - 1]
        grows = (below > 0).all(axis=2) & (below.sum(axis=2) >= 2 * least)
        growing = [np.flatnonzero(g) for g in grows]
        if not grows.any():
            break
    return Forest(features, edges, tuple(weights), depth, feature, cut, gain, counts).pruned()
