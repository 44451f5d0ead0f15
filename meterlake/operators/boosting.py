"""Quantile forecasts by boosted trees on histograms, and what each feature contributes to them.

Rows stay in their partitions. Every level of a tree is one aggregate of counts by node, feature and bin, whose size
depends on the settings alone; the driver sees those counts and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.kernels import leaf_boxes, path_shapley
from meterlake.functions.scaling import value_bucket
from meterlake.sources.storage import settle

#: Trees grown between two writes of the running predictions.
KEPT_TREES = 10


@dataclass
class Tree:
    """A full binary tree: node i has the children 2 i + 1 and 2 i + 2; a row goes left if its bin is at most ``cut``.

    A node that is not split sends all rows left. ``value`` belongs to the leaves, ``cover`` (rows) to all nodes.
    """

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Position of each row among the nodes of a depth, the leaves unless told."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth if depth is None else depth):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.cut[at])
        return at - (2 ** (self.depth if depth is None else depth) - 1)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class QuantileTrees:
    features: list[str]
    quantiles: list[float]
    edges: list[list[float]]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def binned(self, df: DataFrame) -> Column:
        """Bins of the features, 0 for a null; edges are bounded by the number of bins."""
        cells = [
            F.coalesce(value_bucket(F.array(*[F.lit(float(e)) for e in own]).cast("array<double>"), F.col(c).cast("double")), F.lit(0)).cast("int")
            for c, own in zip(self.features, self.edges, strict=True)
        ]
        return F.array(*cells)

    def predict(self, df: DataFrame, out: Sequence[str], floor: float = 0.0) -> DataFrame:
        """One column per quantile, not below ``floor`` and sorted, so that quantiles never cross."""
        base, trees = self.base, self.trees

        @F.pandas_udf("array<double>")
        def scored(bins: pd.Series) -> pd.Series:
            if not len(bins):
                return pd.Series([], dtype=object)
            x = np.vstack(bins.to_numpy())
            found = np.stack([b + sum((t.predict(x) for t in own), np.zeros(len(x))) for b, own in zip(base, trees)], axis=1)
            return pd.Series(list(np.sort(np.maximum(found, floor), axis=1)))

        rows = df.withColumn("_q", scored(self.binned(df)))
        return rows.withColumns({name: F.col("_q")[i] for i, name in enumerate(out)}).drop("_q")

    def contributions(self, df: DataFrame, quantile: float, top: int = 10) -> DataFrame:
        """``base_value``, ``raw_prediction`` and ``shap``: the features of largest absolute contribution, with direction.

        Shapley values of the trees with weights from the rows that passed each node (path-dependent expectations).
        All contributions of a row add up to its unclipped prediction minus the mean, which is ``base_value``.
        """
        k, names = self.quantiles.index(quantile), self.features
        boxes = [b for t in self.trees[k] for b in leaf_boxes(t.feature, t.cut, t.value, t.cover, t.depth)]
        mean = self.base[k] + sum(b.value * b.share for b in boxes)
        width = len(names)

        @F.pandas_udf("array<double>")
        def explained(bins: pd.Series) -> pd.Series:
            return pd.Series(list(path_shapley(boxes, np.vstack(bins.to_numpy()), width))) if len(bins) else pd.Series([], dtype=object)

        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])
        both = F.arrays_zip(cells.alias("c"), F.col("_phi").alias("s"))
        parts = F.transform(
            both,
            lambda p: F.struct(
                (-F.abs(F.round(p["s"], 9))).alias("order"), p["c"]["feature"].alias("feature"), p["c"]["value"].alias("value"), p["s"].alias("shap_value"),
                F.when(p["s"] > 0, "increased").otherwise("decreased").alias("direction"),
            ),
        )
        rows = df.withColumn("_phi", explained(self.binned(df)))
        total = F.aggregate("_phi", F.lit(0.0), lambda s, x: s + x)
        best = F.transform(F.slice(F.array_sort(parts), 1, top), lambda p: p.dropFields("order"))
        return rows.withColumns({"base_value": F.lit(float(mean)), "raw_prediction": F.lit(float(mean)) + total, "shap": best}).drop("_phi")


def _histograms(trees: list[list[Tree]], growing: list[Tree], depth: int, quantiles: list[float], width: int, bins: int):
    """Counts of rows, and of rows above their prediction, by quantile, node, feature and bin of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y, now = np.vstack(b["bins"].to_numpy()), b["y"].to_numpy(), np.vstack(b["now"].to_numpy())
            parts = []
            for k in range(len(quantiles)):
                above = y > now[:, k] + sum((t.predict(x) for t in trees[k]), np.zeros(len(x)))
                node = growing[k].nodes(x, depth)
                cell = ((k * 2**depth + node)[:, None] * width + np.arange(width)) * bins + x
                size = len(quantiles) * 2**depth * width * bins
                n = np.bincount(cell.ravel(), minlength=size)
                up = np.bincount(cell[above].ravel(), minlength=size)
                at = np.flatnonzero(n)
                parts.append(pd.DataFrame({"cell": at, "n": n[at], "above": up[at]}))
            yield pd.concat(parts)

    return run


def _residuals(trees: list[list[Tree]], growing: list[Tree]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y, now = np.vstack(b["bins"].to_numpy()), b["y"].to_numpy(), np.vstack(b["now"].to_numpy())
            for k, tree in enumerate(growing):
                got = y - now[:, k] - sum((t.predict(x) for t in trees[k]), np.zeros(len(x)))
                yield pd.DataFrame({"k": k, "leaf": tree.nodes(x), "r": got})

    return run


def _carried(trees: list[list[Tree]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.vstack(b["bins"].to_numpy())
                added = np.stack([sum((t.predict(x) for t in own), np.zeros(len(x))) for own in trees], axis=1)
                yield pd.DataFrame({"bins": b["bins"], "y": b["y"], "now": list(np.vstack(b["now"].to_numpy()) + added)})

    return run


def _best_splits(n: np.ndarray, above: np.ndarray, quantile: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and last bin on the left for each node (axes: node, feature, bin); -1 where no split helps.

    The slope of the pinball loss is ``quantile`` for a row above its prediction and ``quantile - 1`` for the others.
    A split is as good as the squared sums of slopes on its two sides, each over its rows.
    """
    slope = quantile * above - (1 - quantile) * (n - above)
    left_n, left = n.cumsum(axis=2)[:, :, :-1], slope.cumsum(axis=2)[:, :, :-1]
    total_n, total = n.sum(axis=2)[:, :, None], slope.sum(axis=2)[:, :, None]
    right_n, right = total_n - left_n, total - left
    gain = left**2 / np.maximum(left_n, 1) + right**2 / np.maximum(right_n, 1) - total**2 / np.maximum(total_n, 1)
    gain = np.where((left_n >= least) & (right_n >= least), np.round(gain, 9), -1.0).reshape(len(n), -1)
    at = gain.argmax(axis=1)  # ties: first feature, lowest bin
    found = gain[np.arange(len(n)), at] > 0
    return np.where(found, at // (n.shape[2] - 1), -1), np.where(found, at % (n.shape[2] - 1), n.shape[2])


def fit_quantiles(
    train: DataFrame, features: Sequence[str], label: str, quantiles: Sequence[float] = (0.1, 0.5, 0.9), trees: int = 20, depth: int = 3, step: float = 0.25, bins: int = 32, least: int = 30
) -> QuantileTrees:
    """Boosted trees that lower the pinball loss of every quantile; all quantiles share each pass over the rows.

    A tree takes ``depth`` aggregates of counts and one of leaf residuals, whose quantile is the leaf's step. Rows with
    a null label are left out; null features are lowest. A table without rows is an error.
    """
    features, quantiles = list(features), list(quantiles)
    rows = train.where(F.col(label).isNotNull()).withColumns({c: F.col(c).cast("double") for c in features})
    marks = [i / bins for i in range(1, bins)]
    first = rows.agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(label).cast("double"), quantiles, 10_000).alias("base"), *[F.percentile_approx(c, marks, 10_000).alias(f"e{i}") for i, c in enumerate(features)]
    ).first()
    if not first["n"]:
        raise ValueError("no rows to fit")
    edges = [sorted(set(first[f"e{i}"] or [])) for i in range(len(features))]
    model = QuantileTrees(features, quantiles, edges, [float(b) for b in first["base"]], [[] for _ in quantiles])
    schema = "bins array<int>, y double, now array<double>"
    base = F.array(*[F.lit(b) for b in model.base])
    rows = settle(rows.select(model.binned(rows).alias("bins"), F.col(label).cast("double").alias("y"), base.alias("now")), "binned")
    width, shape = len(features), (len(quantiles), -1, len(features), bins)
    recent: list[list[Tree]] = [[] for _ in quantiles]
    for i in range(trees):
        blank = lambda: Tree(depth, np.full(2**depth - 1, 0), np.full(2**depth - 1, bins), np.zeros(2**depth), np.zeros(2 ** (depth + 1) - 1, np.int64))
        growing = [blank() for _ in quantiles]
        for d in range(depth):
            part = rows.mapInPandas(_histograms(recent, growing, d, quantiles, width, bins), "cell int, n bigint, above bigint")
            got = part.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).toPandas()
            n, above = (np.zeros(len(quantiles) * 2**d * width * bins, np.int64) for _ in range(2))
            n[got["cell"]], above[got["cell"]] = got["n"], got["above"]
            n, above = n.reshape(shape), above.reshape(shape)
            for k, q in enumerate(quantiles):
                at = slice(2**d - 1, 2 ** (d + 1) - 1)
                chosen, cut = _best_splits(n[k], above[k], q, least)
                growing[k].feature[at], growing[k].cut[at] = np.maximum(chosen, 0), cut
                growing[k].cover[at] = n[k][:, 0].sum(axis=1)
        part = rows.mapInPandas(_residuals(recent, growing), "k int, leaf int, r double").groupBy("k", "leaf")
        for r in part.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", quantiles, 10_000).alias("q")).collect():
            growing[r["k"]].value[r["leaf"]] = step * r["q"][r["k"]]
            growing[r["k"]].cover[2**depth - 1 + r["leaf"]] = r["n"]
        for own, now, tree in zip(model.trees, recent, growing, strict=True):
            own.append(tree)
            now.append(tree)
        if (i + 1) % KEPT_TREES == 0 and i + 1 < trees:
            rows = settle(rows.mapInPandas(_carried(recent), schema), "binned")
            recent = [[] for _ in quantiles]
    return model


def pinball(actual: Column, forecast: Column, quantile: float) -> Column:
    gap = actual - forecast
    return F.greatest(gap * quantile, gap * (quantile - 1))

