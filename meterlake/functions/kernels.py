"""Small numpy kernels that run inside Spark tasks on Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def dtw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping distance of each row pair; the whole batch advances cell by cell."""
    rows, n = a.shape
    m = b.shape[1]
    cost = np.full((rows, m + 1), np.inf)
    cost[:, 0] = 0.0
    for i in range(n):
        step = np.full((rows, m + 1), np.inf)
        for j in range(m):
            gap = (a[:, i] - b[:, j]) ** 2
            step[:, j + 1] = gap + np.minimum(np.minimum(cost[:, j + 1], step[:, j]), cost[:, j])
        cost = step
    return np.sqrt(cost[:, m])


class Changepoints:
    """Online Bayesian changepoint detection with a Student-t predictive per run length (Adams and MacKay 2007).

    The run-length posterior is cut at ``longest`` entries, the tail mass staying in the last one. A break is
    reported when the mass on run lengths below ``recent`` passes ``limit`` while the series is older than that.
    """

    def __init__(self, expected_run: float = 250.0, limit: float = 0.5, longest: int = 300, recent: int = 5):
        self.hazard, self.limit, self.longest, self.recent = 1.0 / expected_run, limit, longest, recent
        # Prior shape, scale, weight and mean
        self.prior = (0.1, 0.01, 1.0, 0.0)
        # the shape depends on the run length alone, so the constant of the predictive density is a table
        shapes = self.prior[0] + 0.5 * np.arange(longest + 1)
        self.norm = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in shapes.tolist()])

    def start(self) -> tuple[int, bool, np.ndarray]:
        a, b, k, m = self.prior
        return 0, False, np.array([[1.0, a, b, k, m]])

    def step(self, state: tuple[int, bool, np.ndarray], x: float) -> tuple[tuple[int, bool, np.ndarray], float, bool]:
        """Next state, mass on short runs, and whether a break starts here."""
        seen, inside, table = state
        p, alpha, beta, kappa, mu = table.T
        scale2 = beta * (kappa + 1) / (alpha * kappa)
        df = 2 * alpha
        log_pdf = self.norm[: len(p)] - 0.5 * np.log(df * math.pi * scale2) - (df + 1) / 2 * np.log1p((x - mu) ** 2 / (df * scale2))
        weight = p * np.exp(log_pdf - log_pdf.max())
        grown = weight * (1 - self.hazard)
        fresh = weight.sum() * self.hazard
        total = grown.sum() + fresh
        a0, b0, k0, m0 = self.prior
        new = np.empty((len(p) + 1, 5))
        new[0] = (fresh / total, a0, b0, k0, m0)
        new[1:, 0] = grown / total
        new[1:, 1] = alpha + 0.5
        new[1:, 2] = beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1))
        new[1:, 3] = kappa + 1
        new[1:, 4] = (kappa * mu + x) / (kappa + 1)
        if len(new) > self.longest:
            new[-2, 0] += new[-1, 0]
            new = new[:-1]
        seen += 1
        short = float(new[: self.recent, 0].sum())
        above = seen > 2 * self.recent and short > self.limit
        return (seen, above, new), short, above and not inside

    def scan(self, values: np.ndarray, state=None):
        state = state or self.start()
        masses, breaks = np.empty(len(values)), np.zeros(len(values), dtype=bool)
        for i, x in enumerate(values):
            state, masses[i], breaks[i] = self.step(state, float(x))
        return masses, breaks, state

    def scan_many(self, series: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places of the breaks and the masses there, for every series from its start; all series advance together.

        The arithmetic is that of ``step``, with a row per series: shapes and weights depend on the run length alone.
        """
        order = sorted(range(len(series)), key=lambda i: -len(series[i]))
        out = [([], []) for _ in series]
        a0, b0, k0, m0 = self.prior
        m = len(series)
        p, beta, mu = np.ones((m, 1)), np.full((m, 1), b0), np.full((m, 1), m0)
        alpha, kappa = np.array([a0]), np.array([k0])
        inside = np.zeros(m, dtype=bool)
        for at in range(len(series[order[0]]) if series else 0):
            while len(series[order[m - 1]]) <= at:
                m -= 1
            p, beta, mu, inside = p[:m], beta[:m], mu[:m], inside[:m]
            x = np.array([series[order[i]][at] for i in range(m)], float)[:, None]
            n = p.shape[1]
            scale2 = beta * (kappa + 1) / (alpha * kappa)
            df = 2 * alpha
            off = (x - mu) ** 2
            log_pdf = self.norm[:n] - 0.5 * np.log(df * math.pi * scale2) - (df + 1) / 2 * np.log1p(off / (df * scale2))
            weight = p * np.exp(log_pdf - log_pdf.max(axis=1, keepdims=True))
            grown = weight * (1 - self.hazard)
            fresh = weight.sum(axis=1, keepdims=True) * self.hazard
            total = grown.sum(axis=1, keepdims=True) + fresh
            grown /= total
            keep = min(n, self.longest - 1)
            p, old_beta, old_mu = np.empty((m, keep + 1)), beta, mu
            p[:, :1], p[:, 1:] = fresh / total, grown[:, :keep]
            if keep < n:
                p[:, -1] += grown[:, -1]
            beta, mu = np.empty((m, keep + 1)), np.empty((m, keep + 1))
            beta[:, 0], mu[:, 0] = b0, m0
            beta[:, 1:] = (old_beta + kappa * off / (2 * (kappa + 1)))[:, :keep]
            mu[:, 1:] = ((kappa * old_mu + x) / (kappa + 1))[:, :keep]
            alpha, kappa = np.append(a0, alpha[:keep] + 0.5), np.append(k0, kappa[:keep] + 1)
            short = p[:, : self.recent].sum(axis=1)
            above = (short > self.limit) if at + 1 > 2 * self.recent else np.zeros(m, dtype=bool)
            for i in np.flatnonzero(above & ~inside):
                out[order[i]][0].append(at)
                out[order[i]][1].append(short[i])
            inside = above
        return [(np.array(places, int), np.array(masses, float)) for places, masses in out]


def _growing(x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, mean, squared deviations and maximum of each row's known values up to every column."""
    n, mean, square, top = (np.zeros(x.shape) for _ in range(4))
    top[:] = -np.inf
    a, m, q, t = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), -np.inf)
    for j in range(x.shape[1]):
        known, v = here[:, j], x[:, j]
        a = a + known
        off = np.where(known, v - m, 0.0)
        m = m + off / np.maximum(a, 1.0)
        q = q + np.where(known, off * (v - m), 0.0)
        t = np.where(known, np.maximum(t, v), t)
        n[:, j], mean[:, j], square[:, j], top[:, j] = a, m, q, t
    return n, mean, square, top


def frames(x: np.ndarray, here: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Count, mean, squared deviations and maximum of the last ``width`` rows at each row of series that lie one behind
    the other; ``here`` tells the known values, ``sizes`` the rows of each series."""
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(x)) - np.repeat(begin, sizes)
    blocks = -(-sizes // width)
    row, col = np.repeat(np.cumsum(blocks) - blocks, sizes) + at // width, at % width
    cells, known = np.zeros((int(blocks.sum()), width)), np.zeros((int(blocks.sum()), width), bool)
    cells[row, col], known[row, col] = np.where(here, x, 0.0), here
    na, ma, qa, ta = (c[row, col] for c in _growing(cells, known))
    tail = [c[:, ::-1] for c in _growing(cells[:, ::-1], known[:, ::-1])]
    # the tail that begins one row after the same place of the block before
    old = (at >= width) & (col < width - 1)
    nb, mb, qb, tb = (np.where(old, c[np.maximum(row - 1, 0), np.minimum(col + 1, width - 1)], e) for c, e in zip(tail, (0.0, 0.0, 0.0, -np.inf), strict=True))
    n = na + nb
    share = nb / np.maximum(n, 1.0)
    gap = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
    mean = np.where(nb == 0, ma, np.where(na == 0, mb, ma + gap * share))
    return n, mean, qa + qb + gap * gap * na * share, np.maximum(ta, tb)


def path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_tree(x: np.ndarray, seed: int, sample: int, extension: int = 1) -> np.ndarray:
    """One isolation tree with hyperplane splits over ``extension + 1`` features.

    Rows of the result: left, right, offset, leaf depth credit, then (feature, weight) pairs.
    """
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(2, sample))))
    width = extension + 1
    nodes: list[np.ndarray] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        node = np.zeros(4 + 2 * width)
        node[:2] = -1
        nodes.append(node)
        if parent >= 0:
            nodes[parent][side] = me
        node[3] = depth + path_norm(len(rows))
        part = x[rows]
        spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            continue
        picked = rng.choice(spread, size=min(width, len(spread)), replace=False)
        weights = np.zeros(width)
        features = np.zeros(width)
        features[: len(picked)] = picked
        weights[: len(picked)] = rng.normal(size=len(picked))
        lo, hi = part[:, picked].min(axis=0), part[:, picked].max(axis=0)
        offset = float((rng.uniform(lo, hi) * weights[: len(picked)]).sum())
        go_left = part[:, picked] @ weights[: len(picked)] <= offset
        if go_left.all() or not go_left.any():
            continue
        node[2] = offset
        node[4 : 4 + width] = features
        node[4 + width :] = weights
        todo.append((rows[go_left], depth + 1, me, 0))
        todo.append((rows[~go_left], depth + 1, me, 1))
    return np.vstack(nodes)


def tree_depths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Depth credit of each row's leaf. All rows go down a level at a time, and a leaf is its own child, so that a step
    is a few gathers from short columns and no row is sorted out."""
    width = (tree.shape[1] - 4) // 2
    here = np.arange(len(tree))
    leaf = tree[:, 0] < 0
    # children side by side: 2 * node is the left one, 2 * node + 1 the right one
    child = np.where(leaf[:, None], here[:, None], tree[:, :2].astype(np.int64)).ravel()
    features, weights, offset = tree[:, 4 : 4 + width].astype(np.int64).T.copy(), tree[:, 4 + width :].T.copy(), tree[:, 2].copy()
    flat, begin = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), np.int64)
    while not leaf[at].all():
        value = flat[begin + features[0][at]] * weights[0][at]
        for k in range(1, width):
            value += flat[begin + features[k][at]] * weights[k][at]
        at = child[2 * at + ~(value <= offset[at])]
    return tree[at, 3]


#: Rows that go down a forest together, so that their numbers stay in the cache.
TOGETHER = 8192


def forest_scores(trees: list[np.ndarray], sample: float, x: np.ndarray) -> np.ndarray:
    """2 to the minus mean depth over the expected depth: near 1 is easy to isolate."""
    depth = np.zeros(len(x))
    for i in range(0, len(x), TOGETHER):
        for t in trees:
            depth[i : i + TOGETHER] += tree_depths(t, x[i : i + TOGETHER])
    return 2.0 ** (-(depth / len(trees)) / max(path_norm(sample), 1e-9))


@dataclass
class LeafBox:
    """A leaf as the conditions on its path: low < x <= high for each of its features, once each.

    ``passed`` is the share of rows that the splits on that feature let through, ``share`` that of all rows here.
    """

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    passed: np.ndarray
    share: float


def leaf_boxes(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, cover: np.ndarray, depth: int) -> list[LeafBox]:
    """The leaves of a full binary tree (children 2 i + 1 and 2 i + 2) that rows reached.

    A split that parts no rows must send every row to the same side, as those of a fit do; it is left out.
    """
    out = []
    todo = [(0, {}, 1.0)]
    while todo:
        node, path, share = todo.pop()
        if node >= 2**depth - 1:
            cells = sorted(path.items())
            out.append(LeafBox(float(value[node - (2**depth - 1)]), np.array([f for f, _ in cells], int), *(np.array([c[i] for _, c in cells], float) for i in range(3)), share))
            continue
        children = (2 * node + 1, 2 * node + 2)
        for side, child in enumerate(children):
            if not cover[child]:
                continue
            if cover[child] == cover[node]:
                todo.append((child, path, share))
                continue
            low, high, passed = path.get(int(feature[node]), (-np.inf, np.inf, 1.0))
            part = cover[child] / cover[node]
            at = (low, min(high, cut[node]), passed * part) if side == 0 else (max(low, cut[node]), high, passed * part)
            todo.append((child, path | {int(feature[node]): at}, share * part))
    return out


def path_shapley(boxes: list[LeafBox], x: np.ndarray, width: int) -> np.ndarray:
    """Shapley values of every row and feature for the sum of the leaves.

    In a game over the features of one path, a known feature lets the row through or not (0 or 1), an unknown one lets
    its share through. The sums over coalitions by size are the coefficients of a product of linear terms.
    """
    phi = np.zeros((len(x), width))
    for b in boxes:
        m = len(b.features)
        inside = ((x[:, b.features] > b.low) & (x[:, b.features] <= b.high)).astype(float)
        weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for i in range(m):
            sums = np.zeros((len(x), m))
            sums[:, 0] = 1.0
            for j in (j for j in range(m) if j != i):
                sums[:, 1:] = sums[:, 1:] * b.passed[j] + sums[:, :-1] * inside[:, j : j + 1]
                sums[:, 0] *= b.passed[j]
            phi[:, b.features[i]] += b.value * (inside[:, i] - b.passed[i]) * (sums @ weight)
    return phi
