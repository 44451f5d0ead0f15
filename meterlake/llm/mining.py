"""Hard negatives by inner product: a sort-tile packed R-tree, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.sources.storage import settle

#: Rows of a leaf, children of a node, components of a slab of rows, anchors searched together.
LEAF, FANOUT, SLAB_VALUES, BLOCK = 128, 16, 2_000_000, 4096
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these parts (in hundredths) of its positive's.
LEAST, MOST = 80, 100
SCALE = 256

PAGES = "slab int, label bigint, dim int, n int, ids binary, rows binary, low binary, high binary"
POSITIVE = "key bigint, positive_id bigint, positive_score bigint"
NEGATIVE = "key bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def prepared(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v, key) of the distinct rows that take part; v has floor(256 x) of each component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    own = F.col("label") if label is None else label
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))
    rows = vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), own.cast("bigint").alias("label"), v.alias("v"))
    return rows.distinct().withColumn("key", F.xxhash64("vec_id", "label", "v"))


def tiles(rows: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive order: the pages of a leaf level, each at most ``leaf`` row numbers, near ones together."""
    axes = np.argsort(-rows.astype(float).var(axis=0), kind="stable") if rows.size else np.zeros(0, int)
    out, todo = [], [(np.arange(len(rows)), 0)]
    while todo:
        own, depth = todo.pop()
        pages = -(-len(own) // leaf)
        if pages <= 1 or depth >= len(axes):
            out += [own[i : i + leaf] for i in range(0, len(own), leaf)]
            continue
        own = own[np.argsort(rows[own, axes[depth]], kind="stable")]
        axes_left = min(len(axes) - depth, max(1, int(np.ceil(np.log2(pages)))))
        wide = -(-pages // max(2, round(pages ** (1 / axes_left)))) * leaf
        todo += [(own[i : i + wide], depth + 1) for i in range(0, len(own), wide)][::-1]
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the rows of a partition, one tree for each label and dimension, into leaf pages with their boxes."""
    slab = TaskContext.get().partitionId()
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    v = table.column("v").chunk(0)
    ends, flat = v.offsets.to_numpy(), v.values.to_numpy()
    dims = np.diff(ends)
    for label, dim in sorted(set(zip(labels.tolist(), dims.tolist()))):
        own = np.flatnonzero((labels == label) & (dims == dim))
        rows = flat[ends[own][:, None] + np.arange(dim)]
        made = {name: [] for name in ("slab", "label", "dim", "n", "ids", "rows", "low", "high")}
        for page in tiles(rows):
            box = rows[page]
            held = (slab, label, dim, len(page), ids[own[page]], box, box.min(axis=0), box.max(axis=0))
            for name, x in zip(made, held):
                made[name].append(x.astype(np.int64).tobytes() if isinstance(x, np.ndarray) else x)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        for i in range(0, len(made["slab"]), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 64], t) for x, t in zip(made.values(), kinds)], names=list(made))


class Tree:
    """Boxes of each level from the leaf pages up; a node's children are ``FANOUT`` consecutive nodes below."""

    def __init__(self, pages: list[dict], dim: int):
        numbers = lambda x: np.frombuffer(x, np.int64)
        self.ids = [numbers(p["ids"]) for p in pages]
        self.rows = [numbers(p["rows"]).reshape(len(i), dim) for i, p in zip(self.ids, pages)]
        low, high = (np.stack([numbers(p[c]) for p in pages]) for c in ("low", "high"))
        self.boxes = [(low, high)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0)
            self.boxes.append((low, high))


def trees(pages: pa.Table) -> dict[tuple[int, int], Tree]:
    by: dict[tuple[int, int], list[dict]] = {}
    for p in pages.to_pylist():
        by.setdefault((p["label"], p["dim"]), []).append(p)
    return {k: Tree(x, k[1]) for k, x in by.items()}


def search(roots: list[Tree], a: np.ndarray, windows: list[tuple], best: int, own: int | None = None) -> list[list[tuple[int, int]]]:
    """For each score window (low, high) the ``best`` rows by score, ties by smaller id, as (score, id) pairs in order.

    A box gives each component an interval and so the inner product one. The queue hands out boxes by upper bound. A
    box is dropped if for every window it lies outside or strictly below the last row kept: an equal score may still
    win by its id. Rows whose id is ``own`` are left out; None as a limit is no limit.
    """
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    found: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps, the worst kept row first
    queue: list[tuple] = []
    number = count()

    def wanted(top: int, low: int) -> bool:
        for (least, most), kept in zip(windows, found):
            outside = (least is not None and top < least) or (most is not None and low > most)
            reach = top if most is None else min(top, most)
            if not outside and (len(kept) < best or reach >= kept[0][0]):
                return True
        return False

    def put(tree: Tree, level: int, start: int, stop: int) -> None:
        low, high = (x[start:stop] for x in tree.boxes[level])
        tops, lows = (high @ up + low @ down).tolist(), (low @ up + high @ down).tolist()
        for i, (t, w) in enumerate(zip(tops, lows)):
            if wanted(t, w):
                heapq.heappush(queue, (-t, next(number), w, tree, level, start + i))

    for tree in roots:
        put(tree, len(tree.boxes) - 1, 0, len(tree.boxes[-1][0]))
    while queue:
        top, _, low, tree, level, node = heapq.heappop(queue)
        if not wanted(-top, low):
            continue
        if level:
            put(tree, level - 1, node * FANOUT, min((node + 1) * FANOUT, len(tree.boxes[level - 1][0])))
            continue
        ids, scores = tree.ids[node], tree.rows[node] @ a
        for (least, most), kept in zip(windows, found):
            fits = np.ones(len(ids), bool) if own is None else ids != own
            if least is not None:
                fits &= scores >= least
            if most is not None:
                fits &= scores <= most
            if len(kept) == best:
                fits &= scores >= kept[0][0]
            at = np.flatnonzero(fits)
            for i in at[np.lexsort((ids[at], -scores[at]))[:best]].tolist():
                row = (int(scores[i]), -int(ids[i]))
                if len(kept) < best:
                    heapq.heappush(kept, row)
                elif row > kept[0]:
                    heapq.heapreplace(kept, row)
    return [[(s, -i) for s, i in sorted(kept, reverse=True)] for kept in found]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _positives(best: int):
    schema = pa.schema([("key", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(pages: pa.Table, anchors: pa.Table) -> pa.Table:
        made, held = [], trees(pages) if anchors.num_rows else {}
        for x in anchors.to_pylist():
            tree = held.get((x["label"], len(x["v"])))
            if tree:
                made += [(x["key"], i, s) for s, i in search([tree], np.array(x["v"], np.int64), [(None, None)], best, x["vec_id"])[0]]
        return _table(made, schema)

    return run


def _negatives(best: int, least: int, most: int):
    names = [x.split() for x in NEGATIVE.split(", ")]
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in names])

    def run(pages: pa.Table, anchors: pa.Table) -> pa.Table:
        made, held = [], trees(pages) if anchors.num_rows else {}
        for x in anchors.to_pylist():
            roots = [t for (label, dim), t in held.items() if label != x["label"] and dim == len(x["v"])]
            windows = [(-((-least * p["score"]) // 100), (most * p["score"]) // 100) for p in x["positives"]]
            for place, (p, got) in enumerate(zip(x["positives"], search(roots, np.array(x["v"], np.int64), windows, best))):
                made += [(x["key"], x["vec_id"], place, p["id"], p["score"], i, s) for s, i in got]
        return _table(made, schema)

    return run


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``rows`` come from ``prepared``. An anchor's positives are its best other rows of the same label, the negatives of
    each the best rows of other labels with least * positive <= 100 * negative <= most * positive.

    Rows are range partitioned by label, first component and id into slabs of bounded size, whatever label or vector is
    common. Each slab is packed once into leaf pages with boxes, a written table. Every block of anchors meets every
    slab; what a slab returns is the best few for each anchor, and a ranking over those ends the search.

    Null labels, vectors, components and ids and non-finite components take no part. Rows repeated whole count once;
    rows that share an id but nothing else are rows of their own, and no positives of each other. Scores are exact as
    long as they fit 64 bits. Vectors of another dimension have no score with an anchor. A negative positive score
    gives an empty window. Without anchors or rows there is no result.
    """
    rows = settle(rows, "vectors")
    values, asked = rows.agg(F.sum(F.greatest(F.size("v"), F.lit(1))), F.count_if(anchor)).first()
    slabs, blocks = -(-(values or 1) // SLAB_VALUES), -(-max(asked, 1) // BLOCK)
    cut = rows.repartitionByRange(slabs, "label", F.try_element_at("v", F.lit(1)), "vec_id")
    pages = settle(cut.select("vec_id", "label", "v").mapInArrow(_pages, PAGES), "pages")
    last = pages.agg(F.coalesce(F.max("slab"), F.lit(0))).first()[0]
    pages = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("slab", "block")
    anchors = rows.where(anchor).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))

    def everywhere(df: DataFrame):
        return df.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(last)))).groupBy("slab", "block")

    best = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = pages.cogroup(everywhere(anchors)).applyInArrow(_positives(positives), POSITIVE)
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pair = F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(pair)).alias("positives"))  # a few for each anchor
    anchors = settle(anchors.join(near, "key"), "anchors")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = pages.cogroup(everywhere(anchors)).applyInArrow(_negatives(negatives, least, most), NEGATIVE)
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
