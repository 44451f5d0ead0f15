"""Hash trees over logs: a root per key, where two versions first differ, and proofs that an entry is part of a root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.scaling import join_null_safe
from meterlake.sources.storage import settle

#: Children of a node, so a list never has more entries than this.
FAN = 16


def leaf_hash(payload: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), F.coalesce(payload, F.lit(""))), 256)


def node_hash(hashes: Column) -> Column:
    """The number of children is part of the hash, so a node cannot pass for one with more or fewer."""
    return F.sha2(F.concat(F.lit("node:"), F.size(hashes).cast("string"), F.lit(":"), F.array_join(hashes, "")), 256)


#: Bytes of a hash.
WIDTH = 32


def _pieces(nodes: DataFrame, keys: Sequence[str], hashed: bool) -> DataFrame:
    """(keys, up, idx, hashes, whole) of ``nodes`` (keys, idx, hash as bytes): siblings that follow each other in a task's
    rows become one row. Of a whole family the hash of its parent stands for its own if ``hashed``.

    A log that is stored in its order has few other than whole families, so that hardly a leaf is shuffled; in any other
    order the pieces are smaller and the result is the same.
    """
    keys = list(keys)
    kinds = [nodes.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("up", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("whole", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            idx = b.column(len(keys)).to_numpy()
            new = np.append(True, (idx[1:] != idx[:-1] + 1) | (idx[1:] % FAN == 0))
            for c in b.columns[: len(keys)]:
                x, y = c.slice(1), c.slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, n))
            data = b"".join(b.column(len(keys) + 1).to_pylist())
            cuts = [data[WIDTH * i : WIDTH * (i + k)] for i, k in zip(first.tolist(), size.tolist())]
            if hashed:
                cuts = [hashlib.sha256(b"node:%d:" % FAN + c.hex().encode()).digest() if len(c) == FAN * WIDTH else c for c in cuts]
            up = idx[first] // FAN
            columns = [*(c.take(pa.array(first)) for c in b.columns[: len(keys)]), pa.array(up), pa.array(idx[first]), pa.array(cuts, pa.binary()), pa.array(size == FAN)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "up", "idx", "hashes", "whole"])

    return nodes.select(*keys, "idx", "hash").mapInArrow(run, schema)


def _put_together(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, up, hashes) of the families that come in more than one piece or are not full."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "hashes")))
    lists = pieces.where("not whole").groupBy(*keys, "up").agg(rows.alias("_c"))
    return lists.select(*keys, "up", F.aggregate("_c", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["hashes"])).alias("hashes"))


def _text(hashes: Column) -> Column:
    return F.lower(F.hex(hashes))


def tree(log: DataFrame, keys: Sequence[str], position: str, payload: str, top: int = 0) -> DataFrame:
    """(keys, level, idx, hash, leaves) of all nodes. Positions of a key run from 1 without gaps; level 0 has the leaves.

    A level is one aggregate over the level below, with at most FAN rows in a list, so a long log is many tasks and
    log(n) rounds, each written. Leaves are not written but hashed when they are read: the log is gone over again for
    them, so it should be a written table. All keys get the same number of levels, ``top`` at least: above its root a key
    has a chain of single nodes. A null payload counts as an empty one. An empty log has no nodes.
    """
    keys = list(keys)
    now = log.select(*keys, F.lit(0).alias("level"), (F.col(position) - 1).cast("bigint").alias("idx"), leaf_hash(F.col(payload)).alias("hash"), F.lit(1).cast("bigint").alias("leaves"))
    out, level = now, 0
    while level < top or (now.agg(F.max("idx")).first()[0] or 0) > 0:
        level += 1
        if level == 1:
            pieces = settle(_pieces(now.withColumn("hash", F.unhex("hash")), keys, True), "pieces")
            rest = _put_together(pieces, keys)
            size = F.floor(F.octet_length("hashes") / WIDTH)
            made = F.sha2(F.concat(F.lit("node:"), size.cast("string"), F.lit(":"), _text(F.col("hashes"))), 256)
            now = pieces.where("whole").select(*keys, "up", _text(F.col("hashes")).alias("hash"), F.lit(FAN).cast("bigint").alias("leaves"))
            now = now.unionByName(rest.select(*keys, "up", made.alias("hash"), size.cast("bigint").alias("leaves")))
        else:
            children = F.sort_array(F.collect_list(F.struct("idx", "hash")))
            now = now.groupBy(*keys, F.floor(F.col("idx") / FAN).alias("up")).agg(children.alias("c"), F.sum("leaves").alias("leaves"))
            now = now.withColumn("hash", node_hash(F.transform("c", lambda x: x["hash"])))
        now = settle(now.select(*keys, F.lit(level).alias("level"), F.col("up").alias("idx"), "hash", "leaves"), "nodes")
        out = out.unionByName(now)
    return out


def roots(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, level, hash, leaves): the lowest node that stands for the whole log of a key. To be kept apart from the log."""
    keys = list(keys)
    alone = nodes.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("hash", "leaves")).alias("_x")).where("_n = 1")
    low = alone.groupBy(*keys).agg(F.min_by(F.struct("level", "_x.hash", "_x.leaves"), "level").alias("_r"))
    return low.select(*keys, "_r.level", "_r.hash", "_r.leaves")


def height(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]


def differences(kept: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, first_position) of every key whose log is not what it was.

    ``kept`` are the nodes stored then, ``now`` those of the present log, with as many levels. The top nodes say which
    keys differ; from there the first differing child is followed down, so a round joins at most FAN rows a key.
    Kinds: chain removed, chain added, entries removed, entries added, entries changed.
    """
    keys, top = list(keys), max(height(kept), height(now))

    def level(nodes: DataFrame, i: int, name: str) -> DataFrame:
        return nodes.where(F.col("level") == i).select(*keys, "idx", F.col("hash").alias(f"_{name}"), F.col("leaves").alias(f"_{name}_leaves"))

    def beside(i: int, below: DataFrame | None) -> DataFrame:
        sides = [level(kept, i, "then"), level(now, i, "now")]
        if below is not None:
            at = below.select(*keys, F.col("_at").alias("_up"))
            sides = [join_null_safe(s, at, keys).where(F.floor(F.col("idx") / FAN) == F.col("_up")).drop("_up") for s in sides]
        left = sides[0].withColumnsRenamed({"idx": "_i"}).withColumn("_then_here", F.lit(True))
        right = sides[1].withColumnsRenamed({c: f"_r_{c}" for c in [*keys, "idx"]}).withColumn("_now_here", F.lit(True))
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_i") == F.col("_r_idx")]
        both = left.join(right, same, "full")
        named = [F.when(F.col("_then_here"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys]
        both = both.select(*named, F.coalesce("_i", "_r_idx").alias("idx"), "_then", "_now", "_then_leaves", "_now_leaves")
        return both.where(~F.col("_then").eqNullSafe(F.col("_now")))

    first = beside(top, None)
    kind = (
        F.when(F.col("_now_leaves").isNull(), "chain removed")
        .when(F.col("_then_leaves").isNull(), "chain added")
        .when(F.col("_now_leaves") < F.col("_then_leaves"), "entries removed")
        .when(F.col("_now_leaves") > F.col("_then_leaves"), "entries added")
        .otherwise("entries changed")
    )
    found = settle(first.select(*keys, kind.alias("kind"), F.col("idx").alias("_at")), "differences")
    at = found
    for i in range(top - 1, -1, -1):
        at = settle(beside(i, at).groupBy(*keys).agg(F.min("idx").alias("_at")), "differences")
    return join_null_safe(found.drop("_at"), at, keys).select(*keys, "kind", (F.col("_at") + 1).alias("first_position"))


def families(nodes: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    """(keys, up, hashes): the hashes of the children of each node above ``level``, in order, as bytes in one row."""
    rows = nodes.where(F.col("level") == level).select(*keys, "idx", F.unhex("hash").alias("hash"))
    pieces = _pieces(rows, keys, False)
    return pieces.where("whole").select(*keys, "up", "hashes").unionByName(_put_together(pieces, keys))


def proofs(nodes: DataFrame, wanted: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """``wanted`` with ``proof``: from the leaf up, the hashes of the node's family at each level (at most FAN of them).

    A family is one row of bytes. The upper part of a proof is put together once for all entries below a node, from the
    top down, so that only the lowest families and that part are dealt out with the entries.
    """
    keys, top = list(keys), height(nodes)
    kind = "array<struct<level:int,hashes:array<string>>>"
    if not top:
        return wanted.withColumn("proof", F.lit(None).cast(kind))
    path = None
    for level in range(top - 1, 0, -1):
        own = families(nodes, keys, level).withColumn("_step", F.array(F.struct(F.lit(level).alias("level"), "hashes"))).drop("hashes")
        if path is None:
            path = own.withColumnRenamed("_step", "_path")
        else:
            above = path.withColumnRenamed("up", "_above")
            path = join_null_safe(own.withColumn("_above", F.floor(F.col("up") / FAN)), above, [*keys, "_above"])
            path = path.select(*keys, "up", F.concat("_step", "_path").alias("_path"))
    lowest = families(nodes, keys, 0).withColumnsRenamed({"up": "_up", "hashes": "_low"})
    out = join_null_safe(wanted.withColumn("_up", F.floor((F.col(position) - 1) / FAN)), lowest, [*keys, "_up"], "left")
    steps = F.when(F.col("_low").isNotNull(), F.array(F.struct(F.lit(0).alias("level"), F.col("_low").alias("hashes"))))
    if path is not None:
        above = path.withColumnRenamed("up", "_above")
        out = join_null_safe(out.withColumn("_above", F.floor(F.col("_up") / FAN)), above, [*keys, "_above"], "left")
        steps = F.concat(steps, F.col("_path"))

    def texts(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.octet_length(hashes) / WIDTH).cast("int") - 1)
        return F.transform(places, lambda i: _text(F.substring(hashes, i * WIDTH + 1, F.lit(WIDTH))))

    proof = F.transform(steps, lambda x: F.struct(x["level"].alias("level"), texts(x["hashes"]).alias("hashes")))
    return out.withColumn("proof", proof.cast(kind)).select(*wanted.columns, "proof")


def proved(payload: Column, position: Column, proof: Column, root: Column) -> Column:
    """Does the proof lead from this payload at this position to the root? Needs nothing but the proof and the root.

    A log of one entry has an empty or null proof: its leaf is the root.
    """
    start = F.struct(leaf_hash(payload).alias("hash"), (position - 1).cast("bigint").alias("idx"), F.lit(True).alias("ok"))

    def up(state: Column, step: Column) -> Column:
        here = F.try_element_at(step["hashes"], (state["idx"] % FAN + 1).cast("int"))
        return F.struct(
            node_hash(step["hashes"]).alias("hash"), F.floor(state["idx"] / FAN).alias("idx"), (state["ok"] & here.eqNullSafe(state["hash"])).alias("ok")
        )

    steps = F.coalesce(proof, F.array().cast("array<struct<level:int,hashes:array<string>>>"))
    end = F.aggregate(steps, start, up)
    return end["ok"] & end["hash"].eqNullSafe(root)
