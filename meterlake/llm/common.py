"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in blocks of about so many characters, whatever the size of an Arrow batch.
BLOCK_CHARS = 2_000_000
#: A membership sieve has so many bits (8 MB); what passes it is always checked by an exact join.
SIEVE_BITS = 1 << 26


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def blocks(lengths: list[int], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``most`` characters; one longer row is a range of its own."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def by_block(fn: Callable[[pa.RecordBatch, list], Iterator[pa.RecordBatch]], text: str = "text"):
    """A mapInArrow function that calls ``fn(rows, texts)`` for blocks of rows; a null text is an empty one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in blocks([len(t) for t in texts]):
                yield from fn(batch.slice(a, b - a), texts[a:b])

    return run


def hashed_order(*columns: str) -> Column:
    """A fixed pseudo-random order, to take a bounded sample that does not depend on how rows are stored."""
    return F.xxhash64(*columns)


def sampled(rows: DataFrame, most: dict, stratum: Column, *columns: str) -> DataFrame:
    """A fixed sample with its hash ``h``: of each value of ``stratum`` in ``most`` about that many rows, 10 % more at most as a rule.

    Rows with the least hashes of ``columns`` are taken, all below a bound that follows from the number of distinct
    hashes, so nothing is sorted or gathered. Rows alike in ``columns`` all come: drop repeats of ``h`` once they are small.
    The caller cuts to the exact number by the order of ``h``. A stratum without rows, or a null one, gives none.
    """
    marked = rows.withColumns({"h": hashed_order(*columns), "_s": stratum})
    chosen = F.lit(False)
    for r in marked.groupBy("_s").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect():  # one row a stratum
        if r["_s"] in most:
            share = 1.1 * (most[r["_s"]] + 4 * most[r["_s"]] ** 0.5) / max(r["n"], 1)
            bound = (1 << 63) - 1 if share >= 1 else int((2 * share - 1) * (1 << 63))
            chosen = chosen | ((F.col("_s") == F.lit(r["_s"])) & (F.col("h") <= F.lit(bound)))
    return marked.where(chosen).drop("_s")


def sieve(keys: DataFrame, column: str, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bit array of fixed size with the bit of every key (long) set; built by Spark, at most ``bits / 8`` bytes.

    It only thins out rows before a shuffle. A key outside the set passes with a probability of about
    ``keys / bits``, so an exact join must follow. An empty set gives a sieve that nothing passes.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    got = words.toArrow()  # one row for each set word, so never more than bits / 64 rows
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def passes(kept: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys the sieve lets through."""
    place = np.mod(keys.astype(np.int64, copy=False), np.int64(kept.size * 64)).astype(np.uint64)
    return ((kept[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with x bound to one evaluation of ``value``: a plain column inside a lambda is computed for every element."""
    return F.transform(F.array(value), fn)[0]
