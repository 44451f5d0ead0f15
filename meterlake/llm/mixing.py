"""Mixing sources to target weights: nested hash thresholds found on histograms, built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scaling import join_null_safe
from meterlake.sources.storage import settle

#: Weights of the sources in code-point order, repeating; the null source comes last.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST = 3
#: Marks have so many bits; a histogram shows so many of them at a time.
MARK_BITS, STEP_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark) of each row: its words (null text: 0) and a mark made of its id and text."""
    text = F.coalesce("text", F.lit(""))
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    mark = F.conv(F.substring(F.md5(known.cast("binary")), 1, MARK_BITS // 4), 16, 10).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), mark.alias("mark"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of the sum of all sizes by weight, none above ``most`` times its source.

    What a full source cannot take raises the level of the others; that may fill further sources, until none is above.
    A round is one aggregate over one row a source. Sums are decimals, so no order of addition shows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sources = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight), "sources")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    total, weighed = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, among, before = total or 0, weighed or 1, None
    while (rest, among) != before:
        before = rest, among
        full = exact("weight") * whole(rest) > exact("source_size") * whole(most * among)
        taken, among = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(1))
        ).first()
        rest = (total or 0) - taken
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(among))
    return sources.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, copies, cut): every row is taken ``copies`` times, and once more if its mark is at most ``cut``.

    Tokens are summed by source and leading bits of the mark. The bucket in which the budget ends is the only one
    refined by the next bits, down to single marks; the last mark is taken if that comes nearer to the target.
    A window sees at most 2 ** STEP_BITS rows of a source.
    """
    copies = F.floor(F.col("target") / F.col("source_size"))
    ends = goals.where("source_size > 0").select(
        "source", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("left"), F.lit(0).cast("bigint").alias("path"), F.lit(0).cast("bigint").alias("before")
    )
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("source", "mark", "size")
    for shift in range(MARK_BITS - STEP_BITS, -1, -STEP_BITS):
        held = inside.groupBy("source", F.shiftright("mark", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        held = join_null_safe(held, ends, ["source"]).withColumn("upto", F.col("before") + F.sum("n").over(along))
        ends = held.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        ends = settle(ends.select("source", "copies", "left", F.col("bucket").alias("path"), (F.col("upto") - F.col("n")).alias("before"), "n"), "ends")
        if shift:
            at = ends.select("source", F.col("path").alias("_path"))
            inside = join_null_safe(inside, at, ["source"]).where(F.shiftright("mark", shift) == F.col("_path")).drop("_path")
            inside = settle(inside, "boundary")
            ends = ends.drop("n")
    short = F.col("left") - F.col("before")
    return ends.select("source", "copies", F.when(F.col("n") - short < short, F.col("path")).otherwise(F.col("path") - 1).alias("cut"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies and taken (copies * size).

    The rows of a source with small marks are taken once more than the others, so a larger target takes what a smaller
    one takes and more. No rows are sorted and none leaves its partition but as sums, so a source may hold any share.

    Null and empty texts have size 0 and are taken like others of their mark. A null source is a source, the last one;
    a null id counts as an empty one. Rows with the same id and text have one mark and are taken alike, so many repeats
    of one row may end off the target by half their sum. A source without words has target 0. An empty table gives
    none. Other columns of the table are left aside.
    """
    rows = settle(sized(docs), "sizes")
    goals = settle(targets(rows, weights, most), "goals")
    cut = join_null_safe(goals, thresholds(rows, goals), ["source"], "left")
    out = join_null_safe(rows, cut, ["source"])
    once_more = (F.col("mark") <= F.col("cut")).cast("bigint")
    copies: Column = F.least(F.coalesce(F.col("copies") + once_more, F.lit(0)), F.lit(most)).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
