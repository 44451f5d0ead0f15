"""Descent through parent links of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.sources.storage import settle


def ancestors(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, steps) for all ancestors of every node, fewest steps; a row with itself means that it is on a cycle.

    Reach doubles in every round: the ancestors known so far, and those of the node so many steps up. So the rounds
    grow with the logarithm of the depth, and on a cycle the set of pairs stops growing, which ends the search. There
    are as many pairs as nodes times their depth. Null nodes and parents are no links; repeated links count once.
    """
    jump = links.where(F.col(node).isNotNull() & F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).distinct()
    jump = settle(jump, "links")
    known = settle(jump.withColumn("steps", F.lit(1).cast("bigint")), "ancestors")
    reach, before = 1, -1
    while (size := known.count()) != before:
        before = size
        further = jump.select(F.col("node").alias("_from"), F.col("ancestor").alias("_to"))
        more = known.join(further, F.col("ancestor") == F.col("_from")).select("node", F.col("_to").alias("ancestor"), (F.col("steps") + reach).alias("steps"))
        known = settle(known.unionByName(more).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")), "ancestors")
        jump = settle(jump.join(further, F.col("ancestor") == F.col("_from")).select("node", F.col("_to").alias("ancestor")).distinct(), "links")
        reach *= 2
    return known


def sums_below(links: DataFrame, facts: DataFrame, values: dict[str, Column], node: str = "node", parent: str = "parent") -> DataFrame:
    """For every node with anything below it: its depth from the top, its descendants, whether it is on a cycle, and the
    ``values``, aggregates over the facts of the nodes below. A node on a cycle is not its own descendant; its depth is null.
    """
    pairs = ancestors(links, node, parent)
    depth = pairs.groupBy("node").agg(F.max("steps").alias("depth"), F.bool_or(F.col("node") == F.col("ancestor")).alias("on_cycle"))
    # whatever hangs below a cycle has no top to be counted from
    stuck = pairs.join(depth.where("on_cycle").select(F.col("node").alias("_c")), F.col("ancestor") == F.col("_c"), "left_semi").select("node").distinct()
    depth = depth.join(stuck.withColumn("_stuck", F.lit(True)), "node", "left").select("node", F.when(F.col("_stuck").isNull(), F.col("depth")).alias("depth"), "on_cycle")
    apart = pairs.where("node != ancestor")
    below = apart.join(facts.withColumnRenamed(node, "node"), "node", "left").groupBy(F.col("ancestor").alias("node")).agg(
        F.countDistinct("node").alias("descendants"), *[c.alias(n) for n, c in values.items()]
    )
    out = below.join(depth, "node", "left")
    top = F.coalesce(F.col("on_cycle"), F.lit(False))
    return out.withColumns({"on_cycle": top, "depth": F.when(F.col("on_cycle").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("depth"))})
