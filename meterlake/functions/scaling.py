"""Building blocks that keep ordered computations exact without sending one key to one task.

A key (a meter, a zone, a chain) may hold a large share of all rows. The helpers below cut every key into
order-preserving buckets, do the row-level work inside (key, bucket) and pass only one summary row per bucket
along the key. The tables of summaries are small: their size is the number of buckets, not of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.sources.storage import settle


def _order(columns: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the keys of the left side stay."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _plain_keys(df: DataFrame, names: Sequence[str]) -> dict[str, Column] | None:
    """Columns without nulls that are equal where all of ``names`` are, nulls included: one each, and one for which are null.

    A null-safe join computes its keys anew and so deals out again what a window has dealt out; these serve both. None
    where a type has no value to stand in for a null.
    """
    made, nulls = {}, F.lit(0)
    for i, name in enumerate(names):
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.NumericType):
            filler = F.lit(0).cast(kind)
        elif isinstance(kind, T.StringType):
            filler = F.lit("")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            filler = F.lit("1970-01-01").cast(kind)
        else:
            return None
        made[f"_k{i}"] = F.coalesce(c, filler)
        nulls = nulls + F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return made | {"_z": nulls}


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: dict[str, str] | None = None,
    descending: bool = False,
    small: bool = False,
) -> DataFrame:
    """Row number and running sums per key, exact for keys of any size.

    ``bucket`` must not decrease along ``order``. Sums include the current row and skip nulls. Null keys are a key,
    null order values come first (last if descending), as in a plain window. ``small`` says that buckets hold a few rows
    each: they are dealt out before they are counted, as a task's table of them would hold nearly all it reads.
    """
    sums = sums or {}
    cut = df.withColumn("_b", bucket)
    plain = _plain_keys(cut, [*keys, "_b"])
    by = [*keys, "_b"] if plain is None else list(plain)
    cut = cut.withColumns(plain or {})
    inside = Window.partitionBy(*by).orderBy(*_order(order, descending))
    frame = inside.rowsBetween(Window.unboundedPreceding, 0)
    total = {f"_t{i}": F.sum(c) for i, c in enumerate(sums.values())}
    if any(isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in sums.values()):
        # a bucket's total is its last running sum and not a sum in another order, so that a step of zero into the next
        # bucket leaves the sum as it is and steps that are not negative never lower it
        parts = {f"_f{i}": F.coalesce(F.sum(c).over(frame), F.lit(0.0)) for i, c in enumerate(sums.values())}
        cut = cut.withColumns({"_r": F.row_number().over(inside), **parts})
        total = {f"_t{i}": F.max_by(f"_f{i}", "_r") for i in range(len(sums))}
        place, inner = F.col("_r"), {n: F.col(f"_f{i}") for i, n in enumerate(sums)}
    else:
        place, inner = F.row_number().over(inside), {n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in sums.items()}
    dealt = cut.repartition(*by) if small else cut
    totals = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in total.items()])
    if plain is None:
        whole, along = list(keys), [F.col("_b")]
    else:  # a null bucket comes first
        bit = 1 << len(keys)
        whole = [*by[: len(keys)], F.col("_z") % F.lit(bit)]
        along = [F.col("_z") < F.lit(bit), F.col(by[len(keys)])]
    before = Window.partitionBy(*whole).orderBy(*[c.desc() if descending else c.asc() for c in along]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))],
    )
    made = {}
    if number:
        made[number] = F.col("_n0") + place
    for i, name in enumerate(sums):
        made[name] = F.col(f"_o{i}") + inner[name]
    drop = ["_b", "_n0", "_r", *(plain or {})] + [f"{p}{i}" for i in range(len(sums)) for p in ("_o", "_f")]
    both = join_null_safe(cut, offsets, by) if plain is None else cut.join(offsets, by)
    # cut's own order of columns, which a join by names changes
    return both.withColumns(made).select(*[c for c in [*cut.columns, *made] if c not in drop])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    columns: Sequence[str],
    *,
    following: bool = False,
) -> DataFrame:
    """``prev_<c>`` (and ``next_<c>``) of each row along ``order`` within a key; nulls as in a plain window."""
    cut = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    along = Window.partitionBy(*keys).orderBy("_b")
    row = F.struct(*columns)
    place = F.struct(*order)
    edges = cut.groupBy(*keys, "_b").agg(F.max_by(row, place).alias("_last"), F.min_by(row, place).alias("_first"))
    edges = edges.select(
        *keys, "_b", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after")
    )
    out = join_null_safe(cut, edges, [*keys, "_b"])
    made = {"_p": F.coalesce(F.lag(row).over(inside), F.col("_before"))}
    if following:
        made["_q"] = F.coalesce(F.lead(row).over(inside), F.col("_after"))
    out = out.withColumns(made)
    named = {f"prev_{c}": F.col("_p")[c] for c in columns}
    if following:
        named |= {f"next_{c}": F.col("_q")[c] for c in columns}
    return out.withColumns(named).drop("_b", "_before", "_after", "_p", "_q")


def value_bucket(edges: Column, value: Column) -> Column:
    """Number of edges below a value: an order-preserving bucket."""
    return F.size(F.filter(edges, lambda e: e < value))


def _cut_again(rows: DataFrame, keys: Sequence[str], wanted: list[Column], cuts: int) -> DataFrame:
    """Of each part of each key only the pieces that hold a wanted rank, cut by a sketch of that part.

    Rows have ``_g`` (part), ``_off`` (values before the part) and ``_total``; the pieces get new ones.
    """
    by = [*keys, "_g"]
    marks = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    edges = rows.groupBy(*by).agg(F.percentile_approx("_v", marks, 1000).alias("_edges"))
    if keys:
        cut = join_null_safe(rows, edges, by)
    else:  # a part is one of a few numbers here: two for each wanted point at most
        few = edges.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("_g", "_edges")))).scalar()
        cut = rows.withColumn("_edges", F.try_element_at(few, F.col("_g")))
    cut = cut.withColumn("_vb", value_bucket(F.col("_edges"), F.col("_v"))).drop("_edges")
    sizes = cut.groupBy(*by, "_vb").agg(F.sum("_c").alias("_n"), F.max("_off").alias("_o"), F.max("_total").alias("_total"))
    along = Window.partitionBy(*by).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cuts`` rows
    sizes = sizes.withColumn("_o", F.col("_o") + F.coalesce(F.sum("_n").over(along), F.lit(0)))
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("_o")) & (rank < F.col("_o") + F.col("_n")))
    sizes = sizes.where(holds).select(*by, "_vb", F.col("_o").alias("_new"))
    kept = join_null_safe(cut, sizes, [*by, "_vb"])
    return kept.withColumns({"_off": F.col("_new"), "_g": F.col("_g") * cuts + F.col("_vb")}).drop("_new", "_vb")


#: A key's distinct values are put in order in one task if there are at most so many.
PIECE = 1 << 15


def quantiles(
    df: DataFrame, keys: Sequence[str], column: str, points: dict[str, float], cuts: int = 64, levels: int | None = None, piece: int = PIECE
) -> DataFrame:
    """Exact interpolated quantiles per key; no group's values meet in one aggregation buffer.

    Equal values are counted once and written. While a key may have more than ``piece`` distinct values, a bounded
    sketch cuts each key's values into about equal buckets; bucket counts say which buckets hold a wanted rank, and
    only those are kept and cut again. The number of cuts follows the largest key unless ``levels`` says it; the
    result is the same. Null keys are a key; null values are left out.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = settle(counted, "values")
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_total"), F.count(F.lit(1)).alias("_values"))
    if levels is None:
        most, levels = totals.agg(F.max("_values")).first()[0] or 0, 0
        while most > piece:
            most, levels = most / cuts, levels + 1
    totals = totals.drop("_values")
    rows = join_null_safe(counted, totals, list(keys)) if keys else counted.withColumn("_total", totals.scalar())
    rows = rows.withColumns({"_g": F.lit(0).cast("bigint"), "_off": F.lit(0).cast("bigint")})
    place = {n: F.lit(p) * (F.col("_total") - 1) for n, p in points.items()}
    wanted = [f(x) for x in place.values() for f in (F.floor, F.ceil)]
    for _ in range(levels):
        rows = _cut_again(rows, keys, wanted, cuts)
    inside = Window.partitionBy(*keys, "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_upto", F.col("_off") + F.sum("_c").over(inside))
    made = []
    for name, at in place.items():
        low, high = F.floor(at), F.ceil(at)

        def holds(rank):
            return (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)

        made += [
            F.max(F.when(holds(low), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
    agg = ranked.groupBy(*keys).agg(*made)
    return agg.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in points
        ],
    )


def ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str, edges: Sequence[float]) -> DataFrame:
    """rank, dense_rank, row_number, percent_rank per key by ``value`` descending, ties in ``tie`` order.

    ``edges`` cut the value range into buckets; any increasing list is right, an even one is fast.
    """
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    levels = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    levels = levels.withColumn("_vb", value_bucket(cuts, F.col(value)))
    levels = running(
        levels, keys, F.col("_vb"), [value], number="dense_rank", sums={"_upto": "_c"}, descending=True
    )
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    if keys:
        levels = join_null_safe(levels, totals, list(keys))
    else:
        levels = levels.withColumn("group_rows", totals.scalar())
    levels = levels.select(
        *keys, value, "dense_rank", (F.col("_upto") - F.col("_c") + 1).alias("rank"), "group_rows"
    )
    out = join_null_safe(df, levels, [*keys, value])
    within = Window.partitionBy(*keys, value, "_tb").orderBy(tie)
    # equal values are split by ranges of the tie key, so one common value does not fill one task
    out = out.withColumn("_tb", F.floor(F.col(tie) / 100_000))
    tied = out.groupBy(*keys, value, "_tb").agg(F.count(F.lit(1)).alias("_tn"))
    ahead = Window.partitionBy(*keys, value).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.select(*keys, value, "_tb", F.coalesce(F.sum("_tn").over(ahead), F.lit(0)).alias("_t0"))
    out = join_null_safe(out, tied, [*keys, value, "_tb"])
    return out.withColumns(
        {
            "row_number": F.col("rank") - 1 + F.col("_t0") + F.row_number().over(within),
            "percent_rank": F.when(F.col("group_rows") > 1, (F.col("rank") - 1) / (F.col("group_rows") - 1)).otherwise(
                F.lit(0.0)
            ),
        }
    ).drop("_tb", "_t0")


def ntile(parts: int, row_number: Column, rows: Column) -> Column:
    """SQL NTILE from a row number and a group size: the first ``rows % parts`` tiles hold one row more."""
    small = F.floor(rows / parts)
    large = rows % parts
    head = large * (small + 1)
    return F.when(row_number <= head, F.floor((row_number - 1) / (small + 1)) + 1).otherwise(
        large + F.floor(F.try_divide(row_number - 1 - head, small)) + 1
    )
