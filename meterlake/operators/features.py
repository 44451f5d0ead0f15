"""Time, lag, rolling, physical and rule features of readings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.kernels import frames
from meterlake.functions.scaling import neighbours, running, value_bucket

# Fixed values
OPEN_STATES = ("Open", "Investigating")
RISK_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Normal": 0}


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "dayofweek": F.dayofweek(ts),
            "month": F.month(ts),
            "quarter": F.quarter(ts),
            "date": F.to_date(ts),
        }
    )


def cyclic(df: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """sin/cos pairs; ``columns`` maps an output stem to (column, period)."""
    made = {}
    for stem, (c, period) in columns.items():
        angle = F.lit(2 * math.pi) * F.col(c) / F.lit(float(period))
        made |= {f"{stem}_sin": F.sin(angle), f"{stem}_cos": F.cos(angle)}
    return df.withColumns(made)


def tariff_slot(hour: Column) -> Column:
    """Time-of-use slot of an hour (slot limits 6, 9, 18, 22)."""
    return (
        F.when(hour.isNull(), "normal")
        .when(hour.between(6, 8), "normal")
        .when(hour.between(9, 17), "peak")
        .when(hour.between(18, 21), "critical")
        .otherwise("off_peak")
    )


def day_position(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(
        {
            "minutes_since_midnight": F.hour(ts) * 60 + F.minute(ts),
            "is_weekend": F.dayofweek(ts).isin(1, 7),
        }
    )


def season(month: Column) -> Column:
    """0 winter, 1 summer, 2 monsoon, 3 after the monsoon."""
    return F.when(month.isin(12, 1, 2), 0).when(month <= 5, 1).when(month <= 9, 2).otherwise(3)


def power_factor(kwh: Column, kvah: Column) -> Column:
    return F.when(kvah > 0, kwh / kvah)


def risk_from_load(load: Column) -> Column:
    return F.when(load >= 90, "Critical").when(load >= 75, "High").when(load >= 60, "Medium").otherwise("Normal")


def risk_rank(risk: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in RISK_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, risk), F.lit(0))


def next_action(given: Column, status: Column, severity: Column) -> Column:
    level = F.lower(severity)
    rule = (
        F.when(F.lower(status) == "resolved", "Review closure evidence")
        .when(level == "critical", "Physical inspection within 24 hours")
        .when(level == "high", "Assign field team")
        .when(level == "medium", "Analyst review")
        .otherwise("Monitor trend")
    )
    return F.coalesce(F.nullif(given, F.lit("")), rule)


def detector_votes(df: DataFrame, cut: float = 0.65) -> DataFrame:
    """Status per detector, number agreeing, their names and a consensus label."""
    scores = {"VAE": "vae_score", "EIF": "eif_score", "GNN": "gnn_score"}
    made = {f"{n.lower()}_status": F.when(F.col(c) >= cut, "flagged").otherwise("watch") for n, c in scores.items()}
    made["bocpd_status"] = F.when(F.col("bocpd_flag"), "changepoint").otherwise("no_changepoint")
    fired = F.array_compact(
        F.array(
            F.when(F.col("vae_score") >= cut, "VAE"),
            F.when(F.col("eif_score") >= cut, "EIF"),
            F.when(F.col("bocpd_flag"), "BOCPD"),
            F.when(F.col("gnn_score") >= cut, "GNN"),
        )
    )
    made |= {"detectors": F.array_join(fired, ","), "detectors_agreeing": F.size(fired)}
    return df.withColumns(made).withColumn(
        "consensus", F.when(F.col("detectors_agreeing") >= 3, "High confidence").otherwise("Needs analyst review")
    )


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with codes in sorted order, from 0. The set of distinct values is what is ordered."""
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    # a few values in hash order, sorted, cut the others into even ranges, whatever beginnings they share
    some = values.orderBy(F.xxhash64("value"), "value").limit(256)
    edges = some.groupBy().agg(F.sort_array(F.collect_list("value"))).scalar()
    numbered = running(values.withColumn("_edges", edges), [], value_bucket(F.col("_edges"), F.col("value")), ["value"], number="_n")
    return numbered.select("value", (F.col("_n") - 1).alias("code"))


def encode_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df
    for c in columns:
        codes = label_codes(df, c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        out = out.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return out


def lags(grid: DataFrame, value: str, steps: Sequence[int], ts: str = "hour_ts") -> DataFrame:
    """Row lags on a dense grid, which equal time lags."""
    w = Window.partitionBy("meter_id").orderBy(ts)
    return grid.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in steps})


#: Rows of whole meters that a task of ``rolling`` works on at once.
ROLL_ROWS = 1 << 16


def rolling(grid: DataFrame, value: str, widths: Sequence[int], ts: str = "hour_ts") -> DataFrame:
    """Mean, sample deviation and maximum over rows -n..0 (n + 1 rows), on a dense grid.

    A meter's rows are cut into blocks of the frame's length. A frame is the head of its block up to the row and the
    tail of the block before, so each row needs one running aggregate from either end of a block: work per row does
    not grow with the frame. Count, mean and squared deviations of the two parts are merged, nothing is subtracted,
    and a far value leaves no trace once it has left the frame. Rows are shuffled and sorted once for all widths; the
    aggregates run in the tasks, on whole meters (which the calendar bounds).
    """
    widths = list(widths)
    made = [f"roll_{kind}_{k}" for k in widths for kind in ("mean", "std", "max")]
    kept = [c for c in grid.columns if c not in made]
    # the numbering leaves whole meters in a task, in order; the tasks hold it against the numbers
    order = Window.partitionBy("meter_id").orderBy(ts)
    base = grid.withColumn("_at", F.row_number().over(order)).select(*kept, "_at", F.col(value).cast("double").alias("_x"))
    schema = T.StructType([*grid.select(*kept).schema.fields, *[T.StructField(c, T.DoubleType()) for c in made]])
    names = list(schema.names)

    def roll(rows: pa.Table, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        x = rows.column("_x")
        here = ~np.asarray(x.is_null())
        x = x.to_numpy(zero_copy_only=False)
        out = []
        for k in widths:
            n, mean, square, top = frames(x, here, sizes, k + 1)
            std = np.sqrt(square / np.maximum(n - 1, 1.0))
            out += [pa.array(c, pa.float64(), mask=n < least) for c, least in ((mean, 1), (std, 2), (top, 1))]
        columns = [*rows.select(list(kept)).columns, *out]
        yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < ROLL_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            starts = _starts(rows.column("_at"))
            if len(starts) > 1:  # the last meter may go on in the next batch
                yield from roll(rows.slice(0, starts[-1]), np.diff(starts))
                rows = rows.slice(starts[-1])
            held, count = rows.to_batches(), rows.num_rows
        if count:
            rows = pa.Table.from_batches(held)
            yield from roll(rows, np.diff([*_starts(rows.column("_at")), rows.num_rows]))

    return base.mapInArrow(run, schema)


def _starts(numbers: pa.ChunkedArray) -> np.ndarray:
    """Places where the numbers begin again at 1; anything but the next number elsewhere is an error."""
    at = numbers.to_numpy()
    starts = np.flatnonzero(at == 1)
    if len(starts) == 0 or starts[0] != 0 or (np.delete(np.diff(at), starts[1:] - 1) != 1).any():
        raise ValueError("rows of a series are not in order")
    return starts


def day_statistics(grid: DataFrame, value: str = "kwh", ts: str = "hour_ts") -> DataFrame:
    """Mean, maximum, load factor, night and day sums of the meter's day, on every slot.

    A meter's day has at most 24 slots, so the windows are bounded.
    """
    w = Window.partitionBy("meter_id", "date")
    night = (F.hour(ts) >= 22) | (F.hour(ts) < 6)
    x = F.col(value)
    return grid.withColumn("date", F.to_date(ts)).withColumns(
        {
            "daily_mean": F.avg(x).over(w),
            "daily_max": F.max(x).over(w),
            "load_factor_day": F.when(F.max(x).over(w) > 0, F.avg(x).over(w) / F.max(x).over(w)),
            "night_sum": F.sum(F.when(night, x).otherwise(0.0)).over(w),
            "day_sum": F.sum(F.when(~night, x).otherwise(0.0)).over(w),
            "night_ratio": F.sum(F.when(night, x).otherwise(0.0)).over(w)
            / (F.sum(F.when(~night, x).otherwise(0.0)).over(w) + 1e-5),
        }
    )


def change_ratio(value: Column, before: Column) -> Column:
    return F.when(before > 0, (value - before) / before)


def rollback(register: DataFrame) -> DataFrame:
    """Is the cumulative register below its previous reading? Null on a meter's first reading."""
    rows = neighbours(
        register, ["meter_id"], F.date_trunc("hour", "timestamp"), ["timestamp", "reading_id"], ["cumulative_kwh"]
    )
    return rows.withColumn("cumulative_rollback", F.col("cumulative_kwh") < F.col("prev_cumulative_kwh"))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, bucket: Column | None = None) -> DataFrame:
    """Consecutive rows with equal ``state``: first and last place and length of each run.

    Without a bucket the rows of one key must be bounded (a dense grid); with one they may be any number.
    """
    # the first row is known by its place, so that a null state may follow a null state within a run
    tagged = df.withColumn("_row", F.lit(1))
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        marked = tagged.withColumns({f"prev_{state}": F.lag(state).over(w), "prev__row": F.lag("_row").over(w)})
    else:
        marked = neighbours(tagged, keys, bucket, order, [state, "_row"])
    start = F.col("prev__row").isNull() | ~F.col(state).eqNullSafe(F.col(f"prev_{state}"))
    marked = marked.withColumn("_start", start.cast("int"))
    if bucket is None:
        numbered = marked.withColumn("run_id", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        numbered = running(marked, keys, bucket, order, sums={"run_id": "_start"})
    return numbered.groupBy(*keys, "run_id").agg(
        F.first(state).alias(state),
        F.min(order[0]).alias("run_start"),
        F.max(order[0]).alias("run_end"),
        F.count(F.lit(1)).alias("run_length"),
    )


def range_mean(readings: DataFrame, value: str, seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """Mean over the closed time range [t - seconds, t] of each meter.

    Each meter is cut into time buckets of at least the range's width; a row also goes to the next bucket as
    history, so a window never spans more than two buckets and every frame is whole.
    """
    width = max(bucket_seconds or seconds, seconds)
    at = F.unix_micros(F.col("timestamp"))
    own = F.floor(at / (width * 1_000_000))
    rows = readings.withColumns({"_at": at, "_own": own}).withColumn("_b", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("meter_id", "_b").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = rows.withColumns({"range_mean": F.avg(value).over(w), "range_rows": F.count(F.lit(1)).over(w)})
    return out.where(F.col("_b") == F.col("_own")).drop("_at", "_own", "_b")
