"""Anomaly scores, thresholds, urgency and pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scaling import quantiles
from meterlake.operators.joins import with_peers


def daily_vectors(hourly: DataFrame, meters: DataFrame) -> DataFrame:
    """29 numbers per meter and day: 24 hours, load factor, night ratio, peer z, last day-over-day change, flatline."""
    slots = hourly.select("meter_id", "hour_ts", "kwh")
    old = slots.select("meter_id", (F.col("hour_ts") + F.expr("INTERVAL 24 HOURS")).alias("hour_ts"), F.col("kwh").alias("_old"))
    rows = with_peers(slots, meters).join(old, ["meter_id", "hour_ts"], "left")
    x = F.col("kwh")
    h = F.hour("hour_ts")
    night = (h >= 22) | (h < 6)
    delta = F.when(F.col("_old") > 0, (x - F.col("_old")) / F.col("_old"))
    cells = [F.avg(F.when(h == i, x)) for i in range(24)] + [
        F.when(F.max("kwh") > 0, F.avg("kwh") / F.max("kwh")),
        F.sum(F.when(night, x).otherwise(0.0)) / (F.sum(F.when(night, 0.0).otherwise(x)) + 1e-5),
        F.avg("z_vs_peer"),
        F.max_by(delta, F.when(delta.isNotNull(), F.col("hour_ts"))),
        F.when(F.stddev("kwh") < 0.01, 1.0),
    ]
    agg = rows.groupBy("meter_id", F.to_date("hour_ts").alias("date")).agg(
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in cells]).alias("vector")
    )
    return agg


def threshold(scores: DataFrame, column: str, share: float = 0.99) -> Column:
    """Exact quantile of the scores of normal rows, as a scalar."""
    return quantiles(scores, [], column, {"q": share}).scalar()


def sigmoid_around(score: Column, cut: Column, slope: float = 5.0) -> Column:
    return 1 / (1 + F.exp(-(score - cut) * slope))


def sigmoid_relative(score: Column, cut: Column) -> Column:
    return 1 / (1 + F.exp(-(score - cut) / (cut * 0.5 + 1e-8)))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    ends = df.groupBy().agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    return df.withColumn(out, (F.col(column) - ends["lo"]) / (ends["hi"] - ends["lo"] + 1e-9))


def blend(supervised: Column, isolation: Column) -> Column:
    return supervised * 0.7 + isolation * 0.3


def urgency(p: Column, peer_mean: Column, kwh: Column, days: Column, slots_per_day: int = 96, tariff: float = 6.5) -> Column:
    """Probability times the log of the estimated loss since onset."""
    stolen = F.greatest(peer_mean - kwh, F.lit(0.0)) * slots_per_day
    return p * F.log1p(stolen * F.coalesce(days, F.lit(30.0)) * tariff)


def service_urgency(df: DataFrame) -> DataFrame:
    impact = F.coalesce("estimated_daily_loss_inr", F.col("estimated_loss_units") * 8)
    return df.withColumns(
        {"revenue_impact": impact, "urgency_score": F.col("anomaly_score") * F.greatest(F.lit(1.0), impact) * 10}
    )


def sigma_flags(df: DataFrame, keys: list[str], column: str, sigmas: float = 3.0) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev(column).alias("_s"))
    x = F.col(column)
    return df.join(stats, keys, "left").withColumn(
        "sigma_outlier", (x > F.col("_m") + sigmas * F.col("_s")) | (x < F.col("_m") - sigmas * F.col("_s"))
    ).drop("_m", "_s")


def fence_flags(df: DataFrame, keys: list[str], column: str, width: float = 1.5) -> DataFrame:
    q = quantiles(df, keys, column, {"_q1": 0.25, "_q3": 0.75}, cuts=16)
    gap = F.col("_q3") - F.col("_q1")
    x = F.col(column)
    return df.join(q, keys, "left").withColumn(
        "fence_outlier", (x > F.col("_q3") + width * gap) | (x < F.col("_q1") - width * gap)
    ).drop("_q1", "_q3")


def pattern(df: DataFrame) -> DataFrame:
    """First matching rule names the kind of anomaly; absent evidence counts as false.

    The load factor is rounded, so that a peak of exactly twice the mean does not hang on the order of a sum.
    """

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    kind = (
        F.when(yes(F.col("rollback")), "clock_fraud")
        .when(yes(F.col("power_factor") > 1), "phase_reversal")
        .when(yes(F.col("flatline")), "flatline")
        .when(yes((F.col("drop_ratio") > 0.8) & (F.round("load_factor", 12) < 0.5)), "bypass")
        .when(yes(F.col("peer_z") < -0.8), "slowdown")
        .when(yes(F.col("loss_ratio") > 0.08), "illegal_extension")
        .otherwise("unknown")
    )
    return df.withColumn("anomaly_kind", kind)


def sweep(df: DataFrame, score: str, label: str, steps: int = 20) -> DataFrame:
    """Alerts, precision and recall per cut. One pass counts rows per step; cuts add up the few step rows."""
    step = F.least(F.floor(F.col(score) * steps + F.lit(1e-9)), F.lit(steps)).cast("int")
    per = df.groupBy(step.alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    cut = per.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    above = F.col("_s") >= F.col("cut")
    n, p = F.sum(F.when(above, F.col("_n")).otherwise(0)), F.sum(F.when(above, F.col("_p")).otherwise(0))
    return cut.groupBy("cut").agg(
        n.alias("alerts"), F.try_divide(p, n).alias("precision"), F.try_divide(p, F.sum("_p")).alias("recall")
    ).withColumn("cut", F.col("cut") / steps)
