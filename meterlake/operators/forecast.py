"""Zone demand forecasts: features, intervals, errors, scenarios and risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from meterlake.functions.scaling import quantiles, running

EARTH_KM = 6371.0  # fixed value


def _by_zone() -> Window:
    """One row per zone and day (or slot): the calendar bounds each partition."""
    return Window.partitionBy("zone").orderBy("forecast_date")


def zone_lags(forecasts: DataFrame) -> DataFrame:
    """Previous actual and forecast of the zone; a zone's first row takes the overall median."""
    mid_a = quantiles(forecasts, [], "actual_mw", {"m": 0.5}).scalar()
    mid_f = quantiles(forecasts, [], "forecast_mw", {"m": 0.5}).scalar()
    w = _by_zone()
    return forecasts.withColumns(
        {
            "lag_actual": F.coalesce(F.lag("actual_mw").over(w), mid_a),
            "lag_forecast": F.coalesce(F.lag("forecast_mw").over(w), mid_f),
        }
    )


def forecast_features(forecasts: DataFrame) -> DataFrame:
    """Calendar parts, zone lags and the previous row's error; nothing that knows the target of its own row."""
    rows = zone_lags(forecasts)
    return rows.withColumns(
        {
            "month": F.month("forecast_date"),
            "dayofweek": F.dayofweek("forecast_date"),
            "day": F.dayofmonth("forecast_date"),
            "lag_error": F.col("lag_forecast") - F.col("lag_actual"),
        }
    )


def coarse(df: DataFrame, key: str) -> Column:
    """A value that never falls as ``key`` rises, with few distinct ones: thousands of a number, the head of a text."""
    if isinstance(df.schema[key].dataType, NumericType):
        return F.floor(F.col(key) / 4096)
    return F.substring(F.col(key).cast("string"), 1, 4)


def time_split(df: DataFrame, date: str, keys: list[str], share: float = 0.8, least: int = 20) -> DataFrame:
    """First ``share`` of the rows in (date, keys) order as training rows; numbered without a global sort.

    ``is_calibration`` marks the last stretch of the training rows, as long as what follows them. The rows of a date
    are cut further by ranges of the first key, so that a day of millions of meters is many tasks.
    """
    bucket = F.struct(F.col(date), coarse(df, keys[0])) if keys else F.col(date)
    numbered = running(df, [], bucket, [date, *keys], number="_i")
    total = df.groupBy().agg(F.count(F.lit(1))).scalar()
    cut = F.greatest(F.lit(least), F.floor(total * F.lit(share)))
    train = F.col("_i") <= cut
    marks = {"is_train": train, "is_calibration": train & (F.col("_i") > 2 * cut - total)}
    return numbered.withColumns(marks).withColumnRenamed("_i", "position")


def conformal_pads(calibration: DataFrame, actual: str, forecast: str, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """Quantiles of the absolute residual, overall or per key."""
    rows = calibration.withColumn("_r", F.abs(F.col(actual) - F.col(forecast)))
    return quantiles(rows, keys, "_r", levels)


def intervals(df: DataFrame, forecast: str, pad: Column, name: str) -> DataFrame:
    return df.withColumns(
        {
            f"lower_{name}": F.greatest(F.col(forecast) - pad, F.lit(0.0)),
            f"upper_{name}": F.col(forecast) + pad,
        }
    )


def seasonal_naive(forecasts: DataFrame, days: int = 7) -> DataFrame:
    """Actual of the same zone ``days`` days before, by an equal-key join (gaps in dates stay gaps)."""
    old = forecasts.select("zone", F.date_add("forecast_date", days).alias("forecast_date"), F.col("actual_mw").alias("naive_mw"))
    return forecasts.join(old, ["zone", "forecast_date"], "left")


def decompose(forecasts: DataFrame, width: int = 7) -> DataFrame:
    """Centred moving average, mean deviation by weekday, and what is left."""
    half = width // 2
    w = _by_zone().rowsBetween(-half, half)
    rows = forecasts.withColumn("trend", F.avg("actual_mw").over(w)).withColumn("dow", F.dayofweek("forecast_date"))
    season = rows.groupBy("zone", "dow").agg(F.avg(F.col("actual_mw") - F.col("trend")).alias("seasonal"))
    out = rows.join(season, ["zone", "dow"])
    return out.withColumn("residual", F.col("actual_mw") - F.col("trend") - F.col("seasonal"))


def walk_forward(df: DataFrame, date: str, folds: int = 3, train_days: int = 30, val_days: int = 7) -> DataFrame:
    """Each row once per fold it belongs to, as train or validation; folds with too little history are left out.

    Dates are numbered on the table of distinct dates, whose size is the calendar.
    """
    dates = df.select(date).distinct()
    numbered = running(dates, [], F.trunc(date, "month"), [date], number="_d")
    total = dates.groupBy().agg(F.count(F.lit(1))).scalar()
    numbered = numbered.withColumn("_total", total)
    fold = F.explode(F.array(*[F.lit(i) for i in range(folds)]))
    spread = numbered.withColumn("_f", fold)
    end = F.col("_total") - (folds - F.col("_f") - 1) * val_days
    begin = end - val_days
    spread = spread.withColumn(
        "part", F.when(F.col("_d") <= begin, "train").when(F.col("_d") <= end, "validation")
    ).where((begin >= train_days) & F.col("part").isNotNull())
    return df.join(spread.select(date, (F.col("_f") + 1).alias("fold"), "part"), date)


def fold_errors(folds: DataFrame, forecast: str) -> DataFrame:
    """MAPE per fold with mean and population deviation over the folds."""
    ape = F.abs(F.greatest(F.col("actual_mw"), F.lit(1e-5)) - F.greatest(F.col(forecast), F.lit(0.0))) / F.greatest(
        F.col("actual_mw"), F.lit(1e-5)
    )
    per = folds.where((F.col("part") == "validation") & F.col(forecast).isNotNull()).groupBy("fold").agg(
        F.avg(ape).alias("mape"), F.count(F.lit(1)).alias("rows")
    )
    stats = per.groupBy().agg(F.struct(F.avg("mape").alias("m"), F.stddev_pop("mape").alias("s"))).scalar()
    return per.withColumns({"mean_mape": stats["m"], "std_mape": stats["s"]})


def ensemble(members: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-error weighted mean of ``forecast`` per key; the weight of a model is 1 over its own mean error."""
    skill = members.groupBy("model_name").agg(F.avg(F.abs(F.col("actual_mw") - F.col("forecast"))).alias("_e"))
    rows = members.join(skill.select("model_name", F.try_divide(F.lit(1.0), F.col("_e")).alias("_w")), "model_name")
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_w") * F.col("forecast")), F.sum("_w")).alias("ensemble_mw"), F.count(F.lit(1)).alias("members")
    )


def scenario_factor(temperature_delta: float, industrial: float, holiday: bool) -> float:
    """Fixed sensitivities: 1.2 % per degree, 35 % of the industrial change, 8 % off on holidays."""
    return 1 + 0.012 * temperature_delta + 0.35 * (industrial - 1) - (0.08 if holiday else 0.0)


def scenario(points: DataFrame, temperature_delta: float, industrial: float, holiday: bool) -> DataFrame:
    m = scenario_factor(temperature_delta, industrial, holiday)
    return points.withColumns({"scenario_mw": F.col("forecast_mw") * m, "delta_pct": F.lit((m - 1) * 100)})


def forecast_points(forecasts: DataFrame, rows: int = 24) -> DataFrame:
    """Newest rows in ascending order with 90 and 99 bands; missing outer bands come from the inner ones."""
    newest = forecasts.orderBy(F.desc("forecast_date"), F.desc("zone")).limit(rows)
    have = set(forecasts.columns)
    low99 = F.col("p5_mw") if "p5_mw" in have else F.lit(None).cast("double")
    high99 = F.col("p95_mw") if "p95_mw" in have else F.lit(None).cast("double")
    return newest.select(
        "zone",
        "forecast_date",
        "actual_mw",
        "forecast_mw",
        F.col("p10_mw").alias("lower90"),
        F.col("p90_mw").alias("upper90"),
        F.coalesce(low99, F.col("p10_mw") * 0.94).alias("lower99"),
        F.coalesce(high99, F.col("p90_mw") * 1.06).alias("upper99"),
        F.coalesce("p50_mw", "forecast_mw").alias("p50"),
    ).orderBy("forecast_date", "zone")


def week_expansion(points: DataFrame, every: int = 4, days: int = 7) -> DataFrame:
    """Every ``every``-th of the few points, repeated for each day; the hour is the running index modulo 24."""
    w = Window.orderBy("forecast_date", "zone")  # at most a few dozen points
    base = points.groupBy().agg(F.max("forecast_date")).scalar()
    picked = points.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % every == 0)
    per_day = points.groupBy().agg(F.ceil(F.count(F.lit(1)) / every)).scalar()
    rows = picked.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    index = F.col("day") * per_day + F.floor(F.col("_i") / every)
    hours = (F.col("day") * 24 + index % 24).cast("int")
    stamp = base.cast("timestamp") + F.make_dt_interval(F.lit(0), hours)
    return rows.withColumns({"timestamp": stamp, "point": index}).drop("_i")


def zone_risk(forecasts: DataFrame, capacity: DataFrame) -> DataFrame:
    """Risk per zone and day from capacity share, surge over the week's mean, band width and trend."""
    w = _by_zone()
    week = F.avg("actual_mw").over(w.rowsBetween(-7, -1))
    before = F.lag("forecast_mw").over(w)
    rows = forecasts.withColumns({"week_mean": week, "_rise": F.col("forecast_mw") > before}).join(capacity, "zone")
    share = F.col("forecast_mw") / F.col("capacity_mw")
    wide = (F.col("p90_mw") - F.col("p10_mw")) > 0.2 * F.col("forecast_mw")
    risk = (
        F.when(share > 0.95, "Critical")
        .when((share > 0.80) | (F.col("forecast_mw") > 1.15 * F.col("week_mean")), "High")
        .when(wide & F.col("_rise"), "Medium")
        .otherwise("Normal")
    )
    return rows.withColumns({"capacity_share": share, "risk": risk}).drop("_rise")


def summary(points: DataFrame) -> DataFrame:
    return points.groupBy().agg(
        F.count(F.lit(1)).alias("points"),
        F.max("forecast_mw").alias("peak_forecast_mw"),
        F.max_by("forecast_date", F.struct("forecast_mw", "forecast_date")).alias("peak_date"),
        F.avg(F.col("upper90") - F.col("lower90")).alias("mean_band_width_mw"),
        F.avg(F.abs(F.col("actual_mw") - F.col("forecast_mw"))).alias("mean_abs_gap_mw"),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * (rad / 2)), F.lit(2.0)) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(
        F.sin((lon2 - lon1) * (rad / 2)), F.lit(2.0)
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))
