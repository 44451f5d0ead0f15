"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.features import OPEN_STATES, risk_from_load, risk_rank

HOURS = [f"h{h:02d}" for h in range(24)]


def hour_pivot(readings: DataFrame) -> DataFrame:
    """Mean kwh per hour of day as 24 columns per meter and day; a missing hour is 0."""
    hour = F.hour("timestamp")
    cells = [F.coalesce(F.avg(F.when(hour == h, F.col("kwh"))), F.lit(0.0)).alias(c) for h, c in enumerate(HOURS)]
    return readings.groupBy("meter_id", F.to_date("timestamp").alias("date")).agg(*cells)


def hourly_rollup(readings: DataFrame) -> DataFrame:
    return readings.groupBy("meter_id", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.avg("kwh").alias("avg_kwh"),
        F.sum("kwh").alias("total_kwh"),
        F.max("kwh").alias("peak_kwh"),
        F.min("kwh").alias("min_kwh"),
        F.stddev("kwh").alias("std_kwh"),
        F.count(F.lit(1)).alias("reading_count"),
        F.count_if(F.col("kwh").isNull() | (F.col("communication_status") > 0)).alias("imputed_count"),
    )


def daily_features(readings: DataFrame) -> DataFrame:
    return readings.groupBy("meter_id", F.to_date("timestamp").alias("date")).agg(
        F.sum("kwh").alias("total_kwh"),
        F.avg("kwh").alias("avg_kwh"),
        F.max("kwh").alias("max_kwh"),
        F.avg("voltage_v").alias("avg_voltage"),
        F.avg("kvah").alias("avg_kvah"),
        F.avg("anomaly_score").alias("avg_score"),
        F.avg((F.col("communication_status") == 0).cast("double")).alias("comms_ok_ratio"),
        F.bool_or("tamper_flag").cast("int").alias("tamper_any"),
        F.bool_or("is_theft_flag").cast("int").alias("theft_label"),
        (F.max("kwh") - F.avg("kwh")).alias("flatline_score"),
    )


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status").isin(*OPEN_STATES))


def latest_metric(perf: DataFrame) -> DataFrame:
    """Newest row per model and metric, by an aggregate."""
    return perf.groupBy("model_name", "metric_type").agg(
        F.max_by(F.struct("metric_value", "feature_drift_psi", "evaluation_date"), "evaluation_date").alias("m")
    ).select("model_name", "metric_type", "m.*")


def precision_at_50(perf: DataFrame, feedback: DataFrame, names: tuple[str, ...] = ("TheftDetect", "Ensemble")) -> DataFrame:
    """Mean precision on the newest date, of the named detectors if any, else of all; else TP / (TP + FP)."""
    rows = perf.where(F.col("metric_type") == "precision")
    named = F.lit(False)
    for n in names:
        named = named | F.contains(F.col("model_name"), F.lit(n))
    # one aggregate per (named, date), then the newest date of the preferred kind: two small steps, no join
    per_date = rows.groupBy(named.alias("named"), "evaluation_date").agg(F.sum("metric_value").alias("s"), F.count(F.lit(1)).alias("n"))
    chosen = per_date.groupBy().agg(
        F.max_by(F.struct("s", "n"), F.when(F.col("named"), F.col("evaluation_date"))).alias("p"),
        F.max(F.when(F.col("named"), F.col("evaluation_date"))).alias("p_date"),
    )
    all_dates = rows.groupBy("evaluation_date").agg(F.avg("metric_value").alias("a")).groupBy().agg(
        F.max_by("a", "evaluation_date").alias("a")
    )
    fb = feedback.groupBy().agg(
        F.count_if(F.col("feedback_type") == "true_positive").alias("tp"),
        F.count_if(F.col("feedback_type") == "false_positive").alias("fp"),
    )
    fallback = fb.select(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).scalar()
    return chosen.select(
        F.coalesce(
            F.when(F.col("p_date").isNotNull(), F.col("p.s") / F.col("p.n")), all_dates.scalar(), fallback
        ).alias("precision_at_50")
    )


def kpis(v) -> DataFrame:
    """One row of totals; each table is aggregated once and read as scalar subqueries."""
    a = v.alerts.groupBy().agg(
        F.count_if(F.col("status").isin(*OPEN_STATES)).alias("open_alerts"),
        F.count_if(F.col("status").isin(*OPEN_STATES) & (F.col("severity") == "Critical")).alias("critical_alerts"),
        F.count_if(F.col("status") == "Resolved").alias("resolved_alerts"),
        F.count_if(F.col("status") == "False Positive").alias("false_positive_alerts"),
        F.sum(F.when(F.col("status").isin(*OPEN_STATES), F.col("estimated_loss_units") * 8)).alias("revenue_at_risk"),
    )
    meters = v.meters.groupBy().agg(F.count(F.lit(1))).scalar()
    r = v.readings.groupBy().agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if("is_theft_flag").alias("theft")).alias("r")
    ).scalar()
    mape = v.forecasts.orderBy(F.desc("forecast_date"), F.desc("zone")).limit(500).groupBy().agg(F.avg("mape_pct") / 100).scalar()
    fines = v.audits.groupBy().agg(F.sum("fine_inr")).scalar()
    return a.select(
        "*",
        meters.alias("meters_monitored"),
        r["n"].alias("readings"),
        r["theft"].alias("theft_rows"),
        mape.alias("forecast_mape"),
        fines.alias("recovered"),
    )


def zone_summary(meters: DataFrame, alerts: DataFrame, loads: DataFrame) -> DataFrame:
    """Risk, open alerts, losses, load and centroid per zone; ``loads`` holds one row per feeder."""
    m = meters.groupBy("zone").agg(
        F.count(F.lit(1)).alias("meter_count"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")
    )
    a = open_alerts(alerts).groupBy("zone").agg(F.count(F.lit(1)).alias("open_alerts"))
    f = loads.groupBy("zone").agg(
        F.avg("load_pct").alias("load_pct"), F.avg("loss_pct").alias("feeder_loss_pct"), F.count(F.lit(1)).alias("feeder_count")
    )
    zero = F.lit(0)
    out = m.join(a, "zone", "left").join(f, "zone", "left").withColumns(
        {
            "open_alerts": F.coalesce("open_alerts", zero),
            "feeder_count": F.coalesce("feeder_count", zero),
            "load_pct": F.coalesce("load_pct", F.lit(0.0)),
            "feeder_loss_pct": F.coalesce("feeder_loss_pct", F.lit(0.0)),
        }
    )
    return out.withColumns(
        {
            "risk": risk_from_load(F.col("load_pct")),
            "loss_pct": F.greatest(F.lit(1.5), F.col("open_alerts") / F.greatest(F.lit(1), "meter_count") * 25),
        }
    )


def by_risk(zones: DataFrame) -> DataFrame:
    return zones.orderBy(F.desc(risk_rank(F.col("risk"))), F.desc("open_alerts"), F.asc("zone"))


def feeder_loads(topology: DataFrame, hourly: DataFrame, feeder: DataFrame) -> DataFrame:
    """Per feeder: rated capacity, mean metered energy per hour with input, load and loss percent."""
    billed = hourly.select("meter_id", "kwh").groupBy("meter_id").agg(F.sum("kwh").alias("kwh"))
    t = topology.select("meter_id", "zone", "feeder_id", "substation_id", "transformer_rated_kva")
    cap = (
        t.join(billed, "meter_id", "left")
        .groupBy("zone", "substation_id", "feeder_id")
        .agg(
            F.sum("transformer_rated_kva").alias("capacity_kva"),
            F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("metered_kwh"),
            F.count(F.lit(1)).alias("meter_count"),
        )
    )
    inp = feeder.groupBy("feeder_id").agg(F.sum("feeder_input_kwh").alias("input_kwh"), F.count(F.lit(1)).alias("hours"))
    out = cap.join(inp, "feeder_id", "left")
    return out.withColumns(
        {
            "load_pct": F.coalesce(F.col("input_kwh") / F.col("hours") / F.col("capacity_kva") * 1000, F.lit(0.0)),
            "loss_pct": F.coalesce(
                F.when(F.col("input_kwh") > 0, (F.col("input_kwh") - F.col("metered_kwh")) / F.col("input_kwh") * 100), F.lit(0.0)
            ),
        }
    )


def grid_rollup(meters: DataFrame, usage: DataFrame) -> DataFrame:
    """Meters and energy for every level of substation, zone, feeder, transformer, with subtotals."""
    rows = meters.join(usage, "meter_id", "left")
    return rows.rollup("substation_id", "zone", "feeder_id", "transformer_id").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("meters"), F.sum("kwh").alias("kwh")
    )
