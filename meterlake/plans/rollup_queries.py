"""Aggregations and reports (F); sorts, top-k, pages and set operations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import features, forecast, joins, ranking, rollup
from meterlake.plans import reports
from meterlake.plans.catalog import query
from meterlake.plans.join_queries import FLAGS, HOUR_COLS, PIVOT_SQL, current_topology
from meterlake.plans.window_queries import NIGHT

OPEN = "status IN ('Open', 'Investigating')"

REPORT = {
    **FLAGS,
    "billed": ("hourly", "SELECT meter_id, sum(kwh) AS kwh FROM hourly GROUP BY 1"),
    "loads": (
        "billed topology feeder_readings",
        """SELECT c.*, coalesce(input_kwh / hours / capacity_kva * 1000, 0) AS load_pct, input_kwh, hours,
        coalesce(CASE WHEN input_kwh > 0 THEN (input_kwh - metered_kwh) / input_kwh * 100 END, 0) AS loss_pct FROM (
        SELECT zone, substation_id, feeder_id, sum(transformer_rated_kva) AS capacity_kva, coalesce(sum(kwh), 0) AS metered_kwh, count(*) AS meter_count
        FROM (SELECT * FROM topology WHERE valid_to IS NULL) t LEFT JOIN billed b ON b.meter_id = t.meter_id GROUP BY 1, 2, 3) c
        LEFT JOIN (SELECT feeder_id, sum(feeder_input_kwh) AS input_kwh, count(*) AS hours FROM feeder_readings GROUP BY 1) f ON f.feeder_id = c.feeder_id""",
    ),
    "zones": (
        "meters alerts loads",
        f"""SELECT *, CASE WHEN load_pct >= 90 THEN 'Critical' WHEN load_pct >= 75 THEN 'High' WHEN load_pct >= 60 THEN 'Medium' ELSE 'Normal' END AS risk,
        greatest(1.5, open_alerts / greatest(1, meter_count) * 25) AS loss_pct FROM (
        SELECT m.zone, meter_count, lat, lon, coalesce(a.n, 0) AS open_alerts, coalesce(l.load_pct, 0) AS load_pct,
        coalesce(l.loss_pct, 0) AS feeder_loss_pct, coalesce(l.n, 0) AS feeder_count
        FROM (SELECT zone, count(*) AS meter_count, avg(latitude) AS lat, avg(longitude) AS lon FROM meters GROUP BY 1) m
        LEFT JOIN (SELECT zone, count(*) AS n FROM alerts WHERE {OPEN} GROUP BY 1) a ON a.zone = m.zone
        LEFT JOIN (SELECT zone, avg(load_pct) AS load_pct, avg(loss_pct) AS loss_pct, count(*) AS n FROM loads GROUP BY 1) l ON l.zone = m.zone)""",
    ),
    "points": (
        "forecasts",
        """SELECT zone, forecast_date, actual_mw, forecast_mw, p10_mw AS lower90, p90_mw AS upper90, p10_mw * 0.94E0 AS lower99,
        p90_mw * 1.06E0 AS upper99, p50_mw AS p50 FROM forecasts ORDER BY forecast_date DESC, zone DESC LIMIT 24""",
    ),
}


def loads(v):
    return rollup.feeder_loads(current_topology(v), v.hourly, v.feeder_readings)


def zones(v):
    return rollup.zone_summary(v.meters, v.alerts, loads(v))


@query(
    "f1_calendar_pivot",
    "date:s is_national_holiday:b is_state_holiday:b is_holiday:b is_shutdown:b is_ugadi:b is_deepawali:b is_ipl_evening:b total_demand_impact:d readings:i",
    """SELECT f.*, readings FROM flags f JOIN (SELECT CAST(timestamp AS DATE) AS date, count(*) AS readings FROM readings GROUP BY 1) r ON r.date = f.date""",
    "flags readings",
    FLAGS,
)
def _(v):
    n = v.readings.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("readings"))
    return joins.calendar_flags(v.calendar).join(n, "date")


@query(
    "f2_peer_statistics",
    "peer_cluster_id:i hour_ts:s peer_mean:d peer_std:d peer_median:d median_exact:d",
    """SELECT peer_cluster_id, hour_ts, avg(kwh) AS peer_mean, stddev(kwh) AS peer_std, quantile_disc(kwh, 0.5) AS peer_median,
    median(kwh) AS median_exact FROM hourly JOIN meters USING (meter_id) WHERE peer_cluster_id IS NOT NULL GROUP BY 1, 2""",
    "hourly meters",
)
def _(v):
    from meterlake.functions.scaling import quantiles

    stats = joins.peer_statistics(v.hourly, v.meters)
    rows = v.hourly.join(v.meters.select("meter_id", "peer_cluster_id"), "meter_id").where(F.col("peer_cluster_id").isNotNull())
    exact = quantiles(rows.select("peer_cluster_id", "hour_ts", "kwh"), ["peer_cluster_id", "hour_ts"], "kwh", {"median_exact": 0.5}, cuts=8)
    return stats.join(exact, ["peer_cluster_id", "hour_ts"], "left")


@query(
    "f3_feeder_billed",
    "feeder_id hour_ts:s feeder_billed_kwh:d",
    "SELECT feeder_id, hour_ts, sum(kwh) AS feeder_billed_kwh FROM hourly JOIN meters USING (meter_id) GROUP BY 1, 2",
    "hourly meters",
)
def _(v):
    rows = v.hourly.select("meter_id", "hour_ts", "kwh").join(v.meters.select("meter_id", "feeder_id"), "meter_id")
    return rows.groupBy("feeder_id", "hour_ts").agg(F.sum("kwh").alias("feeder_billed_kwh"))


HOURLY_ROLLUP = """SELECT meter_id, date_trunc('hour', timestamp) AS hour, avg(kwh) AS avg_kwh, sum(kwh) AS total_kwh, max(kwh) AS peak_kwh,
    min(kwh) AS min_kwh, stddev(kwh) AS std_kwh, count(*) AS reading_count,
    count(*) FILTER (kwh IS NULL OR communication_status > 0) AS imputed_count FROM readings GROUP BY 1, 2"""
HOURLY_COLS = "meter_id:i hour:s avg_kwh:d total_kwh:d peak_kwh:d min_kwh:d std_kwh:d reading_count:i imputed_count:i"


@query("f4_hourly_rollup", HOURLY_COLS, HOURLY_ROLLUP, "readings")
def _(v):
    return rollup.hourly_rollup(v.readings)


DAILY_SQL = """SELECT meter_id, CAST(timestamp AS DATE) AS date, sum(kwh) AS total_kwh, avg(kwh) AS avg_kwh, max(kwh) AS max_kwh,
    avg(voltage_v) AS avg_voltage, avg(kvah) AS avg_kvah, avg(anomaly_score) AS avg_score,
    avg(CASE WHEN communication_status = 0 THEN 1E0 ELSE 0E0 END) AS comms_ok_ratio, CAST(bool_or(tamper_flag) AS INT) AS tamper_any,
    CAST(bool_or(is_theft_flag) AS INT) AS theft_label, max(kwh) - avg(kwh) AS flatline_score FROM readings GROUP BY 1, 2"""


@query(
    "f5_daily_features",
    "meter_id:i date:s total_kwh:d avg_kwh:d max_kwh:d avg_voltage:d avg_kvah:d avg_score:d comms_ok_ratio:d tamper_any:i theft_label:i flatline_score:d",
    DAILY_SQL,
    "readings",
)
def _(v):
    return rollup.daily_features(v.readings)


@query(
    "f6_hour_pivot",
    "meter_id:i date:s " + " ".join(f"{c}:d" for c in HOUR_COLS),
    f"SELECT meter_id, CAST(timestamp AS DATE) AS date, {PIVOT_SQL} FROM readings GROUP BY 1, 2",
    "readings",
)
def _(v):
    return rollup.hour_pivot(v.readings)


VEC = [f"x{i:02d}" for i in range(29)]
VEC_SQL = ", ".join(f"coalesce(avg(kwh) FILTER (hour(hour_ts) = {h}), 0) AS x{h:02d}" for h in range(24))


@query(
    "f7_daily_vector",
    "meter_id:i date:s " + " ".join(f"{c}:d5" for c in VEC),
    f"""SELECT meter_id, CAST(hour_ts AS DATE) AS date, {VEC_SQL},
    coalesce(CASE WHEN max(kwh) > 0 THEN avg(kwh) / max(kwh) END, 0) AS x24,
    coalesce(sum(CASE WHEN {NIGHT} THEN kwh ELSE 0 END) / (sum(CASE WHEN {NIGHT} THEN 0 ELSE kwh END) + 1E-5), 0) AS x25,
    coalesce(avg(z_vs_peer), 0) AS x26, coalesce(arg_max(delta, hour_ts), 0) AS x27, CAST(coalesce(stddev(kwh) < 0.01, false) AS INT) AS x28
    FROM (SELECT p.*, CASE WHEN q.kwh > 0 THEN (p.kwh - q.kwh) / q.kwh END AS delta FROM with_peers p
    LEFT JOIN hourly q ON q.meter_id = p.meter_id AND q.hour_ts = p.hour_ts - INTERVAL 24 HOUR) GROUP BY 1, 2""",
    "with_peers hourly",
    FLAGS,
)
def _(v):
    from meterlake.operators.anomaly import daily_vectors

    rows = daily_vectors(v.hourly, v.meters)
    return rows.select("meter_id", "date", *[F.col("vector")[i].alias(c) for i, c in enumerate(VEC)])


@query(
    "f8_kpi_row",
    "open_alerts:i critical_alerts:i resolved_alerts:i false_positive_alerts:i revenue_at_risk:d4 meters_monitored:i readings:i theft_rows:i forecast_mape:d recovered:d4",
    f"""SELECT count(*) FILTER ({OPEN}) AS open_alerts, count(*) FILTER ({OPEN} AND severity = 'Critical') AS critical_alerts,
    count(*) FILTER (status = 'Resolved') AS resolved_alerts, count(*) FILTER (status = 'False Positive') AS false_positive_alerts,
    sum(estimated_loss_units * 8) FILTER ({OPEN}) AS revenue_at_risk, (SELECT count(*) FROM meters) AS meters_monitored,
    (SELECT count(*) FROM readings) AS readings, (SELECT count(*) FROM readings WHERE is_theft_flag) AS theft_rows,
    (SELECT avg(mape_pct) / 100 FROM (SELECT mape_pct FROM forecasts ORDER BY forecast_date DESC, zone DESC LIMIT 500)) AS forecast_mape,
    (SELECT sum(fine_inr) FROM audits) AS recovered FROM alerts""",
    "alerts meters readings forecasts audits",
)
def _(v):
    return rollup.kpis(v)


@query(
    "f9_precision_at_50",
    "precision_at_50:d",
    """SELECT avg(metric_value) AS precision_at_50 FROM model_perf WHERE metric_type = 'precision'
    AND evaluation_date = (SELECT max(evaluation_date) FROM model_perf WHERE metric_type = 'precision')""",
    "model_perf",
)
def _(v):
    return rollup.precision_at_50(v.model_perf, v.feedback)


ZONE_COLS = "zone risk open_alerts:i loss_pct:d9 feeder_loss_pct:d load_pct:d meter_count:i feeder_count:i lat:d9 lon:d9"


@query("f10_zone_summary", ZONE_COLS, "SELECT * FROM zones", "zones", REPORT)
def _(v):
    return zones(v)


@query(
    "f11_quality_by_zone",
    "zone freshness:s missing_pct:d quality_score:d status",
    """SELECT zone, max(date) AS freshness, avg(missing_readings) / 24 * 100 AS missing_pct, avg(quality_score) AS quality_score,
    CASE WHEN avg(quality_score) >= 0.85 THEN 'OK' ELSE 'Audit' END AS status FROM data_quality GROUP BY 1 ORDER BY zone LIMIT 10""",
    "data_quality",
)
def _(v):
    from meterlake.operators.quality import quality_by_zone

    return quality_by_zone(v.data_quality).orderBy("zone").limit(10)


@query(
    "f12_quality_trend",
    "date:s quality:d completeness:d missing:d psi:d8 status",
    """SELECT q.*, coalesce(psi, 0) AS psi, CASE WHEN coalesce(psi, 0) > 0.25 THEN 'DRIFT_RISK' ELSE 'OK' END AS status FROM (
    SELECT date, avg(quality_score) AS quality, avg(received_readings * 100E0 / expected_readings) AS completeness, avg(missing_readings) AS missing
    FROM data_quality GROUP BY 1 ORDER BY date DESC LIMIT 90) q
    LEFT JOIN (SELECT evaluation_date + INTERVAL 27 YEAR AS d, avg(feature_drift_psi) AS psi FROM model_perf WHERE metric_type = 'mape_pct' GROUP BY 1) p ON p.d = q.date""",
    "data_quality model_perf",
)
def _(v):
    from meterlake.operators.quality import quality_trend

    # metric rows of the sample end long before its readings: move them to the readings' years
    perf = v.model_perf.withColumn("evaluation_date", F.add_months("evaluation_date", 27 * 12))
    return quality_trend(v.data_quality, perf)


@query(
    "f13_revenue_trend",
    "date:s recovery:d4 meters:i actions:i cumulative:d4",
    """SELECT *, sum(recovery) OVER (ORDER BY date) AS cumulative FROM (
    SELECT CAST(action_timestamp AS DATE) AS date, sum(fine_inr) AS recovery, count(DISTINCT meter_id) AS meters, count(*) AS actions
    FROM audits GROUP BY 1 ORDER BY date DESC LIMIT 120)""",
    "audits",
)
def _(v):
    from meterlake.functions.scaling import running

    d = v.audits.groupBy(F.to_date("action_timestamp").alias("date")).agg(
        F.sum("fine_inr").alias("recovery"), F.countDistinct("meter_id").alias("meters"), F.count(F.lit(1)).alias("actions")
    )
    newest = d.orderBy(F.desc("date")).limit(120)
    return running(newest, [], F.date_trunc("month", "date"), ["date"], sums={"cumulative": "recovery"})


@query(
    "f13_revenue_by_zone_and_inspector",
    "kind name value:d4",
    """SELECT * FROM (SELECT 'zone' AS kind, zone AS name, sum(fine_inr) AS value FROM audits GROUP BY 2 ORDER BY value DESC, name LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'inspector', CAST(inspector_id AS VARCHAR) AS name, sum(fine_inr) AS value FROM audits GROUP BY 2 ORDER BY value DESC, name LIMIT 10)""",
    "audits",
)
def _(v):
    def best(kind, column):
        name = F.col(column).cast("string")
        g = v.audits.groupBy(name.alias("name")).agg(F.sum("fine_inr").alias("value"))
        return g.orderBy(F.desc("value"), F.asc("name")).limit(10).select(F.lit(kind).alias("kind"), "name", "value")

    return best("zone", "zone").unionByName(best("inspector", "inspector_id"))


@query(
    "f14_usage_heatmap",
    "meter_id:i day:i hour:i kwh:d z_score:d5",
    """SELECT meter_id, dayofweek(hour_ts) + 1 AS day, hour(hour_ts) AS hour, avg(kwh) AS kwh, avg(z_vs_peer) AS z_score FROM (
    SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY hour_ts DESC) AS rn FROM with_peers) WHERE rn <= 240 GROUP BY 1, 2, 3""",
    "with_peers",
    FLAGS,
)
def _(v):
    rows = joins.with_peers(v.hourly.select("meter_id", "hour_ts", "kwh"), v.meters)
    recent = ranking.top_per_key(rows, ["meter_id"], [F.desc("hour_ts")], 240)
    return recent.groupBy("meter_id", F.dayofweek("hour_ts").alias("day"), F.hour("hour_ts").alias("hour")).agg(
        F.avg("kwh").alias("kwh"), F.avg("z_vs_peer").alias("z_score")
    )


@query(
    "f15_alert_counts",
    "model_version zone alerts:i",
    "SELECT model_version, zone, count(*) AS alerts FROM alerts GROUP BY 1, 2",
    "alerts",
)
def _(v):
    return v.alerts.groupBy("model_version", "zone").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "f16_grid_rollup",
    "substation_id zone feeder_id transformer_id level:i meters:i kwh:d4",
    """SELECT substation_id, zone, feeder_id, transformer_id, grouping_id(substation_id, zone, feeder_id, transformer_id) AS level,
    count(*) AS meters, sum(kwh) AS kwh FROM meters m LEFT JOIN billed b ON b.meter_id = m.meter_id
    GROUP BY ROLLUP (substation_id, zone, feeder_id, transformer_id)""",
    "meters billed",
    REPORT,
)
def _(v):
    usage = v.readings.groupBy("meter_id").agg(F.sum("kwh").alias("kwh"))
    return rollup.grid_rollup(v.meters, usage)


@query(
    "f16_usage_cube",
    "zone tariff_category level:i meters:i kwh:d4",
    """SELECT zone, tariff_category, grouping_id(zone, tariff_category) AS level, count(*) AS meters, sum(kwh) AS kwh
    FROM meters m LEFT JOIN billed b ON b.meter_id = m.meter_id GROUP BY CUBE (zone, tariff_category)""",
    "meters billed",
    REPORT,
)
def _(v):
    usage = v.readings.groupBy("meter_id").agg(F.sum("kwh").alias("kwh"))
    rows = v.meters.join(usage, "meter_id", "left")
    return rows.cube("zone", "tariff_category").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("meters"), F.sum("kwh").alias("kwh"))


@query(
    "f17_approximate_statistics",
    "date:s readings:i distinct_ok:b median_ok:b",
    "SELECT CAST(timestamp AS DATE) AS date, count(*) AS readings, true AS distinct_ok, true AS median_ok FROM readings GROUP BY 1",
    "readings",
)
def _(v):
    """Sketches next to exact values: within 5 % of the distinct count and between the exact 45th and 55th percentile."""
    from meterlake.functions.scaling import quantiles

    day = F.to_date("timestamp").alias("date")
    bounds = quantiles(v.readings.withColumn("date", day), ["date"], "kwh", {"low": 0.45, "high": 0.55})
    # exact distinct counting needs a row per (date, meter); sketches do not, so each has its own aggregate
    per_meter = v.readings.groupBy(day, "meter_id").agg(F.count(F.lit(1)).alias("n"))
    exact = per_meter.groupBy("date").agg(F.sum("n").alias("readings"), F.count(F.lit(1)).alias("e"))
    sketch = v.readings.groupBy(day).agg(
        F.approx_count_distinct("meter_id", 0.02).alias("a"), F.percentile_approx("kwh", 0.5).alias("q")
    )
    return exact.join(sketch, "date").join(bounds, "date").select(
        "date",
        "readings",
        (F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e") + 1).alias("distinct_ok"),
        F.col("q").between(F.col("low"), F.col("high")).alias("median_ok"),
    )


@query(
    "f18_cluster_sizes",
    "clusters:i mean_size:d std_size:d smallest:i largest:i",
    """SELECT count(*) AS clusters, avg(n) AS mean_size, stddev_pop(n) AS std_size, min(n) AS smallest, max(n) AS largest FROM (
    SELECT peer_cluster_id, count(*) AS n FROM meters WHERE peer_cluster_id IS NOT NULL GROUP BY 1)""",
    "meters",
)
def _(v):
    n = v.meters.where(F.col("peer_cluster_id").isNotNull()).groupBy("peer_cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy().agg(
        F.count(F.lit(1)).alias("clusters"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"), F.min("n").alias("smallest"), F.max("n").alias("largest")
    )


@query(
    "f19_daily_completeness",
    "meter_id:i date:s expected:i received:i missing:i rows:i null_slots:i duplicates:i completeness_pct:d quality_score:d",
    """SELECT meter_id, date, expected, received, expected - received AS missing, rows, null_slots, duplicates,
    received * 100E0 / expected AS completeness_pct, greatest(0, (received - null_slots) / expected) AS quality_score FROM (
    SELECT meter_id, CAST(hour_ts AS DATE) AS date, count(*) AS expected, count(readings) AS received, coalesce(sum(readings), 0) AS rows,
    count(*) FILTER (readings IS NOT NULL AND kwh IS NULL) AS null_slots, coalesce(sum(readings - 1), 0) AS duplicates FROM grid GROUP BY 1, 2)""",
    "grid",
)
def _(v):
    from meterlake.operators.clean import completeness

    return completeness(v.grid)


@query(
    "f20_monthly_report",
    "month:s zone place:i recovered:d4 alerts:i confirmed:i fdr:d",
    """SELECT z.month, z.zone, z.place, z.recovered, a.alerts, a.confirmed, a.fp / nullif(a.confirmed + a.fp, 0) AS fdr FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(recovered, 4) DESC, zone) AS place FROM (
    SELECT date_trunc('month', action_timestamp) AS month, zone, sum(fine_inr) AS recovered FROM audits GROUP BY 1, 2)) z
    LEFT JOIN (SELECT date_trunc('month', alert_timestamp) AS month, count(*) AS alerts, count(*) FILTER (feedback_type = 'true_positive') AS confirmed,
    count(*) FILTER (feedback_type = 'false_positive') AS fp FROM alerts a LEFT JOIN feedback f ON f.alert_id = a.alert_id GROUP BY 1) a ON a.month = z.month
    WHERE place <= 10""",
    "audits alerts feedback",
)
def _(v):
    return reports.monthly_report(v.alerts, v.feedback, v.audits)


@query(
    "f21_system_status",
    "name metric rows:i",
    """SELECT 'meters' AS name, count(*) || ' meters' AS metric, count(*) AS rows FROM meters
    UNION ALL SELECT 'data_quality', count(*) || ' checks', count(*) FROM data_quality
    UNION ALL SELECT 'forecasts', 'MAPE ' || printf('%.1f', (SELECT avg(mape_pct) FROM (SELECT mape_pct FROM forecasts ORDER BY forecast_date DESC, zone DESC LIMIT 500))) || '%', count(*) FROM forecasts
    UNION ALL SELECT model_version, count(*) || ' alerts', count(*) FROM alerts GROUP BY model_version
    UNION ALL SELECT 'audits', count(*) || ' events', count(*) FROM audits""",
    "meters data_quality forecasts alerts audits",
)
def _(v):
    return reports.system_status(v)


# ---------------------------------------------------------------- G


@query(
    "g1_newest_alerts",
    "alert_id:i zone severity alert_timestamp:s",
    "SELECT alert_id, zone, severity, alert_timestamp FROM alerts ORDER BY alert_timestamp DESC, alert_id LIMIT 75",
    "alerts",
)
def _(v):
    return ranking.top(v.alerts, [F.desc("alert_timestamp"), F.asc("alert_id")], 75)


@query(
    "g2_last_forecasts_ascending",
    "zone forecast_date:s forecast_mw:d10",
    "SELECT zone, forecast_date, forecast_mw FROM points",
    "points",
    REPORT,
)
def _(v):
    return ranking.last_ascending(v.forecasts, [F.desc("forecast_date"), F.desc("zone")], 24, [F.asc("forecast_date"), F.asc("zone")])


@query(
    "g3_top_alerts_per_zone",
    "zone place:i alert_id:i anomaly_score:d",
    """SELECT * FROM (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY anomaly_score DESC, alert_id) AS place, alert_id, anomaly_score FROM alerts) WHERE place <= 5""",
    "alerts",
)
def _(v):
    return ranking.top_per_key(v.alerts, ["zone"], [F.desc("anomaly_score"), F.asc("alert_id")], 5)


@query(
    "g4_zone_order",
    "place:i zone risk open_alerts:i",
    """SELECT row_number() OVER (ORDER BY CASE risk WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 0 END DESC, open_alerts DESC, zone) AS place,
    zone, risk, open_alerts FROM zones""",
    "zones",
    REPORT,
)
def _(v):
    from pyspark.sql import Window

    # one row per zone: the set is as large as the list of zones
    w = Window.orderBy(F.desc(features.risk_rank(F.col("risk"))), F.desc("open_alerts"), F.asc("zone"))
    return rollup.by_risk(zones(v)).withColumn("place", F.row_number().over(w))


@query(
    "g5_clamped_limit",
    "alert_id:i anomaly_score:d",
    "SELECT alert_id, anomaly_score FROM alerts ORDER BY anomaly_score DESC, alert_id LIMIT 500",
    "alerts",
)
def _(v):
    return ranking.top(v.alerts, [F.desc("anomaly_score"), F.asc("alert_id")], ranking.clamp(900, 500))


@query(
    "g6_page_with_total",
    "alert_id:i alert_timestamp:s total:i",
    "SELECT alert_id, alert_timestamp, (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY alert_timestamp DESC, alert_id LIMIT 50 OFFSET 100",
    "alerts",
)
def _(v):
    return ranking.page(v.alerts, [F.desc("alert_timestamp"), F.asc("alert_id")], 3, 50)


@query(
    "g7_dataset_difference",
    "meter_id:i zone tariff_category side",
    """SELECT *, 'added' AS side FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM base)
    UNION ALL SELECT *, 'removed' FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM other)
    UNION ALL SELECT *, 'both' FROM (SELECT * FROM base INTERSECT SELECT * FROM other)""",
    "base other",
    {
        "base": ("meters", "SELECT meter_id, zone, tariff_category FROM meters"),
        "other": (
            "base",
            """SELECT meter_id, zone, CASE WHEN zone = 'NATION_3' AND tariff_category = 'LT-1' THEN 'LT-2' ELSE tariff_category END AS tariff_category FROM base
            UNION ALL SELECT meter_id + 1000000, zone, tariff_category FROM base WHERE zone = 'NATION_4'""",
        ),
    },
)
def _(v):
    base = v.meters.select("meter_id", "zone", "tariff_category")
    moved = F.when((F.col("zone") == "NATION_3") & (F.col("tariff_category") == "LT-1"), "LT-2").otherwise(F.col("tariff_category"))
    extra = base.where(F.col("zone") == "NATION_4").withColumn("meter_id", F.col("meter_id") + 1_000_000)
    return ranking.differences(base, base.withColumn("tariff_category", moved).unionByName(extra))


@query(
    "g8_distinct_substations",
    "substation_id feeder_id zone",
    """SELECT substation_id, feeder_id, zone FROM (SELECT *, row_number() OVER (PARTITION BY substation_id ORDER BY feeder_id, zone) AS rn
    FROM (SELECT DISTINCT substation_id, feeder_id, zone FROM meters)) WHERE rn = 1""",
    "meters",
)
def _(v):
    return ranking.first_per_key(v.meters.select("substation_id", "feeder_id", "zone"), ["substation_id"], "feeder_id")


@query(
    "g9_week_expansion",
    "zone day:i point:i timestamp:s forecast_mw:d10",
    """SELECT zone, day, day * 6 + i // 4 AS point, base + to_hours(CAST(day * 24 + (day * 6 + i // 4) % 24 AS BIGINT)) AS timestamp, forecast_mw FROM (
    SELECT *, row_number() OVER (ORDER BY forecast_date, zone) - 1 AS i, CAST(max(forecast_date) OVER () AS TIMESTAMP) AS base FROM points), range(7) d(day) WHERE i % 4 = 0""",
    "points",
    REPORT,
)
def _(v):
    return forecast.week_expansion(forecast.forecast_points(v.forecasts))


@query(
    "g10_listings",
    "kind id label",
    """SELECT * FROM (SELECT 'meter' AS kind, CAST(meter_id AS VARCHAR) AS id, zone AS label FROM meters ORDER BY meter_id LIMIT 50)
    UNION ALL SELECT * FROM (SELECT 'alert', CAST(alert_id AS VARCHAR), severity FROM alerts ORDER BY alert_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'zone', zone, risk FROM zones ORDER BY zone LIMIT 8)
    UNION ALL SELECT * FROM (SELECT 'feeder', feeder_id, zone FROM loads ORDER BY feeder_id LIMIT 8)""",
    "meters alerts zones loads",
    REPORT,
)
def _(v):
    def first(df, kind, key, label, n):
        return df.orderBy(key).limit(n).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).alias("label"))

    return (
        first(v.meters, "meter", "meter_id", "zone", 50)
        .unionByName(first(v.alerts, "alert", "alert_id", "severity", 10))
        .unionByName(first(zones(v), "zone", "zone", "risk", 8))
        .unionByName(first(loads(v), "feeder", "feeder_id", "zone", 8))
    )
