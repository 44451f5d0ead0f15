"""Scans and sinks (A), cleaning (B), projections and scalar functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions import text as X
from meterlake.operators import clean, features
from meterlake.plans.catalog import query
from meterlake.sources import storage as S
from meterlake.streaming import jobs

START, END = "2024-01-10", "2024-01-12"


@query(
    "a1_time_range_scan",
    "meter_id:i hour_ts:s kwh:d kwh_week_ago:d",
    f"""SELECT a.meter_id, a.hour_ts, a.kwh, b.kwh AS kwh_week_ago FROM hourly a
    LEFT JOIN hourly b ON b.meter_id = a.meter_id AND b.hour_ts = a.hour_ts - INTERVAL 7 DAY
    WHERE a.hour_ts >= TIMESTAMP '{START}' AND a.hour_ts < TIMESTAMP '{END}'""",
    "hourly",
)
def _(v):
    # read the look-back as well, compute, then trim to the asked range
    rows = v.between(START, END, "7 days").hourly.select("meter_id", "hour_ts", "kwh")
    old = rows.select("meter_id", (F.col("hour_ts") + F.expr("INTERVAL 7 DAYS")).alias("hour_ts"), F.col("kwh").alias("kwh_week_ago"))
    return S.trim_range(rows, "hour_ts", START, END).join(old, ["meter_id", "hour_ts"], "left")


@query(
    "a2_dimension_load",
    "meter_id:i peer_cluster_id:i zone install_date:s active:b",
    "SELECT meter_id, peer_cluster_id, zone, install_date, active FROM meters",
    "meters",
)
def _(v):
    return v.meters.select("meter_id", "peer_cluster_id", "zone", "install_date", "active")


@query(
    "a3_feeder_range_load",
    "feeder_id timestamp:s feeder_input_kwh:d",
    f"SELECT * FROM feeder_readings WHERE timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'",
    "feeder_readings",
)
def _(v):
    return v.between(START, END).feeder_readings


CSV_SCHEMA = T.StructType(
    [T.StructField("meter_id", T.LongType()), T.StructField("zone", T.StringType()), T.StructField("contracted_kw", T.DoubleType())]
)


@query(
    "a4_csv_scan",
    "meter_id:i zone contracted_kw:d",
    "SELECT meter_id, zone, contracted_kw FROM meters",
    "meters",
)
def _(v):
    path = S.shared_folder(v.spark, "csv")
    v.meters.select("meter_id", "zone", "contracted_kw").write.option("header", True).csv(path)
    missing = S.read_csv(v.spark, path + "-absent", CSV_SCHEMA)
    return S.read_csv(v.spark, path, CSV_SCHEMA).unionByName(missing)


@query(
    "a5_lenient_parse",
    "reading_id:i as_double:d as_int:i as_time:s",
    """SELECT event_id AS reading_id,
    coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1E0) AS as_double,
    coalesce(CAST(trunc(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)) AS BIGINT), 0) AS as_int,
    CASE event_id % 4 WHEN 0 THEN TIMESTAMP '1970-01-01' WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts)
    ELSE date_trunc('second', ts) END AS as_time FROM events""",
)
def _(v):
    e = v.table("events")
    i = F.col("event_id") % 4
    e = e.select(
        "event_id",
        F.when(i == 0, "n/a").otherwise(F.col("value").cast("string")).alias("num"),
        F.when(i == 0, "soon")
        .when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(i == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("txt"),
    )
    return e.select(
        F.col("event_id").alias("reading_id"),
        S.lenient_double(F.col("num"), -1.0).alias("as_double"),
        S.lenient_int(F.col("num")).alias("as_int"),
        S.lenient_timestamp(F.col("txt"), "1970-01-01").alias("as_time"),
    )


@query(
    "a6_json_payload",
    "k:i readings:i kwh:d",
    """SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, count(*) AS readings, sum(value) AS kwh FROM events GROUP BY 1""",
)
def _(v):
    parsed = v.table("events").select(F.from_json("props", "k INT").alias("p"), "value")
    return parsed.groupBy(F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("readings"), F.sum("value").alias("kwh"))


DAILY_SQL = "SELECT CAST(timestamp AS DATE) AS date, count(*) AS readings, sum(kwh) AS kwh FROM readings GROUP BY 1"


@query("a7_partitioned_sink", "date:s readings:i kwh:d4", DAILY_SQL, "readings")
def _(v):
    path = S.shared_folder(v.spark, "readings")
    rows = v.readings.withColumn("date", F.to_date("timestamp"))
    S.append_by_date(rows, path)
    # a second run of the last day replaces that day only
    S.overwrite_dates(rows.where(F.col("date") == F.lit("2024-01-30").cast("date")), path)
    back = S.read_dates(v.spark, path, "timestamp")
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("readings"), F.sum("kwh").alias("kwh"))


@query("a8_written_row_count", "rows_written:i", "SELECT count(*) AS rows_written FROM readings", "readings")
def _(v):
    path = S.shared_folder(v.spark, "counted")
    n = S.append_by_date(v.readings.withColumn("date", F.to_date("timestamp")), path)
    return v.spark.range(1).select(F.lit(n).alias("rows_written"))


@query(
    "a9_preview_artifact",
    "zone forecast_date:s forecast_mw:d8",
    "SELECT zone, forecast_date, forecast_mw FROM forecasts ORDER BY forecast_date DESC, zone DESC LIMIT 120",
    "forecasts",
)
def _(v):
    """The last 120 forecast rows as a CSV file for a quick look."""
    path = S.shared_folder(v.spark, "preview")
    rows = v.forecasts.select("zone", "forecast_date", "forecast_mw")
    S.write_top(rows, path, [F.desc("forecast_date"), F.desc("zone")], 120)
    return S.read_csv(v.spark, path, rows.schema)


@query(
    "a9_ranked_artifact_sink",
    "alert_id:i anomaly_score:d",
    "SELECT alert_id, anomaly_score FROM alerts ORDER BY anomaly_score DESC, alert_id LIMIT 500",
    "alerts",
)
def _(v):
    path = S.shared_folder(v.spark, "ranked")
    scored = v.alerts.select("alert_id", "anomaly_score")
    S.write_top(scored, path, [F.desc("anomaly_score"), F.asc("alert_id")], 500)
    return S.read_csv(v.spark, path, scored.schema)


@query("a10_stream_source", "date:s readings:i kwh:d4", DAILY_SQL, "readings")
def _(v):
    rows = jobs.run_to_table(jobs.stream_readings(v.spark, v.folder), "raw-stream")
    return rows.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("readings"), F.sum("kwh").alias("kwh"))


# ---------------------------------------------------------------- B

FILLED = {
    "filled": (
        "grid",
        """SELECT *, coalesce(kwh_1, lag(kwh_1, 168) OVER w) AS kwh_2 FROM (
        SELECT meter_id, hour_ts, kwh, kwh IS NULL OR coalesce(communication_status = 2, false) AS was_gap,
        CASE WHEN kwh IS NULL OR coalesce(communication_status = 2, false) THEN (lag(kwh) OVER w + lead(kwh) OVER w) / 2 ELSE kwh END AS kwh_1
        FROM grid WINDOW w AS (PARTITION BY meter_id ORDER BY hour_ts)) WINDOW w AS (PARTITION BY meter_id ORDER BY hour_ts)""",
    ),
    "medians": (
        "filled meters",
        """SELECT peer_cluster_id, hour(hour_ts) AS h, dayofweek(hour_ts) IN (0, 6) AS wk, median(kwh) AS med
        FROM filled JOIN meters USING (meter_id) WHERE NOT was_gap AND peer_cluster_id IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "imputed": (
        "filled meters medians",
        """SELECT f.meter_id, f.hour_ts, f.kwh AS kwh_read, coalesce(kwh_2, med) AS kwh, was_gap AS is_imputed,
        CASE WHEN NOT was_gap THEN 0 WHEN kwh_1 IS NOT NULL THEN 1 WHEN kwh_2 IS NOT NULL THEN 2 WHEN med IS NOT NULL THEN 3 END AS imputation_stage
        FROM filled f LEFT JOIN meters m ON m.meter_id = f.meter_id
        LEFT JOIN medians d ON d.peer_cluster_id = m.peer_cluster_id AND d.h = hour(f.hour_ts) AND d.wk = (dayofweek(f.hour_ts) IN (0, 6))""",
    ),
}


@query("b1_impute_neighbour_mean", "meter_id:i hour_ts:s was_gap:b kwh_1:d", "SELECT * FROM filled", "filled", FILLED)
def _(v):
    return clean.fill_from_series(v.grid)


@query("b2_impute_week_ago", "meter_id:i hour_ts:s kwh_2:d", "SELECT * FROM filled WHERE kwh_1 IS NULL", "filled", FILLED)
def _(v):
    return clean.fill_from_series(v.grid).where(F.col("kwh_1").isNull())


@query(
    "b3_impute_peer_median",
    "meter_id:i hour_ts:s kwh_read:d kwh:d is_imputed:b imputation_stage:i",
    "SELECT * FROM imputed",
    "imputed",
    FILLED,
)
def _(v):
    return clean.impute(v.grid, v.meters, observed=v.hourly)


@query(
    "b4_duplicate_removal",
    "related_alert_id:i step:i action_timestamp:s part_id:i inspector_id:i fine_inr:d copies:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY related_alert_id, step
    ORDER BY action_timestamp DESC, part_id DESC, inspector_id DESC, fine_inr DESC) AS rn,
    count(*) OVER (PARTITION BY related_alert_id, step) AS copies FROM audits) WHERE rn = 1""",
    "audits",
)
def _(v):
    return clean.keep_best(v.audits, ["related_alert_id", "step"], ["action_timestamp", "part_id", "inspector_id", "fine_inr"])


@query(
    "b5_dense_slot_grid",
    "meter_id:i expected:i received:i",
    "SELECT meter_id, count(*) AS expected, count(readings) AS received FROM grid GROUP BY 1",
    "grid",
)
def _(v):
    return v.grid.groupBy("meter_id").agg(F.count(F.lit(1)).alias("expected"), F.count("readings").alias("received"))


@query(
    "b6_range_and_null_counts",
    "meter_id:i date:s rows:i null_kwh:i out_of_range_kwh:i high_voltage:i",
    """SELECT meter_id, CAST(timestamp AS DATE) AS date, count(*) AS rows, count(*) FILTER (kwh IS NULL) AS null_kwh,
    count(*) FILTER (kwh < 1 OR kwh > 200) AS out_of_range_kwh, count(*) FILTER (voltage_v > 224) AS high_voltage FROM readings GROUP BY 1, 2""",
    "readings",
)
def _(v):
    return clean.quality_counts(v.readings, 1, 200)


@query(
    "b7_clip_negative",
    "zone forecast_date:s clipped_mw:d10 ape:d10",
    """SELECT zone, forecast_date, greatest(forecast_mw - 4, 0) AS clipped_mw,
    abs(actual_mw - greatest(forecast_mw - 4, 0)) / greatest(actual_mw, 1E-6) AS ape FROM forecasts""",
    "forecasts",
)
def _(v):
    p = clean.clip_negative(F.col("forecast_mw") - 4)
    return v.forecasts.select(
        "zone", "forecast_date", p.alias("clipped_mw"), (F.abs(F.col("actual_mw") - p) / F.greatest("actual_mw", F.lit(1e-6))).alias("ape")
    )


B8 = dict(FILLED)
B8["filled"] = ("hidden", FILLED["filled"][1].replace("FROM grid", "FROM hidden").replace("hour_ts, kwh,", "hour_ts, kwh, kwh_true,"))
B8["hidden"] = (
    "grid",
    """SELECT * EXCLUDE (kwh), kwh AS kwh_true,
    CASE WHEN (meter_id * 31 + CAST(floor(epoch(hour_ts) / 3600) AS BIGINT) * 17) % 10 <> 0 THEN kwh END AS kwh FROM grid""",
)


@query(
    "b8_imputation_trial",
    "imputation_stage:i slots:i mean_abs_error:d",
    """SELECT imputation_stage, count(*) AS slots, avg(abs(i.kwh - h.kwh_true)) AS mean_abs_error FROM imputed i
    JOIN hidden h ON h.meter_id = i.meter_id AND h.hour_ts = i.hour_ts
    WHERE h.kwh IS NULL AND h.kwh_true IS NOT NULL GROUP BY 1""",
    "imputed hidden",
    B8,
)
def _(v):
    hidden = clean.drop_values(v.grid)
    truth = hidden.where(F.col("kwh").isNull() & F.col("kwh_true").isNotNull()).select("meter_id", "hour_ts")
    filled = clean.impute(hidden, v.meters, observed=clean.drop_values(v.hourly)).join(truth, ["meter_id", "hour_ts"])
    return filled.groupBy("imputation_stage").agg(
        F.count(F.lit(1)).alias("slots"), F.avg(F.abs(F.col("kwh") - F.col("kwh_true"))).alias("mean_abs_error")
    )


# ---------------------------------------------------------------- C


@query(
    "c1_calendar_parts",
    "reading_id:i hour:i dayofweek:i month:i quarter:i date:s",
    """SELECT reading_id, hour(timestamp) AS hour, dayofweek(timestamp) + 1 AS dayofweek, month(timestamp) AS month,
    quarter(timestamp) AS quarter, CAST(timestamp AS DATE) AS date FROM readings""",
    "readings",
)
def _(v):
    return features.calendar_parts(v.readings, "timestamp")


@query(
    "c2_cyclic_encoding",
    "reading_id:i hour_sin:d hour_cos:d dow_sin:d dow_cos:d month_sin:d month_cos:d",
    """SELECT reading_id, sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos,
    sin(2 * pi() * (dayofweek(timestamp) + 1) / 7) AS dow_sin, cos(2 * pi() * (dayofweek(timestamp) + 1) / 7) AS dow_cos,
    sin(2 * pi() * month(timestamp) / 12) AS month_sin, cos(2 * pi() * month(timestamp) / 12) AS month_cos FROM readings""",
    "readings",
)
def _(v):
    rows = features.calendar_parts(v.readings, "timestamp")
    return features.cyclic(rows, {"hour": ("hour", 24), "dow": ("dayofweek", 7), "month": ("month", 12)})


@query(
    "c3_tariff_slot",
    "tou_period readings:i kwh:d4",
    """SELECT CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) < 6 THEN 'off_peak' WHEN hour(timestamp) < 9 THEN 'normal'
    WHEN hour(timestamp) < 18 THEN 'peak' ELSE 'critical' END AS tou_period, count(*) AS readings, sum(kwh) AS kwh FROM readings GROUP BY 1""",
    "readings",
)
def _(v):
    slot = features.tariff_slot(F.hour("timestamp")).alias("tou_period")
    return v.readings.groupBy(slot).agg(F.count(F.lit(1)).alias("readings"), F.sum("kwh").alias("kwh"))


@query(
    "c4_day_position",
    "reading_id:i minutes_since_midnight:i is_weekend:b",
    """SELECT reading_id, hour(timestamp) * 60 + minute(timestamp) AS minutes_since_midnight,
    dayofweek(timestamp) IN (0, 6) AS is_weekend FROM readings""",
    "readings",
)
def _(v):
    return features.day_position(v.readings, "timestamp")


@query(
    "c5_season_bucket",
    "season:i alerts:i",
    """SELECT CASE WHEN month(alert_timestamp) IN (12, 1, 2) THEN 0 WHEN month(alert_timestamp) IN (3, 4, 5) THEN 1
    WHEN month(alert_timestamp) IN (6, 7, 8, 9) THEN 2 ELSE 3 END AS season, count(*) AS alerts FROM alerts GROUP BY 1""",
    "alerts",
)
def _(v):
    return v.alerts.groupBy(features.season(F.month("alert_timestamp")).alias("season")).agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "c6_power_factor",
    "reading_id:i power_factor:d pf_anomaly:b",
    """SELECT reading_id, CASE WHEN kvah > 0 THEN kwh / kvah END AS power_factor,
    CASE WHEN kvah > 0 THEN kwh / kvah END > 1 AS pf_anomaly FROM readings""",
    "readings",
)
def _(v):
    pf = features.power_factor(F.col("kwh"), F.col("kvah"))
    return v.readings.select("reading_id", pf.alias("power_factor"), (pf > 1).alias("pf_anomaly"))


@query(
    "c7_risk_tier",
    "alert_id:i risk risk_rank:i",
    """SELECT alert_id, CASE WHEN l >= 90 THEN 'Critical' WHEN l >= 75 THEN 'High' WHEN l >= 60 THEN 'Medium' ELSE 'Normal' END AS risk,
    CASE WHEN l >= 90 THEN 4 WHEN l >= 75 THEN 3 WHEN l >= 60 THEN 2 ELSE 0 END AS risk_rank
    FROM (SELECT alert_id, anomaly_score * 100 AS l FROM alerts)""",
    "alerts",
)
def _(v):
    risk = features.risk_from_load(F.col("anomaly_score") * 100)
    return v.alerts.select("alert_id", risk.alias("risk")).withColumn("risk_rank", features.risk_rank(F.col("risk")))


@query(
    "c8_next_action",
    "alert_id:i action",
    """SELECT alert_id, CASE WHEN alert_id % 10 = 0 THEN 'Call consumer' WHEN status = 'Resolved' THEN 'Review closure evidence'
    WHEN severity = 'Critical' THEN 'Physical inspection within 24 hours' WHEN severity = 'High' THEN 'Assign field team'
    WHEN severity = 'Medium' THEN 'Analyst review' ELSE 'Monitor trend' END AS action FROM alerts""",
    "alerts",
)
def _(v):
    k = F.col("alert_id") % 10
    given = F.when(k == 0, "Call consumer").when(k == 1, "")
    return v.alerts.select("alert_id", features.next_action(given, F.col("status"), F.col("severity")).alias("action"))


VOTES = "CAST(vae_score >= 0.65 AS INT) + CAST(eif_score >= 0.65 AS INT) + CAST(bocpd_flag AS INT) + CAST(gnn_score >= 0.65 AS INT)"


@query(
    "c9_detector_status",
    "alert_id:i vae_status eif_status gnn_status bocpd_status detectors_agreeing:i consensus",
    f"""SELECT alert_id, CASE WHEN vae_score >= 0.65 THEN 'flagged' ELSE 'watch' END AS vae_status,
    CASE WHEN eif_score >= 0.65 THEN 'flagged' ELSE 'watch' END AS eif_status,
    CASE WHEN gnn_score >= 0.65 THEN 'flagged' ELSE 'watch' END AS gnn_status,
    CASE WHEN bocpd_flag THEN 'changepoint' ELSE 'no_changepoint' END AS bocpd_status, {VOTES} AS detectors_agreeing,
    CASE WHEN {VOTES} >= 3 THEN 'High confidence' ELSE 'Needs analyst review' END AS consensus FROM alerts""",
    "alerts",
)
def _(v):
    return features.detector_votes(v.alerts)


@query(
    "c10_label_encoding",
    "meter_id:i consumer_type_code:i tariff_category_code:i",
    """SELECT meter_id, dense_rank() OVER (ORDER BY consumer_type) - 1 AS consumer_type_code,
    dense_rank() OVER (ORDER BY tariff_category) - 1 AS tariff_category_code FROM meters""",
    "meters",
)
def _(v):
    return features.encode_labels(v.meters, ["consumer_type", "tariff_category"])


@query(
    "c11_one_hot",
    "meter_id:i type_automobile:i type_building:i type_furniture:i type_household:i type_machinery:i",
    """SELECT meter_id, CAST(consumer_type = 'AUTOMOBILE' AS INT) AS type_automobile, CAST(consumer_type = 'BUILDING' AS INT) AS type_building,
    CAST(consumer_type = 'FURNITURE' AS INT) AS type_furniture, CAST(consumer_type = 'HOUSEHOLD' AS INT) AS type_household,
    CAST(consumer_type = 'MACHINERY' AS INT) AS type_machinery FROM meters""",
    "meters",
)
def _(v):
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return v.meters.select("meter_id", *[F.coalesce((F.col("consumer_type") == k).cast("int"), F.lit(0)).alias(f"type_{k.lower()}") for k in known])


@query(
    "c12_risk_status_filter",
    "alert_id:i severity status",
    "SELECT alert_id, severity, status FROM alerts WHERE severity = 'High' AND status = 'Resolved'",
    "alerts",
)
def _(v):
    from meterlake.operators.ranking import filter_alerts

    return filter_alerts(v.alerts, risk="high", status="closed")


@query(
    "c13_substring_search",
    "meter_id:i zone consumer_type feeder_id",
    """SELECT meter_id, zone, consumer_type, feeder_id FROM meters
    WHERE contains(lower(meter_id || ' ' || zone || ' ' || consumer_type || ' ' || feeder_id), 'machinery fdr-1')""",
    "meters",
)
def _(v):
    from meterlake.operators.ranking import search

    return search(v.meters, ["meter_id", "zone", "consumer_type", "feeder_id"], "Machinery FDR-1")


@query(
    "c16_mask_ids_in_text",
    "doc_id:i masked",
    f"""SELECT doc_id, regexp_replace('MTR-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || ' ' || text,
    '{X.id_pattern()}', '{X.id_replacement(mark=chr(92))}', 'g') AS masked FROM documents""",
)
def _(v):
    body = F.concat(F.lit("MTR-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit(" "), F.col("text"))
    return v.table("documents").select("doc_id", X.mask_text(body).alias("masked"))


@query(
    "c17_column_redaction",
    "meter_id consumer_id latitude longitude zone",
    """SELECT CASE WHEN length(CAST(meter_id AS VARCHAR)) <= 4 THEN '[masked-meter]' ELSE
    substr(CAST(meter_id AS VARCHAR), 1, 3) || '...' || right(CAST(meter_id AS VARCHAR), 2) END AS meter_id,
    '[redacted]' AS consumer_id, '[redacted]' AS latitude, '[redacted]' AS longitude, zone FROM (
    SELECT 'METER-' || meter_id AS meter_id, zone FROM meters)""",
    "meters",
)
def _(v):
    rows = v.meters.select(F.concat(F.lit("METER-"), "meter_id").alias("meter_id"), "consumer_id", "latitude", "longitude", "zone")
    return X.redact(rows)


@query(
    "c18_map_links",
    "meter_id:i label",
    """SELECT meter_id, 'https://www.google.com/maps/search/?api=1&query=' || printf('%.4f', latitude) || ',' || printf('%.4f', longitude) AS label FROM meters""",
    "meters",
)
def _(v):
    from meterlake.operators.ranking import map_link

    return v.meters.select("meter_id", map_link(X.decimals(F.col("latitude"), 4), X.decimals(F.col("longitude"), 4)).alias("label"))


@query(
    "c19_guarded_ratios",
    "meter_id:i night_ratio:d per_contract:d loss_ratio:d",
    """SELECT meter_id, n / (d + 1E-5) AS night_ratio, n / greatest(1, contracted_kw) AS per_contract, d / nullif(contracted_kw, 0) AS loss_ratio FROM (
    SELECT meter_id, sum(CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) < 6 THEN kwh ELSE 0 END) AS n,
    sum(CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) < 6 THEN 0 ELSE kwh END) AS d FROM readings GROUP BY 1) JOIN meters USING (meter_id)""",
    "readings meters",
)
def _(v):
    night = (F.hour("timestamp") >= 22) | (F.hour("timestamp") < 6)
    s = v.readings.groupBy("meter_id").agg(
        F.sum(F.when(night, F.col("kwh")).otherwise(0.0)).alias("n"), F.sum(F.when(night, 0.0).otherwise(F.col("kwh"))).alias("d")
    )
    s = s.join(v.meters.select("meter_id", "contracted_kw"), "meter_id")
    return s.select(
        "meter_id",
        (F.col("n") / (F.col("d") + 1e-5)).alias("night_ratio"),
        (F.col("n") / F.greatest(F.lit(1.0), "contracted_kw")).alias("per_contract"),
        F.try_divide("d", "contracted_kw").alias("loss_ratio"),
    )
