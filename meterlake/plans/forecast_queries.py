"""Forecasts, scenarios, explanation and causes (N); report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions import text as X
from meterlake.operators import anomaly, explain, features, forecast, joins, models
from meterlake.plans import reports
from meterlake.plans.base_queries import FILLED
from meterlake.plans.catalog import query
from meterlake.plans.join_queries import FLAGS, daily
from meterlake.plans.rollup_queries import REPORT
from meterlake.sources.storage import read_dates, settle, shared_folder
from meterlake.sources.views import SQL

FC = {
    **REPORT,
    "split": (
        "forecasts",
        """SELECT *, position <= cut AS is_train, position <= cut AND position > 2 * cut - total AS is_calibration FROM (
        SELECT *, row_number() OVER (ORDER BY forecast_date, zone) AS position, count(*) OVER () AS total,
        greatest(20, floor(0.8E0 * count(*) OVER ())) AS cut FROM forecasts)""",
    ),
    "folds": (
        "forecasts",
        """SELECT f.*, fold + 1 AS fold, CASE WHEN d <= e - 7 THEN 'train' ELSE 'validation' END AS part FROM forecasts f JOIN (
        SELECT forecast_date AS day, dense_rank() OVER (ORDER BY forecast_date) AS d, (SELECT count(DISTINCT forecast_date) FROM forecasts) AS total
        FROM (SELECT DISTINCT forecast_date FROM forecasts)) x ON x.day = f.forecast_date
        JOIN (SELECT i AS fold FROM range(3) t(i)) g ON true
        CROSS JOIN LATERAL (SELECT total - (3 - fold - 1) * 7 AS e) l WHERE e - 7 >= 30 AND d <= e""",
    ),
    "naive": (
        "forecasts",
        "SELECT f.*, n.actual_mw AS naive_mw FROM forecasts f LEFT JOIN forecasts n ON n.zone = f.zone AND n.forecast_date = f.forecast_date - 7",
    ),
    "pads": (
        "split",
        """SELECT zone, quantile_cont(abs(actual_mw - forecast_mw), 0.9) AS pad90, quantile_cont(abs(actual_mw - forecast_mw), 0.99) AS pad99
        FROM split WHERE is_calibration GROUP BY 1""",
    ),
    "causes": (
        "daily meters weather flags",
        """SELECT d.meter_id, d.date, d.kwh, m.zone, temp_c, rainfall_mm, temperature_delta, CAST(coalesce(is_holiday, false) AS INT) AS is_holiday,
        CAST(coalesce(is_shutdown, false) AS INT) AS is_shutdown, CAST(coalesce(is_ramadan, false) AS INT) AS is_ramadan,
        CASE WHEN month(d.date) IN (12, 1, 2) THEN 0 WHEN month(d.date) <= 5 THEN 1 WHEN month(d.date) <= 9 THEN 2 ELSE 3 END AS season
        FROM daily d JOIN meters m ON m.meter_id = d.meter_id LEFT JOIN (
        SELECT *, temp_c - avg(CASE WHEN rn <= 14 THEN temp_c END) OVER (PARTITION BY zone) AS temperature_delta FROM (
        SELECT *, row_number() OVER (PARTITION BY zone ORDER BY date) AS rn FROM (
        SELECT zone_id AS zone, CAST(timestamp AS DATE) AS date, avg(temp_c) AS temp_c, sum(rainfall_mm) AS rainfall_mm FROM weather GROUP BY 1, 2))) w
        ON w.zone = m.zone AND w.date = d.date LEFT JOIN flags f ON f.date = d.date""",
    ),
    "effect": (
        "causes",
        """SELECT meter_id, regr_slope(kwh, rainfall_mm) AS slope, avg(rainfall_mm) FILTER (down <= 7) - avg(rainfall_mm) FILTER (up <= 21) AS move
        FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY date) AS up, row_number() OVER (PARTITION BY meter_id ORDER BY date DESC) AS down
        FROM causes WHERE kwh IS NOT NULL AND rainfall_mm IS NOT NULL) GROUP BY 1""",
    ),
    "measured": (
        "daily",
        """SELECT meter_id, n AS days, baseline_mean, recent_mean, (baseline_mean - recent_mean) / (baseline_mean + 1E-8) AS drop_fraction FROM (
        SELECT meter_id, count(*) AS n, avg(kwh) FILTER (up <= 21) AS baseline_mean, avg(kwh) FILTER (down <= 7) AS recent_mean FROM (
        SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY date) AS up, row_number() OVER (PARTITION BY meter_id ORDER BY date DESC) AS down FROM daily
        WHERE kwh IS NOT NULL) GROUP BY 1)""",
    ),
}


def split(v):
    return forecast.time_split(v.forecasts, "forecast_date", ["zone"])


@query(
    "n1_forecast_features",
    "zone forecast_date:s month:i dayofweek:i day:i lag_actual:d8 lag_forecast:d10 lag_error:d10",
    """SELECT *, lag_forecast - lag_actual AS lag_error FROM (SELECT zone, forecast_date, month(forecast_date) AS month, dayofweek(forecast_date) + 1 AS dayofweek,
    day(forecast_date) AS day, coalesce(lag(actual_mw) OVER w, (SELECT median(actual_mw) FROM forecasts)) AS lag_actual,
    coalesce(lag(forecast_mw) OVER w, (SELECT median(forecast_mw) FROM forecasts)) AS lag_forecast FROM forecasts WINDOW w AS (PARTITION BY zone ORDER BY forecast_date))""",
    "forecasts",
)
def _(v):
    return forecast.forecast_features(v.forecasts)


@query("n2_median_forecast", "zone forecast_date:s actual_mw:d p50:d is_train:b")
def _(v):
    return models.median_forecast(v.forecasts)


@query("n3_quantile_forecast", "zone forecast_date:s actual_mw:d p10:d p50:d p90:d is_train:b")
def _(v):
    return models.boosted_quantiles(v.forecasts)[1]


@query("n3_residual_quantiles", "zone forecast_date:s actual_mw:d p10:d p50:d p90:d is_train:b")
def _(v):
    return models.quantile_forecast(settle(models.median_forecast(v.forecasts), "median"))


@query(
    "n4_conformal_intervals",
    "zone forecast_date:s lower_90:d8 upper_90:d8 lower_99:d8 upper_99:d8",
    """SELECT s.zone, forecast_date, greatest(forecast_mw - pad90, 0) AS lower_90, forecast_mw + pad90 AS upper_90,
    greatest(forecast_mw - pad99, 0) AS lower_99, forecast_mw + pad99 AS upper_99 FROM split s JOIN pads p ON p.zone = s.zone WHERE NOT is_train""",
    "split pads",
    FC,
)
def _(v):
    return with_bands(v)


def with_bands(v):
    rows = split(v)
    pads = forecast.conformal_pads(rows.where("is_calibration"), "actual_mw", "forecast_mw", ["zone"], {"pad90": 0.9, "pad99": 0.99})
    later = rows.where("NOT is_train").join(pads, "zone")
    return forecast.intervals(forecast.intervals(later, "forecast_mw", F.col("pad90"), "90"), "forecast_mw", F.col("pad99"), "99")


@query(
    "n4_overall_pad",
    "pad90:d8 pad99:d8",
    """SELECT quantile_cont(abs(actual_mw - forecast_mw), 0.9) AS pad90, quantile_cont(abs(actual_mw - forecast_mw), 0.99) AS pad99 FROM split WHERE is_calibration""",
    "split",
    FC,
)
def _(v):
    return forecast.conformal_pads(split(v).where("is_calibration"), "actual_mw", "forecast_mw", [], {"pad90": 0.9, "pad99": 0.99})


@query(
    "n5_outside_band",
    "zone forecast_date:s actual_mw:d8",
    """SELECT s.zone, forecast_date, actual_mw FROM split s JOIN pads p ON p.zone = s.zone
    WHERE NOT is_train AND (actual_mw < greatest(forecast_mw - pad99, 0) OR actual_mw > forecast_mw + pad99)""",
    "split pads",
    FC,
)
def _(v):
    return with_bands(v).where((F.col("actual_mw") < F.col("lower_99")) | (F.col("actual_mw") > F.col("upper_99")))


@query("n6_seasonal_naive", "zone forecast_date:s actual_mw:d8 naive_mw:d8", "SELECT * FROM naive", "naive", FC)
def _(v):
    return forecast.seasonal_naive(v.forecasts)


@query(
    "n7_decomposition",
    "zone forecast_date:s trend:d10 seasonal:d10 residual:d10",
    """SELECT *, actual_mw - trend - seasonal AS residual FROM (SELECT *, avg(actual_mw - trend) OVER (PARTITION BY zone, dayofweek(forecast_date)) AS seasonal FROM (
    SELECT *, avg(actual_mw) OVER (PARTITION BY zone ORDER BY forecast_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM forecasts))""",
    "forecasts",
)
def _(v):
    return forecast.decompose(v.forecasts)


@query("n8_walk_forward_split", "zone forecast_date:s fold:i part", "SELECT zone, forecast_date, fold, part FROM folds", "folds", FC)
def _(v):
    return forecast.walk_forward(v.forecasts, "forecast_date")


@query(
    "n9_walk_forward_errors",
    "fold:i rows:i mape:d mean_mape:d std_mape:d",
    """SELECT *, avg(mape) OVER () AS mean_mape, stddev_pop(mape) OVER () AS std_mape FROM (SELECT fold, count(*) AS rows,
    avg(abs(greatest(f.actual_mw, 1E-5) - greatest(naive_mw, 0)) / greatest(f.actual_mw, 1E-5)) AS mape FROM folds f
    JOIN (SELECT zone AS z, forecast_date AS d, naive_mw FROM naive WHERE naive_mw IS NOT NULL) n ON z = f.zone AND d = f.forecast_date
    WHERE part = 'validation' GROUP BY 1)""",
    "folds naive",
    FC,
)
def _(v):
    return forecast.fold_errors(forecast.walk_forward(forecast.seasonal_naive(v.forecasts), "forecast_date"), "naive_mw")


@query("n10_parameter_search", "params mean_mape:d std_mape:d best:b")
def _(v):
    return models.grid_search(v.forecasts, {"maxDepth": [2, 3], "maxIter": [20, 60]})


@query(
    "n11_time_split",
    "zone forecast_date:s position:i is_train:b",
    "SELECT zone, forecast_date, position, is_train FROM split",
    "split",
    FC,
)
def _(v):
    return split(v)


@query(
    "n12_weighted_ensemble",
    "zone forecast_date:s ensemble_mw:d10 members:i",
    """WITH members AS (SELECT zone, forecast_date, actual_mw, 'mean' AS model_name, forecast_mw AS forecast FROM naive
    UNION ALL SELECT zone, forecast_date, actual_mw, 'naive', naive_mw FROM naive WHERE naive_mw IS NOT NULL),
    skill AS (SELECT model_name, 1 / nullif(avg(abs(actual_mw - forecast)), 0) AS w FROM members GROUP BY 1)
    SELECT zone, forecast_date, sum(w * forecast) / sum(w) AS ensemble_mw, count(*) AS members FROM members JOIN skill USING (model_name) GROUP BY 1, 2""",
    "naive",
    FC,
)
def _(v):
    rows = forecast.seasonal_naive(v.forecasts)
    one = F.struct(F.lit("mean").alias("model_name"), F.col("forecast_mw").alias("forecast"))
    two = F.struct(F.lit("naive").alias("model_name"), F.col("naive_mw").alias("forecast"))
    members = rows.withColumn("_m", F.explode(F.array(one, two))).select("zone", "forecast_date", "actual_mw", "_m.*")
    return forecast.ensemble(members.where(F.col("forecast").isNotNull()), ["zone", "forecast_date"])


@query(
    "n13_scenario",
    "zone forecast_date:s scenario_mw:d delta_pct:d",
    """SELECT zone, forecast_date, forecast_mw * m AS scenario_mw, (m - 1) * 100 AS delta_pct FROM forecasts, (SELECT 1E0 + 0.012E0 * 3 + 0.35E0 * (1.2E0 - 1) - 0.08E0 AS m)""",
    "forecasts",
)
def _(v):
    return forecast.scenario(v.forecasts, 3.0, 1.2, True)


@query(
    "n14_forecast_points",
    "zone forecast_date:s actual_mw:d8 forecast_mw:d10 lower90:d10 upper90:d10 lower99:d10 upper99:d10 p50:d10",
    "SELECT * FROM points",
    "points",
    FC,
)
def _(v):
    return forecast.forecast_points(v.forecasts)


@query(
    "n15_zone_risk",
    "zone forecast_date:s week_mean:d10 capacity_share:d10 risk",
    """SELECT *, CASE WHEN capacity_share > 0.95 THEN 'Critical' WHEN capacity_share > 0.8 OR forecast_mw > 1.15E0 * week_mean THEN 'High'
    WHEN p90_mw - p10_mw > 0.2E0 * forecast_mw AND forecast_mw > before THEN 'Medium' ELSE 'Normal' END AS risk FROM (
    SELECT f.*, avg(actual_mw) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS week_mean, lag(forecast_mw) OVER w AS before, forecast_mw / cap AS capacity_share
    FROM forecasts f JOIN (SELECT zone, max(forecast_mw) AS cap FROM forecasts GROUP BY 1) c ON c.zone = f.zone WINDOW w AS (PARTITION BY f.zone ORDER BY forecast_date))""",
    "forecasts",
)
def _(v):
    capacity = v.forecasts.groupBy("zone").agg(F.max("forecast_mw").alias("capacity_mw"))
    return forecast.zone_risk(v.forecasts, capacity)


COEF = {"vae_score": 1.7131, "eif_score": -0.9137, "gnn_score": 0.6113, "anomaly_score": 0.7717}
SHAP = {
    "shap": (
        "alerts",
        "SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY abs(round(shap_value, 9)) DESC, feature) AS place FROM ("
        + " UNION ALL ".join(f"SELECT alert_id, '{c}' AS feature, {c} AS value, {w}E0 * ({c} - avg({c}) OVER ()) AS shap_value FROM alerts" for c, w in COEF.items())
        + ")",
    ),
}


@query(
    "n16_feature_contributions",
    "alert_id:i place:i feature value:d shap_value:d9 direction",
    "SELECT *, CASE WHEN shap_value > 0 THEN 'increased' ELSE 'decreased' END AS direction FROM shap WHERE place <= 3",
    "shap",
    SHAP,
)
def _(v):
    rows = explain.contributions(v.alerts, COEF, 3).select("alert_id", F.posexplode("shap").alias("p", "s"))
    return rows.select("alert_id", (F.col("p") + 1).alias("place"), "s.*")


@query("n16_tree_contributions", "zone forecast_date:s p50:d base_value:d raw_prediction:d place:i feature value:d shap_value:d9 direction")
def _(v):
    """Why the fitted median is what it is, for the rows it was not fitted on."""
    model, rows = models.boosted_quantiles(v.forecasts)
    out = model.contributions(rows.where("NOT is_train"), 0.5)
    return out.select("zone", "forecast_date", "p50", "base_value", "raw_prediction", F.posexplode("shap").alias("place", "s")).select(
        "zone", "forecast_date", "p50", "base_value", "raw_prediction", (F.col("place") + 1).alias("place"), "s.*"
    )


NAMES_SQL = "CASE feature " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, n.replace("'", "''")) for k, n in X.FEATURE_NAMES.items()
) + " ELSE replace(feature, '_', ' ') END"
N17_COEF = {"z_vs_peer": 0.8, "night_ratio": -0.05, "load_factor_day": 0.4}


@query(
    "n17_contribution_text",
    "meter_id:i factors",
    f"""SELECT meter_id, string_agg('  - ' || {NAMES_SQL} || ': ' || CASE WHEN s > 0 THEN 'pushed anomaly score higher' ELSE 'normal signal' END ||
    ' (SHAP=' || printf('%+.3f', s) || ', value=' || printf('%.3f', value) || ')', chr(10) ORDER BY abs(round(s, 9)) DESC, feature) AS factors FROM ("""
    + " UNION ALL ".join(f"SELECT meter_id, '{c}' AS feature, {c} AS value, {w}E0 * ({c} - avg({c}) OVER ()) AS s FROM base" for c, w in N17_COEF.items())
    + ") GROUP BY 1",
    "base",
    {
        **FLAGS,
        "base": (
            "with_peers",
            """SELECT meter_id, coalesce(avg(z_vs_peer), 0) AS z_vs_peer, sum(CASE WHEN hour(hour_ts) >= 22 OR hour(hour_ts) < 6 THEN kwh ELSE 0 END) /
            (sum(CASE WHEN hour(hour_ts) >= 22 OR hour(hour_ts) < 6 THEN 0 ELSE kwh END) + 1E-5) AS night_ratio, avg(kwh) / max(kwh) AS load_factor_day FROM with_peers GROUP BY 1""",
        ),
    },
)
def _(v):
    night = (F.hour("hour_ts") >= 22) | (F.hour("hour_ts") < 6)
    base = joins.with_peers(v.hourly, v.meters).groupBy("meter_id").agg(
        F.coalesce(F.avg("z_vs_peer"), F.lit(0.0)).alias("z_vs_peer"),
        (F.sum(F.when(night, F.col("kwh")).otherwise(0.0)) / (F.sum(F.when(night, 0.0).otherwise(F.col("kwh"))) + 1e-5)).alias("night_ratio"),
        F.try_divide(F.avg("kwh"), F.max("kwh")).alias("load_factor_day"),
    )
    return explain.contributions(base, N17_COEF).select("meter_id", explain.factor_lines(F.col("shap")).alias("factors"))


@query(
    "n18_cause_table",
    "meter_id:i date:s kwh:d temp_c:d rainfall_mm:d temperature_delta:d is_holiday:i is_shutdown:i is_ramadan:i season:i",
    "SELECT * FROM causes",
    "causes",
    FC,
)
def _(v):
    return causes(v)


def causes(v):
    return explain.cause_table(daily(v), v.meters, v.weather, v.calendar)


@query("n19_cause_effects", "meter_id:i drop_fraction:d explained_fraction:d effect_temperature_delta:d effect_is_holiday:d")
def _(v):
    return models.cause_effects(causes(v), explain.drop_measure(daily(v)))


@query("n19_single_cause_effect", "meter_id:i slope:d move:d", "SELECT * FROM effect", "effect", FC)
def _(v):
    return explain.single_effect(causes(v), "rainfall_mm")


@query(
    "n20_escalation_decision",
    "meter_id:i days:i drop_fraction:d explained_fraction:d unexplained_fraction:d escalate:b reason suppress_until:s",
    """SELECT *, CASE WHEN escalate THEN NULL ELSE DATE '2024-01-30' + 7 END AS suppress_until FROM (SELECT *,
    CASE WHEN days < 14 THEN 1 WHEN baseline_mean < 1E-3 OR drop_fraction < 0.2 THEN 0 ELSE greatest(0, 1 - explained_fraction) END AS unexplained_fraction,
    CASE WHEN days < 14 THEN true WHEN baseline_mean < 1E-3 OR drop_fraction < 0.2 THEN false ELSE greatest(0, 1 - explained_fraction) > 0.15 END AS escalate,
    CASE WHEN days < 14 THEN 'Insufficient data' WHEN baseline_mean < 1E-3 THEN 'Near-zero baseline' WHEN drop_fraction < 0.2 THEN 'Drop below threshold'
    WHEN greatest(0, 1 - explained_fraction) <= 0.15 THEN 'Explained by known causes' END AS reason FROM (
    SELECT m.*, CASE WHEN drop_fraction > 0 THEN coalesce(least(1, greatest(0, -slope * move) / (baseline_mean - recent_mean)), 0) ELSE 0 END AS explained_fraction
    FROM measured m LEFT JOIN effect e ON e.meter_id = m.meter_id))""",
    "measured effect",
    FC,
)
def _(v):
    drop = explain.drop_measure(daily(v)).join(explain.single_effect(causes(v), "rainfall_mm"), "meter_id", "left")
    moved = F.greatest(F.lit(0.0), -F.col("slope") * F.col("move"))
    share = F.least(F.lit(1.0), moved / (F.col("baseline_mean") - F.col("recent_mean")))
    drop = drop.withColumn("explained_fraction", F.when(F.col("drop_fraction") > 0, F.coalesce(share, F.lit(0.0))).otherwise(0.0))
    return explain.decision(drop).withColumn("suppress_until", F.when(~F.col("escalate"), F.date_add(F.lit("2024-01-30").cast("date"), 7)))


@query(
    "n21_recent_peer_gap",
    "meter_id:i recent_peer_gap:d9 slots:i",
    """SELECT meter_id, avg(coalesce(kwh, 0) - coalesce(peer_mean, 0)) AS recent_peer_gap, count(*) AS slots FROM (
    SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY hour_ts DESC) AS rn FROM with_peers) WHERE rn <= 24 GROUP BY 1""",
    "with_peers",
    FLAGS,
)
def _(v):
    return explain.recent_peer_gap(joins.with_peers(v.hourly, v.meters))


@query(
    "n22_model_inputs",
    "meter_id:i consumer_type:d tariff_category:d contracted_kw:d kwh:d",
    """SELECT m.meter_id, dense_rank() OVER (ORDER BY consumer_type) - 1 AS consumer_type, dense_rank() OVER (ORDER BY tariff_category) - 1 AS tariff_category,
    contracted_kw, coalesce(b.kwh, 0) AS kwh FROM meters m LEFT JOIN billed b ON b.meter_id = m.meter_id""",
    "meters billed",
    REPORT,
)
def _(v):
    usage = v.hourly.groupBy("meter_id").agg(F.sum("kwh").alias("kwh"))
    rows = v.meters.join(usage, "meter_id", "left")
    wanted = ["consumer_type", "tariff_category", "meter_type", "contracted_kw", "kwh"]
    return explain.model_inputs(rows, wanted, ["consumer_type", "tariff_category", "meter_type"], ["meter_id"])


KIND_SQL = "CASE alert_id % 8 WHEN 0 THEN 'bypass' WHEN 1 THEN 'slowdown' WHEN 2 THEN 'flatline' WHEN 3 THEN 'other' ELSE 'unknown' END"
DESC_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in explain.KINDS.items()) + f" ELSE '{explain.UNKNOWN_KIND}' END"


@query(
    "c14_alert_report",
    "alert_id:i report",
    f"""SELECT alert_id, concat_ws(chr(10), 'Utility smart meter alert: ' || severity || ' risk',
    'Meter ' || meter_id || ' in ' || zone || ', ' || upper(consumer_type[1]) || lower(consumer_type[2:]) || ' (' || tariff_category || ')',
    'Summary: ' || CAST(floor(anomaly_score * 100 + 0.5E0) AS BIGINT) || '% theft probability for ' || {DESC_SQL} || '.',
    'Estimated loss: INR ' || format('{{:,}}', CAST(floor(impact + 0.5E0) AS BIGINT)) || ' per day',
    'Detectors triggered: ' || CASE WHEN detectors = '' THEN 'none' ELSE detectors END, 'Top contributing factors:', factors,
    'Calendar note: ' || note, 'Recommended action: ' || CASE severity WHEN 'Critical' THEN 'Inspect on site within 24 hours; look for a bypass at socket and distribution board.'
    WHEN 'High' THEN 'Inspect on site within 3-5 days; verify wiring and seals (' || consumer_type || ').' ELSE 'Notify the consumer first; inspect within 2 weeks if there is no response.' END,
    'Confidence: ' || CASE WHEN votes >= 3 THEN 'High' ELSE 'Medium' END || ' (' || votes || '/4 detectors agree)') AS report FROM (
    SELECT a.*, m.consumer_type, m.tariff_category, {KIND_SQL.replace('alert_id', 'a.alert_id')} AS kind, coalesce(estimated_daily_loss_inr, estimated_loss_units * 8) AS impact,
    concat_ws(',', CASE WHEN vae_score >= 0.65 THEN 'VAE' END, CASE WHEN eif_score >= 0.65 THEN 'EIF' END, CASE WHEN bocpd_flag THEN 'BOCPD' END, CASE WHEN gnn_score >= 0.65 THEN 'GNN' END) AS detectors,
    CAST(vae_score >= 0.65 AS INT) + CAST(eif_score >= 0.65 AS INT) + CAST(bocpd_flag AS INT) + CAST(gnn_score >= 0.65 AS INT) AS votes, s.factors,
    CASE WHEN month(alert_timestamp) = 1 AND day(alert_timestamp) = 1 THEN 'New Year' END AS note
    FROM alerts a JOIN meters m ON m.meter_id = a.meter_id JOIN (
    SELECT alert_id, string_agg('  - ' || {NAMES_SQL} || ': ' || CASE WHEN shap_value > 0 THEN 'pushed anomaly score higher' ELSE 'normal signal' END ||
    ' (SHAP=' || printf('%+.3f', shap_value) || ', value=' || printf('%.3f', value) || ')', chr(10) ORDER BY place) AS factors FROM shap GROUP BY 1) s ON s.alert_id = a.alert_id)""",
    "alerts meters shap",
    SHAP,
)
def _(v):
    k = F.col("alert_id") % 8
    kind = F.when(k == 0, "bypass").when(k == 1, "slowdown").when(k == 2, "flatline").when(k == 3, "other").otherwise("unknown")
    rows = explain.contributions(v.alerts, COEF)
    rows = anomaly.service_urgency(features.detector_votes(rows)).join(v.meters.select("meter_id", "consumer_type", "tariff_category"), "meter_id")
    t = F.col("alert_timestamp")
    note = F.when((F.month(t) == 1) & (F.dayofmonth(t) == 1), "New Year")
    return explain.alert_text(rows.withColumns({"anomaly_kind": kind, "calendar_note": note}))


@query(
    "c15_consumer_notice",
    "meter_id:i subject body",
    """SELECT meter_id, 'Unusual consumption pattern on your Utility account' AS subject, 'Dear consumer (' || meter_id || '), your electricity use over the past weeks was ' ||
    CAST(floor(abs(c) + 0.5E0) AS BIGINT) || '% ' || CASE WHEN c < 0 THEN 'lower' ELSE 'higher' END || ' than usual. If you know the reason, nothing is needed; if not, please contact us within 7 days.' AS body
    FROM (SELECT meter_id, -drop_fraction * 100 AS c FROM measured WHERE drop_fraction IS NOT NULL)""",
    "measured",
    FC,
)
def _(v):
    rows = explain.drop_measure(daily(v)).where(F.col("drop_fraction").isNotNull()).withColumn("change_pct", -F.col("drop_fraction") * 100)
    return explain.consumer_notice(rows, "change_pct")


FEATURE_DAYS = ("2024-01-24", "2024-01-31")
FEATURES_OF = {
    **FLAGS,
    **FILLED,
    # as far back as the longest lag, and nothing after the range
    "readings": (
        SQL["readings"][0],
        f"SELECT * FROM ({SQL['readings'][1]}) WHERE timestamp >= TIMESTAMP '{FEATURE_DAYS[0]}' - INTERVAL 42 DAY AND timestamp < TIMESTAMP '{FEATURE_DAYS[1]}'",
    ),
    "slots": (
        "imputed",
        f"""SELECT * FROM (SELECT meter_id, hour_ts, kwh, lag(kwh, 168) OVER w AS kwh_lag_168, lag(kwh, 1008) OVER w AS kwh_lag_1008,
        avg(kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS roll_mean_24,
        CASE WHEN max(kwh) OVER d > 0 THEN avg(kwh) OVER d / max(kwh) OVER d END AS load_factor_day FROM imputed
        WINDOW w AS (PARTITION BY meter_id ORDER BY hour_ts), d AS (PARTITION BY meter_id, CAST(hour_ts AS DATE)))
        WHERE hour_ts >= TIMESTAMP '{FEATURE_DAYS[0]}' AND hour_ts < TIMESTAMP '{FEATURE_DAYS[1]}'""",
    ),
    "group_stats": (
        "slots meters",
        "SELECT peer_cluster_id, hour_ts, avg(kwh) AS m, stddev(kwh) AS s FROM slots JOIN meters USING (meter_id) WHERE peer_cluster_id IS NOT NULL GROUP BY 1, 2",
    ),
    "losses": (
        "slots meters feeder_readings",
        """SELECT f.feeder_id, f.timestamp AS hour_ts, CASE WHEN feeder_input_kwh > 0 THEN (feeder_input_kwh - billed) / feeder_input_kwh END AS upstream_loss_ratio
        FROM feeder_readings f LEFT JOIN (SELECT feeder_id, hour_ts, sum(kwh) AS billed FROM slots JOIN meters USING (meter_id) GROUP BY 1, 2) b
        ON b.feeder_id = f.feeder_id AND b.hour_ts = f.timestamp""",
    ),
    "zone_hours": ("weather", "SELECT zone_id, date_trunc('hour', timestamp) AS hour_ts, avg(temp_c) AS temp_c FROM weather GROUP BY 1, 2"),
    "falls": (
        "register",
        """SELECT meter_id, date_trunc('hour', timestamp) AS hour_ts, bool_or(fell) AS fell FROM (SELECT *, cumulative_kwh < lag(cumulative_kwh)
        OVER (PARTITION BY meter_id ORDER BY timestamp, reading_id) AS fell FROM register) GROUP BY 1, 2""",
    ),
}


@query(
    "e0_feature_table",
    "meter_id:i hour_ts:s date:s kwh:d kwh_lag_168:d kwh_lag_1008:d roll_mean_24:d9 load_factor_day:d register_rollback:b z_vs_peer:d5 upstream_loss_ratio:d temp_c:d is_holiday:b tou_period",
    """SELECT s.*, CAST(s.hour_ts AS DATE) AS date, coalesce(fell, false) AS register_rollback, CASE WHEN g.s > 0 THEN (kwh - g.m) / g.s END AS z_vs_peer, upstream_loss_ratio, temp_c,
    coalesce(is_holiday, false) AS is_holiday, CASE WHEN hour(s.hour_ts) BETWEEN 6 AND 8 THEN 'normal' WHEN hour(s.hour_ts) BETWEEN 9 AND 17 THEN 'peak'
    WHEN hour(s.hour_ts) BETWEEN 18 AND 21 THEN 'critical' ELSE 'off_peak' END AS tou_period
    FROM slots s LEFT JOIN meters m ON m.meter_id = s.meter_id LEFT JOIN group_stats g ON g.peer_cluster_id = m.peer_cluster_id AND g.hour_ts = s.hour_ts
    LEFT JOIN losses l ON l.feeder_id = m.feeder_id AND l.hour_ts = s.hour_ts LEFT JOIN zone_hours z ON z.zone_id = m.zone AND z.hour_ts = s.hour_ts
    LEFT JOIN flags f ON f.date = CAST(s.hour_ts AS DATE) LEFT JOIN falls r ON r.meter_id = s.meter_id AND r.hour_ts = s.hour_ts""",
    "slots group_stats losses zone_hours flags falls meters",
    FEATURES_OF,
)
def _(v):
    """The whole feature job over the last week with its look-back, written by date and read again."""
    path = shared_folder(v.spark, "features")
    rows = reports.write_feature_table(v, path, *FEATURE_DAYS)
    out = read_dates(v.spark, path, "hour_ts", *FEATURE_DAYS)
    # what was counted while writing is what stands there
    return out.where(F.when(out.groupBy().agg(F.count(F.lit(1))).scalar() == rows, F.lit(True)).otherwise(F.raise_error(F.lit("rows are missing"))))
