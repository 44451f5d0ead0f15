"""Anomaly scores (I), audit chains (K), quality and evaluation (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scaling import quantiles
from meterlake.operators import anomaly, audit, features, grid, joins, models, quality, rollup
from meterlake.plans import reports
from meterlake.plans.catalog import query
from meterlake.plans.join_queries import FLAGS, changes, current_topology, daily
from meterlake.plans.rollup_queries import REPORT
from meterlake.sources.storage import settle

LABELLED = {
    "labelled": (
        "alerts feedback",
        """SELECT a.*, CASE feedback_type WHEN 'true_positive' THEN 1 WHEN 'false_positive' THEN 0 END AS label
        FROM alerts a JOIN feedback f ON f.alert_id = a.alert_id WHERE feedback_type IN ('true_positive', 'false_positive')""",
    ),
    **FLAGS,
}


def labelled(v):
    return v.alerts.join(audit.training_labels(v.feedback), "alert_id")


def vectors(v):
    return anomaly.daily_vectors(v.hourly, v.meters)


def normal_vectors(v):
    theft = v.readings.where("is_theft_flag").select("meter_id", F.to_date("timestamp").alias("date")).distinct()
    return vectors(v).join(theft, ["meter_id", "date"], "left_anti")


@query("i1_isolation_forest", "meter_id:i date:s isolation:d")
def _(v):
    forest = models.IsolationForest().fit(normal_vectors(v), ["meter_id", "date"], "vector")
    return forest.score(vectors(v), "vector", "isolation")


@query(
    "i2_score_threshold",
    "threshold:d",
    "SELECT quantile_cont(anomaly_score, 0.99) AS threshold FROM alerts WHERE status <> 'False Positive'",
    "alerts",
)
def _(v):
    return quantiles(v.alerts.where(F.col("status") != "False Positive"), [], "anomaly_score", {"threshold": 0.99})


@query(
    "i3_sigmoid_probability",
    "alert_id:i around:d relative:d",
    """SELECT alert_id, 1 / (1 + exp(-(vae_score - t) * 5)) AS around, 1 / (1 + exp(-(vae_score - t) / (t * 0.5 + 1E-8))) AS relative
    FROM alerts, (SELECT quantile_cont(vae_score, 0.9) AS t FROM alerts)""",
    "alerts",
)
def _(v):
    cut = anomaly.threshold(v.alerts, "vae_score", 0.9)
    rows = v.alerts.withColumn("_t", cut)
    score, t = F.col("vae_score"), F.col("_t")
    return rows.select("alert_id", anomaly.sigmoid_around(score, t).alias("around"), anomaly.sigmoid_relative(score, t).alias("relative"))


@query("i4_isotonic_calibration", "alert_id:i anomaly_score:d label:i calibrated:d")
def _(v):
    return models.calibrate(labelled(v), "anomaly_score", "label", "calibrated")


@query(
    "i5_min_max_scores",
    "alert_id:i scaled:d9",
    """SELECT alert_id, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1E-9) AS scaled FROM (SELECT alert_id, estimated_loss_units AS v FROM alerts)""",
    "alerts",
)
def _(v):
    return anomaly.min_max(v.alerts, "estimated_loss_units", "scaled")


@query("i6_reconstruction_error", "meter_id:i date:s recon_error:d is_anomaly:b")
def _(v):
    scored = reconstructed(v)
    theft = v.readings.where("is_theft_flag").select("meter_id", F.to_date("timestamp").alias("date")).distinct()
    # the cut comes from days without a known theft
    cut = anomaly.threshold(scored.join(theft, ["meter_id", "date"], "left_anti"), "recon_error", 0.99)
    return scored.withColumn("_t", cut).withColumn("is_anomaly", F.col("recon_error") > F.col("_t"))


def theft(v):
    """The forest and its scored later days. Every query fits its own: a kept one would go on scoring tables that have changed."""
    return models.theft_classifier(reports.theft_days(v), reports.THEFT_FEATURES, "theft_label", "date", ["meter_id"])[:2]


@query("i7_theft_classifier", "meter_id:i date:s theft_label:i supervised:d")
def _(v):
    return theft(v)[1].select("meter_id", "date", "theft_label", "supervised")


@query(
    "i8_score_blend",
    "alert_id:i blended:d predicted_theft:i",
    "SELECT alert_id, 0.7E0 * vae_score + 0.3E0 * eif_score AS blended, CAST(round(0.7E0 * vae_score + 0.3E0 * eif_score, 9) >= 0.5 AS INT) AS predicted_theft FROM alerts",
    "alerts",
)
def _(v):
    b = anomaly.blend(F.col("vae_score"), F.col("eif_score"))
    return v.alerts.select("alert_id", b.alias("blended"), (F.round(b, 9) >= 0.5).cast("int").alias("predicted_theft"))


@query("i9_feature_importance", "feature importance:d")
def _(v):
    return models.importances(v.spark, theft(v)[0], reports.THEFT_FEATURES)


@query("e0_scoring_chain", "meter_id:i date:s theft_label:i supervised:d isolation:d blended:d predicted_theft:i")
def _(v):
    """Daily features to forest and isolation scores, scaled, blended and cut; the 500 most suspicious later days."""
    scored = theft(v)[1]
    forest = models.IsolationForest().fit(normal_vectors(v), ["meter_id", "date"], "vector")
    alone = forest.score(vectors(v), "vector", "isolation").select("meter_id", "date", F.col("isolation").alias("raw"))
    alone = anomaly.min_max(alone, "raw", "isolation").select("meter_id", "date", "isolation")
    rows = scored.select("meter_id", "date", "theft_label", "supervised").join(alone, ["meter_id", "date"], "left")
    rows = rows.withColumn("blended", anomaly.blend(F.col("supervised"), F.coalesce("isolation", F.lit(0.0))))
    rows = rows.withColumn("predicted_theft", (F.round("blended", 9) >= 0.5).cast("int"))
    return rows.orderBy(F.desc(F.round("blended", 9)), "meter_id", "date").limit(500)


def reconstructed(v):
    cells = [F.col(c) for c in rollup.HOURS]
    rows = rollup.hour_pivot(v.readings).select("meter_id", "date", F.array(*cells).alias("profile"))
    return models.reconstruction_errors(rows, "profile", 16)


def detector_columns(v):
    """The nine detector outputs of each meter: reconstruction, isolation, changepoint, neighbours, feeder balance, peers,
    load factor, night share and flatline. A detector that has nothing to say of a meter leaves a null."""
    slots = settle(v.hourly.select("meter_id", "hour_ts", "kwh"), "hours")
    per_meter = lambda df, c, name: df.groupBy("meter_id").agg(F.avg(c).alias(name))
    forest = models.IsolationForest().fit(normal_vectors(v), ["meter_id", "date"], "vector")
    breaks = models.changepoints(slots, "meter_id", "hour_ts", "kwh")
    days = reports.meter_days(slots, v.meters).groupBy("meter_id").agg(
        F.avg("peer_z").alias("peer_z_score"), F.avg("load_factor").alias("load_factor_day"), F.avg("night_ratio").alias("night_ratio")
    )
    flat = features.rolling(slots, "kwh", [4]).groupBy("meter_id").agg(F.max((F.col("roll_std_4") < 0.01).cast("double")).alias("is_flatline"))
    gaps = grid.neighbour_means(v.profiles, current_topology(v)).groupBy("meter_id").agg(F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("gnn_node_score"))
    loss = joins.feeder_balance(slots, current_topology(v), v.feeder_readings).groupBy("feeder_id").agg(F.avg("upstream_loss_ratio").alias("gnn_balance_score"))
    parts = [
        per_meter(reconstructed(v), "recon_error", "vae_score"),
        per_meter(forest.score(vectors(v), "vector", "isolation"), "isolation", "eif_score"),
        breaks.groupBy("meter_id").agg(F.lit(1.0).alias("bocpd_detected")),
        gaps,
        current_topology(v).select("meter_id", "feeder_id").distinct().join(loss, "feeder_id").groupBy("meter_id").agg(F.avg("gnn_balance_score").alias("gnn_balance_score")),
        days,
        flat,
    ]
    out = v.meters.select("meter_id")
    for part in parts:
        out = out.join(part, "meter_id", "left")
    return settle(out, "detectors")


@query("i10_detector_columns", "meter_id:i vae_score:d eif_score:d bocpd_detected:d gnn_node_score:d gnn_balance_score:d peer_z_score:d load_factor_day:d night_ratio:d is_flatline:d")
def _(v):
    return detector_columns(v)


@query("i10_meta_classifier", "alert_id:i theft_probability:d")
def _(v):
    nine = detector_columns(v)
    scored = v.alerts.drop("vae_score", "eif_score").join(nine, "meter_id", "left")
    label = audit.training_labels(v.feedback).select("alert_id", "label")
    return models.meta_classifier(scored.join(label, "alert_id"), scored, models.META_FEATURES, "label")


@query(
    "i11_log_urgency",
    "alert_id:i urgency:d",
    """SELECT alert_id, anomaly_score * ln(1 + greatest(estimated_loss_units - estimated_daily_loss_inr / 100, 0) * 96 * 30 * 6.5E0) AS urgency FROM alerts""",
    "alerts",
)
def _(v):
    u = anomaly.urgency(F.col("anomaly_score"), F.col("estimated_loss_units"), F.col("estimated_daily_loss_inr") / 100, F.lit(None).cast("double"))
    # greatest ignores nulls here as in the check text
    return v.alerts.select("alert_id", u.alias("urgency"))


@query(
    "i12_service_urgency",
    "alert_id:i revenue_impact:d urgency_score:d",
    """SELECT alert_id, r AS revenue_impact, anomaly_score * greatest(1, r) * 10 AS urgency_score FROM (
    SELECT *, coalesce(estimated_daily_loss_inr, estimated_loss_units * 8) AS r FROM alerts)""",
    "alerts",
)
def _(v):
    return anomaly.service_urgency(v.alerts)


@query("i13_changepoints", "meter_id:i position:i hour_ts:s probability:d")
def _(v):
    return models.changepoints(v.hourly, "meter_id", "hour_ts", "kwh")


@query("i13_changepoint_function", "meter_id:i position:i hour_ts:s probability:d")
def _(v):
    v.spark.udtf.register("changepoints", models.ChangepointTable)
    hours = v.hourly.select("meter_id", "hour_ts", "kwh")
    return v.spark.sql("SELECT * FROM changepoints(TABLE(SELECT * FROM {hours}) PARTITION BY meter_id ORDER BY hour_ts)", hours=hours)


@query("i14_recent_changepoint", "meter_id:i recent_changepoint:b last_changepoint:s")
def _(v):
    slots = v.hourly
    return models.recent_changepoint(slots, models.changepoints(slots, "meter_id", "hour_ts", "kwh"), "meter_id", "hour_ts", 168)  # a week of hours


@query(
    "i15_sigma_and_fences",
    "reading_id:i kwh:d sigma_outlier:b fence_outlier:b",
    """SELECT reading_id, kwh, kwh > m + 3 * s OR kwh < m - 3 * s AS sigma_outlier,
    kwh > q3 + 1.5 * (q3 - q1) OR kwh < q1 - 1.5 * (q3 - q1) AS fence_outlier FROM readings r
    LEFT JOIN (SELECT meter_id, avg(kwh) AS m, stddev(kwh) AS s, quantile_cont(kwh, 0.25) AS q1, quantile_cont(kwh, 0.75) AS q3 FROM readings GROUP BY 1) t
    ON t.meter_id = r.meter_id""",
    "readings",
)
def _(v):
    return anomaly.fence_flags(anomaly.sigma_flags(v.readings, ["meter_id"], "kwh"), ["meter_id"], "kwh")


EVIDENCE = {
    **FLAGS,
    "day_loss": (
        "balance meters",
        """SELECT meter_id, date, loss_ratio FROM meters JOIN (SELECT feeder_id, CAST(timestamp AS DATE) AS date,
        (sum(feeder_input_kwh) - sum(billed_kwh)) / nullif(sum(feeder_input_kwh), 0) AS loss_ratio FROM balance GROUP BY 1, 2) USING (feeder_id)""",
    ),
    "evidence": (
        "with_peers readings day_loss",
        """SELECT f.*, l.loss_ratio FROM (SELECT meter_id, CAST(hour_ts AS DATE) AS date, bool_or(register_step < 0) AS rollback, max(kwh / nullif(kvah, 0)) AS power_factor,
        stddev(kwh) < 0.5 AS flatline, (max(kwh) - min(kwh)) / nullif(max(kwh), 0) AS drop_ratio, avg(kwh) / nullif(max(kwh), 0) AS load_factor,
        avg(z_vs_peer) AS peer_z FROM with_peers GROUP BY 1, 2) f LEFT JOIN day_loss l ON l.meter_id = f.meter_id AND l.date = f.date""",
    ),
}


@query(
    "i16_pattern_rules",
    "meter_id:i date:s anomaly_kind",
    """SELECT meter_id, date, CASE WHEN coalesce(rollback, false) THEN 'clock_fraud' WHEN coalesce(power_factor > 1, false) THEN 'phase_reversal'
    WHEN coalesce(flatline, false) THEN 'flatline' WHEN coalesce(drop_ratio > 0.8 AND load_factor < 0.5, false) THEN 'bypass'
    WHEN coalesce(peer_z < -0.8, false) THEN 'slowdown' WHEN coalesce(loss_ratio > 0.08, false) THEN 'illegal_extension' ELSE 'unknown' END AS anomaly_kind FROM evidence""",
    "evidence",
    EVIDENCE,
)
def _(v):
    rows = joins.with_peers(v.hourly, v.meters)
    x = F.col("kwh")
    facts = rows.groupBy("meter_id", F.to_date("hour_ts").alias("date")).agg(
        F.bool_or(F.col("register_step") < 0).alias("rollback"),
        F.max(F.try_divide(x, F.col("kvah"))).alias("power_factor"),
        (F.round(F.stddev(x), 12) < 0.5).alias("flatline"),
        F.try_divide(F.max(x) - F.min(x), F.max(x)).alias("drop_ratio"),
        F.try_divide(F.avg(x), F.max(x)).alias("load_factor"),
        F.avg("z_vs_peer").alias("peer_z"),
    )
    loss = joins.feeder_balance(v.hourly, current_topology(v), v.feeder_readings)
    loss = loss.groupBy("feeder_id", F.to_date("timestamp").alias("date")).agg(
        F.try_divide(F.sum("feeder_input_kwh") - F.sum("billed_kwh"), F.sum("feeder_input_kwh")).alias("loss_ratio")
    )
    facts = facts.join(v.meters.select("meter_id", "feeder_id"), "meter_id", "left").join(loss, ["feeder_id", "date"], "left")
    return anomaly.pattern(facts)


@query(
    "i17_detectors_agreeing",
    "alert_id:i detectors detectors_agreeing:i",
    """SELECT alert_id, concat_ws(',', CASE WHEN vae_score >= 0.65 THEN 'VAE' END, CASE WHEN eif_score >= 0.65 THEN 'EIF' END,
    CASE WHEN bocpd_flag THEN 'BOCPD' END, CASE WHEN gnn_score >= 0.65 THEN 'GNN' END) AS detectors,
    CAST(vae_score >= 0.65 AS INT) + CAST(eif_score >= 0.65 AS INT) + CAST(bocpd_flag AS INT) + CAST(gnn_score >= 0.65 AS INT) AS detectors_agreeing FROM alerts""",
    "alerts",
)
def _(v):
    return features.detector_votes(v.alerts)


@query(
    "i18_threshold_sweep",
    "cut:d alerts:i precision:d recall:d",
    """SELECT c / 20E0 AS cut, count(*) FILTER (s >= c) AS alerts, count(*) FILTER (s >= c AND label = 1) / nullif(count(*) FILTER (s >= c), 0) AS precision,
    count(*) FILTER (s >= c AND label = 1) / nullif(count(*) FILTER (label = 1), 0) AS recall FROM (
    SELECT label, least(CAST(floor(anomaly_score * 20 + 1E-9) AS INT), 20) AS s FROM labelled), range(21) r(c) GROUP BY c""",
    "labelled",
    LABELLED,
)
def _(v):
    return anomaly.sweep(labelled(v), "anomaly_score", "label", 20)


@query(
    "i19_support_gate",
    "meter_id:i days:i baseline_mean:d gate",
    """SELECT meter_id, days, baseline_mean, CASE WHEN days < 14 THEN 'Insufficient data' WHEN baseline_mean < 1E-3 THEN 'Near-zero baseline' END AS gate FROM (
    SELECT meter_id, count(*) AS days, avg(kwh) FILTER (up <= 21) AS baseline_mean FROM (
    SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY date) AS up FROM daily WHERE kwh IS NOT NULL) GROUP BY 1)""",
    "daily",
    FLAGS,
)
def _(v):
    from meterlake.operators.explain import drop_measure, enough_support

    return drop_measure(daily(v)).withColumn("gate", enough_support(F.col("days"), F.col("baseline_mean")))


# ---------------------------------------------------------------- K

CHAIN = {
    "log_rows": (
        "audits",
        """SELECT related_alert_id AS alert_id, '{"inspector_id":' || inspector_id || ',"outcome":"' || outcome || '","part_id":' || part_id || ',"step":' || step || '}' AS payload,
        row_number() OVER (PARTITION BY related_alert_id ORDER BY action_timestamp, step, part_id, inspector_id) AS position FROM audits""",
    ),
}
CHAIN_SQL = """WITH RECURSIVE links AS (
    SELECT alert_id, position, payload, 'genesis:' || alert_id || ':0' AS prev_hash, sha256('genesis:' || alert_id || ':0' || payload) AS entry_hash FROM log_rows WHERE position = 1
    UNION ALL SELECT r.alert_id, r.position, r.payload, l.entry_hash, sha256(l.entry_hash || r.payload) FROM links l JOIN log_rows r ON r.alert_id = l.alert_id AND r.position = l.position + 1)
    """


def logged():
    return audit.canonical_json(["step", "part_id", "inspector_id", "outcome"])


def audit_log(v):
    return v.audits.withColumnRenamed("related_alert_id", "alert_id")


def chained(v):
    return audit.chain(audit_log(v), "alert_id", F.date_trunc("month", "action_timestamp"), ["action_timestamp", "step", "part_id", "inspector_id"], "payload", logged())


def _recursive(tail: str) -> str:
    from meterlake.sources.views import with_views

    head = with_views("log_rows", "SELECT 1", CHAIN)
    body = head[: head.rindex("SELECT 1")].strip()
    return body.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + CHAIN_SQL.strip()[len("WITH RECURSIVE ") :] + tail


@query(
    "k1_hash_chain",
    "alert_id:i position:i prev_hash entry_hash",
    _recursive("SELECT alert_id, position, prev_hash, entry_hash FROM links"),
)
def _(v):
    return chained(v)


TAMPERED = """SELECT alert_id, position FROM (SELECT *, CASE WHEN outcome_pending AND position = 2 THEN payload || ' ' ELSE payload END AS seen,
    lag(entry_hash) OVER (PARTITION BY alert_id ORDER BY position) AS before FROM (SELECT *, contains(payload, 'Pending') AS outcome_pending FROM links))
    WHERE sha256(prev_hash || seen) <> entry_hash"""


@query("k2_broken_links", "alert_id:i position:i", _recursive(TAMPERED))
def _(v):
    rows = chained(v)
    # someone edits the second entry of a chain wherever it was pending
    edited = F.when((F.col("position") == 2) & F.contains(F.col("payload"), F.lit("Pending")), F.concat("payload", F.lit(" ")))
    return audit.broken_links(rows.withColumn("payload", F.coalesce(edited, F.col("payload"))), "alert_id", "payload")


@query("k3_canonical_json", "alert_id:i position:i payload", "SELECT alert_id, position, payload FROM log_rows", "log_rows", CHAIN)
def _(v):
    from meterlake.functions.scaling import running

    return running(
        audit_log(v), ["alert_id"], F.date_trunc("month", "action_timestamp"), ["action_timestamp", "step", "part_id", "inspector_id"], number="position", small=True
    ).withColumn("payload", logged())


MOVES = " OR ".join(
    "(prev = '{}' AND state IN ({}))".format(a, ", ".join(f"'{b}'" for b in bs)) for a, bs in audit.ALLOWED_MOVES.items()
)


@query(
    "k4_status_transitions",
    "alert_id:i step:i part_id:i inspector_id:i state prev_state allowed:b",
    f"""SELECT *, prev AS prev_state, prev IS NULL OR prev = state OR {MOVES} AS allowed FROM (
    SELECT related_alert_id AS alert_id, step, part_id, inspector_id, state, lag(state) OVER (PARTITION BY related_alert_id ORDER BY action_timestamp, step, part_id, inspector_id) AS prev FROM (
    SELECT *, CASE outcome WHEN 'Fail' THEN 'Assigned' WHEN 'Pass' THEN 'Resolved' ELSE 'Snoozed' END AS state FROM audits))""",
    "audits",
)
def _(v):
    log = v.audits.withColumnRenamed("related_alert_id", "alert_id").withColumn(
        "state", F.when(F.col("outcome") == "Fail", "Assigned").when(F.col("outcome") == "Pass", "Resolved").otherwise("Snoozed")
    )
    return audit.transitions(log, "alert_id", F.date_trunc("month", "action_timestamp"), ["action_timestamp", "step", "part_id", "inspector_id"], "state")


@query("k5_training_labels", "alert_id:i anomaly_score:d label:i", "SELECT alert_id, anomaly_score, label FROM labelled", "labelled", LABELLED)
def _(v):
    return labelled(v)


@query(
    "k6_feedback_append",
    "feedback_id alert_id:i feedback_type feedback_timestamp:s",
    """SELECT 'FBK-' || alert_id AS feedback_id, alert_id, feedback_type, NULL AS feedback_timestamp FROM feedback
    UNION ALL SELECT 'FBK-UI-20240201093000-' || alert_id, alert_id, 'no_issue', TIMESTAMP '2024-02-01 09:30:00' FROM (
    SELECT alert_id + 14800 AS alert_id FROM feedback) WHERE alert_id IN (SELECT alert_id FROM alerts)""",
    "feedback alerts",
)
def _(v):
    incoming = v.feedback.select((F.col("alert_id") + 14_800).alias("alert_id"), F.lit("no_issue").alias("feedback_type"))
    return audit.append_feedback(v.feedback, incoming, v.alerts, "2024-02-01 09:30:00")


# ---------------------------------------------------------------- M

PSI_EDGES = "SELECT [" + ", ".join(f"quantile_cont(kwh, {i / 10})" for i in range(1, 10)) + "] AS e FROM readings WHERE timestamp < TIMESTAMP '2024-01-16'"


@query(
    "m1_stability_index",
    "bin:i base_rows:i current_rows:i contribution:d",
    """SELECT bin, base_rows, current_rows, (q - p) * ln(q / p) AS contribution FROM (SELECT *, greatest(base_rows / sum(base_rows) OVER (), 1E-4) AS p,
    greatest(current_rows / sum(current_rows) OVER (), 1E-4) AS q FROM (
    SELECT len(list_filter(e, lambda x: x < kwh)) AS bin, count(*) FILTER (timestamp < TIMESTAMP '2024-01-16') AS base_rows,
    count(*) FILTER (timestamp >= TIMESTAMP '2024-01-16') AS current_rows FROM readings, psi_edges WHERE kwh IS NOT NULL GROUP BY 1))""",
    "readings psi_edges",
    {"psi_edges": ("readings", PSI_EDGES)},
)
def _(v):
    cut = F.lit("2024-01-16").cast("timestamp")
    return quality.stability_index(v.readings.where(F.col("timestamp") < cut), v.readings.where(F.col("timestamp") >= cut), "kwh")


@query(
    "m2_model_health",
    "model_name mape:d precision:d recall:d drift:d8 last_evaluated:s status",
    """SELECT *, CASE WHEN drift > 0.25 THEN 'Critical' WHEN drift > 0.15 THEN 'Watch' ELSE 'Healthy' END AS status FROM (
    SELECT model_name, max(metric_value) FILTER (metric_type = 'mape_pct') AS mape, max(metric_value) FILTER (metric_type = 'precision') AS precision,
    max(metric_value) FILTER (metric_type = 'recall') AS recall, max(feature_drift_psi) AS drift, max(evaluation_date) AS last_evaluated FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name, metric_type ORDER BY evaluation_date DESC) AS rn FROM model_perf) WHERE rn = 1 GROUP BY 1)""",
    "model_perf",
)
def _(v):
    return quality.model_health(v.model_perf)


@query(
    "m3_drift_history",
    "evaluation_date:s model_name metric_type metric_value:d8 feature_drift_psi:d8",
    "SELECT * FROM model_perf ORDER BY evaluation_date DESC, model_name DESC, metric_type DESC LIMIT 250",
    "model_perf",
)
def _(v):
    return quality.drift_history(v.model_perf)


@query(
    "m4_ingestion_freshness",
    "feeder_id meters:i missing_pct_7d:d missing_pct_30d:d last_reading_at:s status",
    """SELECT *, CASE WHEN missing_pct_7d < 50 THEN 'ok' WHEN missing_pct_7d < 95 THEN 'warning' ELSE 'error' END AS status FROM (
    SELECT feeder_id, count(*) AS meters, 100 - coalesce(sum(n7), 0) * 100E0 / (count(*) * 168) AS missing_pct_7d,
    100 - coalesce(sum(n30), 0) * 100E0 / (count(*) * 720) AS missing_pct_30d, max(last_at) AS last_reading_at FROM meters m LEFT JOIN (
    SELECT meter_id, count(DISTINCT date_trunc('hour', timestamp)) FILTER (timestamp >= TIMESTAMP '2024-01-24') AS n7,
    count(DISTINCT date_trunc('hour', timestamp)) FILTER (timestamp >= TIMESTAMP '2024-01-01') AS n30, max(timestamp) AS last_at
    FROM readings WHERE timestamp < TIMESTAMP '2024-01-31' GROUP BY 1) r ON r.meter_id = m.meter_id GROUP BY 1)""",
    "meters readings",
)
def _(v):
    return quality.freshness(v.readings, v.meters, "2024-01-31 00:00:00")


@query(
    "m5_domain_and_key_checks",
    "check violations:i rows:i",
    """SELECT 'alerts.severity in list' AS check, count(*) FILTER (severity NOT IN ('Critical', 'High', 'Medium')) AS violations, count(*) AS rows FROM alerts
    UNION ALL SELECT 'readings.communication_status in list', count(*) FILTER (communication_status NOT IN (0, 1)), count(*) FROM readings
    UNION ALL SELECT 'feedback.alert_id exists', count(*) FILTER (alert_id NOT IN (SELECT alert_id FROM alerts)), count(*) FROM feedback
    UNION ALL SELECT 'meters.meter_id exists', count(*) FILTER (meter_id NOT IN (SELECT meter_id FROM readings)), count(*) FROM meters""",
    "alerts readings feedback meters",
)
def _(v):
    return (
        quality.domain_check(v.alerts, "alerts", "severity", ["Critical", "High", "Medium"])
        .unionByName(quality.domain_check(v.readings, "readings", "communication_status", [0, 1]))
        .unionByName(quality.reference_check(v.feedback, "feedback", "alert_id", v.alerts, "alert_id"))
        .unionByName(quality.reference_check(v.meters, "meters", "meter_id", v.readings, "meter_id"))
    )


@query(
    "m6_forecast_errors",
    "zone rows:i mape:d rmse:d picp:d pinaw:d skill_vs_naive:d",
    """SELECT f.zone, count(*) AS rows, avg(abs(f.actual_mw - f.forecast_mw) / greatest(f.actual_mw, 1E-6)) AS mape, sqrt(avg((f.actual_mw - f.forecast_mw) ** 2)) AS rmse,
    avg(CASE WHEN f.actual_mw BETWEEN f.p10_mw AND f.p90_mw THEN 1E0 ELSE 0E0 END) AS picp, avg(f.p90_mw - f.p10_mw) / (max(f.actual_mw) - min(f.actual_mw)) AS pinaw,
    1 - sqrt(avg(CASE WHEN n.actual_mw IS NOT NULL THEN (f.actual_mw - f.forecast_mw) ** 2 END)) / sqrt(avg((f.actual_mw - n.actual_mw) ** 2)) AS skill_vs_naive
    FROM forecasts f LEFT JOIN forecasts n ON n.zone = f.zone AND n.forecast_date = f.forecast_date - 7 GROUP BY 1""",
    "forecasts",
)
def _(v):
    from meterlake.operators.forecast import seasonal_naive

    return quality.forecast_errors(seasonal_naive(v.forecasts), ["zone"])


@query(
    "m7_classifier_metrics",
    "tp:i fp:i fn:i precision:d recall:d f1:d fdr:d",
    """SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (tp + fp) AS fdr FROM (
    SELECT count(*) FILTER (anomaly_score >= 0.5 AND label = 1) AS tp, count(*) FILTER (anomaly_score >= 0.5 AND label = 0) AS fp,
    count(*) FILTER (anomaly_score < 0.5 AND label = 1) AS fn FROM labelled)""",
    "labelled",
    LABELLED,
)
def _(v):
    return quality.classifier_metrics(labelled(v), "anomaly_score", "label")


@query(
    "m8_roc_auc_and_average_precision",
    "positives:i negatives:i roc_auc:d average_precision:d",
    """SELECT p AS positives, n AS negatives, (SELECT avg(CASE WHEN a.anomaly_score > b.anomaly_score THEN 1E0 WHEN a.anomaly_score = b.anomaly_score THEN 0.5E0 ELSE 0E0 END)
    FROM labelled a, labelled b WHERE a.label = 1 AND b.label = 0) AS roc_auc,
    (SELECT sum(pos * cp / cn) FROM (SELECT anomaly_score, count(*) FILTER (label = 1) AS pos, sum(count(*) FILTER (label = 1)) OVER (ORDER BY anomaly_score DESC) AS cp,
    sum(count(*)) OVER (ORDER BY anomaly_score DESC) AS cn FROM labelled GROUP BY 1)) / p AS average_precision
    FROM (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM labelled)""",
    "labelled",
    LABELLED,
)
def _(v):
    return quality.ranking_quality(labelled(v), "anomaly_score", "label")


@query(
    "m9_precision_at_k",
    "month:s precision_at_k:d rows:i",
    """SELECT month, avg(CAST(label AS DOUBLE)) AS precision_at_k, count(*) AS rows FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY anomaly_score DESC, alert_id) AS rn FROM (SELECT *, date_trunc('month', alert_timestamp) AS month FROM labelled)) WHERE rn <= 5 GROUP BY 1""",
    "labelled",
    LABELLED,
)
def _(v):
    rows = labelled(v).withColumn("month", F.date_trunc("month", "alert_timestamp"))
    return quality.precision_at_k(rows, "month", "anomaly_score", "alert_id", "label", 5)


@query(
    "m10_time_to_detect",
    "onsets:i detected:i mean_days_to_detect:d",
    """SELECT count(*) AS onsets, count(found) AS detected, avg(date_diff('day', onset, found)) AS mean_days_to_detect FROM (
    SELECT o.meter_id, onset, min(c.date) AS found FROM (SELECT meter_id, min(CAST(timestamp AS DATE)) AS onset FROM readings WHERE is_theft_flag GROUP BY 1) o
    LEFT JOIN changes c ON c.meter_id = o.meter_id AND c.date >= o.onset GROUP BY 1, 2)""",
    "readings changes",
    FLAGS,
)
def _(v):
    onsets = v.readings.where("is_theft_flag").select("meter_id", F.to_date("timestamp").alias("date"))
    return quality.time_to_detect(onsets, changes(v))


@query(
    "m11_pinball_loss",
    "zone q10:d q50:d q90:d",
    """SELECT zone, """
    + ", ".join(
        f"avg(CASE WHEN actual_mw >= {c} THEN (actual_mw - {c}) * {q} ELSE (actual_mw - {c}) * ({q} - 1) END) AS q{int(q * 100)}"
        for c, q in (("p10_mw", 0.1), ("p50_mw", 0.5), ("p90_mw", 0.9))
    )
    + " FROM forecasts GROUP BY 1",
    "forecasts",
)
def _(v):
    return v.forecasts.groupBy("zone").agg(
        *[F.avg(quality.pinball_loss(v.forecasts, "actual_mw", c, q)).alias(f"q{int(q * 100)}") for c, q in (("p10_mw", 0.1), ("p50_mw", 0.5), ("p90_mw", 0.9))]
    )


@query(
    "m12_forecast_summary",
    "points:i peak_forecast_mw:d10 peak_date:s mean_band_width_mw:d mean_abs_gap_mw:d",
    """SELECT count(*) AS points, max(forecast_mw) AS peak_forecast_mw, arg_max(forecast_date, forecast_mw) AS peak_date,
    avg(upper90 - lower90) AS mean_band_width_mw, avg(abs(actual_mw - forecast_mw)) AS mean_abs_gap_mw FROM points""",
    "points",
    REPORT,
)
def _(v):
    from meterlake.operators.forecast import forecast_points, summary

    return summary(forecast_points(v.forecasts))
