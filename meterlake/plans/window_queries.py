"""Window computations (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scaling import ntile, ranks, running
from meterlake.operators import features, rollup
from meterlake.operators.ranking import top_per_key
from meterlake.plans.catalog import query
from meterlake.plans.join_queries import FLAGS, daily

W = "(PARTITION BY meter_id ORDER BY hour_ts)"


@query(
    "e1_row_lags",
    "meter_id:i hour_ts:s kwh:d kwh_lag_1:d kwh_lag_2:d kwh_lag_24:d kwh_lag_168:d kwh_lag_336:d kwh_lag_1008:d",
    f"""SELECT meter_id, hour_ts, kwh, {', '.join(f'lag(kwh, {k}) OVER {W} AS kwh_lag_{k}' for k in (1, 2, 24, 168, 336, 1008))} FROM grid""",
    "grid",
)
def _(v):
    return features.lags(v.grid, "kwh", [1, 2, 24, 168, 336, 1008])


ROLL = ", ".join(
    f"avg(kwh) OVER w{k} AS roll_mean_{k}, stddev(kwh) OVER w{k} AS roll_std_{k}, max(kwh) OVER w{k} AS roll_max_{k}" for k in (4, 24, 168)
)
ROLL_W = ", ".join(f"w{k} AS (PARTITION BY meter_id ORDER BY hour_ts ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)" for k in (4, 24, 168))


@query(
    "e2_rolling_statistics",
    "meter_id:i hour_ts:s " + " ".join(f"roll_mean_{k}:d roll_std_{k}:d5 roll_max_{k}:d" for k in (4, 24, 168)),
    f"SELECT meter_id, hour_ts, {ROLL} FROM grid WINDOW {ROLL_W}",
    "grid",
)
def _(v):
    return features.rolling(v.grid, "kwh", [4, 24, 168])


@query(
    "e3_time_range_mean",
    "reading_id:i range_mean:d range_rows:i",
    """SELECT reading_id, avg(kwh) OVER w AS range_mean, count(*) OVER w AS range_rows FROM readings
    WINDOW w AS (PARTITION BY meter_id ORDER BY timestamp RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
    "readings",
)
def _(v):
    return features.range_mean(v.readings, "kwh", 6 * 3600)


NIGHT = "(hour(hour_ts) >= 22 OR hour(hour_ts) < 6)"


@query(
    "e4_daily_load_factor",
    "meter_id:i hour_ts:s daily_mean:d daily_max:d load_factor_day:d9",
    """SELECT meter_id, hour_ts, avg(kwh) OVER w AS daily_mean, max(kwh) OVER w AS daily_max,
    CASE WHEN max(kwh) OVER w > 0 THEN avg(kwh) OVER w / max(kwh) OVER w END AS load_factor_day
    FROM grid WINDOW w AS (PARTITION BY meter_id, CAST(hour_ts AS DATE))""",
    "grid",
)
def _(v):
    return features.day_statistics(v.grid)


@query(
    "e5_day_over_day_change",
    "meter_id:i hour_ts:s kwh_delta_1d:d",
    f"SELECT meter_id, hour_ts, CASE WHEN p > 0 THEN (kwh - p) / p END AS kwh_delta_1d FROM (SELECT *, lag(kwh, 24) OVER {W} AS p FROM grid)",
    "grid",
)
def _(v):
    rows = features.lags(v.grid, "kwh", [24])
    return rows.withColumn("kwh_delta_1d", features.change_ratio(F.col("kwh"), F.col("kwh_lag_24")))


@query(
    "e6_flatline",
    "meter_id:i hour_ts:s is_flatline:b",
    """SELECT meter_id, hour_ts, stddev(kwh) OVER (PARTITION BY meter_id ORDER BY hour_ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) < 0.01 AS is_flatline FROM grid""",
    "grid",
)
def _(v):
    return features.rolling(v.grid, "kwh", [4]).withColumn("is_flatline", F.col("roll_std_4") < 0.01)


@query(
    "e7_register_rollback",
    "reading_id:i cumulative_kwh:d4 cumulative_rollback:b",
    """SELECT reading_id, cumulative_kwh, cumulative_kwh < lag(cumulative_kwh) OVER (PARTITION BY meter_id ORDER BY timestamp, reading_id) AS cumulative_rollback FROM register""",
    "register",
)
def _(v):
    return features.rollback(v.register)


@query(
    "e8_night_day_ratio",
    "meter_id:i hour_ts:s night_sum:d day_sum:d night_ratio:d",
    f"""SELECT meter_id, hour_ts, sum(CASE WHEN {NIGHT} THEN kwh ELSE 0 END) OVER w AS night_sum, sum(CASE WHEN {NIGHT} THEN 0 ELSE kwh END) OVER w AS day_sum,
    sum(CASE WHEN {NIGHT} THEN kwh ELSE 0 END) OVER w / (sum(CASE WHEN {NIGHT} THEN 0 ELSE kwh END) OVER w + 1E-5) AS night_ratio
    FROM grid WINDOW w AS (PARTITION BY meter_id, CAST(hour_ts AS DATE))""",
    "grid",
)
def _(v):
    return features.day_statistics(v.grid)


@query(
    "e9_zone_lags",
    "zone forecast_date:s lag_actual:d8 lag_forecast:d10",
    """SELECT zone, forecast_date, coalesce(lag(actual_mw) OVER w, (SELECT median(actual_mw) FROM forecasts)) AS lag_actual,
    coalesce(lag(forecast_mw) OVER w, (SELECT median(forecast_mw) FROM forecasts)) AS lag_forecast
    FROM forecasts WINDOW w AS (PARTITION BY zone ORDER BY forecast_date)""",
    "forecasts",
)
def _(v):
    from meterlake.operators.forecast import zone_lags

    return zone_lags(v.forecasts)


@query(
    "e10_running_recovery",
    "date:s recovery:d4 cumulative:d4",
    """SELECT date, recovery, sum(recovery) OVER (ORDER BY date) AS cumulative FROM (
    SELECT CAST(action_timestamp AS DATE) AS date, sum(fine_inr) AS recovery FROM audits GROUP BY 1)""",
    "audits",
)
def _(v):
    d = v.audits.groupBy(F.to_date("action_timestamp").alias("date")).agg(F.sum("fine_inr").alias("recovery"))
    return running(d, [], F.date_trunc("month", "date"), ["date"], sums={"cumulative": "recovery"})


@query(
    "e11_latest_per_key",
    "model_name metric_type evaluation_date:s metric_value:d8",
    """SELECT model_name, metric_type, evaluation_date, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY model_name, metric_type
    ORDER BY evaluation_date DESC) AS rn FROM model_perf) WHERE rn = 1""",
    "model_perf",
)
def _(v):
    return rollup.latest_metric(v.model_perf)


@query(
    "e12_last_rows_per_meter",
    "meter_id:i reading_id:i kwh:d place:i",
    """SELECT * FROM (SELECT meter_id, reading_id, kwh, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC, reading_id DESC) AS place
    FROM readings) WHERE place <= 48""",
    "readings",
)
def _(v):
    return top_per_key(v.readings, ["meter_id"], [F.desc("timestamp"), F.desc("reading_id")], 48)


@query(
    "e13_recent_against_baseline",
    "meter_id:i days:i baseline_mean:d recent_mean:d drop_fraction:d",
    """SELECT meter_id, n AS days, baseline_mean, recent_mean, (baseline_mean - recent_mean) / (baseline_mean + 1E-8) AS drop_fraction FROM (
    SELECT meter_id, count(*) AS n, avg(kwh) FILTER (up <= 21) AS baseline_mean, avg(kwh) FILTER (down <= 7) AS recent_mean FROM (
    SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY date) AS up, row_number() OVER (PARTITION BY meter_id ORDER BY date DESC) AS down FROM daily
    WHERE kwh IS NOT NULL) GROUP BY 1)""",
    "daily",
    FLAGS,
)
def _(v):
    from meterlake.operators.explain import drop_measure

    return drop_measure(daily(v))


@query(
    "e14_temperature_delta",
    "zone date:s temp_c:d temperature_delta:d",
    """SELECT zone, date, temp_c, temp_c - avg(CASE WHEN rn <= 14 THEN temp_c END) OVER (PARTITION BY zone) AS temperature_delta FROM (
    SELECT *, row_number() OVER (PARTITION BY zone ORDER BY date) AS rn FROM (
    SELECT zone_id AS zone, CAST(timestamp AS DATE) AS date, avg(temp_c) AS temp_c FROM weather GROUP BY 1, 2))""",
    "weather",
)
def _(v):
    from meterlake.operators.explain import daily_weather, temperature_delta

    return temperature_delta(daily_weather(v.weather))


@query(
    "e15_alert_ranks",
    "alert_id:i zone rank:i dense_rank:i row_number:i percent_rank:d9 quartile:i overall_rank:i",
    """SELECT alert_id, zone, rank() OVER z AS rank, dense_rank() OVER z AS dense_rank,
    row_number() OVER (PARTITION BY zone ORDER BY anomaly_score DESC, alert_id) AS row_number, percent_rank() OVER z AS percent_rank,
    ntile(4) OVER (PARTITION BY zone ORDER BY anomaly_score DESC, alert_id) AS quartile, rank() OVER (ORDER BY anomaly_score DESC) AS overall_rank
    FROM alerts WINDOW z AS (PARTITION BY zone ORDER BY anomaly_score DESC)""",
    "alerts",
)
def _(v):
    edges = [i / 32 for i in range(1, 32)]
    base = v.alerts.select("alert_id", "zone", "anomaly_score")
    rows = ranks(base, ["zone"], "anomaly_score", "alert_id", edges)
    rows = rows.withColumn("quartile", ntile(4, F.col("row_number"), F.col("group_rows")))
    # the overall rank hangs on the score alone: counts by score, not a second ranking of the alerts
    scores = base.groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("alerts"))
    scores = running(scores, [], F.floor(F.col("anomaly_score") * 32), ["anomaly_score"], sums={"upto": "alerts"}, descending=True)
    overall = scores.select("anomaly_score", (F.col("upto") - F.col("alerts") + 1).alias("overall_rank"))
    return rows.join(overall, "anomaly_score", "left")


@query(
    "e16_gap_runs",
    "meter_id:i is_missing:b run_start:s run_end:s run_length:i",
    """SELECT meter_id, is_missing, min(hour_ts) AS run_start, max(hour_ts) AS run_end, count(*) AS run_length FROM (
    SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY hour_ts) - row_number() OVER (PARTITION BY meter_id, is_missing ORDER BY hour_ts) AS g FROM (
    SELECT meter_id, hour_ts, kwh IS NULL AS is_missing FROM grid)) GROUP BY meter_id, is_missing, g""",
    "grid",
)
def _(v):
    rows = v.grid.select("meter_id", "hour_ts", F.col("kwh").isNull().alias("is_missing"))
    return features.runs(rows, ["meter_id"], ["hour_ts"], "is_missing")


RANKING = {
    **FLAGS,
    "facts": (
        "with_peers",
        f"""SELECT meter_id, CAST(hour_ts AS DATE) AS date, sum(kwh) AS total_kwh, avg(z_vs_peer) AS peer_z,
        CASE WHEN max(kwh) > 0 THEN avg(kwh) / max(kwh) END AS load_factor,
        sum(CASE WHEN {NIGHT} THEN kwh ELSE 0 END) / (sum(CASE WHEN {NIGHT} THEN 0 ELSE kwh END) + 1E-5) AS night_ratio,
        count(*) AS hours FROM with_peers GROUP BY 1, 2""",
    ),
}


@query(
    "e0_suspicious_meter_ranking",
    "meter_id:i date:s zone total_kwh:d peer_z:d load_factor:d9 night_ratio:d hours:i",
    """SELECT f.*, zone FROM facts f JOIN meters m ON m.meter_id = f.meter_id WHERE peer_z IS NOT NULL
    ORDER BY abs(round(peer_z, 8)) DESC, f.meter_id, date LIMIT 50""",
    "facts meters",
    RANKING,
)
def _(v):
    """Flagship: readings to hours, peers, day facts and the 50 meter-days farthest from their peers."""
    from meterlake.plans.reports import suspicious_meters

    return suspicious_meters(v.hourly, v.meters, 50)


@query(
    "e16_failure_runs",
    "meter_id:i failed:b run_start:s run_end:s run_length:i",
    """SELECT meter_id, failed, min(timestamp) AS run_start, max(timestamp) AS run_end, count(*) AS run_length FROM (
    SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp, reading_id) - row_number() OVER (PARTITION BY meter_id, failed ORDER BY timestamp, reading_id) AS g FROM (
    SELECT meter_id, reading_id, timestamp, communication_status = 2 AS failed FROM readings)) GROUP BY meter_id, failed, g""",
    "readings",
)
def _(v):
    rows = v.readings.select("meter_id", "reading_id", "timestamp", (F.col("communication_status") == 2).alias("failed"))
    return features.runs(rows, ["meter_id"], ["timestamp", "reading_id"], "failed", F.date_trunc("hour", "timestamp"))
