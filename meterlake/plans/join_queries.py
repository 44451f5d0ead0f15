"""Joins (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import joins
from meterlake.plans.catalog import query

FLAGS = {
    "flags": (
        "calendar",
        """SELECT date, bool_or(event_type = 'national_holiday') AS is_national_holiday, bool_or(event_type = 'state_holiday') AS is_state_holiday,
        bool_or(event_type IN ('national_holiday', 'state_holiday')) AS is_holiday, bool_or(event_type = 'industrial_shutdown') AS is_shutdown,
        bool_or(event_name = 'Ugadi') AS is_ugadi, bool_or(event_name = 'Deepawali') AS is_deepawali,
        bool_or(event_name LIKE '%Ramadan%') AS is_ramadan, bool_or(event_name LIKE '%IPL%') AS is_ipl_evening,
        sum(expected_demand_impact) AS total_demand_impact FROM calendar GROUP BY date""",
    ),
    "daily": (
        "readings",
        "SELECT meter_id, CAST(timestamp AS DATE) AS date, sum(kwh) AS kwh FROM readings GROUP BY 1, 2",
    ),
    "changes": (
        "daily",
        """SELECT * FROM (SELECT meter_id, date, kwh, avg(kwh) OVER (PARTITION BY meter_id) AS usual FROM daily) WHERE kwh > 2 * usual""",
    ),
    "peer_stats": (
        "hourly meters",
        """SELECT peer_cluster_id, hour_ts, avg(kwh) AS peer_mean, stddev(kwh) AS peer_std, quantile_disc(kwh, 0.5) AS peer_median
        FROM hourly JOIN meters USING (meter_id) WHERE peer_cluster_id IS NOT NULL GROUP BY 1, 2""",
    ),
    "with_peers": (
        "peer_stats",
        """SELECT h.*, m.peer_cluster_id, peer_mean, peer_std, peer_median, CASE WHEN peer_mean > 0 THEN kwh / peer_mean END AS peer_dev_ratio,
        CASE WHEN peer_std > 0 THEN (kwh - peer_mean) / peer_std END AS z_vs_peer
        FROM hourly h LEFT JOIN meters m ON m.meter_id = h.meter_id
        LEFT JOIN peer_stats p ON p.peer_cluster_id = m.peer_cluster_id AND p.hour_ts = h.hour_ts""",
    ),
    "balance": (
        "hourly meters feeder_readings",
        """SELECT *, ratio AS upstream_loss_ratio, ratio > 0.08 AS loss_violation, feeder_input_kwh >= billed_kwh AS input_covers_metered FROM (
        SELECT f.*, billed_kwh, CASE WHEN feeder_input_kwh > 0 THEN (feeder_input_kwh - billed_kwh) / feeder_input_kwh END AS ratio
        FROM feeder_readings f LEFT JOIN (SELECT feeder_id, hour_ts, sum(kwh) AS billed_kwh FROM hourly JOIN meters USING (meter_id) GROUP BY 1, 2) b
        ON b.feeder_id = f.feeder_id AND b.hour_ts = f.timestamp)""",
    ),
}


def daily(v):
    return v.readings.groupBy("meter_id", F.to_date("timestamp").alias("date")).agg(F.sum("kwh").alias("kwh"))


def changes(v):
    """Meter-days above twice the meter's mean day: stand-ins for detected breaks."""
    d = daily(v)
    usual = d.groupBy("meter_id").agg(F.avg("kwh").alias("usual"))
    # a day of exactly twice the mean is none, in whatever order the means were summed
    return d.join(usual, "meter_id").where(F.round(F.col("kwh") - 2 * F.col("usual"), 9) > 0)


def current_topology(v):
    return v.topology.where(F.col("valid_to").isNull())


@query(
    "d1_calendar_join",
    "meter_id:i date:s kwh:d is_holiday:b is_shutdown:b is_ugadi:b is_ipl_evening:b is_ramadan:b total_demand_impact:d",
    """SELECT meter_id, d.date, kwh, coalesce(is_holiday, false) AS is_holiday, coalesce(is_shutdown, false) AS is_shutdown,
    coalesce(is_ugadi, false) AS is_ugadi, coalesce(is_ipl_evening, false) AS is_ipl_evening, coalesce(is_ramadan, false) AS is_ramadan,
    coalesce(total_demand_impact, 0) AS total_demand_impact FROM daily d LEFT JOIN flags f ON f.date = d.date""",
    "daily flags",
    FLAGS,
)
def _(v):
    return joins.with_calendar(daily(v), v.calendar)


@query(
    "d2_peer_join",
    "meter_id:i hour_ts:s peer_mean:d peer_std:d peer_median:d peer_dev_ratio:d9 z_vs_peer:d5",
    "SELECT * FROM with_peers",
    "with_peers",
    FLAGS,
)
def _(v):
    return joins.with_peers(v.hourly, v.meters)


@query(
    "d3_topology_join",
    "meter_id:i hour_ts:s feeder_id transformer_rated_kva:d feeder_input_kwh:d upstream_loss_ratio:d feeder_load_share:d",
    """SELECT h.meter_id, h.hour_ts, t.feeder_id, transformer_rated_kva, feeder_input_kwh, upstream_loss_ratio,
    CASE WHEN feeder_input_kwh > 0 THEN kwh / feeder_input_kwh END AS feeder_load_share FROM hourly h
    LEFT JOIN (SELECT * FROM topology WHERE valid_to IS NULL) t ON t.meter_id = h.meter_id
    LEFT JOIN balance b ON b.feeder_id = t.feeder_id AND b.timestamp = h.hour_ts""",
    "balance topology",
    FLAGS,
)
def _(v):
    return joins.with_topology(v.hourly, current_topology(v), v.feeder_readings)


@query(
    "d4_weather_join",
    "meter_id:i hour_ts:s temp_c:d humidity_pct:d rainfall_mm:d",
    """SELECT h.meter_id, h.hour_ts, temp_c, humidity_pct, rainfall_mm FROM hourly h LEFT JOIN meters m ON m.meter_id = h.meter_id
    LEFT JOIN weather w ON w.zone_id = m.zone AND w.timestamp = h.hour_ts""",
    "hourly meters weather",
)
def _(v):
    return joins.with_weather(v.hourly, v.weather, v.meters)


@query(
    "d5_registry_join",
    "meter_id:i date:s kwh:d consumer_type tariff_category contracted_kw:d zone feeder_id transformer_id",
    """SELECT d.*, consumer_type, tariff_category, contracted_kw, zone, feeder_id, transformer_id FROM daily d LEFT JOIN meters m ON m.meter_id = d.meter_id""",
    "daily meters",
    FLAGS,
)
def _(v):
    static = v.meters.select("meter_id", "consumer_type", "tariff_category", "contracted_kw", "zone", "feeder_id", "transformer_id")
    return daily(v).join(static, "meter_id", "left")


@query(
    "d6_zone_calendar_join",
    "zone date:s kwh:d zone_demand_impact:d zone_events:i",
    """SELECT z.zone, z.date, any_value(kwh) AS kwh, coalesce(sum(expected_demand_impact), 0) AS zone_demand_impact, count(event_type) AS zone_events
    FROM (SELECT zone, date, sum(kwh) AS kwh FROM daily JOIN meters USING (meter_id) GROUP BY 1, 2) z
    LEFT JOIN calendar c ON c.date = z.date AND (zones_csv IS NULL OR list_contains(string_split(zones_csv, ','), z.zone)) GROUP BY 1, 2""",
    "daily meters calendar",
    FLAGS,
)
def _(v):
    z = daily(v).join(v.meters.select("meter_id", "zone"), "meter_id").groupBy("zone", "date").agg(F.sum("kwh").alias("kwh"))
    return joins.with_zone_calendar(z, v.calendar)


@query(
    "d7_topology_in_force",
    "meter_id:i date:s kwh:d transformer_id valid_from:s valid_to:s",
    """SELECT d.*, transformer_id, valid_from, valid_to FROM daily d LEFT JOIN topology t ON t.meter_id = d.meter_id
    AND valid_from <= d.date AND d.date < coalesce(valid_to, DATE '9999-12-31')""",
    "daily topology",
    FLAGS,
)
def _(v):
    return joins.valid_topology(daily(v), v.topology)


NEAR = "EXISTS (SELECT 1 FROM calendar e WHERE abs(date_diff('day', e.date, c.date)) <= 2)"


@query("d8_explained_changes", "meter_id:i date:s kwh:d", f"SELECT * FROM changes c WHERE {NEAR}", "changes calendar", FLAGS)
def _(v):
    return joins.explained(changes(v), v.calendar)


@query("d9_unexplained_changes", "meter_id:i date:s kwh:d", f"SELECT * FROM changes c WHERE NOT {NEAR}", "changes calendar", FLAGS)
def _(v):
    return joins.unexplained(changes(v), v.calendar)


@query(
    "d10_alert_detail",
    "alert_id:i zone consumer_type feedback segment:i audits",
    """SELECT a.alert_id, a.zone, m.consumer_type, f.feedback, coalesce(u.segment, 0) AS segment, u.audits FROM alerts a
    LEFT JOIN meters m ON m.meter_id = a.meter_id
    LEFT JOIN (SELECT alert_id, string_agg(feedback_type, ',' ORDER BY feedback_type) AS feedback FROM feedback GROUP BY 1) f ON f.alert_id = a.alert_id
    LEFT JOIN (SELECT related_alert_id, (rn - 1) // 5 AS segment, string_agg(outcome, ',' ORDER BY rn) AS audits FROM (
      SELECT *, row_number() OVER (PARTITION BY related_alert_id ORDER BY action_timestamp, step, part_id, inspector_id) AS rn FROM audits) GROUP BY 1, 2) u
    ON u.related_alert_id = a.alert_id""",
    "alerts meters feedback audits",
)
def _(v):
    fb = joins.listed(
        v.feedback, ["alert_id"], F.substring("feedback_type", 1, 1), ["feedback_type"], F.col("feedback_type")
    ).select("alert_id", F.array_join("items", ",").alias("feedback"))
    au = joins.listed(
        v.audits,
        ["related_alert_id"],
        F.date_trunc("month", "action_timestamp"),
        ["action_timestamp", "step", "part_id", "inspector_id"],
        F.col("outcome"),
        size=5,
    ).select(F.col("related_alert_id").alias("alert_id"), "segment", F.array_join("items", ",").alias("audits"))
    base = v.alerts.select("alert_id", "meter_id", "zone").join(v.meters.select("meter_id", "consumer_type"), "meter_id", "left")
    out = base.join(fb, "alert_id", "left").join(au, "alert_id", "left")
    return out.withColumn("segment", F.coalesce("segment", F.lit(0)))


@query(
    "d11_active_profiles",
    "meter_id:i zone reference_cluster:i",
    "SELECT p.meter_id, zone, reference_cluster FROM profiles p JOIN meters m ON m.meter_id = p.meter_id WHERE active",
    "profiles meters",
)
def _(v):
    return v.profiles.join(v.meters.where("active").select("meter_id", "zone"), "meter_id")


HOUR_COLS = [f"h{h:02d}" for h in range(24)]
PIVOT_SQL = ", ".join(f"coalesce(avg(kwh) FILTER (hour(timestamp) = {h}), 0) AS h{h:02d}" for h in range(24))


@query(
    "d12_pivot_with_daily",
    "meter_id:i date:s total_kwh:d " + " ".join(f"{c}:d" for c in HOUR_COLS),
    f"""SELECT d.meter_id, d.date, coalesce(d.kwh, 0) AS total_kwh, p.* EXCLUDE (meter_id, date) FROM daily d
    LEFT JOIN (SELECT meter_id, CAST(timestamp AS DATE) AS date, {PIVOT_SQL} FROM readings GROUP BY 1, 2) p ON p.meter_id = d.meter_id AND p.date = d.date""",
    "daily readings",
    FLAGS,
)
def _(v):
    from meterlake.operators.rollup import hour_pivot

    out = daily(v).withColumnRenamed("kwh", "total_kwh").join(hour_pivot(v.readings), ["meter_id", "date"], "left")
    return out.fillna(0.0)


@query(
    "d13_audit_lineage",
    "related_alert_id:i step:i part_id:i severity outcome days_to_action:i",
    """SELECT related_alert_id, step, part_id, severity, outcome, date_diff('day', alert_timestamp, action_timestamp) AS days_to_action
    FROM audits u LEFT JOIN alerts a ON a.alert_id = u.related_alert_id""",
    "audits alerts",
)
def _(v):
    a = v.alerts.select(F.col("alert_id").alias("related_alert_id"), "severity", "alert_timestamp")
    return v.audits.join(a, "related_alert_id", "left").withColumn("days_to_action", F.datediff("action_timestamp", "alert_timestamp"))


@query(
    "d14_status_override",
    "alert_id:i base_status status",
    """SELECT a.alert_id, a.status AS base_status, coalesce(o.status, a.status) AS status FROM alerts a LEFT JOIN (
    SELECT related_alert_id, CASE outcome WHEN 'Fail' THEN 'Assigned' WHEN 'Pass' THEN 'Resolved' END AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY related_alert_id ORDER BY action_timestamp DESC, part_id DESC, inspector_id DESC) AS rn FROM audits) WHERE rn = 1) o
    ON o.related_alert_id = a.alert_id""",
    "alerts audits",
)
def _(v):
    from meterlake.operators.audit import current_status

    changes_ = v.audits.select(
        F.col("related_alert_id").alias("alert_id"),
        F.struct("action_timestamp", "part_id", "inspector_id").alias("at"),
        F.when(F.col("outcome") == "Fail", "Assigned").when(F.col("outcome") == "Pass", "Resolved").alias("new_status"),
    )
    return current_status(v.alerts, changes_)


@query(
    "d15_coverage_gaps",
    "meter_id:i missing",
    """SELECT meter_id, 'readings' AS missing FROM meters WHERE meter_id NOT IN (SELECT meter_id FROM readings)
    UNION ALL SELECT meter_id, 'alerts' FROM meters WHERE meter_id NOT IN (SELECT meter_id FROM alerts)""",
    "meters readings alerts",
)
def _(v):
    m = v.meters.select("meter_id")
    no_r = m.join(v.readings.select("meter_id").distinct(), "meter_id", "left_anti").withColumn("missing", F.lit("readings"))
    no_a = m.join(v.alerts.select("meter_id").distinct(), "meter_id", "left_anti").withColumn("missing", F.lit("alerts"))
    return no_r.unionByName(no_a)


@query(
    "d16_as_of_weather",
    "reading_id:i zone forecast_c:d",
    """SELECT reading_id, r.zone, w.temp_c AS forecast_c FROM (SELECT reading_id, zone, timestamp FROM readings JOIN meters USING (meter_id)) r
    ASOF LEFT JOIN (SELECT * FROM weather WHERE hour(timestamp) % 6 = 0) w ON w.zone_id = r.zone AND r.timestamp >= w.timestamp""",
    "readings meters weather",
)
def _(v):
    left = v.readings.select("reading_id", "meter_id", "timestamp").join(v.meters.select("meter_id", "zone"), "meter_id")
    # a forecast is issued every six hours
    issued = v.weather.where(F.hour("timestamp") % 6 == 0).withColumnRenamed("zone_id", "zone")
    return joins.as_of(left, issued, "zone", "timestamp", "temp_c", "forecast_c")
