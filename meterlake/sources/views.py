"""Domain views over the given tables: meters, readings, grid, alerts and so on.

``Views`` builds each view lazily as a DataFrame. ``SQL`` holds the same definitions as text for an independent
engine, so that both sides of a comparison start from equal input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.scaling import running

# Calendar of the sample month (fixed values)
CALENDAR = [
    ("2024-01-01", "national_holiday", "New Year", -0.10, None),
    ("2024-01-15", "state_holiday", "Ugadi", -0.20, None),
    ("2024-01-15", "festival", "Deepawali", 0.15, "NATION_1,NATION_2,NATION_3"),
    ("2024-01-20", "ipl_match", "IPL Final", 0.05, "NATION_4"),
    ("2024-01-22", "industrial_shutdown", "Plant stop", -0.30, "NATION_5,NATION_6"),
    ("2024-01-26", "national_holiday", "Republic Day", -0.25, None),
]


class Views:
    def __init__(self, spark: SparkSession, folder: str, span: tuple[str, str, str] | None = None):
        self.spark = spark
        self.folder = folder
        self.span = span

    def between(self, start: str, end: str, look_back: str = "0 days") -> Views:
        """The same views over readings in [start - look_back, end) only; the range reaches the Parquet scan."""
        return type(self)(self.spark, self.folder, (start, end, look_back))

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "events" and self.span:
            start, end, back = self.span
            low = F.lit(start).cast("timestamp_ntz") - F.expr(f"INTERVAL {back}")
            df = df.where((F.col("ts") >= low) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        return df

    @cached_property
    def _places(self) -> DataFrame:
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", "n_name", "r_name")

    @cached_property
    def meters(self) -> DataFrame:
        key = F.col("c_custkey")
        nation = F.col("c_nationkey")
        balance = F.col("c_acctbal")
        return self.table("customer").join(self._places, nation == F.col("n_nationkey")).select(
            key.alias("meter_id"),
            F.concat(F.lit("C-"), key).alias("consumer_id"),
            F.col("c_mktsegment").alias("consumer_type"),
            F.when(balance > 5000, "HT-1").when(balance > 2000, "LT-3").otherwise("LT-1").alias("tariff_category"),
            F.col("n_name").alias("zone"),
            F.col("r_name").alias("substation_id"),
            F.concat(F.lit("FDR-"), nation, F.lit("-"), key % 3).alias("feeder_id"),
            F.concat(F.lit("DT-"), nation, F.lit("-"), key % 12).alias("transformer_id"),
            F.when(key % 17 != 0, key % 5).alias("peer_cluster_id"),
            (F.greatest(balance, F.lit(0.0)) / 1000).alias("contracted_kw"),
            F.date_add(F.lit("2015-01-01").cast("date"), (key % 3000).cast("int")).alias("install_date"),
            (F.lit(12.8) + (key % 97) / F.lit(400.0)).alias("latitude"),
            (F.lit(77.4) + (key % 89) / F.lit(300.0)).alias("longitude"),
            (key % 50 != 0).alias("active"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        kind, value, eid = F.col("event_type"), F.col("value"), F.col("event_id")
        base = self.table("events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        k = F.col("k")
        return base.select(
            eid.alias("reading_id"),
            F.col("user_id").alias("meter_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.when((kind == "error") & (eid % 2 == 0), None).otherwise(value).alias("kwh"),
            (value / (F.lit(0.70) + F.lit(0.004) * k)).alias("kvah"),
            (F.lit(215.0) + k / F.lit(10.0)).alias("voltage_v"),
            F.when((kind == "signup") & (k < 5), -value).otherwise(value).alias("register_step"),
            F.when(kind == "error", 2).when(kind == "signup", 1).otherwise(0).alias("communication_status"),
            ((kind == "signup") & (k >= 95)).alias("tamper_flag"),
            ((kind == "purchase") & (k >= 90)).alias("is_theft_flag"),
            (k / F.lit(100.0)).alias("anomaly_score"),
        )

    @cached_property
    def register(self) -> DataFrame:
        """Readings with the cumulative register, a running sum cut by hour so that no meter fills one task."""
        return running(
            self.readings,
            ["meter_id"],
            F.date_trunc("hour", "timestamp"),
            ["timestamp", "reading_id"],
            sums={"cumulative_kwh": "register_step"},
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """One row per meter and hour; partial sums collapse busy meters before the shuffle."""
        return self.readings.groupBy("meter_id", F.date_trunc("hour", "timestamp").alias("hour_ts")).agg(
            F.sum("kwh").alias("kwh"),
            F.sum("kvah").alias("kvah"),
            F.sum("register_step").alias("register_step"),
            F.max("communication_status").alias("communication_status"),
            F.avg("voltage_v").alias("voltage_v"),
            F.avg("anomaly_score").alias("anomaly_score"),
            F.bool_or("tamper_flag").alias("tamper_flag"),
            F.bool_or("is_theft_flag").alias("is_theft_flag"),
            F.count(F.lit(1)).alias("readings"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Dense hourly slots per meter, from its first to its last hour."""
        from meterlake.operators.clean import dense_grid

        return dense_grid(self.hourly, "meter_id", "hour_ts", "1 hour")

    @cached_property
    def feeder_readings(self) -> DataFrame:
        per_meter = self.hourly.select("meter_id", "hour_ts", F.coalesce("kwh", F.lit(0.0)).alias("kwh"))
        m = self.meters.select("meter_id", "feeder_id")
        return (
            per_meter.join(m, "meter_id")
            .groupBy("feeder_id", F.col("hour_ts").alias("timestamp"))
            .agg((F.sum("kwh") * (F.lit(1.03) + F.lit(0.01) * F.max(F.col("meter_id") % 10))).alias("feeder_input_kwh"))
        )

    @cached_property
    def weather(self) -> DataFrame:
        hours = self.readings.select(F.date_trunc("hour", "timestamp").alias("timestamp")).distinct()
        h, d, n = F.hour("timestamp"), F.dayofmonth("timestamp"), F.col("n_nationkey")
        # every zone of the place table for every hour: the list of zones is a dimension, the hours are a few thousand
        zones = self.table("nation").groupBy().agg(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("zone_id")))).scalar()
        rows = hours.select("timestamp", F.explode(zones).alias("z")).select("timestamp", "z.*")
        return rows.select(
            "zone_id",
            "timestamp",
            (F.lit(24.0) + F.lit(6.0) * F.sin(F.lit(2.0) * F.pi() * (h - 9) / F.lit(24.0)) + n % 5).alias("temp_c"),
            (F.lit(60.0) - n).alias("humidity_pct"),
            F.when((n + d) % 7 == 0, 4.0).otherwise(0.0).alias("rainfall_mm"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        rows = ", ".join(
            "(DATE '{}', '{}', '{}', {}D, {})".format(d, t, n, i, "CAST(NULL AS STRING)" if z is None else f"'{z}'")
            for d, t, n, i, z in CALENDAR
        )
        return self.spark.sql(
            f"SELECT * FROM VALUES {rows} AS c(date, event_type, event_name, expected_demand_impact, zones_csv)"
        )

    @cached_property
    def topology(self) -> DataFrame:
        g = F.col("g")
        return self.meters.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            "meter_id",
            "zone",
            "substation_id",
            "feeder_id",
            "transformer_id",
            (F.lit(25.0) + F.col("meter_id") % 4 * 75).alias("transformer_rated_kva"),
            F.date_add(F.lit("2024-01-01").cast("date"), 15 * g).alias("valid_from"),
            F.when(g == 0, F.lit("2024-01-16").cast("date")).alias("valid_to"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        k = F.col("o_orderkey")
        place = self.table("customer").join(self._places, F.col("c_nationkey") == F.col("n_nationkey"))
        status = F.col("o_orderstatus")

        def score(factor: int) -> Column:
            return (k * factor % 100) / F.lit(100.0)

        return self.table("orders").join(
            place.select("c_custkey", F.col("n_name").alias("zone")), F.col("o_custkey") == F.col("c_custkey")
        ).select(
            k.alias("alert_id"),
            F.col("o_custkey").alias("meter_id"),
            "zone",
            F.col("o_orderdate").cast("timestamp").alias("alert_timestamp"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
            .when(F.col("o_orderpriority") == "2-HIGH", "High")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
            .otherwise("Low")
            .alias("severity"),
            F.when(status == "O", "Open")
            .when(status == "P", "Investigating")
            .when(k % 4 == 0, "False Positive")
            .otherwise("Resolved")
            .alias("status"),
            ((k * 7919 % 1000) / F.lit(1000.0)).alias("anomaly_score"),
            (F.col("o_totalprice") / 1000).alias("estimated_loss_units"),
            F.when(k % 6 != 0, F.col("o_totalprice") / 50).alias("estimated_daily_loss_inr"),
            score(31).alias("vae_score"),
            score(37).alias("eif_score"),
            score(41).alias("gnn_score"),
            (k % 3 == 0).alias("bocpd_flag"),
            F.when(k % 3 == 0, "TheftDetect-v2.1").when(k % 3 == 1, "TheftDetect-v3.0").otherwise("Ensemble-v1").alias(
                "model_version"
            ),
        )

    @cached_property
    def audits(self) -> DataFrame:
        owner = self.alerts.select(F.col("alert_id").alias("related_alert_id"), "meter_id", "zone")
        return self.table("lineitem").withColumnRenamed("l_orderkey", "related_alert_id").join(
            owner, "related_alert_id"
        ).select(
            "related_alert_id",
            F.col("l_linenumber").alias("step"),
            "meter_id",
            "zone",
            F.col("l_shipdate").cast("timestamp").alias("action_timestamp"),
            F.col("l_suppkey").alias("inspector_id"),
            F.when(F.col("l_returnflag") == "R", "Fail").when(F.col("l_returnflag") == "A", "Pass").otherwise("Pending").alias(
                "outcome"
            ),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("fine_inr"),
            F.col("l_partkey").alias("part_id"),
        )

    @cached_property
    def zone_daily(self) -> DataFrame:
        place = self.table("customer").join(self._places, F.col("c_nationkey") == F.col("n_nationkey"))
        return (
            self.table("orders")
            .join(place.select("c_custkey", F.col("r_name").alias("zone")), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("zone", F.to_date("o_orderdate").alias("date"))
            .agg((F.sum("o_totalprice") / 100000).alias("actual_mw"))
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Seven-row trailing mean per zone. A zone holds one row per day, so its window is bounded by the calendar."""
        w = Window.partitionBy("zone").orderBy("date")
        f = F.col("forecast_mw")
        return (
            self.zone_daily.withColumn("forecast_mw", F.avg("actual_mw").over(w.rowsBetween(-7, -1)))
            .where(f.isNotNull())
            .select(
                "zone",
                F.col("date").alias("forecast_date"),
                "actual_mw",
                "forecast_mw",
                f.alias("p50_mw"),
                (f * 0.85).alias("p10_mw"),
                (f * 1.15).alias("p90_mw"),
                (F.abs(F.col("actual_mw") - f) / F.col("actual_mw") * 100).alias("mape_pct"),
            )
        )

    @cached_property
    def data_quality(self) -> DataFrame:
        hours = self.readings.groupBy(
            "meter_id", F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("h")
        ).agg(
            F.count_if(F.col("kwh").isNull()).alias("nulls"),
            F.count_if(F.col("communication_status") == 2).alias("fails"),
            F.count(F.lit(1)).alias("n"),
        )
        received = F.count(F.lit(1))
        return hours.groupBy("meter_id", "date").agg(
            F.lit(24).alias("expected_readings"),
            received.alias("received_readings"),
            (24 - received).alias("missing_readings"),
            F.sum("nulls").alias("null_values"),
            F.sum("fails").alias("comms_failures"),
            (F.sum("n") - received).alias("duplicate_readings"),
            (received / F.lit(24.0)).alias("quality_score"),
        ).join(self.meters.select("meter_id", "zone"), "meter_id")

    @cached_property
    def feedback(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("alert_id"),
            F.when(F.col("toxic") == 1, "true_positive")
            .when(F.col("quality") == 0, "false_positive")
            .otherwise("needs_review")
            .alias("feedback_type"),
        )

    @cached_property
    def model_perf(self) -> DataFrame:
        """Monthly metric rows per zone model: error, and precision / recall / f1 stand-ins from the same month."""
        monthly = self.forecasts.groupBy("zone", F.date_trunc("month", "forecast_date").cast("date").alias("evaluation_date")).agg(
            F.avg("mape_pct").alias("mape_pct"),
            F.avg((F.abs(F.col("actual_mw") - F.col("forecast_mw")) < F.col("forecast_mw") * 0.5).cast("double")).alias("precision"),
            F.avg((F.col("actual_mw") > F.col("p10_mw")).cast("double")).alias("recall"),
            F.abs(F.avg("actual_mw") / F.avg("forecast_mw") - 1).alias("feature_drift_psi"),
        )
        return monthly.select(
            F.concat(F.lit("Model-"), "zone").alias("model_name"),
            "evaluation_date",
            "feature_drift_psi",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("metric_type"), F.col(m).alias("metric_value"))
                        for m in ("mape_pct", "precision", "recall")
                    ]
                )
            ).alias("m"),
        ).select("model_name", "evaluation_date", "feature_drift_psi", "m.metric_type", "m.metric_value")

    @cached_property
    def profiles(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("meter_id"),
            F.transform("embedding", lambda x: x.cast("double")).alias("profile"),
            F.col("label").alias("reference_cluster"),
        )


_CAL = ", ".join(
    "(DATE '{}', '{}', '{}', {}E0, {})".format(d, t, n, i, "NULL" if z is None else f"'{z}'") for d, t, n, i, z in CALENDAR
)

# name -> (views it reads, text)
SQL: dict[str, tuple[str, str]] = {
    "places": ("", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "meters": (
        "places",
        """SELECT c_custkey AS meter_id, 'C-' || c_custkey AS consumer_id, c_mktsegment AS consumer_type,
        CASE WHEN c_acctbal > 5000 THEN 'HT-1' WHEN c_acctbal > 2000 THEN 'LT-3' ELSE 'LT-1' END AS tariff_category,
        n_name AS zone, r_name AS substation_id, 'FDR-' || c_nationkey || '-' || (c_custkey % 3) AS feeder_id,
        'DT-' || c_nationkey || '-' || (c_custkey % 12) AS transformer_id,
        CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 5 END AS peer_cluster_id,
        greatest(c_acctbal, 0E0) / 1000 AS contracted_kw, DATE '2015-01-01' + CAST(c_custkey % 3000 AS INT) AS install_date,
        12.8E0 + (c_custkey % 97) / 400E0 AS latitude, 77.4E0 + (c_custkey % 89) / 300E0 AS longitude,
        c_custkey % 50 <> 0 AS active
        FROM customer JOIN places ON c_nationkey = n_nationkey""",
    ),
    "readings": (
        "",
        """SELECT event_id AS reading_id, user_id AS meter_id, CAST(ts AS TIMESTAMP) AS timestamp,
        CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE value END AS kwh,
        value / (0.70E0 + 0.004E0 * k) AS kvah, 215E0 + k / 10E0 AS voltage_v,
        CASE WHEN event_type = 'signup' AND k < 5 THEN -value ELSE value END AS register_step,
        CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS communication_status,
        event_type = 'signup' AND k >= 95 AS tamper_flag, event_type = 'purchase' AND k >= 90 AS is_theft_flag,
        k / 100E0 AS anomaly_score
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    ),
    "register": (
        "readings",
        """SELECT *, sum(register_step) OVER (PARTITION BY meter_id ORDER BY timestamp, reading_id
        ROWS UNBOUNDED PRECEDING) AS cumulative_kwh FROM readings""",
    ),
    "hourly": (
        "readings",
        """SELECT meter_id, date_trunc('hour', timestamp) AS hour_ts, sum(kwh) AS kwh, sum(kvah) AS kvah,
        sum(register_step) AS register_step, max(communication_status) AS communication_status,
        avg(voltage_v) AS voltage_v, avg(anomaly_score) AS anomaly_score, bool_or(tamper_flag) AS tamper_flag,
        bool_or(is_theft_flag) AS is_theft_flag, count(*) AS readings
        FROM readings GROUP BY 1, 2""",
    ),
    "grid": (
        "hourly",
        """SELECT s.meter_id, s.hour_ts, h.* EXCLUDE (meter_id, hour_ts) FROM (
        SELECT meter_id, unnest(generate_series(min(hour_ts), max(hour_ts), INTERVAL 1 HOUR)) AS hour_ts
        FROM hourly GROUP BY meter_id) s
        LEFT JOIN hourly h ON h.meter_id = s.meter_id AND h.hour_ts = s.hour_ts""",
    ),
    "feeder_readings": (
        "readings meters",
        """SELECT feeder_id, date_trunc('hour', timestamp) AS timestamp,
        sum(coalesce(kwh, 0)) * (1.03E0 + 0.01E0 * max(meter_id % 10)) AS feeder_input_kwh
        FROM readings JOIN meters USING (meter_id) GROUP BY 1, 2""",
    ),
    "weather": (
        "readings",
        """SELECT n_name AS zone_id, h AS timestamp, 24E0 + 6E0 * sin(2E0 * pi() * (hour(h) - 9) / 24E0) + n_nationkey % 5 AS temp_c,
        60E0 - n_nationkey AS humidity_pct, CASE WHEN (n_nationkey + day(h)) % 7 = 0 THEN 4E0 ELSE 0E0 END AS rainfall_mm
        FROM nation, (SELECT DISTINCT date_trunc('hour', timestamp) AS h FROM readings)""",
    ),
    "calendar": (
        "",
        f"SELECT * FROM (VALUES {_CAL}) c(date, event_type, event_name, expected_demand_impact, zones_csv)",
    ),
    "topology": (
        "meters",
        """SELECT meter_id, zone, substation_id, feeder_id, transformer_id,
        25E0 + meter_id % 4 * 75 AS transformer_rated_kva, DATE '2024-01-01' + 15 * g AS valid_from,
        CASE WHEN g = 0 THEN DATE '2024-01-16' END AS valid_to
        FROM meters, (VALUES (0), (1)) t(g)""",
    ),
    "alerts": (
        "places",
        """SELECT o_orderkey AS alert_id, o_custkey AS meter_id, n_name AS zone, CAST(o_orderdate AS TIMESTAMP) AS alert_timestamp,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity,
        CASE WHEN o_orderstatus = 'O' THEN 'Open' WHEN o_orderstatus = 'P' THEN 'Investigating'
             WHEN o_orderkey % 4 = 0 THEN 'False Positive' ELSE 'Resolved' END AS status,
        (o_orderkey * 7919 % 1000) / 1000E0 AS anomaly_score, o_totalprice / 1000 AS estimated_loss_units,
        CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 50 END AS estimated_daily_loss_inr,
        (o_orderkey * 31 % 100) / 100E0 AS vae_score, (o_orderkey * 37 % 100) / 100E0 AS eif_score,
        (o_orderkey * 41 % 100) / 100E0 AS gnn_score, o_orderkey % 3 = 0 AS bocpd_flag,
        CASE o_orderkey % 3 WHEN 0 THEN 'TheftDetect-v2.1' WHEN 1 THEN 'TheftDetect-v3.0' ELSE 'Ensemble-v1' END AS model_version
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    ),
    "audits": (
        "alerts",
        """SELECT l_orderkey AS related_alert_id, l_linenumber AS step, meter_id, zone, CAST(l_shipdate AS TIMESTAMP) AS action_timestamp,
        l_suppkey AS inspector_id, CASE l_returnflag WHEN 'R' THEN 'Fail' WHEN 'A' THEN 'Pass' ELSE 'Pending' END AS outcome,
        l_extendedprice * l_discount AS fine_inr, l_partkey AS part_id FROM lineitem JOIN alerts ON l_orderkey = alert_id""",
    ),
    "zone_daily": (
        "places",
        """SELECT r_name AS zone, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 100000 AS actual_mw
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    ),
    "forecasts": (
        "zone_daily",
        """SELECT zone, date AS forecast_date, actual_mw, f AS forecast_mw, f AS p50_mw, f * 0.85E0 AS p10_mw, f * 1.15E0 AS p90_mw,
        abs(actual_mw - f) / actual_mw * 100 AS mape_pct FROM (
        SELECT *, avg(actual_mw) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS f
        FROM zone_daily) WHERE f IS NOT NULL""",
    ),
    "data_quality": (
        "readings meters",
        """SELECT q.*, zone FROM (SELECT meter_id, CAST(timestamp AS DATE) AS date, 24 AS expected_readings,
        count(DISTINCT hour(timestamp)) AS received_readings, 24 - count(DISTINCT hour(timestamp)) AS missing_readings,
        count(*) FILTER (kwh IS NULL) AS null_values, count(*) FILTER (communication_status = 2) AS comms_failures,
        count(*) - count(DISTINCT hour(timestamp)) AS duplicate_readings,
        count(DISTINCT hour(timestamp)) / 24E0 AS quality_score FROM readings GROUP BY 1, 2) q JOIN meters USING (meter_id)""",
    ),
    "feedback": (
        "",
        """SELECT doc_id AS alert_id, CASE WHEN toxic = 1 THEN 'true_positive' WHEN quality = 0 THEN 'false_positive'
        ELSE 'needs_review' END AS feedback_type FROM labels""",
    ),
    "model_month": (
        "forecasts",
        """SELECT 'Model-' || zone AS model_name, CAST(date_trunc('month', forecast_date) AS DATE) AS evaluation_date,
        avg(mape_pct) AS mape_pct,
        avg(CASE WHEN abs(actual_mw - forecast_mw) < forecast_mw * 0.5E0 THEN 1E0 ELSE 0E0 END) AS precision,
        avg(CASE WHEN actual_mw > p10_mw THEN 1E0 ELSE 0E0 END) AS recall,
        abs(avg(actual_mw) / avg(forecast_mw) - 1) AS feature_drift_psi FROM forecasts GROUP BY 1, 2""",
    ),
    "model_perf": (
        "model_month",
        """SELECT model_name, evaluation_date, feature_drift_psi, 'mape_pct' AS metric_type, mape_pct AS metric_value FROM model_month
        UNION ALL SELECT model_name, evaluation_date, feature_drift_psi, 'precision', precision FROM model_month
        UNION ALL SELECT model_name, evaluation_date, feature_drift_psi, 'recall', recall FROM model_month""",
    ),
    "profiles": (
        "",
        """SELECT vec_id AS meter_id, CAST(embedding AS DOUBLE[]) AS profile, label AS reference_cluster FROM embeddings""",
    ),
}


def with_views(needs: str, text: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """Prefix a SELECT with the view definitions it needs, in dependency order."""
    defs = {**SQL, **(extra or {})}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, body = defs[name]
        for d in deps.split():
            add(d)
        done[name] = body

    for name in needs.split():
        add(name)
    if not done:
        return text
    # a body may open with its own WITH list: splice it into ours
    head = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in done.items())
    stripped = text.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head},\n{stripped[5:]}"
    return f"WITH {head}\n{text}"
