"""Data quality, drift and evaluation of forecasts and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scaling import quantiles, running, value_bucket


def quality_by_zone(dq: DataFrame, good: float = 0.85) -> DataFrame:
    q = F.avg("quality_score")
    return dq.groupBy("zone").agg(
        F.max("date").alias("freshness"),
        (F.avg("missing_readings") / 24 * 100).alias("missing_pct"),
        q.alias("quality_score"),
        F.when(q >= good, "OK").otherwise("Audit").alias("status"),
    )


def quality_trend(dq: DataFrame, perf: DataFrame, days: int = 90, drift: float = 0.25) -> DataFrame:
    per_day = dq.groupBy("date").agg(
        F.avg("quality_score").alias("quality"),
        F.avg(F.col("received_readings") * 100.0 / F.col("expected_readings")).alias("completeness"),
        F.avg("missing_readings").alias("missing"),
    )
    psi = perf.where(F.col("metric_type") == "mape_pct").groupBy(F.col("evaluation_date").alias("date")).agg(
        F.avg("feature_drift_psi").alias("psi")
    )
    out = per_day.orderBy(F.desc("date")).limit(days).join(psi, "date", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    return out.withColumn("status", F.when(F.col("psi") > drift, "DRIFT_RISK").otherwise("OK")).orderBy("date")


def stability_index(base: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index with bins at the base period's quantiles, one row per bin and the total."""
    points = {f"q{i}": i / bins for i in range(1, bins)}
    edges = quantiles(base, [], column, points).select(F.array(*points)).scalar()

    def shares(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(column).isNotNull()).select(F.col(column), edges.alias("_edges"))
        rows = rows.select(value_bucket(F.col("_edges"), F.col(column)).alias("bin"))
        return rows.groupBy("bin").agg(F.count(F.lit(1)).alias(name))

    spark = base.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = all_bins.join(shares(base, "base_rows"), "bin", "left").join(shares(current, "current_rows"), "bin", "left").fillna(0)
    totals = n.groupBy().agg(F.struct(F.sum("base_rows").alias("b"), F.sum("current_rows").alias("c"))).scalar()
    p = F.greatest(F.col("base_rows") / totals["b"], F.lit(floor))
    q = F.greatest(F.col("current_rows") / totals["c"], F.lit(floor))
    return n.withColumn("contribution", (q - p) * F.log(q / p))


def model_health(perf: DataFrame) -> DataFrame:
    """Newest value of each metric per model side by side; drift above 0.25 is critical, above 0.15 on watch."""
    def newest(metric: str) -> Column:
        return F.max_by("metric_value", F.when(F.col("metric_type") == metric, F.col("evaluation_date")))

    out = perf.groupBy("model_name").agg(
        newest("mape_pct").alias("mape"),
        newest("precision").alias("precision"),
        newest("recall").alias("recall"),
        F.max_by("feature_drift_psi", "evaluation_date").alias("drift"),
        F.max("evaluation_date").alias("last_evaluated"),
    )
    drift = F.col("drift")
    return out.withColumn("status", F.when(drift > 0.25, "Critical").when(drift > 0.15, "Watch").otherwise("Healthy"))


def drift_history(perf: DataFrame, rows: int = 250) -> DataFrame:
    kinds = ["mape_pct", "f1_score", "precision", "recall", "auc_roc"]
    newest = perf.where(F.col("metric_type").isin(*kinds)).orderBy(F.desc("evaluation_date"), F.desc("model_name"), F.desc("metric_type"))
    return newest.limit(rows).orderBy("evaluation_date", "model_name", "metric_type")


def freshness(readings: DataFrame, registry: DataFrame, as_of: str, expected_per_day: int = 24) -> DataFrame:
    """Newest reading and missing share over the last 7 and 30 days per feeder."""
    now = F.lit(as_of).cast("timestamp")
    slots = readings.where(F.col("timestamp") < now).groupBy("meter_id", F.date_trunc("hour", "timestamp").alias("h")).agg(
        F.max("timestamp").alias("last_at")
    )
    recent7 = F.col("h") >= now - F.expr("INTERVAL 7 DAYS")
    recent30 = F.col("h") >= now - F.expr("INTERVAL 30 DAYS")
    per_meter = slots.groupBy("meter_id").agg(
        F.count_if(recent7).alias("n7"), F.count_if(recent30).alias("n30"), F.max("last_at").alias("last_at")
    )
    out = registry.select("meter_id", "feeder_id").join(per_meter, "meter_id", "left").groupBy("feeder_id").agg(
        F.count(F.lit(1)).alias("meters"),
        F.coalesce(F.sum("n7"), F.lit(0)).alias("n7"),
        F.coalesce(F.sum("n30"), F.lit(0)).alias("n30"),
        F.max("last_at").alias("last_reading_at"),
    )
    m7 = 100 - F.col("n7") * 100.0 / (F.col("meters") * 7 * expected_per_day)
    return out.withColumns(
        {
            "missing_pct_7d": m7,
            "missing_pct_30d": 100 - F.col("n30") * 100.0 / (F.col("meters") * 30 * expected_per_day),
            "status": F.when(m7 < 50, "ok").when(m7 < 95, "warning").otherwise("error"),
        }
    )


def domain_check(df: DataFrame, table: str, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the list; null is accepted, as by an SQL constraint."""
    return df.groupBy().agg(
        F.lit(f"{table}.{column} in list").alias("check"),
        F.count_if(~F.coalesce(F.col(column).isin(*allowed), F.lit(True))).alias("violations"),
        F.count(F.lit(1)).alias("rows"),
    )


def reference_check(df: DataFrame, table: str, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing in the target; null is accepted. Keys are counted first, so copies do not travel."""
    keys = df.groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = target.select(F.col(key).alias("_k")).distinct().withColumn("_ok", F.lit(True))
    return keys.join(known, "_k", "left").groupBy().agg(
        F.lit(f"{table}.{column} exists").alias("check"),
        F.coalesce(F.sum(F.when(F.col("_ok").isNull() & F.col("_k").isNotNull(), F.col("_n"))), F.lit(0)).alias("violations"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    )


def forecast_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """MAPE, RMSE, interval coverage and relative width, and skill against the naive forecast."""
    err = F.col("actual_mw") - F.col("forecast_mw")
    naive = F.col("actual_mw") - F.col("naive_mw")
    both = F.col("naive_mw").isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(err) / F.greatest(F.col("actual_mw"), F.lit(1e-6))).alias("mape"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.col("actual_mw").between(F.col("p10_mw"), F.col("p90_mw")).cast("double")).alias("picp"),
        (F.avg(F.col("p90_mw") - F.col("p10_mw")) / (F.max("actual_mw") - F.min("actual_mw"))).alias("pinaw"),
        (1 - F.sqrt(F.avg(F.when(both, err * err))) / F.sqrt(F.avg(naive * naive))).alias("skill_vs_naive"),
    )


def classifier_metrics(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    hit = F.col(score) >= cut
    true = F.col(label) == 1
    n = df.groupBy().agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "fdr": F.try_divide(fp, tp + fp),
        }
    )


def ranking_quality(df: DataFrame, score: str, label: str, cuts: int = 64) -> DataFrame:
    """ROC-AUC and average precision from counts per distinct score, cumulated in value buckets.

    Rows with equal scores count half against each other (mid-ranks) and enter precision together.
    """
    per = df.groupBy(F.col(score).alias("_v")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    marks = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    edges = per.groupBy().agg(F.percentile_approx("_v", marks, 1000)).scalar()
    per = per.withColumn("_edges", edges)
    cut = running(per, [], value_bucket(F.col("_edges"), F.col("_v")), ["_v"], sums={"_cp": "_pos", "_cn": "_neg"}, descending=True)
    auc = F.sum(F.col("_neg") * (F.col("_cp") - F.col("_pos") / 2.0))
    ap = F.sum(F.col("_pos") * F.col("_cp") / (F.col("_cp") + F.col("_cn")))
    return cut.groupBy().agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.try_divide(auc, F.sum("_pos") * F.sum("_neg")).alias("roc_auc"),
        F.try_divide(ap, F.sum("_pos")).alias("average_precision"),
    )


def precision_at_k(df: DataFrame, day: str, score: str, tie: str, label: str, k: int = 50) -> DataFrame:
    from meterlake.operators.ranking import top_per_key

    best = top_per_key(df, [day], [F.desc(score), F.asc(tie)], k)
    return best.groupBy(day).agg(F.avg(F.col(label).cast("double")).alias("precision_at_k"), F.count(F.lit(1)).alias("rows"))


def time_to_detect(onsets: DataFrame, detections: DataFrame) -> DataFrame:
    """First detection on or after the onset, per onset; overall mean days and the share found.

    Only the first onset and the newest detection per meter travel, so busy meters stay small.
    """
    first = onsets.groupBy("meter_id").agg(F.min("date").alias("onset"))
    found = detections.groupBy("meter_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    rows = first.join(found, "meter_id", "left")
    per = rows.groupBy("meter_id", "onset").agg(F.min(F.when(F.col("date") >= F.col("onset"), F.col("date"))).alias("found"))
    return per.groupBy().agg(
        F.count(F.lit(1)).alias("onsets"),
        F.count("found").alias("detected"),
        F.avg(F.datediff("found", "onset")).alias("mean_days_to_detect"),
    )


def pinball_loss(df: DataFrame, actual: str, forecast: str, q: float) -> Column:
    d = F.col(actual) - F.col(forecast)
    return F.when(d >= 0, d * q).otherwise(d * (q - 1))
