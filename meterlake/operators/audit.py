"""Status logs, hash-chained audit trails and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scaling import neighbours, running

GENESIS = "genesis"
SEGMENT_ROWS = 200

# States an alert may move to
ALLOWED_MOVES = {
    "Open": ("Assigned", "Snoozed", "Resolved", "Investigating"),
    "Investigating": ("Assigned", "Snoozed", "Resolved", "False Positive"),
    "Assigned": ("Resolved", "Snoozed", "Open"),
    "Snoozed": ("Open", "Assigned"),
    "Resolved": ("Open",),
    "False Positive": ("Open",),
}


def current_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Newest change per alert over the stored status; a newest change without a status leaves the stored one."""
    newest = changes.groupBy("alert_id").agg(F.max_by("new_status", "at").alias("_new"))
    out = alerts.withColumnRenamed("status", "base_status").join(newest, "alert_id", "left")
    return out.withColumn("status", F.coalesce("_new", "base_status")).drop("_new")


def canonical_json(columns: list[str]) -> Column:
    """JSON text with keys in sorted order; null fields are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def seed(key: Column, segment: Column) -> Column:
    return F.concat(F.lit(f"{GENESIS}:"), key.cast("string"), F.lit(":"), segment.cast("string"))


def chain(log: DataFrame, key: str, bucket: Column, order: list[str], payload: str, made: Column | None = None) -> DataFrame:
    """sha256(previous hash + payload) along each key, in segments of SEGMENT_ROWS rows with a seed each.

    The fold is sequential by nature; segments bound it, so one long chain is many tasks. ``segment_heads`` chains the
    segments themselves, so that nothing between them can be taken out or put in; both levels are checked together.
    A payload that is ``made`` from other columns is not carried through the numbering.
    """
    numbered = running(log, [key], bucket, order, number="position", small=True)
    if made is not None:
        numbered = numbered.withColumn(payload, made)
    cut = numbered.withColumn("segment", F.floor((F.col("position") - 1) / SEGMENT_ROWS))
    rows = F.sort_array(F.collect_list(F.struct("position", payload)))
    folded = cut.groupBy(key, "segment").agg(rows.alias("_rows"))

    def link(state, row):
        before = F.try_element_at(state, F.lit(-1))["entry_hash"]
        start = F.coalesce(before, seed(F.col(key), F.col("segment")))
        entry = F.struct(
            row["position"].alias("position"),
            row[payload].alias(payload),
            start.alias("prev_hash"),
            F.sha2(F.concat(start, row[payload]), 256).alias("entry_hash"),
        )
        return F.concat(state, F.array(entry))

    kind = f"array<struct<position:bigint,{payload}:string,prev_hash:string,entry_hash:string>>"
    folded = folded.withColumn("_links", F.aggregate("_rows", F.array().cast(kind), link))
    return folded.select(key, "segment", F.inline("_links"))


def broken_links(log: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows whose hash or previous hash does not follow; every row is checked in parallel within its segment."""
    w = Window.partitionBy(key, "segment").orderBy("position")
    expected_prev = F.coalesce(F.lag("entry_hash").over(w), seed(F.col(key), F.col("segment")))
    checked = log.withColumns(
        {
            "hash_ok": F.sha2(F.concat("prev_hash", payload), 256) == F.col("entry_hash"),
            "prev_ok": F.col("prev_hash") == expected_prev,
        }
    )
    return checked.where(~(F.col("hash_ok") & F.col("prev_ok")))


def segment_heads(log: DataFrame, key: str) -> DataFrame:
    """Second level of a chain: per segment its rows, its last entry, and a hash over that and the head before.

    A key has one row per SEGMENT_ROWS entries here. To be kept apart from the log.
    """
    last = log.groupBy(key, "segment").agg(F.count(F.lit(1)).alias("rows"), F.max_by("entry_hash", "position").alias("last_hash"))
    ordered = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment", "rows", "last_hash"))).alias("_s"))

    def link(state, s):
        before = F.coalesce(F.try_element_at(state, F.lit(-1))["head_hash"], seed(F.col(key), F.lit("heads")))
        text = F.concat(before, F.lit(":"), s["segment"].cast("string"), F.lit(":"), s["rows"].cast("string"), F.lit(":"), s["last_hash"])
        return F.concat(state, F.array(F.struct(s["segment"].alias("segment"), s["rows"].alias("rows"), s["last_hash"].alias("last_hash"), F.sha2(text, 256).alias("head_hash"))))

    kind = "array<struct<segment:bigint,rows:bigint,last_hash:string,head_hash:string>>"
    return ordered.select(key, F.inline(F.aggregate("_s", F.array().cast(kind), link)))


def broken_segments(log: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, segment) where log and kept heads differ: missing, added or shortened segments, gaps in position, and every
    segment whose head no longer follows. Together with ``broken_links`` any deletion, change or insertion shows."""
    now = segment_heads(log, key).select(key, "segment", F.col("head_hash").alias("_head"))
    first = F.col("segment") * SEGMENT_ROWS
    places = log.groupBy(key, "segment").agg((F.min("position") - first).alias("_low"), (F.max("position") - first - F.count(F.lit(1))).alias("_gap"))
    here = now.join(places, [key, "segment"])
    both = heads.join(here, [key, "segment"], "full")
    fine = F.col("head_hash").eqNullSafe(F.col("_head")) & F.col("_low").eqNullSafe(F.lit(1)) & F.col("_gap").eqNullSafe(F.lit(0))
    return both.where(~fine).select(key, "segment")


def transitions(log: DataFrame, key: str, bucket: Column, order: list[str], state: str) -> DataFrame:
    """Previous state of each log row and whether the move is allowed (a first state always is)."""
    rows = neighbours(log, [key], bucket, order, [state])
    before, now = F.col(f"prev_{state}"), F.col(state)
    allowed = F.lit(False)
    for start, ends in ALLOWED_MOVES.items():
        allowed = allowed | ((before == start) & now.isin(*ends))
    return rows.withColumn("allowed", before.isNull() | (before == now) | allowed)


def training_labels(feedback: DataFrame) -> DataFrame:
    """Confirmed and refuted alerts as 1 and 0; undecided ones are left out."""
    kind = F.col("feedback_type")
    return feedback.withColumn(
        "label", F.when(kind == "true_positive", 1).when(kind == "false_positive", 0)
    ).where(F.col("label").isNotNull())


def append_feedback(stored: DataFrame, incoming: DataFrame, alerts: DataFrame, now: str) -> DataFrame:
    """Stored feedback plus incoming rows for known alerts, each with an id made from the clock and the alert."""
    at = F.lit(now).cast("timestamp")
    known = incoming.join(alerts.select("alert_id"), "alert_id", "left_semi")
    made = known.select(
        F.concat(F.lit("FBK-UI-"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.col("alert_id")).alias("feedback_id"),
        "alert_id",
        "feedback_type",
        at.alias("feedback_timestamp"),
    )
    old = stored.select(
        F.concat(F.lit("FBK-"), F.col("alert_id")).alias("feedback_id"),
        "alert_id",
        "feedback_type",
        F.lit(None).cast("timestamp").alias("feedback_timestamp"),
    )
    return old.unionByName(made)
