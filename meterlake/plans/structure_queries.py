"""Hash trees (K), descent through links (J11), merged sketches (F17) and JSON payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scaling import running
from meterlake.operators import audit, hierarchy, merkle, sketches
from meterlake.plans.catalog import query
from meterlake.plans.rollup_queries import REPORT
from meterlake.sources import payloads
from meterlake.sources.storage import settle

# ---------------------------------------------------------------- K

ZONE_LOG = {
    "zone_log": (
        "audits",
        """SELECT zone, '{"alert":' || related_alert_id || ',"inspector_id":' || inspector_id || ',"outcome":"' || outcome || '","part_id":' || part_id || ',"step":' || step || '}' AS payload,
        row_number() OVER (PARTITION BY zone ORDER BY action_timestamp, related_alert_id, step) AS position, count(*) OVER (PARTITION BY zone) AS entries,
        CAST(regexp_extract(zone, '([0-9]+)', 1) AS INT) % 5 AS case_ FROM audits""",
    ),
    "h0": ("zone_log", "SELECT zone, 0 AS level, position - 1 AS idx, sha256('leaf:' || payload) AS hash, 1 AS leaves FROM zone_log"),
    **{
        f"h{i}": (
            f"h{i - 1}",
            f"""SELECT zone, {i} AS level, up AS idx, sha256('node:' || count(*) || ':' || string_agg(child, '' ORDER BY place)) AS hash, sum(leaves) AS leaves
            FROM (SELECT zone, idx AS place, hash AS child, leaves, idx // 16 AS up FROM h{i - 1}) GROUP BY zone, up""",
        )
        for i in range(1, 7)
    },
}


def zone_log(v):
    """The audit entries of each zone as one long log.

    Payloads are texts of a few columns; they are made when the log is read, neither shuffled nor written.
    """
    made = ["alert", "step", "part_id", "inspector_id", "outcome"]
    rows = v.audits.withColumnRenamed("related_alert_id", "alert").select("zone", "action_timestamp", *made)
    kinds = {c: rows.schema[c].dataType for c in ("part_id", "inspector_id")}
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in kinds})
    # steps of one alert may share a number and a time: the order of their payloads makes the order total, so that a rerun has
    # the same root; of payloads with one alert and step it is that of the texts of the other fields
    order = ["action_timestamp", "alert", "step", "inspector_id", "outcome", "part_id"]
    rows = running(rows, ["zone"], F.date_trunc("month", "action_timestamp"), order, number="position")
    rows = rows.withColumns({c: F.when(F.col(c) != "null", F.col(c)).cast(kind) for c, kind in kinds.items()})
    rows = settle(rows.select("zone", "position", *made), "zone-log")
    return rows.select("zone", "position", audit.canonical_json(made).alias("payload"))


@query(
    "k1_merkle_roots",
    "zone level:i hash leaves:i",
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY zone, level) AS n FROM ("
    + " UNION ALL ".join(f"SELECT zone, level, hash, leaves FROM h{i}" for i in range(7))
    + ")) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY zone ORDER BY level) = 1",
    " ".join(f"h{i}" for i in range(7)),
    ZONE_LOG,
)
def _(v):
    return merkle.roots(merkle.tree(zone_log(v), ["zone"], "position", "payload"), ["zone"])


def tampered(log):
    """By the number of the zone: a whole log, its last entry or its middle entry is taken out, the third is edited, or nothing is."""
    size = log.groupBy("zone").agg(F.count(F.lit(1)).alias("entries"))
    case = F.regexp_extract("zone", "([0-9]+)", 1).cast("int") % 5
    rows = log.join(size, "zone").withColumn("case_", case)
    gone = F.when(F.col("case_") == 1, F.col("entries")).when(F.col("case_") == 2, F.floor(F.col("entries") / 2) + 1)
    rows = rows.withColumn("gone", gone).where((F.col("case_") != 0) & (F.col("gone").isNull() | (F.col("position") != F.col("gone"))))
    edited = F.when((F.col("case_") == 3) & (F.col("position") == 3), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    moved = F.col("position") - F.coalesce((F.col("position") > F.col("gone")).cast("int"), F.lit(0))
    return rows.select("zone", moved.alias("position"), edited.alias("payload"))


@query(
    "k2_tampered_logs",
    "zone kind first_position:i",
    """SELECT DISTINCT zone, CASE case_ WHEN 0 THEN 'chain removed' WHEN 3 THEN 'entries changed' ELSE CASE WHEN entries = 1 THEN 'chain removed' ELSE 'entries removed' END END AS kind,
    CASE case_ WHEN 0 THEN 1 WHEN 1 THEN entries WHEN 2 THEN entries // 2 + 1 ELSE 3 END AS first_position FROM zone_log WHERE case_ < 3 OR (case_ = 3 AND entries >= 3)""",
    "zone_log",
    ZONE_LOG,
)
def _(v):
    log = zone_log(v)
    kept = merkle.tree(log, ["zone"], "position", "payload")
    now = merkle.tree(tampered(log), ["zone"], "position", "payload", merkle.height(kept))
    return merkle.differences(kept, now, ["zone"])


@query("k2_inclusion_proofs", "zone position:i proven:b", "SELECT zone, position, position % 3 <> 0 AS proven FROM zone_log WHERE position % 40 = 1", "zone_log", ZONE_LOG)
def _(v):
    log = zone_log(v)
    nodes = merkle.tree(log, ["zone"], "position", "payload")
    top = nodes.where(F.col("level") == merkle.height(nodes)).select("zone", F.col("hash").alias("root"))
    asked = merkle.proofs(nodes, log.where("position % 40 = 1"), ["zone"], "position").join(top, "zone")
    # a third of the entries is shown with a payload that was never logged
    shown = F.when(F.col("position") % 3 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    return asked.select("zone", "position", merkle.proved(shown, F.col("position"), F.col("proof"), F.col("root")).alias("proven"))


# ---------------------------------------------------------------- J11

LINKS = {
    **REPORT,
    "links": (
        "meters",
        """SELECT DISTINCT unnest(['M:' || meter_id, 'T:' || feeder_id || '/' || transformer_id, 'F:' || feeder_id, 'Z:' || zone, 'S:' || substation_id]) AS node,
        unnest(['T:' || feeder_id || '/' || transformer_id, 'F:' || feeder_id, 'Z:' || zone, 'S:' || substation_id, 'GRID']) AS parent FROM meters""",
    ),
}


def grid_links(v):
    """Parent links from every meter up to the whole grid."""
    name = [F.concat(F.lit("M:"), "meter_id"), F.concat(F.lit("T:"), "feeder_id", F.lit("/"), "transformer_id"), F.concat(F.lit("F:"), "feeder_id")]
    name += [F.concat(F.lit("Z:"), "zone"), F.concat(F.lit("S:"), "substation_id"), F.lit("GRID")]
    pairs = F.array(*[F.struct(a.alias("node"), b.alias("parent")) for a, b in zip(name, name[1:])])
    return v.meters.select(F.explode(pairs).alias("l")).select("l.*").distinct()


@query(
    "j11_recursive_descent",
    "node depth:i on_cycle:b descendants:i meters:i kwh:d4",
    """SELECT a.ancestor AS node, coalesce(d.depth, 0) AS depth, false AS on_cycle, a.descendants, a.meters, a.kwh FROM (
    WITH RECURSIVE up AS (SELECT node, parent AS ancestor, 1 AS steps FROM links UNION ALL SELECT u.node, l.parent, u.steps + 1 FROM up u JOIN links l ON l.node = u.ancestor)
    SELECT ancestor, count(DISTINCT node) AS descendants, count(*) FILTER (node LIKE 'M:%') AS meters, coalesce(sum(b.kwh), 0) AS kwh
    FROM up LEFT JOIN billed b ON 'M:' || b.meter_id = node GROUP BY 1) a LEFT JOIN (
    WITH RECURSIVE up AS (SELECT node, parent AS ancestor, 1 AS steps FROM links UNION ALL SELECT u.node, l.parent, u.steps + 1 FROM up u JOIN links l ON l.node = u.ancestor)
    SELECT node, max(steps) AS depth FROM up GROUP BY 1) d ON d.node = a.ancestor""",
    "links billed",
    LINKS,
)
def _(v):
    usage = v.hourly.groupBy(F.concat(F.lit("M:"), "meter_id").alias("node")).agg(F.sum("kwh").alias("kwh"))
    values = {"meters": F.count_if(F.col("node").startswith("M:")), "kwh": F.coalesce(F.sum("kwh"), F.lit(0.0))}
    return hierarchy.sums_below(grid_links(v), usage, values)


# ---------------------------------------------------------------- F17


@query(
    "f17_merged_sketches",
    "week:s readings:i meters_ok:b median_ok:b",
    "SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week, count(*) AS readings, true AS meters_ok, true AS median_ok FROM readings GROUP BY 1",
    "readings",
)
def _(v):
    """Weeks from stored daily sketches, held against exact values: the distinct count and the rank of the median."""
    days = settle(sketches.daily_sketches(v.readings, [], "timestamp", "meter_id", "kwh"), "sketches")
    week = F.date_trunc("week", "date").cast("date").alias("week")
    weeks = sketches.merged(days.withColumn("week", week), ["week"]).select(
        "week", F.col("rows").alias("readings"), sketches.distinct_items().alias("a"), sketches.value_at(0.5).alias("q")
    )
    rows = v.readings.withColumn("week", F.date_trunc("week", "timestamp").cast("date"))
    meters = rows.select("week", "meter_id").distinct().groupBy("week").agg(F.count(F.lit(1)).alias("e"))
    known = rows.where("kwh IS NOT NULL").join(weeks.select("week", "q"), "week").groupBy("week").agg(
        F.avg((F.col("kwh") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("kwh") <= F.col("q")).cast("double")).alias("upto")
    )
    off = sketches.RANK_ERROR
    return weeks.join(meters, "week").join(known, "week").select(
        "week",
        "readings",
        (F.abs(F.col("a") - F.col("e")) <= sketches.COUNT_ERROR * F.col("e")).alias("meters_ok"),
        ((F.col("below") <= 0.5 + off) & (F.col("upto") >= 0.5 - off)).alias("median_ok"),
    )


# ---------------------------------------------------------------- A6

GEO = {
    "shapes": (
        "meters",
        """SELECT meter_id, CASE meter_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '{"type":"Feature","geometry":{"type":"Poly' WHEN 2 THEN '{"type":"Feature","geometry":null}'
        WHEN 3 THEN '{"type":"Point","coordinates":[77.' || meter_id || ',12.5,900]}'
        WHEN 4 THEN '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,' || meter_id || '],[1,2]]],[[[5,6],[7,8],[5,6]]]]}}'
        WHEN 5 THEN '{"type":"Feature","geometry":{"type":"Polygon","coordinates":"none"}}' WHEN 6 THEN '[1,2]'
        ELSE '{"type":"Feature","properties":{"zone":"' || zone || '","rank":' || meter_id || '},"geometry":{"type":"Polygon","coordinates":[[[77.1,12.' || meter_id || '],[77.2,12.9],[77.1,12.'
        || meter_id || ']],[[77.11,12.3],[77.12,12.31],[77.11,12.3]]]}}' END AS text FROM meters""",
    ),
    "parsed": (
        "shapes",
        """SELECT meter_id, coalesce(json_extract(j, '$.geometry'), j) AS g FROM (SELECT meter_id, CAST(text AS JSON) AS j FROM shapes WHERE json_valid(text))""",
    ),
}


def shapes(v):
    """Map features of several kinds, a few of them malformed, as text."""
    m = F.col("meter_id")
    polygon = F.concat(
        F.lit('{"type":"Feature","properties":{"zone":"'), "zone", F.lit('","rank":'), m, F.lit('},"geometry":{"type":"Polygon","coordinates":[[[77.1,12.'), m,
        F.lit("],[77.2,12.9],[77.1,12."), m, F.lit("]],[[77.11,12.3],[77.12,12.31],[77.11,12.3]]]}}"),
    )
    kinds = {
        1: F.lit('{"type":"Feature","geometry":{"type":"Poly'),
        2: F.lit('{"type":"Feature","geometry":null}'),
        3: F.concat(F.lit('{"type":"Point","coordinates":[77.'), m, F.lit(",12.5,900]}")),
        4: F.concat(F.lit('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,'), m, F.lit("],[1,2]]],[[[5,6],[7,8],[5,6]]]]}}")),
        5: F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":"none"}}'),
        6: F.lit("[1,2]"),
    }
    text = F.when(m % 11 > 6, polygon)
    for k, t in kinds.items():
        text = text.when(m % 11 == k, t)
    return v.meters.select("meter_id", "zone", text.alias("text"))


@query(
    "a6_map_positions",
    "meter_id:i kind ring:i place:i lon:d9 lat:d9",
    """WITH rings AS (SELECT meter_id, 'Polygon' AS kind, CAST(json_extract(g, '$.coordinates') AS DOUBLE[][][]) AS rings FROM parsed
    WHERE json_extract_string(g, '$.type') = 'Polygon' AND json_type(g, '$.coordinates') = 'ARRAY'
    UNION ALL SELECT meter_id, 'MultiPolygon', flatten(CAST(json_extract(g, '$.coordinates') AS DOUBLE[][][][])) FROM parsed WHERE json_extract_string(g, '$.type') = 'MultiPolygon'
    UNION ALL SELECT meter_id, 'Point', [[CAST(json_extract(g, '$.coordinates') AS DOUBLE[])]] FROM parsed WHERE json_extract_string(g, '$.type') = 'Point')
    SELECT meter_id, kind, ring, generate_subscripts(places, 1) - 1 AS place, unnest(places)[1] AS lon, unnest(places)[2] AS lat FROM (
    SELECT meter_id, kind, generate_subscripts(rings, 1) - 1 AS ring, unnest(rings) AS places FROM rings)""",
    "parsed",
    GEO,
)
def _(v):
    return payloads.positions(shapes(v), "text", ["meter_id"])


SUMMARY = {
    "summaries": (
        "meters",
        """SELECT feeder_id, CASE n % 5 WHEN 0 THEN '{"forecasting":{"status":"trained","train_rows":' || n || ',"mape":0.0' || n || ',"features":["zone","month"]},"anomaly_detection":{"status":"trained","blended":{"f1":0.'
        || n || '},"feature_importance":[{"feature":"avg_kwh","importance":0.5}]}}' WHEN 1 THEN '{"forecasting":{"status":"trained","train_rows":"many"}}' WHEN 2 THEN '{"forecasting"'
        WHEN 3 THEN NULL ELSE '{"status":"not_trained","anomaly_detection":{"status":null,"blended":{"f1":' || n || '}}}' END AS text FROM (SELECT feeder_id, count(*) AS n FROM meters GROUP BY 1)""",
    )
}


@query(
    "a6_training_summary",
    "feeder_id forecast_status anomaly_status train_rows:i mape:d9 features:i blended_f1:d9 best_feature",
    """SELECT feeder_id, coalesce(json_extract_string(j, '$.forecasting.status'), 'not_trained') AS forecast_status, coalesce(json_extract_string(j, '$.anomaly_detection.status'), 'not_trained') AS anomaly_status,
    TRY_CAST(json_extract_string(j, '$.forecasting.train_rows') AS BIGINT) AS train_rows, TRY_CAST(json_extract_string(j, '$.forecasting.mape') AS DOUBLE) AS mape,
    coalesce(json_array_length(j, '$.forecasting.features'), 0) AS features, TRY_CAST(json_extract_string(j, '$.anomaly_detection.blended.f1') AS DOUBLE) AS blended_f1,
    json_extract_string(j, '$.anomaly_detection.feature_importance[0].feature') AS best_feature FROM (SELECT feeder_id, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM summaries)""",
    "summaries",
    SUMMARY,
)
def _(v):
    n = F.col("n")
    full = F.concat(
        F.lit('{"forecasting":{"status":"trained","train_rows":'), n, F.lit(',"mape":0.0'), n, F.lit(',"features":["zone","month"]},"anomaly_detection":{"status":"trained","blended":{"f1":0.'),
        n, F.lit('},"feature_importance":[{"feature":"avg_kwh","importance":0.5}]}}'),
    )
    text = F.when(n % 5 == 0, full).when(n % 5 == 1, F.lit('{"forecasting":{"status":"trained","train_rows":"many"}}')).when(n % 5 == 2, F.lit('{"forecasting"'))
    text = text.when(n % 5 == 4, F.concat(F.lit('{"status":"not_trained","anomaly_detection":{"status":null,"blended":{"f1":'), n, F.lit("}}}")))
    rows = v.meters.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n")).select("feeder_id", text.alias("text"))
    return payloads.training_summary(rows, "text")
