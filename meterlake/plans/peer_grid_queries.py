"""Peer groups and profiles (H), grid topology and balance (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import grid, joins, nearest, peers, rollup
from meterlake.plans.catalog import query
from meterlake.plans.join_queries import FLAGS, HOUR_COLS, PIVOT_SQL, current_topology
from meterlake.plans.rollup_queries import REPORT, loads, zones
from meterlake.sources.storage import settle

START, END = "2024-01-01", "2024-01-31"
H24 = range(24)

PROFILE = {
    **FLAGS,
    "profile_rows": (
        "readings meters",
        f"""SELECT r.meter_id, tariff_category, consumer_type, date_trunc('hour', timestamp) AS hour_slot, avg(kwh) AS avg_kwh
        FROM readings r JOIN meters m ON m.meter_id = r.meter_id WHERE timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'
        AND communication_status = 0 AND kwh IS NOT NULL AND active GROUP BY 1, 2, 3, 4""",
    ),
    "centres": (
        "profiles",
        """SELECT reference_cluster, list(m ORDER BY pos) AS centroid FROM (SELECT reference_cluster, pos, avg(x) AS m FROM (
        SELECT reference_cluster, unnest(profile) AS x, generate_subscripts(profile, 1) AS pos FROM profiles) GROUP BY 1, 2) GROUP BY 1""",
    ),
    "dist": (
        "profiles centres",
        """SELECT meter_id, c.reference_cluster AS cluster, list_distance(profile, centroid) AS distance FROM profiles p, centres c""",
    ),
    "weekly": (
        "hourly",
        "SELECT meter_id, CAST(date_trunc('week', hour_ts) AS DATE) AS week, ["
        + ", ".join(f"coalesce(avg(kwh) FILTER (hour(hour_ts) = {h}), 0)" for h in H24)
        + "] AS profile FROM hourly GROUP BY 1, 2",
    ),
    "weekly_cells": (
        "weekly",
        "SELECT meter_id, week, max(week) OVER (PARTITION BY meter_id) AS newest, unnest(profile) AS x, generate_subscripts(profile, 1) AS pos FROM weekly",
    ),
}


def profile_rows(v):
    return peers.hourly_profile(v.readings, v.meters, START, END)


@query(
    "h1_hourly_profile",
    "meter_id:i tariff_category consumer_type hour_slot:s avg_kwh:d",
    "SELECT * FROM profile_rows",
    "profile_rows",
    PROFILE,
)
def _(v):
    return profile_rows(v)


@query(
    "h2_profile_vectors",
    "meter_id:i hour:i z:d",
    "SELECT meter_id, h AS hour, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END AS z FROM ("
    "SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM (SELECT meter_id, h, coalesce(avg(avg_kwh) FILTER (hour(hour_slot) = h), 0) AS x "
    "FROM profile_rows, range(24) t(h) GROUP BY 1, 2) WINDOW w AS (PARTITION BY meter_id))",
    "profile_rows",
    PROFILE,
)
def _(v):
    return peers.profile_vectors(profile_rows(v)).select("meter_id", F.posexplode("profile").alias("hour", "z"))


@query("h3_landmark_dtw", "meter_id:i landmark_id:i distance:d")
def _(v):
    return peers.landmark_distances(peers.profile_vectors(profile_rows(v)))


@query(
    "h4_gaussian_affinity",
    "meter_id:i cluster:i distance:d affinity:d",
    """SELECT *, exp(-distance * distance / (2 * (SELECT median(distance) FROM dist WHERE distance > 0) ** 2)) AS affinity FROM dist""",
    "dist",
    PROFILE,
)
def _(v):
    centres = peers.centroids(v.profiles, "reference_cluster", "profile")
    rows = peers.centroid_distances(v.profiles, centres, "reference_cluster", "profile")
    return peers.affinities(settle(rows, "distances"))


@query("h5_affinity_groups", "meter_id:i cluster:i")
def _(v):
    d = peers.landmark_distances(peers.profile_vectors(profile_rows(v)))
    return peers.group_by_affinity(peers.affinities(settle(d, "distances")), 5)


@query("h5_power_iteration_groups", "meter_id:i cluster:i")
def _(v):
    d = peers.landmark_distances(peers.profile_vectors(profile_rows(v)))
    return peers.power_iteration_groups(peers.affinities(settle(d, "distances")), 5)


@query("h6_eigengap", "k:i eigenvalue:d gap:d best:b")
def _(v):
    d = peers.landmark_distances(peers.profile_vectors(profile_rows(v)), 64)
    return peers.group_count_by_gap(peers.affinities(settle(d, "distances")))


@query("h6_group_count_sweep", "k:i silhouette:d best:b")
def _(v):
    return peers.group_count_sweep(v.profiles, list(range(5, 41)))


@query(
    "h7_nearest_centroid",
    "meter_id:i cluster:i distance:d",
    "SELECT meter_id, arg_min(cluster, distance) AS cluster, min(distance) AS distance FROM dist GROUP BY 1",
    "dist",
    PROFILE,
)
def _(v):
    centres = peers.centroids(v.profiles, "reference_cluster", "profile")
    return peers.nearest_centroid(v.profiles, centres, "reference_cluster", "profile")


@query(
    "h8_registry_write_back",
    "meter_id:i zone peer_cluster_id:i",
    """SELECT m.meter_id, zone, coalesce(d.cluster, m.peer_cluster_id) AS peer_cluster_id FROM meters m
    LEFT JOIN (SELECT meter_id, arg_min(cluster, distance) AS cluster FROM dist GROUP BY 1) d ON d.meter_id = m.meter_id""",
    "meters dist",
    PROFILE,
)
def _(v):
    centres = peers.centroids(v.profiles, "reference_cluster", "profile")
    labels = peers.nearest_centroid(v.profiles, centres, "reference_cluster", "profile")
    return peers.write_back(v.meters, labels)


@query(
    "h9_peer_deviation",
    "meter_id:i date:s mean_ratio:d mean_z:d hours:i",
    "SELECT meter_id, CAST(hour_ts AS DATE) AS date, avg(peer_dev_ratio) AS mean_ratio, avg(z_vs_peer) AS mean_z, count(z_vs_peer) AS hours FROM with_peers GROUP BY 1, 2",
    "with_peers",
    FLAGS,
)
def _(v):
    return joins.with_peers(v.hourly, v.meters).groupBy("meter_id", F.to_date("hour_ts").alias("date")).agg(
        F.avg("peer_dev_ratio").alias("mean_ratio"), F.avg("z_vs_peer").alias("mean_z"), F.count("z_vs_peer").alias("hours")
    )


@query(
    "h10_peer_band",
    "meter_id:i hour_ts:s kwh:d peer_upper:d peer_lower:d outside:b",
    """SELECT meter_id, hour_ts, kwh, peer_mean + peer_std AS peer_upper, greatest(peer_mean - peer_std, 0) AS peer_lower,
    kwh > peer_mean + peer_std OR kwh < greatest(peer_mean - peer_std, 0) AS outside FROM with_peers WHERE peer_std IS NOT NULL""",
    "with_peers",
    FLAGS,
)
def _(v):
    return peers.peer_band(joins.with_peers(v.hourly, v.meters).where(F.col("peer_std").isNotNull()))


@query(
    "h11_straying_meters",
    "meter_id:i weeks:i latest_distance:d usual_distance:d spread:d straying:b",
    """SELECT meter_id, count(*) AS weeks, max(distance) FILTER (week = newest) AS latest_distance, avg(distance) FILTER (week < newest) AS usual_distance,
    stddev(distance) FILTER (week < newest) AS spread,
    coalesce(max(distance) FILTER (week = newest) > avg(distance) FILTER (week < newest) + 2 * stddev(distance) FILTER (week < newest), false) AS straying FROM (
    SELECT c.meter_id, week, newest, sqrt(sum((x - m) * (x - m))) AS distance FROM weekly_cells c
    JOIN (SELECT meter_id, pos, avg(x) AS m FROM weekly_cells GROUP BY 1, 2) a ON a.meter_id = c.meter_id AND a.pos = c.pos GROUP BY 1, 2, 3) GROUP BY 1""",
    "weekly_cells",
    PROFILE,
)
def _(v):
    return peers.history_distances(peers.weekly_profiles(v.hourly))


@query("h11_plane_coordinates", "meter_id:i x:d y:d")
def _(v):
    return peers.plane_coordinates(v.profiles)


@query(
    "h12_fingerprint_drift",
    "meter_id:i week:s drift:d",
    """SELECT n.meter_id, n.week, 1 - sum(n.x * m) / nullif(sqrt(sum(n.x * n.x)) * sqrt(sum(m * m)), 0) AS drift
    FROM (SELECT * FROM weekly_cells WHERE week = newest) n
    JOIN (SELECT meter_id, pos, avg(x) AS m FROM weekly_cells WHERE week < newest GROUP BY 1, 2) o ON o.meter_id = n.meter_id AND o.pos = n.pos GROUP BY 1, 2""",
    "weekly_cells",
    PROFILE,
)
def _(v):
    return peers.fingerprint_drift(peers.weekly_profiles(v.hourly))


@query(
    "h13_day_profile_scores",
    "meter_id:i date:s " + " ".join(f"{c}:d" for c in HOUR_COLS),
    "SELECT meter_id, date, " + ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1E-8) AS {c}" for c in HOUR_COLS) + " FROM day_cells",
    "day_cells",
    {"day_cells": ("readings", f"SELECT meter_id, CAST(timestamp AS DATE) AS date, {PIVOT_SQL} FROM readings GROUP BY 1, 2")},
)
def _(v):
    return peers.slot_scores(rollup.hour_pivot(v.readings), HOUR_COLS)


# ---------------------------------------------------------------- J

RISK = "CASE WHEN load_pct >= 90 THEN 'Critical' WHEN load_pct >= 75 THEN 'High' WHEN load_pct >= 60 THEN 'Medium' ELSE 'Normal' END"


@query(
    "j1_grid_nodes",
    "id type parent meter_count:i load_pct:d risk",
    f"""SELECT *, {RISK} AS risk FROM (SELECT substation_id AS id, 'Substation' AS type, NULL AS parent, sum(meter_count) AS meter_count, max(load_pct) AS load_pct FROM loads GROUP BY 1
    UNION ALL SELECT feeder_id, 'Feeder', substation_id, meter_count, load_pct FROM loads)""",
    "loads",
    REPORT,
)
def _(v):
    return grid.nodes(loads(v))


@query("j1_grid_edges", "source target weight:i", "SELECT substation_id AS source, feeder_id AS target, meter_count AS weight FROM loads", "loads", REPORT)
def _(v):
    return grid.edges(loads(v))


@query(
    "j2_shared_transformer_links",
    "feeder_id source target group_size:i",
    """SELECT feeder_id, unnest(['M-' || meter_id, transformer_id]) AS source, unnest([transformer_id, 'M-' || meter_id]) AS target, group_size FROM (
    SELECT *, count(*) OVER (PARTITION BY feeder_id) AS nf, count(*) OVER (PARTITION BY feeder_id, transformer_id) AS group_size FROM meters) WHERE nf >= 2 AND group_size >= 2""",
    "meters",
)
def _(v):
    return grid.shared_transformers(v.topology)


BAL_COLS = "feeder_id timestamp:s feeder_input_kwh:d billed_kwh:d upstream_loss_ratio:d loss_violation:b input_covers_metered:b"


@query("j3_feeder_balance", BAL_COLS, "SELECT * FROM balance", "balance", FLAGS)
def _(v):
    return joins.feeder_balance(v.hourly, current_topology(v), v.feeder_readings)


NEAR = {
    **FLAGS,
    "cells": ("profiles", "SELECT meter_id, unnest(profile) AS x, generate_subscripts(profile, 1) - 1 AS pos FROM profiles"),
    "beside": (
        "profiles meters",
        """SELECT ma.meter_id, mb.meter_id AS other FROM meters ma JOIN meters mb ON mb.feeder_id = ma.feeder_id AND mb.transformer_id = ma.transformer_id
        AND mb.meter_id <> ma.meter_id WHERE mb.meter_id IN (SELECT meter_id FROM profiles) AND ma.meter_id IN (SELECT meter_id FROM profiles)""",
    ),
    "hop": (
        "cells beside",
        """SELECT a.meter_id, a.pos, a.x, m AS neighbour_mean FROM cells a JOIN (
        SELECT p.meter_id, pos, avg(x) AS m FROM beside p JOIN cells c ON c.meter_id = p.other GROUP BY 1, 2) b ON b.meter_id = a.meter_id AND b.pos = a.pos""",
    ),
}


@query(
    "j4_neighbour_means",
    "meter_id:i pos:i neighbour_mean:d gap:d",
    "SELECT meter_id, pos, neighbour_mean, x - neighbour_mean AS gap FROM hop",
    "hop",
    NEAR,
)
def _(v):
    return grid.neighbour_means(v.profiles, current_topology(v))


@query(
    "j4_two_hop_means",
    "meter_id:i pos:i neighbour_mean:d gap:d",
    """SELECT a.meter_id, a.pos, m AS neighbour_mean, a.neighbour_mean - m AS gap FROM hop a JOIN (
    SELECT p.meter_id, pos, avg(neighbour_mean) AS m FROM beside p JOIN hop c ON c.meter_id = p.other GROUP BY 1, 2) b ON b.meter_id = a.meter_id AND b.pos = a.pos""",
    "hop beside",
    NEAR,
)
def _(v):
    return grid.two_hops(v.profiles, current_topology(v))


@query(
    "j4_feeder_pool",
    "feeder_id pos:i pooled:d",
    "SELECT feeder_id, pos, avg(x) AS pooled FROM cells JOIN meters USING (meter_id) GROUP BY 1, 2",
    "cells meters",
    NEAR,
)
def _(v):
    return grid.feeder_pool(v.profiles, current_topology(v))


@query(
    "j5_label_propagation",
    "feeder_id meter_id:i kwh:d feeder_label:i share_deviation:d suspect:b",
    """SELECT r.*, kwh - avg(kwh) OVER (PARTITION BY feeder_id) AS share_deviation,
    feeder_label = 1 AND row_number() OVER (PARTITION BY feeder_id ORDER BY round(kwh, 6) DESC, meter_id) = 1 AS suspect FROM (
    SELECT m.feeder_id, u.meter_id, coalesce(u.kwh, 0) AS kwh, feeder_label FROM (SELECT meter_id, sum(kwh) AS kwh FROM hourly GROUP BY 1) u
    JOIN meters m ON m.meter_id = u.meter_id JOIN (SELECT feeder_id, CAST(coalesce((sum(feeder_input_kwh) - sum(billed_kwh)) / sum(feeder_input_kwh), 0) > 0.08 AS INT) AS feeder_label
    FROM balance GROUP BY 1) b ON b.feeder_id = m.feeder_id) r""",
    "hourly meters balance",
    FLAGS,
)
def _(v):
    t = current_topology(v)
    return grid.propagate_labels(joins.feeder_balance(v.hourly, t, v.feeder_readings), v.hourly, t)


@query(
    "j6_physics_violation",
    "feeder_id violations:i physics_loss:d",
    """SELECT feeder_id, count(*) FILTER (e > 0) AS violations, avg(e) / (avg(feeder_input_kwh) + 1E-8) AS physics_loss FROM (
    SELECT feeder_id, 0.95 * feeder_input_kwh AS feeder_input_kwh, greatest(coalesce(billed_kwh, 0) - 0.95 * feeder_input_kwh, 0) AS e FROM balance) GROUP BY 1""",
    "balance",
    FLAGS,
)
def _(v):
    # inputs read 5 % low, so that some feeders deliver less than their meters record
    low = v.feeder_readings.withColumn("feeder_input_kwh", F.col("feeder_input_kwh") * 0.95)
    return grid.physics_violation(joins.feeder_balance(v.hourly, current_topology(v), low))


@query(
    "j7_feeder_loading",
    "feeder_id zone input_kwh:d4 metered_kwh:d4 load_pct:d loss_shown:d",
    """SELECT *, coalesce(nullif(loss_pct, 0), greatest(0, 100 - metered_kwh / greatest(input_kwh, 1) * 100)) AS loss_shown FROM loads
    ORDER BY round(load_pct, 6) DESC, feeder_id LIMIT 16""",
    "loads",
    REPORT,
)
def _(v):
    return grid.loading_table(loads(v))


@query(
    "j8_transformer_loading",
    "transformer_id rated_kva:d peak_kva:d mean_kva:d peak_loading:d",
    """SELECT *, peak_kva / rated_kva AS peak_loading FROM (SELECT transformer_id, max(kva) AS peak_kva, avg(kva) AS mean_kva FROM (
    SELECT transformer_id, hour_ts, sum(kvah) AS kva FROM hourly JOIN meters USING (meter_id) GROUP BY 1, 2) GROUP BY 1) d
    JOIN (SELECT transformer_id, max(transformer_rated_kva) AS rated_kva FROM topology GROUP BY 1) r USING (transformer_id)""",
    "hourly meters topology",
)
def _(v):
    return grid.transformer_loading(v.hourly, current_topology(v))


@query(
    "j9_zone_polygons",
    "zone risk corner:i lon:d9 lat:d9",
    f"""SELECT zone, risk, unnest(range(5)) AS corner, unnest([lon - 0.018, lon + 0.018, lon + 0.018, lon - 0.018, lon - 0.018]) AS lon,
    unnest([lat - 0.018, lat - 0.018, lat + 0.018, lat + 0.018, lat - 0.018]) AS lat FROM zones""",
    "zones",
    REPORT,
)
def _(v):
    rings = grid.zone_polygons(zones(v)).select("zone", "risk", F.posexplode("ring").alias("corner", "p"))
    return rings.select("zone", "risk", "corner", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query(
    "j10_route_legs",
    "zone alert_id:i next_stop:i leg_km:d total_km:d4",
    """SELECT *, sum(leg_km) OVER (PARTITION BY zone) AS total_km FROM (
    SELECT zone, alert_id, lead(alert_id) OVER w AS next_stop, 2 * 6371 * asin(sqrt(pow(sin(radians(lead(latitude) OVER w - latitude) / 2), 2)
    + cos(radians(latitude)) * cos(radians(lead(latitude) OVER w)) * pow(sin(radians(lead(longitude) OVER w - longitude) / 2), 2))) AS leg_km
    FROM (SELECT a.zone, a.alert_id, -anomaly_score AS s, latitude, longitude FROM alerts a JOIN meters m ON m.meter_id = a.meter_id WHERE status IN ('Open', 'Investigating'))
    WINDOW w AS (PARTITION BY zone ORDER BY s, alert_id))""",
    "alerts meters",
)
def _(v):
    stops = rollup.open_alerts(v.alerts).select("zone", "alert_id", "meter_id", (-F.col("anomaly_score")).alias("s"))
    stops = stops.join(v.meters.select("meter_id", "latitude", "longitude"), "meter_id")
    legs = grid.route_legs(stops, ["zone"], F.floor(F.col("s") * 64), ["s", "alert_id"])
    total = legs.groupBy("zone").agg(F.sum("leg_km").alias("total_km"))
    return legs.join(total, "zone")


@query(
    "j10_nearest_site",
    "zone alert_id:i meter_id:i nearest_meter:i nearest_km:d",
    """WITH sites AS (SELECT DISTINCT a.zone, a.meter_id, latitude, longitude FROM alerts a JOIN meters m ON m.meter_id = a.meter_id WHERE status IN ('Open', 'Investigating')),
    pairs AS (SELECT s.zone, s.meter_id, o.meter_id AS nearest_meter, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(o.latitude - s.latitude) / 2), 2)
    + cos(radians(s.latitude)) * cos(radians(o.latitude)) * pow(sin(radians(o.longitude - s.longitude) / 2), 2)))), 9) AS nearest_km
    FROM sites s JOIN sites o ON o.zone = s.zone AND o.meter_id <> s.meter_id),
    best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY zone, meter_id ORDER BY nearest_km, nearest_meter) = 1)
    SELECT a.zone, a.alert_id, a.meter_id, nearest_meter, nearest_km FROM alerts a JOIN sites s ON s.zone = a.zone AND s.meter_id = a.meter_id
    LEFT JOIN best b ON b.zone = a.zone AND b.meter_id = a.meter_id WHERE status IN ('Open', 'Investigating')""",
    "alerts meters",
)
def _(v):
    stops = rollup.open_alerts(v.alerts).select("zone", "alert_id", "meter_id")
    stops = stops.join(v.meters.select("meter_id", "latitude", "longitude"), "meter_id")
    near = nearest.nearest_other(stops, ["zone"], "meter_id")
    near = near.select("zone", "meter_id", F.col("nearest").alias("nearest_meter"), F.col("km").alias("nearest_km"))
    return stops.join(near, ["zone", "meter_id"])


@query(
    "j11_hierarchy_descent",
    "depth:i node meters:i transformers:i kwh:d4 input_kwh:d4 loss_ratio:d",
    """WITH rows_ AS (SELECT m.*, u.kwh FROM meters m LEFT JOIN billed u ON u.meter_id = m.meter_id),
    fed AS (SELECT feeder_id, sum(feeder_input_kwh) AS i FROM feeder_readings GROUP BY 1),
    owner AS (SELECT DISTINCT feeder_id, substation_id FROM meters)
    SELECT d.*, input_kwh, (input_kwh - kwh) / nullif(input_kwh, 0) AS loss_ratio FROM (
    SELECT 1 AS depth, substation_id AS node, count(*) AS meters, count(DISTINCT transformer_id) AS transformers, coalesce(sum(kwh), 0) AS kwh FROM rows_ GROUP BY 2
    UNION ALL SELECT 2, feeder_id, count(*), count(DISTINCT transformer_id), coalesce(sum(kwh), 0) FROM rows_ GROUP BY 2
    UNION ALL SELECT 3, feeder_id || '/' || transformer_id, count(*), count(DISTINCT transformer_id), coalesce(sum(kwh), 0) FROM rows_ GROUP BY 2
    UNION ALL SELECT 4, CAST(meter_id AS VARCHAR), count(*), count(DISTINCT transformer_id), coalesce(sum(kwh), 0) FROM rows_ GROUP BY 2) d
    LEFT JOIN (SELECT 2 AS depth, feeder_id AS node, i AS input_kwh FROM fed
    UNION ALL SELECT 1, substation_id, sum(i) FROM fed JOIN owner USING (feeder_id) GROUP BY 2) f ON f.depth = d.depth AND f.node = d.node""",
    "meters billed feeder_readings",
    REPORT,
)
def _(v):
    usage = v.hourly.groupBy("meter_id").agg(F.sum("kwh").alias("kwh"))
    return grid.descendants(v.meters, usage, v.feeder_readings)
