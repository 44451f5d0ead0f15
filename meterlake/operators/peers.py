"""Load profiles and peer groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.kernels import dtw
from meterlake.functions.scaling import quantiles
from meterlake.sources.storage import settle, stored


def hourly_profile(readings: DataFrame, meters: DataFrame, start: str, end: str) -> DataFrame:
    """Mean energy per active meter and hour of observed readings in [start, end)."""
    inside = (F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp"))
    seen = readings.where(inside & (F.col("communication_status") == 0) & F.col("kwh").isNotNull())
    slots = seen.groupBy("meter_id", F.date_trunc("hour", "timestamp").alias("hour_slot")).agg(F.avg("kwh").alias("avg_kwh"))
    return slots.join(meters.where("active").select("meter_id", "tariff_category", "consumer_type"), "meter_id")


def profile_vectors(profile: DataFrame) -> DataFrame:
    """24-slot day shape per meter: mean by hour of day, absent hours 0, then z-scores within the meter
    (population deviation; a constant shape becomes zeros).

    Mean and deviation come from sums in the same aggregate as the slots, so they stay two columns in the plan
    instead of being repeated inside every slot's expression.
    """
    slots = profile.groupBy("meter_id", F.hour("hour_slot").alias("h")).agg(F.avg("avg_kwh").alias("x"))
    cells = [F.coalesce(F.max(F.when(F.col("h") == i, F.col("x"))), F.lit(0.0)).alias(f"c{i}") for i in range(24)]
    rows = slots.groupBy("meter_id").agg(
        *cells, (F.sum("x") / 24).alias("_m"), (F.sum(F.col("x") * F.col("x")) / 24).alias("_q")
    )
    var = F.col("_q") - F.col("_m") * F.col("_m")
    # what subtraction leaves of a constant shape is rounding noise
    z = [F.when(var > 1e-12 * F.col("_q"), (F.col(f"c{i}") - F.col("_m")) / F.sqrt(F.abs(var))).otherwise(0.0) for i in range(24)]
    return rows.select("meter_id", F.array(*z).alias("profile"))


def landmarks(profiles: DataFrame, count: int) -> Column:
    """A fixed-size sample of meters as one scalar array; sampled by hash, so its size never grows with the data."""
    picked = profiles.orderBy(F.xxhash64("meter_id"), "meter_id").limit(count)
    return picked.groupBy().agg(F.sort_array(F.collect_list(F.struct("meter_id", "profile")))).scalar()


def landmark_distances(profiles: DataFrame, count: int = 32) -> DataFrame:
    """DTW distance of every meter to the landmark meters: linear in meters, never all pairs."""
    rows = profiles.withColumn("_l", F.explode(landmarks(profiles, count))).select(
        "meter_id", F.col("_l.meter_id").alias("landmark_id"), "profile", F.col("_l.profile").alias("other")
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = dtw(np.vstack(b["profile"]), np.vstack(b["other"]))
                yield pd.DataFrame({"meter_id": b["meter_id"], "landmark_id": b["landmark_id"], "distance": d})

    return rows.mapInPandas(measure, "meter_id bigint, landmark_id bigint, distance double")


def affinities(distances: DataFrame) -> DataFrame:
    """Gaussian kernel with the median non-zero distance as width."""
    sigma = quantiles(distances.where(F.col("distance") > 0), [], "distance", {"s": 0.5}).scalar()
    d = F.col("distance")
    return distances.withColumn("affinity", F.exp(-d * d / (2 * sigma * sigma)))


def landmark_rows(affinity: DataFrame) -> DataFrame:
    """(meter_id, _v): each meter's affinities to the landmarks, scaled to sum 1, and columns by the root of their sum.

    With Z the matrix of these rows, Z Z' is the normalised affinity of all meters through the landmarks (Chen and
    Cai 2011); it is never made. A row has as many entries as there are landmarks.
    """
    total = affinity.groupBy("meter_id").agg(F.sum("affinity").alias("_r"))
    cells = affinity.join(total, "meter_id").select("meter_id", "landmark_id", (F.col("affinity") / F.col("_r")).alias("z"))
    column = cells.groupBy("landmark_id").agg(F.sum("z").alias("_c"))
    cells = cells.join(column, "landmark_id").withColumn("z", F.col("z") / F.sqrt("_c"))
    rows = cells.groupBy("meter_id").agg(F.sort_array(F.collect_list(F.struct("landmark_id", "z"))).alias("_z"))
    return settle(rows.select("meter_id", F.transform("_z", lambda c: c["z"]).alias("_v")), "affinity")


def group_by_affinity(affinity: DataFrame, groups: int, seed: int = 42) -> DataFrame:
    """Spectral grouping by landmarks: the main components of the meter-landmark matrix are clustered."""
    rows = landmark_rows(affinity).select("meter_id", array_to_vector("_v").alias("_v"))
    main = stored(PCA(k=groups, inputCol="_v", outputCol="_u").fit(rows), "components").transform(rows)
    model = stored(KMeans(k=groups, seed=seed, featuresCol="_u", predictionCol="cluster").fit(main), "groups")
    return model.transform(main).select("meter_id", "cluster")


def laplacian_spectrum(affinity: DataFrame) -> np.ndarray:
    """Eigenvalues of the normalised Laplacian of all meters, smallest first, as far as the landmarks carry them.

    The non-zero eigenvalues of Z Z' are those of the small Z' Z, a sum over rows: tasks add up their part, and one
    aggregate by cell ends it. What reaches the driver is a matrix of landmarks by landmarks.
    """
    rows = landmark_rows(affinity)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = np.vstack(b["_v"])
                i, j = np.triu_indices(z.shape[1])
                yield pd.DataFrame({"i": i, "j": j, "s": (z.T @ z)[i, j]})

    cells = rows.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if not len(cells):
        return np.zeros(0)
    gram = np.zeros((cells["i"].max() + 1,) * 2)
    gram[cells["i"], cells["j"]] = gram[cells["j"], cells["i"]] = cells["s"]
    return np.sort(1 - np.clip(np.linalg.eigvalsh(gram), 0, 1))


def group_count_by_gap(affinity: DataFrame, least: int = 5, most: int = 40) -> DataFrame:
    """Laplacian eigenvalues, the gap after each, and the number of groups: where the gap is largest, within bounds.

    A fixed number of landmarks shows at most as many groups; take more of them than ``most``. Without meters no rows.
    """
    values = laplacian_spectrum(affinity)
    gaps = np.diff(values[: most + 1])
    chosen = int(np.clip(int(np.argmax(gaps)) + 1, least, most)) if len(gaps) else 0
    rows = [(k + 1, float(v), float(gaps[k]) if k < len(gaps) else None, k + 1 == chosen) for k, v in enumerate(values[: most + 1])]
    return affinity.sparkSession.createDataFrame(rows, "k int, eigenvalue double, gap double, best boolean")


def nearest_links(affinity: DataFrame, nearest: int) -> DataFrame:
    """The sparse graph of each meter and its ``nearest`` landmarks, weighted by affinity; a window sees one row a landmark."""
    order = Window.partitionBy("meter_id").orderBy(F.desc("affinity"), "landmark_id")
    return affinity.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= nearest).select("meter_id", "_k", "landmark_id", F.col("affinity").alias("w"))


def power_iteration_groups(affinity: DataFrame, groups: int, nearest: int = 6, starts: int = 4, rounds: int = 15, seed: int = 42) -> DataFrame:
    """Power iteration clustering (Lin and Cohen 2010) on the meter-landmark graph, each step one aggregate.

    A value per meter goes over the links to the landmarks and back, each time as a weighted mean. After some steps
    meters of a group hold about the same value, while groups still differ; several starts keep groups apart that one
    start would show alike. The starts are hashes of the id, so reruns agree. Links stay on their meter's row, and a
    step leaves nothing but the values of the landmarks, whose number is fixed; so no meter's value is sent anywhere.
    """
    # links in the order of their rank; one without a landmark carries nothing
    link = F.struct(F.col("_k"), F.col("landmark_id"), F.col("w"))
    rows = nearest_links(affinity, nearest).where(F.col("landmark_id").isNotNull()).groupBy("meter_id").agg(F.sort_array(F.collect_list(link)).alias("_l"))
    links = settle(rows, "links")
    at = [f"x{i}" for i in range(starts)]
    size = F.lit(float(2**32))
    now = links.withColumns({c: F.pmod(F.xxhash64("meter_id", F.lit(seed + i)), size.cast("bigint")) / size for i, c in enumerate(at)})
    kind = affinity.schema["landmark_id"].dataType

    def back(there: list) -> DataFrame:
        known = F.create_map(*[c for r in there for c in (F.lit(r["landmark_id"]).cast(kind), F.array(*[F.lit(x).cast("double") for x in r["at"]]))])
        held = links.withColumn("_p", F.transform("_l", lambda p: F.struct(p["w"].alias("w"), known[p["landmark_id"]].alias("at"))))
        total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["w"])
        return held.withColumns({c: F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["w"] * p["at"][i]) / total for i, c in enumerate(at)})  # noqa: B023

    means = F.array(*[F.sum(F.col("w") * F.col(c)) / F.sum("w") for c in at]).alias("at")
    for _ in range(rounds):
        sent = now.where(F.col("meter_id").isNotNull()).select(*at, F.inline("_l"))
        there = sent.groupBy("landmark_id").agg(means).collect()  # one row a landmark
        now = back(there) if there else now.limit(0)
    now = settle(now.select("meter_id", *at).repartition("meter_id"), "power")
    # what a walk forgets last is what tells groups apart, however small it has become
    stats = now.groupBy().agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in at], *[F.stddev_pop(c).alias(f"s_{c}") for c in at])).scalar()
    scaled = [F.when(stats[f"s_{c}"] > 0, (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).otherwise(0.0) for c in at]
    rows = settle(now.select("meter_id", array_to_vector(F.array(*scaled)).alias("_u")), "power")
    model = stored(KMeans(k=groups, seed=seed, featuresCol="_u", predictionCol="cluster").fit(rows), "groups")
    return model.transform(rows).select("meter_id", "cluster")


def agreement(a: DataFrame, b: DataFrame, key: str = "meter_id", label: str = "cluster") -> DataFrame:
    """Adjusted Rand index of two groupings of the same keys, from the counts of label pairs; 1 is the same grouping."""
    both = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key).groupBy("_a", "_b").count()
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    n = F.col("count")
    cells = both.groupBy().agg(pairs(n).alias("together"), F.sum(n).alias("rows"))
    rows = both.groupBy("_a").agg(F.sum("count").alias("count")).groupBy().agg(pairs(n)).scalar()
    columns = both.groupBy("_b").agg(F.sum("count").alias("count")).groupBy().agg(pairs(n)).scalar()
    expected = rows * columns / F.nullif(F.col("rows") * (F.col("rows") - 1) / 2, F.lit(0.0))
    return cells.select("rows", ((F.col("together") - expected) / F.nullif((rows + columns) / 2 - expected, F.lit(0.0))).alias("adjusted_rand"))


def group_count_sweep(profiles: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """Silhouette per number of groups, and the best one."""
    rows = settle(profiles.select("meter_id", array_to_vector("profile").alias("features")), "profiles")
    score = ClusteringEvaluator()
    found = []
    for k in ks:
        model = stored(KMeans(k=k, seed=seed, maxIter=20).fit(rows), "sweep")
        found.append((k, float(score.evaluate(model.transform(rows)))))
    best = max(found, key=lambda r: (r[1], -r[0]))[0]
    return profiles.sparkSession.createDataFrame([(k, s, k == best) for k, s in found], "k int, silhouette double, best boolean")


def centroids(labelled: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label by position; partial sums travel, not vectors."""
    cells = labelled.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("m"))
    return cells.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_c")).select(
        label, F.transform("_c", lambda c: c["m"]).alias("centroid")
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Centroids that the grouping makes by default; a caller with more says so.
MAX_GROUPS = 40


def with_centroids(profiles: DataFrame, centres: DataFrame, label: str, out: str, most: int = MAX_GROUPS) -> DataFrame:
    """Every row with the array of all centroids; more than ``most`` of them is an error, so the array is bounded."""
    few = centres.groupBy().agg(F.slice(F.sort_array(F.collect_list(F.struct(label, "centroid"))), 1, most + 1))
    rows = profiles.withColumn(out, few.scalar())
    return rows.where(F.when(F.size(out) <= most, F.lit(True)).otherwise(F.raise_error(F.lit("too many centroids"))))


def centroid_distances(profiles: DataFrame, centres: DataFrame, label: str, vector: str, most: int = MAX_GROUPS) -> DataFrame:
    rows = with_centroids(profiles, centres, label, "_all", most).withColumn("_c", F.explode("_all"))
    return rows.select("meter_id", F.col("_c")[label].alias("cluster"), euclidean(F.col(vector), F.col("_c.centroid")).alias("distance"))


def nearest_centroid(profiles: DataFrame, centres: DataFrame, label: str, vector: str, most: int = MAX_GROUPS) -> DataFrame:
    """Closest centroid per row, found inside the row: no pairs are made."""
    scored = F.transform(
        F.col("_all"), lambda c: F.struct(euclidean(F.col(vector), c["centroid"]).alias("distance"), c[label].alias("cluster"))
    )
    rows = with_centroids(profiles, centres, label, "_all", most).withColumn("_near", F.array_min(scored))
    return rows.withColumns({"cluster": F.col("_near.cluster"), "distance": F.col("_near.distance")}).drop("_near", "_all")


def write_back(registry: DataFrame, labels: DataFrame) -> DataFrame:
    """New registry snapshot: new labels where known, else the old group."""
    new = labels.select("meter_id", F.col("cluster").alias("_new"))
    return registry.join(new, "meter_id", "left").withColumn(
        "peer_cluster_id", F.coalesce(F.col("_new").cast("bigint"), F.col("peer_cluster_id").cast("bigint"))
    ).drop("_new")


def peer_band(rows: DataFrame) -> DataFrame:
    spread = F.col("peer_std")
    return rows.withColumns(
        {
            "peer_upper": F.col("peer_mean") + spread,
            "peer_lower": F.greatest(F.col("peer_mean") - spread, F.lit(0.0)),
            "outside": (F.col("kwh") > F.col("peer_mean") + spread) | (F.col("kwh") < F.greatest(F.col("peer_mean") - spread, F.lit(0.0))),
        }
    )


def weekly_profiles(hourly: DataFrame) -> DataFrame:
    """24 hourly means per meter and ISO week."""
    h = F.hour("hour_ts")
    cells = [F.coalesce(F.avg(F.when(h == i, F.col("kwh"))), F.lit(0.0)) for i in range(24)]
    return hourly.groupBy("meter_id", F.date_trunc("week", "hour_ts").cast("date").alias("week")).agg(F.array(*cells).alias("profile"))


def history_distances(weekly: DataFrame) -> DataFrame:
    """Distance of each week to the meter's mean profile, and the newest week against the spread of the others."""
    centre = centroids(weekly, "meter_id", "profile")
    rows = weekly.join(centre, "meter_id").withColumn("distance", euclidean(F.col("profile"), F.col("centroid")))
    newest = rows.groupBy("meter_id").agg(F.max("week").alias("_w"))
    rows = rows.join(newest, "meter_id")
    past = F.when(F.col("week") < F.col("_w"), F.col("distance"))
    return rows.groupBy("meter_id").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.max(F.when(F.col("week") == F.col("_w"), F.col("distance"))).alias("latest_distance"),
        F.avg(past).alias("usual_distance"),
        F.stddev(past).alias("spread"),
    ).withColumn("straying", F.coalesce(F.col("latest_distance") > F.col("usual_distance") + 2 * F.col("spread"), F.lit(False)))


def fingerprint_drift(weekly: DataFrame) -> DataFrame:
    """Cosine distance of the newest week to the mean of the earlier weeks."""
    w = Window.partitionBy("meter_id")  # one row per meter and week
    rows = weekly.withColumn("_w", F.max("week").over(w))
    old = centroids(rows.where(F.col("week") < F.col("_w")), "meter_id", "profile")
    new = rows.where(F.col("week") == F.col("_w")).select("meter_id", "week", "profile")
    return new.join(old, "meter_id").withColumn("drift", cosine_distance(F.col("profile"), F.col("centroid")))


def plane_coordinates(profiles: DataFrame) -> DataFrame:
    rows = settle(profiles.select("meter_id", array_to_vector("profile").alias("features")), "plane")
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(rows)
    xy = vector_to_array("xy")
    return model.transform(rows).select("meter_id", xy[0].alias("x"), xy[1].alias("y"))


def slot_scores(pivot: DataFrame, cells: list[str]) -> DataFrame:
    """Z-score of each slot over all meter-days (mean and population deviation + 1e-8)."""
    stats = pivot.groupBy().agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in cells], *[F.stddev_pop(c).alias(f"s_{c}") for c in cells])
    ).scalar()
    return pivot.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] + 1e-8) for c in cells})
