"""Model jobs: fitted with MLlib or grown by seed in Spark tasks, scored where the rows are."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.kernels import Changepoints, forest_scores, grow_tree
from meterlake.operators import boosting, forecast, forest
from meterlake.sources.storage import settle, stored


# ---------------------------------------------------------------- isolation forest


class IsolationForest:
    """Hyperplane isolation trees. Fitting looks at ``trees * sample`` rows at most, whatever the size of the data."""

    def __init__(self, trees: int = 200, sample: int = 256, extension: int = 1, seed: int = 42):
        self.trees, self.sample, self.extension, self.seed = trees, sample, extension, seed
        self.grown: list[np.ndarray] = []
        self.size = float(sample)

    def fit(self, normal: DataFrame, key: Sequence[str], vector: str) -> IsolationForest:
        trees, sample, extension, seed = self.trees, self.sample, self.extension, self.seed
        # a hash order is a random sample that a repeated task draws again; a bound on the hash, from the count, keeps
        # all but about the wanted rows out of the ordering
        most = trees * sample
        hashed = normal.select(F.xxhash64(F.lit(seed), *key).alias("_h"), vector)
        part = min(1.0, (most + 8 * math.sqrt(most)) / max(1, hashed.count()))
        low = F.col("_h") <= F.lit(min(2**63 - 1, int(-(2**63) + part * 2**64)))
        pool = hashed.where(low).orderBy("_h").limit(most)
        have = pool.groupBy().agg(F.count(F.lit(1))).scalar()
        copies = F.ceil(F.lit(trees * sample) / have).cast("int")
        dealt = pool.withColumn("_n", copies).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("_h", "_i"), F.lit(trees)))

        def grow(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            x = np.vstack(rows["x"].to_numpy())
            # every tree sees its rows in one order, so a rerun grows the same tree
            x = x[np.lexsort(x.T[::-1])]
            rng = np.random.default_rng(int(keys[0]) + seed)
            if len(x) > sample:
                x = x[rng.choice(len(x), sample, replace=False)]
            tree = grow_tree(x, int(keys[0]) + seed, sample, extension)
            return pd.DataFrame({"tree": [int(keys[0])], "width": [tree.shape[1]], "rows": [len(x)], "nodes": [tree.ravel().tolist()]})

        grown = (
            dealt.select("tree", F.col(vector).alias("x"))
            .groupBy("tree")
            .applyInPandas(grow, "tree bigint, width int, rows int, nodes array<double>")
        )
        # the forest is small: trees times at most 2 * sample nodes
        found = sorted(grown.collect(), key=lambda r: r["tree"])
        self.grown = [np.array(r["nodes"]).reshape(-1, r["width"]) for r in found]
        self.size = float(np.mean([r["rows"] for r in found]))
        return self

    def score(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        trees, size = self.grown, self.size

        @F.pandas_udf("double")
        def isolation(batch: pd.Series) -> pd.Series:
            return pd.Series(forest_scores(trees, size, np.vstack(batch.to_numpy()))) if len(batch) else pd.Series([], dtype=float)

        return df.withColumn(out, isolation(F.col(vector)))


# ---------------------------------------------------------------- reconstruction error


def reconstruction_errors(rows: DataFrame, vector: str, components: int = 16) -> DataFrame:
    """Mean squared error of each standardised profile after projection on its main components and back."""
    base = settle(rows.withColumn("_v", array_to_vector(vector)), "profiles")
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(base)
    scaled = scaler.transform(base)
    pc = PCA(k=components, inputCol="_z", outputCol="_y").fit(scaled).pc.toArray()

    @F.pandas_udf("double")
    def error(z: pd.Series) -> pd.Series:
        if not len(z):
            return pd.Series([], dtype=float)
        x = np.vstack(z.to_numpy())
        return pd.Series(((x - x @ pc @ pc.T) ** 2).mean(axis=1))

    return scaled.withColumn("recon_error", error(vector_to_array("_z"))).drop("_v", "_z")


# ---------------------------------------------------------------- supervised theft score


def theft_classifier(
    daily: DataFrame, features: list[str], label: str, date: str, keys: list[str], trees: int = 220, depth: int = 10, seed: int = 42
):
    """Class-balanced random forest on the first 80 % of the days; returns the model and the scored later rows."""
    # numbering and splitting go over the days more than once
    days = settle(daily.fillna(0.0, features), "theft-days")
    rows = settle(forecast.time_split(days, date, keys), "theft")
    train = rows.where("is_train")
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    weights = tuple(n / (2 * max(1, counts.get(k, 0))) for k in (0, 1))
    model = forest.fit_forest(train, "position", features, label, weights, trees=trees, depth=depth, seed=seed)
    return model, model.score(rows.where("NOT is_train"), "supervised"), train


def importances(spark, model, features: list[str], top: int = 12) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.importances(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


# ---------------------------------------------------------------- calibration and meta classifier


def _isotonic(train: DataFrame, score: str, label: str, out: str):
    """Isotonic fit on one weighted row per distinct score, so what it pools is as small as the scores allow."""
    rows = train.groupBy(score).agg(F.avg(label).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    return stored(IsotonicRegression(featuresCol=score, labelCol="_y", weightCol="_w", predictionCol=out).fit(rows), "isotonic")


def calibrate(df: DataFrame, score: str, label: str, out: str, key: str = "alert_id", folds: int = 5) -> DataFrame:
    """Isotonic map of a score to a probability; each fold (by hash of the key) is mapped by a fit on the others."""
    rows = df.withColumn(score, F.col(score).cast("double")).withColumn(label, F.col(label).cast("double"))
    rows = settle(rows.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds))), "calibration")
    parts = []
    for k in range(folds):
        train, part = rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)
        if train.isEmpty():
            parts.append(part.withColumn(out, F.lit(None).cast("double")))
        else:
            parts.append(_isotonic(train, score, label, out).transform(part))
    return functools.reduce(DataFrame.unionByName, parts).drop("_fold")


META_FEATURES = [
    "vae_score", "eif_score", "bocpd_detected", "gnn_node_score", "gnn_balance_score",
    "peer_z_score", "load_factor_day", "night_ratio", "is_flatline",
]  # fixed values


def meta_classifier(labelled: DataFrame, rows: DataFrame, features: list[str], label: str, c: float = 0.1, folds: int = 5) -> DataFrame:
    """Logistic regression over detector columns (nulls are 0), calibrated by an isotonic map of its score.

    Every fitted model is stored and the held-out scores are written before the isotonic fit reads them, so no fit
    carries another one's plan or training summary into its tasks. With rows of one label only, the probability is
    that label; without labelled rows it is null.
    """
    base = settle(labelled.fillna(0, features).withColumn(label, F.col(label).cast("double")).select(*features, label), "meta")
    seen = [r[0] for r in base.select(label).distinct().collect()]
    if len(seen) < 2:
        return rows.withColumn("theft_probability", F.lit(seen[0] if seen else None).cast("double"))
    put = VectorAssembler(inputCols=features, outputCol="_x")
    train = put.transform(base)
    # the penalty of a sum of losses, 1 / (2 C), becomes 1 / (C n) for MLlib's mean loss
    n = max(1, train.count())
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * n), maxIter=100).fit(train)
    model = stored(model, "meta-model")

    def raw(own, df: DataFrame) -> DataFrame:
        return own.transform(df).withColumn("_p", vector_to_array("probability")[1])

    # out-of-fold scores: a calibration on the fitted rows would trust them too much
    held = []
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(*features), F.lit(folds)))
    for k in range(folds):
        rest, part = folded.where(F.col("_fold") != k), folded.where(F.col("_fold") == k)
        if rest.select(label).distinct().count() == 2:
            own = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * n), maxIter=100).fit(rest)
            held.append(raw(stored(own, "meta-fold"), part))
    scored = functools.reduce(DataFrame.unionByName, held) if held else raw(model, train)
    fitted = settle(scored.select("_p", F.col(label).alias("_label")), "held-out")
    iso = _isotonic(fitted, "_p", "_label", "theft_probability")
    scored = iso.transform(raw(model, put.transform(rows.fillna(0, features))))
    return scored.drop("_x", "_p", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- changepoints


#: Series that a task scans side by side, or fewer once they hold so many rows.
SIDE_BY_SIDE, SIDE_ROWS = 128, 1 << 18


def changepoints(slots: DataFrame, key: str, ts: str, value: str, detector: Changepoints | None = None) -> DataFrame:
    """Breaks of each series. The detector is sequential along one meter, whose slots the calendar bounds.

    A task's rows come sorted by meter and time, and whole series are scanned side by side, so that short series cost
    neither a call each nor a step of numpy for every value.
    """
    d = detector or Changepoints()
    schema = f"{key} bigint, position bigint, {ts} timestamp, probability double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [key, "position", ts, "probability"], [pa.int64(), pa.int64(), None, pa.float64()]
        waiting, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            # parts of a series: its rows in one batch each
            whole = [(k, pa.concat_arrays([t for t, _ in got]), np.concatenate([x for _, x in got])) for k, got in waiting]
            found = d.scan_many([x for _, _, x in whole])
            keys = [k for (k, _, _), (at, _) in zip(whole, found, strict=True) for _ in at]
            times = [t.take(pa.array(at)) for (_, t, _), (at, _) in zip(whole, found, strict=True)]
            at, mass = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            columns = [pa.array(keys, types[0]), pa.array(at + 1, types[1]), pa.concat_arrays(times), pa.array(mass, types[3])]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            ids = b.column(0).to_pylist()
            x = b.column(2).to_numpy(zero_copy_only=False)
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(ids)], strict=True):
                if not waiting or waiting[-1][0] != ids[i]:
                    if len(waiting) >= SIDE_BY_SIDE or held >= SIDE_ROWS:
                        yield flush()
                        waiting, held = [], 0
                    parts = []
                    waiting.append((ids[i], parts))
                parts.append((b.column(1).slice(i, j - i), x[i:j]))
                held += j - i
        if waiting:
            yield flush()

    rows = slots.where(F.col(value).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, F.col(ts).asc_nulls_last()).mapInArrow(scan, schema)


@F.udtf(returnType="meter_id bigint, position bigint, hour_ts timestamp, probability double")
class ChangepointTable:
    """Table function over rows with meter_id, hour_ts and kwh, one series per partition, in order:

        SELECT * FROM changepoints(TABLE(hours) PARTITION BY meter_id ORDER BY hour_ts)

    It holds the detector's table of one series and nothing else, however long the series is. Null values are skipped.
    """

    def __init__(self):
        self.detector = Changepoints()
        self.state, self.seen = self.detector.start(), 0

    def eval(self, row):
        if row["kwh"] is not None:
            self.seen += 1
            self.state, mass, is_break = self.detector.step(self.state, float(row["kwh"]))
            if is_break:
                yield row["meter_id"], self.seen, row["hour_ts"], mass


def recent_changepoint(slots: DataFrame, breaks: DataFrame, key: str, ts: str, look_back: int = 672) -> DataFrame:
    """Does a break lie among the last ``look_back`` hourly slots of the meter?"""
    ends = slots.groupBy(key).agg(F.max(ts).alias("_end"))
    late = breaks.groupBy(key).agg(F.max(ts).alias("_last"))
    out = ends.join(late, key, "left")
    edge = F.col("_end") - F.expr(f"INTERVAL {look_back} HOURS")
    return out.select(key, F.coalesce(F.col("_last") > edge, F.lit(False)).alias("recent_changepoint"), F.col("_last").alias("last_changepoint"))


# ---------------------------------------------------------------- demand forecasts

FORECAST_NUMBERS = ["month", "dayofweek", "day", "lag_actual", "lag_forecast", "lag_error", "forecast_mw"]


def _demand_rows(forecasts: DataFrame) -> DataFrame:
    # a row per zone and day made from all orders: medians, numbering and split read the written rows, not the orders
    rows = forecast.time_split(forecast.forecast_features(settle(forecasts, "forecasts")), "forecast_date", ["zone"])
    return settle(rows, "demand")


def _assemble(rows: DataFrame, train: DataFrame) -> DataFrame:
    index = StringIndexer(inputCol="zone", outputCol="zone_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    return VectorAssembler(inputCols=[*FORECAST_NUMBERS, "zone_index"], outputCol="features").transform(index.transform(rows))


def median_forecast(forecasts: DataFrame, iterations: int = 180, depth: int = 3, step: float = 0.04, seed: int = 42) -> DataFrame:
    """Gradient boosted trees with absolute loss, fitted on the earlier 80 %; predictions are clipped at 0."""
    rows = _demand_rows(forecasts)
    ready = _assemble(rows, rows.where("is_train"))
    model = GBTRegressor(
        labelCol="actual_mw", featuresCol="features", lossType="absolute", maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed
    ).fit(ready.where("is_train"))
    return model.transform(ready).withColumn("p50", F.greatest("prediction", F.lit(0.0))).drop("features", "prediction", "zone_index")


def _zone_numbers(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Zones as numbers in order of their mean demand, so that one cut parts small zones from large ones."""
    order = train.groupBy("zone").agg(F.avg("actual_mw").alias("_m"))
    numbered = order.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("_m", "zone"))), lambda z: z["zone"])).scalar()  # one entry a zone
    return rows.withColumn("zone_number", F.array_position(numbered, F.col("zone")).cast("double"))


def boosted_quantiles(forecasts: DataFrame, quantiles: Sequence[float] = (0.1, 0.5, 0.9), **settings) -> tuple[boosting.QuantileTrees, DataFrame]:
    """Trees that lower the pinball loss of each quantile, fitted on the earlier 80 %; the rows with p10, p50 and p90."""
    rows = _demand_rows(forecasts)
    ready = _zone_numbers(rows, rows.where("is_train"))
    model = boosting.fit_quantiles(ready.where("is_train"), [*FORECAST_NUMBERS, "zone_number"], "actual_mw", quantiles, **settings)
    return model, model.predict(ready, [f"p{round(100 * q)}" for q in quantiles])


def quantile_forecast(predicted: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Median plus the zone's residual quantiles of the calibration rows, sorted so that the three never cross."""
    from meterlake.functions.scaling import quantiles

    resid = predicted.where("is_calibration").withColumn("_r", F.col("actual_mw") - F.col("p50"))
    q = quantiles(resid, ["zone"], "_r", {"_lo": low, "_hi": high})
    # a zone without calibration rows keeps its median for all three
    rows = predicted.join(q, "zone", "left").fillna(0.0, ["_lo", "_hi"])
    three = F.array_sort(
        F.array(F.greatest(F.col("p50") + F.col("_lo"), F.lit(0.0)), F.col("p50"), F.greatest(F.col("p50") + F.col("_hi"), F.lit(0.0)))
    )
    return rows.withColumn("_t", three).withColumns({"p10": F.col("_t")[0], "p50": F.col("_t")[1], "p90": F.col("_t")[2]}).drop("_t", "_lo", "_hi")


def grid_search(forecasts: DataFrame, grid: dict[str, list], folds: int = 3, train_days: int = 30, val_days: int = 7) -> DataFrame:
    """Mean walk-forward error of every parameter set, and the smallest. Each fit is a Spark job."""
    rows = forecast.forecast_features(settle(forecasts, "forecasts"))
    parts = settle(forecast.walk_forward(rows, "forecast_date", folds, train_days, val_days), "folds")
    ready = _assemble(parts, parts)
    names = list(grid)
    found = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(names, values, strict=True))
        errors = []
        for f in range(1, folds + 1):
            fold = ready.where(F.col("fold") == f)
            model = GBTRegressor(labelCol="actual_mw", featuresCol="features", lossType="absolute", seed=42, **params).fit(fold.where("part = 'train'"))
            got = model.transform(fold.where("part = 'validation'"))
            y, p = F.greatest("actual_mw", F.lit(1e-5)), F.greatest("prediction", F.lit(0.0))
            errors.append(got.agg(F.avg(F.abs(y - p) / y)).first()[0])
        found.append((str(params), float(np.mean(errors)), float(np.std(errors))))
    best = min(found, key=lambda r: r[1])[0]
    return forecasts.sparkSession.createDataFrame(
        [(p, m, s, p == best) for p, m, s in found], "params string, mean_mape double, std_mape double, best boolean"
    )


# ---------------------------------------------------------------- known causes of a drop

CAUSES = ["temperature_delta", "is_holiday", "is_shutdown", "is_ramadan", "rainfall_mm"]  # fixed values


def cause_effects(causes: DataFrame, measured: DataFrame) -> DataFrame:
    """Part of each meter's drop that a linear effect of the known causes explains (0..1).

    Least squares needs only sums of products, so one partial aggregate per meter replaces the grouped rows; the
    small normal equations are solved in batches.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in CAUSES], F.col("season").cast("double")]
    n = len(x)
    rows = causes.where(F.col("kwh").isNotNull() & F.col("temperature_delta").isNotNull())
    cells = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [
        F.sum(x[i] * F.col("kwh")).alias(f"b{i}") for i in range(n)
    ]
    sums = rows.groupBy("meter_id").agg(*cells)
    from pyspark.sql import Window

    up, down = Window.partitionBy("meter_id").orderBy("date"), Window.partitionBy("meter_id").orderBy(F.desc("date"))
    placed = rows.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    moves = placed.groupBy("meter_id").agg(
        *[
            (F.avg(F.when(F.col("_down") <= 7, F.col(c).cast("double"))) - F.avg(F.when(F.col("_up") <= 21, F.col(c).cast("double")))).alias(f"d_{c}")
            for c in CAUSES
        ]
    )
    ready = measured.join(sums, "meter_id").join(moves, "meter_id")
    k = len(CAUSES)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.zeros((len(b), n, n))
            for i in range(n):
                for j in range(i, n):
                    a[:, i, j] = a[:, j, i] = b[f"a{i}_{j}"]
            y = b[[f"b{i}" for i in range(n)]].to_numpy()
            coef = np.einsum("rij,rj->ri", np.linalg.pinv(a, hermitian=True), y) if len(b) else np.zeros((0, n))
            delta = b[[f"d_{c}" for c in CAUSES]].to_numpy()
            moved = coef[:, 1 : 1 + k] * delta
            # only effects in the direction of the drop explain it
            explained = np.clip(-moved, 0, None).sum(axis=1)
            drop = (b["baseline_mean"] - b["recent_mean"]).to_numpy()
            share = np.where(drop > 0, np.minimum(explained / np.maximum(drop, 1e-8), 1.0), 0.0)
            out = b[["meter_id", "days", "baseline_mean", "recent_mean", "drop_fraction"]].copy()
            out["explained_fraction"] = share
            for i, c in enumerate(CAUSES):
                out[f"effect_{c}"] = coef[:, 1 + i]
            yield out

    schema = "meter_id bigint, days bigint, baseline_mean double, recent_mean double, drop_fraction double, explained_fraction double, " + ", ".join(
        f"effect_{c} double" for c in CAUSES
    )
    return ready.mapInPandas(solve, schema)
