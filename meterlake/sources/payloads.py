"""Parsing of JSON payloads: map features and training summaries. Malformed text gives nulls or defaults, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_TRAINED = "not_trained"  # fixed value


def feature(text: Column) -> Column:
    """A GeoJSON feature or bare geometry as struct<kind, properties, rings>, null if it is neither.

    ``rings`` are those of a polygon, all of a multi-polygon, or a single ring with the position of a point; a feature
    without a geometry has a null kind and no rings. Positions are arrays (lon, lat); other numbers behind them are kept,
    what is no position is left out.
    """
    v = F.try_parse_json(text)
    plain = F.try_variant_get(v, "$.coordinates", "string").isNotNull()
    place = F.when(plain, v).otherwise(F.try_variant_get(v, "$.geometry", "variant"))
    kind = F.try_variant_get(place, "$.type", "string")
    at = lambda shape: F.try_variant_get(place, "$.coordinates", shape)
    rings = (
        F.when(kind == "Polygon", at("array<array<array<double>>>"))
        .when(kind == "MultiPolygon", F.flatten(at("array<array<array<array<double>>>>")))
        .when(kind == "Point", F.array(F.array(at("array<double>"))))
    )
    sound = F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: F.filter(r, lambda p: p.isNotNull()))
    known = plain | (F.try_variant_get(v, "$.type", "string") == "Feature")
    body = F.struct(kind.alias("kind"), F.try_variant_get(v, "$.properties", "map<string,string>").alias("properties"), sound.alias("rings"))
    return F.when(known, body)


def positions(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per position: the kept columns, kind, ring, place in the ring, lon, lat."""
    rings = df.select(*keep, feature(F.col(text)).alias("f")).select(*keep, F.col("f.kind").alias("kind"), F.posexplode("f.rings").alias("ring", "_r"))
    places = rings.select(*keep, "kind", "ring", F.posexplode("_r").alias("place", "_p"))
    at = lambda i: F.try_element_at("_p", F.lit(i))
    return places.select(*keep, "kind", "ring", "place", at(1).alias("lon"), at(2).alias("lat"))


def training_summary(df: DataFrame, text: str) -> DataFrame:
    """Adds what a training summary says; a missing, unreadable or untrained part is ``not_trained`` and null numbers."""
    v = F.try_parse_json(F.col(text))
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    status = lambda path: F.coalesce(at(path, "string"), F.lit(NOT_TRAINED))
    return df.withColumns(
        {
            "forecast_status": status("$.forecasting.status"),
            "anomaly_status": status("$.anomaly_detection.status"),
            "train_rows": at("$.forecasting.train_rows", "bigint"),
            "mape": at("$.forecasting.mape", "double"),
            "features": F.coalesce(F.size(at("$.forecasting.features", "array<string>")), F.lit(0)),
            "blended_f1": at("$.anomaly_detection.blended.f1", "double"),
            "best_feature": at("$.anomaly_detection.feature_importance[0].feature", "string"),
        }
    )
