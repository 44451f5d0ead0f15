"""Nearest other site on the globe: a grid index whose cells grow until the answer is certain."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scaling import join_null_safe
from meterlake.operators.forecast import EARTH_KM, haversine_km
from meterlake.sources.storage import settle

#: A level has 2 ** level cells round the equator: from about 15 cm to a quarter of the globe.
FINEST, COARSEST, LEVEL_STEP = 28, 2, 2
#: The search starts at the coarsest level whose fullest cell has at most so many places.
CELL_PLACES = 32
#: Distances are compared in whole micrometres; a ring is trusted up to a millimetre.
DIGITS, MARGIN_KM = 9, 1e-6


def _cell(latitude: Column, longitude: Column, level: int) -> tuple[Column, Column]:
    side = 360 / 2**level
    return F.floor(F.pmod(longitude + 180, F.lit(360.0)) / side) % 2**level, F.floor((latitude + 90) / side)


def _certain_km(latitude: Column, longitude: Column, level: int) -> Column:
    """Distance within which every place lies in the 3 x 3 cells about a point: to the two parallels and the two meridians."""
    side, rad = 360 / 2**level, math.pi / 180
    x, y = _cell(latitude, longitude, level)
    east = F.pmod(longitude + 180, F.lit(360.0))
    parallels = F.least(latitude + 90 - (y - 1) * side, (y + 2) * side - latitude - 90) * rad
    turn = F.least(F.least(east - (x - 1) * side, (x + 2) * side - east) * rad, F.lit(math.pi / 2))
    return F.least(parallels, F.asin(F.cos(latitude * rad) * F.sin(turn))) * EARTH_KM


def _start_level(places: DataFrame, keys: Sequence[str], latitude: str, longitude: str, most: int) -> int:
    """One pass counts the places of every cell of each level; what comes back is one row a level."""
    cells = [F.struct(F.lit(i).alias("level"), *[c.alias(n) for n, c in zip("xy", _cell(F.col(latitude), F.col(longitude), i))]) for i in range(COARSEST, FINEST + 1, LEVEL_STEP)]
    counts = places.select(*keys, F.explode(F.array(*cells)).alias("c")).groupBy(*keys, "c").count()
    fullest = {r["level"]: r["n"] for r in counts.groupBy("c.level").agg(F.max("count").alias("n")).collect()}
    fit = [level for level, n in fullest.items() if n <= most]
    return min(fit, default=FINEST)


def nearest_other(
    sites: DataFrame, keys: Sequence[str], site: str, latitude: str = "latitude", longitude: str = "longitude", cell_places: int = CELL_PLACES
) -> DataFrame:
    """(keys, site, nearest, km) for each distinct site: its nearest other site with the same keys, ties by smaller id.

    A site looks for places in its cell and the eight around it. It is done when the best of them is nearer than any
    place outside can be; the others go on in cells four times as wide. A site that goes on has no place nearer than a cell
    is wide, so few of them share a cell, and the pairs looked at stay linear in the sites, however full a cell of the
    first level is: that level is as fine as the fullest cell asks for. Sites at one place are taken together first.

    Null ids and coordinates take no part. A null key is a key. The only site of its keys has a null ``nearest``.
    Every round is written, so a lost executor repeats one round.
    """
    keys, at = list(keys), [*keys, latitude, longitude]
    known = F.col(site).isNotNull() & F.col(latitude).isNotNull() & F.col(longitude).isNotNull()
    rows = settle(sites.where(known).select(*at, site).distinct(), "sites")
    places = rows.groupBy(*at).agg(F.min(site).alias("_first"), F.count(F.lit(1)).alias("_n"))
    places = settle(places, "places")
    shared = join_null_safe(rows, places.where("_n > 1"), at)
    second = shared.where(F.col(site) > F.col("_first")).groupBy(*at).agg(F.min(site).alias("_second"))
    other = F.when(F.col(site) == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    found = [join_null_safe(shared, second, at).select(*keys, site, other.alias("nearest"), F.lit(0.0).alias("km"))]
    several = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_places")) if keys else places.groupBy().agg(F.count(F.lit(1)).alias("_places"))
    alone = places.where("_n = 1").select(*at, F.col("_first").alias(site))
    alone = join_null_safe(alone, several, keys) if keys else alone.withColumn("_places", several.scalar())
    found.append(alone.where("_places = 1").select(*keys, site, F.lit(None).cast(rows.schema[site].dataType).alias("nearest"), F.lit(None).cast("double").alias("km")))
    asked = settle(alone.where("_places > 1").drop("_places"), "asked")
    lat, lon = F.col(latitude), F.col(longitude)
    for level in [*range(_start_level(places, keys, latitude, longitude, cell_places), COARSEST - 1, -LEVEL_STEP), None]:
        if asked.isEmpty():
            break
        if level is None:  # whoever is left compares with all places of its keys
            x, y, around = F.lit(0), F.lit(0), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
            certain = F.lit(float("inf"))
        else:
            x, y = _cell(lat, lon, level)
            near = [F.struct(F.pmod(x + i, F.lit(2**level)).alias("x"), (y + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            around, certain = F.array(*near), _certain_km(lat, lon, level)
        held = places.select(*keys, x.alias("x"), y.alias("y"), lat.alias("_lat"), lon.alias("_lon"), "_first")
        open_ = asked.withColumn("_c", F.explode(around)).select(*at, site, "_c.x", "_c.y")
        pairs = join_null_safe(open_, held, [*keys, "x", "y"], "left")
        km = F.round(haversine_km(lat, lon, F.col("_lat"), F.col("_lon")), DIGITS)
        other = F.when(F.col("_first") != F.col(site), F.struct(km.alias("km"), F.col("_first").alias("id")))
        best = pairs.groupBy(*at, site).agg(F.min(other).alias("_best"))
        out = settle(best.withColumn("_done", F.coalesce(F.col("_best.km") <= certain - MARGIN_KM, F.lit(False))), "ring")
        found.append(out.where("_done").select(*keys, site, F.col("_best.id").alias("nearest"), F.col("_best.km").alias("km")))
        asked = out.where("NOT _done").select(*at, site)
    return functools.reduce(DataFrame.unionByName, found)
