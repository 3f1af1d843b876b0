"""Nearest site by great-circle distance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import EARTH_RADIUS_MILES, KM_PER_MILE, great_circle_distance
from marketloom.session import written


def nearest_site(
    points: DataFrame,
    sites: DataFrame,
    point_id: str,
    site_id: str,
    within: float,
    unit: str = "mi",
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Every point with its nearest site at most ``within`` away (NULL if there is none).

    Points and sites meet only in latitude/longitude cells: a site is written to every cell
    its search circle can touch, a point to its own, so all candidates of a point are in one
    cell. Points with equal coordinates are looked up once. Ties go to the smaller site id.
    """
    radius = EARTH_RADIUS_MILES * (1 if unit == "mi" else KM_PER_MILE)
    reach = math.degrees(within / radius)
    # A whole number of columns around the globe, each at least as wide as the reach.
    columns = max(1, int(360 / max(reach, 1e-3)))
    wide = 360 / columns
    tall = max(reach, 1e-3)

    def row(c: str) -> str:
        return f"bigint(floor(({c} + 90D) / {tall!r}D))"

    def column(c: str) -> str:
        return f"bigint(floor(({c} + 180D) / {wide!r}D))"

    # Widest longitude difference on the circle around a latitude; every column near the poles.
    spread = f"""CASE WHEN abs({lat}) + {reach!r}D >= 90D THEN 180D
                      ELSE degrees(asin(sin(radians({reach!r}D)) / cos(radians({lat})))) END"""
    reached = (
        sites.selectExpr(f"{site_id} AS site_id", f"double({lat}) AS site_lat", f"double({lon}) AS site_lon", f"{spread} AS spread")
        .selectExpr(
            "site_id",
            "site_lat",
            "site_lon",
            f"{column('site_lon - spread')} AS west",
            f"{column('site_lon + spread')} AS east",
            f"explode(sequence({row(f'site_lat - {reach!r}D')}, {row(f'site_lat + {reach!r}D')})) AS cell_row",
        )
        .selectExpr(
            "site_id",
            "site_lat",
            "site_lon",
            "cell_row",
            f"explode(sequence(west, least(east, west + {columns - 1}))) AS turned",
        )
        .selectExpr("site_id", "site_lat", "site_lon", "cell_row", f"pmod(turned, {columns}) AS cell_column")
    )
    located = points.selectExpr(f"{point_id} AS point_id", f"double({lat}) AS point_lat", f"double({lon}) AS point_lon")
    places = (
        located.select("point_lat", "point_lon")
        .distinct()
        .selectExpr("*", f"{row('point_lat')} AS cell_row", f"pmod({column('point_lon')}, {columns}) AS cell_column")
    )
    distance = great_circle_distance("point_lat", "point_lon", "site_lat", "site_lon", unit)
    near = (
        places.join(reached, ["cell_row", "cell_column"])
        .selectExpr("point_lat", "point_lon", "site_id", f"{distance} AS distance")
        .filter(F.col("distance") <= within)
        .groupBy("point_lat", "point_lon")
        .agg(F.expr("min(struct(distance, site_id)) AS best"))
    )
    return located.join(near, ["point_lat", "point_lon"], "left").selectExpr(
        "point_id", "best.site_id AS site_id", "best.distance AS distance"
    )


def nearest_in_rings(
    points: DataFrame, sites: DataFrame, point_id: str, site_id: str, unit: str = "mi", lat: str = "lat", lon: str = "lon", first: float | None = None
) -> DataFrame:
    """Every point with its nearest site, however far (NULL if there are no sites).

    Rings grow fourfold: a point whose nearest site lies within a ring is answered, the others go on to the next one. The
    first ring is small against the mean distance of the sites, so points among crowded sites meet few of them, and
    large rings are left to the few points far from any. Equal places of points and of sites are looked up once; ties go
    to the smaller site id. Rows without coordinates are points without a site, and no sites.
    """
    radius = EARTH_RADIUS_MILES * (1 if unit == "mi" else KM_PER_MILE)
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    places = sites.filter(known).groupBy(lat, lon).agg(F.min(site_id).alias(site_id))
    places = written(places, "site-places")
    count = places.count()
    left = points.filter(known).select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).distinct()
    left = written(left, "point-places")
    within = first or math.sqrt(4 * math.pi / max(count, 1)) * radius / 64
    answers = []
    while count and not left.isEmpty():
        within = min(within, math.pi * radius)
        last = within >= math.pi * radius
        asked = left.select(F.struct("lat", "lon").alias("place"), "lat", "lon")
        named = places.withColumnsRenamed({lat: "lat", lon: "lon"})
        found = written(nearest_site(asked, named, "place", site_id, within, unit), "ring")
        answers.append(found.filter("site_id IS NOT NULL"))
        if last:
            break
        left = written(found.filter("site_id IS NULL").select("point_id.lat", "point_id.lon"), "left-over")
        within *= 4
    located = points.select(F.col(point_id).alias("point_id"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    if not answers:
        return located.selectExpr("point_id", "cast(NULL AS bigint) AS site_id", "cast(NULL AS double) AS distance")
    best = reduce(DataFrame.unionByName, answers).selectExpr("point_id.lat AS _at_lat", "point_id.lon AS _at_lon", "site_id", "distance")
    met = (F.col("_lat") == F.col("_at_lat")) & (F.col("_lon") == F.col("_at_lon"))
    return located.join(best, met, "left").select("point_id", "site_id", "distance")
