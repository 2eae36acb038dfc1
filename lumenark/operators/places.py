"""The nearest place of a gazetteer of any size, by a join over cells on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S

EARTH_KM = 6371.0
#: Degrees added to all reaches, for what rounding may take away.
SLACK = 1e-6


def _bands(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height).cast("int")


def _cells_of(band: Column, height: float) -> Column:
    """How many cells go around the sphere in a band, so that each is at least `height` wide where it is narrowest, and one at the poles."""
    low = F.lit(-90.0) + band * height
    far = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(low + height)))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(far)) * 360.0 / height)).cast("int")


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells).cast("int"), cells)


def nearest(points: DataFrame, gazetteer: DataFrame, km: float = R.PLACE_KM, lat: str = "gps_latitude", lon: str = "gps_longitude", name: str = "place") -> DataFrame:
    """points with `name`: of the places (i, place, lat, lon) closer than km the nearest, of equally near ones the smaller i.

    Null at (0, 0), for nulls, and for what is no latitude or longitude. Places lie in one cell each; a point looks into those cells that a
    circle of km around it touches, across the date line and over the poles. Points at one spot are looked up once. Distances are exact.
    """
    reach = km / EARTH_KM  # radians
    height = min(180.0, math.degrees(reach) + SLACK)
    at, to = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    sound = (F.abs(at) <= 90) & (F.abs(to) <= 180) & ~((at == 0) & (to == 0))
    held = points.withColumns({"_lat": F.when(sound, at), "_lon": F.when(sound, to)})
    spots = held.filter("_lat IS NOT NULL").select("_lat", "_lon").distinct()
    around = spots.withColumn("_band", F.explode(F.sequence(_bands(F.greatest(F.lit(-90.0), F.col("_lat") - height), height), _bands(F.least(F.lit(90.0), F.col("_lat") + height), height))))
    around = around.withColumn("_n", _cells_of(F.col("_band"), height))
    # How far the circle reaches to the east and west; all around if a pole is in it.
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(reach, math.pi / 2))) / F.cos(F.radians("_lat"))))) + SLACK
    wide = F.when(F.abs("_lat") + height >= 90.0, 180.0).otherwise(wide)
    first, last = F.floor((F.col("_lon") - wide + 180.0) / 360.0 * F.col("_n")), F.floor((F.col("_lon") + wide + 180.0) / 360.0 * F.col("_n"))
    some = F.transform(F.sequence(first, F.least(last, first + F.col("_n") - 1)), lambda c: F.pmod(c.cast("int"), F.col("_n")))
    asked = around.select("_lat", "_lon", "_band", F.explode(some).alias("_cell"))
    known = gazetteer.select("i", F.col("place").alias("_place"), F.col("lat").cast("double").alias("_plat"), F.col("lon").cast("double").alias("_plon")).filter("abs(_plat) <= 90 AND abs(_plon) <= 180")
    known = known.withColumn("_band", _bands(F.col("_plat"), height)).withColumn("_cell", _cell(F.col("_plon"), _cells_of(F.col("_band"), height)))
    far = S.haversine_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon"))
    near = asked.join(known, ["_band", "_cell"]).withColumn("_km", far).filter(F.col("_km") < km)
    best = near.groupBy("_lat", "_lon").agg(F.min_by("_place", F.struct("_km", "i")).alias(name))
    return held.join(best, ["_lat", "_lon"], "left").select(*points.columns, name)
