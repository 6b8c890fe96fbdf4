"""Nearest reference point within a tolerance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

METRES_PER_LAT, METRES_PER_LON = 110_574.0, 111_320.0


def cell_size(tolerance_m: float, most_lat: float) -> float:
    """Degrees beyond which no point within the tolerance can lie, for latitudes up to the given one.

    Points within the tolerance are at most sqrt(2) times the larger of the two degree spans apart in the plane; the size is above that, so of
    a point's own cell and its eight neighbours none that counts is missing.
    """
    if most_lat >= 89:
        raise ValueError("cells of degrees don't bound distances near the poles")
    lat, lon = tolerance_m / METRES_PER_LAT, tolerance_m / (METRES_PER_LON * np.cos(np.radians(most_lat)))
    return 1.5 * 1.01 * max(lat, lon, 1e-9)


def geodesic() -> Callable[[Column, Column, Column, Column], Column]:
    """Distances on the WGS84 ellipsoid, by iteration over whole batches."""

    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf("double")
    def metres(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(ellipsoidal(*(x.to_numpy(dtype=float) for x in (lat1, lon1, lat2, lon2))))

    return metres


def ellipsoidal(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Vincenty's inverse formula; NaN where it doesn't converge (nearly opposite points)."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    span = np.radians(lon2 - lon1)
    lam = span.copy()
    done = np.zeros(len(span), dtype=bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1, cos2))
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = span + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        u = cos2 * (a**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        delta = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        return np.where(done, b * big * (sigma - delta), np.nan)


def match_references(
    points: DataFrame,
    refs: DataFrame,
    tolerance_m: float,
    *,
    most_lat: float = 70.0,
    most_listed: int = 500,
    distance: Callable[[Column, Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """points with ``match``: struct(ref_idx, lat, lon, distance_m) of the nearest reference, or null.

    Nearest is by planar degrees, the first ref_idx among equals; that one is measured on the ellipsoid (or by
    ``distance``, such as ``haversine``) and kept if within the tolerance, equality included.
    References meet in cells: each is listed in its own cell and the eight around, so a point looks up one list and no
    pairs are made; references and points of one place count once there, so lists grow with different places only. Cells of more than ``most_listed`` references have several lists, and their points a row for each until the nearest is known. Points without coordinates, or beyond ``most_lat``, for which cells would be too small, raise or stay unmatched as told:
    latitudes beyond it are an error.
    """
    size = cell_size(tolerance_m, most_lat)
    measure = distance or geodesic()
    cell = lambda lat, lon: (F.floor(lat / size), F.floor(lon / size))
    own = refs.select("ref_idx", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).where("rlat is not null and rlon is not null")
    own = own.groupBy("rlat", "rlon").agg(F.min("ref_idx").alias("ref_idx"))  # of references at one place only the first can be a match
    cy, cx = cell(F.col("rlat"), F.col("rlon"))
    around = F.explode(F.array(*[F.struct((cy + y).alias("cy"), (cx + x).alias("cx")) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
    spread = own.withColumn("c", around).select("ref_idx", "rlat", "rlon", "c.cy", "c.cx")
    py, px = cell(F.col("lat"), F.col("lon"))
    safe = F.when(F.abs(F.col("lat")) > most_lat, F.raise_error(F.lit(f"a latitude is beyond most_lat = {most_lat}")).cast("bigint")).otherwise(py)
    places = points.select("lat", "lon").where("lat is not null and lon is not null").distinct()  # each place is looked up once
    placed = places.withColumn("cy", safe).withColumn("cx", px)
    parts = spread.groupBy("cy", "cx").agg(F.ceil(F.count("*") / most_listed).cast("int").alias("parts")).where("parts > 1")
    if parts.isEmpty():
        best = nearest_in(placed, spread)
    else:
        sparse = nearest_in(placed.join(parts, ["cy", "cx"], "left_anti"), spread.join(parts, ["cy", "cx"], "left_anti"))
        dense = nearest_in_parts(placed.join(parts.select("cy", "cx"), ["cy", "cx"], "left_semi"), spread.join(parts, ["cy", "cx"]))
        best = sparse.unionByName(dense)
    found = best.withColumn("metres", measure(F.col("lat"), F.col("lon"), F.col("best.rlat"), F.col("best.rlon")))
    kept = F.when(
        F.col("metres") <= tolerance_m,
        F.struct(F.col("best.ref_idx").alias("ref_idx"), F.col("best.rlat").alias("lat"), F.col("best.rlon").alias("lon"), F.col("metres").alias("distance_m")),
    )
    matches = found.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), kept.alias("match"))
    return points.drop("match").join(matches, (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), "left").drop("__lat", "__lon")


def listed(spread: DataFrame, *cells: str) -> DataFrame:
    lists = spread.groupBy(*cells).agg(F.sort_array(F.collect_list(F.struct("ref_idx", "rlat", "rlon"))).alias("near"))
    return lists.select(*cells, "near", F.col("near.rlat").alias("lats"), F.col("near.rlon").alias("lons"))


def with_best(found: DataFrame) -> DataFrame:
    """Adds best, the nearest reference of the row's list, and off, its distance in squared degrees."""
    # numbers only in the inner loop; of equally near references the first of the sorted list counts
    off = F.zip_with("lats", "lons", lambda y, x: (y - F.col("lat")) * (y - F.col("lat")) + (x - F.col("lon")) * (x - F.col("lon")))
    found = found.withColumn("off", off)
    return found.withColumn("best", F.get(F.col("near"), (F.array_position(F.col("off"), F.array_min("off")) - 1).cast("int"))).withColumn("off", F.array_min("off")).drop("near", "lats", "lons")


def nearest_in(placed: DataFrame, spread: DataFrame) -> DataFrame:
    """Points with best, by one list for each cell."""
    return with_best(placed.join(listed(spread, "cy", "cx"), ["cy", "cx"], "left")).drop("off")


def nearest_in_parts(placed: DataFrame, spread: DataFrame) -> DataFrame:
    """The same in cells of many references: these are dealt out to lists of bounded size by a hash, and of each list's nearest the point keeps the nearest, by one minimum."""
    dealt = spread.withColumn("part", F.pmod(F.xxhash64("ref_idx", "rlat", "rlon"), F.col("parts")))
    numbered = placed.withColumn("__row", F.monotonically_increasing_id())  # read once: it groups the copies of a row again
    each = with_best(numbered.join(listed(dealt, "cy", "cx", "part").drop("part"), ["cy", "cx"]))
    nearest = F.min_by(F.struct(*[F.col(f"`{c}`") for c in placed.columns], "best"), F.struct("off", "best.ref_idx")).alias("x")
    return each.groupBy("__row").agg(nearest).select("x.*")


def aligned(matched: DataFrame, refs: DataFrame) -> DataFrame:
    """The 16-column frame table: a matched frame is aligned to its reference's coordinates, any other to its own."""
    names = refs.select(F.col("ref_idx").alias("__ref"), "reference_id", "reference_name", "reference_label")
    joined = matched.join(names, F.col("match.ref_idx") == F.col("__ref"), "left").drop("__ref")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return joined.select(
        *[c for c in matched.columns if c not in ("match", "lat", "lon")],
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.coalesce("match.lat", "lat").alias("aligned_latitude"), F.coalesce("match.lon", "lon").alias("aligned_longitude"),
        blank(F.col("reference_label")).alias("kp"), blank(F.col("reference_id")).alias("reference_id"), blank(F.col("reference_name")).alias("reference_name"),
        blank(F.col("reference_label")).alias("reference_label"), F.col("match.distance_m").alias("kp_distance_m"), F.col("match.lat").alias("kp_latitude"),
        F.col("match.lon").alias("kp_longitude"), F.col("match").isNotNull().cast("int").alias("kp_match"),
    )
