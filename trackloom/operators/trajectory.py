"""Headings and displacements from frames around each frame, and the heading that is held over jumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import heading, local_vector
from ..session import ship

REACH, JUMP_DEG, LEAST_M, LEAST_RADIUS_M, STRETCH = 10, 45.0, 0.5, 1.0, 4096


def headings(positions: DataFrame, frames: DataFrame | None = None, key: str = "video", reach: int = REACH, stretch: int = STRETCH) -> DataFrame:
    """key, frame, heading, distance_m for each frame asked for (all frames with a position by default).

    positions: one row (key, frame, lat, lon) for each frame. The pair at the largest equal offset on both sides counts; without one, and with a
    position of its own, the frame and the farthest frame on one side, forward first. Neighbours are found by frame number,
    so gaps are gaps. A video is dealt out in stretches of frames; frames near a border are read in both.
    """
    asked = positions.select(key, "frame") if frames is None else frames.select(key, "frame").distinct()
    rows = positions.select(key, "frame", "lat", "lon", F.lit(False).alias("asked"))
    rows = rows.unionByName(asked.select(key, "frame", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(True).alias("asked")))
    part = lambda shift: F.floor((F.col("frame") + shift) / stretch)
    rows = rows.withColumn("part", F.explode(F.when(F.col("asked"), F.array(part(0))).otherwise(F.array_distinct(F.array(part(-reach), part(0), part(reach))))))
    near = Window.partitionBy(key, "part").orderBy("frame").rangeBetween(-reach, reach)
    here = F.when(~F.col("asked") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("frame", "lat", "lon"))
    rows = rows.withColumn("near", F.map_from_entries(F.transform(F.collect_list(here).over(near), lambda p: F.struct(p["frame"], p)))).where("asked")
    at = lambda shift: F.try_element_at(F.col("near"), F.col("frame") + F.lit(shift))

    def pair(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2")))

    both = [pair(at(-k), at(k)) for k in range(reach, 0, -1)]
    single = [x for k in range(reach, 0, -1) for x in (pair(at(0), at(k)), pair(at(-k), at(0)))]
    rows = rows.select(key, "frame", F.coalesce(*both, *single).alias("p"))  # the pair first: the vector is computed once
    east, north = local_vector(*(F.col(f"p.{x}") for x in ("lat1", "lon1", "lat2", "lon2")))
    rows = rows.select(key, "frame", east.alias("east"), north.alias("north"))
    return rows.select(key, "frame", heading(F.col("east"), F.col("north")).alias("heading"), F.sqrt(F.col("east") * F.col("east") + F.col("north") * F.col("north")).alias("distance_m"))


def held_headings(visits: DataFrame, key: str = "video", order: str = "seq", reach: int = REACH, scale: float = 1.0) -> DataFrame:
    """visits (key, order, frame, heading, distance_m) with held_heading and radius_m.

    A heading more than 45 degrees off the one held, at a frame within reach of the last, and any heading over less than half a metre, gives way
    to the one held. The comparison is with the held heading, so each row needs the one before: a key's visits are streamed in
    order through one task, one row of state at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, radius, last = object(), None, None, None
        for batch in batches:
            out_heading, out_radius = [], []
            for who, frame, now, metres in zip(batch[key], batch["frame"], batch["heading"], batch["distance_m"], strict=True):
                if who != current:
                    current, held, radius, last = who, None, None, None
                held, radius = step(held, radius, last, frame, None if pd.isna(now) else now, None if pd.isna(metres) else metres, reach, scale)
                last = frame
                out_heading.append(held)
                out_radius.append(radius)
            yield batch.assign(held_heading=out_heading, radius_m=out_radius)

    ship(visits.sparkSession)
    schema = T.StructType([*visits.schema.fields, T.StructField("held_heading", T.DoubleType()), T.StructField("radius_m", T.DoubleType())])
    return visits.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def step(held: float | None, radius: float | None, last: int | None, frame: int, now: float | None, metres: float | None, reach: int = REACH, scale: float = 1.0) -> tuple[float, float]:
    """The heading and radius held after one more frame."""
    if now is None or metres is None:
        return (0.0 if held is None else held), radius or LEAST_RADIUS_M
    near = last is not None and abs(frame - last) <= reach
    jump = near and held is not None and abs((now - held + 180.0) % 360.0 - 180.0) > JUMP_DEG
    weak = jump or metres < LEAST_M
    grown = metres * scale
    return (held if weak and held is not None else now), max(grown, LEAST_RADIUS_M) if weak else grown
