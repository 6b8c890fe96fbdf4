"""Targets seen in the viewer, projected to places on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import calibrated_distance, camera_height, destination, distance_quality, fov, grid_radii, ground_from_pitch, ground_to_screen, norm_yaw, positive, signed_delta, signed_yaw
from ..functions.numbers import clamp


def bearing_offset(state_offset: Column, map_bearing: Column, heading: Column, target_yaw: Column, fallback: float = 0.0) -> Column:
    """The state's own offset, else the one that a target's map bearing implies, else the fallback."""
    return F.coalesce(signed_yaw(state_offset), signed_yaw(map_bearing - heading - target_yaw), F.lit(fallback))


def project_targets(rows: DataFrame, fallback_offset: float = 0.0, calibration_fov: float = 90.0, calibration_distance: float = 5.0, scale: float = 1.0) -> DataFrame:
    """Adds yaw_delta, pitch, bearing, distance_m, forward_m, mode, quality, point to one row for each target.

    rows: lat, lon, heading, state_yaw, state_zoom, state_offset, camera_height_m, hud_scale, and the target's target_yaw, view_yaw, yaw_delta,
    target_pitch, view_pitch, pitch_delta, view_zoom, ground_m, map_bearing, map_yaw, projection; any of them may be null. A target without
    yaw and without yaw delta has no point.
    """
    c = {name: F.col(name) for name in rows.columns}
    state_yaw = F.coalesce(c["state_yaw"], F.lit(0.0))
    yaw = F.coalesce(c["target_yaw"], norm_yaw(state_yaw + c["yaw_delta"]))
    delta = F.coalesce(c["yaw_delta"], signed_delta(F.coalesce(c["view_yaw"], state_yaw), yaw))
    pitch = F.coalesce(c["target_pitch"], clamp(c["view_pitch"] + c["pitch_delta"], -90, 90))
    rows = rows.withColumn("__yaw", yaw).withColumn("__delta", delta).withColumn("pitch", F.when(F.col("target_pitch").isNotNull() | (F.col("view_pitch").isNotNull() & F.col("pitch_delta").isNotNull()), pitch))
    turn = F.cos(F.radians(F.col("__delta")))
    turn = F.when(F.abs(turn) >= 0.1, turn).when(turn >= 0, 0.1).otherwise(-0.1)
    view = F.when(F.col("view_zoom").isNotNull(), fov(F.col("view_zoom"))).otherwise(fov(F.col("state_zoom")))
    ahead = calibrated_distance(view, calibration_fov, calibration_distance, scale)
    ground = F.coalesce(positive(F.col("ground_m")), ground_from_pitch(F.col("pitch"), camera_height(F.col("camera_height_m"), F.col("hud_scale"))))
    distance = F.greatest(F.lit(1.0), F.coalesce(ground, ahead / F.abs(turn)))
    forward = F.when(ground.isNotNull(), F.abs(F.greatest(F.lit(1.0), ground) * turn)).otherwise(ahead)
    offset = bearing_offset(F.col("state_offset"), F.col("map_bearing"), F.col("heading"), F.col("target_yaw"), fallback_offset)
    bearing = F.coalesce(F.col("map_bearing"), norm_yaw(F.col("heading") + offset + F.coalesce(F.col("map_yaw"), F.col("__yaw"))))
    known = F.col("__yaw").isNotNull()
    rows = (
        rows.withColumn("mode", F.when(ground.isNotNull(), "ground_plane").otherwise(F.coalesce("projection", F.lit("center_plane"))))
        .withColumn("distance_m", F.when(known, distance))
        .withColumn("forward_m", F.when(known, forward))
        .withColumn("bearing", F.when(known, bearing))
    )
    rows = rows.withColumn("quality", distance_quality(F.col("distance_m"))).withColumn("point", F.when(known, destination(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("distance_m"))))
    return rows.withColumn("yaw_delta", F.col("__delta")).withColumn("target_yaw", F.col("__yaw")).drop("__yaw", "__delta")


#: What a target has for its projection, with the names that ``project_targets`` takes.
TARGET_FIELDS = ("target_yaw", "view_yaw", "yaw_delta", "target_pitch", "view_pitch", "pitch_delta", "view_zoom", "ground_m", "map_bearing", "map_yaw", "projection")


def targets_of(states: DataFrame, single: str = "target", many: str = "targets") -> DataFrame:
    """A row for each target of a state, with ``place`` from 0: those of the list that aren't null, or the single one where there are none. States without targets have no row."""
    listed = F.filter(F.col(many), lambda t: t.isNotNull())
    all_of = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).when(F.col(single).isNotNull(), F.array(single))
    others = [F.col(f"`{c}`") for c in states.columns if c not in (single, many)]
    return states.where(all_of.isNotNull()).select(*others, F.posexplode(all_of).alias("place", "target"))


def project_state_targets(states: DataFrame, **settings: float) -> DataFrame:
    """``project_targets`` for every target of every state, with its place, id and order; targets without a point are left out.

    states: lat, lon, heading, state_yaw, state_zoom, state_offset, camera_height_m, hud_scale, target (a struct of ``TARGET_FIELDS``, id and order) and targets (an array of these).
    """
    rows = targets_of(states)
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "target"], *[F.col("target")[f].alias(f) for f in ("id", "order", *TARGET_FIELDS)])
    return project_targets(rows, **settings).where("point is not null")


def ground_grid(rows: DataFrame, samples: int = 64) -> DataFrame:
    """The rows with radius, k, x, y: where ``samples`` + 1 points of each whole-metre ring show on the stage; points out of view are left out.

    rows: inner_m, outer_m, camera_m, yaw, pitch, view_h, width, height.
    """
    c = F.col
    rings = rows.withColumn("radius", F.explode(grid_radii(c("inner_m"), c("outer_m")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    point = ground_to_screen(c("k") / float(samples) * 360.0, c("radius"), c("camera_m"), c("yaw"), c("pitch"), c("view_h"), c("width"), c("height"))
    return rings.withColumn("p", point).where("p is not null").select(*rows.columns, "radius", "k", "p.x", "p.y")
