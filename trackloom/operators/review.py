"""Markings and detection candidates: normalisation, de-duplication, ranking, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import norm_yaw
from ..functions.numbers import clamp, fixed

MOST, VIEW_ZOOM = 100, 1.35
CLICK_SOURCES = ("viewer_marking", "viewer_click", "manual_click", "user_click")
CUBE_FACES = ("front", "back", "left", "right", "up", "down")


def text_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def of_video(video: Column, wanted: str | None) -> Column:
    """Rows of a video, and rows that name none."""
    return F.lit(True) if not wanted else video.isNull() | (video == "") | (video == wanted)


def evidence_fits(flat: bool | Column, source: Column, path: Column, face: Column) -> Column:
    """In flat mode, evidence from cube faces doesn't count unless the source is a pinhole image."""
    plain = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    cube = plain.contains("/cubemap/") | plain.startswith("cubemap/") | F.coalesce(F.lower(F.trim(face)).isin(*CUBE_FACES), F.lit(False))
    pinhole = F.coalesce(F.lower(F.trim(source)) == "yolo_pinhole", F.lit(False))
    return ~F.lit(flat) | pinhole | ~cube if isinstance(flat, bool) else ~flat | pinhole | ~cube


def is_user_click(source: Column, candidate: Column, semantic_class: Column, marker: Column, target_id: Column, order: Column) -> Column:
    """An explicit marking: an allowed source or none, nothing of a candidate, and an id or order."""
    plain = F.coalesce(F.lower(F.trim(source)), F.lit(""))
    bare = lambda x: F.coalesce(x, F.lit("")) == ""
    return ((plain == "") | plain.isin(*CLICK_SOURCES)) & bare(candidate) & bare(semantic_class) & bare(marker) & (target_id.isNotNull() | order.isNotNull())


def is_meaningful(semantic_class: Column, candidate: Column, source: Column, marker: Column, status: Column, target_id: Column, order: Column) -> Column:
    named = F.coalesce(semantic_class, F.lit("")) != ""
    for x in (candidate, source, marker, status):
        named = named | (F.coalesce(x, F.lit("")) != "")
    return named | (F.coalesce(target_id, F.lit(0)) > 0) | (F.coalesce(order, F.lit(0)) > 0)


def marking_key(target_id: Column, order: Column, yaw: Column, pitch: Column) -> Column:
    """By id or order; without either, by the direction in thousandths of a degree."""
    number = F.coalesce(target_id, order).cast("bigint")
    direction = F.concat_ws(":", (fixed(F.coalesce(yaw, F.lit(0.0)), 3) * 1000).cast("bigint"), (fixed(F.coalesce(pitch, F.lit(0.0)), 3) * 1000).cast("bigint"))
    return F.coalesce(F.concat(F.lit("#"), number.cast("string")), direction)


def insert_markings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows whose (video, frame, id) isn't stored yet. Equal keys within the new rows are all inserted."""
    keys = existing.where("target_id is not null").select("video", "frame", F.concat(F.lit("#"), F.col("target_id").cast("bigint").cast("string")).alias("key")).distinct()
    keyed = new.withColumn("key", marking_key(F.col("target_id"), F.col("target_order"), F.col("target_yaw"), F.col("target_pitch")))
    return keyed.join(keys, ["video", "frame", "key"], "left_anti").drop("key")


def distinct_candidates(rows: DataFrame, position: str = "pos") -> DataFrame:
    """The first row, by input position, of each frame's candidate and direction in thousandths of a degree."""
    keyed = rows.withColumn("__yaw", fixed(norm_yaw(F.col("target_yaw")), 3)).withColumn("__pitch", fixed(clamp(F.col("target_pitch"), -90, 90), 3))
    keys = ["video", "frame", "candidate_id", "__yaw", "__pitch"]
    others = [c for c in rows.columns if c not in keys]
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct(*others), position).alias("x"))
    return first.select("video", "frame", "candidate_id", *[f"x.{c}" for c in others if c not in ("video", "frame", "candidate_id")])


def rank_candidates(rows: DataFrame, most: int = MOST, position: str = "pos") -> DataFrame:
    """The best ``most`` candidates of each frame with rank 1..n: with confidence first, by confidence, class and id, then input position."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = Window.partitionBy("video", "frame").orderBy(F.col("confidence").isNull(), F.col("confidence").desc(), blank("semantic_class"), blank("candidate_id"), position)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def best_view(rows: DataFrame) -> DataFrame:
    """video, frame, yaw, pitch, zoom of each frame's first-ranked candidate, found by one minimum."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.struct(F.col("confidence").isNull().alias("a"), (-F.col("confidence")).alias("b"), blank("semantic_class").alias("c"), blank("candidate_id").alias("d"), F.col("pos").alias("e"))
    best = rows.groupBy("video", "frame").agg(F.min_by(F.struct("target_yaw", "target_pitch"), place).alias("x"))
    return best.select("video", "frame", norm_yaw(F.col("x.target_yaw")).alias("yaw"), clamp(F.col("x.target_pitch"), -90, 90).alias("pitch"), F.lit(VIEW_ZOOM).alias("zoom"))


def latest_marking(rows: DataFrame, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Of each frame the marking of the largest (order, id), missing ones as 0; the last row wins among equals."""
    place = F.struct(F.coalesce("target_order", F.lit(0)).alias("a"), F.coalesce("target_id", F.lit(0)).alias("b"), F.col("pos").alias("c"))
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("x")).select(*keys, "x.*")


def restored_markings(rows: DataFrame) -> DataFrame:
    """Markings as targets: one row for each frame and id, the first by (order, id) and position, with defaults and limits applied."""
    keyed = rows.withColumn("key", marking_key(F.col("target_id"), F.col("target_order"), F.col("target_yaw"), F.col("target_pitch")))
    place = F.struct(F.coalesce("target_order", F.lit(0)).alias("a"), F.coalesce("target_id", F.lit(0)).alias("b"), F.col("pos").alias("c"))
    first = keyed.groupBy("video", "frame", "key").agg(F.min_by(F.struct("target_id", "target_order", "target_yaw", "target_pitch", "view_zoom", "pos"), place).alias("x"))
    return first.select(
        "video", "frame", F.coalesce("x.target_id", "x.target_order").alias("id"), F.coalesce("x.target_order", "x.target_id").alias("order"),
        norm_yaw(F.col("x.target_yaw")).alias("yaw"), clamp(F.coalesce("x.target_pitch", F.lit(0.0)), -90, 90).alias("pitch"), F.greatest(F.lit(0.01), F.coalesce("x.view_zoom", F.lit(1.0))).alias("zoom"),
    )


def sorted_markings(rows: DataFrame) -> DataFrame:
    """Restored markings with ``place`` from 1 within their frame: by order, then id, then input position."""
    order = Window.partitionBy("video", "frame").orderBy(F.coalesce("target.order", F.lit(0)), F.coalesce("target.id", F.lit(0)), "pos")
    return rows.withColumn("place", F.row_number().over(order))


def last_view(rows: DataFrame) -> DataFrame:
    """video, frame, yaw, pitch, zoom of the view in which each frame's last restored marking was made."""
    place = F.struct(F.coalesce("target.order", F.lit(0)).alias("a"), F.coalesce("target.id", F.lit(0)).alias("b"), F.col("pos").alias("c"))
    view = F.struct(F.col("target.view_yaw_to_camera_heading").alias("yaw"), F.col("target.view_pitch").alias("pitch"), F.col("target.view_zoom").alias("zoom"))
    return rows.groupBy("video", "frame").agg(F.max_by(view, place).alias("x")).select("video", "frame", "x.*")


def display_order(targets: Column) -> Column:
    """Targets in the order in which they are shown: by order, else id, else first; equal ones as they come."""
    number = lambda t: F.coalesce(F.nullif(t["order"], F.lit(0)), t["id"], F.lit(0)).cast("bigint")
    placed = F.sort_array(F.transform(targets, lambda t, k: F.struct(number(t).alias("a"), k.alias("b"), t.alias("t"))))
    return F.transform(placed, lambda x: x["t"])
