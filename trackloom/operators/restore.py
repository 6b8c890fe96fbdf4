"""Saved rows back to viewer targets, settings and positions, and the state a session opens with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import norm_yaw, signed_delta, signed_yaw, valid_gps
from ..functions.numbers import clamp, finite, let
from ..functions.text import parse_bool, parse_float
from .review import VIEW_ZOOM, text_or_null

#: Fixed names: projections, sources and markers that restored targets carry where their rows have none.
MARKING_PROJECTION, CANDIDATE_PROJECTION, CANDIDATE_SOURCE, CANDIDATE_MARKER = "ground_plane", "direction_only", "yolo_candidate", "target_point"
#: Fixed names of settings; int: numbers cut to whole ones.
NUMBERS = {
    "frame_shift": "int", "kp_tolerance_m": "double", "radar_range_m": "double", "radar_scale": "double", "radar_cal_fov_deg": "double", "radar_cal_dist_m": "double", "nav_step": "int", "nav_fast_step": "int",
    "radar_offset_deg": "int",
}


def optional(rows: DataFrame, name: str, kind: str = "double") -> Column:
    """A column in the kind asked for; null where the table lacks it, where a value doesn't read as that kind, or where a number isn't finite."""
    if name not in rows.columns:
        return F.lit(None).cast(kind)
    value = F.col(f"`{name}`")
    if kind != "double":
        return value.try_cast(kind)
    text = dict(rows.dtypes)[name] == "string"
    return parse_float(value) if text else finite(value.try_cast("double"))


def marking_targets(rows: DataFrame, fallback: Column | None = None) -> DataFrame:
    """The rows with ``target``, the viewer's struct of a saved marking; rows without yaw or pitch have none and go.

    A row without id gets ``fallback`` (its place, as the caller counts it), one without order its id. A click place in the very middle, of a view that looks
    elsewhere, is an old default and is left out. Columns that the table lacks count as null.
    """
    c = {n: optional(rows, n) for n in ("target_yaw", "target_pitch", "view_yaw", "view_pitch", "view_zoom", "yaw_delta", "target_id", "target_order", "x_ratio", "y_ratio", "distance_m", "bearing_deg")}
    view_yaw, view_pitch = F.coalesce(c["view_yaw"], c["target_yaw"]), F.coalesce(c["view_pitch"], c["target_pitch"])
    delta = F.coalesce(c["yaw_delta"], signed_delta(view_yaw, c["target_yaw"]))
    ident = F.coalesce(c["target_id"].cast("bigint"), F.lit(1).cast("bigint") if fallback is None else fallback.cast("bigint"))
    projection = F.coalesce(text_or_null(optional(rows, "projection", "string")), F.lit(MARKING_PROJECTION))
    middle = F.coalesce((F.abs(c["x_ratio"] - 0.5) < 1e-6) & (F.abs(c["y_ratio"] - 0.5) < 1e-6) & ((F.abs(delta) > 0.001) | (F.abs(c["target_pitch"] - view_pitch) > 0.001)), F.lit(False))
    target = F.struct(
        ident.alias("id"), F.coalesce(c["target_order"].cast("bigint"), ident).alias("order"), signed_yaw(delta).alias("yaw_delta_deg"), clamp(c["target_pitch"] - view_pitch, -90, 90).alias("pitch_delta_deg"),
        norm_yaw(c["target_yaw"]).alias("target_yaw_to_camera_heading"), clamp(c["target_pitch"], -90, 90).alias("target_pitch_deg"), norm_yaw(view_yaw).alias("view_yaw_to_camera_heading"),
        clamp(view_pitch, -90, 90).alias("view_pitch"), F.greatest(F.lit(0.01), F.coalesce(c["view_zoom"], F.lit(1.0))).alias("view_zoom"), projection.alias("projection"),
        F.when((projection == MARKING_PROJECTION) & (c["distance_m"] > 0), c["distance_m"]).alias("ground_distance_m"), F.when(~middle, clamp(c["x_ratio"], 0, 1)).alias("x_ratio"), F.when(~middle, clamp(c["y_ratio"], 0, 1)).alias("y_ratio"),
        norm_yaw(c["bearing_deg"]).alias("map_bearing_deg"), text_or_null(optional(rows, "quality", "string")).alias("quality"),
    )
    return rows.withColumn("target", target).where(c["target_yaw"].isNotNull() & c["target_pitch"].isNotNull())


def anchor(box: Column) -> Column:
    """struct(x, y, width, height) of a bounding box as JSON: an object of corners and image size, or an array of the four corners."""
    return let(F.try_parse_json(box), _anchor)


def _anchor(parsed: Column) -> Column:
    at = lambda path: finite(F.try_variant_get(parsed, path, "double"))
    nonzero = lambda x: F.nullif(x, F.lit(0.0))
    named = F.struct(
        ((at("$.x1") + at("$.x2")) / 2).alias("x"), ((at("$.y1") + at("$.y2")) / 2).alias("y"),
        F.coalesce(nonzero(at("$.image_width")), at("$.width")).alias("width"), F.coalesce(nonzero(at("$.image_height")), at("$.height")).alias("height"),
    )
    listed = F.struct(((at("$[0]") + at("$[2]")) / 2).alias("x"), ((at("$[1]") + at("$[3]")) / 2).alias("y"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    return F.when(kind.startswith("OBJECT"), named).when(kind.startswith("ARRAY") & F.try_variant_get(parsed, "$[3]", "string").isNotNull(), listed)


def candidate_targets(rows: DataFrame, flat: bool = False, width: float | None = None, height: float | None = None) -> DataFrame:
    """The rows with ``target``, the viewer's struct of a detection; rows without yaw or pitch have none and go.

    Its place in the image is that of the anchor, else of the box's centre, over the image size (of the box, the row, or for a flat video the
    video's). A flat view takes it first, a spherical one only where there are no cube-map coordinates.
    """
    c = {n: optional(rows, n) for n in ("target_yaw", "target_pitch", "confidence", "ground_distance_m", "distance_m", "map_target_yaw", "cubemap_target_yaw", "bearing_deg", "anchor_x_px", "anchor_y_px")}
    c |= {n: optional(rows, n) for n in ("image_width", "width_px", "image_height", "height_px", "cubemap_u", "cubemap_v")}
    text = lambda name: text_or_null(optional(rows, name, "string"))
    columns = rows.columns
    rows = rows.withColumn("__box", anchor(optional(rows, "evidence_bbox_json", "string")))  # read once a row
    box = F.col("__box")
    missing = c["anchor_x_px"].isNull() | c["anchor_y_px"].isNull()
    x, y = (F.when(missing, F.coalesce(box[k], c[f"anchor_{k}_px"])).otherwise(c[f"anchor_{k}_px"]) for k in "xy")
    nonzero = lambda value: F.nullif(value, F.lit(0.0))
    sizes = [F.coalesce(box[name], nonzero(c[f"image_{name}"]), c[f"{name}_px"]) for name in ("width", "height")]
    if flat and width and height:  # both of the video where either is unknown
        unknown = sizes[0].isNull() | sizes[1].isNull()
        sizes = [F.when(unknown, F.lit(float(v))).otherwise(s) for s, v in zip(sizes, (width, height), strict=True)]
    known = x.isNotNull() & y.isNotNull() & (sizes[0] != 0) & (sizes[1] != 0)
    in_box = F.when(known, F.struct(clamp(x / sizes[0], 0, 1).alias("x"), clamp(y / sizes[1], 0, 1).alias("y")))
    u, v = c["cubemap_u"], c["cubemap_v"]
    in_cube = F.when(u.isNotNull() & v.isNotNull(), F.struct(clamp((u + 1) / 2, 0, 1).alias("x"), clamp((v + 1) / 2, 0, 1).alias("y")))
    rows = rows.withColumn("__place", F.coalesce(in_box, in_cube) if flat else F.coalesce(in_cube, in_box))
    place = F.col("__place")
    ground = F.coalesce(c["ground_distance_m"], c["distance_m"])
    yaw, pitch = norm_yaw(c["target_yaw"]), clamp(c["target_pitch"], -90, 90)
    target = F.struct(
        F.lit(0.0).alias("yaw_delta_deg"), F.lit(0.0).alias("pitch_delta_deg"), yaw.alias("target_yaw_to_camera_heading"), pitch.alias("target_pitch_deg"), yaw.alias("view_yaw_to_camera_heading"), pitch.alias("view_pitch"),
        F.lit(VIEW_ZOOM).alias("view_zoom"), F.coalesce(text("projection"), F.lit(CANDIDATE_PROJECTION)).alias("projection"), F.coalesce(text("target_source"), F.lit(CANDIDATE_SOURCE)).alias("target_source"),
        F.coalesce(text("viewer_marker"), F.lit(CANDIDATE_MARKER)).alias("viewer_marker"), place["x"].alias("x_ratio"), place["y"].alias("y_ratio"),
        norm_yaw(F.coalesce(c["map_target_yaw"], c["cubemap_target_yaw"])).alias("map_target_yaw_to_camera_heading"), norm_yaw(c["bearing_deg"]).alias("map_bearing_deg"), F.when(ground > 0, ground).alias("ground_distance_m"),
        text("quality").alias("quality"), F.coalesce(text("candidate_id"), text("target_id"), text("detection_id")).alias("candidate_id"), text("semantic_class").alias("semantic_class"), c["confidence"].alias("confidence"),
        text("review_status").alias("review_status"),
    )
    found = rows.withColumn("target", target).where(c["target_yaw"].isNotNull() & c["target_pitch"].isNotNull())
    return found.select(*[F.col(f"`{n}`") for n in columns if n != "target"], "target")


def restored_settings(metadata: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row of settings for each job (``keys``) of a (key, value) table of texts; a setting that is missing or doesn't read is null.

    Fields of view are held within 1 and 179 degrees, camera height and its scale within their limits, offsets within a half turn; the video's own offset
    goes before the viewer's, whether or not it reads.
    """
    one = metadata.where("key is not null").groupBy(*keys, "key").agg(F.max("value").alias("value"))  # of a repeated key the largest text
    values = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    text = lambda k: F.try_element_at("m", F.lit(k))
    number = lambda k: parse_float(text(k))
    has = lambda k: F.map_contains_key("m", k)
    front = F.when(has("video_front_offset_deg"), number("video_front_offset_deg")).otherwise(number("viewer_front_offset_deg"))
    return values.select(
        *keys,
        *[number(k).cast("bigint").alias(k) if kind == "int" else number(k).alias(k) for k, kind in NUMBERS.items()],
        clamp(number("viewer_camera_height_m"), 0.1, 20).alias("viewer_camera_height_m"), clamp(number("viewer_hud_height_scale"), 0.1, 5).alias("viewer_hud_height_scale"),
        text("viewer_projection").alias("viewer_projection"), clamp(number("viewer_flat_hfov_deg"), 1, 179).alias("viewer_flat_hfov_deg"), clamp(number("viewer_flat_vfov_deg"), 1, 179).alias("viewer_flat_vfov_deg"),
        signed_yaw(front).alias("video_front_offset_deg"), F.when(has("follow_frame"), parse_bool(text("follow_frame"))).alias("follow_frame"),
    )


def position_of(rows: DataFrame) -> Column:
    """struct(lat, lon): the aligned pair if both parts read, else the raw pair, else the point's own coordinates; null without any."""
    pair = lambda lat, lon: F.when(optional(rows, lat).isNotNull() & optional(rows, lon).isNotNull(), F.struct(optional(rows, lat).alias("lat"), optional(rows, lon).alias("lon")))
    return F.coalesce(pair("aligned_latitude", "aligned_longitude"), pair("latitude", "longitude"), pair("point_y", "point_x"))


def gps_of(rows: DataFrame) -> Column:
    """struct(lat, lon): the first of the same pairs that is a valid position."""

    def valid(lat: str, lon: str) -> Column:
        return F.when(valid_gps(optional(rows, lat), optional(rows, lon)), F.struct(optional(rows, lat).alias("lat"), optional(rows, lon).alias("lon")))

    return F.coalesce(valid("aligned_latitude", "aligned_longitude"), valid("latitude", "longitude"), valid("point_y", "point_x"))


def rebuilt_positions(rows: DataFrame, keys: tuple[str, ...] = (), order: str = "pos") -> DataFrame:
    """keys, frame, lat, lon of each frame: the last row with a position counts. Frames are cut to whole numbers."""
    placed = rows.select(*keys, optional(rows, "frame").cast("bigint").alias("frame"), position_of(rows).alias("at"), order).where("frame is not null and at is not null")
    return placed.groupBy(*keys, "frame").agg(F.max_by("at", order).alias("at")).select(*keys, "frame", "at.lat", "at.lon")


def looked_up(asked: DataFrame, features: DataFrame, cached: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """asked (keys, frame) with lat, lon: of the frame's own feature, else of the cache, else of the processed rows.

    features, cached, rows: (keys, frame, lat, lon), at most one row for each frame in the first two; of ``rows`` the smallest ``pos`` counts.
    """
    on = [*keys, "frame"]
    first = rows.groupBy(*on).agg(F.min_by(F.struct("lat", "lon"), "pos").alias("c"))
    named = lambda df, name: df.select(*on, F.struct("lat", "lon").alias(name))
    found = asked.join(named(features, "a"), on, "left").join(named(cached, "b"), on, "left").join(first, on, "left")
    whole = lambda x: F.when(F.col(f"{x}.lat").isNotNull() & F.col(f"{x}.lon").isNotNull(), F.col(x))
    return found.withColumn("at", F.coalesce(whole("a"), whole("b"), whole("c"))).select(*asked.columns, "at.lat", "at.lon")


def snapshot_position(*pairs: tuple[Column, Column, Column, Column, Column]) -> Column:
    """struct(lat, lon, source) of the first (latitude, lat, longitude, lon, source) with both parts; the long names go before the short ones."""

    def one(latitude: Column, lat: Column, longitude: Column, lon: Column, source: Column) -> Column:
        a, b = F.coalesce(latitude, lat), F.coalesce(longitude, lon)
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon"), F.coalesce(source, F.lit("snapshot_payload")).alias("source")))

    return F.coalesce(*[one(*p) for p in pairs])


def opened_sessions(videos: DataFrame, picked: DataFrame, detected: DataFrame, listed: DataFrame, key: str = "video") -> DataFrame:
    """videos with first_frame and mode: the first marked frame, else the first detection, else the first frame; marking, detect or layer.

    picked, detected, listed: (key, frame). A video without any frame has neither.
    """
    least = lambda df, name: df.groupBy(key).agg(F.min("frame").alias(name))
    found = videos.join(least(picked, "__p"), key, "left").join(least(detected, "__d"), key, "left").join(least(listed, "__l"), key, "left")
    mode = F.when(F.col("__p").isNotNull(), "marking").when(F.col("__d").isNotNull(), "detect").when(F.col("__l").isNotNull(), "layer")
    return found.select(*videos.columns, F.coalesce("__p", "__d", "__l").alias("first_frame"), mode.alias("mode"))


def inferred_videos(asked: DataFrame, files: DataFrame, key: str = "database") -> DataFrame:
    """asked (key, folder, parent, names) with video: where a session's video lies.

    The first of its names that is in the folder or its parent, the folder first; else the only .mp4 file of the two; else null. names: in order of trust,
    blanks left out. files: (folder, name).
    """
    places = asked.select(key, F.posexplode(F.array("folder", "parent")).alias("turn", "at")).where("at is not null")
    here = files.select(F.col("folder").alias("__at"), F.col("name").alias("__name")).distinct()
    found = places.join(here, F.col("at") == F.col("__at"))
    names = asked.select(F.col(key).alias("__key"), F.posexplode("names").alias("rank", "wanted")).where(F.trim("wanted") != "")
    named = found.join(names, (F.col(key) == F.col("__key")) & (F.col("__name") == F.col("wanted")))
    path = F.concat("at", F.lit("/"), "__name")
    first = named.groupBy(key).agg(F.min_by(path, F.struct("rank", "turn")).alias("__first"))
    only = found.where(F.lower("__name").endswith(".mp4")).select(key, path.alias("p")).distinct().groupBy(key).agg(F.count("*").alias("n"), F.min("p").alias("p"))
    only = only.where("n = 1").select(key, F.col("p").alias("__only"))
    return asked.join(first, key, "left").join(only, key, "left").withColumn("video", F.coalesce("__first", "__only")).drop("__first", "__only")
