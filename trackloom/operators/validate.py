"""Viewer documents: validated targets, states and radar settings, and the merge of a new state with the one before.

Documents are JSON texts; every number in them may also be written as text. Results are structs of nullable fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import norm_yaw, signed_yaw
from ..functions.numbers import clamp, clamp_or, finite, let
from ..functions.text import opt_float, parse_frame, projection_name, video_name_error

MOST_TARGETS = 100
PROJECTIONS = ("ground_plane", "center_plane", "constant_distance", "direction_only")
QUALITIES = ("trusted", "usable", "far", "direction_only", "unknown")
TARGET_FIELDS = (
    "yaw_delta_deg", "pitch_delta_deg", "target_yaw_to_camera_heading", "view_yaw_to_camera_heading", "view_pitch", "target_pitch_deg", "view_zoom", "projection", "quality", "ground_distance_m",
    "x_ratio", "y_ratio", "map_bearing_deg", "map_target_yaw_to_camera_heading", "target_source", "semantic_class", "review_status", "candidate_id", "viewer_marker", "confidence", "id", "order",
)
RADAR_FIELDS = ("range_m", "outer_range_m", "base_sector_radius_m", "calibration_fov_deg", "calibration_distance_m", "manual_scale", "min_sector_radius_m", "min_zoom_multiplier", "max_zoom_multiplier")
STATE_FIELDS = (
    "video", "frame_index", "yaw_to_camera_heading", "pitch", "zoom", "viewer_camera_height_m", "viewer_hud_height_scale", "viewer_projection", "viewer_front_offset_deg", "applied_command_id",
    "_viewer_view_update_only", "updated_at",
)
#: Fields of a validated state, besides target and targets.
PLAIN = ("video", "frame_index", "yaw_to_camera_heading", "pitch", "zoom", "viewer_camera_height_m", "viewer_hud_height_scale", "viewer_projection", "viewer_front_offset_deg")


def _strings(names: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}`: STRING" for n in names)


TARGET_KIND, RADAR_KIND = f"STRUCT<{_strings(TARGET_FIELDS)}>", f"STRUCT<{_strings(RADAR_FIELDS)}>"
DOCUMENT_KIND = f"STRUCT<{_strings(STATE_FIELDS)}, target: {TARGET_KIND}, targets: ARRAY<{TARGET_KIND}>, radar: {RADAR_KIND}>"


def parse_document(text: Column) -> Column:
    """A document as a struct of texts; null if it isn't a JSON object."""
    return F.from_json(text, DOCUMENT_KIND, {"mode": "PERMISSIVE"})


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _number(x: Column, default: Column | float | None = None) -> Column:
    """A number; the default where none is given. What is given but no number stays null."""
    value = opt_float(_given(x))
    return value if default is None else F.when(_given(x).isNull(), default if isinstance(default, Column) else F.lit(float(default))).otherwise(value)


def _bad(x: Column) -> Column:
    return _given(x).isNotNull() & opt_float(_given(x)).isNull()


#: Fields of a target that make it invalid if given but no number, and those that then count as missing.
STRICT = ("yaw_delta_deg", "pitch_delta_deg", "target_yaw_to_camera_heading", "view_yaw_to_camera_heading", "view_pitch", "target_pitch_deg", "view_zoom")
LENIENT = ("x_ratio", "y_ratio", "ground_distance_m", "map_bearing_deg", "map_target_yaw_to_camera_heading", "confidence")


def is_target(t: Column) -> Column:
    """Whether a target is valid: it has a target yaw, and none of the first seven fields is given but no number."""
    valid = opt_float(t["target_yaw_to_camera_heading"]).isNotNull()
    for name in STRICT:
        if name != "target_yaw_to_camera_heading":
            valid = valid & ~_bad(t[name])
    return F.coalesce(valid, F.lit(False))


def _whole(x: Column) -> Column:
    return F.when(x.try_cast("bigint") > 0, x.try_cast("bigint"))


def _place(t: Column, name: str, k: Column | None) -> Column:
    return _whole(t[name]) if k is None else F.coalesce(_whole(t[name]), (k + 1).cast("bigint"))


def _valid_fields(t: Column, k: Column | None = None) -> Column:
    """The fields of a valid target; k: its place from 0, which stands for a missing id or order. Texts are read once each."""
    read = F.struct(*[opt_float(_given(t[n])).alias(n) for n in STRICT], *[finite(opt_float(_given(t[n]))).alias(n) for n in LENIENT])
    chosen = lambda name, names, other: F.when(t[name].isin(*names), t[name]).otherwise(F.lit(other))
    or_ = lambda x, default: F.coalesce(x, F.lit(float(default)))

    def angles(n: Column) -> Column:
        first = F.struct(
            signed_yaw(or_(n["yaw_delta_deg"], 0)).alias("delta"), clamp(or_(n["pitch_delta_deg"], 0), -90, 90).alias("tilt"), norm_yaw(n["target_yaw_to_camera_heading"]).alias("yaw"),
            clamp(or_(n["view_pitch"], 0), -90, 90).alias("pitch"),
        )
        return let(first, lambda a: fields(n, a))

    def fields(n: Column, a: Column) -> Column:
        return F.struct(
            a["delta"].alias("yaw_delta_deg"), a["tilt"].alias("pitch_delta_deg"), a["yaw"].alias("target_yaw_to_camera_heading"),
            clamp(F.coalesce(n["target_pitch_deg"], a["pitch"] + a["tilt"]), -90, 90).alias("target_pitch_deg"), norm_yaw(F.coalesce(n["view_yaw_to_camera_heading"], a["yaw"] - a["delta"])).alias("view_yaw_to_camera_heading"),
            a["pitch"].alias("view_pitch"), F.greatest(F.lit(0.01), or_(n["view_zoom"], 1)).alias("view_zoom"), chosen("projection", PROJECTIONS, "ground_plane").alias("projection"),
            chosen("quality", QUALITIES, None).alias("quality"), F.coalesce(clamp(n["x_ratio"], 0, 1), F.lit(0.5)).alias("x_ratio"), F.coalesce(clamp(n["y_ratio"], 0, 1), F.lit(0.5)).alias("y_ratio"),
            F.when(n["ground_distance_m"] > 0, clamp(n["ground_distance_m"], 0.01, 1000)).alias("ground_distance_m"), norm_yaw(n["map_bearing_deg"]).alias("map_bearing_deg"), norm_yaw(n["map_target_yaw_to_camera_heading"]).alias("map_target_yaw_to_camera_heading"),
            *[_given(t[name]).alias(name) for name in ("target_source", "semantic_class", "review_status", "candidate_id", "viewer_marker")],
            clamp(n["confidence"], 0, 1).alias("confidence"), _place(t, "id", k).alias("id"), _place(t, "order", k).alias("order"),
        )

    return let(read, angles)


def target(t: Column) -> Column:
    """A valid target: angles and ratios within their limits, unknown names replaced, ids only if positive. Null without a
    target yaw, or if one of the first seven fields is given but no number."""
    return F.when(is_target(t), _valid_fields(t))


def valid_targets(items: Column, most: int = MOST_TARGETS) -> Column:
    """The valid ones of the first ``most`` targets, as they came; empty where there are none."""
    return F.coalesce(F.filter(F.slice(items, 1, most), is_target), F.array().cast(f"array<{TARGET_KIND}>"))


def target_ids(items: Column, most: int = MOST_TARGETS) -> Column:
    """The ids that ``targets`` gives, without its other fields."""
    return F.transform(valid_targets(items, most), lambda t, k: _place(t, "id", k))


def targets(items: Column, most: int = MOST_TARGETS) -> Column:
    """The valid ones of the first ``most`` targets; missing ids and orders are their places among these."""
    return F.transform(valid_targets(items, most), _valid_fields).cast(placed_kind())


def placed_kind() -> str:
    doubles = ("yaw_delta_deg", "pitch_delta_deg", "target_yaw_to_camera_heading", "target_pitch_deg", "view_yaw_to_camera_heading", "view_pitch", "view_zoom")
    kinds = [*((n, "double") for n in doubles), ("projection", "string"), ("quality", "string"), ("x_ratio", "double"), ("y_ratio", "double"), ("ground_distance_m", "double"), ("map_bearing_deg", "double"), ("map_target_yaw_to_camera_heading", "double")]
    kinds += [(n, "string") for n in ("target_source", "semantic_class", "review_status", "candidate_id", "viewer_marker")] + [("confidence", "double"), ("id", "bigint"), ("order", "bigint")]
    return "array<struct<" + ",".join(f"`{n}`:{k}" for n, k in kinds) + ">>"


def radar(r: Column) -> Column:
    """Radar settings within their limits; null as a whole if a required one is missing or any given one is no number."""
    broken = _number(r["range_m"]).isNull() | _number(r["base_sector_radius_m"]).isNull()
    for name in RADAR_FIELDS:
        broken = broken | _bad(r[name])
    range_m = F.greatest(F.lit(0.1), _number(r["range_m"]))
    least = F.greatest(F.lit(0.01), _number(r["min_zoom_multiplier"], 0.25))
    return F.when(
        ~broken,
        F.struct(
            range_m.alias("range_m"), F.greatest(range_m, _number(r["outer_range_m"], range_m * 2)).alias("outer_range_m"), F.greatest(F.lit(0.0), _number(r["base_sector_radius_m"])).alias("base_sector_radius_m"),
            clamp(_number(r["calibration_fov_deg"], 90.0), 1, 179).alias("calibration_fov_deg"), F.greatest(F.lit(0.1), _number(r["calibration_distance_m"], 5.0)).alias("calibration_distance_m"),
            F.greatest(F.lit(0.1), _number(r["manual_scale"], 1.0)).alias("manual_scale"), F.greatest(F.lit(0.0), _number(r["min_sector_radius_m"], 1.0)).alias("min_sector_radius_m"), least.alias("min_zoom_multiplier"),
            F.greatest(least, _number(r["max_zoom_multiplier"], 8.0)).alias("max_zoom_multiplier"),
        ),
    )


def state(rows: DataFrame, document: str = "document", only: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``error`` (null if the document is fine) and ``state``: its validated fields, target the last of targets unless given alone.

    only: the fields to make, where not all are wanted.
    """
    d = F.col(document)
    error = (
        F.when(d.isNull(), "document").when(video_name_error(d["video"]).isNotNull(), F.concat(F.lit("video: "), video_name_error(d["video"]))).when(parse_frame(d["frame_index"]).isNull(), "frame_index")
        .when(_number(d["yaw_to_camera_heading"]).isNull(), "yaw_to_camera_heading").when(_bad(d["pitch"]), "pitch").when(_bad(d["zoom"]), "zoom")
    )
    plain = (
        F.trim(d["video"]).alias("video"), parse_frame(d["frame_index"]).alias("frame_index"), norm_yaw(_number(d["yaw_to_camera_heading"])).alias("yaw_to_camera_heading"),
        _number(d["pitch"], 0.0).alias("pitch"), _number(d["zoom"], 1.0).alias("zoom"), clamp_or(opt_float(d["viewer_camera_height_m"]), 0.1, 20, 1.5).alias("viewer_camera_height_m"),
        clamp_or(opt_float(d["viewer_hud_height_scale"]), 0.1, 5, 1).alias("viewer_hud_height_scale"), projection_name(d["viewer_projection"]).alias("viewer_projection"),
        signed_yaw(finite(opt_float(d["viewer_front_offset_deg"]))).alias("viewer_front_offset_deg"),
    )
    rows = rows.withColumn("error", error)

    def with_targets(many: Column) -> Column:
        return F.struct(*plain, F.coalesce(target(d["target"]).cast(placed_kind()[6:-1]), F.try_element_at(many, F.lit(-1))).alias("target"), many.alias("targets"))

    if only:
        named = dict(zip(PLAIN, plain, strict=True))
        whole = let(targets(d["targets"]), with_targets) if set(only) - set(named) else None
        fields = F.struct(*[named[n] if n in named else whole[n].alias(n) for n in only])
    else:
        fields = let(targets(d["targets"]), with_targets)
    return rows.withColumn("state", F.when(F.col("error").isNull(), fields))
