"""Scalar functions as queries: a column over one driver table, and the SQL that gives the same values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numbers import clamp_or, fixed
from ..operators import review


@dataclass(frozen=True)
class Scalar:
    table: str
    key: str
    column: Callable[[], Column]
    sql: str


C = F.col


def mod(x: str) -> str:
    return f"((({x}) % 360e0) + 360e0) % 360e0"


def rounded(x: str, k: str = "1e6") -> str:
    return f"floor(({x}) * {k} + 0.5) / {k}"


YAW, YAW_SQL = lambda: (C("event_id") * 37 % 2000).cast("double") - 1000.0, "CAST(event_id * 37 % 2000 AS DOUBLE) - 1000e0"
OTHER, OTHER_SQL = lambda: (C("event_id") * 53 % 777).cast("double"), "CAST(event_id * 53 % 777 AS DOUBLE)"
LAT, LAT_SQL = lambda: F.lit(35.0) + (C("event_id") % 1000) / 1e4, "(35e0 + (event_id % 1000) / 1e4)"
LON, LON_SQL = lambda: F.lit(136.0) + (C("event_id") * 7 % 1000) / 1e4, "(136e0 + (event_id * 7 % 1000) / 1e4)"
LAT2, LAT2_SQL = lambda: F.lit(35.0) + (C("event_id") * 3 % 1000) / 1e4, "(35e0 + (event_id * 3 % 1000) / 1e4)"
LON2, LON2_SQL = lambda: F.lit(136.0) + (C("event_id") * 11 % 1000) / 1e4, "(136e0 + (event_id * 11 % 1000) / 1e4)"
ZOOM, ZOOM_SQL = lambda: F.when(C("p_partkey") % 9 != 0, C("p_size") / 8.0 - 0.5), "CASE WHEN p_partkey % 9 <> 0 THEN p_size / 8e0 - 0.5e0 END"
FOV_SQL = f"greatest(1e0, least(179e0, 90e0 / greatest(CASE WHEN ({ZOOM_SQL}) IS NULL OR ({ZOOM_SQL}) = 0 THEN 1e0 ELSE ({ZOOM_SQL}) END, 0.01e0)))"
PITCH, PITCH_SQL = lambda: (C("p_partkey") % 1900) / 10.0 - 95.0, "((p_partkey % 1900) / 10e0 - 95e0)"
DIST, DIST_SQL = lambda: F.when(C("p_partkey") % 17 != 0, C("p_size") / 2.0 - 1), "CASE WHEN p_partkey % 17 <> 0 THEN p_size / 2e0 - 1 END"
DIRTY = lambda: F.expr(
    "CASE p_partkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', p_size, ',', 100 + p_partkey % 900, '.5 ') WHEN 3 THEN 'nan' WHEN 4 THEN '1e999' WHEN 5 THEN concat('-', p_size)"
    " WHEN 6 THEN '1.5d' WHEN 7 THEN concat('.', p_size) WHEN 8 THEN 'Infinity' WHEN 9 THEN concat(p_size, 'e-2') WHEN 10 THEN p_name ELSE concat('+', p_size, '.25') END"
)
DIRTY_SQL = (
    "CASE p_partkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', p_size, ',', 100 + p_partkey % 900, '.5 ') WHEN 3 THEN 'nan' WHEN 4 THEN '1e999' WHEN 5 THEN concat('-', p_size)"
    " WHEN 6 THEN '1.5d' WHEN 7 THEN concat('.', p_size) WHEN 8 THEN 'Infinity' WHEN 9 THEN concat(p_size, 'e-2') WHEN 10 THEN p_name ELSE concat('+', p_size, '.25') END"
)
NAME = lambda: F.concat(C("p_brand"), F.lit(": "), C("p_type"), F.lit("--"), C("p_name"))
NAME_SQL = "concat(p_brand, ': ', p_type, '--', p_name)"
PATH = lambda: F.concat(F.lit("/a b/"), C("p_name"), F.lit(" x."), C("p_size").cast("string"), F.when(C("p_partkey") % 3 == 0, ".mp4").otherwise(""))
PATH_SQL = "concat('/a b/', p_name, ' x.', CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '.mp4' ELSE '' END)"


def picked(*values: str | None) -> tuple[Callable[[], Column], str]:
    """One of the values by p_partkey, for Spark and SQL."""
    items = " ".join(f"WHEN {k} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for k, v in enumerate(values))
    sql = f"CASE p_partkey % {len(values)} {items} END"
    return (lambda: F.expr(sql)), sql


VIDEO, VIDEO_SQL = picked(None, "", "a.mp4", "b.MP4 ", "c/d.mp4", "c:d.mp4", "e.mov")
BOOL, BOOL_SQL = picked(None, "1", " Yes", "on", "off", "TRUE", "0")
MODE, MODE_SQL = picked(None, "Marking", " picked ", "frame", "detect")
PROJ, PROJ_SQL = picked(None, "360", "PANO ", "pinhole", "front", "flat", "sphere", "x", "normal", "panorama")
ENGINE, ENGINE_SQL = picked(None, "PSV", "photosphere", "photo-sphere-viewer", "krpano", "zzz")
LOCALE, LOCALE_SQL = picked(None, "ja_JP", "EN-us", "de", "ja", "")
LAYER, LAYER_SQL = picked("360 Detection Candidates", "my poi_clusters 3", "roads", "all_classes", None)
FRAME, FRAME_SQL = picked("12", " 7 ", "-1", "3.5", "x", None, "+9")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^_+|_+$', '', 'g')"


NUMBER_SQL = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
PARSED_SQL = f"CASE WHEN regexp_matches(replace(trim({DIRTY_SQL}), ',', ''), '{NUMBER_SQL}') AND abs(TRY_CAST(replace(trim({DIRTY_SQL}), ',', '') AS DOUBLE)) < CAST('inf' AS DOUBLE) THEN TRY_CAST(replace(trim({DIRTY_SQL}), ',', '') AS DOUBLE) END"
HAV_SQL = (
    f"2e0 * 6371000e0 * asin(sqrt(pow(sin((radians({LAT2_SQL}) - radians({LAT_SQL})) / 2), 2) + cos(radians({LAT_SQL})) * cos(radians({LAT2_SQL})) * pow(sin((radians({LON2_SQL}) - radians({LON_SQL})) / 2), 2)))"
)
EAST_SQL, NORTH_SQL = f"radians({LON2_SQL} - {LON_SQL}) * 6378137e0 * cos(radians(({LAT_SQL} + {LAT2_SQL}) / 2))", f"radians({LAT2_SQL} - {LAT_SQL}) * 6378137e0"
KEY_SQL = strip(f"regexp_replace(regexp_replace(lower(trim({NAME_SQL})), '^[^:]*:', ''), '[^a-z0-9]+', '_', 'g')")
DMS_MIN = f"floor(({LAT_SQL} - floor({LAT_SQL})) * 60)"

SCALARS: dict[str, Scalar] = {
    "geo_norm_yaw": Scalar("events", "event_id", lambda: geo.norm_yaw(YAW()), mod(YAW_SQL)),
    "geo_signed_yaw": Scalar("events", "event_id", lambda: geo.signed_yaw(YAW()), f"{mod(YAW_SQL + ' + 180e0')} - 180e0"),
    "geo_signed_delta": Scalar("events", "event_id", lambda: geo.signed_delta(YAW(), OTHER()), f"{mod(f'({OTHER_SQL}) - ({YAW_SQL}) + 180e0')} - 180e0"),
    "geo_heading_delta": Scalar("events", "event_id", lambda: geo.heading_delta(YAW(), OTHER()), f"abs({mod(f'({YAW_SQL}) - ({OTHER_SQL}) + 180e0')} - 180e0)"),
    "geo_front_offset": Scalar("events", "event_id", lambda: geo.front_offset(OTHER()), f"{mod(OTHER_SQL + ' + 180e0')} - 180e0"),
    "geo_bearing": Scalar("events", "event_id", lambda: geo.bearing(OTHER(), 12.5, YAW()), mod(f"{OTHER_SQL} + 12.5e0 + {mod(YAW_SQL)}")),
    "geo_haversine": Scalar("events", "event_id", lambda: fixed(geo.haversine(LAT(), LON(), LAT2(), LON2()), 3), rounded(HAV_SQL, "1e3")),
    "geo_local_vector": Scalar("events", "event_id", lambda: fixed(geo.local_vector(LAT(), LON(), LAT2(), LON2())[0], 3), rounded(EAST_SQL, "1e3")),
    "geo_heading": Scalar("events", "event_id", lambda: fixed(geo.heading(*geo.local_vector(LAT(), LON(), LAT2(), LON2())), 6), rounded(mod(f"degrees(atan2({EAST_SQL}, {NORTH_SQL})) + 360e0"))),
    "geo_fov": Scalar("part", "p_partkey", lambda: geo.fov(ZOOM()), FOV_SQL),
    "geo_zoom_multiplier": Scalar("part", "p_partkey", lambda: geo.zoom_multiplier(ZOOM()), FOV_SQL.replace("greatest(1e0, least(179e0, 90e0", "greatest(0.25e0, least(8e0, 1e0")),
    "geo_cal_distance": Scalar("part", "p_partkey", lambda: fixed(geo.calibrated_distance(geo.fov(ZOOM()), 80.0, 5.0, 1.5), 3), rounded(f"greatest(1e0, 5e0 * 1.5e0 * tan(radians({FOV_SQL} / 2)) / tan(radians(80e0 / 2)))", "1e3")),
    "geo_camera_height": Scalar("part", "p_partkey", lambda: geo.camera_height(DIST(), ZOOM()), f"greatest(0.1e0, least(20e0, coalesce({DIST_SQL}, 1.5e0))) * greatest(0.1e0, least(5e0, coalesce({ZOOM_SQL}, 1e0)))"),
    "geo_ground_from_pitch": Scalar("part", "p_partkey", lambda: fixed(geo.ground_from_pitch(PITCH(), F.lit(1.5)), 3), rounded(f"CASE WHEN {PITCH_SQL} > 0.1 AND {PITCH_SQL} < 89.9 THEN 1.5e0 / tan(radians({PITCH_SQL})) END", "1e3")),
    "geo_ground_from_payload": Scalar("part", "p_partkey", lambda: geo.positive(DIST()), f"CASE WHEN ({DIST_SQL}) > 0 THEN {DIST_SQL} END"),
    "geo_quality": Scalar("part", "p_partkey", lambda: geo.distance_quality(DIST()), f"CASE WHEN ({DIST_SQL}) <= 5 THEN 'trusted' WHEN ({DIST_SQL}) <= 10 THEN 'usable' WHEN ({DIST_SQL}) > 10 THEN 'far' END"),
    "geo_clamps": Scalar("part", "p_partkey", lambda: clamp_or(DIST(), 0.1, 20, 1.5), f"greatest(0.1e0, least(20e0, coalesce({DIST_SQL}, 1.5e0)))"),
    "geo_infer_projection": Scalar("part", "p_partkey", lambda: geo.infer_projection(C("p_size") * 40, F.lit(1000)), "CASE WHEN abs(p_size * 40 / 1000e0 - 2e0) > 0.03 THEN 'flat' ELSE 'sphere' END"),
    "geo_destination": Scalar("events", "event_id", lambda: fixed(geo.destination(LAT(), LON(), OTHER(), OTHER() / 7)["lat"], 6), rounded(f"degrees(asin(sin(radians({LAT_SQL})) * cos({OTHER_SQL} / 7 / 6378137e0) + cos(radians({LAT_SQL})) * sin({OTHER_SQL} / 7 / 6378137e0) * cos(radians({OTHER_SQL}))))")),
    "geo_dms": Scalar("events", "event_id", lambda: geo.dms(LAT())[2]["num"], f"CAST(round_even((({LAT_SQL} - floor({LAT_SQL})) * 60 - {DMS_MIN}) * 60 * 1000000, 0) AS BIGINT)"),
    "geo_valid_gps": Scalar("events", "event_id", lambda: geo.valid_gps(OTHER() - 200, YAW()), f"abs({OTHER_SQL} - 200) <= 90 AND abs({YAW_SQL}) <= 180"),
    "geo_grid_radii": Scalar("part", "p_partkey", lambda: F.array_join(geo.grid_radii(C("p_size") / 2.0, C("p_size") * 1.0).cast("array<int>").cast("array<string>"), ","), "array_to_string(list_filter(range(1, p_size), lambda x: x * 2 <> p_size), ',')"),
    "geo_zoom_psv": Scalar("part", "p_partkey", lambda: fixed(geo.psv_level(ZOOM()), 6), rounded(f"greatest(0e0, least(100e0, (90e0 - greatest(30e0, least(90e0, 90e0 / greatest(CASE WHEN ({ZOOM_SQL}) IS NULL OR ({ZOOM_SQL}) = 0 THEN 1e0 ELSE ({ZOOM_SQL}) END, 0.01e0)))) / 60e0 * 100e0))")),
    "geo_click_flat": Scalar("part", "p_partkey", lambda: fixed(geo.click_flat(C("p_size") / 50.0, C("p_size") / 50.0, F.lit(70.0), F.lit(43.0))[0], 6), rounded("degrees(atan((greatest(0e0, least(1e0, p_size / 50e0)) - 0.5e0) * 2 * tan(radians(35e0))))")),
    "geo_rotate": Scalar("events", "event_id", lambda: fixed(geo.rotate_yaw(F.lit(1.0), F.lit(2.0), F.lit(3.0), YAW())[0], 6), rounded(f"1e0 * cos(radians({YAW_SQL})) + 3e0 * sin(radians({YAW_SQL}))")),
    "geo_ground_max": Scalar("part", "p_partkey", lambda: geo.ground_search_limit(C("p_size") * 3.0, C("p_size") * 1.0, F.lit(5.0)), "greatest(5e0, least(200e0, greatest(p_size * 3e0, p_size * 2e0, 10e0, 20e0)))"),
    "geo_fit_rect": Scalar("part", "p_partkey", lambda: geo.fit_scale(C("p_size") * 10.0, F.lit(100.0), F.lit(300.0), F.lit(200.0)), "least(300e0 / (p_size * 10e0), 200e0 / 100e0)"),
    "str_parse_float": Scalar("part", "p_partkey", lambda: text.parse_float(DIRTY()), PARSED_SQL),
    "str_parse_bool": Scalar("part", "p_partkey", lambda: text.parse_bool(BOOL()), f"coalesce(lower(trim({BOOL_SQL})) IN ('1', 'true', 'yes', 'on'), false)"),
    "str_base_name": Scalar("part", "p_partkey", lambda: text.base_name(PATH()), "CASE WHEN {0} = '' THEN 'video_gpx' ELSE {0} END".format(strip(f"regexp_replace(regexp_replace(regexp_extract({PATH_SQL}, '([^/]*)$', 1), '\\.[^.]*$', ''), '[^0-9A-Za-z_.-]+', '_', 'g')"))),
    "str_safe_layer": Scalar("part", "p_partkey", lambda: text.safe_layer(F.concat(C("p_size").cast("string"), NAME())), f"left('layer_' || lower({strip(f'''regexp_replace(concat(p_size, {NAME_SQL}), '[^0-9A-Za-z_]+', '_', 'g')''')}), 63)"),
    "str_class_key": Scalar("part", "p_partkey", lambda: text.class_key(NAME()), KEY_SQL),
    "str_class_alias": Scalar("part", "p_partkey", lambda: text.class_alias(C("p_type"), {"ECONOMY BRASS": "Eco", "promo": "Promo"}), "CASE WHEN p_type = 'ECONOMY BRASS' THEN 'Eco' WHEN p_type = 'promo' OR lower(p_type) = 'promo' THEN 'Promo' ELSE p_type END"),
    "str_candidate_name": Scalar("part", "p_partkey", lambda: text.is_candidate_name(LAYER()), f"coalesce(regexp_matches(lower({LAYER_SQL}), '360 detection candidates|360 poi clusters|all_classes|poi_candidates|poi_clusters'), false)"),
    "str_video_name": Scalar("part", "p_partkey", lambda: text.video_name_error(VIDEO()), f"CASE WHEN trim(coalesce({VIDEO_SQL}, '')) = '' THEN 'empty' WHEN regexp_matches({VIDEO_SQL}, '[/:]') THEN 'path' WHEN NOT lower(trim({VIDEO_SQL})) LIKE '%.mp4' THEN 'extension' END"),
    "str_snapshot_name": Scalar("part", "p_partkey", lambda: text.snapshot_name(NAME()), f"left(regexp_replace(regexp_replace({NAME_SQL}, '[^0-9A-Za-z_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 80)"),
    "str_cache_name": Scalar("part", "p_partkey", lambda: text.cache_name(C("p_brand"), C("p_partkey"), "v2", "view", 4096, 85, True), "printf('%s_frame_%06d_v2_view_w4096_q85_p1.jpg', p_brand, p_partkey)"),
    "str_frame_path": Scalar("part", "p_partkey", lambda: text.frame_path(C("p_partkey") * 997), "printf('%04d/frame_%07d.jpg', (p_partkey * 997) // 1000, p_partkey * 997)"),
    "str_compact": Scalar("part", "p_partkey", lambda: text.compact(F.repeat(NAME(), 3)), f"CASE WHEN length(repeat({NAME_SQL}, 3)) > 160 THEN left(repeat({NAME_SQL}, 3), 112) || ' ... ' || right(repeat({NAME_SQL}, 3), 44) ELSE repeat({NAME_SQL}, 3) END"),
    "str_locale": Scalar("part", "p_partkey", lambda: text.locale(LOCALE()), f"CASE WHEN lower(regexp_extract(coalesce({LOCALE_SQL}, ''), '^[^_-]+')) IN ('en', 'ja') THEN lower(regexp_extract({LOCALE_SQL}, '^[^_-]+')) ELSE 'en' END"),
    "str_projection_norm": Scalar("part", "p_partkey", lambda: text.projection_name(PROJ()), f"CASE WHEN lower(trim({PROJ_SQL})) IN ('flat', 'pinhole', 'front') THEN 'flat' ELSE 'sphere' END"),
    "str_engine_norm": Scalar("part", "p_partkey", lambda: text.engine_name(ENGINE()), f"CASE WHEN lower(trim({ENGINE_SQL})) IN ('psv', 'photosphere', 'photo-sphere-viewer', 'photo_sphere_viewer') THEN 'psv' ELSE 'krpano' END"),
    "str_error_list": Scalar("part", "p_partkey", lambda: text.error_list(F.transform(F.sequence(F.lit(1), C("p_size") % 9 + 1), lambda k: F.concat(F.lit("e"), k.cast("string")))), "array_to_string(list_transform(range(1, least(5, p_size % 9 + 1) + 1), lambda k: 'e' || k), '; ') || CASE WHEN p_size % 9 + 1 > 5 THEN ' and ' || (p_size % 9 + 1 - 5) || ' more' ELSE '' END"),
    "str_opt_float": Scalar("part", "p_partkey", lambda: text.opt_float(F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN ' 2.5 ' END")), "TRY_CAST(trim(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN ' 2.5 ' END) AS DOUBLE)"),
    "proj_norm_field": Scalar("part", "p_partkey", lambda: text.normalize_field(NAME()), strip(f"regexp_replace(lower(trim({NAME_SQL})), '[\\s:./()\\[\\]-]+', '_', 'g')")),
    "proj_norm_gpx_field": Scalar("part", "p_partkey", lambda: text.normalize_gpx_field(F.concat(F.lit("{http://x}"), NAME())), strip(f"regexp_replace(lower(trim({NAME_SQL})), '[\\s:./-]+', '_', 'g')")),
    "proj_frame_index": Scalar("part", "p_partkey", lambda: text.parse_frame(FRAME()), f"CASE WHEN regexp_matches(trim({FRAME_SQL}), '^[+]?[0-9]+$') THEN CAST(trim({FRAME_SQL}) AS BIGINT) END"),
    "pred_marking_mode": Scalar("part", "p_partkey", lambda: text.is_marking_mode(MODE()), f"coalesce(lower(trim({MODE_SQL})) IN ('marking', 'picked'), false)"),
    "pred_user_click": Scalar("part", "p_partkey", lambda: review.is_user_click(F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Manual_Click' WHEN 2 THEN 'yolo' ELSE '' END"), F.expr("CASE WHEN p_size % 7 = 0 THEN 'c' END"), F.lit(None).cast("string"), F.lit(""), F.expr("CASE WHEN p_size % 3 = 0 THEN 1 END"), F.expr("CASE WHEN p_size % 5 = 0 THEN 1 END")), "coalesce(p_partkey % 4 <> 2, true) AND p_size % 7 <> 0 AND (p_size % 3 = 0 OR p_size % 5 = 0)"),
    "pred_meaningful": Scalar("part", "p_partkey", lambda: review.is_meaningful(F.expr("CASE WHEN p_size % 7 = 0 THEN 'c' END"), F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit(""), F.expr("p_size % 3"), F.expr("CASE WHEN p_size % 5 = 0 THEN 0 END")), "p_size % 7 = 0 OR p_size % 3 > 0"),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    s = SCALARS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{s.table}.parquet").select(s.key, s.column().alias("value"))

    run.__name__ = name
    return run


def oracle(name: str) -> str:
    s = SCALARS[name]
    return f"SELECT {s.key}, {s.sql} AS value FROM {s.table}"
