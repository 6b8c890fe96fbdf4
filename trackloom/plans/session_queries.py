"""Queries of restored sessions, project tables, navigation modes, settings and viewer geometry, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..functions.numbers import fixed
from ..operators import export, frames, layers, navigate, restore, review, settings
from ..operators.resample import frame_at
from ..session import dealt
from ..streaming import state
from . import fixtures
from .fixtures import table, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def mod(x: str) -> str:
    return f"((({x}) % 360e0 + 360e0) % 360e0)"


def signed(x: str) -> str:
    return f"({mod(f'({x}) + 180e0')} - 180e0)"


def rounded(x: str, k: str = "1e6") -> str:
    return f"floor(({x}) * {k} + 0.5) / {k}"


# markings and candidates as targets

MARKS = (
    "event_id AS pos, concat('v', user_id % 20) AS video, event_id % 97 AS frame, CASE WHEN event_id % 11 <> 0 THEN event_id % 7 + 1 END AS target_id, CASE WHEN event_id % 13 <> 0 THEN event_id % 5 + 1 END AS target_order,"
    " CASE WHEN event_id % 17 <> 0 THEN (event_id % 145) * 5e0 - 180e0 END AS target_yaw, (event_id % 47) * 5e0 - 115e0 AS target_pitch, CASE WHEN event_id % 4 <> 0 THEN (event_id % 73) * 10e0 - 20e0 END AS view_yaw,"
    " CASE WHEN event_id % 6 <> 0 THEN (event_id % 31) * 5e0 - 75e0 END AS view_pitch, CASE WHEN event_id % 3 <> 0 THEN (event_id % 9) / 2e0 END AS view_zoom, CASE WHEN event_id % 5 <> 0 THEN (event_id % 400) - 200e0 END AS yaw_delta,"
    " CASE WHEN event_id % 8 = 0 THEN 0.5e0 WHEN event_id % 8 < 6 THEN (event_id % 14) / 10e0 - 0.1e0 END AS x_ratio, CASE WHEN event_id % 8 = 0 THEN 0.5e0 WHEN event_id % 7 < 5 THEN (event_id % 13) / 10e0 END AS y_ratio,"
    " CASE WHEN event_id % 9 = 0 THEN 'direction_only' WHEN event_id % 9 = 1 THEN '' END AS projection, CASE WHEN event_id % 10 < 7 THEN (event_id % 50) - 3e0 END AS distance_m,"
    " CASE WHEN event_id % 12 = 0 THEN (event_id % 700) - 300e0 END AS bearing_deg, CASE WHEN event_id % 14 = 0 THEN 'far' WHEN event_id % 14 = 1 THEN '' END AS quality"
)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr(*split_columns(MARKS))


def split_columns(sql: str) -> list[str]:
    """The items of a SELECT list; commas within parentheses don't count. Literals with an exponent are doubles in both engines."""
    out, depth, last = [], 0, 0
    for k, ch in enumerate(sql):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and depth == 0:
            out.append(sql[last:k])
            last = k + 1
    return [x.strip().replace('"', "") for x in [*out, sql[last:]]]


TARGET_SQL = f"""WITH t AS (SELECT {MARKS} FROM events WHERE event_type = 'click'), a AS (
  SELECT *, coalesce(view_yaw, target_yaw) AS vy, coalesce(view_pitch, target_pitch) AS vp FROM t WHERE target_yaw IS NOT NULL AND target_pitch IS NOT NULL
), b AS (SELECT *, coalesce(yaw_delta, {signed('target_yaw - vy')}) AS yd, coalesce(target_id, pos % 5) AS tid, coalesce(nullif(trim(projection), ''), 'ground_plane') AS pr FROM a
), c AS (SELECT *, coalesce(abs(x_ratio - 0.5) < 1e-6 AND abs(y_ratio - 0.5) < 1e-6 AND (abs(yd) > 0.001 OR abs(target_pitch - vp) > 0.001), false) AS middle FROM b)
SELECT pos, tid AS id, coalesce(target_order, tid) AS "order", {rounded(signed('yd'))} AS yaw_delta_deg, greatest(-90e0, least(90e0, target_pitch - vp)) AS pitch_delta_deg, {mod('target_yaw')} AS target_yaw_to_camera_heading,
  greatest(-90e0, least(90e0, target_pitch)) AS target_pitch_deg, {mod('vy')} AS view_yaw_to_camera_heading, greatest(-90e0, least(90e0, vp)) AS view_pitch, greatest(0.01e0, coalesce(view_zoom, 1e0)) AS view_zoom, pr AS projection,
  CASE WHEN pr = 'ground_plane' AND distance_m > 0 THEN distance_m END AS ground_distance_m, CASE WHEN NOT middle AND x_ratio IS NOT NULL THEN greatest(0e0, least(1e0, x_ratio)) END AS x_ratio,
  CASE WHEN NOT middle AND y_ratio IS NOT NULL THEN greatest(0e0, least(1e0, y_ratio)) END AS y_ratio, {mod('bearing_deg')} AS map_bearing_deg, nullif(trim(quality), '') AS quality FROM c"""


@query(TARGET_SQL)
def geo_restore_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore.marking_targets(marks(spark, sf_dir), F.col("pos") % 5)
    return found.select("pos", "target.*").withColumn("yaw_delta_deg", fixed(F.col("yaw_delta_deg"), 6))


BOXES = (
    "CASE p_partkey % 7 WHEN 0 THEN concat('{\"x1\":', p_size, ',\"y1\":10,\"x2\":', p_size + 20, ',\"y2\":30,\"image_width\":200,\"image_height\":100}') WHEN 1 THEN concat('[', p_size, ',5,', p_size + 9, ',25]')"
    " WHEN 2 THEN '{\"x1\":1,\"width\":400,\"height\":300}' WHEN 3 THEN 'broken' WHEN 4 THEN '[1,2,3]' WHEN 5 THEN concat('{\"x1\":2,\"y1\":4,\"x2\":6,\"y2\":8,\"image_width\":0,\"width\":', p_size * 3, ',\"height\":50}') END"
)
SEEN = (
    "p_partkey AS pos, CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey % 90) * 10e0 - 100e0 END AS target_yaw, (p_partkey % 23) * 10e0 - 115e0 AS target_pitch, CASE WHEN p_partkey % 3 = 0 THEN p_size / 50e0 END AS confidence,"
    " CASE WHEN p_partkey % 5 = 0 THEN 'ground_plane' WHEN p_partkey % 5 = 1 THEN ' ' END AS projection, CASE WHEN p_partkey % 4 = 0 THEN p_size - 5e0 END AS ground_distance_m, CASE WHEN p_partkey % 4 < 2 THEN p_size * 2e0 END AS distance_m,"
    " CASE WHEN p_partkey % 6 = 0 THEN p_size * 20e0 END AS map_target_yaw, CASE WHEN p_partkey % 6 < 3 THEN p_size * -9e0 END AS cubemap_target_yaw, CASE WHEN p_partkey % 8 = 0 THEN p_size * 30e0 END AS bearing_deg,"
    " CASE WHEN p_partkey % 10 < 4 THEN p_size * 7e0 END AS anchor_x_px, CASE WHEN p_partkey % 10 < 3 THEN p_size * 3e0 END AS anchor_y_px, CASE WHEN p_partkey % 9 = 0 THEN 0e0 WHEN p_partkey % 9 < 5 THEN 300e0 END AS image_width,"
    " CASE WHEN p_partkey % 9 = 0 THEN 250e0 END AS width_px, CASE WHEN p_partkey % 9 < 4 THEN 150e0 END AS height_px, CASE WHEN p_partkey % 11 < 4 THEN p_size / 20e0 - 1.2e0 END AS cubemap_u, CASE WHEN p_partkey % 11 < 3 THEN p_size / 25e0 - 1e0 END AS cubemap_v,"
    " CASE WHEN p_partkey % 12 = 0 THEN '' WHEN p_partkey % 12 < 5 THEN concat('c', p_size) END AS candidate_id, CASE WHEN p_partkey % 12 < 9 THEN concat('d', p_size) END AS detection_id, p_type AS semantic_class,"
    " CASE WHEN p_partkey % 13 = 0 THEN 'yolo_pinhole' END AS target_source, CASE WHEN p_partkey % 13 = 1 THEN 'box' END AS viewer_marker, CASE WHEN p_partkey % 15 = 0 THEN 'done' END AS review_status"
)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey").selectExpr(*split_columns(SEEN), f"{BOXES} AS evidence_bbox_json")


def candidate_sql(flat: bool) -> str:
    number = lambda path: f"TRY_CAST(json_extract_string(CASE WHEN json_valid(j) THEN j END, '{path}') AS DOUBLE)"
    kind = "json_type(CASE WHEN json_valid(j) THEN j END)"
    place = "coalesce(bx, cx) AS x_ratio, coalesce(bx2, cy) AS y_ratio" if flat else "coalesce(cx, bx) AS x_ratio, coalesce(cy, bx2) AS y_ratio"
    return f"""WITH t AS (SELECT {SEEN}, {BOXES} AS j FROM part), k AS (
  SELECT *, CASE WHEN {kind} = 'OBJECT' THEN 'o' WHEN {kind} = 'ARRAY' AND json_extract_string(j, '$[3]') IS NOT NULL THEN 'a' END AS kind FROM t WHERE target_yaw IS NOT NULL
), m AS (SELECT *, CASE kind WHEN 'o' THEN ({number('$.x1')} + {number('$.x2')}) / 2 WHEN 'a' THEN ({number('$[0]')} + {number('$[2]')}) / 2 END AS ax, CASE kind WHEN 'o' THEN ({number('$.y1')} + {number('$.y2')}) / 2 WHEN 'a' THEN ({number('$[1]')} + {number('$[3]')}) / 2 END AS ay,
  CASE kind WHEN 'o' THEN coalesce(nullif({number('$.image_width')}, 0), {number('$.width')}) END AS jw, CASE kind WHEN 'o' THEN coalesce(nullif({number('$.image_height')}, 0), {number('$.height')}) END AS jh FROM k
), n AS (SELECT *, CASE WHEN anchor_x_px IS NULL OR anchor_y_px IS NULL THEN coalesce(ax, anchor_x_px) ELSE anchor_x_px END AS x, CASE WHEN anchor_x_px IS NULL OR anchor_y_px IS NULL THEN coalesce(ay, anchor_y_px) ELSE anchor_y_px END AS y,
  coalesce(jw, nullif(image_width, 0), width_px) AS w0, coalesce(jh, height_px) AS h0 FROM m
), o AS (SELECT *, {"CASE WHEN w0 IS NULL OR h0 IS NULL THEN 640e0 ELSE w0 END AS w, CASE WHEN w0 IS NULL OR h0 IS NULL THEN 480e0 ELSE h0 END AS h" if flat else "w0 AS w, h0 AS h"} FROM n
), p AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND w <> 0 AND h <> 0 THEN greatest(0e0, least(1e0, x / w)) END AS bx, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND w <> 0 AND h <> 0 THEN greatest(0e0, least(1e0, y / h)) END AS bx2,
  CASE WHEN cubemap_u IS NOT NULL AND cubemap_v IS NOT NULL THEN greatest(0e0, least(1e0, (cubemap_u + 1) / 2)) END AS cx, CASE WHEN cubemap_u IS NOT NULL AND cubemap_v IS NOT NULL THEN greatest(0e0, least(1e0, (cubemap_v + 1) / 2)) END AS cy FROM o
), q AS (SELECT *, {place} FROM p)
SELECT pos, {mod('target_yaw')} AS yaw, greatest(-90e0, least(90e0, target_pitch)) AS pitch, coalesce(nullif(trim(projection), ''), 'direction_only') AS projection, coalesce(target_source, 'yolo_candidate') AS target_source, coalesce(viewer_marker, 'target_point') AS viewer_marker,
  {rounded('x_ratio')} AS x_ratio, {rounded('y_ratio')} AS y_ratio, {mod('coalesce(map_target_yaw, cubemap_target_yaw)')} AS map_yaw, {mod('bearing_deg')} AS map_bearing, CASE WHEN coalesce(ground_distance_m, distance_m) > 0 THEN coalesce(ground_distance_m, distance_m) END AS ground,
  coalesce(nullif(candidate_id, ''), detection_id) AS candidate_id, semantic_class, confidence, review_status FROM q"""


def candidate_target(found: DataFrame) -> DataFrame:
    t = lambda name: F.col(f"target.{name}")
    return found.select(
        "pos", t("target_yaw_to_camera_heading").alias("yaw"), t("target_pitch_deg").alias("pitch"), t("projection").alias("projection"), t("target_source").alias("target_source"), t("viewer_marker").alias("viewer_marker"),
        fixed(t("x_ratio"), 6).alias("x_ratio"), fixed(t("y_ratio"), 6).alias("y_ratio"), t("map_target_yaw_to_camera_heading").alias("map_yaw"), t("map_bearing_deg").alias("map_bearing"), t("ground_distance_m").alias("ground"),
        t("candidate_id").alias("candidate_id"), t("semantic_class").alias("semantic_class"), t("confidence").alias("confidence"), t("review_status").alias("review_status"),
    )


@query(candidate_sql(False))
def geo_restore_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_target(restore.candidate_targets(seen(spark, sf_dir)))


@query(candidate_sql(True))
def geo_restore_candidate_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_target(restore.candidate_targets(seen(spark, sf_dir), flat=True, width=640, height=480))


# settings

KEYS = (
    "frame_shift", "kp_tolerance_m", "radar_range_m", "radar_scale", "radar_offset_deg", "nav_step", "viewer_camera_height_m", "viewer_hud_height_scale", "viewer_projection", "viewer_flat_hfov_deg", "video_front_offset_deg",
    "viewer_front_offset_deg", "follow_frame", "radar_cal_fov_deg", "other",
)
SETTING_KEY = "CASE c_custkey % 15 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KEYS)) + " END"
SETTING_VALUE = "CASE WHEN c_custkey % 15 = 12 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'True' ELSE 'no' END WHEN c_custkey % 15 = 8 THEN 'flat' WHEN c_nationkey % 5 = 0 THEN 'x' WHEN c_nationkey % 5 = 1 THEN concat(' ', c_nationkey, '.5 ') ELSE CAST(c_custkey % 500 - 20 AS STRING) END"


def settings_sql() -> str:
    text_of = lambda k: f"max(v) FILTER (key = '{k}')"
    number = lambda k: f"TRY_CAST(trim({text_of(k)}) AS DOUBLE)"
    whole = lambda k: f"CAST(trunc({number(k)}) AS BIGINT)"
    held = lambda k, low, high: f"CASE WHEN {number(k)} IS NOT NULL THEN greatest({low}, least({high}, {number(k)})) END"
    front = f"CASE WHEN count(*) FILTER (key = 'video_front_offset_deg') > 0 THEN {number('video_front_offset_deg')} ELSE {number('viewer_front_offset_deg')} END"
    return f"""WITH s AS (SELECT CAST(floor(c_custkey / 15) AS BIGINT) AS job, {SETTING_KEY} AS key, {SETTING_VALUE.replace('STRING', 'VARCHAR')} AS v FROM customer)
SELECT job, {whole('frame_shift')} AS frame_shift, {number('kp_tolerance_m')} AS kp_tolerance_m, {number('radar_range_m')} AS radar_range_m, {whole('radar_offset_deg')} AS radar_offset_deg, {whole('nav_step')} AS nav_step,
  {held('viewer_camera_height_m', '0.1e0', '20e0')} AS camera, {held('viewer_hud_height_scale', '0.1e0', '5e0')} AS hud, {text_of('viewer_projection')} AS viewer_projection, {held('viewer_flat_hfov_deg', '1e0', '179e0')} AS hfov, {signed(front)} AS front,
  CASE WHEN count(*) FILTER (key = 'follow_frame') > 0 THEN lower(trim({text_of('follow_frame')})) IN ('1', 'true', 'yes', 'on') END AS follow FROM s GROUP BY job"""


@query(settings_sql())
def json_apply_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("CAST(floor(c_custkey / 15) AS BIGINT) AS job", f"{SETTING_KEY} AS key", f"{SETTING_VALUE} AS value")
    found = restore.restored_settings(rows, ("job",))
    return found.select(
        "job", "frame_shift", "kp_tolerance_m", "radar_range_m", "radar_offset_deg", "nav_step", F.col("viewer_camera_height_m").alias("camera"), F.col("viewer_hud_height_scale").alias("hud"), "viewer_projection",
        F.col("viewer_flat_hfov_deg").alias("hfov"), F.col("video_front_offset_deg").alias("front"), F.col("follow_frame").alias("follow"),
    )


SET_SQL = "CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN '0' ELSE CAST(event_id % 600 - 20 AS {0}) END"


@query(f"WITH t AS (SELECT event_id, {SET_SQL.format('VARCHAR')} AS r, CASE event_id % 6 WHEN 0 THEN ' kp' WHEN 1 THEN 'walk' WHEN 2 THEN NULL ELSE 'frame' END AS mode FROM events), n AS (SELECT *, coalesce(TRY_CAST(r AS DOUBLE), CASE WHEN r IS NULL THEN NULL END) AS v FROM t)"
       " SELECT event_id, concat_ws(' | ', CASE WHEN coalesce(trim(mode), '') NOT IN ('frame', 'layer', 'kp', 'marking', 'picked', 'detect') THEN 'nav_mode choice' END, CASE WHEN r = 'x' THEN 'nav_step unreadable' WHEN coalesce(v, 1) < 1 THEN 'nav_step range 1.0' END) AS navigation,"
       " concat_ws(' | ', CASE WHEN r = 'x' THEN 'radar_range_m unreadable' WHEN coalesce(v, 5) < 1 OR coalesce(v, 5) > 500 THEN 'radar_range_m range 1.0 500.0' END, CASE WHEN r = 'x' THEN 'radar_offset_deg unreadable' WHEN coalesce(v, 0) NOT IN (0, 90, 180, 270) THEN 'radar_offset_deg choice' END) AS radar FROM n")  # fmt: skip
def json_validate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{SET_SQL.format('STRING')} AS r", "CASE event_id % 6 WHEN 0 THEN ' kp' WHEN 1 THEN 'walk' WHEN 2 THEN NULL ELSE 'frame' END AS mode")
    none = F.lit(None).cast("string")
    shown = lambda e: F.array_join(F.transform(e, lambda x: F.concat_ws(" ", x["field"], x["rule"], x["low"], x["high"])), " | ")
    return rows.select("event_id", shown(settings.navigation_errors(F.col("mode"), F.col("r"), none)).alias("navigation"), shown(settings.radar_errors(F.col("r"), none, none, none, F.col("r"))).alias("radar"))


# positions

PLACED = (
    "event_id AS pos, user_id % 40 AS video, CASE WHEN event_id % 23 <> 0 THEN event_id * 3 % 199 END AS frame, CASE WHEN event_id % 3 = 0 THEN 35e0 + event_id % 100 / 1e3 END AS aligned_latitude, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 136e0 + event_id % 90 / 1e3 END AS aligned_longitude,"
    " CASE WHEN event_id % 4 < 2 THEN 36e0 + event_id % 80 / 1e3 END AS latitude, CASE WHEN event_id % 4 = 0 THEN 400e0 WHEN event_id % 4 = 1 THEN 137e0 + event_id % 70 / 1e3 END AS longitude,"
    " CASE WHEN event_id % 5 < 3 THEN 34e0 + event_id % 60 / 1e3 END AS point_y, CASE WHEN event_id % 5 < 3 THEN 135e0 + event_id % 50 / 1e3 END AS point_x"
)
PLACED_SQL = f"WITH t AS (SELECT {PLACED} FROM events)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*split_columns(PLACED))


def pair_sql(test: str) -> str:
    pairs = (("aligned_latitude", "aligned_longitude"), ("latitude", "longitude"), ("point_y", "point_x"))
    return "coalesce(" + ", ".join(f"CASE WHEN {test.format(lat=a, lon=b)} THEN struct_pack(lat := {a}, lon := {b}) END" for a, b in pairs) + ")"


BOTH, VALID = "{lat} IS NOT NULL AND {lon} IS NOT NULL", "abs({lat}) <= 90 AND abs({lon}) <= 180"


@query(PLACED_SQL + f", p AS (SELECT *, {pair_sql(BOTH)} AS spot FROM t WHERE frame IS NOT NULL) SELECT video, frame, spot.lat AS lat, spot.lon AS lon FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY pos DESC) AS k FROM p WHERE spot IS NOT NULL) WHERE k = 1")
def join_rebuild_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.rebuilt_positions(placed(spark, sf_dir), ("video",))


@query(PLACED_SQL + f" SELECT pos, spot.lat AS lat, spot.lon AS lon FROM (SELECT *, {pair_sql(VALID)} AS spot FROM t)")
def join_gps_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir)
    return rows.select("pos", restore.gps_of(rows).alias("at")).select("pos", "at.lat", "at.lon")


LOOKED = PLACED_SQL + """, f AS (SELECT DISTINCT video, frame FROM t WHERE frame IS NOT NULL), a AS (SELECT video, frame, max(latitude) AS lat, max(longitude) AS lon FROM t WHERE pos % 3 = 0 GROUP BY video, frame),
b AS (SELECT video, frame, max(point_y) AS lat, max(point_x) AS lon FROM t WHERE pos % 3 = 1 GROUP BY video, frame), r AS (SELECT video, frame, pos, 33e0 + pos % 10 AS lat, 134e0 AS lon FROM t WHERE pos % 3 = 2),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY pos) AS k FROM r) WHERE k = 1)
SELECT f.video, f.frame, CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL THEN a.lat WHEN b.lat IS NOT NULL AND b.lon IS NOT NULL THEN b.lat ELSE c.lat END AS lat, CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL THEN a.lon WHEN b.lat IS NOT NULL AND b.lon IS NOT NULL THEN b.lon ELSE c.lon END AS lon
FROM f LEFT JOIN a ON a.video = f.video AND a.frame = f.frame LEFT JOIN b ON b.video = f.video AND b.frame = f.frame LEFT JOIN c ON c.video = f.video AND c.frame = f.frame"""


@query(LOOKED)
def join_position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = placed(spark, sf_dir)
    one = lambda k, lat, lon: t.where(F.col("pos") % 3 == k).groupBy("video", "frame").agg(F.max(lat).alias("lat"), F.max(lon).alias("lon"))
    rows = t.where("pos % 3 = 2").selectExpr("video", "frame", "pos", "33e0 + pos % 10 AS lat", "134e0 AS lon")
    return restore.looked_up(t.where("frame is not null").select("video", "frame").distinct(), one(0, "latitude", "longitude"), one(1, "point_y", "point_x"), rows)


@query(PLACED_SQL + " SELECT pos, CASE WHEN coalesce(aligned_latitude, latitude) IS NOT NULL AND aligned_longitude IS NOT NULL THEN 'first' WHEN point_y IS NOT NULL AND longitude IS NOT NULL THEN 'snapshot_payload' END AS source,"
       " CASE WHEN coalesce(aligned_latitude, latitude) IS NOT NULL AND aligned_longitude IS NOT NULL THEN coalesce(aligned_latitude, latitude) WHEN point_y IS NOT NULL AND longitude IS NOT NULL THEN point_y END AS lat FROM t")  # fmt: skip
def join_snapshot_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("double")
    at = restore.snapshot_position((c("aligned_latitude"), c("latitude"), c("aligned_longitude"), none, F.lit("first")), (c("point_y"), none, none, c("longitude"), F.lit(None).cast("string")))
    return placed(spark, sf_dir).select("pos", at.alias("at")).select("pos", "at.source", "at.lat")


OPENED = with_("markings", "candidates") + """, v AS (SELECT DISTINCT concat('v', user_id % 30) AS video FROM events), l AS (SELECT concat('v', user_id % 25) AS video, min(event_id % 53) AS f FROM events GROUP BY 1),
m AS (SELECT video, min(frame) AS f FROM markings WHERE CAST(substr(video, 2) AS INTEGER) < 6 GROUP BY video), d AS (SELECT video, min(frame) AS f FROM candidates GROUP BY video)
SELECT v.video, coalesce(m.f, d.f, l.f) AS first_frame, CASE WHEN m.f IS NOT NULL THEN 'marking' WHEN d.f IS NOT NULL THEN 'detect' WHEN l.f IS NOT NULL THEN 'layer' END AS mode
FROM v LEFT JOIN m ON m.video = v.video LEFT JOIN d ON d.video = v.video LEFT JOIN l ON l.video = v.video"""


@query(OPENED)
def api_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    listed = e.selectExpr("concat('v', user_id % 25) AS video", "event_id % 53 AS frame")
    picked = fixtures.markings(spark, sf_dir).where("CAST(substr(video, 2) AS INT) < 6")
    return restore.opened_sessions(e.selectExpr("concat('v', user_id % 30) AS video").distinct(), picked, fixtures.candidates(spark, sf_dir), listed)


# project tables

LAYER_LIST = (
    "p_partkey % 40 AS project, concat('L', p_partkey) AS layer_id, p_partkey AS place,"
    " CASE p_partkey % 7 WHEN 0 THEN '360 Markings' WHEN 1 THEN '360 Detection Candidates: x' WHEN 2 THEN 'POI: All_Classes' WHEN 3 THEN 'roads' WHEN 4 THEN '360 click targets old' WHEN 6 THEN 'poi_clusters_pole' END AS name,"
    " CASE p_partkey % 5 WHEN 0 THEN '/a/tmp.gpkg|layername=markings_360' WHEN 1 THEN '/a/tmp.gpkg|layername=poi_candidates_360' WHEN 2 THEN 'memory' WHEN 4 THEN '/b/ALL_CLASSES.gpkg' END AS source,"
    " CASE p_partkey % 6 WHEN 0 THEN ['frame', 'target_id', 'video'] WHEN 1 THEN ['frame', 'target_yaw', 'target_pitch', 'semantic_class'] WHEN 2 THEN ['frame', 'latitude'] WHEN 3 THEN ['frame', 'target_id', 'target_yaw', 'target_pitch', 'candidate_id'] WHEN 4 THEN ['geom'] ELSE ['frame', 'target_yaw', 'target_pitch'] END AS \"columns\","
    " CASE p_partkey % 9 WHEN 0 THEN concat('semantic_class  = ', chr(39), p_brand, chr(39)) WHEN 1 THEN concat('semantic_class=', chr(34), 'a b', chr(34)) WHEN 2 THEN concat('semantic_class like ', chr(39), 'pole%', chr(39))"
    " WHEN 3 THEN concat('x > 1 AND semantic_class IN (', chr(39), 'b', chr(39), ', ', chr(39), 'a', chr(39), ', ', chr(39), 'b', chr(39), ')') WHEN 4 THEN ' ' WHEN 5 THEN concat('semantic_class=', chr(39), '  ', chr(39), ' OR semantic_class LIKE ', chr(39), 'z', chr(39)) END AS subset,"
    " CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS visible, CASE WHEN p_partkey % 8 = 0 THEN [1, 3] WHEN p_partkey % 8 = 1 THEN [5] END AS selected, p_partkey % 10 = 3 AS memory, p_partkey % 11 = 1 AS active"
)
CATEGORIES = "CASE p_partkey % 4 WHEN 0 THEN {a}{s}'pole', true), {s}'tree', false){z} WHEN 1 THEN {a}{s}'pole', true), {s}'All_Classes', true){z} WHEN 2 THEN {a}{s}'x', true), {s}'y', true){z} END"
DUCK_CATEGORIES = "CASE p_partkey % 4 WHEN 0 THEN [{'value': 'pole', 'enabled': true}, {'value': 'tree', 'enabled': false}] WHEN 1 THEN [{'value': 'pole', 'enabled': true}, {'value': 'All_Classes', 'enabled': true}] WHEN 2 THEN [{'value': 'x', 'enabled': true}, {'value': 'y', 'enabled': true}] END"
SPARK_CATEGORIES = CATEGORIES.format(a="array(", z=")", s="named_struct('value', ").replace(", true)", ", 'enabled', true)").replace(", false)", ", 'enabled', false)")
CANDIDATE_SQL = "list_contains(\"columns\", 'frame') AND list_contains(\"columns\", 'target_yaw') AND list_contains(\"columns\", 'target_pitch') AND list_has_any(\"columns\", ['semantic_class', 'candidate_id', 'evidence_face', 'detection_id'])"
LAYERS_SQL = f"""WITH t AS (SELECT {LAYER_LIST}, {DUCK_CATEGORIES} AS categories FROM part), lay AS (
  SELECT *, lower(coalesce(name, '') || chr(10) || coalesce(source, '')) AS txt, list_contains("columns", 'frame') AND NOT list_contains("columns", 'target_id') AS is_frame, list_contains("columns", 'frame') AND list_contains("columns", 'target_id') AS is_marking, {CANDIDATE_SQL} AS is_candidate FROM t
), roles AS (SELECT *, is_candidate AND contains(txt, 'all_classes') AS is_all_classes, is_marking AND NOT is_candidate AND regexp_matches(txt, '360 markings|360 click targets|markings_360|click_targets_360') AS is_named_marking,
  is_candidate AND regexp_matches(txt, '360 detection candidates|360 poi clusters|all_classes|poi_candidates|poi_clusters') AS is_named_candidate FROM lay
), cand AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY coalesce(place = own, false) DESC, place DESC) AS turn FROM (SELECT *, max(CASE WHEN memory THEN place END) OVER (PARTITION BY project) AS own FROM roles WHERE is_candidate))"""


def layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [x.replace("[", "array(").replace("]", ")") for x in split_columns(LAYER_LIST)]
    return table(spark, sf_dir, "part").selectExpr(*columns, f"{SPARK_CATEGORIES} AS categories")


@query(LAYERS_SQL + " SELECT layer_id, is_frame, is_marking, is_candidate, is_all_classes, is_named_marking, is_named_candidate, coalesce(visible, true) AS shown FROM roles")
def proj_layer_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by columns, by names, and visibility."""
    rows = layers.with_roles(layer_table(spark, sf_dir))
    return rows.select("layer_id", "is_frame", "is_marking", "is_candidate", "is_all_classes", "is_named_marking", "is_named_candidate", layers.is_visible(F.col("visible")).alias("shown"))


SUBSET = (
    "CASE WHEN trim(regexp_extract({0}, '(?i)semantic_class\\s*=\\s*[''\"]([^''\"]+)[''\"]', 1)) <> '' THEN [trim(regexp_extract({0}, '(?i)semantic_class\\s*=\\s*[''\"]([^''\"]+)[''\"]', 1))]"
    " WHEN trim(regexp_extract({0}, '(?i)semantic_class\\s+LIKE\\s*[''\"]([^''\"]+)[''\"]', 1)) <> '' THEN [trim(regexp_extract({0}, '(?i)semantic_class\\s+LIKE\\s*[''\"]([^''\"]+)[''\"]', 1))]"
    " ELSE list_filter(list_transform(regexp_extract_all(regexp_extract({0}, '(?i)semantic_class\\s+IN\\s*\\(([^)]+)\\)', 1), '[''\"]([^''\"]+)[''\"]', 1), lambda x: trim(x)), lambda x: x <> '') END"
).format("coalesce(subset, '')")
ENABLED = "list_filter(list_transform(list_filter(coalesce(categories, []), lambda c: c.enabled), lambda c: c.value), lambda v: v <> '' AND lower(v) <> 'all_classes')"


@query(LAYERS_SQL + f", f AS (SELECT layer_id, list_sort(list_distinct({SUBSET})) AS fromtext, {ENABLED} AS en, categories FROM roles)"
       " SELECT layer_id, array_to_string(fromtext, '|') AS subset_classes, array_to_string(list_sort(list_distinct(list_concat(fromtext, CASE WHEN len(en) > 0 AND len(en) < len(categories) THEN en ELSE [] END))), '|') AS active FROM f")  # fmt: skip
def pred_active_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that a filter text names, and their union with the enabled categories."""
    rows = layer_table(spark, sf_dir)
    shown = lambda a: F.array_join(a, "|")
    return rows.select("layer_id", shown(layers.subset_classes(F.col("subset"))).alias("subset_classes"), shown(layers.active_classes(F.col("subset"), F.col("categories"))).alias("active"))


ROWS_SQL = ", rws AS (SELECT p_partkey % 40 AS project, concat('L', p_partkey) AS layer_id, k AS row_id, p_partkey * 10 + k AS pos, (p_partkey * 7 + k) % 9 AS frame, CASE WHEN k % 3 <> 2 THEN concat('m', p_size % 4) END AS model_name FROM part, (SELECT unnest(range(0, 6)) AS k))"


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return rows.selectExpr("p_partkey % 40 AS project", "concat('L', p_partkey) AS layer_id", "k AS row_id", "p_partkey * 10 + k AS pos", "(p_partkey * 7 + k) % 9 AS frame", "CASE WHEN k % 3 <> 2 THEN concat('m', p_size % 4) END AS model_name")


SCOPES = {"visible": "coalesce(c.visible, true)", "all": "true", "active": "c.active", "selected": "list_contains(c.selected, r.row_id)"}


@query(LAYERS_SQL + ROWS_SQL + " " + " UNION ALL ".join(f"SELECT '{s}' AS scope, c.project, count(*) AS n, CAST(sum(r.pos) AS BIGINT) AS sum_pos FROM rws r JOIN cand c ON c.layer_id = r.layer_id WHERE {t} GROUP BY c.project" for s, t in SCOPES.items()))
def pred_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each scope reads, selected rows among them."""
    tables, rows = layer_table(spark, sf_dir), layer_rows(spark, sf_dir)
    one = lambda s: layers.in_scope(tables, rows, s).groupBy("project").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos")).select(F.lit(s).alias("scope"), "project", "n", "sum_pos")
    found = [one(s) for s in SCOPES]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(LAYERS_SQL + """, fr AS (SELECT project, layer_id, row_number() OVER (PARTITION BY project ORDER BY memory DESC, place DESC) AS k FROM roles WHERE is_frame AND (memory OR active)),
ma AS (SELECT project, layer_id, row_number() OVER (PARTITION BY project ORDER BY coalesce(place = own, false) DESC, place DESC) AS k FROM (SELECT *, max(CASE WHEN memory THEN place END) OVER (PARTITION BY project) AS own FROM roles WHERE is_marking AND NOT is_candidate) WHERE coalesce(place = own, false) OR is_named_marking),
de AS (SELECT project, layer_id, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN len(selected) > 0 THEN 0 WHEN coalesce(trim(subset), '') <> '' THEN 1 WHEN active THEN 2 WHEN is_all_classes THEN 3 ELSE 4 END, turn) AS k FROM cand),
ask AS (SELECT project, mode FROM (SELECT DISTINCT project FROM t), (SELECT unnest(['frame', ' KP ', 'picked', 'detect', 'other']) AS mode))
SELECT a.project, a.mode, coalesce(fr.layer_id, ma.layer_id, de.layer_id) AS layer_id FROM ask a LEFT JOIN fr ON fr.project = a.project AND fr.k = 1 AND lower(trim(a.mode)) IN ('frame', 'kp') LEFT JOIN ma ON ma.project = a.project AND ma.k = 1 AND a.mode = 'picked' LEFT JOIN de ON de.project = a.project AND de.k = 1 AND a.mode = 'detect'""")
def proj_pick_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = layer_table(spark, sf_dir)
    asked = tables.select("project").distinct().withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("frame", " KP ", "picked", "detect", "other")])))
    return layers.preferred_layer(asked, tables)


@query(LAYERS_SQL + ROWS_SQL + " SELECT project, frame, layer_id, pos FROM (SELECT r.*, row_number() OVER (PARTITION BY r.project, r.frame ORDER BY c.turn, r.pos) AS k FROM rws r JOIN cand c ON c.layer_id = r.layer_id) WHERE k = 1")
def set_union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = layers.candidate_layers(layer_table(spark, sf_dir))
    return frames.union_by_turn(read, layer_rows(spark, sf_dir), ("project", "frame")).select("project", "frame", "layer_id", "pos")


@query(LAYERS_SQL + ROWS_SQL + ", nm AS (SELECT r.project, r.model_name AS name, min(struct_pack(a := c.turn, b := r.pos)) AS spot FROM rws r JOIN cand c ON c.layer_id = r.layer_id WHERE trim(r.model_name) <> '' GROUP BY 1, 2) SELECT project, array_to_string(list(name ORDER BY name), '|') AS names FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY spot) AS k FROM nm) WHERE k <= 2 GROUP BY project")
def agg_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layer_rows(spark, sf_dir).join(layers.candidate_layers(layer_table(spark, sf_dir)).select("layer_id", "turn").hint("merge"), "layer_id")
    return layers.model_names(rows).select("project", F.array_join("names", "|").alias("names"))


@query(LAYERS_SQL + ROWS_SQL + ", ask AS (SELECT layer_id, CASE WHEN place % 3 = 0 THEN '' ELSE concat('v', place % 5) END AS video, CASE WHEN place % 4 <> 0 THEN place % 9 END AS frame FROM roles), vr AS (SELECT layer_id, CASE WHEN pos % 4 = 0 THEN NULL ELSE concat('v', pos % 5) END AS video, frame FROM rws WHERE pos % 7 < 4)"
       " SELECT a.layer_id, a.video, a.frame, a.video = '' OR EXISTS (SELECT 1 FROM vr WHERE vr.layer_id = a.layer_id AND (coalesce(vr.video, '') = '' OR vr.video = a.video) AND (a.frame IS NULL OR vr.frame = a.frame)) AS found FROM ask a")  # fmt: skip
def agg_has_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = layer_table(spark, sf_dir).selectExpr("layer_id", "CASE WHEN place % 3 = 0 THEN '' ELSE concat('v', place % 5) END AS video", "CASE WHEN place % 4 <> 0 THEN place % 9 END AS frame")
    rows = layer_rows(spark, sf_dir).where("pos % 7 < 4").selectExpr("layer_id", "CASE WHEN pos % 4 = 0 THEN NULL ELSE concat('v', pos % 5) END AS video", "frame")
    return frames.has_any(asked, rows)




def safe_sql(x: str) -> str:
    plain = f"lower(regexp_replace(regexp_replace({x}, '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    named = f"CASE WHEN {plain} = '' THEN 'video_gpx_points' ELSE {plain} END"
    return f"left(CASE WHEN regexp_matches({named}, '^[0-9]') THEN 'layer_' || {named} ELSE {named} END, 63)"


@query(LAYERS_SQL + f""" SELECT layer_id, CASE WHEN is_candidate THEN CASE WHEN place % 3 = 0 THEN 'poi_clusters_pole' WHEN starts_with(name, '360 Detection Candidates: ') THEN {safe_sql("substr(name, 27)")} WHEN starts_with(name, 'POI: ') THEN {safe_sql("substr(name, 6)")}
  WHEN regexp_matches(name, '^poi_(candidates|clusters)') THEN {safe_sql('name')} ELSE 'poi_candidates_360' END WHEN is_marking THEN 'markings_360' WHEN is_frame THEN 'video_gpx_points' ELSE {safe_sql("printf('%s_%02d', 'My Layer', place)")} END AS saved FROM roles""")
def sink_backup_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers.with_roles(layer_table(spark, sf_dir))
    single = F.when(F.col("is_candidate") & (F.col("place") % 3 == 0), "pole")
    return rows.select("layer_id", layers.backup_name(F.col("name"), F.col("columns"), single, F.lit("My Layer"), F.col("place"), text.safe_layer).alias("saved"))


# frames, classes, values


@query(with_("markings") + " SELECT DISTINCT video, frame FROM markings")
def agg_distinct_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.distinct_frames(fixtures.markings(spark, sf_dir))


@query(LAYERS_SQL + ROWS_SQL + " SELECT project, count(*) AS features, count(DISTINCT layer_id) AS layers FROM rws GROUP BY project")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.feature_counts(layer_rows(spark, sf_dir), ("project",))


@query("WITH t AS (SELECT p_brand, list_sort(list(DISTINCT CASE WHEN p_size % 5 < 2 THEN 'pole' ELSE CASE WHEN p_partkey % 90 = 0 THEN p_type END END) FILTER (WHERE p_size % 5 < 2 OR p_partkey % 90 = 0)) AS cl FROM part GROUP BY p_brand)"
       " SELECT p_brand, CASE WHEN len(cl) = 1 THEN cl[1] ELSE 'tail' END AS value FROM t")  # fmt: skip
def agg_single_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_brand", "CASE WHEN p_size % 5 < 2 THEN 'pole' WHEN p_partkey % 90 = 0 THEN p_type END AS semantic_class")
    found = rows.select("p_brand").distinct().join(frames.sorted_classes(rows, ("p_brand",)), "p_brand", "left")
    return found.select("p_brand", frames.inferred_class(F.coalesce("classes", F.array().cast("array<string>")), F.lit(" "), F.concat("p_brand", F.lit(": tail ")), F.lit(None).cast("string")).alias("value"))


@query("SELECT user_id % 50 AS video, arg_min(trim(event_type), event_id) AS value FROM events WHERE event_id % 3 = 0 AND trim(event_type) <> '' GROUP BY 1")
def agg_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 50 AS video", "CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' END AS v", "event_id AS pos")
    return frames.first_value(rows, "v")


QUALITY = "CASE event_id % 5 WHEN 0 THEN 'trusted' WHEN 1 THEN 'odd' WHEN 2 THEN '' END"


@query(f"WITH t AS (SELECT user_id % 50 AS video, coalesce(nullif({QUALITY}, ''), CASE WHEN d <= 5 THEN 'trusted' WHEN d <= 10 THEN 'usable' ELSE 'far' END) AS q FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_id % 15 * 1e0 END AS d FROM events)), c AS (SELECT video, count(*) FILTER (q = 'trusted') AS a, count(*) FILTER (q = 'usable') AS b, count(*) FILTER (q NOT IN ('trusted', 'usable')) AS c FROM t GROUP BY video)"
       " SELECT video, 'trusted' AS quality, a AS n FROM c UNION ALL SELECT video, 'usable', b FROM c UNION ALL SELECT video, 'far', c FROM c")  # fmt: skip
def agg_quality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 50 AS video", f"{QUALITY} AS quality", "CASE WHEN event_id % 7 <> 0 THEN event_id % 15 * 1e0 END AS distance_m")
    return frames.quality_groups(rows, ("video",))


# navigation

NAV = (
    "event_id, concat('v', user_id % 20) AS video, event_id * 5 % 120 AS frame, CASE event_id % 6 WHEN 0 THEN 'frame' WHEN 1 THEN 'KP' WHEN 2 THEN 'marking' WHEN 3 THEN ' picked' WHEN 4 THEN 'detect' END AS mode, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction,"
    " event_id % 3 = 0 AS fast, event_id % 4 AS step, 30 AS fast_step, CASE WHEN event_id % 9 <> 0 THEN 100 + user_id % 20 END AS frame_count"
)
LISTED_SQL = "SELECT video, frame, CASE pos % 4 WHEN 0 THEN 'kp' WHEN 1 THEN 'marking' WHEN 2 THEN 'detect' ELSE 'layer' END AS mode FROM markings WHERE NOT (pos % 4 = 0 AND CAST(substr(video, 2) AS INTEGER) % 3 = 0)"
NAV_SQL = with_("markings") + f""", ask AS (SELECT {NAV} FROM events), l AS (SELECT video, mode, list(DISTINCT frame) AS fs FROM ({LISTED_SQL}) GROUP BY video, mode),
k AS (SELECT *, CASE WHEN mode = 'frame' THEN 'frame' WHEN lower(mode) = 'kp' THEN 'kp' WHEN trim(mode) IN ('marking', 'picked') THEN 'marking' WHEN mode = 'detect' THEN 'detect' ELSE 'layer' END AS kind, CASE WHEN fast THEN fast_step ELSE step END AS cnt FROM ask),
j AS (SELECT k.*, l.fs, CASE WHEN kind IN ('marking', 'detect') THEN CASE WHEN fast THEN 1 END WHEN kind <> 'frame' THEN greatest(1, cnt) END AS jump FROM k LEFT JOIN l ON l.video = k.video AND l.mode = k.kind),
g AS (SELECT *, CASE WHEN direction > 0 THEN list_sort(list_filter(fs, lambda x: x > frame)) ELSE list_reverse_sort(list_filter(fs, lambda x: x < frame)) END AS way, greatest(0, frame + cnt * direction) AS moved FROM j)
SELECT event_id, CASE WHEN jump IS NULL OR (kind = 'kp' AND fs IS NULL) THEN CASE WHEN cnt * direction > 0 AND frame_count IS NOT NULL AND frame >= frame_count - 1 THEN NULL ELSE CASE WHEN frame_count IS NULL THEN moved ELSE least(moved, frame_count - 1) END END
  WHEN len(way) > 0 THEN way[least(len(way), jump)] END AS target FROM g"""


@query(NAV_SQL)
def win_nav_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").selectExpr(*split_columns(NAV))
    listed = fixtures.markings(spark, sf_dir).where("NOT (pos % 4 = 0 AND CAST(substr(video, 2) AS INT) % 3 = 0)").selectExpr("video", "frame", "CASE pos % 4 WHEN 0 THEN 'kp' WHEN 1 THEN 'marking' WHEN 2 THEN 'detect' ELSE 'layer' END AS mode")
    return navigate.dispatch(asked, listed).select("event_id", "target")


@query(TARGET_SQL.replace("SELECT pos, tid AS id", ", d AS (SELECT video, frame, pos, tid AS id", 1) + f') SELECT video, frame, pos, CAST(row_number() OVER (PARTITION BY video, frame ORDER BY "order", id, pos) AS INTEGER) AS place FROM d')
def sort_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore.marking_targets(marks(spark, sf_dir), F.col("pos") % 5)
    return review.sorted_markings(rows).select("video", "frame", "pos", "place")


@query(TARGET_SQL.replace("SELECT pos, tid AS id", ", d AS (SELECT video, frame, pos, tid AS id", 1) + ') SELECT video, frame, view_yaw_to_camera_heading AS yaw, view_pitch AS pitch, view_zoom AS zoom FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY "order" DESC, id DESC, pos DESC) AS k FROM d) WHERE k = 1')
def topk_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.last_view(restore.marking_targets(marks(spark, sf_dir), F.col("pos") % 5))


# schemas


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS video, CAST(NULL AS BIGINT) AS frame, s_acctbal AS view_zoom FROM supplier")
def proj_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with one of the marking columns gets the others, as nulls."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("view_zoom"))
    return layers.migrated(rows).select("s_suppkey", "video", "frame", "view_zoom")


@query("SELECT s_suppkey, s_name FROM supplier")
def proj_drop_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.without_row_ids(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("FID"), F.col("s_acctbal").alias("ogc_fid")))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN 'x' END AS DOUBLE) AS size, CAST(NULL AS BIGINT) AS absent FROM part")
def proj_safe_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) WHEN p_size % 3 = 1 THEN 'x' END AS SIZE")
    return layers.safe_columns(rows, {"p_partkey": "bigint", "size": "double", "absent": "bigint"})


# geometry


GROUND_SQL = """WITH s AS (SELECT s_suppkey, (s_suppkey * 13 % 360) * 1e0 AS az, 100e0 + s_suppkey * 37 % 600 AS sx, 100e0 + s_suppkey * 53 % 400 AS sy, (s_suppkey * 13 % 360) * 1e0 + s_suppkey % 41 - 20 AS yaw, (s_suppkey % 50) * 1e0 AS pitch, 5e0 + s_suppkey % 60 AS most FROM supplier),
v AS (SELECT *, degrees(atan(tan(radians(45e0)) * (600e0 / 800e0))) * 2 AS vf, (most - 0.05e0) / 360 AS step FROM s),
c AS (SELECT *, unnest(range(0, 361)) AS k FROM v), cm AS (SELECT *, 0.05e0 + step * k AS m FROM c),
ca AS (SELECT *, m * sin(radians(az)) * cos(radians(-yaw)) + m * cos(radians(az)) * sin(radians(-yaw)) AS x1, m * cos(radians(az)) * cos(radians(-yaw)) - m * sin(radians(az)) * sin(radians(-yaw)) AS z1 FROM cm),
cb AS (SELECT *, -1.5e0 * cos(radians(pitch)) + z1 * sin(radians(pitch)) AS y2, z1 * cos(radians(pitch)) - (-1.5e0) * sin(radians(pitch)) AS z2 FROM ca),
cc AS (SELECT *, x1 / z2 / tan(radians(45e0)) AS nx, -y2 / z2 / tan(radians(vf / 2)) AS ny FROM cb), ce AS (SELECT *, pow((nx + 1) / 2 * 800 - sx, 2) + pow((ny + 1) / 2 * 600 - sy, 2) AS err FROM cc WHERE z2 > 0.01 AND abs(nx) <= 2.2 AND abs(ny) <= 2.2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY err, k) AS rn FROM ce) WHERE rn = 1),
r AS (SELECT s_suppkey, az, sx, sy, yaw, pitch, vf, most, step, m AS m0, err AS e0, greatest(0.05e0, m - step) AS low, least(most, m + step) AS high, unnest(range(0, 41)) AS k FROM b), rm AS (SELECT *, low + (high - low) / 40 * k AS m FROM r),
ra AS (SELECT *, m * sin(radians(az)) * cos(radians(-yaw)) + m * cos(radians(az)) * sin(radians(-yaw)) AS x1, m * cos(radians(az)) * cos(radians(-yaw)) - m * sin(radians(az)) * sin(radians(-yaw)) AS z1 FROM rm),
rb AS (SELECT *, -1.5e0 * cos(radians(pitch)) + z1 * sin(radians(pitch)) AS y2, z1 * cos(radians(pitch)) - (-1.5e0) * sin(radians(pitch)) AS z2 FROM ra),
rc AS (SELECT *, x1 / z2 / tan(radians(45e0)) AS nx, -y2 / z2 / tan(radians(vf / 2)) AS ny FROM rb), re AS (SELECT *, CASE WHEN z2 > 0.01 AND abs(nx) <= 2.2 AND abs(ny) <= 2.2 THEN pow((nx + 1) / 2 * 800 - sx, 2) + pow((ny + 1) / 2 * 600 - sy, 2) END AS err FROM rc),
f AS (SELECT s_suppkey, any_value(m0) AS m0, any_value(e0) AS e0, min(err) AS err, arg_min(m, err) AS m FROM re GROUP BY s_suppkey)
SELECT s.s_suppkey, floor(CASE WHEN least(e0, coalesce(err, e0)) <= 6400 THEN CASE WHEN err < e0 THEN m ELSE m0 END END * 1e3 + 0.5) / 1e3 AS metres FROM s LEFT JOIN f ON f.s_suppkey = s.s_suppkey"""


@query(GROUND_SQL)
def geo_ground_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("s_suppkey")
    az = (r * 13 % 360).cast("double")
    found = geo.ground_distance(az, F.lit(100.0) + r * 37 % 600, F.lit(100.0) + r * 53 % 400, F.lit(1.5), az + r % 41 - 20, (r % 50).cast("double"), F.lit(90.0), F.lit(800.0), F.lit(600.0), F.lit(5.0) + r % 60)
    return dealt(table(spark, sf_dir, "supplier").select(r), "s_suppkey").select(r, fixed(found, 3).alias("metres"))


@query("WITH t AS (SELECT p_partkey, p_size / 50e0 AS xr, (50 - p_size) / 40e0 AS yr, p_partkey % 720 - 100e0 AS yaw, p_partkey % 181 - 90e0 AS pitch, greatest(1e0, least(179e0, 90e0 / greatest(CASE WHEN p_size % 7 = 0 THEN 1e0 ELSE p_size / 9e0 END, 0.01e0))) AS fh FROM part),"
       " u AS (SELECT *, greatest(1e0, least(179e0, degrees(atan(tan(radians(fh / 2)) * (600e0 / 800e0))) * 2)) AS fv FROM t), d AS (SELECT *, degrees(atan((greatest(0e0, least(1e0, xr)) - 0.5) * 2 * tan(radians(fh / 2)))) AS yd, -degrees(atan((greatest(0e0, least(1e0, yr)) - 0.5) * 2 * tan(radians(fv / 2)))) AS pd FROM u)"
       f" SELECT p_partkey, {rounded(signed('yd'))} AS yaw_delta, {rounded('pd')} AS pitch_delta, {rounded(mod('yaw + yd'), '1e4')} AS yaw, {rounded('greatest(-90e0, least(90e0, pitch + pd))')} AS pitch FROM d")  # fmt: skip
def geo_click_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    view = geo.click_view(c("p_size") / 50.0, (50 - c("p_size")) / 40.0, c("p_partkey") % 720 - 100.0, c("p_partkey") % 181 - 90.0, F.when(c("p_size") % 7 != 0, c("p_size") / 9.0), F.lit(800.0), F.lit(600.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", view.alias("v"))
    return rows.select("p_partkey", *[fixed(c(f"v.{n}"), k).alias(n) for n, k in (("yaw_delta", 6), ("pitch_delta", 6), ("yaw", 4), ("pitch", 6))])


HUD_SQL = """WITH t AS (SELECT p_partkey, p_size * 1e0 AS r, CASE WHEN p_size % 9 <> 0 THEN p_size * 2e0 ELSE 0e0 END AS o, p_size / 2e0 AS s, CASE WHEN p_partkey % 5 <> 0 THEN 90e0 ELSE 0e0 END AS v, CASE WHEN p_partkey % 4 <> 0 THEN 5e0 ELSE 0e0 END AS d, p_size % 6 / 4e0 AS z, CASE WHEN p_partkey % 3 = 0 THEN p_size / 3e0 END AS g FROM part),
m AS (SELECT *, CASE WHEN z = 0 THEN 1e0 ELSE greatest(z, 0.01e0) END AS zz FROM t), w AS (SELECT *, greatest(0.25e0, least(8e0, CASE WHEN v > 0 THEN v / (90e0 / zz) ELSE zz END)) AS wide, CASE WHEN d > 0 THEN d ELSE r END AS base FROM m),
x AS (SELECT p_partkey, o, greatest(4e0, least(100e0, o / base * s * wide)) AS outer_, greatest(2e0, least(100e0, r / base * s * wide)) AS inner_, greatest(2e0, least(100e0, coalesce(CASE WHEN g > 0 THEN g END, r) / base * s * wide)) AS marker FROM w)
SELECT p_partkey, CASE WHEN o > 0 THEN floor(outer_ * 1e6 + 0.5) / 1e6 END AS "outer", CASE WHEN o > 0 THEN floor(inner_ * 1e6 + 0.5) / 1e6 END AS "inner", CASE WHEN o > 0 THEN floor(marker * 1e6 + 0.5) / 1e6 END AS marker, CASE WHEN o > 0 THEN floor(greatest(12e0, least(96e0, greatest(4e0, least(104e0, 104 - marker)) - 8)) * 1e6 + 0.5) / 1e6 END AS label_y FROM x"""


@query(HUD_SQL)
def geo_hud(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size * 1e0 AS r", "CASE WHEN p_size % 9 <> 0 THEN p_size * 2e0 ELSE 0e0 END AS o", "p_size / 2e0 AS s", "CASE WHEN p_partkey % 5 <> 0 THEN 90e0 ELSE 0e0 END AS v",
        "CASE WHEN p_partkey % 4 <> 0 THEN 5e0 ELSE 0e0 END AS d", "p_size % 6 / 4e0 AS z", "CASE WHEN p_partkey % 3 = 0 THEN p_size / 3e0 END AS g",
    )
    c = F.col
    radii = geo.hud_radii(c("r"), c("o"), c("s"), c("v"), c("d"), F.lit(1.0), c("z"), c("g"), F.lit(0.25), F.lit(8.0))
    return rows.select("p_partkey", radii.alias("h")).select("p_partkey", *[fixed(c(f"h.{n}"), 6).alias(n) for n in ("outer", "inner", "marker", "label_y")])


@query("SELECT p_partkey, p_size * 2e0 AS outer_range_m, (p_size % 7 + 1e0) * (p_size % 3 + 0.5e0) AS base_sector_radius_m, 1e0 AS min_sector_radius_m FROM part")
def geo_hud_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_size")
    found = geo.hud_payload(c * 1.0, F.lit(90.0), c % 7 + 1.0, c % 3 + 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("h")).select("p_partkey", "h.outer_range_m", "h.base_sector_radius_m", "h.min_sector_radius_m")


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {signed('(event_id * 7 % 360) - (event_id % 360) - (event_id * 11 % 360)')} WHEN event_id % 4 <> 0 THEN {signed('(event_id * 5 % 360) - (event_id % 360) - (event_id * 3 % 360)')} END AS value FROM events")
def geo_offset_from_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    one = lambda test, a, b: F.struct(F.when(test, (e * a % 360).cast("double")).alias("map_bearing"), (e * b % 360).cast("double").alias("yaw"))
    targets = F.array(one(e % 3 == 0, 7, 11), one(e % 4 != 0, 5, 3))
    return table(spark, sf_dir, "events").select("event_id", geo.offset_from_targets((e % 360).cast("double"), targets).alias("value"))


@query("WITH t AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN concat('v', event_id % 3) ELSE '' END AS a, CASE WHEN event_id % 5 <> 0 THEN concat('v', event_id % 2) END AS b, CASE WHEN event_id % 6 <> 0 THEN event_id % 30 / 5e0 END AS z FROM events)"
       " SELECT event_id, CASE WHEN (a = '' OR b IS NULL OR a = b) AND z IS NOT NULL THEN greatest(1e0, least(179e0, 90e0 / greatest(CASE WHEN z = 0 THEN 1e0 ELSE z END, 0.01e0))) END AS value FROM t")  # fmt: skip
def geo_current_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 4 <> 0 THEN concat('v', event_id % 3) ELSE '' END AS a", "CASE WHEN event_id % 5 <> 0 THEN concat('v', event_id % 2) END AS b", "CASE WHEN event_id % 6 <> 0 THEN event_id % 30 / 5e0 END AS z")
    return rows.select("event_id", geo.current_fov(F.col("a"), F.col("b"), F.col("z")).alias("value"))


# texts and times


def scalar(name: str, of: str, key: str, column: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, of).select(key, column().alias("value"))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"SELECT {key}, {sql} AS value FROM {of}"


LAYER = "CASE p_partkey % 7 WHEN 0 THEN 'poi_candidates_360' WHEN 1 THEN 'All_classes' WHEN 2 THEN 'poi_clusters_x' WHEN 3 THEN 'poi_candidates_y' WHEN 4 THEN ' roads ' WHEN 5 THEN '' END"
OWN = "CASE p_partkey % 5 WHEN 0 THEN '360 POI Clusters: pole ' WHEN 1 THEN '360 POI Clusters:' WHEN 2 THEN 'mine' END"
PLAIN_SQL = f"CASE WHEN coalesce(trim({LAYER}), '') IN ('', 'poi_candidates_360') THEN '360 Detection Candidates' WHEN lower(trim({LAYER})) = 'all_classes' THEN 'POI: All_Classes' WHEN starts_with(trim({LAYER}), 'poi_clusters') THEN 'POI: ' || trim({LAYER}) ELSE '360 Detection Candidates: ' || trim({LAYER}) END"
scalar("str_display_name", "part", "p_partkey", lambda: text.display_name(F.expr(LAYER), F.expr(OWN)), f"CASE p_partkey % 5 WHEN 0 THEN 'POI: pole' WHEN 1 THEN 'POI' WHEN 2 THEN 'mine' ELSE {PLAIN_SQL} END")
scalar("str_cache_stem", "part", "p_partkey", lambda: text.cache_stem(F.expr("concat('/a b/', CASE WHEN p_partkey % 4 = 0 THEN '__' ELSE p_type END, '.mp4')")), "CASE WHEN p_partkey % 4 = 0 THEN 'video' ELSE regexp_replace(p_type, '[^0-9A-Za-z_.-]+', '_', 'g') END")
scalar("str_missing_keys", "part", "p_partkey", lambda: F.array_join(text.missing_keys(F.expr("array('c', 'a', p_brand)"), F.expr("array('a', concat('Brand#', p_size))")), "|"), "CASE WHEN p_brand = concat('Brand#', p_size) THEN 'c' ELSE p_brand || '|c' END")
scalar("set_unique_ordered", "part", "p_partkey", lambda: F.array_join(text.unique_ordered(F.expr("array(p_size % 3, 2, p_size % 2, 0, 5)").cast("array<string>")), "|"),
       "array_to_string(list_transform(list_filter(list_zip([p_size % 3, 2, p_size % 2, 0, 5], range(1, 6)), lambda t: list_position([p_size % 3, 2, p_size % 2, 0, 5], t[1]) = t[2]), lambda t: t[1]), '|')")
scalar("pred_auto_target", "part", "p_partkey", lambda: text.is_auto_target(F.expr("CASE p_size % 3 WHEN 0 THEN ' Auto_Point' WHEN 1 THEN 'user' END"), F.expr("CASE WHEN p_size % 11 = 0 THEN 'target_point' END"), F.lit(""), F.expr("CASE WHEN p_size % 13 = 0 THEN p_type END")),
       "p_size % 3 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0")
scalar("pred_same_frame", "events", "event_id", lambda: text.same_frame(F.expr("concat('v', event_id % 3)"), F.expr("CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id % 5 AS STRING) END"), F.lit("v1"), F.lit(2)), "event_id % 3 = 1 AND event_id % 5 = 2 AND event_id % 7 <> 0")
scalar("pred_frame_in_range", "part", "p_partkey", lambda: text.frame_in_range(F.expr("CASE WHEN p_partkey % 41 <> 0 THEN p_partkey % 60 - 3 END"), F.expr("CASE WHEN p_size % 10 <> 0 THEN p_size END")), "p_partkey % 41 <> 0 AND p_partkey % 60 - 3 >= 0 AND (p_size % 10 = 0 OR p_partkey % 60 - 3 < p_size)")
scalar("str_class_unalias", "part", "p_partkey", lambda: text.class_unalias(F.col("p_type"), {"eco": "ECONOMY BRASS", "pro": "PROMO TIN"}), "CASE p_type WHEN 'ECONOMY BRASS' THEN 'eco' WHEN 'PROMO TIN' THEN 'pro' ELSE p_type END")
scalar("str_format_size", "part", "p_partkey", lambda: text.format_size(F.expr("p_partkey * p_partkey * p_size")), "CASE WHEN p_partkey * p_partkey * p_size < 1024 THEN CAST(p_partkey * p_partkey * p_size AS VARCHAR) || ' B' WHEN p_partkey * p_partkey * p_size < 1048576 THEN printf('%.1f KB', floor(p_partkey * p_partkey * p_size / 1024e0 * 10 + 0.5) / 10) WHEN p_partkey * p_partkey * p_size < 1073741824 THEN printf('%.1f MB', floor(p_partkey * p_partkey * p_size / 1048576e0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(p_partkey * p_partkey * p_size / 1073741824e0 * 10 + 0.5) / 10) END")
scalar("str_format_distance", "part", "p_partkey", lambda: text.format_distance(F.expr("CASE WHEN p_size % 6 <> 0 THEN p_size / 8e0 END")), "CASE WHEN p_size % 6 <> 0 THEN printf('%.3f', p_size / 8e0) ELSE '' END")
scalar("str_format_meters", "part", "p_partkey", lambda: text.format_meters(F.expr("p_size * 1e0")), "CASE WHEN p_size >= 10 THEN printf('%.0fm', p_size * 1e0) ELSE printf('%.1fm', p_size * 1e0) END")
scalar("time_to_frame", "events", "event_id", lambda: frame_at(F.expr("event_id * 125000"), F.lit(4.0)), "CAST(round_even(event_id * 125000 / 1e6 * 4e0, 0) AS BIGINT)")
scalar("time_format", "events", "event_id", lambda: export.stamp(F.col("ts")), "strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'")
scalar("time_to_layer", "events", "event_id", lambda: times.to_layer(F.col("ts") + F.expr("INTERVAL '0.001999' SECOND")), "date_trunc('millisecond', ts + INTERVAL 1999 MICROSECOND)")
TIMES = "CASE event_id % 6 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN concat(date_format(ts, 'yyyy/MM/dd HH:mm'), ' JST') WHEN 2 THEN date_format(ts, 'yyyyMMdd HHmmss') WHEN 3 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING) WHEN 4 THEN 'not a time' ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') END"
scalar("time_parse", "events", "event_id", lambda: times.parse(F.expr(TIMES)), "CASE event_id % 6 WHEN 1 THEN date_trunc('minute', ts) - INTERVAL 9 HOUR WHEN 4 THEN NULL ELSE date_trunc('second', ts) END")
scalar("time_looks_like", "events", "event_id", lambda: times.looks_like(F.expr(TIMES)), "event_id % 6 <> 4")
scalar("time_parse_epoch", "events", "event_id", lambda: times.parse_epoch(F.expr("CASE event_id % 4 WHEN 0 THEN CAST(event_id + 1000000000 AS STRING) WHEN 1 THEN CAST((event_id + 1000000000) * 1000 + 5 AS STRING) WHEN 2 THEN concat(event_id + 1000000000, '.5') ELSE '20240101' END")),
       "CASE event_id % 4 WHEN 0 THEN CAST(to_timestamp(event_id + 1000000000) AT TIME ZONE 'UTC' AS TIMESTAMP) WHEN 1 THEN CAST(to_timestamp(event_id + 1000000000) AT TIME ZONE 'UTC' AS TIMESTAMP) + INTERVAL 5 MILLISECOND WHEN 2 THEN CAST(to_timestamp(event_id + 1000000000) AT TIME ZONE 'UTC' AS TIMESTAMP) + INTERVAL 500 MILLISECOND END")


# rules of a stream of states, over a table of them

STATE_ROWS = "event_id AS seq, ts, user_id % 20 AS video, event_id % 3 AS frame, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS n_targets, event_id % 5 = 0 AS external"
HOURS = 3_600_000_000


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*split_columns(STATE_ROWS))


@query(f"WITH t AS (SELECT {STATE_ROWS} FROM events) SELECT seq FROM (SELECT seq, epoch_us(lead(ts) OVER (PARTITION BY video ORDER BY ts, seq)) - epoch_us(ts) AS gap FROM t) WHERE gap IS NULL OR gap >= {HOURS}")
def st_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.settled(state_rows(spark, sf_dir), HOURS).select("seq")


@query(f"WITH t AS (SELECT {STATE_ROWS} FROM events) SELECT seq FROM (SELECT *, epoch_us(ts) - max(CASE WHEN external THEN epoch_us(ts) END) OVER (PARTITION BY video ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS since FROM t) WHERE external OR since IS NULL OR since >= {2 * HOURS}")
def st_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.unsuppressed(state_rows(spark, sf_dir), 2 * HOURS).select("seq")


@query(f"WITH t AS (SELECT {STATE_ROWS.replace('event_id % 3 AS frame', 'event_id % 2 AS frame')} FROM events), b AS (SELECT *, CASE WHEN n_targets > 0 OR frame IS DISTINCT FROM lag(frame) OVER w OR lag(n_targets) OVER w > 0 THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY video ORDER BY ts, seq)),"
       " r AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM b)"
       f" SELECT seq, n_targets = 0 AND epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY video, run) >= {HOURS // 2} AS cleared FROM r")  # fmt: skip
def st_clear_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.graced(state_rows(spark, sf_dir).withColumn("frame", F.col("seq") % 2), HOURS // 2).select("seq", "cleared")


# the parts of compound results that the scalar queries leave out

AT_SQL, AT2_SQL = ("(35e0 + (event_id % 1000) / 1e4)", "(136e0 + (event_id * 7 % 1000) / 1e4)"), ("(35e0 + (event_id * 3 % 1000) / 1e4)", "(136e0 + (event_id * 11 % 1000) / 1e4)")
TURN_SQL, ARC_SQL = "radians(event_id * 53 % 777)", "(event_id * 53 % 777 / 7e0 / 6378137e0)"
SINE_SQL = f"(sin(radians({AT_SQL[0]})) * cos({ARC_SQL}) + cos(radians({AT_SQL[0]})) * sin({ARC_SQL}) * cos({TURN_SQL}))"
LON_SQL = f"degrees(radians({AT_SQL[1]}) + atan2(sin({TURN_SQL}) * sin({ARC_SQL}) * cos(radians({AT_SQL[0]})), cos({ARC_SQL}) - sin(radians({AT_SQL[0]})) * {SINE_SQL}))"


def at(pair: tuple[str, str]) -> list[Column]:
    return [F.expr(x) for x in pair]


def angle() -> Column:
    return F.expr("CAST(event_id * 53 % 777 AS DOUBLE)")


scalar("geo_destination_lon", "events", "event_id", lambda: fixed(geo.destination(*at(AT_SQL), angle(), angle() / 7)["lon"], 6), rounded(LON_SQL))
scalar("geo_local_vector_north", "events", "event_id", lambda: fixed(geo.local_vector(*at(AT_SQL), *at(AT2_SQL))[1], 3), rounded(f"radians({AT2_SQL[0]} - {AT_SQL[0]}) * 6378137e0", "1e3"))
scalar("geo_dms_minutes", "events", "event_id", lambda: geo.dms(at(AT_SQL)[0])[1]["num"], f"CAST(floor(({AT_SQL[0]} - floor({AT_SQL[0]})) * 60) AS BIGINT)")
scalar("geo_rotate_forward", "events", "event_id", lambda: fixed(geo.rotate_yaw(F.lit(1.0), F.lit(2.0), F.lit(3.0), angle())[2], 6), rounded("3e0 * cos(radians(event_id * 53 % 777)) - 1e0 * sin(radians(event_id * 53 % 777))"))
scalar("geo_click_flat_pitch", "part", "p_partkey", lambda: fixed(geo.click_flat(F.col("p_size") / 50.0, F.col("p_size") / 50.0, F.lit(70.0), F.lit(43.0))[1], 6), rounded("-degrees(atan((greatest(0e0, least(1e0, p_size / 50e0)) - 0.5e0) * 2 * tan(radians(21.5e0))))"))


def reached(lat: str, lon: str, bearing: str, metres: str) -> tuple[str, str]:
    """SQL of the latitude and longitude at a distance and bearing."""
    arc, turn = f"({metres} / 6378137e0)", f"radians({bearing})"
    sine = f"(sin(radians({lat})) * cos({arc}) + cos(radians({lat})) * sin({arc}) * cos({turn}))"
    return f"degrees(asin({sine}))", f"degrees(radians({lon}) + atan2(sin({turn}) * sin({arc}) * cos(radians({lat})), cos({arc}) - sin(radians({lat})) * {sine}))"


TIP, LEFT, RIGHT = reached("lat0", "lon0", "b", "r"), reached("lat1", "lon1", "(b - 90e0)", "(r * 0.3e0)"), reached("lat1", "lon1", "(b + 90e0)", "(r * 0.3e0)")


@query(f"WITH t AS (SELECT event_id, {AT_SQL[0]} AS lat0, {AT_SQL[1]} AS lon0, event_id * 53 % 777 / 1e0 AS b, event_id * 53 % 777 / 7e0 AS r FROM events), p AS (SELECT *, {TIP[0]} AS lat1, {TIP[1]} AS lon1 FROM t)"
       f" SELECT event_id, {rounded('lat1')} AS tip_lat, {rounded('lon1')} AS tip_lon, {rounded(LEFT[0])} AS left_lat, {rounded(LEFT[1])} AS left_lon, {rounded(RIGHT[0])} AS right_lat, {rounded(RIGHT[1])} AS right_lon FROM p")  # fmt: skip
def geo_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tip of the view direction and both ends of the line across it."""
    ends = zip(("tip", "left", "right"), geo.direction(*at(AT_SQL), angle(), angle() / 7), strict=True)
    rows = table(spark, sf_dir, "events").select("event_id", *[p.alias(name) for name, p in ends])
    return rows.select("event_id", *[fixed(F.col(f"{name}.{c}"), 6).alias(f"{name}_{c}") for name in ("tip", "left", "right") for c in ("lat", "lon")])


scalar("limit_rings", "part", "p_partkey", lambda: F.array_join(geo.grid_radii(F.lit(0.5), F.col("p_size") * 20 + 0.5).cast("array<int>").cast("array<string>"), ","), "array_to_string(range(1, least(250, p_size * 20) + 1), ',')")
