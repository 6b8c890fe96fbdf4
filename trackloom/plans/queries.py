"""The operators as queries over relations derived from the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import circle, ground_to_screen, haversine, sector, vertical_fov
from ..functions.numbers import fixed
from ..operators import export, frames, match, navigate, project, resample, review, trajectory
from . import document_queries, fixtures, live_queries, scalars, session_queries
from .fixtures import table, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHIFT, TOLERANCE_M = 3, 500.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEGMENTS_SQL = with_("track", "videos") + """, pts AS (
  SELECT track_id, epoch_us(ts) AS us, lat, lon FROM track
), segs AS (
  SELECT track_id, us, lat, lon, lead(us) OVER w AS us_next, lead(lat) OVER w AS lat_next, lead(lon) OVER w AS lon_next, min(us) OVER (PARTITION BY track_id) AS us_first
  FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY us, lat, lon)
)"""
RESAMPLE_SQL = SEGMENTS_SQL + """, fr AS (
  SELECT s.*, v.fps, v.frame_count, us_next - us AS len, CAST(round_even((us - us_first) / 1e6 * fps, 0) AS BIGINT) AS f0, CAST(round_even((us_next - us_first) / 1e6 * fps, 0) AS BIGINT) AS f1
  FROM segs s JOIN videos v USING (track_id) WHERE us_next > us
), ex AS (
  SELECT *, unnest(generate_series(f0, f1 - 1)) AS n FROM fr WHERE f1 > f0
), tm AS (
  SELECT *, CAST(round_even(n / fps * 1e6, 0) AS BIGINT) AS moment FROM ex
), ip AS (
  SELECT *, greatest(0e0, least(1e0, (moment - (us - us_first)) / CAST(len AS DOUBLE))) AS share, CAST(round_even(moment / 1e6 * fps, 0) AS BIGINT) AS source_frame FROM tm
), src AS (
  SELECT track_id, source_frame, make_timestamp(us_first + moment) AS ts, lat + share * (lat_next - lat) AS lat, lon + share * (lon_next - lon) AS lon, frame_count,
    row_number() OVER (PARTITION BY track_id, source_frame ORDER BY n DESC) AS rn FROM ip
)"""


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = fixtures.videos(spark, sf_dir)
    return resample.shift_frames(resample.resample(fixtures.track(spark, sf_dir), videos), videos, SHIFT)


FRAMES_SQL = RESAMPLE_SQL + f", frames AS (SELECT track_id, source_frame + {SHIFT} AS frame, source_frame, ts, lat, lon FROM src WHERE rn = 1 AND source_frame + {SHIFT} >= 0 AND source_frame + {SHIFT} < frame_count)"


@query(SEGMENTS_SQL + " SELECT * FROM segs WHERE us_next IS NOT NULL")
def win_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.segments(fixtures.track(spark, sf_dir))


@query(RESAMPLE_SQL + " SELECT track_id, source_frame, ts, lat, lon FROM src WHERE rn = 1")
def win_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(fixtures.track(spark, sf_dir), fixtures.videos(spark, sf_dir))


@query(FRAMES_SQL + " SELECT * FROM frames")
def join_frame_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the camera was at every frame of every video."""
    return frames_of(spark, sf_dir)


NEAREST_SQL = """, near AS (
  SELECT p.*, (SELECT min(struct_pack(d2 := (r.lat - p.lat) * (r.lat - p.lat) + (r.lon - p.lon) * (r.lon - p.lon), ref_idx := r.ref_idx, rlat := r.lat, rlon := r.lon)) FROM refs r) AS b FROM pt p
), measured AS (
  SELECT *, 2e0 * 6371000e0 * asin(sqrt(pow(sin((radians(b.rlat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(b.rlat)) * pow(sin((radians(b.rlon) - radians(lon)) / 2), 2))) AS m FROM near
), matched AS (
  SELECT *, CASE WHEN m <= 500 THEN b.ref_idx END AS ref_idx, CASE WHEN m <= 500 THEN floor(m * 1e3 + 0.5) / 1e3 END AS metres FROM measured
)"""
POINTS_SQL = with_("track", "refs") + ", pt AS (SELECT track_id, epoch_us(ts) AS us, lat, lon FROM track)" + NEAREST_SQL


def matched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.track(spark, sf_dir).select("track_id", resample.micros(F.col("ts")).alias("us"), "lat", "lon")
    return match.match_references(points, fixtures.refs(spark, sf_dir), TOLERANCE_M, distance=haversine)  # on the sphere, as the SQL


@query(POINTS_SQL + " SELECT track_id, us, lat, lon, ref_idx, metres FROM matched")
def join_nearest_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched_points(spark, sf_dir)
    return rows.select("track_id", "us", "lat", "lon", F.col("match.ref_idx").alias("ref_idx"), fixed(F.col("match.distance_m"), 3).alias("metres"))


@query(POINTS_SQL + " SELECT count(*) AS points, count(ref_idx) AS matched FROM matched")
def agg_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.matched_count(matched_points(spark, sf_dir))


@query(POINTS_SQL + " SELECT track_id, us, lat AS latitude, lon AS longitude, coalesce(r2.lat, m.lat) AS aligned_latitude, coalesce(r2.lon, m.lon) AS aligned_longitude, coalesce(r2.reference_label, '') AS kp,"
       " CASE WHEN m.ref_idx IS NULL THEN 0 ELSE 1 END AS kp_match FROM (SELECT track_id, us, lat, lon, ref_idx FROM matched) m LEFT JOIN refs r2 ON m.ref_idx = r2.ref_idx".replace("track_id, us, lat AS latitude, lon AS", "track_id, us, m.lat AS latitude, m.lon AS"))  # fmt: skip
def proj_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.aligned(matched_points(spark, sf_dir), fixtures.refs(spark, sf_dir))
    return rows.select("track_id", "us", "latitude", "longitude", "aligned_latitude", "aligned_longitude", "kp", "kp_match")


SINK_SQL = POINTS_SQL + """, al AS (SELECT m.us // 3600000000 AS frame, m.us, m.lat, m.lon, m.m AS metres_, m.ref_idx, r.reference_id, r.reference_name, r.reference_label, r.lat AS rlat, r.lon AS rlon FROM matched m LEFT JOIN refs r ON r.ref_idx = m.ref_idx),
tx AS (SELECT frame, frame + 3 AS source_frame, 3 AS frame_shift, printf('%04d/frame_%07d.jpg', frame // 1000, frame) AS image_path, strftime(date_trunc('millisecond', make_timestamp(us)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, printf('%.9f', lat) AS latitude, printf('%.9f', lon) AS longitude,
  printf('%.9f', coalesce(rlat, lat)) AS aligned_latitude, printf('%.9f', coalesce(rlon, lon)) AS aligned_longitude, coalesce(reference_label, '') AS kp, coalesce(reference_id, '') AS reference_id, coalesce(reference_name, '') AS reference_name, coalesce(reference_label, '') AS reference_label,
  CASE WHEN ref_idx IS NULL THEN '' ELSE printf('%.3f', floor(metres_ * 1e3 + 0.5) / 1e3) END AS kp_distance_m, CASE WHEN rlat IS NULL THEN '' ELSE printf('%.9f', rlat) END AS kp_latitude, CASE WHEN rlon IS NULL THEN '' ELSE printf('%.9f', rlon) END AS kp_longitude, CASE WHEN ref_idx IS NULL THEN 0 ELSE 1 END AS kp_match FROM al)"""


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.aligned(matched_points(spark, sf_dir), fixtures.refs(spark, sf_dir))
    frame = F.floor(F.col("us") / 3_600_000_000).cast("bigint")
    return rows.withColumns({"frame": frame, "source_frame": frame + 3, "ts": F.timestamp_micros("us").cast("timestamp_ntz"), "kp_distance_m": fixed(F.col("kp_distance_m"), 3)})


@query(SINK_SQL + " SELECT * FROM tx")
def sink_frames_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.frames_table(frame_rows(spark, sf_dir), 3)


@query(SINK_SQL + " SELECT frame AS frame_index, frame, source_frame, image_path, kp, reference_id, reference_name, reference_label, kp_distance_m, latitude, longitude FROM tx WHERE kp_match = 1")
def sink_matched_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.matched_table(frame_rows(spark, sf_dir), 3)


HEADING_SQL = with_("positions") + """, prs AS (
  SELECT c.video, c.frame, c.lat, c.lon, k.k, b.lat AS blat, b.lon AS blon, a.lat AS alat, a.lon AS alon
  FROM positions c CROSS JOIN (SELECT unnest(range(1, 11)) AS k) k LEFT JOIN positions b ON b.video = c.video AND b.frame = c.frame - k.k LEFT JOIN positions a ON a.video = c.video AND a.frame = c.frame + k.k
), opts AS (
  SELECT video, frame, 100 + k AS rank, blat AS lat1, blon AS lon1, alat AS lat2, alon AS lon2 FROM prs WHERE blat IS NOT NULL AND alat IS NOT NULL
  UNION ALL SELECT video, frame, 2 * k + 1, lat, lon, alat, alon FROM prs WHERE alat IS NOT NULL
  UNION ALL SELECT video, frame, 2 * k, blat, blon, lat, lon FROM prs WHERE blat IS NOT NULL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY rank DESC) AS rn FROM opts
), vec AS (
  SELECT video, frame, radians(lon2 - lon1) * 6378137e0 * cos(radians((lat1 + lat2) / 2)) AS dx, radians(lat2 - lat1) * 6378137e0 AS dy FROM best WHERE rn = 1
), hd AS (
  SELECT p.video, p.frame, ((degrees(atan2(dx, dy)) + 360e0) % 360e0 + 360e0) % 360e0 AS heading, sqrt(dx * dx + dy * dy) AS distance_m FROM positions p LEFT JOIN vec v ON p.video = v.video AND p.frame = v.frame
)"""


@query(HEADING_SQL + " SELECT video, frame, floor(heading * 1e6 + 0.5) / 1e6 AS heading, floor(distance_m * 1e3 + 0.5) / 1e3 AS distance_m FROM hd")
def win_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory.headings(fixtures.positions(spark, sf_dir))
    return rows.select("video", "frame", fixed(F.col("heading"), 6).alias("heading"), fixed(F.col("distance_m"), 3).alias("distance_m"))


@query(HEADING_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, vis AS (
  SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS seq FROM hd
), run AS (
  SELECT video, frame, seq, coalesce(heading, 0e0) AS held FROM vis WHERE seq = 1
  UNION ALL
  SELECT v.video, v.frame, v.seq, CASE WHEN v.heading IS NULL THEN r.held
    WHEN (abs(v.frame - r.frame) <= 10 AND abs((((v.heading - r.held + 180e0) % 360e0) + 360e0) % 360e0 - 180e0) > 45) OR v.distance_m < 0.5 THEN r.held ELSE v.heading END
  FROM run r JOIN vis v ON v.video = r.video AND v.seq = r.seq + 1
) SELECT video, frame, floor(held * 1e6 + 0.5) / 1e6 AS held_heading FROM run""")
def win_heading_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory.headings(fixtures.positions(spark, sf_dir)).withColumn("seq", F.col("frame"))
    return trajectory.held_headings(rows).select("video", "frame", fixed(F.col("held_heading"), 6).alias("held_heading"))


@query(with_("markings") + " SELECT video, frame, lag(frame) OVER w AS previous, lead(frame) OVER w AS next, row_number() OVER w - 1 AS index FROM (SELECT DISTINCT video, frame FROM markings) WINDOW w AS (PARTITION BY video ORDER BY frame)")
def win_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.neighbours(fixtures.markings(spark, sf_dir))


ASKED_SQL = with_("markings") + ", fr AS (SELECT DISTINCT video, frame FROM markings), asked AS (SELECT video, unnest(range(0, 100)) AS frame FROM (SELECT DISTINCT video FROM markings))"


def asked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 0 to 99 of every video with markings."""
    return fixtures.markings(spark, sf_dir).select("video").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))))


@query(ASKED_SQL + " SELECT video, frame, (SELECT max(f.frame) FROM fr f WHERE f.video = a.video AND f.frame < a.frame) AS previous, (SELECT min(f.frame) FROM fr f WHERE f.video = a.video AND f.frame > a.frame) AS next FROM asked a")
def win_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.around(fixtures.markings(spark, sf_dir), asked_frames(spark, sf_dir))


@query(ASKED_SQL + ", l AS (SELECT video, list(frame ORDER BY frame) AS fs FROM fr GROUP BY video), g AS (SELECT a.video, a.frame, fs, list_filter(fs, lambda x: x > a.frame) AS gt FROM asked a JOIN l USING (video))"
       " SELECT video, frame, CASE WHEN len(gt) > 0 THEN gt[least(len(gt), 3)] END AS target FROM g")  # fmt: skip
def win_step_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.step(fixtures.markings(spark, sf_dir), asked_frames(spark, sf_dir), 3, forward=True)


@query(ASKED_SQL + ", l AS (SELECT video, list(frame ORDER BY frame DESC) AS fs FROM fr GROUP BY video), g AS (SELECT a.video, a.frame, fs, list_filter(fs, lambda x: x < a.frame) AS lt FROM asked a JOIN l USING (video))"
       " SELECT video, frame, CASE WHEN len(lt) > 0 THEN lt[least(len(lt), 3)] END AS target FROM g")  # fmt: skip
def win_step_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.step(fixtures.markings(spark, sf_dir), asked_frames(spark, sf_dir), 3, forward=False)


@query("SELECT event_id, CASE WHEN event_id % 100 >= 50 + user_id % 40 - 1 THEN NULL ELSE least(greatest(0, event_id % 100 + 30), 50 + user_id % 40 - 1) END AS target FROM events")
def win_frame_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", navigate.frame_step(F.col("event_id") % 100, F.lit(50) + F.col("user_id") % 40, 30).alias("target"))


@query(with_("markings") + " SELECT video, min(frame) AS first, max(frame) AS last FROM markings GROUP BY video")
def win_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.edges(fixtures.markings(spark, sf_dir))


@query(POINTS_SQL + ", nd AS (SELECT track_id AS video, us AS frame, ref_idx, row_number() OVER w - 1 AS index, lag(us) OVER w AS previous_frame, lead(us) OVER w AS next_frame FROM matched WHERE ref_idx IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY us))"
       " SELECT video, frame, ref_idx, CAST(index AS INTEGER) AS index, CAST(CASE WHEN index > 0 THEN index - 1 END AS INTEGER) AS previous_index, CAST(CASE WHEN next_frame IS NOT NULL THEN index + 1 END AS INTEGER) AS next_index, previous_frame, next_frame FROM nd")  # fmt: skip
def win_linked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched_points(spark, sf_dir).where("match is not null").select(F.col("track_id").alias("video"), F.col("us").alias("frame"), F.col("match.ref_idx").alias("ref_idx"))
    return navigate.linked_nodes(rows)


CANDIDATES_SQL = with_("candidates") + r""", fit AS (
  SELECT *, ((target_yaw % 360e0) + 360e0) % 360e0 AS yaw, greatest(-90e0, least(90e0, target_pitch)) AS pitch FROM candidates
  WHERE coalesce(lower(trim(target_source)) = 'yolo_pinhole', false) OR NOT (coalesce(lower(replace(evidence_path, '\', '/')) LIKE '%/cubemap/%' OR lower(replace(evidence_path, '\', '/')) LIKE 'cubemap/%', false)
    OR coalesce(lower(trim(evidence_face)) IN ('front', 'back', 'left', 'right', 'up', 'down'), false))
), dd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, candidate_id, floor(yaw * 1e3 + 0.5), floor(pitch * 1e3 + 0.5) ORDER BY pos) AS rn FROM fit) WHERE rn = 1
)"""


def fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.candidates(spark, sf_dir).where(review.evidence_fits(True, F.col("target_source"), F.col("evidence_path"), F.col("evidence_face")))


@query(CANDIDATES_SQL + " SELECT count(*) AS n, sum(pos) AS sum_pos, video, frame FROM fit GROUP BY video, frame")
def pred_projection_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum_pos is a bigint, as in the SQL, or a decimal(38,0) where a sum exceeds it, at which the SQL's own cast fails."""
    sums = fitting(spark, sf_dir).groupBy("video", "frame").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum_pos"))
    if sums.where(F.col("sum_pos").try_cast("bigint").isNull()).isEmpty():
        return sums.withColumn("sum_pos", F.col("sum_pos").cast("bigint"))
    return sums


ORACLES["pred_projection_match"] = ORACLES["pred_projection_match"].replace("sum(pos) AS", "CAST(sum(pos) AS BIGINT) AS")


@query(CANDIDATES_SQL + " SELECT video, frame, candidate_id, pos FROM dd")
def dedup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.distinct_candidates(fitting(spark, sf_dir)).select("video", "frame", "candidate_id", "pos")


@query(CANDIDATES_SQL + " SELECT video, frame, candidate_id, pos, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video, frame ORDER BY (confidence IS NULL), confidence DESC, coalesce(semantic_class, ''), coalesce(candidate_id, ''), pos) AS INTEGER) AS rank FROM dd) WHERE rank <= 100")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rank_candidates(review.distinct_candidates(fitting(spark, sf_dir))).select("video", "frame", "candidate_id", "pos", "rank")


@query(CANDIDATES_SQL + " SELECT video, frame, yaw, pitch, 1.35e0 AS zoom FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY (confidence IS NULL), confidence DESC, coalesce(semantic_class, ''), coalesce(candidate_id, ''), pos) AS k FROM dd) WHERE k = 1")
def topk_best_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.best_view(review.distinct_candidates(fitting(spark, sf_dir)))


@query(with_("markings") + " SELECT video, frame, target_id, target_order, pos FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY coalesce(target_order, 0) DESC, coalesce(target_id, 0) DESC, pos DESC) AS k FROM markings) WHERE k = 1")
def agg_latest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_marking(fixtures.markings(spark, sf_dir)).select("video", "frame", "target_id", "target_order", "pos")


KEYED_SQL = with_("markings") + ", keyed AS (SELECT *, coalesce('#' || coalesce(target_id, target_order), CAST(floor(target_yaw * 1e3 + 0.5) AS BIGINT) || ':' || CAST(floor(target_pitch * 1e3 + 0.5) AS BIGINT)) AS key FROM markings)"


@query(KEYED_SQL + " SELECT pos, key FROM keyed")
def dedup_marking_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return fixtures.markings(spark, sf_dir).select("pos", review.marking_key(c("target_id"), c("target_order"), c("target_yaw"), c("target_pitch")).alias("key"))


@query(KEYED_SQL + " SELECT pos FROM keyed n WHERE pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM markings o WHERE o.pos % 2 = 0 AND o.video = n.video AND o.frame = n.frame AND o.target_id IS NOT NULL AND '#' || o.target_id = n.key)")
def dedup_marking_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.markings(spark, sf_dir)
    return review.insert_markings(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1")).select("pos")


@query(KEYED_SQL + " SELECT video, frame, coalesce(target_id, target_order) AS id, coalesce(target_order, target_id) AS \"order\", target_yaw % 360e0 AS yaw, target_pitch AS pitch, greatest(0.01e0, coalesce(view_zoom, 1e0)) AS zoom"
       " FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, key ORDER BY coalesce(target_order, 0), coalesce(target_id, 0), pos) AS k FROM keyed) WHERE k = 1")  # fmt: skip
def dedup_marking_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.restored_markings(fixtures.markings(spark, sf_dir))


@query(with_("markings") + " SELECT video, CAST(count(DISTINCT frame) AS BIGINT) AS frames FROM markings GROUP BY video")
def agg_picked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_count(fixtures.markings(spark, sf_dir))


@query(with_("candidates") + " SELECT DISTINCT video, frame FROM candidates")
def agg_detection_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.distinct_frames(fixtures.candidates(spark, sf_dir))


@query(with_("candidates") + " SELECT video, min(frame) AS first_frame, count(*) AS features FROM candidates GROUP BY video")
def agg_first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.first_frames(fixtures.candidates(spark, sf_dir))


@query(with_("candidates") + " SELECT video, array_to_string(list_sort(list(DISTINCT semantic_class)), '|') AS classes, CASE WHEN count(DISTINCT semantic_class) = 1 THEN max(semantic_class) END AS single FROM candidates GROUP BY video")
def agg_sorted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.sorted_classes(fixtures.candidates(spark, sf_dir))
    return rows.select("video", F.array_join("classes", "|").alias("classes"), frames.single_class(F.col("classes")).alias("single"))


@query("SELECT p_type AS value, min(p_partkey) AS first_pos FROM part WHERE trim(p_type) <> '' GROUP BY p_type ORDER BY first_pos LIMIT 4")
def agg_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four distinct values of a column, in row order: the limit is the feature."""
    return frames.distinct_values(table(spark, sf_dir, "part"), "p_type", 4, "p_partkey")


@query(with_("markings") + " SELECT video, max(greatest(coalesce(target_id, 0), coalesce(target_order, 0))) + 1 AS next_id FROM markings GROUP BY video")
def agg_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.next_id(fixtures.markings(spark, sf_dir))


TARGETS_SQL = """WITH t AS (
  SELECT event_id, 35e0 + (event_id % 1000) / 1e4 AS lat, 136e0 + (event_id * 7 % 1000) / 1e4 AS lon, (event_id * 17 % 3600) / 10e0 AS heading, CASE WHEN event_id % 5 <> 0 THEN (event_id * 7 % 3600) / 10e0 END AS state_yaw,
    CASE WHEN event_id % 3 <> 0 THEN (event_id % 40) / 10e0 END AS state_zoom, CASE WHEN event_id % 4 = 0 THEN (event_id % 500) - 250e0 END AS state_offset, CASE WHEN event_id % 2 = 0 THEN (event_id % 90) / 3e0 END AS camera_height_m,
    CASE WHEN event_id % 6 <> 0 THEN (event_id * 11 % 3600) / 10e0 END AS target_yaw, CASE WHEN event_id % 7 = 0 THEN (event_id * 3 % 3600) / 10e0 END AS view_yaw, CASE WHEN event_id % 9 <> 0 THEN (event_id % 360) - 180e0 END AS yaw_delta,
    CASE WHEN event_id % 8 <> 0 THEN (event_id * 13 % 1800) / 10e0 - 90e0 END AS target_pitch, CASE WHEN event_id % 10 = 0 THEN (event_id % 700) / 10e0 END AS ground_m, CASE WHEN event_id % 12 = 0 THEN (event_id % 360) * 1e0 END AS map_bearing
  FROM events
), y AS (
  SELECT *, coalesce(target_yaw, (((coalesce(state_yaw, 0e0) + yaw_delta) % 360e0) + 360e0) % 360e0) AS yaw FROM t
), d AS (
  SELECT *, coalesce(yaw_delta, (((yaw - coalesce(view_yaw, state_yaw, 0e0) + 180e0) % 360e0) + 360e0) % 360e0 - 180e0) AS delta FROM y
), c AS (
  SELECT *, CASE WHEN abs(cos(radians(delta))) >= 0.1 THEN cos(radians(delta)) WHEN cos(radians(delta)) >= 0 THEN 0.1e0 ELSE -0.1e0 END AS turn,
    greatest(1e0, least(179e0, 90e0 / greatest(CASE WHEN state_zoom IS NULL OR state_zoom = 0 THEN 1e0 ELSE state_zoom END, 0.01e0))) AS fov FROM d
), g AS (
  SELECT *, coalesce(CASE WHEN ground_m > 0 THEN ground_m END, CASE WHEN target_pitch > 0.1 AND target_pitch < 89.9 THEN greatest(0.1e0, least(20e0, coalesce(camera_height_m, 1.5e0))) / tan(radians(target_pitch)) END) AS ground,
    greatest(1e0, 5e0 * tan(radians(fov / 2)) / tan(radians(45e0))) AS ahead FROM c
), p AS (
  SELECT *, CASE WHEN yaw IS NOT NULL THEN greatest(1e0, coalesce(ground, ahead / abs(turn))) END AS metres,
    CASE WHEN yaw IS NOT NULL THEN coalesce(map_bearing, (((heading + coalesce((((state_offset + 180e0) % 360e0) + 360e0) % 360e0 - 180e0, 0e0) + yaw) % 360e0) + 360e0) % 360e0) END AS bearing FROM g
) SELECT event_id, CASE WHEN ground IS NOT NULL THEN 'ground_plane' ELSE 'center_plane' END AS mode, floor(metres * 1e3 + 0.5) / 1e3 AS metres, floor(bearing * 1e6 + 0.5) / 1e6 AS bearing,
  CASE WHEN metres <= 5 THEN 'trusted' WHEN metres <= 10 THEN 'usable' WHEN metres > 10 THEN 'far' END AS quality FROM p"""


@query(TARGETS_SQL)
def geo_project_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "35D + (event_id % 1000) / 1e4D AS lat", "136D + (event_id * 7 % 1000) / 1e4D AS lon", "(event_id * 17 % 3600) / 10D AS heading", "CASE WHEN event_id % 5 <> 0 THEN (event_id * 7 % 3600) / 10D END AS state_yaw",
        "CASE WHEN event_id % 3 <> 0 THEN (event_id % 40) / 10D END AS state_zoom", "CASE WHEN event_id % 4 = 0 THEN (event_id % 500) - 250D END AS state_offset", "CASE WHEN event_id % 2 = 0 THEN (event_id % 90) / 3D END AS camera_height_m",
        "CAST(NULL AS DOUBLE) AS hud_scale", "CASE WHEN event_id % 6 <> 0 THEN (event_id * 11 % 3600) / 10D END AS target_yaw", "CASE WHEN event_id % 7 = 0 THEN (event_id * 3 % 3600) / 10D END AS view_yaw",
        "CASE WHEN event_id % 9 <> 0 THEN (event_id % 360) - 180D END AS yaw_delta", "CASE WHEN event_id % 8 <> 0 THEN (event_id * 13 % 1800) / 10D - 90D END AS target_pitch", "CAST(NULL AS DOUBLE) AS view_pitch",
        "CAST(NULL AS DOUBLE) AS pitch_delta", "CAST(NULL AS DOUBLE) AS view_zoom", "CASE WHEN event_id % 10 = 0 THEN (event_id % 700) / 10D END AS ground_m", "CASE WHEN event_id % 12 = 0 THEN (event_id % 360) * 1D END AS map_bearing",
        "CAST(NULL AS DOUBLE) AS map_yaw", "CAST(NULL AS STRING) AS projection",
    )
    rows = project.project_targets(e)
    return rows.select("event_id", "mode", fixed(F.col("distance_m"), 3).alias("metres"), fixed(F.col("bearing"), 6).alias("bearing"), "quality")


DESTINATION_SQL = "degrees(asin(sin(radians({lat})) * cos({d} / 6378137e0) + cos(radians({lat})) * sin({d} / 6378137e0) * cos(radians({b}))))"


PLACED_SQL = "35e0 + (s_suppkey * 37 % 1000) / 1e4 AS lat, 136e0 + (s_suppkey * 91 % 1000) / 1e4 AS lon, 5e0 + s_suppkey % 20 AS radius"


def arrived(bearing: str) -> str:
    """SQL of lat and lon at the radius and a bearing from the supplier's place, rounded."""
    return ", ".join(f"floor({x} * 1e6 + 0.5) / 1e6 AS {name}" for x, name in zip(session_queries.reached("lat", "lon", bearing, "radius"), ("lat", "lon"), strict=True))


@query(f"WITH s AS (SELECT s_suppkey, {PLACED_SQL}, unnest(range(0, 46)) AS k FROM supplier) SELECT s_suppkey, CAST(k AS INTEGER) AS k, {arrived('k * 8e0')} FROM s")
def geo_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.refs(spark, sf_dir).withColumn("p", circle(F.col("lat"), F.col("lon"), F.lit(5.0) + F.col("ref_idx") % 20))
    return s.select(F.col("ref_idx").alias("s_suppkey"), F.posexplode("p").alias("k", "x")).select("s_suppkey", "k", fixed(F.col("x.lat"), 6).alias("lat"), fixed(F.col("x.lon"), 6).alias("lon"))


@query(f"WITH s AS (SELECT s_suppkey, {PLACED_SQL}, (s_suppkey * 13 % 360) * 1e0 AS b, 20e0 + s_suppkey % 100 AS f FROM supplier), n AS (SELECT *, greatest(8, CAST(floor(f / 4) AS INTEGER)) AS n FROM s), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n)"
       f" SELECT s_suppkey, CAST(k + 1 AS INTEGER) AS k, {arrived('(b - f / 2 + f * (k / CAST(n AS DOUBLE)))')} FROM k"
       " UNION ALL SELECT s_suppkey, CAST(unnest([0, n + 2]) AS INTEGER), floor(lat * 1e6 + 0.5) / 1e6, floor(lon * 1e6 + 0.5) / 1e6 FROM n")  # fmt: skip
def geo_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ref_idx")
    s = fixtures.refs(spark, sf_dir).withColumn("p", sector(F.col("lat"), F.col("lon"), (r * 13 % 360).cast("double"), F.lit(20.0) + r % 100, F.lit(5.0) + r % 20))
    return s.select(r.alias("s_suppkey"), F.posexplode("p").alias("k", "x")).select("s_suppkey", "k", fixed(F.col("x.lat"), 6).alias("lat"), fixed(F.col("x.lon"), 6).alias("lon"))


RING_SQL = """WITH s AS (SELECT s_suppkey, 2e0 + s_suppkey % 9 AS radius, (s_suppkey * 13 % 360) * 1e0 AS yaw, (s_suppkey % 50) * 1e0 AS pitch, unnest(range(0, 97)) AS k FROM supplier),
v AS (SELECT *, sin(radians(k / 96e0 * 360e0)) * radius AS x, -1.5e0 AS y, cos(radians(k / 96e0 * 360e0)) * radius AS z FROM s),
a AS (SELECT *, x * cos(radians(-yaw)) + z * sin(radians(-yaw)) AS x1, z * cos(radians(-yaw)) - x * sin(radians(-yaw)) AS z1 FROM v),
b AS (SELECT *, y * cos(radians(pitch)) + z1 * sin(radians(pitch)) AS y2, z1 * cos(radians(pitch)) - y * sin(radians(pitch)) AS z2 FROM a),
n AS (SELECT *, x1 / z2 / tan(radians(45e0)) AS nx, -y2 / z2 / tan(radians(greatest(1e0, least(179e0, degrees(atan(tan(radians(45e0)) * (600e0 / 800e0))) * 2)) / 2)) AS ny FROM b),
w AS (SELECT s_suppkey, k, coalesce(z2 > 0.01 AND abs(nx) <= 2.2 AND abs(ny) <= 2.2, false) AS seen, (nx + 1) / 2 * 800 AS px FROM n),
i AS (SELECT *, k - row_number() OVER (PARTITION BY s_suppkey ORDER BY k) AS island FROM w WHERE seen),
c AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey, island) AS size, min(k) OVER (PARTITION BY s_suppkey, island) AS run FROM i)
SELECT s_suppkey, CAST(k AS INTEGER) AS k, CAST(run AS INTEGER) AS run, floor(px * 1e3 + 0.5) / 1e3 AS px FROM c WHERE size >= 2"""


@query(RING_SQL)
def geo_ground_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """96 samples of a ground ring on the screen, in runs of at least two visible ones."""
    r = F.col("ref_idx")
    s = fixtures.refs(spark, sf_dir).select(r, F.explode(F.sequence(F.lit(0), F.lit(96))).alias("k"))
    point = ground_to_screen(F.col("k") / 96.0 * 360.0, F.lit(2.0) + r % 9, F.lit(1.5), (r * 13 % 360).cast("double"), (r % 50).cast("double"), F.lit(90.0), F.lit(800.0), F.lit(600.0))
    seen = s.withColumn("p", point).where("p is not null")
    by_ring = Window.partitionBy("ref_idx")
    seen = seen.withColumn("island", F.col("k") - F.row_number().over(by_ring.orderBy("k")))
    island = Window.partitionBy("ref_idx", "island")
    runs = seen.withColumn("size", F.count("*").over(island)).withColumn("run", F.min("k").over(island)).where("size >= 2")
    return runs.select(r.alias("s_suppkey"), "k", "run", fixed(F.col("p.x"), 3).alias("px"))


@query("SELECT p_partkey, floor(greatest(1e0, least(179e0, degrees(atan(tan(radians((20e0 + p_size) / 2)) * (9e0 / 16e0))) * 2)) * 1e6 + 0.5) / 1e6 AS value FROM part")
def geo_vertical_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fixed(vertical_fov(F.lit(20.0) + F.col("p_size"), F.lit(16.0), F.lit(9.0)), 6).alias("value"))


QUERIES |= session_queries.QUERIES | document_queries.QUERIES | live_queries.QUERIES
ORACLES |= session_queries.ORACLES | document_queries.ORACLES | live_queries.ORACLES
for _name in scalars.SCALARS:
    QUERIES[_name] = scalars.query(_name)
    ORACLES[_name] = scalars.oracle(_name)
