"""Queries of live rules, tables changed by key, files chosen by rank, drawn places and EXIF bytes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exif, screen
from ..functions.numbers import fixed
from ..operators import keyed, project
from ..session import dealt, scratch
from ..sources import fallback
from ..streaming import rules, state
from .document_queries import Query
from .fixtures import table
from .session_queries import mod, rounded, signed, split_columns

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# live rules over a table of states; an hour stands for a second

HOUR = 3_600_000_000
LIVE = "event_id AS seq, ts, user_id % 20 AS video, event_id // 7 % 2 AS frame, CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS n_targets, event_id % 3 = 0 AND event_id % 4 > 0 AND event_id % 5 = 0 AS by_user"
QUIET, BEAT, LIFE, GRACE, IDLE = 3 * HOUR // 10, HOUR, 3 * HOUR, 9 * HOUR // 10, 12 * HOUR


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*split_columns(LIVE.replace("event_id // 7", "event_id div 7")))


@query(f"""WITH t AS (SELECT user_id % 20 AS video, event_id AS seq, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {LIFE} THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY video ORDER BY us, seq)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS session FROM n), e AS (SELECT video, session, min(us) AS lo, max(us) AS hi FROM s GROUP BY video, session),
b AS (SELECT video, NULL AS seq, unnest(range(lo + {BEAT}, hi + {LIFE} + 1, {BEAT})) AS us, true AS beat FROM e), a AS (SELECT video, seq, us, false AS beat FROM s UNION ALL SELECT video, seq, us, beat FROM b),
p AS (SELECT video, us, beat, lead(us) OVER w AS later, last_value(seq IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS seq FROM a WINDOW w AS (PARTITION BY video ORDER BY us, beat DESC, seq))
SELECT video, seq, us + {QUIET} AS posted_us, beat FROM p WHERE later IS NULL OR later - us >= {QUIET}""")
def st_debounce_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post of every video, heartbeats too."""
    return rules.posted(live(spark, sf_dir), rules.Debounce(QUIET, BEAT, LIFE))


@query(f"""WITH t AS (SELECT {LIVE}, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN frame IS DISTINCT FROM lag(frame) OVER w OR us - lag(us) OVER w > {IDLE} THEN 1 ELSE 0 END AS fresh, lag(n_targets) OVER w AS before FROM t WINDOW w AS (PARTITION BY video ORDER BY us, seq)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run, min(CASE WHEN n_targets > 0 OR fresh = 1 THEN us END) OVER (PARTITION BY video ORDER BY us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM n),
u AS (SELECT *, coalesce(bool_or(by_user) OVER (PARTITION BY video, run ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM r)
SELECT video, seq, us, n_targets FROM u WHERE fresh = 1 OR n_targets > 0 AND (by_user OR NOT held)
UNION ALL SELECT video, seq, us + {GRACE}, 0 FROM u WHERE n_targets = 0 AND fresh = 0 AND NOT held AND before > 0 AND coalesce(later - us >= {GRACE}, true)""")
def st_clear_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of the displayed targets: new ones, and clearings after the grace; those of a user stay."""
    return rules.displayed(live(spark, sf_dir), rules.ClearGrace(GRACE, IDLE))


@query("WITH n AS (SELECT user_id % 20 AS video, event_id AS seq, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS id FROM events) SELECT video, seq, id, CASE WHEN id > 100 THEN id - 100 END AS dropped_id FROM n")
def st_number_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.appended(live(spark, sf_dir))


# tables changed by key


@query("SELECT user_id % 40 AS video, event_id AS frame, CASE WHEN user_id % 40 % 3 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 2 = 0 OR user_id % 40 % 3 = 0")
def upsert_frame_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of a third of the videos take the place of these videos' old ones; the others keep theirs."""
    folder = scratch(spark, "frames")
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 40 AS video", "event_id AS frame", "value")
    keyed.replace_groups(rows.where("frame % 2 = 0"), folder, ["video"], expect=0)
    keyed.replace_groups(rows.where("video % 3 = 0").withColumn("value", F.col("value") * 2), folder, ["video"], expect=1)
    return keyed.read(spark, folder)


OFFSET = "CASE WHEN event_id % 6 <> 0 THEN user_id % 50 * 7e0 + event_id % 3 * 4e-3 + CASE WHEN user_id % 50 % 4 = 0 THEN event_id % 97 ELSE 0 END END"


@query(f"""WITH t AS (SELECT user_id % 50 AS video, event_id AS seq, {OFFSET} AS x FROM events), k AS (SELECT video, seq, {signed('x')} AS x, event_half FROM (SELECT *, seq < (SELECT max(event_id) / 2 FROM events) AS event_half FROM t) WHERE x IS NOT NULL),
a AS (SELECT video, max(seq) AS seq, arg_max(x, seq) AS x FROM k WHERE event_half GROUP BY video), b AS (SELECT video, max(seq) AS seq, arg_max(x, seq) AS x FROM k WHERE NOT event_half GROUP BY video)
SELECT video, CASE WHEN a.video IS NULL OR abs({signed('a.x - b.x')}) >= 0.01 THEN coalesce(b.seq, a.seq) ELSE a.seq END AS seq, floor((CASE WHEN a.video IS NULL OR abs({signed('a.x - b.x')}) >= 0.01 THEN coalesce(b.x, a.x) ELSE a.x END) * 1e6 + 0.5) / 1e6 AS offset_deg
FROM a FULL JOIN b USING (video)""")
def geo_offset_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's newest bearing offset of the first half of the states, written back from the second half where it moved by a hundredth of a degree."""
    folder = scratch(spark, "offsets")
    e = table(spark, sf_dir, "events")
    half = e.agg(F.max("event_id") / 2).first()[0] or 0
    rows = e.selectExpr("user_id % 50 AS video", "event_id AS seq", f"{OFFSET} AS viewer_front_offset_deg")
    made = keyed.put_offsets(rows.where(F.col("seq") < half), folder)
    made = keyed.put_offsets(rows.where(F.col("seq") >= half), folder) or made
    if made is None:
        return rows.limit(0).select("video", "seq", F.col("viewer_front_offset_deg").alias("offset_deg"))
    return keyed.read(spark, folder).select("video", "seq", fixed(F.col("viewer_front_offset_deg"), 6).alias("offset_deg"))


MARKED = "user_id % 20 AS video, event_id % 97 AS frame, event_id % 7 AS target_id, event_id % 7 AS target_order, CAST(event_id % 360 AS DOUBLE) AS target_yaw, 0e0 AS target_pitch, event_id AS created_at"


@query(f"WITH t AS (SELECT {MARKED} FROM events) SELECT video, frame, target_id, arg_min(target_yaw, (created_at % 2 = 1, created_at)) AS target_yaw, arg_min(created_at, (created_at % 2 = 1, created_at)) AS created_at FROM t GROUP BY video, frame, target_id")
def st_store_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markings of two batches, the even ones first: each key is stored once, as it came first."""
    folder = scratch(spark, "markings")
    rows, store = table(spark, sf_dir, "events").selectExpr(*split_columns(MARKED)), state.store_markings(spark, folder)
    for number in range(2):
        store(rows.where(F.col("created_at") % 2 == number), number)
    return keyed.read(spark, folder).select("video", "frame", "target_id", "target_yaw", "created_at")


# files chosen by rank

FOLDERS = ("/session", "/video")


@query("""WITH v AS (SELECT DISTINCT 'v' || user_id || '.mp4' AS video, user_id AS u FROM events), d AS (SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 0 ELSE 1 END AS place, 'd' || c_custkey || '_navigation.json' AS name, CASE c_custkey % 4 WHEN 0 THEN NULL ELSE 'v' || (c_custkey * 7 % 400) || '.mp4' END AS video,
  CASE c_custkey % 2 WHEN 0 THEN '/session' ELSE '/video' END || '/t' || c_custkey || '.csv' AS path FROM customer WHERE c_custkey % 9 <> 0),
f AS (SELECT '/session/v' || s_suppkey * 3 || '_frames.csv' AS path FROM supplier UNION SELECT '/video/v' || s_suppkey * 2 || '_frames.csv' FROM supplier UNION SELECT CASE o_custkey % 2 WHEN 0 THEN '/session' ELSE '/video' END || '/t' || o_custkey || '.csv' FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 4 <> 0),
c AS (SELECT video, 0 AS rank, '' AS name, '/session/v' || u || '_frames.csv' AS path FROM v UNION ALL SELECT video, 1, '', '/video/v' || u || '_frames.csv' FROM v UNION ALL SELECT v.video, 4 + d.place, d.name, d.path FROM v JOIN d ON d.video = v.video
  UNION ALL SELECT v.video, 4 + d.place, d.name, d.path FROM v, (SELECT * FROM d WHERE video IS NULL AND path IN (SELECT path FROM f) ORDER BY place, name, path LIMIT 1) d)
SELECT video, arg_min(path, (rank, name, path)) AS path FROM c WHERE path IN (SELECT path FROM f) GROUP BY video""")
def scan_frames_csv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames file of each video among those named after it and those that navigation documents name; a document for no video in particular counts for all."""
    videos = table(spark, sf_dir, "events").selectExpr("concat('v', user_id, '.mp4') AS video").distinct()
    documents = table(spark, sf_dir, "customer").selectExpr(
        "concat(CASE c_custkey % 2 WHEN 0 THEN '/session' ELSE '/video' END, '/d', c_custkey, '_navigation.json') AS path",
        "CASE WHEN c_custkey % 9 = 0 THEN CASE c_custkey % 2 WHEN 0 THEN '{broken' ELSE concat('{\"video\": \"v1.mp4\", \"frames_csv\": ', c_custkey, '}') END WHEN c_custkey % 4 = 0 THEN concat('{\"frames_csv\": \"t', c_custkey, '.csv\"}')"
        " ELSE concat('{\"video\": \"/data/v', c_custkey * 7 % 400, '.mp4\", \"frames_csv\": \"t', c_custkey, '.csv\"}') END AS document",
    )
    supplier, orders = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders")
    files = supplier.selectExpr("concat('/session/v', s_suppkey * 3, '_frames.csv') AS path").union(supplier.selectExpr("concat('/video/v', s_suppkey * 2, '_frames.csv')"))
    files = files.union(orders.where("o_custkey % 5 = 0 OR o_custkey % 4 <> 0").selectExpr("concat(CASE o_custkey % 2 WHEN 0 THEN '/session' ELSE '/video' END, '/t', o_custkey, '.csv')"))
    return fallback.first_files(fallback.frames_candidates(videos, documents, list(FOLDERS)), files, videos)


@query("""WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN '/video' ELSE '/out' || user_id % 7 END || '/b' || user_id || '_matched_frames.csv' AS path, CASE WHEN event_id % 3 = 0 AND user_id % 4 <> 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 500 END AS frame FROM events),
c AS (SELECT DISTINCT user_id AS u, k AS rank, CASE k WHEN 0 THEN '/video' ELSE '/out' || user_id % 7 END || '/b' || user_id || '_matched_frames.csv' AS path FROM events, range(2) x(k)), p AS (SELECT u, min(rank) AS rank FROM c JOIN r USING (path) WHERE frame IS NOT NULL GROUP BY u)
SELECT DISTINCT 'v' || u || '.mp4' AS video, frame, path FROM p JOIN c USING (u, rank) JOIN r USING (path) WHERE frame IS NOT NULL""")
def scan_matched_csv_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each video's first matched-frames file that has any: the file beside the video, else that in its own output folder."""
    e = table(spark, sf_dir, "events")
    rows = e.selectExpr("concat(CASE event_id % 3 WHEN 0 THEN '/video' ELSE concat('/out', user_id % 7) END, '/b', user_id, '_matched_frames.csv') AS path",
                        "map('frame_index', CASE WHEN event_id % 3 = 0 AND user_id % 4 <> 0 THEN 'none' WHEN event_id % 11 = 0 THEN '' ELSE concat(event_id % 500, CASE event_id % 2 WHEN 0 THEN '.9' ELSE '' END) END) AS fields")
    outputs = e.selectExpr("concat('v', user_id, '.mp4') AS video", "concat('b', user_id) AS base", "concat('/out', user_id % 7) AS output").distinct()
    return fallback.first_matched(fallback.matched_candidates(outputs, [F.lit("/video"), F.col("output")]), rows)


# drawn places

DRAWN = (
    "event_id, CASE WHEN event_id % 29 <> 0 THEN event_id * 17 % 3600 / 10e0 END AS yaw, (event_id * 13 % 1800) / 10e0 - 90e0 AS pitch, (event_id * 7 % 720) * 1e0 - 100e0 AS view_yaw, (event_id * 11 % 200) / 1e0 - 100e0 AS view_pitch, event_id % 9 / 2e0 AS zoom,"
    " CASE WHEN event_id % 31 = 0 THEN 0e0 ELSE 600e0 + event_id % 400 END AS width, 400e0 + event_id % 300 AS height, event_id % 3 = 0 AS flat, CASE WHEN event_id % 4 <> 0 THEN event_id % 23 / 20e0 - 0.05e0 END AS x_ratio, CASE WHEN event_id % 5 <> 0 THEN event_id % 19 / 18e0 END AS y_ratio,"
    " event_id % 7 = 0 AS auto, CASE WHEN event_id % 8 = 0 THEN event_id % 360 * 1e0 END AS own_yaw, event_id % 37 <> 0 AS has_target"
)
OWN = "flat AND own_yaw IS NOT NULL"


def stage(pitch: str, yaw: str, zoom: str) -> str:
    return f"""WITH t AS (SELECT {DRAWN} FROM events), s AS (SELECT *, least(90e0, greatest(-90e0, {pitch})) AS vp, {yaw} AS vy, 90e0 / CASE WHEN {zoom} > 0 THEN {zoom} ELSE 1e0 END AS wide FROM t),
a AS (SELECT *, {signed('yaw - vy')} AS turn, least(90e0, greatest(-90e0, pitch)) - vp AS rise, tan(radians(least(179e0, greatest(1e0, wide)) / 2)) AS half FROM s),
n AS (SELECT *, CASE WHEN abs(turn) < 89 THEN tan(radians(turn)) / half END AS x, CASE WHEN abs(turn) < 89 THEN -tan(radians(rise)) / (half * height / width) END AS y, least(1e0, greatest(0e0, x_ratio)) * width AS ix, least(1e0, greatest(0e0, y_ratio)) * height AS iy FROM a)"""


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*split_columns(DRAWN))


@query(stage(f"CASE WHEN {OWN} THEN 5e0 ELSE view_pitch END", f"CASE WHEN {OWN} THEN own_yaw ELSE view_yaw END", f"CASE WHEN {OWN} THEN 2e0 ELSE zoom END")
       + f""", m AS (SELECT event_id, CASE WHEN width > 0 THEN CASE WHEN flat AND ix IS NOT NULL AND iy IS NOT NULL AND x_ratio IS NOT NULL AND y_ratio IS NOT NULL THEN ix WHEN NOT (flat AND auto) AND abs(x) <= 1.2 AND abs(y) <= 1.2 THEN (x + 1) / 2 * width END END AS x,
CASE WHEN width > 0 THEN CASE WHEN flat AND x_ratio IS NOT NULL AND y_ratio IS NOT NULL THEN iy WHEN NOT (flat AND auto) AND abs(x) <= 1.2 AND abs(y) <= 1.2 THEN (y + 1) / 2 * height END END AS y FROM n) SELECT event_id, {rounded('x', '1e3')} AS x, {rounded('y', '1e3')} AS y FROM m""")
def geo_marker_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = screen.marker(c("yaw"), c("pitch"), c("view_yaw"), c("view_pitch"), c("zoom"), c("width"), c("height"), flat=c("flat"), x_ratio=c("x_ratio"), y_ratio=c("y_ratio"), auto=c("auto"),
                       own_yaw=c("own_yaw"), own_pitch=F.lit(5.0), own_zoom=F.lit(2.0))
    return drawn(spark, sf_dir).select("event_id", at.alias("at")).select("event_id", fixed(c("at.x"), 3).alias("x"), fixed(c("at.y"), 3).alias("y"))


@query(stage("view_pitch", "view_yaw", "zoom") + f""", f AS (SELECT *, CASE WHEN abs(x) < 0.001 AND abs(y) < 0.001 THEN -0.001 ELSE y END AS yy, least(1e0, greatest(0e0, (abs(turn) - 90) / 90)) AS back, sin(radians(turn)) AS dx, CASE WHEN abs(sin(radians(turn))) < 0.001 AND abs(sin(radians(rise))) < 0.001 THEN -1e0 ELSE -sin(radians(rise)) END AS dy FROM n),
g AS (SELECT *, least(1e0, 0.92 / greatest(abs(x), abs(yy), 0.001)) AS pull, sqrt(dx * dx + dy * dy) AS far FROM f),
p AS (SELECT *, CASE WHEN NOT has_target THEN width / 2 WHEN flat THEN CASE WHEN x_ratio IS NOT NULL AND y_ratio IS NOT NULL THEN ix END WHEN yaw IS NULL THEN NULL WHEN x IS NOT NULL THEN (x * pull + 1) / 2 * width WHEN abs(turn) > 90 THEN width / 2 + CASE WHEN turn >= 0 THEN 1 ELSE -1 END * width * (0.18 + 0.28 * back) ELSE width / 2 + dx / far * 100 END AS px,
  CASE WHEN NOT has_target THEN height / 2 WHEN flat THEN CASE WHEN x_ratio IS NOT NULL AND y_ratio IS NOT NULL THEN iy END WHEN yaw IS NULL THEN NULL WHEN x IS NOT NULL THEN (yy * pull + 1) / 2 * height WHEN abs(turn) > 90 THEN height * (0.78 + 0.12 * back) ELSE height / 2 + dy / far * 100 END AS py FROM g),
q AS (SELECT *, CASE WHEN sqrt((px - width / 2) ** 2 + (py - height) ** 2) < 1 THEN 0e0 ELSE px - width / 2 END AS rx, CASE WHEN sqrt((px - width / 2) ** 2 + (py - height) ** 2) < 1 THEN -1e0 ELSE py - height END AS ry FROM p),
z AS (SELECT *, coalesce(list_min(list_filter([CASE WHEN abs(rx) > 0.001 THEN (0 - width / 2) / rx END, CASE WHEN abs(rx) > 0.001 THEN (width - width / 2) / rx END, CASE WHEN abs(ry) > 0.001 THEN (0 - height) / ry END], lambda t: t > 0)), 1e0) AS t FROM q)
SELECT event_id, CASE WHEN width > 0 AND px IS NOT NULL THEN {rounded('greatest(0e0, least(width, width / 2 + rx * t))', '1e3')} END AS x, CASE WHEN width > 0 AND px IS NOT NULL THEN {rounded('greatest(0e0, least(height, height + ry * t))', '1e3')} END AS y FROM z""")
def geo_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = screen.guide(c("yaw"), c("pitch"), c("view_yaw"), c("view_pitch"), screen.view_of(c("zoom")), c("width"), c("height"), has_target=c("has_target"), flat=c("flat"), x_ratio=c("x_ratio"), y_ratio=c("y_ratio"))
    return drawn(spark, sf_dir).select("event_id", at.alias("at")).select("event_id", fixed(c("at.x"), 3).alias("x"), fixed(c("at.y"), 3).alias("y"))


# EXIF bytes

TAGGED = "p_partkey, p_name AS said, CASE WHEN p_size % 5 = 0 THEN 'ab' ELSE p_brand END AS software, CASE WHEN p_size % 7 <> 0 THEN '2025:03:04 05:06:07' END AS made_at, p_partkey * 37 % 1800 / 7e0 - 100e0 AS lat, p_partkey * 91 % 3600 / 11e0 - 160e0 AS lon"


def le(x: str, n: int = 4) -> str:
    """SQL of a number's bytes in hex, lowest first."""
    return "(" + " || ".join(f"printf('%02X', CAST({x} AS BIGINT) // {256**k} % 256)" for k in range(n)) + ")"


def exif_sql(versioned: bool) -> str:
    extra = 12 if versioned else 0
    dms = lambda x: f"({le(f'floor(abs({x}))')} || '01000000' || {le(f'floor((abs({x}) - floor(abs({x}))) * 60)')} || '01000000' || {le(f'round_even(((abs({x}) - floor(abs({x}))) * 60 - floor((abs({x}) - floor(abs({x}))) * 60)) * 60 * 1000000, 0)')} || '40420F00')"
    field = lambda tag, v, at: f"'{tag}0200' || {le(f'len({v}) // 2')} || CASE WHEN len({v}) <= 8 THEN rpad({v}, 8, '0') ELSE {le(at)} END"
    apart = lambda v: f"CASE WHEN len({v}) <= 8 THEN '' ELSE {v} END"
    size = lambda v: f"CASE WHEN len({v}) <= 8 THEN 0 ELSE len({v}) // 2 END"
    version = "'000001000400000002030000' || " if versioned else ""
    count = "0600" if versioned else "0500"
    return f"""WITH t AS (SELECT {TAGGED} FROM part), h AS (SELECT *, abs(lat) <= 90 AND abs(lon) <= 180 AS ok, hex(encode(said)) || '00' AS a, hex(encode(software)) || '00' AS b, hex(encode(coalesce(made_at, ''))) || '00' AS c FROM t),
o AS (SELECT *, CASE WHEN ok THEN 8 + 2 + 4 * 12 + 4 + 2 + 5 * 12 + {extra} + 4 ELSE 8 + 2 + 3 * 12 + 4 END AS at_a FROM h), p AS (SELECT *, at_a + {size('a')} AS at_b FROM o), q AS (SELECT *, at_b + {size('b')} AS at_c FROM p), r AS (SELECT *, at_c + {size('c')} AS at_d FROM q)
SELECT p_partkey, '45786966000049492A0008000000' || CASE WHEN ok THEN '0400' ELSE '0300' END || {field('0E01', 'a', 'at_a')} || {field('3101', 'b', 'at_b')} || {field('3201', 'c', 'at_c')} || CASE WHEN ok THEN '2588040001000000' || {le('8 + 2 + 4 * 12 + 4')} ELSE '' END || '00000000'
|| CASE WHEN ok THEN '{count}' || {version}'0100020002000000' || CASE WHEN lat >= 0 THEN '4E000000' ELSE '53000000' END || '0200050003000000' || {le('at_d')} || '0300020002000000' || CASE WHEN lon >= 0 THEN '45000000' ELSE '57000000' END || '0400050003000000' || {le('at_d + 24')} || '1200020007000000' || {le('at_d + 48')} || '00000000' ELSE '' END
|| {apart('a')} || {apart('b')} || {apart('c')} || CASE WHEN ok THEN {dms('lat')} || {dms('lon')} || '5747532D383400' ELSE '' END AS payload FROM r"""


def payloads(spark: SparkSession, sf_dir: str, versioned: bool) -> DataFrame:
    c = F.col
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").selectExpr(*split_columns(TAGGED))
    return rows.withColumn("payload", exif.exif(c("said"), c("software"), c("made_at"), c("lat"), c("lon"), versioned))


@query(exif_sql(True))
def geo_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole payloads, in hex, with the version entry."""
    return payloads(spark, sf_dir, True).select("p_partkey", F.hex("payload").alias("payload"))


@query(exif_sql(False))
def geo_exif_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole payloads, in hex, without the version entry."""
    return payloads(spark, sf_dir, False).select("p_partkey", F.hex("payload").alias("payload"))


@query(f"""WITH t AS (SELECT {TAGGED} FROM part) SELECT p_partkey, said AS description, software, coalesce(made_at, '') AS made_at, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN {rounded('lat', '1e5')} END AS lat, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN {rounded('lon', '1e5')} END AS lon FROM t""")
def geo_exif_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from pictures that the payloads were put into."""
    pictures = payloads(spark, sf_dir, True).select("p_partkey", exif.read_exif(exif.insert(F.unhex(F.lit("FFD8FFDB000400FFD9")), F.col("payload"))).alias("x"))
    return pictures.select("p_partkey", "x.description", "x.software", "x.made_at", fixed(F.col("x.lat"), 5).alias("lat"), fixed(F.col("x.lon"), 5).alias("lon"))


# a state's list of targets

FACTS = "35e0 + (event_id % 1000) / 1e4 AS lat, 136e0 + (event_id * 7 % 1000) / 1e4 AS lon, (event_id * 17 % 3600) / 10e0 AS heading, (event_id * 7 % 3600) / 10e0 AS state_yaw"


@query(f"""WITH s AS (SELECT event_id, (event_id * 17 % 3600) / 10e0 AS heading, CASE WHEN event_id % 4 = 0 THEN [NULL] WHEN event_id % 4 = 1 THEN NULL ELSE [{{'k': 1}}, NULL, {{'k': 2}}, {{'k': 3}}] END AS l, event_id % 5 <> 0 AS single FROM events),
f AS (SELECT *, CASE WHEN event_id % 4 > 1 THEN [1, 2, 3] WHEN single THEN [9] ELSE [] END AS ks FROM s), e AS (SELECT event_id, heading, unnest(ks) AS k, generate_subscripts(ks, 1) - 1 AS place FROM f)
SELECT event_id, CAST(place AS INTEGER) AS place, CAST(k AS BIGINT) AS id, {rounded(mod('heading + k * 31 % 360'))} AS bearing, floor((1e0 + k) * 1e3 + 0.5) / 1e3 AS metres FROM e""")
def geo_project_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target of every state: the list's, or the single one where the list has none."""
    kinds = {"target_yaw": "DOUBLE", "ground_m": "DOUBLE", "projection": "STRING"}
    made = lambda k: f"named_struct('id', CAST({k} AS BIGINT), 'order', CAST({k} AS BIGINT), " + ", ".join(f"'{f}', " + {"target_yaw": f"CAST({k} * 31 % 360 AS DOUBLE)", "ground_m": f"CAST(1 + {k} AS DOUBLE)"}.get(f, f"CAST(NULL AS {kinds.get(f, 'DOUBLE')})") for f in project.TARGET_FIELDS) + ")"
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", *split_columns(FACTS), "CAST(NULL AS DOUBLE) AS state_zoom", "CAST(NULL AS DOUBLE) AS state_offset", "CAST(NULL AS DOUBLE) AS camera_height_m", "CAST(NULL AS DOUBLE) AS hud_scale",
        f"CASE WHEN event_id % 5 <> 0 THEN {made(9)} END AS target", f"CASE event_id % 4 WHEN 0 THEN array(CASE WHEN event_id < 0 THEN {made(1)} END) WHEN 1 THEN NULL ELSE array({made(1)}, CASE WHEN event_id < 0 THEN {made(1)} END, {made(2)}, {made(3)}) END AS targets",
    )
    found = project.project_state_targets(rows)
    return found.select("event_id", "place", "id", fixed(F.col("bearing"), 6).alias("bearing"), fixed(F.col("distance_m"), 3).alias("metres"))
