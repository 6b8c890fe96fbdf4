"""Viewer documents, sources, sinks and streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from trackloom.functions import text, times
from trackloom.operators import export, validate
from trackloom.sources import geopackage, gpx, tables
from trackloom.streaming import state as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def validated(spark, document):
    rows = spark.createDataFrame([(json.dumps(document) if document is not None else "not json",)], "text string").select(validate.parse_document(F.col("text")).alias("document"))
    return validate.state(rows).select("error", "state").first()


@pytest.mark.parametrize(("raw", "value"), [("nan", None), ("Infinity", None), ("1e999", None), ("0", 0.0), ("１,２３４.５", 1234.5), ("1.5d", None), ("", None), (None, None), (" 7 ", 7.0)])
def test_parse_float(spark, raw, value):
    assert one(spark, text.parse_float(F.lit(raw).cast("string"))) == value


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("2025-03-24T13:08:49Z", "2025-03-24 13:08:49"), ("2025-03-24 22:08:49.25 JST", "2025-03-24 13:08:49.25"), ("2025年3月24日 13時08分49秒", "2025-03-24 13:08:49"),
        ("2025/03/24 13:08", "2025-03-24 13:08:00"), ("20250324130849", "2025-03-24 13:08:49"), ("20250324T130849.5+0900", "2025-03-24 04:08:49.5"), ("5", "1970-01-01 00:00:05"),
        ("1742821729", "2025-03-24 13:08:49"), ("1742821729500", "2025-03-24 13:08:49.5"), ("2025-03-24", "2025-03-24 00:00:00"), ("soon", None), (None, None), ("2025-13-44", None),
        ("'2025/3/4  1:02:03 +09'", "2025-03-03 16:02:03"), ("2025年3月4日5時6分7秒", "2025-03-04 05:06:07"), ("2025-3-4_5:6", "2025-03-04 05:06:00"), ("20250324_130849-0130", "2025-03-24 14:38:49"), ("2025-03-24 13:08:49,5 utc", "2025-03-24 13:08:49.5"),
    ],
)
def test_time_texts(spark, raw, value):
    got = one(spark, times.parse(F.lit(raw).cast("string")))
    assert (str(got).rstrip("0") if got is not None and "." in str(got) else got if got is None else str(got)) == value


def test_class_filters_and_settings(spark):
    from trackloom.operators import layers, settings

    named = lambda subset: one(spark, layers.subset_classes(F.lit(subset).cast("string")))
    assert named("\"x\" > 1 AND semantic_class = ' pole ' OR semantic_class IN ('a','b')") == ["pole"]
    assert named("SEMANTIC_CLASS like 'sign'") == ["sign"] and named("semantic_class = ' ' or semantic_class in (\"b\", 'a', 'b')") == ["a", "b"]
    assert named("semantic_class > 3") == [] and named(None) == [] and named("") == []
    text = lambda v: F.lit(v).cast("string")
    wrong = one(spark, settings.viewer_errors(text(" "), text("0"), text("x"), text(None), text("1e9"), text("1")))
    assert [tuple(e) for e in wrong] == [("host", "missing", None, None), ("port", "range", 1.0, 65535.0), ("jpeg_quality", "unreadable", None, None), ("camera_height_m", "range", 0.1, 20.0)]
    assert [e.rule for e in one(spark, settings.process_errors(text("a.GPX"), text(None), text("t.txt"), text("1.5"), text("-1")))] == ["missing", "kind", "unreadable", "range"]
    assert one(spark, settings.radar_errors(*[text(None)] * 5)) == []


def test_state_with_dirty_numbers(spark):
    target = {"yaw_delta_deg": "190", "target_yaw_to_camera_heading": "-10", "view_yaw_to_camera_heading": "725", "view_pitch": "-95", "view_zoom": "0", "projection": "odd"}
    got = validated(spark, {"video": "abc.mp4", "frame_index": "11", "yaw_to_camera_heading": "370", "pitch": "3", "target": target})
    assert got.error is None
    s = got.state
    assert (s.frame_index, s.yaw_to_camera_heading, s.target.yaw_delta_deg, s.target.target_yaw_to_camera_heading) == (11, 10.0, -170.0, 350.0)
    assert (s.target.view_yaw_to_camera_heading, s.target.view_pitch, s.target.view_zoom, s.target.projection) == (5.0, -90.0, 0.01, "ground_plane")
    assert (s.target.x_ratio, s.target.y_ratio, s.zoom, s.viewer_camera_height_m) == (0.5, 0.5, 1.0, 1.5)


def test_targets_get_their_places_and_the_last_one_counts(spark):
    ok = {"target_yaw_to_camera_heading": 1}
    got = validated(spark, {"video": "a.mp4", "frame_index": 0, "yaw_to_camera_heading": 0, "targets": [ok, {"x_ratio": 1}, {**ok, "id": 8, "order": 8}, *[ok] * 200]}).state
    assert [t.id for t in got.targets[:3]] == [1, 8, 3] and len(got.targets) == 99 and got.target == got.targets[-1]


@pytest.mark.parametrize("document", [None, {}, {"video": "a/b.mp4", "frame_index": 1, "yaw_to_camera_heading": 0}, {"video": "a.mp4", "frame_index": -1, "yaw_to_camera_heading": 0}, {"video": "a.mp4", "frame_index": 1}])
def test_refused_states(spark, document):
    got = validated(spark, document)
    assert got.error and got.state is None


def test_radar(spark):
    def radar(d):
        rows = spark.createDataFrame([(json.dumps({"radar": d}),)], "text string").select(validate.parse_document(F.col("text")).alias("d"))
        return rows.select(validate.radar(F.col("d.radar")).alias("r")).first().r

    good = radar({"range_m": 10, "base_sector_radius_m": -1, "outer_range_m": 3, "min_zoom_multiplier": 2, "max_zoom_multiplier": 1})
    assert (good.range_m, good.outer_range_m, good.base_sector_radius_m, good.max_zoom_multiplier, good.calibration_fov_deg) == (10, 10, 0, 2, 90)
    assert radar({"range_m": 10}) is None and radar({"range_m": "x", "base_sector_radius_m": 1}) is None


GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>
<trkpt lat="35.0" lon="136.0"><time>2025-03-24T13:08:49Z</time></trkpt>
<trkpt lat="35.1" lon="136.1"><extensions><gps_date>2025/03/24</gps_date><hms>13:08:50</hms></extensions></trkpt>
<trkpt lat="nan" lon="136.1"><time>2025-03-24T13:08:51Z</time></trkpt>
<trkpt lat="35.2" lon="136.2"><time>soon</time></trkpt><trkpt lat="35.2" lon="136.2"/></trkseg></trk>
<rte><rtept lat="35.3" lon="136.3" when="2025-03-24 13:08:52"/></rte><wpt lat="1" lon="1"><time>2025-03-24T13:08:49Z</time></wpt></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    rows = gpx.read_gpx(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(str(r.ts)[11:], r.lat) for r in rows] == [("13:08:49", 35.0), ("13:08:50", 35.1), ("13:08:52", 35.3)]
    d = gpx.diagnose(spark, str(tmp_path)).first()
    assert (d.point_count, d.missing_time_count, d.bad_time_count, d.time_samples) == (6, 1, 1, ["soon"])


def test_gpx_with_entities_is_refused():
    with pytest.raises(gpx.Unsafe):
        list(gpx.points(b'<!DOCTYPE x [<!ENTITY a "b">]><gpx><trkpt lat="1" lon="1"/></gpx>'))


def test_reference_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("名称;id;緯度;経度\nx;;35,1;136\n;7;35.2;136.2\n;;bad;1\n;;35.4;136.4\n".replace("35,1", "35.1").replace("名称", "label").encode("cp932"))
    rows = tables.references(tables.read_csv(spark, str(tmp_path / "r.csv"))).orderBy("ref_idx").collect()
    assert [(r.ref_idx, r.reference_label, r.lat) for r in rows] == [(1, "x", 35.1), (2, "7", 35.2), (4, "4", 35.4)]
    with pytest.raises(ValueError, match="latitude"):
        tables.references(spark.createDataFrame([("1", 1)], "a string, __row int"))
    assert tables.find_field(["any", "lat"], tables.LATITUDE) == "lat" and tables.find_field(["my_latitude_deg"], tables.LATITUDE) == "my_latitude_deg"
    assert tables.find_field(["my_latitude_deg"], tables.LATITUDE, strict=True) is None


def test_frame_records_and_navigation(spark):
    rows = spark.createDataFrame(
        [(1, "11", "", "n", "35.1", "136.2", "35.3", "136.4"), (2, "11", "z", "z", "1", "1", "1", "1"), (3, "12", "", "", "35", "136", "", "136"), (4, "x", "", "", "1", "1", "1", "1"), (5, "20", "k", "", "", "1", "", "")],
        "__row int, frame_index string, kp string, reference_name string, latitude string, longitude string, aligned_latitude string, aligned_longitude string",
    )
    got = {r.frame: (r.label, r.lat, r.lon) for r in tables.frame_records(rows).collect()}
    assert got == {11: ("n", 35.3, 136.4), 12: ("", 35.0, 136.0), 20: ("k", None, None)}
    nav = tables.navigation_payload(tables.frame_records(rows), 12).first()
    assert (nav.previous, nav.next, nav["count"], nav.lat) == (11, 20, 3, 35.0)
    assert sorted(r.frame for r in tables.matched_frames(spark.createDataFrame([("3",), ("-1",), ("2.5",), ("3",), (None,)], "frame_index string")).collect()) == [3]


def test_metadata_and_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    geopackage.write_metadata(path, {"fps": "29.97", "mode": '"kp"', "raw": "not json"})
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        db.executemany("INSERT INTO gpkg_contents VALUES (?, ?)", [("roads", "features"), ("poi_candidates_360", "features"), ("m", "attributes")])
    got = {r.key: r.value for r in tables.metadata(geopackage.read_table(spark, path, geopackage.METADATA_TABLE)).collect()}
    assert got == {"fps": "29.97", "mode": "kp", "raw": "not json"}
    assert geopackage.feature_tables(path) == ["poi_candidates_360", "roads"] and geopackage.feature_tables(path, True) == ["poi_candidates_360"]


def test_exports(spark, tmp_path):
    frames = spark.sql("SELECT 'v' AS video, 1000L AS frame, 998L AS source_frame, TIMESTAMP_NTZ'2025-03-24 13:08:49.123456' AS ts, 35D AS latitude, 136D AS longitude, 35.1D AS aligned_latitude, 136.1D AS aligned_longitude, 'k' AS kp, '1' AS reference_id, 'k' AS reference_name, 'k' AS reference_label, 2.5D AS kp_distance_m, 35.1D AS kp_latitude, 136.1D AS kp_longitude, 1 AS kp_match"
                       " UNION ALL SELECT 'v', 1001L, 999L, TIMESTAMP_NTZ'2025-03-24 13:08:50', 35D, 136D, 35D, 136D, '', '', '', '', NULL, NULL, NULL, 0")  # fmt: skip
    rows = export.frames_table(frames, 2).orderBy("frame").collect()
    assert (rows[0].image_path, rows[0].timestamp, rows[0].latitude, rows[0].kp_distance_m) == ("0001/frame_0001000.jpg", "2025-03-24T13:08:49.123Z", "35.000000000", "2.500")
    assert (rows[1].kp_distance_m, rows[1].kp_latitude) == ("", "")
    assert export.matched_table(frames).count() == 1
    document = json.loads(export.navigation_json(frames).first().document)
    assert document["node_count"] == 1 and document["nodes"][0]["frame"] == 1000
    out = str(tmp_path / "frames")
    assert export.existing(spark, [out]) == []
    export.write_csv(export.frames_table(frames), out)
    assert export.existing(spark, [out]) == [out] and spark.read.option("header", True).csv(out).count() == 2


STATES = [
    ("a", 1, 5, 1.0, 0.0, 1.0, 2.0, None, None, "r1", "t1", None, False), ("a", 2, 5, 2.0, 0.0, 1.0, None, None, 7.0, None, None, None, True), ("a", 3, 5, 3.0, 0.0, 1.0, None, None, None, None, None, None, False),
    ("a", 4, 6, 4.0, 0.0, 1.0, None, None, None, None, None, None, True), ("b", 1, 5, 1.0, 0.0, 1.0, None, None, None, None, "x", None, False),
]
STATE_COLUMNS = streams.SCHEMA + ", view_only boolean"


def test_stream_of_states_equals_the_table(spark, tmp_path):
    states = spark.createDataFrame(STATES, STATE_COLUMNS)
    want = sorted(map(tuple, streams.merge_states_batch(states).collect()), key=lambda r: r[:2])
    by_seq = {r[:2]: r for r in want}
    assert by_seq["a", 2][6] == 2.0 and by_seq["a", 2][10] == "t1" and by_seq["a", 3][10] is None and by_seq["a", 3][8] == 7.0 and by_seq["a", 4][9] is None
    for k in (1, 2):  # two batches
        states.where(f"seq {'<=' if k == 1 else '>'} 2").coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    source = spark.readStream.schema(STATE_COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = streams.merge_states(source, life_ms=None).writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("merged").collect()), key=lambda r: r[:2]) == want


def test_changes_and_view_equality(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 2.0)], "video string, seq int, yaw double")
    got = streams.changes(rows, streams.signature(F.round("yaw", 3))).select("video", "seq").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 3), ("b", 1)]
    zero = F.lit(0.0)
    assert one(spark, streams.view_equal(F.lit(359.999), zero, F.lit(1.0), F.lit(0.001), zero, F.lit(1.0))) is True
