"""Streams of states that had no test, chosen files, drawn places, EXIF bytes."""

from __future__ import annotations

import datetime as dt
import math
import struct

import pytest
from pyspark.sql import functions as F

from trackloom.functions import exif, screen
from trackloom.operators import keyed, project
from trackloom.operators.trajectory import step
from trackloom.sources import fallback
from trackloom.streaming import state as streams


def in_parts(spark, folder, parts, schema: str, apply) -> list[tuple]:
    """What a stream gives over some batches, stopped and gone on between them."""
    got: list[tuple] = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        q = apply(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
    return got


def test_changes_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), ("a", 3, "z"), ("b", 2, "y"), ("a", 4, "z"), ("b", 3, None), ("a", 5, "x")]
    got = in_parts(spark, tmp_path, [rows[:4], rows[4:]], "video string, seq bigint, signature string", lambda s: streams.changes_stream(s, life_ms=None))
    table = streams.changes(spark.createDataFrame(rows, "video string, seq bigint, signature string"), F.col("signature"))
    assert sorted(got, key=str) == sorted(map(tuple, table.select("video", "seq", "signature").collect()), key=str)


def test_held_headings_go_on_over_batches(spark, tmp_path):
    rows = [("a", k, k * 3, None if k % 3 == 0 else 10.0 * k, float(k % 5)) for k in range(12)]
    want, held, radius, last = [], None, None, None
    for video, seq, frame, now, metres in rows:
        held, radius = step(held, radius, last, frame, now, metres)
        last = frame
        want.append((video, seq, held, radius))
    schema = "video string, seq bigint, frame bigint, heading double, distance_m double"
    got = in_parts(spark, tmp_path, [rows[:5], rows[5:]], schema, lambda s: streams.held_headings_stream(s, life_ms=None))
    assert sorted((r[0], r[1], r[5], r[6]) for r in got) == want


def test_commands_are_new_once(spark, tmp_path):
    at = lambda minute: dt.datetime(2025, 1, 1, 0, minute, tzinfo=dt.UTC)
    parts = [[("c1", at(0)), ("c1", at(1)), ("c2", at(1))], [("c1", at(2)), ("c3", at(2))]]
    got = in_parts(spark, tmp_path, parts, "command_id string, ts timestamp", streams.new_commands)
    assert sorted(r[0] for r in got) == ["c1", "c2", "c3"]


def test_a_video_is_forgotten_when_its_time_is_over(spark, tmp_path):
    schema = "video string, seq bigint, signature string"
    spark.createDataFrame([("a", 1, "x")], schema).write.parquet(f"{tmp_path}/in")
    stream = streams.changes_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), life_ms=500)
    q = stream.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            if (p := q.lastProgress) and p["stateOperators"] and spark.table("forgotten").count() and p["stateOperators"][0]["numRowsTotal"] == 0:
                break
        assert p["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()


def test_stored_markings_of_a_stream(spark, tmp_path):
    schema = "video string, frame bigint, target_id bigint, target_order bigint, target_yaw double, target_pitch double, created_at string"
    table = f"file:{tmp_path}/table"
    for k, rows in enumerate([[("v", 1, 1, 1, 0.0, 0.0, "a"), ("v", 1, 1, 1, 9.0, 0.0, "b")], [("v", 1, 1, 1, 5.0, 0.0, "c"), ("v", 2, 1, 1, 5.0, 0.0, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(streams.store_markings(spark, table)).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        assert keyed.version(spark, table).note == k
    assert sorted((r.frame, r.created_at) for r in keyed.read(spark, table).collect()) == [(1, "a"), (2, "d")]


def test_files_are_chosen_and_read_in_one_scan(spark, tmp_path):
    session, video = tmp_path / "session", tmp_path / "video"
    session.mkdir()
    video.mkdir()
    (video / "one_frames.csv").write_text("frame,latitude\n1,35.5\nx,1\n2,\n")
    (session / "far.csv").write_bytes("frame_index;名\n7;駅\n".encode("cp932"))
    (session / "z_navigation.json").write_text('{"video": "/data/two.mp4", "frames_csv": "far.csv"}')
    (session / "a_navigation.json").write_text("[]")
    (video / "two_navigation.json").write_text('{"video": "other.mp4", "frames_csv": "one_frames.csv"}')
    (video / "any_navigation.json").write_text('{"frames_csv": "one_frames.csv"}')
    videos = spark.createDataFrame([("one.mp4",), ("two.mp4",), ("three.mp4",)], "video string")
    rows = fallback.read_rows(spark, [str(session / "*.csv"), str(video / "*.csv")])
    documents = fallback.read_documents(spark, [f"{session}/*.json", f"{video}/*.json"])
    chosen = fallback.first_files(fallback.frames_candidates(videos, documents, [f"file:{session}", f"file:{video}"]), rows, videos)
    told = sorted((r.video, r.path.rsplit("/", 1)[1]) for r in chosen.collect())
    assert told == [("one.mp4", "one_frames.csv"), ("three.mp4", "one_frames.csv"), ("two.mp4", "far.csv")]
    frames = sorted((r.video, r.frame, r.row) for r in fallback.frames_of(chosen, rows).collect())
    assert frames == [("one.mp4", 1, 1), ("one.mp4", 2, 3), ("three.mp4", 1, 1), ("three.mp4", 2, 3), ("two.mp4", 7, 1)]
    assert {r.fields["名"] for r in rows.collect() if "名" in r.fields} == {"駅"}


def test_first_matched_file_with_frames_counts(spark):
    rows = spark.createDataFrame([("/a", {"frame_index": "x"}), ("/a", {"other": "1"}), ("/b", {"frame_index": "3.7"}), ("/b", {"frame_index": "3"}), ("/b", {"frame_index": None}), ("/c", {"frame_index": "9"})], "path string, fields map<string,string>")
    candidates = spark.createDataFrame([("v", 0, "/none"), ("v", 1, "/a"), ("v", 2, "/b"), ("v", 3, "/c"), ("w", 0, "/a")], "video string, rank int, path string")
    assert sorted(map(tuple, fallback.first_matched(candidates, rows).collect())) == [("v", 3, "/b")]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_markers_and_guides(spark):
    n = lambda *x: [F.lit(float(v)) for v in x]
    at = value(spark, screen.marker(*n(10, 0, 0, 0, 1, 800, 600)))
    assert at.x == pytest.approx(400 * (1 + math.tan(math.radians(10)))) and at.y == pytest.approx(300)
    assert value(spark, screen.marker(*n(95, 0, 0, 0, 1, 800, 600))) is None and value(spark, screen.marker(*n(10, 0, 0, 0, 1, 0, 600))) is None
    assert value(spark, screen.marker(*n(10, 0, 0, 0, 1, 800, 600), flat=True, auto=True)) is None
    assert value(spark, screen.marker(*n(10, 0, 0, 0, 1, 800, 600), flat=True, auto=True, x_ratio=F.lit(2.0), y_ratio=F.lit(0.5))) == (800.0, 300.0)
    assert value(spark, screen.guide(*n(0, 0, 0, 0, 90, 800, 600), has_target=False)) == (400.0, 0.0)
    assert value(spark, screen.guide(F.lit(float("nan")), *n(0, 0, 0, 90, 800, 600))) is None
    behind = value(spark, screen.guide(*n(180, 0, 0, 0, 90, 800, 600)))
    assert behind.x == 0.0 and 0 < behind.y < 600  # a turn of half a circle counts as to the left


def test_exif_reads_back(spark):
    rows = [("駅 a", "", None, 35.5, -136.25), ("abc", "s", "2025:01:02 03:04:05", None, 1.0), ("x", "y", "z", float("nan"), 1.0), ("", "", "", -90.0, 180.0)]
    df = spark.createDataFrame(rows, "d string, s string, m string, lat double, lon double")
    payload = exif.exif(*[F.col(c) for c in df.columns])
    got = df.select(payload.alias("p"), exif.read_exif(exif.insert(F.unhex(F.lit("FFD8FFD9")), payload)).alias("x"), exif.insert(F.lit(b"no picture"), payload).alias("same")).collect()
    assert [(r.x.description, r.x.software, r.x.made_at) for r in got] == [("? a", "", ""), ("abc", "s", "2025:01:02 03:04:05"), ("x", "y", "z"), ("", "", "")]
    assert [(r.x.lat, r.x.lon) for r in got] == [(35.5, -136.25), (None, None), (None, None), (-90.0, 180.0)]
    assert all(bytes(r.same) == b"no picture" for r in got)
    assert struct.unpack_from("<HHI", bytes(got[0].p), 14) == (4, 0x010E, 0x00040002)  # entries of the first directory, then its first entry
    assert value(spark, exif.read_exif(F.lit(b"\xff\xd8\xff\xd9"))) is None
    long = value(spark, exif.insert(F.unhex(F.lit("FFD8FFD9")), exif.exif(F.repeat(F.lit("x"), 70_000), *[F.lit(None)] * 2, F.lit(1.0), F.lit(1.0))))
    assert bytes(long) == b"\xff\xd8\xff\xd9"  # more than a segment holds


def test_targets_of_states(spark):
    kind = "struct<id:bigint,order:bigint," + ",".join(f"{f}:{'string' if f == 'projection' else 'double'}" for f in project.TARGET_FIELDS) + ">"
    target = lambda k, yaw: (k, k, yaw, *[None] * (len(project.TARGET_FIELDS) - 1))
    facts = (35.0, 136.0, 90.0, None, None, None, None, None)
    rows = [(1, *facts, target(9, 10.0), [target(1, 0.0), None, target(2, None)]), (2, *facts, target(9, 10.0), [None]), (3, *facts, target(9, 10.0), None), (4, *facts, None, [])]
    columns = "n int, lat double, lon double, heading double, state_yaw double, state_zoom double, state_offset double, camera_height_m double, hud_scale double"
    found = project.project_state_targets(spark.createDataFrame(rows, f"{columns}, target {kind}, targets array<{kind}>"))
    assert sorted((r.n, r.place, r.id, r.bearing) for r in found.collect()) == [(1, 0, 1, 90.0), (2, 0, 9, 100.0), (3, 0, 9, 100.0)]  # one without a direction has no point
