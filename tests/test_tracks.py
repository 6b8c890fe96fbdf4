"""Resampling, matching and headings on small tracks worked out by hand, and properties over random ones."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators import match, navigate, resample, trajectory

T0 = datetime(2025, 3, 24, 13, 8, 49)


def tracks(spark, rows):
    return spark.createDataFrame(rows, "track_id string, ts timestamp_ntz, lat double, lon double")


def test_three_points_at_two_frames_a_second(spark):
    track = tracks(spark, [("a", T0, 35.0, 136.0), ("a", T0 + timedelta(seconds=1), 35.1, 136.0), ("a", T0 + timedelta(seconds=2), 35.1, 136.2)])
    videos = spark.createDataFrame([("a", 2.0, 10)], "track_id string, fps double, frame_count int")
    rows = resample.resample(track, videos).orderBy("source_frame").collect()
    assert [r.source_frame for r in rows] == [0, 1, 2, 3]
    assert [(round(r.lat, 6), round(r.lon, 6)) for r in rows] == [(35.0, 136.0), (35.05, 136.0), (35.1, 136.0), (35.1, 136.1)]
    assert rows[1].ts == T0 + timedelta(seconds=0.5)
    shifted = resample.shift_frames(resample.resample(track, videos), videos, -2).orderBy("frame").collect()
    assert [(r.frame, r.source_frame) for r in shifted] == [(0, 2), (1, 3)]


def test_equal_times_and_empty_tracks(spark):
    track = tracks(spark, [("a", T0, 35.0, 136.0), ("a", T0, 35.0, 135.0), ("a", T0 + timedelta(seconds=1), 36.0, 136.0), ("b", T0, 1.0, 1.0)])
    videos = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 10)], "track_id string, fps double, frame_count int")
    rows = resample.resample(track, videos).collect()
    assert [(r.track_id, r.source_frame, r.lon) for r in rows] == [("a", 0, 136.0)]
    assert resample.resample(track.limit(0), videos).count() == 0


def test_frames_are_contiguous_whatever_the_stretches(spark):
    rng = random.Random(1)
    rows, t = [], T0
    for _ in range(60):
        t += timedelta(milliseconds=rng.randrange(1, 9000))
        rows.append(("a", t, 35 + rng.random() / 100, 136 + rng.random() / 100))
    videos = spark.createDataFrame([("a", 29.97, 100_000)], "track_id string, fps double, frame_count int")
    wide = resample.resample(tracks(spark, rows), videos).orderBy("source_frame").collect()
    narrow = resample.resample(tracks(spark, rows), videos, stretch_us=3_000_000).orderBy("source_frame").collect()
    assert wide == narrow
    assert [r.source_frame for r in wide] == list(range(len(wide)))


@pytest.mark.parametrize("most_listed", [500, 3])  # the second deals cells out to several lists
def test_nearest_reference_equals_comparison_with_all(spark, most_listed):
    rng = random.Random(2)
    refs = [(k, 35 + rng.random() / 10, 136 + rng.random() / 10) for k in range(100)]
    points = [(k, 35 + rng.random() / 10, 136 + rng.random() / 10) for k in range(500)] + [(900, None, 136.0)]
    found = match.match_references(spark.createDataFrame(points, "n int, lat double, lon double"), spark.createDataFrame(refs, "ref_idx int, lat double, lon double"), 400.0, most_listed=most_listed)
    got = {r.n: r["match"].ref_idx if r["match"] else None for r in found.collect()}

    def haversine(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(x))

    for n, lat, lon in points:
        if lat is None:
            assert got[n] is None
            continue
        k, y, x = min(refs, key=lambda r: ((r[1] - lat) ** 2 + (r[2] - lon) ** 2, r[0]))
        assert got[n] == (k if haversine(lat, lon, y, x) <= 400 else None)
    assert len(set(got.values())) > 20


def test_geodesic_of_known_length(spark):
    row = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (50.0, 5.0, 50.0, 5.0)], "a double, b double, c double, d double")
    far, none = row.select(match.geodesic()("a", "b", "c", "d").alias("m")).collect()
    assert abs(far.m - 111_319.491) < 0.01 and none.m == 0


def test_heading_uses_the_farthest_pair_and_falls_back(spark):
    rows = [("v", f, 35.0 + f * 1e-5, 136.0) for f in (0, 1, 2, 4)] + [("v", 30, 35.0, 136.0)]
    positions = spark.createDataFrame(rows, "video string, frame bigint, lat double, lon double")
    asked = spark.createDataFrame([("v", f) for f in (0, 2, 3, 30, 50)], "video string, frame bigint")
    for stretch in (4096, 3):
        got = {r.frame: (r.heading, r.distance_m) for r in trajectory.headings(positions, asked, reach=2 if stretch == 3 else 10, stretch=stretch).collect()}
        assert abs(got[2][0]) < 1e-6 and abs(got[2][1] - 4 * 1.11319) < 0.01  # frames 0 and 4
        assert got[3][1] is not None and abs(got[3][1] - 2 * 1.11319) < 0.01  # 2 and 4, though 3 has no position
        assert got[0][0] == 0 and got[30] == (None, None) and got[50] == (None, None)


def test_held_heading_over_two_jumps(spark):
    visits = [(0, 0, 10.0, 5.0), (1, 1, 100.0, 5.0), (2, 2, 100.0, 5.0), (3, 60, 100.0, 5.0), (4, 61, 120.0, 0.1), (5, 62, None, None)]
    rows = spark.createDataFrame([("v", *v) for v in visits], "video string, seq bigint, frame bigint, heading double, distance_m double")
    got = [(r.held_heading, r.radius_m) for r in trajectory.held_headings(rows).orderBy("seq").collect()]
    assert got == [(10.0, 5.0), (10.0, 5.0), (10.0, 5.0), (100.0, 5.0), (100.0, 1.0), (100.0, 1.0)]


def test_destination_and_vector_agree(spark):
    rows = spark.range(200).select((F.rand(3) * 120 - 60).alias("lat"), (F.rand(4) * 300 - 150).alias("lon"), (F.rand(5) * 360).alias("b"), (F.rand(6) * 99 + 1).alias("d"))
    p = geo.destination(F.col("lat"), F.col("lon"), F.col("b"), F.col("d"))
    east, north = geo.local_vector(F.col("lat"), F.col("lon"), p["lat"], p["lon"])
    off = rows.select((F.abs(F.sqrt(east * east + north * north) / F.col("d") - 1)).alias("x"), geo.heading_delta(geo.heading(east, north), F.col("b")).alias("y"))
    worst = off.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    assert worst.x < 1e-3 and worst.y < 0.1


def test_steps(spark):
    frames = spark.createDataFrame([("v", f) for f in (10, 20, 30, 40)], "video string, frame bigint")
    asked = spark.createDataFrame([("v", f) for f in (5, 10, 15, 40)], "video string, frame bigint")
    ahead = {r.frame: r.target for r in navigate.step(frames, asked, 2, forward=True).collect()}
    back = {r.frame: r.target for r in navigate.step(frames, asked, 2, forward=False).collect()}
    assert ahead == {5: 20, 10: 30, 15: 30, 40: None}
    assert back == {5: None, 10: None, 15: 10, 40: 20}
    one = spark.range(1)
    step = lambda at, n: one.select(navigate.frame_step(F.lit(at), F.lit(53497), n).alias("x")).first().x
    assert (step(53071, 600), step(53496, 1), step(53496, -1)) == (53496, None, 53495)
