"""A timestamped track at a video's frame rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a track are dealt out by stretches of this many microseconds, so a long track isn't one task's.
STRETCH_US = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def segments(track: DataFrame, key: str = "track_id", stretch_us: int = STRETCH_US) -> DataFrame:
    """Consecutive points: key, us, lat, lon, us_next, lat_next, lon_next, us_first (of the whole track).

    Points are ordered by time, latitude and longitude. The track's stretches of time are sorted apart; the first point of the next stretch,
    found among one row for each stretch, closes the last segment of a stretch.
    """
    points = track.select(key, micros(F.col("ts")).alias("us"), "lat", "lon").withColumn("stretch", F.floor(F.col("us") / stretch_us))
    first = points.groupBy(key, "stretch").agg(F.min(F.struct("us", "lat", "lon")).alias("first"))
    by_stretch = Window.partitionBy(key).orderBy("stretch")
    first = first.withColumn("after", F.lead("first").over(by_stretch)).withColumn("us_first", F.first("first.us").over(by_stretch))
    inner = Window.partitionBy(key, "stretch").orderBy("us", "lat", "lon")
    joined = points.join(first.select(key, "stretch", "after", "us_first"), [key, "stretch"])
    following = F.coalesce(F.lead(F.struct("us", "lat", "lon")).over(inner), F.col("after"))
    joined = joined.withColumn("following", following).where("following is not null")
    return joined.select(
        key, "us", "lat", "lon", F.col("following.us").alias("us_next"), F.col("following.lat").alias("lat_next"), F.col("following.lon").alias("lon_next"), "us_first"
    )


def frame_at(us: Column, fps: Column) -> Column:
    """The frame at a number of microseconds, rounding half to even."""
    return F.rint(us / 1e6 * fps).cast("bigint")


def time_of(frame: Column, fps: Column) -> Column:
    """Microseconds from the video's begin at a frame, rounding half to even."""
    return F.rint(frame / fps * 1e6).cast("bigint")


def resample(track: DataFrame, videos: DataFrame, key: str = "track_id", stretch_us: int = STRETCH_US) -> DataFrame:
    """key, source_frame, ts, lat, lon: one row for each frame from the first point to before the last.

    videos: one row (key, fps, ...) for each track. Times are whole microseconds, from which fractions and frame numbers are computed;
    of equal frame numbers the latest row stays.
    """
    pairs = segments(track, key, stretch_us).join(videos.select(key, "fps"), key)
    pairs = pairs.withColumn("us_length", F.col("us_next") - F.col("us")).where("us_length > 0")
    pairs = pairs.withColumn("f0", frame_at(F.col("us") - F.col("us_first"), F.col("fps"))).withColumn("f1", frame_at(F.col("us_next") - F.col("us_first"), F.col("fps")))
    frames = pairs.where("f1 > f0").withColumn("n", F.explode(F.sequence("f0", F.col("f1") - 1)))
    frames = frames.withColumn("at", time_of(F.col("n"), F.col("fps")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at") - (F.col("us") - F.col("us_first"))) / F.col("us_length")))
    frames = frames.withColumn("share", share)
    rows = frames.select(
        key,
        frame_at(F.col("at"), F.col("fps")).alias("source_frame"),
        F.struct(
            F.col("n"), (F.col("us_first") + F.col("at")).alias("us"),
            (F.col("lat") + F.col("share") * (F.col("lat_next") - F.col("lat"))).alias("lat"), (F.col("lon") + F.col("share") * (F.col("lon_next") - F.col("lon"))).alias("lon"),
        ).alias("x"),
    )
    kept = rows.groupBy(key, "source_frame").agg(F.max("x").alias("x"))
    return kept.select(key, "source_frame", F.timestamp_micros("x.us").cast("timestamp_ntz").alias("ts"), "x.lat", "x.lon")


def shift_frames(source: DataFrame, videos: DataFrame, shift: int = 0, key: str = "track_id") -> DataFrame:
    """key, frame, source_frame, ts, lat, lon of the video's own frames; a frame without a track position is absent."""
    joined = source.join(videos.select(key, "frame_count"), key).withColumn("frame", F.col("source_frame") + F.lit(shift))
    return joined.where("frame >= 0 and frame < frame_count").select(key, "frame", "source_frame", "ts", "lat", "lon")
