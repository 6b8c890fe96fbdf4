"""Domain relations derived from the driver's tables by the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FPS = 1.0 / 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("track_id"), "ts", (F.lit(35.0) + (F.col("event_id") % 1000) / 1e4).alias("lat"), (F.lit(136.0) + (F.col("event_id") * 7 % 1000) / 1e4).alias("lon")
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct()
    return e.withColumn("fps", F.lit(FPS)).withColumn("frame_count", F.lit(500) + F.col("track_id") % 300)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("ref_idx"), F.col("s_suppkey").cast("string").alias("reference_id"), F.col("s_name").alias("reference_name"), F.col("s_name").alias("reference_label"),
        (F.lit(35.0) + (F.col("s_suppkey") * 37 % 1000) / 1e4).alias("lat"), (F.lit(136.0) + (F.col("s_suppkey") * 91 % 1000) / 1e4).alias("lon"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position for each frame of a video, with gaps: frame numbers step by 1, 2 or 5."""
    e = table(spark, sf_dir, "events")
    p = e.select(
        F.expr("user_id % 40").alias("video"), (F.col("event_id") * 3 % 1999).alias("frame"), (F.lit(35.0) + (F.col("event_id") * 13 % 1000) / 1e6).alias("lat"),
        (F.lit(136.0) + (F.col("event_id") * 29 % 1000) / 1e6).alias("lon"), F.col("event_id").alias("pos"),
    )
    return p.groupBy("video", "frame").agg(F.max_by(F.struct("lat", "lon"), "pos").alias("x")).select("video", "frame", "x.lat", "x.lon")


def markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(
        F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("video"), F.expr("event_id % 97").alias("frame"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 7 + 1).alias("target_id"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 5 + 1).alias("target_order"),
        ((F.col("event_id") % 73) * 5.0).alias("target_yaw"), ((F.col("event_id") % 37) * 5.0 - 90.0).alias("target_pitch"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 9) / 2.0).alias("view_zoom"), F.col("event_id").alias("pos"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat(F.lit("v"), (F.col("l_suppkey") % 10).cast("string")).alias("video"), (F.col("l_orderkey") % 30).alias("frame"), F.concat(F.lit("c"), (F.col("l_partkey") % 60).cast("string")).alias("candidate_id"),
        F.col("p_type").alias("semantic_class"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_discount") * 10).alias("confidence"),
        ((F.col("l_partkey") % 40) * 10.0 - 20.0).alias("target_yaw"), ((F.col("l_partkey") % 21) * 10.0 - 100.0).alias("target_pitch"),
        F.expr("CASE WHEN l_linenumber % 5 = 0 THEN 'yolo_pinhole' WHEN l_linenumber % 5 = 1 THEN '' END").alias("target_source"),
        F.expr("CASE WHEN l_partkey % 4 = 0 THEN 'A\\\\cubemap\\\\x.jpg' WHEN l_partkey % 4 = 1 THEN 'flat/x.jpg' END").alias("evidence_path"),
        F.expr("CASE WHEN l_partkey % 6 = 0 THEN 'Front' WHEN l_partkey % 6 = 1 THEN 'other' END").alias("evidence_face"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("pos"),
    )


Fixture = Callable[[SparkSession, str], DataFrame]

#: The same relations for DuckDB, as WITH items over the driver's tables.
SQL = {
    "track": "track AS (SELECT user_id AS track_id, ts, 35e0 + (event_id % 1000) / 1e4 AS lat, 136e0 + (event_id * 7 % 1000) / 1e4 AS lon FROM events)",
    "videos": "videos AS (SELECT DISTINCT user_id AS track_id, 1e0 / 3600e0 AS fps, 500 + user_id % 300 AS frame_count FROM events)",
    "refs": "refs AS (SELECT s_suppkey AS ref_idx, CAST(s_suppkey AS VARCHAR) AS reference_id, s_name AS reference_name, s_name AS reference_label,"
    " 35e0 + (s_suppkey * 37 % 1000) / 1e4 AS lat, 136e0 + (s_suppkey * 91 % 1000) / 1e4 AS lon FROM supplier)",
    "positions": "positions AS (SELECT video, frame, lat, lon FROM (SELECT user_id % 40 AS video, event_id * 3 % 1999 AS frame, 35e0 + (event_id * 13 % 1000) / 1e6 AS lat,"
    " 136e0 + (event_id * 29 % 1000) / 1e6 AS lon, row_number() OVER (PARTITION BY user_id % 40, event_id * 3 % 1999 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)",
    "markings": "markings AS (SELECT 'v' || (user_id % 20) AS video, event_id % 97 AS frame, CASE WHEN event_id % 11 <> 0 THEN event_id % 7 + 1 END AS target_id,"
    " CASE WHEN event_id % 13 <> 0 THEN event_id % 5 + 1 END AS target_order, (event_id % 73) * 5e0 AS target_yaw, (event_id % 37) * 5e0 - 90e0 AS target_pitch,"
    " CASE WHEN event_id % 3 <> 0 THEN (event_id % 9) / 2e0 END AS view_zoom, event_id AS pos FROM events WHERE event_type = 'click')",
    "candidates": r"candidates AS (SELECT 'v' || (l_suppkey % 10) AS video, l_orderkey % 30 AS frame, 'c' || (l_partkey % 60) AS candidate_id, p_type AS semantic_class,"
    r" CASE WHEN l_linenumber % 7 <> 0 THEN l_discount * 10 END AS confidence, (l_partkey % 40) * 10e0 - 20e0 AS target_yaw, (l_partkey % 21) * 10e0 - 100e0 AS target_pitch,"
    r" CASE WHEN l_linenumber % 5 = 0 THEN 'yolo_pinhole' WHEN l_linenumber % 5 = 1 THEN '' END AS target_source,"
    r" CASE WHEN l_partkey % 4 = 0 THEN 'A\cubemap\x.jpg' WHEN l_partkey % 4 = 1 THEN 'flat/x.jpg' END AS evidence_path,"
    r" CASE WHEN l_partkey % 6 = 0 THEN 'Front' WHEN l_partkey % 6 = 1 THEN 'other' END AS evidence_face, (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
