"""Frame tables as files: CSV of all frames and of matched ones, the navigation document, and what would be overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_distance, frame_path
from .navigate import linked_nodes

FRAME_COLUMNS = (
    "frame", "source_frame", "frame_shift", "image_path", "timestamp", "latitude", "longitude", "aligned_latitude", "aligned_longitude", "kp", "reference_id", "reference_name", "reference_label",
    "kp_distance_m", "kp_latitude", "kp_longitude", "kp_match",
)
MATCHED_COLUMNS = ("frame_index", "frame", "source_frame", "image_path", "kp", "reference_id", "reference_name", "reference_label", "kp_distance_m", "latitude", "longitude")


def coordinate(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.9f", x)).otherwise("")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def frames_table(frames: DataFrame, shift: int = 0) -> DataFrame:
    """The 17 columns of the frames file as text; frames has the columns of ``match.aligned`` with frame, source_frame and ts."""
    rows = frames.withColumn("frame_shift", F.lit(shift)).withColumn("image_path", frame_path(F.col("frame"))).withColumn("timestamp", stamp(F.col("ts")))
    for name in ("latitude", "longitude", "aligned_latitude", "aligned_longitude", "kp_latitude", "kp_longitude"):
        rows = rows.withColumn(name, coordinate(F.col(name)))
    return rows.withColumn("kp_distance_m", format_distance(F.col("kp_distance_m"))).select(*FRAME_COLUMNS)


def matched_table(frames: DataFrame, shift: int = 0) -> DataFrame:
    rows = frames_table(frames.where("kp_match = 1"), shift)
    return rows.withColumn("frame_index", F.col("frame")).select(*MATCHED_COLUMNS)


def navigation_nodes(frames: DataFrame, key: str = "video") -> DataFrame:
    """One row for each matched frame of a video, linked to the one before and after."""
    nodes = linked_nodes(frames.where("kp_match = 1"), key)
    return nodes.withColumn("image_path", frame_path(F.col("frame"))).withColumn("timestamp", stamp(F.col("ts")))


def navigation_json(frames: DataFrame, key: str = "video") -> DataFrame:
    """key, document: a JSON document for each video, its nodes in order. A video's matched frames form one document, so one row."""
    fields = ("index", "frame", "source_frame", "image_path", "timestamp", "kp", "reference_id", "reference_name", "reference_label", "kp_distance_m", "latitude", "longitude", "previous_index", "previous_frame", "next_index", "next_frame")
    nodes = navigation_nodes(frames, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))
    return nodes.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("video"), F.size("nodes").alias("node_count"), "nodes")).alias("document"))


def write_csv(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = rows.write.option("header", True).mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the output paths that exist already, on whatever store they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    return [p for p in paths if (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)]
