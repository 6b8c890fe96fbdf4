"""Previous, next, step and edge queries over the frames of a mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_marking_mode

KEY = "video"


def neighbours(frames: DataFrame, key: str = KEY) -> DataFrame:
    """key, frame, previous, next, index (from 0) of the distinct frames."""
    order = Window.partitionBy(key).orderBy("frame")
    rows = frames.select(key, "frame").where("frame is not null").distinct()
    return rows.select(key, "frame", F.lag("frame").over(order).alias("previous"), F.lead("frame").over(order).alias("next"), (F.row_number().over(order) - 1).cast("bigint").alias("index"))


def around(frames: DataFrame, asked: DataFrame, key: str = KEY) -> DataFrame:
    """asked (key, frame) with the nearest frames below and above it; the frame itself need not be among them.

    Both tables are merged in frame order and the last and next listed frames are carried along, so no pairs are made.
    """
    listed = frames.select(key, "frame").where("frame is not null").distinct().withColumn("listed", F.col("frame")).withColumn("kind", F.lit(1))
    both = listed.unionByName(asked.select(key, "frame").distinct().withColumn("listed", F.lit(None).cast("bigint")).withColumn("kind", F.lit(0)))
    upto = lambda frame: Window.partitionBy(key).orderBy(frame).rangeBetween(Window.unboundedPreceding, -1)
    below = F.max("listed").over(upto(F.col("frame")))
    above = F.min("listed").over(upto(F.col("frame").desc()))  # the same frame read backwards: one that ends ahead is recomputed for each row
    return both.withColumn("previous", below).withColumn("next", above).where("kind = 0").select(key, "frame", "previous", "next")


def step(frames: DataFrame, asked: DataFrame, count: int, forward: bool, key: str = KEY) -> DataFrame:
    """asked (key, frame) with target: ``count`` places on in the sorted frames, held at the ends, null from the last one on."""
    count = max(1, count)
    listed = neighbours(frames, key).select(key, F.col("frame").alias("at"), "index")
    total = listed.groupBy(key).agg(F.count("*").alias("total"))
    placed = around(frames, asked, key).withColumn("from", F.col("next" if forward else "previous"))
    placed = placed.join(listed.withColumnRenamed("at", "from"), [key, "from"], "left").join(total, key, "left")
    shift = count - 1 if forward else 1 - count
    wanted = F.when(F.col("index").isNotNull(), F.greatest(F.lit(0), F.least(F.col("total") - 1, F.col("index") + shift)))
    found = placed.withColumn("index", wanted).join(listed, [key, "index"], "left")
    return found.select(key, "frame", F.col("at").alias("target"))


def frame_step(frame: Column, count: Column, step_count: int | Column) -> Column:
    """Plain frames: within the video, null when moving on from its last frame; without a frame count there is no end."""
    by = step_count if isinstance(step_count, Column) else F.lit(step_count)
    target = F.greatest(F.lit(0), frame + by)
    held = F.when(count.isNull(), target).otherwise(F.least(target, count - 1))
    return F.when((by > 0) & count.isNotNull() & (frame >= count - 1), F.lit(None).cast("bigint")).otherwise(held)


def dispatch(asked: DataFrame, listed: DataFrame, key: str = KEY) -> DataFrame:
    """asked with target: where a step leads in the mode of the row; null where it leads nowhere.

    asked: key, frame, mode, direction (1 or -1), fast, step, fast_step, frame_count. listed: key, mode (kp, marking, detect, layer), frame.
    Plain frames step through the video, and so do markings and detections unless fast, when they go to the next listed frame. Matched
    frames and layers go ``step`` listed frames on; without any matched frame the video is stepped through.
    """
    mode = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    kind = F.when(mode == "frame", "frame").when(mode == "kp", "kp").when(is_marking_mode(F.col("mode")), "marking").when(mode == "detect", "detect").otherwise("layer")
    count = F.when(F.col("fast"), F.col("fast_step")).otherwise(F.col("step")).cast("bigint")
    rows = asked.withColumns({"__kind": kind, "__count": count, "__frame": F.col("frame").cast("bigint")})
    rows = rows.withColumn("__jump", F.when(F.col("__kind").isin("marking", "detect"), F.when(F.col("fast"), 1)).when(F.col("__kind") != "frame", F.greatest(F.lit(1), F.col("__count"))))
    places = listed.select(F.col(key).alias("__key"), F.col("mode").alias("__mode"), F.col("frame").cast("bigint").alias("__at")).where("__at is not null").distinct()
    by_mode = Window.partitionBy("__key", "__mode")
    places = places.withColumn("__index", F.row_number().over(by_mode.orderBy("__at")).cast("bigint"))
    totals = places.groupBy("__key", "__mode").agg(F.count("*").alias("__total"))
    # both tables in frame order: how many listed frames lie below and up to each asked one
    wanted = rows.where("__jump is not null and __frame is not null").select(F.col(key).alias("__key"), F.col("__kind").alias("__mode"), F.col("__frame").alias("__at")).distinct()
    both = places.select("__key", "__mode", "__at", "__index", F.lit(False).alias("__asked"))
    both = both.unionByName(wanted.withColumn("__index", F.lit(None).cast("bigint")).withColumn("__asked", F.lit(True)))
    upto = lambda last: by_mode.orderBy("__at").rangeBetween(Window.unboundedPreceding, last)
    both = both.withColumn("__below", F.coalesce(F.max("__index").over(upto(-1)), F.lit(0))).withColumn("__upto", F.coalesce(F.max("__index").over(upto(0)), F.lit(0))).where("__asked")
    rows = rows.join(both.select("__key", "__mode", "__at", "__below", "__upto"), (F.col(key) == F.col("__key")) & (F.col("__kind") == F.col("__mode")) & (F.col("__frame") == F.col("__at")), "left").drop("__key", "__mode", "__at")
    rows = rows.join(totals, (F.col(key) == F.col("__key")) & (F.col("__kind") == F.col("__mode")), "left").drop("__key", "__mode")
    ahead = F.when(F.col("__upto") < F.col("__total"), F.least(F.col("__total"), F.col("__upto") + F.col("__jump")))
    back = F.when(F.col("__below") > 0, F.greatest(F.lit(1), F.col("__below") + 1 - F.col("__jump")))
    rows = rows.withColumn("__wanted", F.when(F.col("direction") > 0, ahead).otherwise(back))
    wanted = places.select("__key", F.col("__mode").alias("__of"), F.col("__index").alias("__place"), F.col("__at").alias("__found"))
    rows = rows.join(wanted, (F.col(key) == F.col("__key")) & (F.col("__kind") == F.col("__of")) & (F.col("__wanted") == F.col("__place")), "left")
    stepped = frame_step(F.col("__frame"), F.col("frame_count"), F.col("__count") * F.signum("direction").cast("bigint"))
    plain = F.col("__jump").isNull() | ((F.col("__kind") == "kp") & F.col("__total").isNull())
    return rows.withColumn("target", F.when(plain, stepped).otherwise(F.col("__found"))).select(*asked.columns, "target")


def edges(frames: DataFrame, key: str = KEY) -> DataFrame:
    return frames.groupBy(key).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def linked_nodes(frames: DataFrame, key: str = KEY) -> DataFrame:
    """Each row with its index and those of its neighbours, and their frames."""
    order = Window.partitionBy(key).orderBy("frame")
    index = F.row_number().over(order) - 1
    return frames.withColumn("index", index).withColumn("previous_index", F.lag("index").over(order)).withColumn("next_index", F.lead("index").over(order)).withColumn(
        "previous_frame", F.lag("frame").over(order)
    ).withColumn("next_frame", F.lead("frame").over(order))
