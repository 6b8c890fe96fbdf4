"""What tables of frames hold: frames, counts, classes, values, and which of them have anything for a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_quality

#: Fixed names of the classes of distance quality, nearest first.
QUALITIES = ("trusted", "usable", "far")


def distinct_frames(rows: DataFrame, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """keys, frame: the different frames, cut to whole numbers; missing ones don't count."""
    return rows.select(*keys, F.col("frame").try_cast("bigint").alias("frame")).where("frame is not null").distinct()


def frame_count(rows: DataFrame, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """keys, frames: the number of different frames."""
    return distinct_frames(rows, keys).groupBy(*keys).agg(F.count("*").alias("frames"))


def first_frames(rows: DataFrame, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """keys, first_frame, features: the smallest frame and the number of rows."""
    return rows.groupBy(*keys).agg(F.min("frame").alias("first_frame"), F.count("*").alias("features"))


def feature_counts(rows: DataFrame, keys: tuple[str, ...] = ("video",), layer: str = "layer_id") -> DataFrame:
    """keys, features, layers: the number of rows over all tables, and of the tables that have any."""
    by_layer = rows.groupBy(*keys, layer).agg(F.count("*").alias("n"))
    return by_layer.groupBy(*keys).agg(F.sum("n").alias("features"), F.count("*").alias("layers"))


def matched_count(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, points, matched: rows, and rows with a match."""
    return rows.groupBy(*keys).agg(F.count("*").alias("points"), F.count("match").alias("matched"))


def sorted_classes(rows: DataFrame, keys: tuple[str, ...] = ("video",), column: str = "semantic_class") -> DataFrame:
    """keys, classes: the different names in the column, sorted; blank ones don't count."""
    named = rows.select(*keys, F.trim(F.col(column)).alias("__class")).where("__class <> ''").distinct()
    return named.groupBy(*keys).agg(F.sort_array(F.collect_list("__class")).alias("classes"))


def single_class(classes: Column, hint: Column | None = None) -> Column:
    """The class that a table was told to have, else its only one."""
    only = F.when(F.size(classes) == 1, F.get(classes, F.lit(0)))
    return only if hint is None else F.coalesce(F.nullif(F.trim(hint), F.lit("")), only)


def inferred_class(classes: Column, hint: Column, name: Column, source: Column) -> Column:
    """As ``single_class``; else what the table's name, then its source, says after its prefix or last colon."""

    def said(x: Column) -> Column:
        after = lambda mark: F.when(x.contains(mark), F.trim(F.regexp_extract(x, f"(?s){mark}(.*)$", 1)))
        return F.coalesce(after("poi_clusters_"), after("poi_candidates_"), F.nullif(F.trim(F.regexp_extract(x, r"(?s):([^:]*)$", 1)), F.lit("")))

    return F.coalesce(single_class(classes, hint), said(F.trim(name)), said(F.trim(source)), F.lit(""))


def distinct_values(rows: DataFrame, column: str, most: int, order: str = "pos", keys: tuple[str, ...] = ()) -> DataFrame:
    """The first ``most`` different values of a column that aren't blank, in row order, with the place of each: the limit is the feature."""
    found = rows.where(F.trim(F.col(column)) != "").groupBy(*keys, F.col(column).alias("value")).agg(F.min(order).alias("first_pos"))
    if not keys:
        return found.orderBy("first_pos").limit(most)
    first = found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("first_pos", "value"))), 1, most).alias("x"))
    return first.select(*keys, F.inline("x"))


def first_value(rows: DataFrame, column: str, keys: tuple[str, ...] = ("video",), order: str = "pos") -> DataFrame:
    """keys, value: the first value of a column, in row order, that isn't blank."""
    text = F.trim(F.col(column).cast("string"))
    return rows.where(text != "").groupBy(*keys).agg(F.min_by(text, order).alias("value"))


def next_id(rows: DataFrame, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """keys, next_id: one more than the largest id or order."""
    most = F.max(F.greatest(F.coalesce("target_id", F.lit(0)), F.coalesce("target_order", F.lit(0))))
    return rows.groupBy(*keys).agg((most + 1).alias("next_id"))


def has_any(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked (layer_id, video, frame) with found: whether the table has a row of the video or of none, at the frame if one is asked for.

    A table of which no video is asked always counts. Rows are reduced to their keys before they meet.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    have = rows.select("layer_id", text("video").alias("__video"), F.col("frame").try_cast("bigint").alias("__frame")).distinct()
    any_frame = have.select("layer_id", "__video", F.lit(None).cast("bigint").alias("__frame")).distinct()
    keys = have.where("__frame is not null").unionByName(any_frame).withColumn("found", F.lit(True))
    wanted = asked.withColumn("__n", F.monotonically_increasing_id()).withColumn("__video", F.explode(F.array_distinct(F.array(text("video"), F.lit("")))))
    wanted = wanted.withColumn("__frame", F.col("frame").cast("bigint"))
    met = wanted.join(keys.hint("merge"), (wanted.layer_id == keys.layer_id) & (wanted["__video"] == keys["__video"]) & wanted["__frame"].eqNullSafe(keys["__frame"]), "left")
    found = met.groupBy("__n").agg(*[F.first(wanted[c]).alias(c) for c in asked.columns], F.max(F.coalesce("found", F.lit(False))).alias("found"))
    return found.select(*asked.columns, (F.col("found") | (text("video") == "")).alias("found"))


def quality_of(quality: Column, distance: Column) -> Column:
    """A projection's own class of quality, else that of its distance; unknown ones are far."""
    found = F.coalesce(F.nullif(quality, F.lit("")), distance_quality(distance))
    return F.when(found.isin(*QUALITIES), found).otherwise("far")


def quality_groups(rows: DataFrame, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """keys, quality, n: how many projections of each class, also of classes without any where the keys have others."""
    classed = rows.select(*keys, quality_of(F.col("quality"), F.col("distance_m")).alias("quality"))
    counts = classed.groupBy(*keys).agg(*[F.count_if(F.col("quality") == q).alias(q) for q in QUALITIES])
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("quality"), F.col(q).alias("n")) for q in QUALITIES])).alias("x")).select(*keys, "x.*")


def union_by_turn(layers: DataFrame, rows: DataFrame, keys: tuple[str, ...], order: str = "pos") -> DataFrame:
    """The rows of several tables as one: of each key the row of the table of the smallest ``turn``, then of the smallest place.

    layers: (layer_id, turn). A key may be null.
    """
    placed = rows.join(layers.select("layer_id", "turn").hint("merge"), "layer_id")  # both sides grow with the tables
    others = [c for c in placed.columns if c not in keys]
    first = placed.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("turn", order)).alias("x"))
    return first.select(*keys, "x.*")
