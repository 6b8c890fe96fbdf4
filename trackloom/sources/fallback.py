"""Which of several files a video's frames are read from: candidates are ranked, all files are read in one scan, and each video takes its first one.

No path is looped over on the driver: candidates, documents and files are tables, and of each video one minimum over (rank, path) decides.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.text import parse_float, parse_frame
from ..session import ship
from .tables import sniff

#: Fixed ends of file names.
FRAMES, MATCHED, NAVIGATION = "_frames.csv", "_matched_frames.csv", "_navigation.json"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot doesn't count as one."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def in_folder(folder: str | Column, name: Column) -> Column:
    return F.concat(folder if isinstance(folder, Column) else F.lit(folder), F.lit("/"), name)


def own_files(videos: DataFrame, folders: list[str], suffix: str) -> DataFrame:
    """(video, rank, path): the file named after the video in each folder, in the folders' order."""
    named = F.array(*[F.struct(F.lit(k).alias("rank"), in_folder(f, F.concat(stem(F.col("video")), F.lit(suffix))).alias("path")) for k, f in enumerate(folders)])
    return videos.select("video").distinct().select("video", F.explode(named).alias("x")).select("video", "x.*")


def told_files(documents: DataFrame) -> DataFrame:
    """(folder, name, video, path): the frames file that each navigation document names, beside it, and the video it is for (null: any).

    documents: (path, document). Documents that aren't JSON objects or name no file are left out; of the video's path the file name counts.
    """
    said = F.try_parse_json("document")
    text = lambda field: F.try_variant_get(said, f"$.{field}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(said, "$.frames_csv", "variant")) == "STRING"
    folder, named = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.when(is_text, F.nullif(text("frames_csv"), F.lit("")))
    rows = documents.select(folder.alias("folder"), file_name(F.col("path")).alias("name"), file_name(F.nullif(text("video"), F.lit(""))).alias("video"), named.alias("named"))
    beside = F.when(F.col("named").startswith("/"), F.col("named")).otherwise(in_folder(F.col("folder"), F.col("named")))
    return rows.where("named is not null").select("folder", "name", "video", beside.alias("path"))


def frames_candidates(videos: DataFrame, documents: DataFrame, folders: list[str]) -> DataFrame:
    """(video, rank, path) of all files that may hold a video's frames. Folders are as Spark tells paths (``file:/...``).

    First come the files named after the video in each folder, then those that its own navigation documents name, then those of all other documents for this video or for any,
    by folder and name. A document for any video is ranked among the others but isn't joined to every video: only its first ones count, see ``first_files``.
    """
    places = {f: k for k, f in enumerate(folders)}
    first = own_files(videos, folders, FRAMES)
    order = F.lit(None).cast("int")
    for f, k in places.items():
        order = F.when(F.col("folder") == f, k).otherwise(order)
    told = told_files(documents).withColumn("at", order).where("at is not null")
    own = told.join(videos.select(F.col("video").alias("of"), F.concat(stem(F.col("video")), F.lit(NAVIGATION)).alias("wanted")).distinct(), F.col("name") == F.col("wanted"))
    own = own.where(F.col("video").isNull() | (F.col("video") == F.col("of"))).select(F.col("of").alias("video"), (F.lit(len(folders)) + F.col("at")).alias("rank"), "path", F.lit("").alias("name"))
    named = told.join(videos.select("video").distinct(), "video").select("video", (F.lit(2 * len(folders)) + F.col("at")).alias("rank"), "path", "name")
    anyone = told.where("video is null").select("video", (F.lit(2 * len(folders)) + F.col("at")).alias("rank"), "path", "name")
    return first.withColumn("name", F.lit("")).unionByName(own).unionByName(named).unionByName(anyone)


def first_files(candidates: DataFrame, present: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, path) of each video's first candidate that is present. candidates without a video are for any; of these the first present one is a single row."""
    ranked = candidates if "name" in candidates.columns else candidates.withColumn("name", F.lit(""))
    there = ranked.join(present.select("path").distinct(), "path", "left_semi")
    place = F.min(F.struct("rank", "name", "path")).alias("first")
    own = there.where("video is not null").groupBy("video").agg(place)
    shared = there.where("video is null").agg(place).first()["first"]
    found = videos.select("video").distinct().join(own, "video", "left")
    if shared is not None:
        of_any = F.struct(*[F.lit(shared[n]).cast(found.schema["first"].dataType[n].dataType).alias(n) for n in ("rank", "name", "path")])
        found = found.withColumn("first", F.least("first", of_any))
    return found.where("first is not null").select("video", "first.path")


def matched_candidates(outputs: DataFrame, folders: list[Column]) -> DataFrame:
    """(video, rank, path): the matched-frames file of each output name in each folder, both given by a row. outputs: video, base, and what the folders need."""
    named = F.array(*[F.struct(F.lit(k).alias("rank"), in_folder(f, F.concat(F.col("base"), F.lit(MATCHED))).alias("path")) for k, f in enumerate(folders)])
    return outputs.select("video", F.explode(named).alias("x")).select("video", "x.*")


def first_matched(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(video, frame, path): the distinct frames of each video's first file that has any. rows: (path, fields), every row of every file.

    A row counts if its ``frame_index`` is a number, of which the whole part is taken; a file without such rows is as good as none.
    """
    number = finite(parse_float(F.col("fields")["frame_index"]))
    frames = rows.select("path", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint").alias("frame")).where("frame is not null").distinct()
    chosen = first_files(candidates, frames, candidates.select("video"))
    return chosen.join(frames, "path").select("video", "frame", "path")


def frames_of(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """(video, frame, path, row, fields) of the rows of each video's chosen file that have a whole frame number."""
    frame = F.coalesce(parse_frame(F.col("fields")["frame_index"]), parse_frame(F.col("fields")["frame"]))
    return chosen.join(rows, "path").select("video", frame.alias("frame"), "path", "row", "fields").where("frame is not null")


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, row, fields) of all rows of all delimited files in one scan: rows count from 1, fields are a map of the file's own header. A file is one task's."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                encoding, separator = sniff(content[:4096])
                text = content.decode("utf-8-sig" if encoding == "UTF-8" else "cp932", "replace")
                rows = [(path, k, list(row.items())) for k, row in enumerate(csv.DictReader(io.StringIO(text), delimiter=separator, restkey="__rest"), start=1)]
                for low in range(0, len(rows), 10_000):
                    part = rows[low : low + 10_000]
                    maps = [[(n, v) for n, v in r[2] if n is not None and isinstance(v, str)] for r in part]
                    kinds = pa.map_(pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64()), pa.array(maps, kinds)], ["path", "row", "fields"])

    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
    return files.mapInArrow(run, "path string, row bigint, fields map<string,string>")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, document) of whole small text files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
