"""Delimited and JSON inputs: sniffed CSV, reference points, frame lists, viewer documents, job metadata."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_float, parse_frame, parse_frame_tolerant

#: Fixed candidate names of columns.
LATITUDE = ("lat", "latitude", "gps_lat", "y", "緯度")
LONGITUDE = ("lon", "lng", "longitude", "gps_lon", "gps_lng", "x", "経度")
REFERENCE_ID = ("reference_id", "ref_id", "id", "asset_id", "facility_id", "pole_id", "参照点ID", "施設ID", "電柱番号")
REFERENCE_LABEL = (
    "reference_label", "label", "reference_name", "name", "kp", "kilopost", "kilo_post", "reference", "ref", "point", "facility_name", "bridge_name", "pole", "bridge",
    "測点", "キロポスト", "参照点", "施設名", "高架橋名",
)
KILOPOST = (
    "kp", "kilopost", "kilo_post", "reference", "reference_id", "ref", "ref_id", "name", "id", "point", "asset_id", "facility_id", "pole", "pole_id", "bridge", "bridge_name",
    "測点", "キロポスト", "参照点", "参照点ID", "施設ID", "施設名", "電柱番号", "高架橋名",
)


def field_name(name: str) -> str:
    return re.sub(r"[\s:./()（）\[\]-]+", "_", unicodedata.normalize("NFKC", name or "").strip().lower()).strip("_")


def find_field(columns: list[str], names: tuple[str, ...], strict: bool = False) -> str | None:
    """The first column of one of the names; else, unless strict, the first that contains one of them."""
    wanted = {field_name(n) for n in names}
    exact = [c for c in columns if field_name(c) in wanted]
    loose = [] if strict else [c for c in columns if any(w and w in field_name(c) for w in wanted)]
    return (exact + loose or [None])[0]


def sniff(sample: bytes) -> tuple[str, str]:
    """(encoding, separator) of a delimited file from its first bytes: UTF-8 if they decode, else the Japanese code page."""
    for encoding in ("UTF-8", "MS932"):
        try:
            text = sample.decode("utf-8-sig" if encoding == "UTF-8" else "cp932")
        except UnicodeDecodeError as error:
            if error.start >= len(sample) - 4 and encoding == "UTF-8":  # cut within a character
                text = sample[: error.start].decode("utf-8-sig")
            else:
                continue
        lines = [x for x in text.splitlines()[:20] if x] or [""]
        score = {sep: (min(x.count(sep) for x in lines), lines[0].count(sep)) for sep in (",", "\t", ";")}
        best = max(score, key=lambda s: score[s])
        return encoding, best if score[best][1] else ","
    raise ValueError("the file is neither UTF-8 nor code page 932")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the row's number from 1 in ``__row``; the dialect is sniffed from the first 4096 bytes Spark reads."""
    first = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, 4096).alias("head")).first()
    if first is None:
        raise ValueError(f"no file at {path}")
    encoding, sep = sniff(bytes(first.head))
    if encoding != "UTF-8":
        return _read_decoded(spark, path, "cp932", sep, bytes(first.head))
    rows = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    return rows.withColumn("__row", F.monotonically_increasing_id() + 1)  # a multi-line file is read by one task


def _read_decoded(spark: SparkSession, path: str, encoding: str, sep: str, head: bytes) -> DataFrame:
    """For encodings that Spark's own reader doesn't take: each file is decoded and split by one task."""
    names = next(csv.reader(io.StringIO(head.decode(encoding, "ignore")), delimiter=sep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                lines = csv.reader(io.StringIO(raw.as_py().decode(encoding)), delimiter=sep)
                next(lines, None)
                rows = [(x + [None] * len(names))[: len(names)] + [k] for k, x in enumerate(lines, start=1)]
                columns = list(zip(*rows, strict=True)) or [[]] * (len(names) + 1)
                kinds = [pa.string()] * len(names) + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "__row"])

    schema = ", ".join([*(f"`{n}` string" for n in names), "`__row` bigint"])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def references(rows: DataFrame, strict: bool = False) -> DataFrame:
    """ref_idx (row number), reference_id, reference_name, reference_label, lat, lon of the rows with readable coordinates.

    The label is the name, else the kilopost, else the id, else the row's number. ValueError without coordinate columns.
    """
    columns = [c for c in rows.columns if c != "__row"]
    lat, lon = find_field(columns, LATITUDE, strict), find_field(columns, LONGITUDE, strict)
    if not lat or not lon:
        raise ValueError(f"latitude and longitude columns are needed; there are {', '.join(columns)}")
    text = lambda names: F.coalesce(F.trim(F.col(f"`{f}`")), F.lit("")) if (f := find_field(columns, names, strict)) else F.lit("")
    ident, name, kilopost = text(REFERENCE_ID), text(REFERENCE_LABEL), text(KILOPOST)
    label = F.coalesce(*[F.nullif(c, F.lit("")) for c in (name, kilopost, ident)], F.col("__row").cast("string"))
    found = rows.select(F.col("__row").alias("ref_idx"), ident.alias("reference_id"), name.alias("reference_name"), label.alias("reference_label"), parse_float(F.col(f"`{lat}`")).alias("lat"), parse_float(F.col(f"`{lon}`")).alias("lon"))
    return found.where("lat is not null and lon is not null")


def matched_frames(rows: DataFrame, tolerant: bool = False) -> DataFrame:
    """The distinct frame numbers of a matched-frames table: whole and not negative, or with ``tolerant`` cut from any number."""
    if "frame_index" not in rows.columns:
        return rows.sparkSession.createDataFrame([], "frame bigint")
    parse = parse_frame_tolerant if tolerant else parse_frame
    return rows.select(parse(F.col("frame_index")).alias("frame")).where("frame >= 0").distinct()


def _text(rows: DataFrame, name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit("")) if name in rows.columns else F.lit(None).cast("string")


def frame_records(rows: DataFrame) -> DataFrame:
    """frame, label, lat, lon: the first row of each frame. The aligned pair counts if both parts are there, else the raw pair."""
    number = lambda n: parse_float(_text(rows, n))
    frame = F.coalesce(parse_frame(_text(rows, "frame_index")), parse_frame(_text(rows, "frame")))
    both = number("aligned_latitude").isNotNull() & number("aligned_longitude").isNotNull()
    raw = number("latitude").isNotNull() & number("longitude").isNotNull()
    facts = F.struct(
        F.coalesce(*[_text(rows, n) for n in ("reference_label", "reference_name", "kp", "reference_id")], F.lit("")).alias("label"),
        F.when(both, number("aligned_latitude")).when(raw, number("latitude")).alias("lat"), F.when(both, number("aligned_longitude")).when(raw, number("longitude")).alias("lon"),
    )
    found = rows.select(frame.alias("frame"), facts.alias("x"), "__row").where("frame is not null")
    return found.groupBy("frame").agg(F.min_by("x", "__row").alias("x")).select("frame", "x.*")


def navigation_payload(records: DataFrame, frame: int) -> DataFrame:
    """One row: the frame, its neighbours among the listed frames, their number, its label and position."""
    one = records.groupBy().agg(
        F.max(F.when(F.col("frame") < frame, F.col("frame"))).alias("previous"), F.min(F.when(F.col("frame") > frame, F.col("frame"))).alias("next"), F.count("*").alias("count"),
        F.max(F.when(F.col("frame") == frame, F.struct("label", "lat", "lon"))).alias("x"),
    )
    return one.select(F.lit(frame).alias("frame"), "previous", "next", "count", "x.*")


def metadata(rows: DataFrame) -> DataFrame:
    """key, value, kind of a key/value table: the JSON value as text without quotes, or the text itself where it isn't JSON."""
    parsed = F.try_parse_json("value")
    return rows.select("key", F.coalesce(F.try_variant_get(parsed, "$", "string"), "value").alias("value"), F.schema_of_variant(parsed).alias("kind"))


def latest_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    place = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")
