"""GPX files: every track and route point with a position and a readable time."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import normalize_gpx_field
from ..session import ship

POINTS = ("trkpt", "rtept")
RAW = "file string, place bigint, lat string, lon string, fields array<struct<name:string,value:string>>"


class Unsafe(ValueError):
    """The file declares a document type or an entity."""


def points(raw: bytes) -> Iterator[tuple[str | None, str | None, list[tuple[str, str]]]]:
    """(lat, lon, [(name, text)]) of each point, in document order: its attributes, then the texts and attributes of all elements within it.

    Document types and entities are refused, so nothing is expanded or fetched.
    """
    parser = expat.ParserCreate(namespace_separator="}")
    out: list[tuple[str | None, str | None, list]] = []
    stack: list[dict] = []
    depth = 0

    def refuse(*_: object) -> None:
        raise Unsafe("document types and entities are refused")

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal depth
        depth += 1
        local = tag.rsplit("}", 1)[-1]
        if local in POINTS:
            stack.append({"depth": depth, "lat": attributes.get("lat"), "lon": attributes.get("lon"), "fields": list(attributes.items()), "open": []})
            out.append((stack[-1]["lat"], stack[-1]["lon"], stack[-1]["fields"]))
        elif stack:
            place = len(stack[-1]["fields"])
            stack[-1]["fields"].append((tag, ""))
            stack[-1]["fields"] += list(attributes.items())
            stack[-1]["open"].append((place, len(stack[-1]["fields"])))

    def text(data: str) -> None:
        if stack and stack[-1]["open"]:
            place, after = stack[-1]["open"][-1]
            if len(stack[-1]["fields"]) == after:  # text before the first child only
                name, had = stack[-1]["fields"][place]
                stack[-1]["fields"][place] = (name, had + data)

    def end(_: str) -> None:
        nonlocal depth
        if stack and stack[-1]["depth"] == depth:
            stack.pop()
        elif stack and stack[-1]["open"]:
            stack[-1]["open"].pop()
        depth -= 1

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, end
    parser.Parse(raw, True)
    yield from out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = list(points(raw.as_py() or b""))
            for low in range(0, len(rows), 10_000):
                part = rows[low : low + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(part)), pa.array(range(low, low + len(part)), pa.int64()), pa.array([p[0] for p in part], pa.string()), pa.array([p[1] for p in part], pa.string()),
                        pa.array([[{"name": n, "value": v} for n, v in p[2]] for p in part], kind),
                    ],
                    ["file", "place", "lat", "lon", "fields"],
                )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """file, place, lat, lon, fields of all points of the files at a path, positions as text."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, RAW)


def candidates(fields: Column) -> Column:
    """Texts that may be a point's time, in order: time fields, pairs of date and clock fields, anything that looks like a time."""

    def named(names: tuple[str, ...]) -> Column:
        hits = F.filter(fields, lambda f: normalize_gpx_field(f["name"]).isin(*names) & times.clean(f["value"]).isNotNull())
        return F.transform(hits, lambda f: times.clean(f["value"]))

    dates, clocks = named(times.DATE_FIELDS), named(times.CLOCK_FIELDS)
    pairs = F.flatten(F.transform(dates, lambda d: F.transform(F.filter(clocks, lambda c: c != d), lambda c: F.concat(d, F.lit(" "), c))))
    likely = F.filter(F.transform(fields, lambda f: times.clean(f["value"])), lambda v: times.looks_like(v))
    return F.array_distinct(F.concat(named(times.TIME_FIELDS), pairs, likely))


def _read(raw: DataFrame) -> DataFrame:
    coordinate = lambda c, most: F.when(F.abs(F.col(c).try_cast("double")) <= most, F.col(c).try_cast("double"))
    rows = raw.withColumn("y", coordinate("lat", 90)).withColumn("x", coordinate("lon", 180)).withColumn("texts", candidates(F.col("fields")))
    ts = F.get(F.filter(F.transform("texts", lambda t: times.parse(t)), lambda t: t.isNotNull()), F.lit(0))
    return rows.withColumn("ts", ts)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """track_id (the file), ts, lat, lon. Points without a finite position or a readable time are left out."""
    rows = _read(read_points(spark, path)).where("ts is not null and y is not null and x is not null")
    return rows.select(F.col("file").alias("track_id"), "ts", F.col("y").alias("lat"), F.col("x").alias("lon"))


def diagnose(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: point_count, missing_time_count, bad_time_count, and up to five time texts that weren't read."""
    rows = _read(read_points(spark, path)).withColumn("placed", F.col("y").isNotNull() & F.col("x").isNotNull())
    bad = F.col("placed") & (F.size("texts") > 0) & F.col("ts").isNull()
    rows = rows.withColumn("bad", bad)
    nth = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("file").orderBy("place"))
    rows = rows.withColumn("sample", F.when(F.col("bad") & (nth <= 5), F.struct("place", F.get("texts", F.lit(0)).alias("text"))))
    return rows.groupBy("file").agg(
        F.count("*").alias("point_count"), F.count_if(F.col("placed") & (F.size("texts") == 0)).alias("missing_time_count"), F.count_if("bad").alias("bad_time_count"),
        F.transform(F.sort_array(F.collect_list("sample")), lambda s: s["text"]).alias("time_samples"),
    )
