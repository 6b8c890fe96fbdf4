"""Tables that are replaced by a pointer: a new version's files first, then one small file that names them.

A table's folder holds ``data/<version>/bucket=k`` and ``versions/<number>.json``. The pointer of the highest number is the table; it names, for each bucket of the keys' hash, the
folder that holds its rows. A writer puts new folders beside the old ones and then its pointer, which fails if another writer has put the same number
(``Conflict``): so a reader sees the old rows or the new ones, a failing writer changes nothing, and of two writers one wins. Folders that no kept version names are removed only after that.

A change by key is copy-on-write: only the buckets that hold a changed key are read and written anew; the others stay where they are, under the new pointer too. Only
numbers of buckets and names of folders pass through the driver. Putting the pointer is as atomic as the file system's rename without overwriting.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import heading_delta, signed_delta
from .review import marking_key

BUCKETS, KEPT = 64, 2
#: A bearing offset is written back only where it moved by so many degrees.
LEAST_MOVE = 0.01


class Conflict(RuntimeError):
    """Another writer has replaced the version that a change was made from."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    folders: dict[int, str]
    note: int | None


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def _names(spark: SparkSession, path: str) -> list[str]:
    where, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _pointer(table: str, number: int) -> str:
    return f"{table}/versions/{number:012d}.json"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not be there yet, whole or not at all."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where, files = _path(spark, path)
    staged, _ = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = files.create(staged, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(context.makeQualified(staged), context.makeQualified(where), none)
    except Exception as error:
        files.delete(staged, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{path} has been written meanwhile") from None
        raise


def _remove(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)


def version(spark: SparkSession, table: str) -> Version | None:
    """The newest version of a table; None if nothing was ever written."""
    names = [n for n in _names(spark, f"{table}/versions") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return None
    said = json.loads(spark.read.text(f"{table}/versions/{names[-1]}", wholetext=True).first()[0])
    return Version(said["number"], T.StructType.fromJson(said["schema"]), tuple(said["keys"]), said["buckets"], {int(k): v for k, v in said["folders"].items()}, said["note"])


def read(spark: SparkSession, table: str, at: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version (the newest if not given), of some buckets if these are given."""
    at = at or version(spark, table)
    if at is None:
        raise FileNotFoundError(f"no version in {table}")
    folders = [f"{table}/{f}" for k, f in sorted(at.folders.items()) if buckets is None or k in buckets]
    return spark.read.schema(at.schema).parquet(*folders) if folders else spark.createDataFrame([], at.schema)


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def _commit(rows: DataFrame, table: str, before: Version | None, keys: tuple[str, ...], buckets: int, touched: list[int] | None, note: int | None, kept: int) -> Version:
    """Writes the rows by bucket and puts the pointer; touched: the buckets that these rows replace, all if None."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    number = before.number + 1 if before else 1
    try:
        rows.withColumn("__bucket", bucket_of(keys, buckets)).repartition("__bucket", *[F.col(f"`{k}`") for k in keys]).write.partitionBy("__bucket").parquet(f"{table}/{name}")
        made = {int(n.split("=")[1]): f"{name}/{n}" for n in _names(spark, f"{table}/{name}") if n.startswith("__bucket=")}
        stay = {k: f for k, f in before.folders.items() if k not in touched} if before and touched is not None else {}
        folders = stay | made
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        said = {"number": number, "schema": schema.jsonValue(), "keys": list(keys), "buckets": buckets, "folders": folders, "note": note}
        _put(spark, _pointer(table, number), json.dumps(said))
    except BaseException:
        with contextlib.suppress(Exception):
            _remove(spark, f"{table}/{name}")
        raise
    _sweep(spark, table, number, kept)
    return Version(number, schema, keys, buckets, folders, note)


def _sweep(spark: SparkSession, table: str, number: int, kept: int) -> None:
    """Removes pointers before the last kept ones, then bucket folders that no pointer names and that an older pointer named."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{table}/versions") if n.endswith(".json") and not n.startswith(".")]
    old = [n for n in numbers if n <= number - kept]
    read_one = lambda n: set(json.loads(spark.read.text(_pointer(table, n), wholetext=True).first()[0])["folders"].values())
    live = set().union(*(read_one(n) for n in numbers if n not in old))
    for n in old:
        for folder in sorted(read_one(n) - live):
            _remove(spark, f"{table}/{folder}")
        _remove(spark, _pointer(table, n))


def _expected(spark: SparkSession, table: str, expect: int | None) -> Version | None:
    before = version(spark, table)
    if expect is not None and (before.number if before else 0) != expect:
        raise Conflict(f"{table} is at version {before.number if before else 0}, not {expect}")
    return before


def replace(rows: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS, expect: int | None = None, note: int | None = None, kept: int = KEPT) -> Version:
    """The rows take the place of the whole table. expect: the version it must be at (0: none)."""
    before = _expected(rows.sparkSession, table, expect)
    return _commit(rows, table, before, tuple(keys), before.buckets if before and before.keys == tuple(keys) else buckets, None, note, kept)


def _touched(rows: DataFrame, before: Version) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket_of(before.keys, before.buckets).alias("b")).distinct().collect())


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for k in keys:
        found &= a[k].eqNullSafe(b[k])
    return found


def replace_groups(rows: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS, expect: int | None = None, note: int | None = None, kept: int = KEPT) -> Version | None:
    """Of each key that the rows hold, they take the place of all its rows; other keys keep theirs. Without rows nothing changes, and None is returned.

    So the frames of a video are replaced only once the new ones are there, and never by nothing.
    """
    spark = rows.sparkSession
    before = _expected(spark, table, expect)
    if before is None:
        return None if rows.isEmpty() else _commit(rows, table, None, tuple(keys), buckets, None, note, kept)
    touched = _touched(rows, before)
    if not touched:
        return None
    old = read(spark, table, before, touched)
    gone = rows.select(*[f"`{k}`" for k in before.keys]).distinct()
    stay = old.join(gone, _same(old, gone, before.keys), "left_anti")
    return _commit(stay.unionByName(rows), table, before, before.keys, before.buckets, touched, note, kept)


def upsert(
    rows: DataFrame,
    table: str,
    keys: list[str],
    order: str,
    changed: Callable[[Column, Column], Column] | None = None,
    buckets: int = BUCKETS,
    expect: int | None = None,
    note: int | None = None,
    kept: int = KEPT,
) -> Version | None:
    """Of each key the row of the largest order takes the place of the stored one where ``changed(stored, new)`` says so (always if not given).

    A key that isn't stored yet is added. Where nothing changes, no version is written and None is returned.
    """
    spark = rows.sparkSession
    latest = rows.groupBy(*[f"`{k}`" for k in keys]).agg(F.max(F.struct(F.col(order).alias("__order"), *[F.col(f"`{c}`") for c in rows.columns])).alias("new")).select("new")
    before = _expected(spark, table, expect)
    fresh = latest.select("new.*").select(*[f"`{c}`" for c in rows.columns])
    if before is None:
        return None if rows.isEmpty() else _commit(fresh, table, None, tuple(keys), buckets, None, note, kept)
    near = _touched(fresh, before)
    if not near:
        return None
    stored = read(spark, table, before, near).select(F.struct("*").alias("old"))
    same = F.lit(True)
    for k in before.keys:
        same &= stored["old"][k].eqNullSafe(latest["new"][k])
    met = latest.join(stored, same, "left")
    if changed is not None:
        met = met.where(F.col("old").isNull() | changed(F.col("old"), F.col("new")))
    change = met.select("new.*").select(*[f"`{c}`" for c in rows.columns])
    touched = _touched(change, before)
    if not touched:
        return None
    old = read(spark, table, before, touched)
    stay = old.join(change, _same(old, change, before.keys), "left_anti")
    return _commit(stay.unionByName(change), table, before, before.keys, before.buckets, touched, note, kept)


def in_batches(write: Callable[[DataFrame, int], Version | None], spark: SparkSession, table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch that the table's pointer has noted already is left out, so one that runs twice changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        before = version(spark, table)
        if before is None or before.note is None or before.note < number:
            write(batch, number)

    return each


def put_offsets(offsets: DataFrame, table: str, key: str = "video", order: str = "seq", offset: str = "viewer_front_offset_deg", least: float = LEAST_MOVE, **more) -> Version | None:
    """Writes back each video's newest bearing offset, between -180 and 180 degrees, where it moved by at least ``least``; rows without one are left out."""
    rows = offsets.where(F.col(offset).isNotNull()).withColumn(offset, signed_delta(F.lit(0.0), F.col(offset)))
    return upsert(rows, table, [key], order, lambda old, new: F.coalesce(heading_delta(old[offset], new[offset]) >= least, F.lit(True)), **more)


def put_markings(markings: DataFrame, table: str, order: str = "created_at", **more) -> Version | None:
    """Adds the markings whose (video, frame, id) isn't stored; of equal new ones the first by order stays. What is stored is never changed."""
    keyed = markings.withColumn("marking_key", marking_key(F.col("target_id"), F.col("target_order"), F.col("target_yaw"), F.col("target_pitch")))
    first = keyed.groupBy("video", "frame", "marking_key").agg(F.min(F.struct(F.col(order).alias("__order"), *[F.col(c) for c in markings.columns])).alias("x"))
    rows = first.select("marking_key", *[F.col(f"x.{c}") for c in markings.columns]).select(*keyed.columns)
    return upsert(rows, table, ["video", "frame", "marking_key"], order, lambda old, new: F.lit(False), **more)
