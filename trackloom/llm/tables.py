"""Where operators keep intermediate tables, and helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

_FOLDERS: dict[str, str] = {}


#: Batches of texts hold at most so many bytes (or one row) where the session has Spark's own limit, eight times that: each is in memory several times.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def map_arrow(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_SETTING).removesuffix("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application inside ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (tests, local mode) a temporary folder is made and set instead.
    The folder is removed when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="trackloom-")
        _FOLDERS[app] = f"{top.rstrip('/')}/trackloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, on whatever store it is."""
    if spark.sparkContext._jsc is not None:  # noqa: SLF001
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_rows(df: DataFrame, key: str, n: int, seed: int) -> list[Row]:
    """At most n rows of a table, those of the smallest hashes of the key.

    Rows are first thinned by the hash to about twice as many, so that no task sorts more than that.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    if total > 4 * n:
        df = df.where(place < F.lit(int((1 << 40) * 2.0 * n / total)))
    return df.orderBy(place, *df.columns).limit(n).collect()


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The same as a local table of bounded size."""
    return df.sparkSession.createDataFrame(hashed_rows(df, key, n, seed), df.schema)


def range_pieces(df: DataFrame, key: str, tie: str, pieces: int, by: Column | None = None) -> Column:
    """Numbers of about ``pieces`` equal pieces in ascending order of a bigint key, nulls first.

    A key that fills several pieces by itself has as many of its own, among which its rows are dealt out by a hash of ``tie``; so have nulls. With ``by``, an evenly
    spread number from 0 to 1, they are dealt out by its ranges, so pieces are in order of the key and then of that number.
    """
    at = [k / pieces for k in range(1, max(2, pieces))]
    found = df.agg(F.percentile_approx(key, at, 10_000).alias("at"), F.count("*").alias("n"), F.count(key).alias("known")).first()
    marks = Counter(x for x in found["at"] or [] if x is not None)
    heavy = {x: n for x, n in marks.items() if n > 1}
    edges = sorted(set(marks) | {x + 1 for x in heavy if x + 1 < 1 << 63})
    nulls = max(1, -(-(found["n"] - found["known"]) * pieces // max(1, found["n"])))
    most = max([nulls, *heavy.values()])
    own = F.when(F.col(key).isNull(), nulls)
    for x, n in sorted(heavy.items()):
        own = own.when(F.col(key) == F.lit(x), n)
    own = own.otherwise(1)
    within = F.pmod(F.xxhash64(tie), own).cast("int") if by is None else F.least(own - 1, F.floor(by * own)).cast("int")
    bucket = F.when(F.col(key).isNull(), 0).otherwise(1 + (_bucket(F.col(key), edges) if edges else F.lit(0)))
    return (bucket * most + within).cast("int")


def _bucket(key: Column, edges: list) -> Column:
    """A balanced tree of comparisons: log2(edges) of them for each row."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(edges[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(edges))


def ranked(df: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in the order, counted anew for each value of the ``within`` columns, by which rows are ordered first.

    Rows are dealt out by ranges of the whole order and sorted in their tasks, written, and counted by file; a place is the row's number in its file plus the
    rows of earlier files. So no window, key or source is gathered in one task: rows that are equal in the whole order are told apart by where they were written,
    and only a row for each file and ``within`` value is summed up.
    """
    spark, columns, within = df.sparkSession, df.columns, within or []
    at, tie, part = free_name(df, "at"), free_name(df, "tie"), free_name(df, "part")
    first = written(df, "unsorted").select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias(tie))
    keys = [*[F.col(f"`{c}`") for c in within], *order, F.col(tie)]
    dealt = written(first.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[f"`{c}`" for c in columns]), "sorted")
    number = F.concat(*[F.lpad(F.regexp_extract("_metadata.file_name", p, 1), 9, "0") for p in (r"part-(\d+)", r"-c(\d+)\.")])
    rows = dealt.select("*", number.alias(part), F.col("_metadata.row_index").alias(at))
    runs = rows.groupBy(part, *within).agg(F.min(at).alias("__first"), F.count("*").alias("__count"))
    earlier = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("__shift", F.coalesce(F.sum("__count").over(earlier), F.lit(0)) - F.col("__first")).drop("__first", "__count"), "runs")
    named = runs.withColumnsRenamed({part: "__in", **{c: f"__of_{k}" for k, c in enumerate(within)}})
    same = F.col(part) == F.col("__in")
    for k, c in enumerate(within):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__of_{k}"))
    joined = rows.join(named, same)
    return joined.select(*[f"`{c}`" for c in columns], (F.col(at) + F.col("__shift")).alias(name))


def column_or_null(df: DataFrame, name: str, kind: str | T.DataType) -> Column:
    """A column in the kind asked for, or nulls where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def free_name(df: DataFrame, name: str) -> str:
    """The name with underscores before it until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
