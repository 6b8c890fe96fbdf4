"""GeoPackage files: their catalogue, the attribute tables in them, and job metadata; a Python data source over SQLite.

SQLite opens files by local path, so the file must be one that each executor can open at that path.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import CANDIDATE_MARKS
from ..session import ship

METADATA_TABLE = "gpx_video_processor_job_metadata"
KINDS = {"INT": "bigint", "MEDIUMINT": "bigint", "INTEGER": "bigint", "BOOLEAN": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class GeoPackage(DataSource):
    """Options: path, table. One partition for each stretch of row ids."""

    @classmethod
    def name(cls) -> str:
        return "trackloom_gpkg"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {KINDS.get(re.sub(r'[(].*', '', c[2]).upper(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, step: int = 100_000):
        self.path, self.table, self.names, self.step = path, table, schema.names, step
        self.binary = [f.dataType.typeName() == "binary" for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [InputPartition((k, k + self.step)) for k in range(low, high + 1, self.step)] if low is not None else [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names))
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", partition.value):
                yield tuple(bytes(v) if b and v is not None else v for v, b in zip(row, self.binary, strict=True))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(GeoPackage)
    return spark.read.format("trackloom_gpkg").option("path", path).option("table", table).load()


def feature_tables(path: str, candidates_only: bool = False) -> list[str]:
    """Names of the feature tables in order; of those that candidate tables go by if asked."""
    with _open(path) as db:
        names = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
    return [n for n in names if not candidates_only or any(m in n.lower() for m in CANDIDATE_MARKS)]


def write_metadata(path: str, values: dict[str, str]) -> None:
    """Replaces all job metadata in one transaction."""
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {METADATA_TABLE} (key TEXT PRIMARY KEY, value TEXT NOT NULL)")
        db.execute(f"DELETE FROM {METADATA_TABLE}")
        db.executemany(f"INSERT INTO {METADATA_TABLE} VALUES (?, ?)", list(values.items()))
