"""State documents as a streaming source and sink: small JSON files that are replaced in place, one for each viewer.

``NewestDocuments`` (format ``state_documents``) reads only the newest document of each path and leaves out missing and broken ones. Its offsets are numbers of polls; a poll's
findings (path, modification time, size) are kept in a spool folder, and so is each document as the first task read it, with its digest. A batch that
is planned again after a restart therefore reads what it read before, though the file has been replaced meanwhile, and nothing is lost or read twice. Spooled documents are removed once Spark has
committed past them. The driver holds a line for each path, never a document.

``StateFiles`` (format ``state_files``) puts documents in their places: tasks write to staging names, and only the commit of the batch moves each key's newest document to its
final name by a rename, so a reader sees the old document or the new one. An aborted batch removes what it staged; a batch that is run again is left out.

Paths are those of ``pyarrow.fs`` and must be seen by the driver and all executors.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

SCHEMA = "path string, modified timestamp, digest string, document string"
#: Paths that one task reads.
SLICE = 200


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole(files: fs.FileSystem, path: str) -> bytes | None:
    """A file's bytes; None where it is missing."""
    try:
        with files.open_input_stream(path, compression=None) as stream:
            return stream.read()
    except (FileNotFoundError, OSError):
        return None


def put(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file under another name and renames it, so nobody sees half of it."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(staged, compression=None) as stream:
        stream.write(content)
    files.move(staged, path)


def parsed(content: bytes | None) -> str | None:
    """The text of a document that is a JSON object; None of any other."""
    if content is None:
        return None
    try:
        text = content.decode("utf-8-sig")
        return text if isinstance(json.loads(text), dict) else None
    except ValueError:
        return None


@dataclass
class Slice(InputPartition):
    poll: int
    number: int
    paths: list  # of (path, modification time in ns)

    def __init__(self, poll: int, number: int, paths: list):
        super().__init__((poll, number))
        self.poll, self.number, self.paths = poll, number, paths


class PollReader(DataSourceStreamReader):
    def __init__(self, folder: str, spool: str, suffix: str):
        self.folder, self.spool, self.suffix = folder, spool, suffix

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def _listing(self, poll: int) -> dict:
        files, spool = opened(self.spool)
        said = whole(files, f"{spool}/{poll:09d}.json") if poll else None
        return json.loads(said) if said else {"seen": {}, "new": []}

    def _polls(self) -> list[int]:
        files, spool = opened(self.spool)
        files.create_dir(spool, recursive=True)
        found = files.get_file_info(fs.FileSelector(spool))
        return sorted(int(f.base_name[:-5]) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json"))

    def latestOffset(self) -> dict:  # noqa: N802
        """Looks at the folder; a poll that finds something new gets the next number and its listing is spooled before it is told."""
        files, folder = opened(self.folder)
        polls = self._polls()
        last = polls[-1] if polls else 0
        seen = self._listing(last)["seen"]
        found = {f.path: [f.mtime_ns, f.size] for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix)}
        new = sorted(p for p, at in found.items() if seen.get(p) != at)
        if not new:
            return {"poll": last}
        spools, spool = opened(self.spool)
        put(spools, f"{spool}/{last + 1:09d}.json", json.dumps({"seen": found, "new": [(p, found[p][0]) for p in new]}).encode())
        return {"poll": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """The polls after start, up to end. A path that several of them found is read at the last."""
        last: dict[str, tuple[int, int]] = {}
        for poll in range(start["poll"] + 1, end["poll"] + 1):
            last |= {p: (poll, at) for p, at in self._listing(poll)["new"]}
        out = []
        for poll in sorted({poll for poll, _ in last.values()}):
            paths = sorted((p, at) for p, (of, at) in last.items() if of == poll)
            out += [Slice(poll, k, paths[low : low + SLICE]) for k, low in enumerate(range(0, len(paths), SLICE))]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.folder)
        spools, spool = opened(self.spool)
        kept = f"{spool}/{partition.poll:09d}"
        rows = []
        for path, at in partition.paths:
            copy = f"{kept}/{hashlib.sha256(path.encode()).hexdigest()}.json"
            text = parsed(whole(spools, copy))
            if text is None:  # the first reading: what is there now is what this poll gives from now on
                content = whole(files, path)
                text = parsed(content)
                if text is None:
                    continue
                spools.create_dir(kept, recursive=True)
                put(spools, copy, content)
            rows.append((path, at // 1000, hashlib.sha256(text.encode()).hexdigest(), text))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "modified", "digest", "document"])

    def commit(self, end: dict) -> None:
        """Spooled documents up to end, and listings before it, aren't asked for again."""
        spools, spool = opened(self.spool)
        for poll in self._polls():
            if poll <= end["poll"]:
                with contextlib.suppress(FileNotFoundError, OSError):
                    spools.delete_dir(f"{spool}/{poll:09d}")
            if poll < end["poll"]:
                spools.delete_file(f"{spool}/{poll:09d}.json")


class NewestDocuments(DataSource):
    """Options: path (a folder, looked through with all below), spool (a folder of this query's own), suffix (.json)."""

    @classmethod
    def name(cls) -> str:
        return "state_documents"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PollReader:  # noqa: N802
        return PollReader(self.options["path"], self.options["spool"], self.options.get("suffix", ".json"))


def poll_documents(spark: SparkSession, path: str, spool: str, suffix: str = ".json") -> DataFrame:
    """A stream of (path, modified, digest, document): of each poll the documents that are new or have changed."""
    ship(spark)
    spark.dataSource.register(NewestDocuments)
    return spark.readStream.format("state_documents").options(path=path, spool=spool, suffix=suffix).load()


@dataclass
class Staged(WriterCommitMessage):
    files: list  # of (key, order, staged path)


class PlacingWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Staged:
        """Stages the newest document of each key of a task."""
        files, folder = opened(self.folder)
        newest: dict[str, tuple] = {}
        for row in iterator:
            if row["key"] is not None and row["document"] is not None and (row["key"] not in newest or row["ord"] >= newest[row["key"]][0]):
                newest[row["key"]] = (row["ord"], row["document"])
        staged = []
        if newest:
            files.create_dir(f"{folder}/_staged", recursive=True)
        for key, (order, document) in newest.items():
            path = f"{folder}/_staged/{uuid.uuid4().hex}"
            with files.open_output_stream(path, compression=None) as stream:
                stream.write(document.encode())
            staged.append((key, order, path))
        return Staged(staged)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        """Moves the newest of each key, then notes the batch; what is left of older ones is removed."""
        files, folder = opened(self.folder)
        note = f"{folder}/_committed"
        staged = sorted((key, order, path) for m in messages if m is not None for key, order, path in m.files)
        done = whole(files, note)
        newest = {key: path for key, _, path in staged} if done is None or int(done) < batchId else {}
        for key, path in newest.items():
            files.move(path, f"{folder}/{name_of(key)}")
        for _, _, path in staged:
            if path not in newest.values():
                with contextlib.suppress(FileNotFoundError, OSError):
                    files.delete_file(path)
        if done is None or int(done) < batchId:
            files.create_dir(folder, recursive=True)
            put(files, note, str(batchId).encode())

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files, _ = opened(self.folder)
        for path in (path for m in messages if m is not None for _, _, path in m.files):
            with contextlib.suppress(FileNotFoundError, OSError):
                files.delete_file(path)


def name_of(key: str) -> str:
    """A file name of a key: letters, digits, dots and dashes stay, the rest is written as its UTF-8 bytes, so different keys have different names."""
    plain = "".join(c if c.isascii() and (c.isalnum() or c in "-.") else "".join(f"_{b:02x}" for b in c.encode()) for c in key)
    return f"{plain}.json"


class StateFiles(DataSource):
    """Option: path (a folder). Columns: key string, ord bigint, document string."""

    @classmethod
    def name(cls) -> str:
        return "state_files"

    def streamWriter(self, schema: StructType, overwrite: bool) -> PlacingWriter:  # noqa: N802
        return PlacingWriter(self.options["path"])


def place_documents(states: DataFrame, path: str, checkpoint: str, key: str = "video", order: str = "seq", document: str = "document"):
    """A stream writer, not yet started, that keeps each key's newest document at ``path``/<key>.json. Keys without a document are left as they are."""
    spark = states.sparkSession
    ship(spark)
    spark.dataSource.register(StateFiles)
    rows = states.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("ord"), F.col(document).cast("string").alias("document"))
    return rows.writeStream.format("state_files").option("path", path).option("checkpointLocation", checkpoint)
