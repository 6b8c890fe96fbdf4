"""Pointer tables, the source of newest documents and the sink of placed ones: restarts, failures, two writers."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackloom.operators import keyed
from trackloom.streaming import documents


def rows_of(spark, table: str) -> list[tuple]:
    return sorted(map(tuple, keyed.read(spark, table).collect()), key=str)


def frames(spark, video: str, count: int, mark: int):
    return spark.range(count).select(F.lit(video).alias("video"), F.col("id").alias("frame"), F.lit(mark).alias("mark"))


def test_groups_are_replaced_only_by_rows(spark, tmp_path):
    table = f"file:{tmp_path}/t"
    assert keyed.version(spark, table) is None
    assert keyed.replace_groups(frames(spark, "a", 5, 1).union(frames(spark, "b", 3, 1)), table, ["video"], buckets=8).number == 1
    untouched = keyed.version(spark, table).folders
    keyed.replace_groups(frames(spark, "a", 2, 2), table, ["video"])
    assert rows_of(spark, table) == sorted([("a", 0, 2), ("a", 1, 2), *(("b", k, 1) for k in range(3))], key=str)
    assert keyed.replace_groups(frames(spark, "a", 0, 3), table, ["video"]) is None  # nothing takes the place of nothing
    after = keyed.version(spark, table).folders
    assert len(set(untouched.values()) & set(after.values())) == 1  # the bucket of b stayed where it was
    keyed.replace(frames(spark, "c", 1, 4), table, ["video"])
    keyed.replace(frames(spark, None, 1, 5), table, ["video"])
    assert rows_of(spark, table) == [(None, 0, 5)]
    assert len(os.listdir(tmp_path / "t/versions")) <= 2 * 2  # old pointers are gone, two and their checksums stay
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, f"file:{tmp_path}/nothing")


def test_a_failing_write_changes_nothing(spark, tmp_path):
    table = f"file:{tmp_path}/t"
    keyed.replace(frames(spark, "a", 5, 1), table, ["video"], buckets=4)
    before, there = rows_of(spark, table), sorted(os.listdir(tmp_path / "t/data"))
    broken = frames(spark, "a", 5, 2).withColumn("mark", F.when(F.col("frame") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("mark")))
    with pytest.raises(Exception, match="no"):
        keyed.replace(broken, table, ["video"])
    assert rows_of(spark, table) == before and sorted(os.listdir(tmp_path / "t/data")) == there


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    table = f"file:{tmp_path}/t"
    first = keyed.replace(frames(spark, "a", 1, 1), table, ["video"], expect=0)
    with pytest.raises(keyed.Conflict):
        keyed.replace(frames(spark, "a", 1, 2), table, ["video"], expect=0)
    sly = keyed._put  # the other writer puts its pointer while this one has written its rows

    def late(spark, path, text):
        monkeypatch.setattr(keyed, "_put", sly)
        keyed.replace(frames(spark, "a", 1, 7), table, ["video"])
        sly(spark, path, text)

    monkeypatch.setattr(keyed, "_put", late)
    with pytest.raises(keyed.Conflict):
        keyed.replace(frames(spark, "a", 1, 8), table, ["video"], expect=first.number)
    assert rows_of(spark, table) == [("a", 0, 7)]


def test_offsets_move_by_a_hundredth_of_a_degree(spark, tmp_path):
    table, columns = f"file:{tmp_path}/t", "video string, seq bigint, viewer_front_offset_deg double"
    put = lambda *rows: keyed.put_offsets(spark.createDataFrame(list(rows), columns), table, buckets=16)
    put(("a", 1, 359.0), ("a", 2, 10.0), ("b", 1, 179.999), ("c", 1, None))
    assert rows_of(spark, table) == [("a", 2, 10.0), ("b", 1, pytest.approx(179.999))]
    assert put(("a", 3, 10.005), ("b", 2, -179.995)) is None  # too little, over the seam too
    made = put(("a", 4, 10.02), ("b", 3, None))
    assert rows_of(spark, table) == [("a", 4, pytest.approx(10.02)), ("b", 1, pytest.approx(179.999))] and made.number == 2


def test_markings_are_added_once(spark, tmp_path):
    table = f"file:{tmp_path}/t"
    columns = "video string, frame bigint, target_id bigint, target_order bigint, target_yaw double, target_pitch double, created_at string"
    rows = [("v", 1, 1, 1, 0.0, 0.0, "a"), ("v", 1, 2, 2, 5.0, 0.0, "b"), (None, 1, None, None, 5.0, 1.0, "c")]
    write = keyed.in_batches(lambda df, n: keyed.put_markings(df, table, note=n), spark, table)
    write(spark.createDataFrame(rows[:2], columns), 0)
    write(spark.createDataFrame([("v", 1, 9, 9, 0.0, 0.0, "z")], columns), 0)  # the same batch again
    write(spark.createDataFrame([rows[1][:-1] + ("later",), rows[2], rows[2]], columns), 1)
    got = sorted((r.video or "", r.target_id or 0, r.created_at) for r in keyed.read(spark, table).collect())
    assert got == [("", 0, "c"), ("v", 1, "a"), ("v", 2, "b")]


def poll(spark, tmp_path, got: list, fail: bool = False):
    stream = documents.poll_documents(spark, str(tmp_path / "in"), str(tmp_path / "spool"))

    def each(df, number):
        found = sorted((os.path.basename(r.path), json.loads(r.document)["n"]) for r in df.collect())
        if fail and found:
            got.append(("seen", found))
            raise RuntimeError("lost")
        got.extend(found)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(60)
    except Exception:
        if not fail:
            raise


def document(path: Path, n, at: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(n if isinstance(n, str) else json.dumps({"n": n}))
    os.utime(path, (at, at))


def test_newest_documents_are_read_once_over_restarts(spark, tmp_path):
    got: list = []
    (tmp_path / "in").mkdir()
    document(tmp_path / "in/a.json", 1, 100)
    document(tmp_path / "in/deep/b.json", 1, 100)
    document(tmp_path / "in/broken.json", "{", 100)
    document(tmp_path / "in/list.json", "[1]", 100)
    document(tmp_path / "in/other.txt", "x", 100)
    poll(spark, tmp_path, got)
    assert sorted(got) == [("a.json", 1), ("b.json", 1)]
    got.clear()
    poll(spark, tmp_path, got)
    assert got == []  # nothing new, nothing again
    document(tmp_path / "in/a.json", 2, 200)
    document(tmp_path / "in/a.json", 3, 300)
    document(tmp_path / "in/broken.json", 5, 300)
    poll(spark, tmp_path, got, fail=True)
    assert got == [("seen", [("a.json", 3), ("broken.json", 5)])]
    got.clear()
    document(tmp_path / "in/a.json", 4, 400)  # replaced after the batch that was lost
    (tmp_path / "in/broken.json").unlink()
    poll(spark, tmp_path, got)
    poll(spark, tmp_path, got)
    assert got == [("a.json", 3), ("broken.json", 5), ("a.json", 4)]  # the lost batch as it was, then what came after


def test_documents_are_placed_whole(spark, tmp_path):
    schema = "video string, seq bigint, document string"
    for k, rows in enumerate([[("v/1", 1, "old"), ("v/1", 2, "x" * 100_000), ("w", 1, "w1")], [("v/1", 3, "new"), ("w", 2, None), (None, 9, "?")]]):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        q = documents.place_documents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        here = {p.name: p.read_text() for p in (tmp_path / "out").glob("*.json")}
        assert here == {"v_2f1.json": "x" * 100_000 if k == 0 else "new", "w.json": "w1"}
    assert list((tmp_path / "out/_staged").iterdir()) == []


def test_a_batch_that_is_committed_twice_or_aborted_changes_nothing(tmp_path):
    writer = documents.PlacingWriter(str(tmp_path))
    row = lambda n, text: {"key": "k", "ord": n, "document": text}
    writer.commit([writer.write(iter([row(1, "one")])), writer.write(iter([row(2, "two")])), None], 0)
    assert (tmp_path / "k.json").read_text() == "two"
    writer.commit([writer.write(iter([row(3, "again")]))], 0)
    writer.abort([writer.write(iter([row(4, "aborted")]))], 1)
    assert (tmp_path / "k.json").read_text() == "two" and list((tmp_path / "_staged").iterdir()) == []
