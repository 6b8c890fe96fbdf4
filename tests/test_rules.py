"""The live rules: machines, windows over a table and streams that stop and go on give the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trackloom.streaming import rules
from trackloom.streaming.state import unsuppressed

COLUMNS = "video string, seq bigint, ts timestamp, frame bigint, n_targets bigint, by_user boolean, external boolean"
MS = 1000


def made(n: int = 160) -> list[tuple]:
    """(video, seq, ms, frame, n_targets, by_user, external) of three videos, with bursts, gaps and equal times."""
    rng, rows, now = random.Random(5), [], 10_000
    for seq in range(n):
        now += rng.choice([0, 20, 150, 300, 400, 900, 1000, 2600, 9000])
        count = rng.choice([0, 0, 1, 2])
        rows.append((rng.choice("abc"), seq, now, rng.choice([1, 1, 1, 2]), count, count > 0 and rng.random() < 0.2, rng.random() < 0.3))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS.replace("ts timestamp", "ms bigint")).withColumn("ts", F.timestamp_millis("ms")).select(*[c.split()[0] for c in COLUMNS.split(", ")])


RULES = {
    "debounce": (rules.Debounce(life_us=4_000_000), lambda t, r: rules.posted(t, r)),
    "suppress": (rules.Suppress(), lambda t, r: unsuppressed(t, r.hold_us).select("video", "seq", F.unix_micros("ts").alias("us"))),
    "clear_grace": (rules.ClearGrace(life_us=20_000_000), lambda t, r: rules.displayed(t, r)),
}


def by_machine(rule: rules.Rule, rows: list[tuple]) -> list[tuple]:
    out = []
    for video in "abc":
        own = [(ms * MS, {"seq": seq, "frame": frame, "n_targets": n, "by_user": user, "external": ext}) for v, seq, ms, frame, n, user, ext in rows if v == video]
        state: dict = {}
        out += [(video, *x) for x in rules.advance(rule, state, own, 1 << 60)]
        assert state == {}  # nothing stays of a session that has ended
    return sorted(out)


@pytest.mark.parametrize("name", RULES)
def test_tables_equal_machines(table, rows, name):
    rule, batch = RULES[name]
    got = sorted(map(tuple, batch(table, rule).collect()))
    assert got == by_machine(rule, rows) and got


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(rules.STORE_SETTING)
    spark.conf.set(rules.STORE_SETTING, rules.ROCKS)
    yield spark
    spark.conf.set(rules.STORE_SETTING, before)


def streamed(spark, folder, rows: list[tuple], apply, cuts: list[int]) -> list[tuple]:
    """What a stream of files gives that is stopped after each part and goes on from its checkpoint."""
    got: list[tuple] = []
    for k, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = rows[low:high]
        random.Random(k).shuffle(part)
        frame = spark.createDataFrame(part, COLUMNS.replace("ts timestamp", "ms bigint")).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
        q = apply(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return got


@pytest.mark.parametrize("name", RULES)
def test_streams_equal_tables_over_restarts(rocks, rows, tmp_path, name):
    rule, _ = RULES[name]
    end = [("z", 10_000, 10_000_000, 1, 0, False, True), ("z", 10_001, 20_000_000, 1, 0, False, True)]  # moves the clock on
    got = [x for x in streamed(rocks, tmp_path, [*rows, *end], lambda s: rules.follow(s, rule), [50, 100, len(rows), len(rows) + 1]) if x[0] != "z"]
    assert sorted(got) == by_machine(rule, rows)


def test_live_debounce_posts_the_last_state_by_the_clock(rocks, rows, tmp_path):
    q, found = None, []
    try:
        rocks.createDataFrame(rows[:30], COLUMNS.replace("ts timestamp", "ms bigint")).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in")
        live = rules.follow(stream, rules.Debounce(quiet_us=300_000, beat_us=1_000_000, life_us=2_000_000), live=True)
        q = live.writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="200 milliseconds").start()
        for _ in range(40):  # a stream with timers of the clock never has nothing to do
            found = rocks.table("live").collect()
            if sum(r.beat for r in found) >= 3:
                break
            q.awaitTermination(1)
    finally:
        if q:
            q.stop()
    newest = {v: max(r[1] for r in rows[:30] if r[0] == v) for v in "abc"}
    assert {r.video for r in found} == set("abc") and all(r.seq == newest[r.video] for r in found)
    assert any(r.beat for r in found)


def test_markings_are_numbered_over_restarts(rocks, table, rows, tmp_path):
    got = streamed(rocks, tmp_path, rows, lambda s: rules.append_markings(s, most=10, life_ms=None), [40, 90])
    assert sorted(got) == sorted(map(tuple, rules.appended(table, most=10).collect()))
    assert max(x[2] for x in got) > 30 and any(x[3] for x in got)


def test_without_the_right_store_it_says_so(spark, table):
    if spark.conf.get(rules.STORE_SETTING, None) != rules.ROCKS:
        with pytest.raises(ValueError, match="stateStore"):
            rules.follow(table, rules.Suppress())
