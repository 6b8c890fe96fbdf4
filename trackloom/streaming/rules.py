"""Live rules of a viewer, each once as a state machine over a stream and once as windows over a finished table.

* ``Debounce`` / ``posted``: a state is posted once nothing was scheduled for ``quiet_us`` after it; every change schedules, and so does a beat each ``beat_us`` from the first
  change of a session on. A session ends ``life_us`` after its last change.
* ``Suppress`` / ``streaming.state.unsuppressed``: own posts are dropped until ``hold_us`` after an external change.
* ``ClearGrace`` / ``displayed``: an empty list of targets clears the displayed ones only if no other state of that frame brings targets, and no other frame comes, within ``grace_us``;
  targets that a user set are replaced by a user's only, and never cleared at the same frame.
* ``append_markings`` / ``appended``: each saved marking gets the next number of its video; the last ``most`` are kept.

In a stream, rows wait in the state until the watermark has passed them, so that a key's rows meet its machine in order of time whatever batch and order they came in, and what is
due without a row is a timer, which a later row cancels. So a stream gives what the table gives, after a restart too. With ``live`` times are those of arrival, and
timers are those of the clock. A key whose session has ended leaves no state behind. The state store must be RocksDB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, ClassVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(value: Any) -> Any:
    """A pandas value as Python's own; missing ones are None."""
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


@dataclass(frozen=True)
class Rule:
    """A machine of one key. Rows come in order of time; ``us`` is a row's time in microseconds.

    ``inputs``: columns of a row besides key and us. ``outputs``: columns of what is emitted besides the key.
    """

    inputs: ClassVar[str] = ""
    outputs: ClassVar[str] = ""

    def take(self, state: dict, us: int, row: dict) -> Iterator[tuple]:
        """What a row makes the key emit; changes the state in place."""
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When the key acts by itself if no row comes before."""
        return None

    def fire(self, state: dict, us: int) -> Iterator[tuple]:
        """What the key emits at the time it was due."""
        return iter(())

    def until(self, state: dict) -> int:
        """Up to when the state matters to a row."""
        raise NotImplementedError


@dataclass(frozen=True)
class Debounce(Rule):
    """Emits (seq, posted_us, beat): the newest state, when it is posted, and whether a beat scheduled that."""

    inputs: ClassVar[str] = "seq bigint"
    outputs: ClassVar[str] = "seq bigint, posted_us bigint, beat boolean"
    quiet_us: int = 300_000
    beat_us: int = 1_000_000
    life_us: int = 60_000_000

    def take(self, state: dict, us: int, row: dict) -> Iterator[tuple]:
        if not state or us > state["last"] + self.life_us:
            state["next"] = us + self.beat_us
        state |= {"last": us, "seq": row["seq"], "pending": us, "beat": False}
        return iter(())

    def due(self, state: dict) -> int | None:
        if not state:
            return None
        times = [state["next"]] if state["next"] <= state["last"] + self.life_us else []
        times += [state["pending"] + self.quiet_us] if state["pending"] is not None else []
        return min(times, default=None)

    def fire(self, state: dict, us: int) -> Iterator[tuple]:
        if state["pending"] is not None and state["pending"] + self.quiet_us == us:
            yield state["seq"], us, state["beat"]
            state["pending"] = None
        if state["next"] == us and us <= state["last"] + self.life_us:
            state |= {"pending": us, "beat": True, "next": us + self.beat_us}

    def until(self, state: dict) -> int:
        return state["last"] + self.life_us


@dataclass(frozen=True)
class Suppress(Rule):
    """Emits (seq, us): external changes, and own posts that none preceded by less than the hold."""

    inputs: ClassVar[str] = "seq bigint, external boolean"
    outputs: ClassVar[str] = "seq bigint, us bigint"
    hold_us: int = 1_200_000

    def take(self, state: dict, us: int, row: dict) -> Iterator[tuple]:
        if row["external"]:
            state["until"] = us + self.hold_us
        if row["external"] or us >= state.get("until", us):
            yield row["seq"], us

    def until(self, state: dict) -> int:
        return state.get("until", 0)


@dataclass(frozen=True)
class ClearGrace(Rule):
    """Emits (seq, us, n_targets) whenever other targets are displayed; of a clearing, seq is the first empty state's and n_targets 0."""

    inputs: ClassVar[str] = "seq bigint, frame bigint, n_targets bigint, by_user boolean"
    outputs: ClassVar[str] = "seq bigint, us bigint, n_targets bigint"
    grace_us: int = 900_000
    life_us: int = 3_600_000_000

    def take(self, state: dict, us: int, row: dict) -> Iterator[tuple]:
        count = row["n_targets"] or 0
        user = bool(row["by_user"]) and count > 0
        new = not state or row["frame"] != state["frame"] or us > state["last"] + self.life_us
        kept = not new and state["user"] and not user
        if new or (not kept and count):
            state |= {"frame": row["frame"], "shown": count, "user": user, "since": None}
            yield row["seq"], us, count
        elif count:
            state["since"] = None
        elif not kept and state["shown"] and state["since"] is None:
            state |= {"since": us, "of": row["seq"]}
        state["last"] = us

    def due(self, state: dict) -> int | None:
        return state["since"] + self.grace_us if state and state["since"] is not None else None

    def fire(self, state: dict, us: int) -> Iterator[tuple]:
        state |= {"shown": 0, "since": None}
        yield state["of"], us, 0

    def until(self, state: dict) -> int:
        return state["last"] + self.life_us


def advance(rule: Rule, state: dict, rows: list[tuple[int, dict]], upto: int) -> Iterator[tuple]:
    """All that a key emits up to a time: what is due goes before a row of the same time. A state that no longer matters is emptied."""

    def act(before: int) -> Iterator[tuple]:
        while (at := rule.due(state)) is not None and at <= before:
            yield from rule.fire(state, at)

    for us, row in rows:
        yield from act(us)
        yield from rule.take(state, us, row)
    yield from act(upto)
    if state and rule.due(state) is None and rule.until(state) <= upto:
        state.clear()


class Follower(StatefulProcessor):
    """Leads a rule's machines through a stream: the rows not yet passed by the time are a list state, the machine is a value state."""

    def __init__(self, rule: Rule, key: str, live: bool):
        self.rule, self.key, self.live = rule, key, live
        self.names = [c.split()[0] for c in rule.inputs.split(", ")]
        self.out = [key, *(c.split()[0] for c in rule.outputs.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string")
        self.waiting = handle.getListState("waiting", f"us bigint, {self.rule.inputs}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(map(plain, r)) for part in rows for r in part[["us", *self.names]].itertuples(index=False, name=None)]
        upto = self.time(timerValues)
        yield from self.go(key, [(upto, *r[1:]) for r in sorted(new, key=lambda r: r[:2])] if self.live else new, upto)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.go(key, [], self.time(timerValues))

    def time(self, values) -> int:
        return 1000 * (values.getCurrentProcessingTimeInMs() if self.live else values.getCurrentWatermarkInMs())

    def go(self, key: tuple, new: list[tuple], upto: int) -> Iterator[pd.DataFrame]:
        held = [*(self.waiting.get() if self.waiting.exists() else ()), *new]
        held.sort(key=lambda r: (r[0], r[1]))
        ready = [(r[0], dict(zip(self.names, r[1:], strict=True))) for r in held if r[0] <= upto]
        held = [tuple(r) for r in held[len(ready) :]]
        state = json.loads(self.machine.get()[0]) if self.machine.exists() else {}
        out = list(advance(self.rule, state, ready, upto))
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        if state:
            self.machine.update((json.dumps(state),))
        else:
            self.machine.clear()
        self.wake(state, held)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=self.out)

    def wake(self, state: dict, held: list[tuple]) -> None:
        """One timer at most: for what comes next. Those that a row made stale are taken back."""
        at = [held[0][0]] if held else []
        if state:
            due = self.rule.due(state)
            at.append(self.rule.until(state) if due is None else due)
        wanted = -(-min(at) // 1000) if at else None
        for there in list(self.handle.listTimers()):
            if there == wanted:
                wanted = None
            else:
                self.handle.deleteTimer(there)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


def needs_rocks(df: DataFrame) -> None:
    if df.sparkSession.conf.get(STORE_SETTING, None) != ROCKS:
        raise ValueError(f"set {STORE_SETTING} to {ROCKS}: states with lists and timers are kept there")


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def follow(rows: DataFrame, rule: Rule, key: str = "video", time: str = "ts", delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """The rule over a stream of (key, time, the rule's inputs). delay: how late a row may come; later ones are dropped. Rows without a time are, too."""
    needs_rocks(rows)
    ship(rows.sparkSession)
    timed = rows.where(F.col(time).isNotNull()).withColumn("__at", F.col(time).cast("timestamp"))
    names = [c.split()[0] for c in rule.inputs.split(", ")]
    timed = timed.select(key, "__at", F.unix_micros("__at").alias("us"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in rule.inputs.split(", ")])
    if not live:
        timed = timed.withWatermark("__at", delay)
    given = timed.select(key, *(["__at"] if not live else []), "us", *names).groupBy(key)
    return given.transformWithStateInPandas(Follower(rule, key, live), f"{key} {kind_of(rows, key)}, {rule.outputs}", "Append", "ProcessingTime" if live else "EventTime")


def posted(changes: DataFrame, rule: Debounce | None = None, key: str = "video", time: str = "ts") -> DataFrame:
    """(key, seq, posted_us, beat) of a finished table of changes (key, seq, time), as ``Debounce`` posts them, beats after the last change included."""
    rule = rule or Debounce()
    rows = changes.where(F.col(time).isNotNull()).select(key, "seq", F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    order = Window.partitionBy(key).orderBy("us", "seq")
    new = F.coalesce(F.col("us") - F.lag("us").over(order) > rule.life_us, F.lit(True))
    rows = rows.withColumn("session", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy(key, "session").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    beats = ends.where(F.lit(rule.beat_us) <= F.col("last") - F.col("first") + rule.life_us)
    beats = beats.select(key, F.explode(F.sequence(F.col("first") + rule.beat_us, F.col("last") + rule.life_us, F.lit(rule.beat_us))).alias("us"))
    both = rows.select(key, "us", "seq", F.lit(False).alias("beat")).unionByName(beats.select(key, "us", F.lit(None).cast(kind_of(rows, "seq")).alias("seq"), F.lit(True).alias("beat")))
    order = Window.partitionBy(key).orderBy("us", F.col("beat").desc(), "seq")
    scheduled = both.withColumn("after", F.lead("us").over(order)).withColumn("seq", F.last("seq", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = scheduled.where(F.col("after").isNull() | (F.col("after") - F.col("us") >= rule.quiet_us))
    return kept.select(key, "seq", (F.col("us") + rule.quiet_us).alias("posted_us"), "beat")


def displayed(states: DataFrame, rule: ClearGrace | None = None, key: str = "video", time: str = "ts") -> DataFrame:
    """(key, seq, us, n_targets) of a finished table of states (key, seq, time, frame, n_targets, by_user), as ``ClearGrace`` displays them."""
    rule = rule or ClearGrace()
    rows = states.where(F.col(time).isNotNull()).select(
        key, "seq", "frame", F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"), (F.coalesce("by_user", F.lit(False)) & (F.col("n_targets") > 0)).alias("user")
    )
    order = Window.partitionBy(key).orderBy("us", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = ~F.col("frame").eqNullSafe(F.lag("frame").over(order)) | F.coalesce(F.col("us") - F.lag("us").over(order) > rule.life_us, F.lit(True))
    rows = rows.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(upto))
    within = Window.partitionBy(key, "run").orderBy("us", "seq")
    rows = rows.withColumn("by_user", F.coalesce(F.max(F.col("user").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    shown = F.col("new") | ((F.col("n_targets") > 0) & (F.col("user") | ~F.col("by_user")))
    # a stretch of empty states begins after a state with targets and lasts to the next one, to another frame, or for ever
    begins = (F.col("n_targets") == 0) & ~F.col("new") & ~F.col("by_user") & (F.lag("n_targets").over(order) > 0)
    back = Window.partitionBy(key).orderBy(F.col("us").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.last(F.when((F.col("n_targets") > 0) | F.col("new"), F.col("us")), True).over(back)
    rows = rows.withColumn("shown", shown).withColumn("clears", begins & F.coalesce(ends - F.col("us") >= rule.grace_us, F.lit(True)))
    told = rows.where("shown").select(key, "seq", "us", "n_targets")
    cleared = rows.where("clears").select(key, "seq", (F.col("us") + rule.grace_us).alias("us"), F.lit(0).cast(kind_of(rows, "n_targets")).alias("n_targets"))
    return told.unionByName(cleared)


class Appender(StatefulProcessor):
    """The kept markings of each key as a list state, with a time to live where one is given."""

    def __init__(self, key: str, most: int, life_ms: int | None):
        self.key, self.most, self.life_ms = key, most, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "id bigint, seq bigint", self.life_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        out = []
        for (seq,) in sorted(r for part in rows for r in part[["seq"]].itertuples(index=False, name=None)):
            kept.append((max((k for k, _ in kept), default=0) + 1, int(seq)))
            gone = kept.pop(0) if len(kept) > self.most else (None, None)
            out.append((key[0], int(seq), kept[-1][0], gone[0]))
        self.kept.put(kept)
        yield pd.DataFrame(out, columns=[self.key, "seq", "id", "dropped_id"]).astype({"id": "Int64", "dropped_id": "Int64"})

    def close(self) -> None:
        pass


def append_markings(markings: DataFrame, key: str = "video", most: int = 100, life_ms: int | None = 86_400_000) -> DataFrame:
    """(key, seq, id, dropped_id) of a stream of saved markings (key, seq): numbers go on over batches and restarts; of each key the last ``most`` are kept.

    Markings of one batch are numbered in order of seq. A key that saves nothing for ``life_ms`` by the clock starts anew; with None, which a query that is to end by itself
    needs, keys are kept for ever.
    """
    needs_rocks(markings)
    ship(markings.sparkSession)
    rows = markings.select(key, F.col("seq").cast("bigint").alias("seq")).groupBy(key)
    return rows.transformWithStateInPandas(Appender(key, most, life_ms), f"{key} {kind_of(markings, key)}, seq bigint, id bigint, dropped_id bigint", "Append", "ProcessingTime" if life_ms else "None")


def appended(markings: DataFrame, key: str = "video", most: int = 100) -> DataFrame:
    """The same of a finished table."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("seq")).cast("bigint")
    return markings.select(key, "seq", number.alias("id")).withColumn("dropped_id", F.when(F.col("id") > most, F.col("id") - most))
