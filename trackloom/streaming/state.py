"""Viewer states as a stream: the latest document of each video, merged field by field, with repeats and known commands dropped.

A video that sends nothing for ``life`` by the clock is forgotten: its next state is as its first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import keyed
from ..operators.trajectory import step
from ..session import ship

#: Fields that a new state of the same frame takes from the one before where it doesn't bring them itself.
CARRIED = ("viewer_camera_height_m", "viewer_hud_height_scale", "viewer_front_offset_deg")
FIELDS = ("frame_index", "yaw", "pitch", "zoom", *CARRIED, "radar", "target", "targets", "view_only", "updated_at")
SCHEMA = "video string, seq bigint, frame_index bigint, yaw double, pitch double, zoom double, viewer_camera_height_m double, viewer_hud_height_scale double, viewer_front_offset_deg double, radar string, target string, targets string"
STATE = "frame_index bigint, viewer_camera_height_m double, viewer_hud_height_scale double, viewer_front_offset_deg double, radar string, target string, targets string, known int"


def merged(before: dict | None, new: dict) -> dict:
    """A state after the one before: of the same frame, radar is kept, limits and offset where absent, targets only for view-only posts."""
    out = dict(new)
    if before is not None and before["frame_index"] == new["frame_index"]:
        out["radar"] = before["radar"] if before["radar"] is not None else new["radar"]
        for name in CARRIED:
            if new[name] is None:
                out[name] = before[name]
        if new.get("view_only"):
            for name in ("target", "targets"):
                if new[name] is None:
                    out[name] = before[name]
    return out


#: How long a video's state is kept without a new one.
LIFE_MS = 86_400_000


def _plain(value):
    return None if value is None or (not isinstance(value, str) and pd.isna(value)) else value


def timeout(life_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if life_ms else GroupStateTimeout.NoTimeout


def lived(step, life_ms: int | None):
    """A group's step whose state goes when its time is over; until then each batch gives it the whole time anew. None, for queries that are to end by themselves: it stays."""
    if not life_ms:
        return step

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from step(key, batches, state)
        if state.exists:
            state.setTimeoutDuration(life_ms)

    return run


def _merge_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STATE.split(", ")][:-1]
    before = dict(zip(names, state.get[:-1], strict=True)) if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for record in rows.to_dict("records"):
        new = {k: _plain(v) for k, v in record.items()}
        before = merged(before, new)
        out.append({**new, **{k: before[k] for k in before if k in new}})
    if before is not None:
        state.update(tuple(before[n] for n in names) + (1,))
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    yield pd.DataFrame(out).reindex(columns=columns)


def merge_states(states: DataFrame, life_ms: int | None = LIFE_MS) -> DataFrame:
    """Each state of a video after the merge with the one before it; states: SCHEMA columns and ``view_only``. One row of state for each video."""
    ship(states.sparkSession)
    return states.groupBy("video").applyInPandasWithState(lived(_merge_group, life_ms), SCHEMA, STATE, "append", timeout(life_ms))


def merge_states_batch(states: DataFrame) -> DataFrame:
    """The same over a table, by windows: within a run of one frame, limits and offset are the last known ones, radar the first known one, and targets those of the
    last state that isn't view-only or brings its own."""
    order = Window.partitionBy("video").orderBy("seq")
    runs = states.withColumn("__new", ~F.col("frame_index").eqNullSafe(F.lag("frame_index").over(order)) | F.lag(F.lit(1)).over(order).isNull())
    runs = runs.withColumn("__run", F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = Window.partitionBy("video", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = {name: F.last(name, True).over(upto) for name in CARRIED} | {"radar": F.first("radar", True).over(upto)}
    for name in ("target", "targets"):
        brings = F.col("__new") | ~F.coalesce("view_only", F.lit(False)) | F.col(name).isNotNull()
        kept[name] = F.last(F.when(brings, F.struct(name)), True).over(upto)[name]
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    return runs.select(*[kept.get(c, F.col(c)).alias(c) for c in columns])


def signature(*fields: Column) -> Column:
    """A digest of the fields, numbers to three decimals."""
    return F.sha2(F.to_json(F.struct(*[f.alias(f"f{k}") for k, f in enumerate(fields)])).cast("binary"), 256)


def changes(states: DataFrame, signed: Column, key: str = "video", order: str = "seq") -> DataFrame:
    """States of a table whose signature differs from the one before."""
    before = F.lag("__signature").over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("__signature", signed).withColumn("__before", before).where("NOT (__signature <=> __before)").drop("__signature", "__before")


def _changed_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    keep = []
    for value in rows["signature"]:
        keep.append(value != last)
        last = value
    state.update((last,))
    yield rows[keep]


def changes_stream(states: DataFrame, life_ms: int | None = LIFE_MS) -> DataFrame:
    """video, seq, signature of streamed states whose signature is new for their video."""
    ship(states.sparkSession)
    schema = "video string, seq bigint, signature string"
    return states.select("video", "seq", "signature").groupBy("video").applyInPandasWithState(lived(_changed_group, life_ms), schema, "signature string", "append", timeout(life_ms))


def new_commands(commands: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Commands whose id hasn't been seen within the delay; the delay bounds the state that is kept."""
    return commands.withWatermark(time, delay).dropDuplicatesWithinWatermark(["command_id"])


def _held_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, radius, last = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for frame, now, metres in zip(rows["frame"], rows["heading"], rows["distance_m"], strict=True):
        held, radius = step(held, radius, last, int(frame), _plain(now), _plain(metres))
        last = int(frame)
        out.append((held, radius))
    state.update((held, radius, last))
    yield rows.assign(held_heading=[h for h, _ in out], radius_m=[r for _, r in out])


def held_headings_stream(visits: DataFrame, life_ms: int | None = LIFE_MS) -> DataFrame:
    """The heading held by each video over a stream of visits (video, seq, frame, heading, distance_m)."""
    ship(visits.sparkSession)
    schema = "video string, seq bigint, frame bigint, heading double, distance_m double, held_heading double, radius_m double"
    rows = visits.select("video", "seq", "frame", "heading", "distance_m")
    return rows.groupBy("video").applyInPandasWithState(lived(_held_group, life_ms), schema, "held double, radius double, last bigint", "append", timeout(life_ms))


def view_equal(yaw_a: Column, pitch_a: Column, zoom_a: Column, yaw_b: Column, pitch_b: Column, zoom_b: Column) -> Column:
    """Views that differ by less than a hundredth of a degree and a thousandth of zoom."""
    turn = F.abs(F.pmod(yaw_a - yaw_b + 180.0, F.lit(360.0)) - 180.0)
    return (turn < 0.01) & (F.abs(pitch_a - pitch_b) < 0.01) & (F.abs(zoom_a - zoom_b) < 0.001)


def append_marking(targets: Column, new: Column, most: int = 100) -> Column:
    """The list with the new marking, whose id and order follow the largest so far; the last ``most`` stay."""
    ids = F.transform(targets, lambda t: F.coalesce(t["id"], t["order"], F.lit(0)))
    number = F.coalesce(F.array_max(ids), F.lit(0)) + 1
    added = F.array_append(targets, new.withField("id", number.cast("bigint")).withField("order", number.cast("bigint")))
    return F.slice(added, F.greatest(F.size(added) - (most - 1), F.lit(1)), most)


def store_markings(spark: SparkSession, table: str, order: str = "created_at"):
    """A foreachBatch function that adds the markings of a batch which the table doesn't hold yet: only the buckets of new keys are read and written, and a batch that
    runs twice changes nothing."""
    return keyed.in_batches(lambda batch, number: keyed.put_markings(batch, table, order, note=number), spark, table)


def settled(changes: DataFrame, quiet_us: int = 300_000, key: str = "video", time: str = "ts") -> DataFrame:
    """The changes after which nothing changed for so long: what is posted of a burst is its last state. The last change of all counts."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    after = F.lead(us).over(Window.partitionBy(key).orderBy(time, "seq"))
    return changes.withColumn("__after", after - us).where(F.col("__after").isNull() | (F.col("__after") >= quiet_us)).drop("__after")


def unsuppressed(posts: DataFrame, hold_us: int = 1_200_000, key: str = "video", time: str = "ts") -> DataFrame:
    """The posts without own ones that follow an external change too soon; ``external`` tells the two apart."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    last = F.max(F.when(F.col("external"), us)).over(Window.partitionBy(key).orderBy(time, "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return posts.withColumn("__since", us - last).where(F.col("external") | F.col("__since").isNull() | (F.col("__since") >= hold_us)).drop("__since")


def graced(states: DataFrame, grace_us: int = 900_000, key: str = "video", time: str = "ts") -> DataFrame:
    """states (key, frame, seq, time, n_targets) with cleared: whether an empty list counts, having stayed empty for so long at the same frame."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    order = Window.partitionBy(key).orderBy(time, "seq")
    new = (F.col("n_targets") > 0) | ~F.col("frame").eqNullSafe(F.lag("frame").over(order)) | (F.lag("n_targets").over(order) > 0)
    rows = states.withColumn("__run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(us).over(Window.partitionBy(key, "__run"))
    return rows.withColumn("cleared", (F.col("n_targets") == 0) & (us - first >= grace_us)).drop("__run")
