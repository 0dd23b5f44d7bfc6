"""Stateful task tracking on streams, with batch twins that give the same rows.

Within a micro-batch, rows of a key are ordered by (ts, seq); across micro-batches they must
arrive in that order, as the messages of a worker do.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..plans.ordered import SLICE, Sliced

MOVES = ("start", "RESULT", "ERROR")
OUTCOME = "task_id string, outcome string, at_ms bigint"
TRANSITION = "asset_id string, seq bigint, ts_ms bigint, from_status string, to_status string"


class TimeoutProcessor(StatefulProcessor):
    """First of: done, failed, timed out. A task leaves the state once its deadline has passed.

    A key is a bucket of tasks, with one value and one timer, at the earliest deadline: each use of
    state is a call out of the worker, and most tasks have few messages.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        task = "struct<task_id: string, deadline: bigint, settled: boolean>"
        self.bucket = handle.getValueState("bucket", f"tasks array<{task}>")

    def _known(self) -> dict[str, tuple[int, bool]]:
        known = self.bucket.get()
        return {} if known is None else {task: (end, settled) for task, end, settled in known[0]}

    def _store(self, tasks: dict[str, tuple[int, bool]]) -> None:
        if tasks:
            self.bucket.update(([(task, *rest) for task, rest in tasks.items()],))
        else:
            self.bucket.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self._known()
        tasks = dict(known)
        for row in sorted(rows, key=lambda r: (r.ts_ms, r.seq, r.kind)):
            at, kind = row.ts_ms, row.kind
            deadline, settled = tasks.get(row.task_id, (None, False))
            if deadline is None:
                if kind == "start":
                    tasks[row.task_id] = (at + self.limit_ms, False)
            elif not settled and kind in ("done", "failed"):
                tasks[row.task_id] = (deadline, True)
                in_time = at <= deadline
                yield Row(
                    task_id=row.task_id,
                    outcome=kind if in_time else K.ERR_TIMEOUT,
                    at_ms=at if in_time else deadline,
                )
        if tasks != known:
            self._store(tasks)
            old = min((end for end, _ in known.values()), default=None)
            new = min(end for end, _ in tasks.values())
            if old != new:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, open_tasks = timerValues.getCurrentWatermarkInMs(), {}
        for task_id, (deadline, settled) in self._known().items():
            if deadline >= now:
                open_tasks[task_id] = (deadline, settled)
            elif not settled:
                yield Row(task_id=task_id, outcome=K.ERR_TIMEOUT, at_ms=deadline)
        self._store(open_tasks)
        if open_tasks:
            self.handle.registerTimer(min(end for end, _ in open_tasks.values()))

    def close(self) -> None:
        pass


def task_timeouts(
    events: DataFrame, limit_ms: int = K.TASK_TIMEOUT_MS, delay: str = "0 seconds",
    buckets: int = 4096,
) -> DataFrame:
    """Outcome per task on a stream of (task_id, kind, ts, seq); kind start, done or failed.

    buckets: tasks are kept in so many values of state, by the hash of their ids. A micro-batch
    rewrites the open tasks of the buckets that its messages meet. It stays as it is for the life
    of a checkpoint.
    """
    return (
        events.withWatermark("ts", delay)
        .filter(F.col("kind").isin("start", "done", "failed"))
        .withColumns(
            {"ts_ms": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("task_id"), F.lit(buckets))}
        )
        .groupBy("bucket")
        .transformWithState(
            TimeoutProcessor(limit_ms), OUTCOME, outputMode="append", timeMode="EventTime"
        )
    )


def task_outcomes(events: DataFrame, limit_ms: int, until_ms: int) -> DataFrame:
    """Batch twin of `task_timeouts` for a feed that has been seen up to `until_ms`."""
    timed = events.withColumn("ts_ms", F.unix_millis("ts"))
    starts = timed.filter("kind = 'start'").groupBy("task_id").agg(
        F.min(F.struct("ts_ms", "seq")).alias("begin")
    )
    ends = timed.filter(F.col("kind").isin("done", "failed")).select(
        "task_id", F.struct("ts_ms", "seq").alias("end"), "kind"
    )
    first_end = (
        ends.join(starts, "task_id").filter(F.col("end") > F.col("begin"))
        .groupBy("task_id")
        .agg(F.min_by(F.struct("kind", "end.ts_ms"), "end").alias("first"))
    )
    deadline = F.col("begin.ts_ms") + limit_ms
    in_time = F.col("first.ts_ms") <= deadline
    known = starts.join(first_end, "task_id", "left").withColumn("deadline", deadline)
    return known.filter(
        F.col("first").isNotNull() | (F.col("deadline") < until_ms)
    ).select(
        "task_id",
        F.when(in_time, F.col("first.kind")).otherwise(F.lit(K.ERR_TIMEOUT)).alias("outcome"),
        F.when(in_time, F.col("first.ts_ms")).otherwise(F.col("deadline")).alias("at_ms"),
    )


class LifecycleProcessor(StatefulProcessor):
    """Item status from the states of its formats; one row per change of status."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.formats = handle.getMapState("formats", "format string", "status string")
        self.item = handle.getValueState("item", "status string, last_ms bigint")

    def _ends_at(self, item: tuple | None) -> int | None:
        """When a finished item leaves the state: once no message may continue it."""
        if item is None or self.keep_ms is None or item[0] == K.PROCESSING:
            return None
        return item[1] + self.keep_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = item = self.item.get()
        stored = {k[0]: v[0] for k, v in self.formats.iterator()}
        states = dict(stored)
        for row in sorted(rows, key=lambda r: (r.ts_ms, r.seq)):
            end = self._ends_at(item)
            if end is not None and row.ts_ms >= end:
                item, states = None, {}
            state = {"start": K.PROCESSING, "RESULT": K.SUCCESS}.get(row.type, K.ERROR)
            before = K.PENDING if item is None else item[0]
            if row.format not in states and state != K.PROCESSING:
                item = item and (before, row.ts_ms)
                continue
            states[row.format] = state
            held = set(states.values())
            after = next((s for s in (K.PROCESSING, K.ERROR) if s in held), K.SUCCESS)
            item = (after, row.ts_ms)
            if after != before:
                yield Row(
                    asset_id=key[0], seq=row.seq, ts_ms=row.ts_ms, from_status=before,
                    to_status=after,
                )
        for name in stored.keys() - states.keys():
            self.formats.removeKey((name,))
        for name, state in states.items():
            if stored.get(name) != state:
                self.formats.updateValue((name,), (state,))
        old, new = self._ends_at(known), self._ends_at(item)
        if old != new and old is not None:
            self.handle.deleteTimer(old)
        if old != new and new is not None:
            self.handle.registerTimer(new)
        if item is None:
            self.item.clear()
        elif item != known:
            self.item.update(item)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.formats.clear()
        self.item.clear()
        return iter(())

    def close(self) -> None:
        pass


def task_lifecycle(
    events: DataFrame, keep: timedelta | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Status transitions per item on a stream of (asset_id, format, type, ts, seq).

    Messages other than start, RESULT and ERROR, such as progress, change no status, and neither
    do outcomes of formats that were not started.

    With `keep`, a finished item leaves the state when the watermark is more than that past its
    last message, so that the state holds the open items and those just finished. A message
    that comes later than that begins the item anew: it counts as pending, with no format started.
    The rule is on the times of messages and not on when the state was cleared, so the cut of a
    feed into micro-batches changes nothing. Messages behind the watermark (`delay`) are dropped.
    Without `keep` items stay.
    """
    keep_ms = None if keep is None else keep // timedelta(milliseconds=1)
    moves = events.filter(F.col("type").isin(*MOVES))
    timed = moves if keep is None else moves.withWatermark("ts", delay)
    return (
        timed.withColumn("ts_ms", F.unix_millis("ts"))
        .groupBy("asset_id")
        .transformWithState(
            LifecycleProcessor(keep_ms), TRANSITION, outputMode="append",
            timeMode="None" if keep is None else "EventTime",
        )
    )


ORDER = ["ts_ms", "seq"]


def _is(column: str, status: str) -> Column:
    return F.coalesce(F.col(column) == status, F.lit(False)).cast("int")


def _earlier_states(sliced: Sliced) -> DataFrame:
    """Last message of each format of an item in front of each of the item's slices.

    Columns: asset_id, slice, format, ts_ms, seq, state, and the place of the last start. Only
    items that cross a slice border have any; rows are their slices times their formats.
    """
    place = F.struct(*ORDER)
    last = F.struct(*ORDER, "state")
    ends = sliced.rows.groupBy("asset_id", "format", SLICE).agg(
        F.max(last).alias("last"),
        F.max(F.when(F.col("state") == K.PROCESSING, place)).alias("started"),
    )
    slices = ends.groupBy("asset_id").agg(
        F.collect_set(SLICE).alias("slices"), F.collect_set("format").alias("formats")
    )
    every = slices.filter(F.size("slices") > 1).select(
        "asset_id", F.explode("slices").alias(SLICE), "formats"
    ).select("asset_id", SLICE, F.explode("formats").alias("format"))
    earlier = sliced.earlier("format")
    known = every.join(ends, ["asset_id", "format", SLICE], "left").select(
        "asset_id",
        SLICE,
        "format",
        F.max("last").over(earlier).alias("last"),
        F.max("started").over(earlier).alias("started"),
    )
    return known.filter(F.col("last").isNotNull()).select(
        "asset_id", SLICE, "format", "last.*", "started"
    )


def _with_lives(sliced: Sliced, earlier: DataFrame, keep: timedelta) -> tuple[DataFrame, DataFrame]:
    """Rows with `life`, a number within their slice, and earlier states that still hold.

    A finished item that is silent for longer than `keep` begins anew. Whether an item is open
    before a message does not depend on where its lives begin: a format is open if its last message
    is a start, and no life ends while one is.
    """
    columns = ["asset_id", SLICE, "format", *ORDER, "state"]
    both = sliced.rows.select(*columns, F.lit(False).alias("before")).unionByName(
        earlier.select(*columns, F.lit(True).alias("before"))
    )
    stepped = sliced.together(both).withColumn("was", F.lag("state").over(sliced.inside("format")))
    change = _is("state", K.PROCESSING) - _is("was", K.PROCESSING)
    inside = sliced.inside()
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    silent = F.col("ts_ms") - F.lag("ts_ms").over(inside) > keep // timedelta(milliseconds=1)
    opened = stepped.withColumn("change", change).withColumns(
        {"held": F.sum("change").over(running) - F.col("change"), "silent": F.coalesce(silent, F.lit(False))}
    )
    fresh = ~F.col("before") & F.col("silent") & (F.col("held") == 0)
    lived = opened.withColumn("fresh", fresh.cast("int")).withColumn(
        "life", F.sum("fresh").over(running)
    )
    begun = lived.groupBy("asset_id", SLICE).agg(
        F.max(F.when(F.col("fresh") == 1, F.struct(*ORDER))).alias("begun")
    ).withColumn("_begun", F.max("begun").over(sliced.earlier()))
    held = sliced.carried(earlier, begun.filter(F.col("_begun").isNotNull()), "_begun").filter(
        F.col("_begun").isNull() | (F.col("started") >= F.col("_begun"))
    )
    return lived.filter("NOT before").select(*columns, "life"), held


def lifecycle_transitions(
    events: DataFrame, slices: int | None = None, keep: timedelta | None = None
) -> DataFrame:
    """Batch twin of `task_lifecycle`.

    Messages are cut into slices once. In front of each slice stand the last messages of the
    item's formats before it, so that the status after every message follows within the slice: a
    message changes how many formats are open and how many have failed.
    """
    state = (
        F.when(F.col("type") == "start", K.PROCESSING)
        .when(F.col("type") == "RESULT", K.SUCCESS)
        .otherwise(K.ERROR)
    )
    rows = events.filter(F.col("type").isin(*MOVES)).select(
        "asset_id", "format", F.unix_millis("ts").alias("ts_ms"), "seq", state.alias("state")
    )
    sliced = Sliced(rows, ["asset_id"], ORDER, slices)
    earlier = _earlier_states(sliced)
    if keep is None:
        real = sliced.rows.withColumn("life", F.lit(0).cast("bigint"))
    else:
        real, earlier = _with_lives(sliced, earlier, keep)
    columns = ["asset_id", SLICE, "life", "format", *ORDER, "state"]
    held = earlier.filter(F.col("started").isNotNull()).withColumn("life", F.lit(0).cast("bigint"))
    both = real.select(*columns, F.lit(False).alias("before")).unionByName(
        held.select(*columns, F.lit(True).alias("before"))
    )
    of_format = sliced.inside("life", "format")
    running = of_format.rowsBetween(Window.unboundedPreceding, 0)
    begun = F.bool_or(F.col("before") | (F.col("state") == K.PROCESSING)).over(running)
    known = sliced.together(both).withColumn("begun", begun).filter("begun")
    stepped = known.withColumn("was", F.lag("state").over(of_format))
    inside = sliced.inside("life")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)

    def held_in(status: str) -> Column:
        return F.sum(_is("state", status) - _is("was", status)).over(running)

    status = (
        F.when(F.col("open") > 0, K.PROCESSING)
        .when(F.col("failed") > 0, K.ERROR)
        .otherwise(K.SUCCESS)
    )
    counted = stepped.withColumns({"open": held_in(K.PROCESSING), "failed": held_in(K.ERROR)})
    named = counted.withColumn("to_status", status)
    moved = named.withColumn("from_status", F.lag("to_status", 1, K.PENDING).over(inside))
    return moved.filter(~F.col("before") & (F.col("from_status") != F.col("to_status"))).select(
        "asset_id", "seq", "ts_ms", "from_status", "to_status"
    )
