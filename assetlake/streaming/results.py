"""Worker outcomes merged into the results table, micro-batch by micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..operators import stats, tasks
from .store import ChangeLog

RESULT, ERROR, WORKER_ERROR, CANCELLED = "RESULT", "ERROR", "WORKER_ERROR", "CANCELLED"


def _told(events: DataFrame, *more: str) -> DataFrame:
    """Outcomes and cancellations, in one pass; a cancellation has no status."""
    kind = F.col("type")
    good, failed = kind == RESULT, kind == WORKER_ERROR
    return events.filter(kind.isin(RESULT, ERROR, WORKER_ERROR, CANCELLED)).select(
        "asset_id",
        F.when(kind != CANCELLED, F.col("format")).alias("format"),
        F.col("seq").cast("bigint").alias("seq"),
        failed.cast("int").alias("phase"),
        F.when(good, K.SUCCESS).when(kind != CANCELLED, K.ERROR).alias("status"),
        F.when(good, F.col("size")).cast("bigint").alias("size"),
        F.when(good, F.col("label")).alias("label"),
        F.when(failed, K.ERR_WORKER).when(kind == ERROR, F.col("error")).alias("error"),
        *more,
    )


def outcomes_of(events: DataFrame) -> DataFrame:
    """RESULT and ERROR messages as outcomes, and the errors of workers, which come after them.

    Progress and cancellation change no result. Columns as `tasks.merge_outcomes` gives them.
    """
    return _told(events).filter(F.col("status").isNotNull())


# Cancellation --------------------------------------------------------------------------------


def drop_cancelled(events: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Ignore messages of removed or cancelled items. Works on streams: stream-static anti join."""
    return events.join(cancelled.select("asset_id").distinct(), "asset_id", "left_anti")


class TombstoneProcessor(StatefulProcessor):
    """Lets the messages of an item through up to its first cancellation, and that one."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tombstone = handle.getValueState("tombstone", "ts_ms bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.tombstone.get()
        rows = list(rows)  # those of one item in one micro-batch
        first = min(((r.ts_ms, r.seq) for r in rows if r.cancel), default=None)
        if first and (known is None or first < tuple(known)):
            if known is not None and self.keep_ms is not None:
                self.handle.deleteTimer(known[0] + self.keep_ms)
            self.tombstone.update(first)
            if self.keep_ms is not None:
                self.handle.registerTimer(first[0] + self.keep_ms)
        else:
            first = known and tuple(known)
        for row in rows:
            at = (row.ts_ms, row.seq)
            if first is None or at < first or (row.cancel and at == first and known is None):
                yield Row(asset_id=key[0], cancel=row.cancel, message=row.message)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.tombstone.clear()
        return iter(())

    def close(self) -> None:
        pass


def _until_cancelled(marked: DataFrame, keep: timedelta | None, delay: str) -> DataFrame:
    """(asset_id, cancel, message) of rows (asset_id, cancel, ts, seq, message) that pass."""
    keep_ms = None if keep is None else keep // timedelta(milliseconds=1)
    timed = marked if keep is None else marked.withWatermark("ts", delay)
    kept = [marked.schema[c] for c in ("asset_id", "cancel", "message")]
    first = F.lit(-1).cast("bigint")  # messages without a place come before all others
    place = {"ts_ms": F.unix_millis("ts"), "seq": F.col("seq").cast("bigint")}
    return (
        timed.withColumns({name: F.coalesce(c, first) for name, c in place.items()})
        .groupBy("asset_id")
        .transformWithState(
            TombstoneProcessor(keep_ms), T.StructType(kept), outputMode="append",
            timeMode="None" if keep is None else "EventTime",
        )
    )


def _marked(rows: DataFrame, cancel: Column, columns: list[str]) -> DataFrame:
    rest = [c for c in columns if c != "asset_id"]
    return rows.select("asset_id", cancel.alias("cancel"), "ts", "seq", F.struct(*rest).alias("message"))


def drop_cancelled_stream(
    events: DataFrame, cancels: DataFrame, keep: timedelta | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Messages of a feed up to the cancellation of their item, which comes on a second stream.

    events: (asset_id, ts, seq, ...); cancels: (asset_id, ts, seq). A cancellation leaves a tombstone
    in the state of its item. From then on, messages that follow it in (ts, seq) are dropped, in
    whatever order both streams deliver them within a micro-batch; earlier ones that arrive late
    still pass, and those that passed before the cancellation arrived have passed. Of several
    cancellations the first counts. With `keep`, a tombstone is cleared once the watermark is that
    long past the cancellation, after which the id may be used again, and messages behind the
    watermark (`delay`) are dropped; without, tombstones stay.
    """
    rest = [f for f in events.schema if f.name != "asset_id"]
    nothing = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    both = _marked(events, F.lit(False), events.columns).unionByName(
        cancels.select("asset_id", F.lit(True).alias("cancel"), "ts", "seq", nothing.alias("message"))
    )
    return (
        _until_cancelled(both, keep, delay).filter("NOT cancel")
        .select("asset_id", "message.*").select(events.columns)
    )


# The change log ------------------------------------------------------------------------------

PLACE = "struct<number: bigint, phase: int, seq: bigint>"
CHANGE = (
    "format string, new_status string, new_size bigint, new_label string, new_error string, "
    f"at {PLACE}, size_at {PLACE}, error_at {PLACE}, cancelled boolean"
)


def _log_schema(asset_id: T.DataType, delta: list[T.StructField] | None = None) -> T.StructType:
    """Rows of the log: a change of a result, a removed item (`cancelled`), or signed counts."""
    fields = [T.StructField("asset_id", asset_id), *T.StructType.fromDDL(CHANGE)]
    return T.StructType(fields + ([T.StructField("delta", T.StructType(delta))] if delta else []))


def _as_log(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with the columns of the log; those that are missing are null."""
    return rows.select(
        *(
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


def _folded(changes: DataFrame, *more: Column) -> DataFrame:
    """The last of several changes per (item, format): each value with the place that set it."""
    return changes.groupBy("asset_id", "format").agg(
        *more,
        F.max("at").alias("at"),
        F.max_by("new_status", "at").alias("new_status"),
        F.max_by("new_size", "size_at").alias("new_size"),
        F.max_by("new_label", "size_at").alias("new_label"),
        F.max_by("new_error", "error_at").alias("new_error"),
        F.max("size_at").alias("size_at"),
        F.max("error_at").alias("error_at"),
    )


def _parts(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, removed items) of a log."""
    changes = log.filter(F.col("at").isNotNull())
    return changes, log.filter("cancelled").select("asset_id").distinct()


def _fold(log: DataFrame) -> DataFrame:
    """The log with one row per result, per removed item and per group of statistics."""
    changes, removed = _parts(log)
    gone = removed.withColumn("cancelled", F.lit(True))
    kept = _folded(changes.join(removed, "asset_id", "left_anti"))
    out = _as_log(kept, log.schema).unionByName(_as_log(gone, log.schema))
    if "delta" in log.columns:
        sums = _summed(log)
        sums = sums.select(F.struct(*sums.columns).alias("delta"))
        out = out.unionByName(_as_log(sums, log.schema))
    return out


def _place(number: int, phase: Column, seq: Column) -> Column:
    fields = (F.lit(number).cast("bigint"), phase.cast("int"), seq.cast("bigint"))
    return F.struct(*(c.alias(n) for c, n in zip(fields, ("number", "phase", "seq"))))


def _changes(told: DataFrame, number: int) -> DataFrame:
    """Log rows of a micro-batch: one per (item, format), and one per cancelled item."""
    at = _place(number, F.col("phase"), F.col("seq"))
    rows = told.select(
        "asset_id",
        "format",
        F.when(F.col("status").isNotNull(), at).alias("at"),
        F.col("status").alias("new_status"),
        F.col("size").alias("new_size"),
        F.col("label").alias("new_label"),
        F.col("error").alias("new_error"),
        F.when(F.col("status") == K.SUCCESS, at).alias("size_at"),
        F.when(F.col("status") == K.ERROR, at).alias("error_at"),
        F.col("status").isNull().alias("cancelled"),
    )
    return _folded(rows, F.bool_or("cancelled").alias("cancelled"))


def _log(spark: SparkSession, path: str) -> ChangeLog:
    return ChangeLog(spark, path, _fold)


def merge_results_stream(
    events: DataFrame,
    path: str,
    cancelled: DataFrame | None = None,
    keep: timedelta | None = None,
    delay: str = "0 seconds",
) -> DataStreamWriter:
    """Fold each micro-batch to one change per (item, format) and commit it to the log at `path`.

    `current_results` reads the log over the results table; no micro-batch rewrites that table.
    A CANCELLED message removes its item: messages that follow it never reach the log (see
    `drop_cancelled_stream`, also for `keep` and `delay`); items of the table `cancelled` never do.
    Replayed epochs change nothing, and the log is folded as it grows (see `ChangeLog`).
    """
    spark = events.sparkSession
    schema = _log_schema(events.schema["asset_id"].dataType)
    _log(spark, path).create(spark.createDataFrame([], schema))
    told = _told(events, "ts")
    if cancelled is not None:  # their outcomes go; a message that cancels one still counts
        gone = cancelled.select(F.col("asset_id").alias("gone")).distinct()
        theirs = (F.col("asset_id") == F.col("gone")) & F.col("status").isNotNull()
        told = told.join(gone, theirs, "left_anti")
    marked = _marked(told, F.col("status").isNull(), [c for c in told.columns if c != "ts"])
    passed = _until_cancelled(marked, keep, delay).select("asset_id", "message.*")

    def store(batch: DataFrame, epoch: int) -> None:
        log = _log(batch.sparkSession, path)
        log.commit(epoch, lambda number: _as_log(_changes(batch, number), schema))

    return passed.writeStream.foreachBatch(store).option(
        "checkpointLocation", f"{path}/progress"
    )


def removed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items that messages of the feed cancelled."""
    return _parts(_log(spark, path).rows())[1]


def current_results(spark: SparkSession, results: DataFrame, path: str) -> DataFrame:
    """The results table with all committed changes applied.

    Unknown items and formats of the feed vanish, and so do the results of removed items.
    """
    changes, removed = _parts(_log(spark, path).rows())
    names = ["status", "size", "label", "error"]
    return (
        drop_cancelled(results, removed)
        .join(_folded(changes), ["asset_id", "format"], "left")
        .withColumns({c: F.coalesce(f"new_{c}", c) for c in names})
        .select(*results.columns)
    )


def current_items(
    spark: SparkSession, items: DataFrame, results: DataFrame, path: str
) -> DataFrame:
    """Items with the status that their current results give them, without removed ones."""
    kept = drop_cancelled(items, removed_items(spark, path))
    return tasks.item_status(kept, current_results(spark, results, path))


# Running statistics --------------------------------------------------------------------------


class QueueProcessor(StatefulProcessor):
    """Items and their results as keyed state; changes come out with the counts they move.

    What an item adds to the statistics follows from its state. A change takes the old
    contribution back and adds the new one, as one row of signed counts per item and micro-batch.
    A key is a bucket of items, with one value: each use of state is a call out of the worker, and
    each key of a micro-batch a batch of rows of its own on the way to it. Messages come as JSON, as
    every column of a row is taken out of its batch by itself.
    """

    #: first_size: of the results table; a success without a size falls back to it.
    FORMATS = "array<struct<format: string, status: string, size: bigint, first_size: bigint>>"
    CHANGED = (
        "format string, status string, size bigint, label string, error string, phase int, "
        "seq bigint, size_phase int, size_seq bigint, error_phase int, error_seq bigint, "
        "counts array<bigint>, cancelled boolean"
    )

    def __init__(self, asset_id: str, groups: str):
        self.kept = (
            f"asset_id: {asset_id}, formats: {self.FORMATS}, original_size: bigint, status: string, {groups}"
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", f"items array<struct<{self.kept}>>")

    def _known(self) -> dict[object, tuple]:
        stored = self.bucket.get()
        known = [] if stored is None else stored[0]
        return {
            asset_id: ([tuple(state) for state in formats], *rest) for asset_id, formats, *rest in known
        }

    def _store(self, items: dict[object, tuple]) -> None:
        if items:
            self.bucket.update(([(asset_id, *item) for asset_id, item in items.items()],))
        else:
            self.bucket.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        items = {}
        for known in initialState.asDict(recursive=True)["items"]:
            formats = {
                r["format"]: (r["format"], r["status"], r["size"], r["size"])
                for r in known["results"] or []
            }
            item = (list(formats.values()), known["original_size"], known["status"])
            items[known["asset_id"]] = (*item, *known["groups"].values())
        self._store(items)

    @staticmethod
    def counts(item: tuple | None) -> tuple[int, ...]:
        """Values of `stats.COUNTS` for one item; a removed one has none."""
        if item is None:
            return (0,) * len(stats.COUNTS)
        formats, original_size, status, *_ = item
        held = {state for _, state, _, _ in formats}
        if held and not {K.PENDING, K.PROCESSING} & held:
            status = K.ERROR if K.ERROR in held else K.SUCCESS
        written = sum(size or 0 for _, state, size, _ in formats if state == K.SUCCESS)
        named = [int(status == s) for s in (K.SUCCESS, K.ERROR, K.PROCESSING)]
        return (1, original_size or 0, written, *named)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last: dict[object, dict[str, dict]] = {}
        set_by: dict[object, dict[tuple[str, str], dict]] = {}
        cancelled = set()
        for row in rows:
            asset_id, told = row.asset_id, json.loads(row.told)
            ends, by_status = last.setdefault(asset_id, {}), set_by.setdefault(asset_id, {})
            name, status = told.get("format"), told.get("status")
            if status is None:
                cancelled.add(asset_id)
                continue
            place = (told["phase"], told["seq"])
            for names, key_ in ((ends, name), (by_status, (name, status))):
                if key_ not in names or (names[key_]["phase"], names[key_]["seq"]) <= place:
                    names[key_] = told
        items, moved = self._known(), False
        for asset_id in last.keys() & items.keys():
            before = items[asset_id]
            if asset_id in cancelled:
                after = None
                del items[asset_id]
            else:
                after, changes = self.merged(before, last[asset_id], set_by[asset_id])
                items[asset_id] = after
                for change in changes:
                    yield self.row(asset_id, before, change)
            moved = moved or after != before
            counts = [a - b for a, b in zip(self.counts(after), self.counts(before))]
            if after is None or any(counts):
                yield self.row(asset_id, before, {"counts": counts, "cancelled": after is None})
        if moved:
            self._store(items)

    @staticmethod
    def merged(
        item: tuple, last: dict[str, dict], set_by: dict[tuple[str, str], dict]
    ) -> tuple[tuple, list[dict]]:
        """(the item, values of CHANGED) after its last message per format, and per format and status."""
        formats, changes = {name: tuple(rest) for name, *rest in item[0]}, []
        for name, told in last.items():
            if name not in formats:
                continue
            good, bad = set_by.get((name, K.SUCCESS)), set_by.get((name, K.ERROR))
            _, size, first = formats[name]
            if good:
                size = first if good.get("size") is None else good["size"]
            formats[name] = (told["status"], size, first)
            change = {"format": name} | {c: told[c] for c in ("status", "phase", "seq")}
            if good:
                change |= {"size": good.get("size"), "label": good.get("label")}
                change |= {"size_phase": good["phase"], "size_seq": good["seq"]}
            if bad:
                change |= {"error": bad.get("error"), "error_phase": bad["phase"], "error_seq": bad["seq"]}
            changes.append(change)
        return ([(name, *rest) for name, rest in formats.items()], *item[1:]), changes

    @classmethod
    def row(cls, asset_id: object, item: tuple, values: dict) -> Row:
        """A row of CHANGED with these values; all others are null."""
        names = (column.split()[0] for column in cls.CHANGED.split(", "))
        values = dict.fromkeys(names) | {"cancelled": False} | values
        groups = {f"g{n}": value for n, value in enumerate(item[3:])}
        return Row(asset_id=asset_id, groups=groups, **values)

    def close(self) -> None:
        pass


def _summed(log: DataFrame) -> DataFrame:
    """Signed counts of a log, added up per group."""
    delta = log.schema["delta"].dataType
    by = [f.name for f in delta if f.name not in stats.COUNTS]
    deltas = log.filter(F.col("delta").isNotNull()).select("delta.*")
    return deltas.groupBy(*by).agg(*(F.sum(name).alias(name) for name in stats.COUNTS))


def running_stats(
    events: DataFrame, items: DataFrame, results: DataFrame, path: str, by: list[str],
    buckets: int = 4096,
) -> DataStreamWriter:
    """Keep results merged, and the queue statistics with them. `latest_stats` reads these.

    `items` and `results` are read once, when the stream starts for the first time: their rows
    become the state of a processor keyed by item, and their statistics the base of the log.
    After that a flush costs what changed: messages meet the state of their own items, a result
    that is sent again takes the one before back, a CANCELLED message takes its whole item back,
    and the log gets one row per changed result and one row of signed counts per changed item.
    Ids of items are unique, numbers or strings. Messages of unknown items and formats change nothing. In one
    micro-batch, errors of workers come after results, and a cancellation counts for all of it.
    buckets: items are kept in so many values of state, by the hash of their ids. A flush rewrites
    the items of the buckets that its changes meet. It stays as it is for the life of a checkpoint.
    """
    spark = events.sparkSession
    groups = [T.StructField(c, items.schema[c].dataType) for c in by]
    counts = [T.StructField(c, T.LongType()) for c in stats.COUNTS]
    asset_id = items.schema["asset_id"].dataType
    bucket = F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).alias("bucket")
    schema = _log_schema(asset_id, groups + counts)
    log = _log(spark, path)
    if log.manifest() is None:
        start = stats.queue_counts(tasks.item_status(items, results), by)
        log.create(_as_log(start.select(F.struct(*by, *stats.COUNTS).alias("delta")), schema))

    held = results.select("asset_id", F.struct("format", "status", F.col("size").cast("bigint").alias("size")).alias("r"))
    held = held.groupBy("asset_id").agg(F.collect_list("r").alias("results"))
    named = [F.col(c).alias(f"g{n}") for n, c in enumerate(by)] or [F.lit(0).alias("g0")]
    known = items.join(held, "asset_id", "left").select(
        "asset_id",
        F.col("original_size").cast("bigint").alias("original_size"),
        "status",
        F.struct(*named).alias("groups"),
        "results",
    )
    initial = known.groupBy(bucket).agg(F.collect_list(F.struct(*known.columns)).alias("items"))
    state = known.schema["groups"].dataType
    first = [items.schema["asset_id"], T.StructField("groups", state)]
    out = T.StructType([*first, *T.StructType.fromDDL(QueueProcessor.CHANGED)])
    told = _told(events).withColumns(
        {"asset_id": F.col("asset_id").cast(asset_id), "seq": F.coalesce("seq", F.lit(-1).cast("bigint"))}
    )
    rest = [c for c in told.columns if c != "asset_id"]
    dealt = told.select(bucket, "asset_id", F.to_json(F.struct(*rest)).alias("told"))
    kept = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in state)
    changed = dealt.groupBy("bucket").transformWithState(
        QueueProcessor(asset_id.simpleString(), kept),
        out, outputMode="append", timeMode="None", initialState=initial.groupBy("bucket"),
    )

    def rows(batch: DataFrame, number: int) -> DataFrame:
        moved = [F.col("counts")[n].alias(name) for n, name in enumerate(stats.COUNTS)]
        keys = [F.col(f"groups.g{n}").alias(c) for n, c in enumerate(by)]

        def place(name: str, prefix: str = "") -> Column:
            phase, seq = F.col(f"{prefix}phase"), F.col(f"{prefix}seq")
            return F.when(seq.isNotNull(), _place(number, phase, seq)).alias(name)

        return batch.select(
            "asset_id",
            "format",
            *(F.col(c).alias(f"new_{c}") for c in ("status", "size", "label", "error")),
            place("at"),
            place("size_at", "size_"),
            place("error_at", "error_"),
            "cancelled",
            F.when(F.col("counts").isNotNull(), F.struct(*keys, *moved)).alias("delta"),
        )

    def store(batch: DataFrame, epoch: int) -> None:
        to = _log(batch.sparkSession, path)
        to.commit(epoch, lambda number: _as_log(rows(batch, number), schema), continues=False)

    return changed.writeStream.foreachBatch(store).outputMode("append").option(
        "checkpointLocation", f"{path}/progress"
    )


def latest_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of the last flush; before any, those of the untouched items.

    The base of the log and the signed counts behind it, added up; no item is read.
    """
    return stats.counted_stats(_summed(_log(spark, path).rows()))
