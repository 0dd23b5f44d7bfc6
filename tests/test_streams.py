"""Streams over several micro-batches give what batch gives on all events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assetlake.functions import constants as K
from assetlake.operators import tasks
from assetlake.sources.events import TASK_EVENT, read_task_events
from assetlake.streaming import lifecycle as L, options as O, results as R, store as S
from assetlake.streaming.runs import drain, rocksdb_state, run

START = datetime(2024, 1, 1)


def write_parts(spark, rows, schema, path, parts=3):
    """Consecutive parts of the feed, one file each, in order."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        part = spark.createDataFrame(rows[n * size : (n + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.createDataFrame(rows, schema)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_results_stream(spark, tmp_path):
    random.seed(1)
    rows = []
    for seq in range(120):
        kind = random.choice(["RESULT", "ERROR", "PROGRESS"])
        rows.append((kind, f"i{seq % 7}", random.choice(["webp", "png", "gif"]), None, None, seq * 10,
                     "L", None, "broke" if kind == "ERROR" else None, seq, START))
    write_parts(spark, rows, TASK_EVENT, tmp_path / "in")
    table = spark.createDataFrame(
        [(f"i{i}", f, "processing", None, None, None) for i in range(6) for f in ("webp", "png")],
        "asset_id string, format string, status string, size bigint, label string, error string",
    )
    gone = spark.createDataFrame([("i2",)], "asset_id string")
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run finds nothing new and changes nothing
        feed = read_task_events(spark, str(tmp_path / "in"), files_per_trigger=1)
        run(R.merge_results_stream(feed, out, gone))
    kept = R.drop_cancelled(spark.createDataFrame(rows, TASK_EVENT), gone)
    same(R.current_results(spark, table, out), tasks.apply_results(table, R.outcomes_of(kept)))


def test_replayed_epoch_changes_nothing(spark, tmp_path):
    rows = [("RESULT", "i1", "webp", None, None, 5, "L", None, None, 1, START)]
    write_parts(spark, rows, TASK_EVENT, tmp_path / "in", parts=1)
    table = spark.createDataFrame(
        [("i1", "webp", "processing", None, None, None)],
        "asset_id string, format string, status string, size bigint, label string, error string",
    )
    out = str(tmp_path / "out")
    for place in ("one", "two"):  # a lost checkpoint replays epoch 0
        feed = read_task_events(spark, str(tmp_path / "in"))
        run(R.merge_results_stream(feed, out).option("checkpointLocation", str(tmp_path / place)))
    row = R.current_results(spark, table, out).first()
    assert (row.status, row["size"]) == (K.SUCCESS, 5)


def test_debounce(spark, tmp_path):
    random.seed(2)
    at, rows = START, []
    for seq in range(90):
        at += timedelta(milliseconds=random.choice([50, 100, 299, 300, 301, 900]))
        rows.append((random.choice("ab"), at, seq, f"o{seq}", random.random() < 0.1))
    schema = "session string, ts timestamp, seq bigint, options string, force boolean"
    changes = write_parts(spark, rows, schema, tmp_path / "in")
    batch = O.debounce(changes, "session")
    expected, open_burst = [], {}
    for key, ts, _, option, force in rows:
        burst = open_burst.get(key)
        if burst and ts - burst[2] < timedelta(milliseconds=300):
            open_burst[key] = [key, burst[1], ts, option, burst[4] or force, burst[5] + 1]
        else:
            expected += [burst] if burst else []
            open_burst[key] = [key, ts, ts, option, force, 1]
    expected += open_burst.values()
    got = sorted((r.session, r.first_at, r.options, r.force, r.changes) for r in batch.collect())
    assert got == sorted((k, a, o, f, n) for k, a, _, o, f, n in expected)
    stream = read_task_events(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    closed = drain(O.debounce(stream, "session", delay="0 seconds"), "bursts")
    same(closed, batch.filter(F.col("applied_at") <= F.lit(at)))


@pytest.fixture(scope="module")
def task_feed():
    random.seed(4)
    at, rows = START, []
    for seq in range(300):
        at += timedelta(seconds=random.choice([1, 5, 20]))
        rows.append((f"t{seq // 6 + random.randint(0, 5)}", random.choice(["start", "done", "failed", "x"]), at, seq))
    return rows


def test_timeouts(spark, tmp_path, task_feed):
    schema = "task_id string, kind string, ts timestamp, seq bigint"
    events = write_parts(spark, task_feed, schema, tmp_path / "in")
    until = int(task_feed[-1][2].timestamp() * 1000)
    expected = L.task_outcomes(events, 60_000, until)
    assert {r.outcome for r in expected.collect()} == {"done", "failed", K.ERR_TIMEOUT}
    # One pass over everything; several passes are compared on tasks that start once.
    whole = read_task_events(spark, str(tmp_path / "in"), schema)
    same(drain(L.task_timeouts(whole, 60_000), "whole"), expected)


def test_timeouts_over_micro_batches(spark, tmp_path, task_feed):
    schema = "task_id string, kind string, ts timestamp, seq bigint"
    seen, rows = set(), []
    for row in task_feed:
        if row[1] != "start" or row[0] not in seen:
            rows.append(row)
        if row[1] == "start":
            seen.add(row[0])
    events = write_parts(spark, rows, schema, tmp_path / "in")
    until = int(rows[-1][2].timestamp() * 1000)
    parts = read_task_events(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    same(drain(L.task_timeouts(parts, 60_000), "parts"), L.task_outcomes(events, 60_000, until))


def test_timeouts_of_tasks_that_share_a_bucket(spark, tmp_path):
    """All tasks in one value of state, with one timer, over many micro-batches."""
    rows = []
    for i in range(12):
        begin = START + timedelta(seconds=20 * i)
        rows.append((f"t{i}", "start", begin, 2 * i))
        if i % 3:
            rows.append((f"t{i}", "done", begin + timedelta(seconds=50 * (i % 3)), 2 * i + 1))
    rows.sort(key=lambda r: (r[2], r[3]))
    schema = "task_id string, kind string, ts timestamp, seq bigint"
    events = write_parts(spark, rows, schema, tmp_path / "in")
    until = int(rows[-1][2].timestamp() * 1000)
    expected = L.task_outcomes(events, 60_000, until)
    assert {r.outcome for r in expected.collect()} == {"done", K.ERR_TIMEOUT}
    parts = read_task_events(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    same(drain(L.task_timeouts(parts, 60_000, buckets=1), "shared"), expected)


def test_lifecycle(spark, tmp_path):
    random.seed(5)
    at, rows = START, []
    for seq in range(200):
        at += timedelta(seconds=random.choice([0, 1, 5]))
        kind = random.choice(["start", "start", "RESULT", "ERROR"])
        rows.append((f"i{random.randint(0, 4)}", random.choice(["webp", "png"]), kind, at, seq))
    schema = "asset_id string, format string, type string, ts timestamp, seq bigint"
    events = write_parts(spark, rows, schema, tmp_path / "in")
    batch = L.lifecycle_transitions(events)
    same(L.lifecycle_transitions(events, slices=9), batch)
    parts = read_task_events(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    same(drain(L.task_lifecycle(parts), "moves"), batch)
    states, before, moves = {}, {}, []
    for asset, fmt, kind, ts, seq in rows:
        held = states.setdefault(asset, {})
        if kind != "start" and fmt not in held:
            continue
        held[fmt] = {"start": "processing", "RESULT": "success"}.get(kind, "error")
        now = next((s for s in ("processing", "error") if s in held.values()), "success")
        if now != before.get(asset, "pending"):
            moves.append((asset, seq, before.get(asset, "pending"), now))
            before[asset] = now
    got = sorted((r.asset_id, r.seq, r.from_status, r.to_status) for r in batch.collect())
    assert got == sorted(moves)


TABLE = "asset_id string, format string, status string, size bigint, label string, error string"


def test_running_stats(spark, tmp_path, monkeypatch):
    """A result sent again replaces the first; a cancelled item leaves; worker errors count last."""
    monkeypatch.setattr(S, "FOLD_EVERY", 2)
    kinds = [("RESULT", "i1", 60), ("RESULT", "i1", 30), ("WORKER_ERROR", "i2", None),
             ("RESULT", "i2", 10), ("CANCELLED", "i3", None), ("RESULT", "i3", 5), ("PROGRESS", "i4", 1)]
    rows = [(kind, i, "webp", None, None, size, "L", None, None, n, START)
            for n, (kind, i, size) in enumerate(kinds)]
    write_parts(spark, rows, TASK_EVENT, tmp_path / "in", parts=7)
    names = [f"i{n}" for n in range(1, 5)]
    results = spark.createDataFrame([(n, "webp", "processing", None, None, None) for n in names], TABLE)
    items = spark.createDataFrame(
        [(n, "b", 100, "processing", 0) for n in names],
        "asset_id string, batch_id string, original_size bigint, status string, progress int",
    )
    out = str(tmp_path / "out")
    feed = read_task_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    run(R.running_stats(feed, items, results, out, ["batch_id"]))
    row = R.latest_stats(spark, out).first()
    assert (row["items"], row.total_original, row.total_optimized) == (3, 300, 40)
    assert (row.successful, row.processing, row.all_done, row.has_finished, row.zero_errors) == (
        2, 1, False, True, True)
    status = {r.asset_id: r.status for r in R.current_items(spark, items, results, out).collect()}
    assert status == {"i1": "success", "i2": "success", "i4": "processing"}
    with rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_streams_without_messages(spark, tmp_path):
    spark.createDataFrame([], TASK_EVENT).write.parquet(str(tmp_path / "in"))
    results = spark.createDataFrame([("i", "webp", "processing", None, None, None)], TABLE)
    items = spark.createDataFrame(
        [("i", "b", 100, "processing", 0)],
        "asset_id string, batch_id string, original_size bigint, status string, progress int",
    )
    out = str(tmp_path / "out")
    feed = read_task_events(spark, str(tmp_path / "in"))
    run(R.running_stats(feed, items, results, out, ["batch_id"]))
    same(R.current_results(spark, results, out), results)
    assert R.latest_stats(spark, out).first()["items"] == 1


def test_debounce_of_one_busy_key(spark):
    rng = random.Random(2)
    at, rows = START, []
    for seq in range(500):
        at += timedelta(milliseconds=rng.choice([1, 100, 299, 300, 301]))
        rows.append(("hot", at, seq, f"o{seq}", seq % 50 == 0))
    changes = spark.createDataFrame(rows, "session string, ts timestamp, seq long, options string, force boolean")
    want, last = [], None
    for _, ts, seq, option, force in rows:
        if last is None or ts - last >= timedelta(milliseconds=300):
            want.append([ts, None, None, False, 0])
        want[-1][1:] = [ts + timedelta(milliseconds=300), option, want[-1][3] or force, want[-1][4] + 1]
        last = ts
    got = O.debounce(changes, "session", timedelta(milliseconds=300)).collect()
    assert sorted(list(r)[1:] for r in got) == want


# The change log ------------------------------------------------------------------------------


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


@pytest.fixture
def as_stream(spark):
    """Commits made here count as those of one stream."""
    context = spark.sparkContext
    context.setLocalProperty(S.QUERY_ID, "stream-1")
    yield lambda name: context.setLocalProperty(S.QUERY_ID, name)
    context.setLocalProperty(S.QUERY_ID, None)


def sums(log):
    return log.groupBy("k").agg(F.sum("n").alias("n"))


def test_folders_do_not_grow_with_the_age_of_a_log(spark, tmp_path, monkeypatch, as_stream):
    monkeypatch.setattr(S, "FOLD_EVERY", 10)
    log = S.ChangeLog(spark, str(tmp_path / "log"), sums)
    log.create(spark.createDataFrame([], "k int, n bigint"))
    count = {}
    for epoch in range(1, 201):
        log.commit(epoch, lambda number: spark.range(1).selectExpr(f"{epoch % 3} AS k", "1L AS n"))
        count[epoch] = len(folders(tmp_path / "log"))
    assert count[100] == count[150] == count[200] <= 13
    assert max(count.values()) <= 22
    assert dict(map(tuple, sums(log.rows()).collect())) == {0: 66, 1: 67, 2: 67}


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["_replace", "_discard"])
@pytest.mark.parametrize("done", [False, True], ids=["before", "after"])
def test_a_writer_may_stop_anywhere(spark, tmp_path, monkeypatch, as_stream, step, done):
    """At every call of a step, before or after it: the replayed epochs give the same table."""
    monkeypatch.setattr(S, "FOLD_EVERY", 2)
    log = S.ChangeLog(spark, str(tmp_path / "log"), sums)
    log.create(spark.createDataFrame([], "k int, n bigint"))
    real = getattr(S.ChangeLog, step)
    calls = {"n": 0, "stop": 0}

    def stopping(self, what):
        calls["n"] += 1
        if calls["n"] == calls["stop"] and not done:
            raise Stop
        real(self, what)
        if calls["n"] == calls["stop"]:
            raise Stop

    monkeypatch.setattr(S.ChangeLog, step, stopping)
    epoch = 0
    while epoch < 8:
        calls |= {"n": 0, "stop": 1 if epoch % 2 else 2}  # first the commit, then the fold
        rows = spark.range(2).selectExpr("CAST(id AS INT) AS k", f"{10**epoch}L AS n")
        for _ in range(2):  # the second is the replay
            try:
                log.commit(epoch, lambda number: rows)
            except Stop:
                calls["stop"] = 0
        epoch += 1
    assert dict(map(tuple, sums(log.rows()).collect())) == {0: 11111111, 1: 11111111}
    known = log.manifest()
    assert {known["base"], *known["deltas"], *known["superseded"]} <= set(folders(tmp_path / "log"))


def test_a_log_and_its_checkpoint_belong_together(spark, tmp_path, as_stream):
    log = S.ChangeLog(spark, str(tmp_path / "log"))
    log.create(spark.createDataFrame([], "n bigint"))
    log.commit(0, lambda number: spark.range(1).selectExpr("1L AS n"))
    as_stream("stream-2")
    with pytest.raises(ValueError, match="checkpoint is lost"):
        log.commit(0, lambda number: spark.range(1).selectExpr("1L AS n"), continues=False)
    log.commit(0, lambda number: spark.range(1).selectExpr("2L AS n"))
    assert sorted(r.n for r in log.rows().collect()) == [1, 2]


# Cancellation --------------------------------------------------------------------------------

SIMPLE = "asset_id string, kind string, ts timestamp, seq bigint"


def tick(n):
    return START + timedelta(seconds=n)


@pytest.mark.parametrize("parts", [1, 4])
def test_cancellations_in_either_order(spark, tmp_path, parts):
    """A cancellation that is delivered before, with or after the messages it is about."""
    random.seed(7)
    rows = [(f"i{random.randint(0, 9)}", "m", tick(n), n) for n in range(80)]
    stops = [(f"i{k}", "cancel", tick(n), n) for k, n in [(1, 0), (2, 30), (2, 50), (3, 79), (4, 41)]]
    write_parts(spark, rows, SIMPLE, tmp_path / "in", parts)
    write_parts(spark, list(reversed(stops)), SIMPLE, tmp_path / "stops", 1)
    told = read_task_events(spark, str(tmp_path / "in"), SIMPLE, files_per_trigger=1)
    gone = read_task_events(spark, str(tmp_path / "stops"), SIMPLE)
    kept = drain(R.drop_cancelled_stream(told, gone), "kept")
    assert kept.columns == ["asset_id", "kind", "ts", "seq"]
    first = {}
    for key, _, _, n in stops:
        first[key] = min(n, first.get(key, n))
    want = [row for row in rows if row[3] < first.get(row[0], 1000)]
    assert sorted(map(tuple, kept.collect())) == sorted(want)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_tombstones_expire(spark, tmp_path):
    rows = [("a", "cancel", tick(0), 0), ("a", "m", tick(1), 1), ("b", "m", tick(5), 2),
            ("b", "m", tick(30), 3), ("b", "m", tick(31), 4), ("a", "m", tick(40), 5)]
    write_parts(spark, rows, SIMPLE, tmp_path / "in", 6)
    told = read_task_events(spark, str(tmp_path / "in"), SIMPLE, files_per_trigger=1)
    kinds = told.filter("kind = 'm'"), told.filter("kind = 'cancel'")
    kept = R.drop_cancelled_stream(*kinds, keep=timedelta(seconds=10))
    writer = kept.writeStream.format("memory").queryName("kept_messages")
    query = run(writer.option("checkpointLocation", str(tmp_path / "progress")))
    assert max(state_rows(query)) > 0 and state_rows(query)[-1] == 0
    got = spark.table("kept_messages").collect()
    assert sorted(r.seq for r in got) == [2, 3, 4, 5]


def test_messages_after_a_cancellation_never_reach_the_log(spark, tmp_path):
    kinds = [("RESULT", "i1", 10), ("CANCELLED", "i1", None), ("RESULT", "i1", 20), ("ERROR", "i1", None),
             ("RESULT", "i2", 30), ("CANCELLED", "i1", None)]
    rows = [(kind, i, "webp", None, None, size, "L", None, None, n, tick(n))
            for n, (kind, i, size) in enumerate(kinds)]
    for parts in (1, 3, 6):
        source, out = tmp_path / f"in{parts}", str(tmp_path / f"out{parts}")
        write_parts(spark, rows, TASK_EVENT, source, parts)
        run(R.merge_results_stream(read_task_events(spark, str(source), files_per_trigger=1), out))
        log = R._log(spark, out).rows()
        sizes = [(r.asset_id, r.new_size) for r in log.filter("at IS NOT NULL").collect()]
        assert sorted(sizes) == [("i1", 10), ("i2", 30)]
        assert [r.asset_id for r in R.removed_items(spark, out).collect()] == ["i1"]
        assert log.filter("cancelled").count() == 1


# Running statistics --------------------------------------------------------------------------

ITEM = "asset_id string, batch_id string, original_size bigint, status string, progress int"
STATS = ["batch_id", "items", "total_original", "total_optimized", "all_done", "successful",
         "processing", "has_finished", "zero_errors", "savings_pct"]


def queue(spark, n, formats=("webp", "png")):
    items = [(f"i{k}", f"b{k % 3}", 100 + k, "processing" if k % 2 else "pending", 0) for k in range(n)]
    results = [(f"i{k}", f, "success" if k % 7 == 0 else "processing", 5 if k % 7 == 0 else None, None, None)
               for k in range(n) for f in formats]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(results, TABLE)


def feed_rows(n, items, seed):
    rng = random.Random(seed)
    kinds = ["RESULT", "RESULT", "ERROR", "WORKER_ERROR", "PROGRESS", "CANCELLED"]
    rows = []
    for seq in range(n):
        kind = rng.choices(kinds, [8, 8, 4, 2, 4, 1])[0]
        size = rng.choice([None, seq]) if kind == "RESULT" else None
        rows.append((kind, f"i{rng.randint(0, items + 3)}", rng.choice(["webp", "png", "gif"]), None, None,
                     size, "L", None, "broke", seq, tick(seq)))
    return rows


def test_running_stats_equal_those_of_all_results(spark, tmp_path, monkeypatch):
    """Results sent again, failed after success and back, cancelled, unknown: over ten flushes."""
    monkeypatch.setattr(S, "FOLD_EVERY", 3)
    items, results = queue(spark, 25)
    write_parts(spark, feed_rows(250, 25, 3), TASK_EVENT, tmp_path / "in", 10)
    out = str(tmp_path / "out")
    feed = read_task_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = run(R.running_stats(feed, items, results, out, ["batch_id"]))
    whole = R.current_items(spark, items, results, out)
    same(R.latest_stats(spark, out).select(STATS), R.stats.queue_stats(whole, ["batch_id"]).select(STATS))
    removed = R.removed_items(spark, out).count()
    assert removed > 3 and state_rows(query)[-1] == 25 - removed
    total = str(tmp_path / "total")
    run(R.running_stats(read_task_events(spark, str(tmp_path / "in")), items, results, total, []))
    overall = R.stats.queue_stats(R.current_items(spark, items, results, total))
    same(R.latest_stats(spark, total).select(STATS[1:]), overall.select(STATS[1:]))


def test_a_flush_costs_what_changed(spark, tmp_path):
    """Rows that flushes after the first one read and log do not depend on the size of the queue."""
    rows = feed_rows(60, 10, 5)
    cost = {}
    for n in (20, 400):
        items, results = queue(spark, n)
        source, out = tmp_path / f"in{n}", tmp_path / f"out{n}"
        write_parts(spark, rows, TASK_EVENT, source, 6)
        feed = read_task_events(spark, str(source), files_per_trigger=1)
        query = run(R.running_stats(feed, items, results, str(out), ["batch_id"]))
        later = [p for p in query.recentProgress if p["batchId"] > 0 and p["numInputRows"]]
        assert len(later) == 5 and all(p["stateOperators"][0]["numRowsUpdated"] <= 30 for p in later)
        logged = [spark.read.parquet(str(p)).count() for p in sorted(out.glob("delta-*"))]
        cost[n] = [p["numInputRows"] for p in later], logged[1:]
    assert cost[20] == cost[400]


def test_items_share_values_of_state(spark, tmp_path):
    """A use of state serves a bucket of items; texts of messages come through as they are."""
    items, results = queue(spark, 40)
    odd = 'a "b"\\ \n\u00e9\U0001f600'
    rows = [(*row[:6], odd, *row[7:]) for row in feed_rows(300, 40, 11)]
    write_parts(spark, rows, TASK_EVENT, tmp_path / "in", 5)
    out = str(tmp_path / "out")
    feed = read_task_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = run(R.running_stats(feed, items, results, out, ["batch_id"], buckets=3))
    assert max(state_rows(query)) == 3
    whole = R.current_items(spark, items, results, out)
    same(R.latest_stats(spark, out).select(STATS), R.stats.queue_stats(whole, ["batch_id"]).select(STATS))
    assert 0 < R.removed_items(spark, out).count() < 40
    found = R.current_results(spark, results, out).select("label").distinct().collect()
    assert odd in {r.label for r in found}


def test_replayed_flushes_count_once(spark, tmp_path, monkeypatch):
    items, results = queue(spark, 10)
    write_parts(spark, feed_rows(60, 10, 9), TASK_EVENT, tmp_path / "in", 4)
    out = str(tmp_path / "out")

    def flush(limit):
        commit = S.ChangeLog.commit

        def stopping(self, epoch, *args, **kwargs):
            commit(self, epoch, *args, **kwargs)
            if epoch == limit:
                raise Stop

        feed = read_task_events(spark, str(tmp_path / "in"), files_per_trigger=1)
        with monkeypatch.context() as patch:
            patch.setattr(S.ChangeLog, "commit", stopping)
            return run(R.running_stats(feed, items, results, out, ["batch_id"]))

    for limit in (0, 2):  # the log has the epoch, the checkpoint does not
        with pytest.raises(Exception, match="Stop"):
            flush(limit)
    flush(None)
    whole = R.current_items(spark, items, results, out)
    same(R.latest_stats(spark, out).select(STATS), R.stats.queue_stats(whole, ["batch_id"]).select(STATS))


# Lifecycle -----------------------------------------------------------------------------------

MOVE = "asset_id string, format string, type string, ts timestamp, seq bigint"


@pytest.mark.parametrize("parts", [1, 6])
def test_finished_items_leave_the_state(spark, tmp_path, parts):
    random.seed(11)
    at, rows = START, []
    for seq in range(240):
        at += timedelta(seconds=random.choice([0, 1, 5, 40]))
        kind = random.choice(["start", "RESULT", "RESULT", "ERROR", "PROGRESS"])
        rows.append((f"i{random.randint(0, 4)}", random.choice(["webp", "png"]), kind, at, seq))
    end = at + timedelta(minutes=30)
    rows += [("last", "webp", "start", end, 500), ("last", "webp", "start", end, 501)]
    events = write_parts(spark, rows, MOVE, tmp_path / "in", parts)
    keep = timedelta(seconds=60)
    batch = L.lifecycle_transitions(events, keep=keep)
    same(L.lifecycle_transitions(events, slices=7, keep=keep), batch)
    feed = read_task_events(spark, str(tmp_path / "in"), MOVE, files_per_trigger=1)
    writer = L.task_lifecycle(feed, keep).writeStream.format("memory").queryName(f"moves_{parts}")
    query = run(writer.option("checkpointLocation", str(tmp_path / "progress")))
    same(spark.table(f"moves_{parts}"), batch)
    want, states, known, opened = [], {}, {}, 0
    for asset, fmt, kind, ts, seq in rows:
        if kind == "PROGRESS":
            continue
        before, last = known.get(asset, ("pending", ts))
        if asset in known and before != "processing" and ts - last > keep:
            states.pop(asset), known.pop(asset)
            before = "pending"
        held = states.setdefault(asset, {})
        if kind != "start" and fmt not in held:
            if asset in known:
                known[asset] = (before, ts)
            continue
        held[fmt] = {"start": "processing", "RESULT": "success"}.get(kind, "error")
        now = next((s for s in ("processing", "error") if s in held.values()), "success")
        known[asset] = (now, ts)
        if now != before:
            want.append((asset, seq, before, now))
    got = sorted((r.asset_id, r.seq, r.from_status, r.to_status) for r in batch.collect())
    assert got == sorted(want)
    assert len(want) > len(L.lifecycle_transitions(events).collect()) // 2
    # the state is back to the open items: each with its status and its formats
    still = sum(1 + len(states[a]) for a, (status, _) in known.items() if status == "processing")
    # and a timer is kept twice for each of those just finished, of which there are none
    assert state_rows(query)[-1] == still < max(state_rows(query)) or parts == 1
