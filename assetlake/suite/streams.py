"""Events as worker messages, streamed from the table file and checked against batch SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..plans.session import new_shared_path, read_table
from ..sources.events import read_task_events
from ..streaming import lifecycle, options, results as R
from ..streaming.runs import drain, run
from .base import events, query
from .queue import SUMMARY

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)


def stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_task_events(spark, sf, EVENTS, glob="events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "read_task_events",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def read_task_events_query(spark, sf):
    rows = stream(spark, sf)
    return drain(rows.select("event_id", "user_id", "event_type", "value"), "events")


# Results ------------------------------------------------------------------------------------

MESSAGES = """messages AS (
  SELECT user_id AS asset_id, ['webp', 'avif', 'png'][event_id % 3 + 1] AS format,
    CASE event_type WHEN 'purchase' THEN 'RESULT' WHEN 'error' THEN 'ERROR'
      WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN CASE WHEN event_id % 97 = 0 THEN 'CANCELLED'
        WHEN event_id % 5 = 0 THEN 'WORKER_ERROR' ELSE 'PROGRESS' END ELSE 'PROGRESS' END AS type,
    CAST(floor(value * 100) AS BIGINT) AS size, event_id AS seq FROM events)"""
CANCELLED = (
    "cancelled AS (SELECT c_custkey AS asset_id FROM customer WHERE c_mktsegment = 'MACHINERY')"
)


def messages(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    fmt = F.element_at(
        F.array(F.lit("webp"), F.lit("avif"), F.lit("png")), (F.col("event_id") % 3 + 1).cast("int")
    )
    return rows.select(
        F.col("user_id").alias("asset_id"),
        fmt.alias("format"),
        F.when(kind == "purchase", "RESULT").when(kind == "error", "ERROR")
        .when(kind == "signup", "QUEUED")
        .when((kind == "view") & (F.col("event_id") % 97 == 0), "CANCELLED")
        .when((kind == "view") & (F.col("event_id") % 5 == 0), "WORKER_ERROR")
        .otherwise("PROGRESS").alias("type"),
        F.floor(F.col("value") * 100).alias("size"),
        F.upper(fmt).alias("label"),
        F.when(kind == "error", "Optimization failed").alias("error"),
        F.col("event_id").alias("seq"),
        "ts",
    )


def cancelled(spark, sf):
    return read_table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("asset_id")
    )


def merged_sql(gone: str) -> str:
    return f"""{MESSAGES}, {CANCELLED},
    stopped AS (SELECT asset_id FROM messages WHERE type = 'CANCELLED'),
    base AS (SELECT DISTINCT asset_id, format FROM messages
      WHERE type = 'QUEUED' AND asset_id NOT IN (SELECT asset_id FROM stopped)),
    kept AS (SELECT *, (type = 'WORKER_ERROR')::INT AS phase FROM messages
      WHERE type IN ('RESULT', 'ERROR', 'WORKER_ERROR') {gone}),
    folded AS (SELECT asset_id, format,
      arg_max(CASE type WHEN 'RESULT' THEN 'success' ELSE 'error' END, (phase, seq)) AS status,
      arg_max(size, seq) FILTER (type = 'RESULT') AS size,
      arg_max(upper(format), seq) FILTER (type = 'RESULT') AS label,
      arg_max(CASE type WHEN 'ERROR' THEN 'Optimization failed' ELSE '{K.ERR_WORKER}' END,
        (phase, seq)) FILTER (type <> 'RESULT') AS error
      FROM kept GROUP BY asset_id, format),
    results AS (SELECT b.asset_id, b.format, coalesce(f.status, 'processing') AS status, f.size,
      f.label, f.error
      FROM base b LEFT JOIN folded f ON f.asset_id = b.asset_id AND f.format = b.format)"""


GONE = "AND asset_id NOT IN (SELECT asset_id FROM cancelled)"


def queued_results(spark, sf):
    queued = messages(events(spark, sf)).filter("type = 'QUEUED'")
    return queued.select("asset_id", "format").distinct().withColumns(
        {
            "status": F.lit(K.PROCESSING),
            "size": F.lit(None).cast("bigint"),
            "label": F.lit(None).cast("string"),
            "error": F.lit(None).cast("string"),
        }
    )


@query(
    "merge_results_stream",
    f"WITH {merged_sql(GONE)} SELECT asset_id, format, status, size, label, error FROM results",
)
def merge_results_stream(spark, sf):
    path = new_shared_path(spark, "results")
    feed = messages(stream(spark, sf))
    run(R.merge_results_stream(feed, path, cancelled(spark, sf)))
    return R.current_results(spark, queued_results(spark, sf), path)


@query(
    "drop_cancelled",
    f"WITH {MESSAGES}, {CANCELLED} SELECT asset_id, format, type, seq FROM messages "
    "WHERE asset_id NOT IN (SELECT asset_id FROM cancelled)",
)
def drop_cancelled(spark, sf):
    kept = R.drop_cancelled(messages(stream(spark, sf)), cancelled(spark, sf))
    return drain(kept.select("asset_id", "format", "type", "seq"), "kept")


@query(
    "drop_cancelled_stream",
    f"""WITH {MESSAGES}, timed AS (
      SELECT m.*, epoch_us(ts) // 1000 AS ms FROM messages m JOIN events ON event_id = seq),
    stops AS (SELECT asset_id, min((ms, seq)) AS stop FROM timed WHERE type = 'CANCELLED'
      GROUP BY asset_id)
    SELECT asset_id, format, type, seq FROM timed LEFT JOIN stops USING (asset_id)
    WHERE type <> 'CANCELLED' AND (stop IS NULL OR (ms, seq) < stop)""",
)
def drop_cancelled_stream(spark, sf):
    """Messages on one stream, cancellations on another."""
    told = messages(stream(spark, sf)).select("asset_id", "format", "type", "seq", "ts")
    stops = messages(stream(spark, sf)).filter("type = 'CANCELLED'")
    kept = R.drop_cancelled_stream(told.filter("type <> 'CANCELLED'"), stops)
    return drain(kept.select("asset_id", "format", "type", "seq"), "until-cancelled")


@query(
    "running_stats",
    f"""WITH {merged_sql("")}, flags AS (
      SELECT asset_id, bool_or(status IN ('pending', 'processing')) AS any_open,
        bool_or(status = 'error') AS any_error,
        sum(CASE WHEN status = 'success' THEN size END) AS optimized_size
      FROM results GROUP BY asset_id),
    items AS (SELECT asset_id, asset_id % 7 AS batch_id, CAST(sum(size) AS BIGINT) AS original_size
      FROM messages WHERE type = 'QUEUED' AND asset_id NOT IN (SELECT asset_id FROM stopped)
      GROUP BY asset_id),
    rated AS (SELECT batch_id, original_size, CASE WHEN coalesce(any_open, true) THEN 'processing'
        WHEN any_error THEN 'error' ELSE 'success' END AS status,
        CAST(coalesce(optimized_size, 0) AS BIGINT) AS optimized_size
      FROM items LEFT JOIN flags USING (asset_id))
    SELECT batch_id, {SUMMARY} FROM rated GROUP BY batch_id""",
)
def running_stats(spark, sf):
    path = new_shared_path(spark, "stats")
    queued = messages(events(spark, sf)).filter("type = 'QUEUED'")
    items = queued.groupBy("asset_id").agg(F.sum("size").alias("original_size")).select(
        "asset_id", (F.col("asset_id") % 7).alias("batch_id"), "original_size",
        F.lit(K.PROCESSING).alias("status"), F.lit(0).alias("progress"),
    )
    feed = messages(stream(spark, sf))
    run(R.running_stats(feed, items, queued_results(spark, sf), path, ["batch_id"]))
    return R.latest_stats(spark, path)


# Debounce -----------------------------------------------------------------------------------

SESSIONS = """stepped AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS burst FROM stepped),
bursts AS (
  SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 + 1800000 AS applied_ms,
    arg_max(event_type, (ts, event_id)) AS options, bool_or(value > 60) AS force, count(*) AS changes
  FROM numbered GROUP BY user_id, burst)"""


def option_changes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("options"),
        (F.col("value") > 60).alias("force"),
    )


def burst_columns(bursts: DataFrame) -> DataFrame:
    return bursts.select(
        "user_id", F.unix_millis("first_at").alias("first_ms"),
        F.unix_millis("applied_at").alias("applied_ms"), "options", "force", "changes",
    )


@query("debounce", f"WITH {SESSIONS} SELECT * FROM bursts")
def debounce(spark, sf):
    changes = option_changes(events(spark, sf))
    return burst_columns(options.debounce(changes, "user_id", timedelta(minutes=30)))


@query(
    "debounce_stream",
    f"WITH {SESSIONS} SELECT * FROM bursts "
    "WHERE applied_ms <= (SELECT epoch_us(max(ts)) // 1000 FROM events)",
)
def debounce_stream(spark, sf):
    changes = option_changes(stream(spark, sf))
    bursts = options.debounce(changes, "user_id", timedelta(minutes=30), delay="0 seconds")
    return burst_columns(drain(bursts, "bursts"))


# Timeouts and lifecycle -----------------------------------------------------------------------

LIMIT_MS = 6 * 3600 * 1000
TASKS = f"""timed AS (
  SELECT user_id || '-' || CAST(ts AS DATE) AS task_id, epoch_us(ts) // 1000 AS ms, event_id AS seq,
    CASE WHEN event_type IN ('signup', 'view') THEN 'start' WHEN event_type = 'purchase' THEN 'done'
      WHEN event_type = 'error' THEN 'failed' ELSE 'other' END AS kind FROM events),
starts AS (SELECT task_id, min((ms, seq)) AS s, min(ms) + {LIMIT_MS} AS deadline
  FROM timed WHERE kind = 'start' GROUP BY task_id),
ends AS (SELECT t.task_id, min(ms) AS first_ms, arg_min(kind, (ms, seq)) AS kind
  FROM timed t JOIN starts USING (task_id)
  WHERE kind IN ('done', 'failed') AND (ms, seq) > s GROUP BY t.task_id),
outcomes AS (
  SELECT task_id, CASE WHEN first_ms <= deadline THEN kind ELSE 'Task timed out' END AS outcome,
    CASE WHEN first_ms <= deadline THEN first_ms ELSE deadline END AS at_ms
  FROM starts LEFT JOIN ends USING (task_id)
  WHERE first_ms IS NOT NULL OR deadline < (SELECT epoch_us(max(ts)) // 1000 FROM events))"""


def task_events(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return rows.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
        .alias("task_id"),
        F.when(kind.isin("signup", "view"), "start").when(kind == "purchase", "done")
        .when(kind == "error", "failed").otherwise("other").alias("kind"),
        "ts",
        F.col("event_id").alias("seq"),
    )


@query("task_timeouts", f"WITH {TASKS} SELECT task_id, outcome, at_ms FROM outcomes")
def task_timeouts(spark, sf):
    return drain(lifecycle.task_timeouts(task_events(stream(spark, sf)), LIMIT_MS), "timeouts")


@query("task_outcomes", f"WITH {TASKS} SELECT task_id, outcome, at_ms FROM outcomes")
def task_outcomes(spark, sf):
    rows = events(spark, sf)
    until = rows.agg(F.max(F.unix_millis("ts"))).first()[0]
    return lifecycle.task_outcomes(task_events(rows), LIMIT_MS, until)


STATES = """states AS (
  SELECT user_id AS asset_id, event_id % 3 AS f, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN event_type IN ('signup', 'view') THEN 'processing'
      WHEN event_type = 'purchase' THEN 'success' ELSE 'error' END AS state
  FROM events WHERE event_type <> 'click')"""
KEEP = timedelta(hours=6)
#: A finished item that is silent for longer than KEEP begins anew.
LIVES = f"""{STATES.replace("states AS", "every AS")},
followed AS (SELECT *, lag(state) OVER (PARTITION BY asset_id, f ORDER BY ts_ms, seq) AS earlier,
  lag(ts_ms) OVER (PARTITION BY asset_id ORDER BY ts_ms, seq) AS last_ms FROM every),
opened AS (SELECT *, coalesce(sum((state = 'processing')::INT - coalesce((earlier = 'processing')::INT, 0))
  OVER (PARTITION BY asset_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS held FROM followed),
states AS (SELECT asset_id, f, seq, ts_ms, state,
  sum((held = 0 AND coalesce(ts_ms - last_ms > {KEEP // timedelta(milliseconds=1)}, false))::INT)
    OVER (PARTITION BY asset_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS life FROM opened)"""


def moved_sql(states: str, item: str) -> str:
    """Transitions from the states of formats; `item` names the columns that tell items apart."""
    return f"""WITH {states},
begun AS (SELECT {item}, f, min((ts_ms, seq)) AS s FROM states WHERE state = 'processing'
  GROUP BY {item}, f),
stepped AS (SELECT t.*, lag(state) OVER (PARTITION BY {item}, f ORDER BY ts_ms, seq) AS was
  FROM states t JOIN begun USING ({item}, f) WHERE (ts_ms, seq) >= s),
counted AS (
  SELECT *, sum((state = 'processing')::INT - coalesce((was = 'processing')::INT, 0)) OVER w AS open,
    sum((state = 'error')::INT - coalesce((was = 'error')::INT, 0)) OVER w AS failed
  FROM stepped WINDOW w AS (PARTITION BY {item} ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)),
named AS (SELECT {item}, seq, ts_ms, CASE WHEN open > 0 THEN 'processing' WHEN failed > 0
  THEN 'error' ELSE 'success' END AS to_status FROM counted),
moves AS (SELECT asset_id, seq, ts_ms, coalesce(lag(to_status) OVER (PARTITION BY {item}
  ORDER BY ts_ms, seq), 'pending') AS from_status, to_status FROM named)
SELECT CAST(asset_id AS VARCHAR) AS asset_id, seq, ts_ms, from_status, to_status
FROM moves WHERE from_status <> to_status"""


def lifecycle_events(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").cast("string").alias("asset_id"),
        (F.col("event_id") % 3).cast("string").alias("format"),
        F.when(kind.isin("signup", "view"), "start").when(kind == "purchase", "RESULT")
        .when(kind == "error", "ERROR").otherwise("PROGRESS").alias("type"),
        "ts",
        F.col("event_id").alias("seq"),
    )


MOVED = moved_sql(STATES, "asset_id")
LIVED = moved_sql(LIVES, "asset_id, life")


@query("task_lifecycle", MOVED)
def task_lifecycle(spark, sf):
    return drain(lifecycle.task_lifecycle(lifecycle_events(stream(spark, sf))), "lifecycle")


@query("lifecycle_transitions", MOVED)
def lifecycle_transitions(spark, sf):
    return lifecycle.lifecycle_transitions(lifecycle_events(events(spark, sf)))


@query("task_lifecycle_expiring", LIVED)
def task_lifecycle_expiring(spark, sf):
    moves = lifecycle.task_lifecycle(lifecycle_events(stream(spark, sf)), KEEP)
    return drain(moves, "lifecycle")


@query("lifecycle_transitions_expiring", LIVED)
def lifecycle_transitions_expiring(spark, sf):
    return lifecycle.lifecycle_transitions(lifecycle_events(events(spark, sf)), keep=KEEP)
