"""Queue items, tasks, results, order and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, constants as K
from ..operators import naming, packing, ranking, stats, tasks
from ..operators.intake import archive_limits, archive_totals, intake_verdict, union_intake
from ..plans.ordered import ranked
from ..plans.session import read_table
from .base import (
    ASSETS, ITEMS, LAST, MAGIC, REPORTS, RESULTS, REPORT_ORDER, SUPPORTED, assets, items, query,
    reports, results, sql_list,
)

STATUS = f"""WITH {ITEMS}, {RESULTS},
flags AS (
  SELECT asset_id, bool_or(status IN ('pending', 'processing')) AS any_open,
    bool_or(status = 'error') AS any_error,
    sum(CASE WHEN status = 'success' THEN size END) AS optimized_size
  FROM results GROUP BY asset_id),
rated AS (
  SELECT i.asset_id, batch_id, original_size,
    CASE WHEN coalesce(any_open, true) THEN i.status WHEN any_error THEN 'error'
         ELSE 'success' END AS status,
    CASE WHEN coalesce(any_open, true) THEN i.progress ELSE 100 END AS progress,
    CAST(coalesce(optimized_size, 0) AS BIGINT) AS optimized_size
  FROM items i LEFT JOIN flags f ON f.asset_id = i.asset_id)"""

SUMMARY = """count(*) AS items, CAST(sum(original_size) AS BIGINT) AS total_original,
  CAST(sum(optimized_size) AS BIGINT) AS total_optimized,
  bool_and(status IN ('success', 'error')) AS all_done,
  count(*) FILTER (status = 'success') AS successful,
  count(*) FILTER (status = 'processing') AS processing,
  bool_or(status IN ('success', 'error')) AS has_finished,
  count(*) FILTER (status = 'error') = 0 AS zero_errors,
  CASE WHEN sum(original_size) > 0 AND sum(optimized_size) <> 0
    THEN round((sum(original_size) - sum(optimized_size)) / CAST(sum(original_size) AS DOUBLE)
      * 100, 1)
    ELSE 0.0 END AS savings_pct"""


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.item_status(items(spark, sf), results(spark, sf))


@query("queue_stats", f"{STATUS} SELECT batch_id, {SUMMARY} FROM rated GROUP BY batch_id")
def queue_stats(spark, sf):
    return stats.queue_stats(rated(spark, sf), ["batch_id"])


@query("queue_stats_overall", f"{STATUS} SELECT {SUMMARY} FROM rated")
def queue_stats_overall(spark, sf):
    return stats.queue_stats(rated(spark, sf))


@query(
    "item_status",
    f"{STATUS} SELECT asset_id, batch_id, status, progress, optimized_size FROM rated",
)
def item_status(spark, sf):
    return rated(spark, sf).select("asset_id", "batch_id", "status", "progress", "optimized_size")


@query("latest_result", f"WITH {RESULTS} SELECT asset_id, format, status, size FROM results")
def latest_result(spark, sf):
    return results(spark, sf)


CUSTOM = ["webp", "avif", "jpeg", "webp"]


@query(
    "expand_tasks",
    f"""WITH {ITEMS}, wanted AS (
      SELECT asset_id, CASE original_format WHEN 'jpg' THEN 'jpeg' ELSE original_format END AS own
      FROM items),
    every AS (
      SELECT asset_id, own AS format, 0 AS place FROM wanted
      UNION ALL SELECT asset_id, unnest(['webp', 'avif', 'jpeg']), unnest([1, 2, 3]) FROM wanted)
    SELECT asset_id, format,
      CAST(row_number() OVER (PARTITION BY asset_id ORDER BY min(place)) - 1 AS INT) AS task_ordinal
    FROM every GROUP BY asset_id, format""",
)
def expand_tasks(spark, sf):
    formats = F.array(*[F.lit(f) for f in CUSTOM])
    expanded = tasks.expand_tasks(items(spark, sf), formats, False, True)
    return expanded.select("asset_id", "format", "task_ordinal")


@query(
    "distinct_formats",
    f"""WITH {ITEMS} SELECT asset_id,
      CASE original_format WHEN 'jpg' THEN 'jpeg,webp,avif' WHEN 'webp' THEN 'webp,avif,jpeg'
        WHEN 'avif' THEN 'avif,webp,jpeg' ELSE original_format || ',webp,avif,jpeg' END AS formats
    FROM items""",
)
def distinct_formats(spark, sf):
    formats = F.array(*[F.lit(f) for f in CUSTOM])
    listed = C.format_list(F.col("original_format"), formats, False, True)
    return items(spark, sf).select("asset_id", F.array_join(listed, ",").alias("formats"))


VISIBLE = """visible AS (
  SELECT l_orderkey AS asset_id FROM lineitem WHERE l_extendedprice > 90000)"""


def visible(spark, sf):
    """Ids seen on screen, with repeats: orders with an expensive line."""
    return read_table(spark, sf, "lineitem").filter("l_extendedprice > 90000").select(
        F.col("l_orderkey").alias("asset_id")
    )


@query(
    "pending_only",
    f"WITH {ITEMS}, {VISIBLE} SELECT asset_id, batch_id FROM items WHERE asset_id IN "
    "(SELECT asset_id FROM visible)",
)
def pending_only(spark, sf):
    return tasks.pending_only(items(spark, sf), visible(spark, sf)).select("asset_id", "batch_id")


@query(
    "remove_items",
    f"WITH {ITEMS}, {VISIBLE} SELECT asset_id, batch_id FROM items WHERE asset_id NOT IN "
    "(SELECT asset_id FROM visible)",
)
def remove_items(spark, sf):
    return tasks.remove_items(items(spark, sf), visible(spark, sf)).select("asset_id", "batch_id")


@query(
    "clear_finished",
    f"{STATUS} SELECT asset_id, status FROM rated WHERE status IN ('pending', 'processing')",
)
def clear_finished(spark, sf):
    return tasks.clear_finished(rated(spark, sf)).select("asset_id", "status")


@query(
    "flag_visible",
    f"WITH {ITEMS}, {VISIBLE} SELECT asset_id, asset_id IN (SELECT asset_id FROM visible) "
    "AS visible FROM items",
)
def flag_visible(spark, sf):
    return tasks.flag_visible(items(spark, sf), visible(spark, sf)).select("asset_id", "visible")


RANKED = f"""WITH {ITEMS}, {VISIBLE}, ranked AS (
  SELECT asset_id, batch_id, original_size, row_number() OVER (PARTITION BY batch_id ORDER BY
    CASE WHEN asset_id IN (SELECT asset_id FROM visible) THEN 0 ELSE 1 END,
    original_size, ordinal) AS queue_rank
  FROM items WHERE status = 'pending')"""


@query("priority_rank", f"{RANKED} SELECT asset_id, batch_id, queue_rank FROM ranked")
def priority_rank(spark, sf):
    flagged = tasks.flag_visible(items(spark, sf), visible(spark, sf))
    return ranking.priority_rank(flagged).select("asset_id", "batch_id", "queue_rank")


@query(
    "next_task",
    f"{RANKED} SELECT batch_id, asset_id, original_size FROM ranked WHERE queue_rank = 1",
)
def next_task(spark, sf):
    flagged = tasks.flag_visible(items(spark, sf), visible(spark, sf))
    return ranking.next_task(flagged).select("batch_id", "asset_id", "original_size")


@query(
    "order_items",
    f"""WITH {ITEMS}, placed AS (
      SELECT l_orderkey AS asset_id, CAST(floor(max(l_extendedprice)) AS BIGINT) AS ordinal
      FROM lineitem GROUP BY l_orderkey)
    SELECT items.asset_id, name, placed.ordinal FROM items JOIN placed
      ON placed.asset_id = items.asset_id""",
)
def order_items(spark, sf):
    order = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(
        F.floor(F.max("l_extendedprice")).alias("ordinal")
    )
    return ranking.order_items(items(spark, sf), order).select("asset_id", "name", "ordinal")


@query(
    "item_lookup",
    f"WITH {ITEMS} SELECT asset_id, name, original_size FROM items WHERE asset_id = 42",
)
def item_lookup(spark, sf):
    return ranking.item_lookup(items(spark, sf), 42).select("asset_id", "name", "original_size")


@query("item_count", f"WITH {ITEMS} SELECT count(*) AS items FROM items")
def item_count(spark, sf):
    return ranking.item_count(items(spark, sf))


# Outcomes folded into results ----------------------------------------------------------------

OUTCOMES = f"""WITH {REPORTS},
base AS (SELECT o_orderkey AS asset_id, unnest(['webp', 'png']) AS format FROM orders),
feed AS (
  SELECT asset_id, format, CASE WHEN status = 'error' THEN 1 ELSE 0 END AS phase,
    CASE WHEN status = 'success' THEN 'success' ELSE 'error' END AS status,
    CASE WHEN status = 'success' THEN size END AS size,
    CASE WHEN status = 'success' THEN upper(format) END AS label,
    CASE status WHEN 'pending' THEN 'line ' || line WHEN 'error' THEN 'Worker error' END AS error,
    row_number() OVER (PARTITION BY asset_id, format ORDER BY
      CASE WHEN status = 'error' THEN 1 ELSE 0 END, shipped, line, part, supp, reports.size) AS turn
  FROM reports),
folded AS (
  SELECT asset_id, format, arg_max(status, turn) AS status,
    arg_max(size, turn) FILTER (status = 'success') AS size,
    arg_max(label, turn) FILTER (status = 'success') AS label,
    arg_max(error, turn) FILTER (status = 'error') AS error
  FROM feed GROUP BY asset_id, format)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    feed = reports(spark, sf).withColumns(
        {
            "seq": F.struct(*REPORT_ORDER),
            "type": F.when(F.col("status") == K.SUCCESS, "RESULT").otherwise("ERROR"),
            "label": F.upper("format"),
            "error": F.concat(F.lit("line "), F.col("line").cast("string")),
        }
    )
    failed = F.col("status") == K.ERROR
    return tasks.merge_outcomes(feed.filter(~failed), feed.filter(failed))


@query("merge_outcomes", f"{OUTCOMES} SELECT asset_id, format, phase, status, size, error FROM feed")
def merge_outcomes(spark, sf):
    return outcomes(spark, sf).select("asset_id", "format", "phase", "status", "size", "error")


@query(
    "apply_results",
    f"""{OUTCOMES} SELECT b.asset_id, b.format, coalesce(f.status, 'processing') AS status,
      f.size, f.label, f.error FROM base b LEFT JOIN folded f
      ON f.asset_id = b.asset_id AND f.format = b.format""",
)
def apply_results(spark, sf):
    formats = F.array(F.lit("webp"), F.lit("png"))
    open_results = tasks.expand_tasks(items(spark, sf), formats, use_original=False).select(
        "asset_id",
        "format",
        F.lit(K.PROCESSING).alias("status"),
        F.lit(None).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("error"),
    )
    return tasks.apply_results(open_results, outcomes(spark, sf))


@query(
    "reapply_options",
    f"""{STATUS}, redo AS (SELECT r.asset_id, original_format FROM rated r JOIN items i
        ON i.asset_id = r.asset_id WHERE r.status IN ('pending', 'processing'))
    SELECT asset_id, format, status, size FROM results
      WHERE asset_id NOT IN (SELECT asset_id FROM redo)
    UNION ALL SELECT asset_id, f.format, 'pending', NULL
      FROM redo, (VALUES ('webp'), ('png')) AS f(format)""",
)
def reapply_options(spark, sf):
    status, found = rated(spark, sf), results(spark, sf)
    formats = F.array(F.lit("webp"), F.lit("png"))
    return tasks.reapply_options(status, found, formats, use_original=False)[1]


@query(
    "successful_results",
    f"""WITH {RESULTS} SELECT asset_id, count(*) FILTER (status = 'success') AS successes,
      CAST(sum(CASE WHEN status = 'success' THEN size END) AS BIGINT) AS bytes,
      string_agg(CASE WHEN status = 'success' THEN format END, ',' ORDER BY format) AS formats
    FROM results GROUP BY asset_id""",
)
def successful_results(spark, sf):
    kept = C.successful_results(F.col("results"))
    sizes = F.transform(F.map_values(kept), lambda r: r["size"])
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return tasks.nested_results(results(spark, sf)).select(
        "asset_id",
        F.size(kept).cast("bigint").alias("successes"),
        F.when(F.size(kept) > 0, total).alias("bytes"),
        F.nullif(F.array_join(F.array_sort(F.map_keys(kept)), ","), F.lit("")).alias("formats"),
    )


# Packing and naming -----------------------------------------------------------------------------

PACK_BYTES = 400_000
PACK_FILES = 40


def exportable(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as results: one batch per source, in document order."""
    return assets(spark, sf).select(
        "batch_id", "ordinal", "name", F.lit("jpeg").alias("format"),
        F.lit(K.SUCCESS).alias("status"), "size",
    )


PACKED = f"""WITH RECURSIVE {ASSETS},
queue AS (
  SELECT batch_id, ordinal, name, size,
    row_number() OVER (PARTITION BY batch_id ORDER BY ordinal) AS n FROM assets),
walk AS (
  SELECT batch_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS files,
    CAST(0 AS BIGINT) AS used, false AS taken FROM (SELECT DISTINCT batch_id FROM queue)
  UNION ALL
  SELECT w.batch_id, q.n,
    w.files + CASE WHEN t.ok THEN 1 ELSE 0 END, w.used + CASE WHEN t.ok THEN q.size ELSE 0 END, t.ok
  FROM walk w JOIN queue q ON q.batch_id = w.batch_id AND q.n = w.n + 1,
    LATERAL (SELECT w.files < {PACK_FILES} AND w.used < {PACK_BYTES}
      AND w.used + q.size <= {PACK_BYTES} AS ok) AS t),
packed AS (
  SELECT q.batch_id, q.ordinal, q.name, q.size, w.files AS position, w.used AS total_bytes
  FROM walk w JOIN queue q ON q.batch_id = w.batch_id AND q.n = w.n WHERE w.taken)"""


@query(
    "greedy_pack",
    f"{PACKED} SELECT batch_id, ordinal, size, position, total_bytes FROM packed",
)
def greedy_pack(spark, sf):
    return packing.greedy_pack(exportable(spark, sf), ["ordinal"], PACK_FILES, PACK_BYTES)


def to_name(spark: SparkSession, sf: str) -> DataFrame:
    """Items under heavily repeated names, as results of one format each."""
    return items(spark, sf).select(
        "batch_id", "ordinal", F.replace("name", F.lit("img-"), F.lit("img")).alias("name"),
        "original_format", F.lit("jpeg").alias("format"),
    )


@query(
    "unique_names",
    f"""WITH {ITEMS}, numbered AS (
      SELECT batch_id, ordinal, 'img' || substr(split_part(name, '.', 1), 5) AS base,
        row_number() OVER (PARTITION BY batch_id, split_part(name, '.', 1) ORDER BY ordinal) AS n
      FROM items)
    SELECT batch_id, ordinal,
      'small-' || base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.jpg' AS export_name
    FROM numbered""",
)
def unique_names(spark, sf):
    rows = naming.named(to_name(spark, sf))
    return naming.unique_names(rows, prefix="small-").select("batch_id", "ordinal", "export_name")


@query(
    "unique_names_colliding",
    f"""WITH RECURSIVE {ITEMS},
    bases AS (SELECT batch_id, ordinal, CASE WHEN ordinal % 40 < 20 THEN 'img'
        WHEN ordinal % 40 < 25 THEN 'img-2-2' ELSE 'img-' || (ordinal // 40) END AS base,
      row_number() OVER (PARTITION BY batch_id ORDER BY ordinal) AS place FROM items),
    taken(batch_id, name, place) USING KEY (batch_id, name) AS (
      SELECT batch_id, base || '.png', place FROM bases WHERE place = 1
      UNION ALL
      SELECT b.batch_id, (SELECT min_by(c.name, c.k) FROM (
          SELECT k, b.base || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.png' AS name
          FROM range(1, b.place + 1) t(k)) c
        WHERE NOT EXISTS (SELECT 1 FROM recurring.taken u
          WHERE u.batch_id = b.batch_id AND u.name = c.name)), b.place
      FROM taken l JOIN bases b ON b.batch_id = l.batch_id AND b.place = l.place + 1)
    SELECT batch_id, ordinal, name AS export_name FROM bases JOIN taken USING (batch_id, place)""",
)
def unique_names_colliding(spark, sf):
    """Names like img, img-2, img-7 that collide with numbered ones; the SQL takes row by row."""
    key = F.col("ordinal") % 40
    base = F.when(key < 20, F.lit("img")).when(key < 25, F.lit("img-2-2")).otherwise(
        F.concat(F.lit("img-"), F.floor(F.col("ordinal") / 40).cast("string"))
    )
    rows = items(spark, sf).select(
        "batch_id", "ordinal", base.alias("base"), F.lit("png").alias("ext")
    )
    return naming.unique_names(rows).select("batch_id", "ordinal", "export_name")


@query(
    "download_name",
    f"""WITH {ITEMS} SELECT asset_id, 'small-' || split_part(name, '.', 1) || '.' ||
      CASE original_format WHEN 'jpg' THEN 'jpg' ELSE original_format END AS download_name
    FROM items""",
)
def download_name(spark, sf):
    fmt = C.normalize_format(F.lit("original"), F.col("original_format"))
    return items(spark, sf).select(
        "asset_id", C.download_name(F.col("name"), fmt, "small-").alias("download_name")
    )


# Archives and intake ------------------------------------------------------------------------------

MEMBER_LIMIT, BYTE_LIMIT = 40, 110_000
TOTALS = f"""WITH {ASSETS}, totals AS (
  SELECT batch_id AS archive_path, count(*) AS members, CAST(sum(size) AS BIGINT) AS expanded_bytes
  FROM assets GROUP BY batch_id)"""
#: Where the members of an archive, in the order of their ids, cross each limit.
IN_ORDER = f"""placed AS (
  SELECT batch_id, size, row_number() OVER (PARTITION BY batch_id ORDER BY asset_id) AS n
  FROM assets),
crossed AS (
  SELECT batch_id, min(n) FILTER (total > {BYTE_LIMIT}) AS bytes_at,
    min(n) FILTER (n > {MEMBER_LIMIT}) AS count_at
  FROM (SELECT *, sum(size) OVER (PARTITION BY batch_id ORDER BY n) AS total FROM placed)
  GROUP BY batch_id)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as archive members: one archive per source."""
    place = ranked(assets(spark, sf), ["batch_id"], [F.col("asset_id")], "place")
    return place.select(
        F.col("batch_id").alias("archive_path"), F.col("name").alias("member_path"), "size",
        (F.col("place") - 1).alias("position"),
    )


@query("archive_totals", f"{TOTALS} SELECT archive_path, members, expanded_bytes FROM totals")
def archive_totals_query(spark, sf):
    return archive_totals(members(spark, sf))


@query(
    "archive_limits",
    f"""{TOTALS}, {IN_ORDER}, rated AS (SELECT t.*, coalesce(count_at < bytes_at, bytes_at IS NULL)
      AS by_count, members > {MEMBER_LIMIT} OR expanded_bytes > {BYTE_LIMIT} AS over
      FROM totals t JOIN crossed c ON c.batch_id = t.archive_path)
    SELECT a.batch_id AS archive_path, a.name AS member_path, a.size, NULL AS error
    FROM assets a JOIN rated r ON r.archive_path = a.batch_id WHERE NOT over
    UNION ALL SELECT archive_path, NULL, NULL,
      CASE WHEN by_count THEN '{K.ERR_ZIP_PREFIX}{K.ERR_ZIP_COUNT}'
        ELSE '{K.ERR_ZIP_PREFIX}{K.ERR_ZIP_BYTES}' END
    FROM rated WHERE over""",
)
def archive_limits_query(spark, sf):
    """A member that crosses both limits counts as over the bytes, as in the SQL."""
    kept, over = archive_limits(
        members(spark, sf), max_members=MEMBER_LIMIT, max_bytes=BYTE_LIMIT, tie=K.ERR_ZIP_BYTES
    )
    return union_intake(kept.drop("position"), over.select("archive_path", "error"))


@query(
    "union_intake",
    f"""WITH {ASSETS} SELECT asset_id, name, size, 'file' AS origin,
      CASE WHEN size > 20000 THEN '{K.ERR_FILE_LIMIT}' WHEN NOT {MAGIC} THEN '{K.ERR_INVALID}' END
        AS error, NULL AS archive_path
    FROM assets WHERE {SUPPORTED} AND lang = 'en'
    UNION ALL SELECT asset_id, name, size, 'archive', NULL, batch_id FROM assets
    WHERE lang <> 'en'""",
)
def union_intake_query(spark, sf):
    rows = assets(spark, sf)
    loose = intake_verdict(rows.filter("lang = 'en'"), max_bytes=20_000).select(
        "asset_id", "name", "size", F.lit("file").alias("origin"), "error"
    )
    packed = rows.filter("lang <> 'en'").select(
        "asset_id", "name", "size", F.lit("archive").alias("origin"),
        F.col("batch_id").alias("archive_path"),
    )
    return union_intake(loose, packed)


# Plans per task -----------------------------------------------------------------------------------

REQUESTED = ["webp", "avif", "jpeg", "png", "jxl", "gif"]
PLAN_TASKS = f"""{ASSETS}, plan_tasks AS (
  SELECT asset_id, {sql_list(REQUESTED)}[asset_id % 6 + 1] AS requested_format,
    CASE WHEN size % 11 = 0 THEN 'poster' WHEN size % 3 = 0 THEN 'graphic' ELSE 'photo' END
      AS preset,
    size % 2 = 0 AS has_alpha, size % 2 = 0 AND size < 3000 AS small_transparent
  FROM assets)"""


def preset_values() -> str:
    def cell(value) -> str:
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    rows = ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in K.PRESETS)
    names = ", ".join(part.split()[0] for part in K.PRESET_COLUMNS.split(", "))
    return f"presets AS (SELECT * FROM (VALUES {rows}) AS p({names}))"


def plan_tasks(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("size")
    return assets(spark, sf).select(
        "asset_id",
        F.element_at(F.array(*[F.lit(f) for f in REQUESTED]), (F.col("asset_id") % 6 + 1).cast("int"))
        .alias("format"),
        F.when(size % 11 == 0, "poster").when(size % 3 == 0, "graphic").otherwise("photo")
        .alias("preset"),
        (size % 2 == 0).alias("has_alpha"),
        ((size % 2 == 0) & (size < 3000)).alias("small_transparent"),
    )


@query(
    "preset_lookup",
    f"""WITH {PLAN_TASKS}, {preset_values()} SELECT asset_id, t.preset, requested_format AS format,
      {", ".join(K.PRESET_NAMES)}, CASE WHEN p.format IS NULL THEN '{K.ERR_NO_PRESET}' END AS error
    FROM plan_tasks t LEFT JOIN presets p
      ON p.preset = t.preset AND p.format = t.requested_format""",
)
def preset_lookup(spark, sf):
    return tasks.preset_lookup(plan_tasks(spark, sf)).select(
        "asset_id", "preset", "format", *K.PRESET_NAMES, "error"
    )


@query(
    "encode_plan",
    f"""WITH {PLAN_TASKS}, {preset_values()}, routed AS (
      SELECT *, CASE WHEN requested_format IN ('webp', 'avif', 'jpeg', 'png')
        THEN requested_format ELSE 'webp' END AS encoder FROM plan_tasks)
    SELECT asset_id, r.preset, requested_format, encoder,
      CASE WHEN requested_format = 'webp' AND small_transparent THEN 77
        WHEN encoder = 'png' AND small_transparent AND r.preset = 'photo' THEN 90
        ELSE quality END AS quality,
      CASE WHEN encoder = 'png' AND small_transparent AND r.preset = 'photo' THEN 98
        ELSE quality_max END AS quality_max,
      {", ".join(K.PRESET_NAMES[2:])}, encoder = 'jpeg' AND has_alpha AS flatten_alpha,
      CASE WHEN r.preset = 'graphic' THEN 'photo' END AS fallback_preset,
      CASE WHEN p.format IS NULL THEN '{K.ERR_NO_PRESET}' END AS error
    FROM routed r LEFT JOIN presets p ON p.preset = r.preset AND p.format = r.encoder""",
)
def encode_plan(spark, sf):
    return tasks.encode_plan(plan_tasks(spark, sf)).select(
        "asset_id", "preset", "requested_format", "encoder", *K.PRESET_NAMES, "flatten_alpha",
        "fallback_preset", "error",
    )


@query(
    "pick_codec",
    f"""WITH {PLAN_TASKS}, registered AS (
      SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey * 10 + l_linenumber AS seq,
        'codec' || (l_suppkey % 40) AS id,
        {sql_list(REQUESTED)}[l_partkey % 5 + 1] AS format, l_linestatus = 'F' AS encode
      FROM lineitem),
    current AS (
      SELECT id, min((seq, format, encode)) AS position, arg_max(format, (seq, format, encode)) AS format,
        arg_max(encode, (seq, format, encode)) AS encode FROM registered GROUP BY id),
    chosen AS (
      SELECT format, arg_min(id, (position, id)) AS codec_id FROM current WHERE encode
      GROUP BY format)
    SELECT asset_id, requested_format AS format, codec_id
    FROM plan_tasks LEFT JOIN chosen ON chosen.format = requested_format""",
)
def pick_codec(spark, sf):
    """Lineitems as a registration log: many re-registrations of forty codecs."""
    registered = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
        .alias("n"),
        F.concat(F.lit("codec"), (F.col("l_suppkey") % 40).cast("string")).alias("id"),
        F.element_at(F.array(*[F.lit(f) for f in REQUESTED]), (F.col("l_partkey") % 5 + 1).cast("int"))
        .alias("format"),
        (F.col("l_linestatus") == "F").alias("encode"),
    ).select(F.struct("n", "format", "encode").alias("seq"), "id", "format", "encode")
    wanted = plan_tasks(spark, sf).select("asset_id", "format")
    return tasks.pick_codec(wanted, registered).select("asset_id", "format", "codec_id")
