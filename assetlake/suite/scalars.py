"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C, constants as K
from ..operators import intake
from ..plans.session import read_table
from .base import ASSETS, DOC_LIMIT, MAGIC, MIME, RESULTS, SUPPORTED, assets, items, query, results
from .base import ITEMS, sql_list


@query("file_extension", f"WITH {ASSETS} SELECT asset_id, name, extension FROM assets")
def file_extension(spark, sf):
    return assets(spark, sf).select(
        "asset_id", "name", C.file_extension(F.col("name")).alias("extension")
    )


@query("supported_only", f"WITH {ASSETS} SELECT asset_id, name FROM assets WHERE {SUPPORTED}")
def supported_only(spark, sf):
    return intake.supported_only(assets(spark, sf)).select("asset_id", "name")


@query("mime_type", f"WITH {ASSETS} SELECT asset_id, {MIME} AS mime FROM assets")
def mime_type(spark, sf):
    return intake.with_names(assets(spark, sf)).select("asset_id", "mime")


@query(
    "mime_prefix_filter",
    f"WITH {ASSETS} SELECT asset_id, {MIME} AS mime FROM assets "
    f"WHERE starts_with({MIME}, 'image/')",
)
def mime_prefix_filter(spark, sf):
    return intake.mime_prefix_filter(intake.with_names(assets(spark, sf))).select("asset_id", "mime")


@query(
    "size_limit",
    f"""WITH {ASSETS} SELECT asset_id, size, CASE
      WHEN ends_with(name, '.zip') THEN CASE WHEN size > 5000 THEN '{K.ERR_ZIP_LIMIT}' END
      WHEN size > {DOC_LIMIT} THEN '{K.ERR_FILE_LIMIT}' END AS error FROM assets""",
)
def size_limit(spark, sf):
    return intake.size_limit(assets(spark, sf), DOC_LIMIT, 5000).select("asset_id", "size", "error")


@query("magic_match", f"WITH {ASSETS} SELECT asset_id, {MAGIC} AS magic_ok FROM assets")
def magic_match(spark, sf):
    rows = assets(spark, sf)
    ok = C.magic_match(F.col("content"), C.file_extension(F.col("name")))
    return rows.select("asset_id", ok.alias("magic_ok"))


@query(
    "intake_verdict",
    f"""WITH {ASSETS}, checked AS (SELECT *, CASE WHEN size > {DOC_LIMIT} THEN '{K.ERR_FILE_LIMIT}'
        WHEN NOT {MAGIC} THEN '{K.ERR_INVALID}'
        WHEN extension IN ('heic', 'heif') THEN '{K.ERR_HEIC}' END AS error
      FROM assets WHERE {SUPPORTED})
    SELECT asset_id, name, CASE WHEN error IS NULL THEN 'pending' ELSE 'error' END AS status, error
    FROM checked""",
)
def intake_verdict(spark, sf):
    return intake.intake_verdict(assets(spark, sf), max_bytes=DOC_LIMIT).select(
        "asset_id", "name", "status", "error"
    )


SIZES = "sizes AS (SELECT o_orderkey AS asset_id, CAST(o_custkey % 20000 + 1 AS INT) AS width, " \
    "CAST(floor(o_totalprice) AS BIGINT) % 25000 AS height, o_orderkey % 5 AS requested FROM orders)"


def sizes(spark, sf):
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        (F.col("o_custkey") % 20000 + 1).cast("int").alias("width"),
        (F.floor("o_totalprice") % 25000).alias("height"),
        (F.col("o_orderkey") % 5).alias("requested"),
    )


@query(
    "pixel_guard",
    f"""WITH {SIZES} SELECT asset_id, CASE WHEN CAST(width AS DOUBLE) * height > 9e6
      THEN '{K.ERR_PIXELS}' END AS error FROM sizes""",
)
def pixel_guard(spark, sf):
    return intake.pixel_guard(sizes(spark, sf), 9_000_000).select("asset_id", "error")


@query(
    "effective_dpr",
    f"""WITH {SIZES}, wanted AS (SELECT asset_id, width AS w, greatest(1, height) AS h,
        least(3, greatest(1, requested)) AS dpr FROM sizes)
    SELECT asset_id, CAST(CASE WHEN dpr >= 3 AND w * h * 9 <= 9000000 THEN 3
      WHEN dpr >= 2 AND w * h * 4 <= 9000000 THEN 2 ELSE 1 END AS INT) AS dpr FROM wanted""",
)
def effective_dpr(spark, sf):
    dpr = C.effective_dpr(F.col("width"), F.col("height"), F.col("requested"), 9_000_000)
    return sizes(spark, sf).select("asset_id", dpr.alias("dpr"))


@query(
    "internal_render_size",
    f"""WITH {SIZES}, based AS (
      SELECT asset_id, CAST(width AS BIGINT) AS w, greatest(1, height) AS h FROM sizes),
    scaled AS (SELECT *, CASE WHEN w * h * 16 > 9000000
      THEN greatest(1.0, sqrt(9000000.0::DOUBLE / CAST(w * h AS DOUBLE))) ELSE 4.0::DOUBLE END AS s
      FROM based)
    SELECT asset_id, greatest(w, CAST(floor(w * s + 0.5) AS BIGINT)) AS render_width,
      greatest(h, CAST(floor(h * s + 0.5) AS BIGINT)) AS render_height FROM scaled""",
)
def internal_render_size(spark, sf):
    w, h = C.internal_render_size(F.col("width"), F.col("height"), 9_000_000)
    return sizes(spark, sf).select("asset_id", w.alias("render_width"), h.alias("render_height"))


ROUTES = """routed AS (SELECT o_orderkey AS asset_id,
    ['jpg', 'png', 'webp', 'svg', 'gif'][o_custkey % 5 + 1] AS extension,
    ['original', 'jpg', 'webp', 'svg', 'avif', 'jxl'][o_orderkey % 6 + 1] AS requested
  FROM orders)"""
NORMAL = """CASE WHEN requested = 'original'
      THEN CASE extension WHEN 'jpg' THEN 'jpeg' ELSE extension END
    WHEN requested = 'jpg' THEN 'jpeg' ELSE requested END"""


def routed(spark, sf):
    def choose(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        choose(["jpg", "png", "webp", "svg", "gif"], F.col("o_custkey") % 5).alias("extension"),
        choose(["original", "jpg", "webp", "svg", "avif", "jxl"], F.col("o_orderkey") % 6)
        .alias("requested"),
    )


@query("normalize_format", f"WITH {ROUTES} SELECT asset_id, {NORMAL} AS format FROM routed")
def normalize_format(spark, sf):
    fmt = C.normalize_format(F.col("requested"), F.col("extension"))
    return routed(spark, sf).select("asset_id", fmt.alias("format"))


@query(
    "route_task",
    f"""WITH {ROUTES} SELECT asset_id, CASE
      WHEN extension = 'svg' OR requested = 'svg' THEN
        CASE WHEN requested IN ('webp', 'avif', 'jpeg', 'png') THEN 'vector_to_raster'
          ELSE 'vector_keep' END
      ELSE 'raster' END AS route,
      CASE WHEN {NORMAL} = 'svg' THEN 'webp' ELSE {NORMAL} END AS effective_format FROM routed""",
)
def route_task(spark, sf):
    extension, requested = F.col("extension"), F.col("requested")
    return routed(spark, sf).select(
        "asset_id",
        C.route(extension, requested).alias("route"),
        C.effective_format(extension, requested).alias("effective_format"),
    )


LINE = "l_orderkey AS asset_id, l_linenumber AS line, l_partkey AS part"


def line_keys():
    return [F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part")]


@query(
    "lossless_guard",
    f"""SELECT {LINE}, CASE WHEN l_extendedprice <= l_quantity * 1500 * 1.3::DOUBLE THEN 'lossless'
      ELSE 'lossy' END AS choice FROM lineitem""",
)
def lossless_guard(spark, sf):
    choice = C.lossless_guard(F.col("l_extendedprice"), F.col("l_quantity") * 1500)
    return read_table(spark, sf, "lineitem").select(*line_keys(), choice.alias("choice"))


@query(
    "vector_bias_choice",
    f"""SELECT {LINE}, CASE WHEN l_quantity * 1500 < l_extendedprice * 0.85::DOUBLE THEN 'wrapper'
      ELSE 'vector' END AS choice FROM lineitem""",
)
def vector_bias_choice(spark, sf):
    choice = C.vector_bias_choice(F.col("l_quantity") * 1500, F.col("l_extendedprice"))
    return read_table(spark, sf, "lineitem").select(*line_keys(), choice.alias("choice"))


@query(
    "savings_columns",
    f"""WITH {ITEMS}, {RESULTS}, sides AS (
      SELECT r.asset_id, r.format, i.original_size AS o, r.size AS s
      FROM results r JOIN items i ON i.asset_id = r.asset_id)
    SELECT asset_id, format, round(s / 1024.0::DOUBLE, 1) AS size_kb,
      CASE WHEN s < 1024 THEN s || ' B'
        ELSE CAST(CAST(round(s / 1024.0::DOUBLE, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' KB' END
        AS display_size,
      CAST(CASE WHEN o = 0 THEN 0 ELSE floor(abs((o - s) / CAST(o AS DOUBLE) * 100) + 0.5) END
        AS INT) AS savings_pct,
      CASE WHEN o > 0 AND s > 0 THEN round((o - s) / CAST(o AS DOUBLE) * 100, 1) ELSE 0.0 END
        AS preview_savings
    FROM sides""",
)
def savings_columns(spark, sf):
    originals = items(spark, sf).select("asset_id", "original_size")
    original, size = F.col("original_size"), F.col("size")
    return results(spark, sf).join(originals, "asset_id").select(
        "asset_id",
        "format",
        C.size_kb(size).alias("size_kb"),
        C.display_size(size).alias("display_size"),
        C.absolute_savings(original, size).alias("savings_pct"),
        C.signed_savings(original, size).alias("preview_savings"),
    )


@query(
    "clamp_quality",
    f"""SELECT {LINE}, CAST(CASE WHEN l_linenumber < 7 THEN
      least(100, greatest(1, floor(l_extendedprice / 700 - 10 + 0.5))) END AS INT) AS quality
    FROM lineitem""",
)
def clamp_quality(spark, sf):
    wanted = F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice") / 700 - 10)
    return read_table(spark, sf, "lineitem").select(
        *line_keys(), C.clamp_quality(wanted).alias("quality")
    )


@query(
    "lerp_quality",
    f"""SELECT {LINE}, CAST(floor(20 + (80 - 20) * greatest(0.0, least(1.0, p / 100.0::DOUBLE))
        + 0.5) AS INT) AS avif,
      CAST(floor(30 + (95 - 30) * greatest(0.0, least(1.0, p / 100.0::DOUBLE)) + 0.5) AS INT) AS webp
    FROM (SELECT *, l_quantity * 3 - 10 AS p FROM lineitem)""",
)
def lerp_quality(spark, sf):
    percent = F.col("l_quantity") * 3 - 10

    def at(fmt):
        low, high = K.QUALITY_RANGES[fmt]
        return C.lerp_quality(F.lit(low), F.lit(high), percent).alias(fmt)

    return read_table(spark, sf, "lineitem").select(*line_keys(), at("avif"), at("webp"))


SIZE_UNITS = ["KB", "MB", "GB", "B", "kb", ""]


@query(
    "parse_size",
    f"""SELECT asset_id, line, part, text, CASE unit WHEN 'KB' THEN q * 1024.0::DOUBLE
        WHEN 'kb' THEN q * 1024.0::DOUBLE WHEN 'MB' THEN q * 1048576.0::DOUBLE
        WHEN 'GB' THEN q * 1073741824.0::DOUBLE ELSE 0.0::DOUBLE END AS size_bytes
    FROM (SELECT {LINE}, CAST(l_quantity AS INT) AS q,
      {sql_list(SIZE_UNITS)}[l_partkey % 6 + 1] AS unit,
      CAST(l_quantity AS INT) || {sql_list(SIZE_UNITS)}[l_partkey % 6 + 1] AS text FROM lineitem)""",
)
def parse_size(spark, sf):
    unit = F.element_at(
        F.array(*[F.lit(u) for u in SIZE_UNITS]), (F.col("l_partkey") % 6 + 1).cast("int")
    )
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), unit)
    rows = read_table(spark, sf, "lineitem").select(*line_keys(), text.alias("text"))
    return rows.withColumn("size_bytes", C.parse_size(F.col("text")))


@query(
    "error_text",
    "SELECT event_id, CASE WHEN event_type = 'error' OR event_type = 'view' "
    "THEN 'Optimization failed' ELSE event_type END AS message FROM events",
)
def error_text(spark, sf):
    kind = F.col("event_type")
    message = F.when(kind == "error", F.lit("")).when(kind != "view", kind)
    return read_table(spark, sf, "events").select(
        "event_id", C.error_text(message, "Optimization failed").alias("message")
    )
