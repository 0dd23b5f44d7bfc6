"""Gates over pairs, and size ceilings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G, stats
from ..plans.session import read_table
from ..sources import configs
from .base import pairs, query
from .pixels import EDGES, PIXELS, SSIM, grey_lines, rgba_lines

OUT_FORMATS = ["webp", "png", "jpg", "gif"]
#: The same names occur in every batch of so many images.
BATCH_IMAGES = 50
PAIR_SQL = f"""named AS (
  SELECT a.vec_id // {BATCH_IMAGES} AS batch_id, a.vec_id AS original_id, b.vec_id AS output_id,
    'photo' || (a.vec_id % {BATCH_IMAGES}) AS base,
    'photo' || (a.vec_id % {BATCH_IMAGES}) || '.png' AS original_name,
    ['webp', 'png', 'jpg', 'gif'][b.vec_id % 4 + 1] AS format
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE b.vec_id % 4 <> 3)"""


def paired(spark, sf):
    """Originals photo<n>.png; outputs carry batch and name of the image before them."""
    ids = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"))
    fmt = F.element_at(
        F.array(*[F.lit(f) for f in OUT_FORMATS]), (F.col("asset_id") % 4 + 1).cast("int")
    )

    def named(before, extension):
        number = F.col("asset_id") - before
        name = F.concat(
            F.lit("photo"), F.pmod(number, F.lit(BATCH_IMAGES)).cast("string"), F.lit("."), extension
        )
        return ids.select("asset_id", F.floor(number / BATCH_IMAGES).alias("batch_id"), name.alias("name"))

    return G.pair_outputs(named(0, F.lit("png")), named(1, fmt))


@query(
    "pair_outputs",
    f"WITH {PAIR_SQL} SELECT batch_id, base, original_id, output_id, format FROM named",
)
def pair_outputs(spark, sf):
    return paired(spark, sf).select("batch_id", "base", "original_id", "output_id", "format")


# Thresholds and baselines from labels and parts, through the same JSON as configuration files.

THRESHOLDS_SQL = """threshold_rows AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'photo' || p_partkey ELSE 'photo' || p_partkey || '.png'
      END AS file, NULL AS format, 0.5 + p_size / 200.0::DOUBLE AS ssim_min,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE 10.0 + p_size / 10.0::DOUBLE END AS psnr_min
  FROM part
  UNION ALL
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'photo' || p_partkey ELSE 'photo' || p_partkey || '.png'
      END, 'webp', 0.3 + p_size / 200.0::DOUBLE, NULL
  FROM part)"""


def threshold_texts(spark, sf):
    """One commented JSON text per part, in the layout of a threshold file."""
    part = read_table(spark, sf, "part")
    name = F.concat(
        F.lit("photo"), F.col("p_partkey").cast("string"),
        F.when(F.col("p_partkey") % 2 == 0, "").otherwise(".png"),
    )
    size = F.col("p_size")
    psnr = F.when(size % 3 == 0, "").otherwise(
        F.concat(F.lit(', "psnrMin": '), (10.0 + size / 10.0).cast("string"))
    )
    text = F.concat(
        F.lit('{ // limits\n "_comment": "x", "'), name, F.lit('": {"ssimMin": '),
        (0.5 + size / 200.0).cast("string"), psnr,
        F.lit(', "formats": {"webp": {"ssimMin": '), (0.3 + size / 200.0).cast("string"),
        F.lit("}}} /* end */ }"),
    )
    return part.select(text.alias("value"))


@query(
    "load_thresholds",
    f"WITH {THRESHOLDS_SQL} SELECT file, format, round(ssim_min, 6) AS ssim_min, "
    "round(psnr_min, 6) AS psnr_min FROM threshold_rows",
)
def load_thresholds(spark, sf):
    return configs.thresholds_from(threshold_texts(spark, sf)).select(
        "file", "format", F.round("ssim_min", 6).alias("ssim_min"),
        F.round("psnr_min", 6).alias("psnr_min"),
    )


RESOLVED_SQL = f"""{PAIR_SQL}, {THRESHOLDS_SQL},
keyed AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM threshold_rows t
    WHERE t.file = n.original_name) THEN original_name ELSE base END AS threshold_file FROM named n),
resolved AS (
  SELECT k.original_id, k.output_id, k.format,
    coalesce(f.ssim_min, w.ssim_min, 0.98) AS ssim_min,
    coalesce(f.psnr_min, w.psnr_min, 30.0) AS psnr_min
  FROM keyed k
  LEFT JOIN threshold_rows w ON w.file = k.threshold_file AND w.format IS NULL
  LEFT JOIN threshold_rows f ON f.file = k.threshold_file AND f.format = k.format)"""


def resolved(spark, sf):
    return G.resolve_thresholds(
        paired(spark, sf), configs.thresholds_from(threshold_texts(spark, sf))
    )


@query(
    "resolve_thresholds",
    f"WITH {RESOLVED_SQL} SELECT original_id, format, round(ssim_min, 6) AS ssim_min, "
    "round(psnr_min, 6) AS psnr_min FROM resolved",
)
def resolve_thresholds(spark, sf):
    return resolved(spark, sf).select(
        "original_id", "format", F.round("ssim_min", 6).alias("ssim_min"),
        F.round("psnr_min", 6).alias("psnr_min"),
    )


MEASURED_SQL = f"""{RESOLVED_SQL}, {PIXELS},
colours AS (SELECT asset_id, count(DISTINCT (r, g, b)) AS colours, bool_or(a < 255) AS has_alpha
  FROM pixels GROUP BY asset_id),
flat AS (SELECT asset_id, p, r, g, b, a,
    CAST(floor(r * (a / 255.0::DOUBLE) + 0.5) AS INT) AS fr,
    CAST(floor(g * (a / 255.0::DOUBLE) + 0.5) AS INT) AS fg,
    CAST(floor(b * (a / 255.0::DOUBLE) + 0.5) AS INT) AS fb FROM pixels),
compared AS (
  SELECT v.original_id, v.format, ssim_min, psnr_min,
    CASE WHEN v.format = 'jpg' THEN o.fr ELSE o.r END AS r1,
    CASE WHEN v.format = 'jpg' THEN o.fg ELSE o.g END AS g1,
    CASE WHEN v.format = 'jpg' THEN o.fb ELSE o.b END AS b1,
    CASE WHEN v.format = 'jpg' THEN 255 ELSE o.a END AS a1,
    n.r AS r2, n.g AS g2, n.b AS b2, n.a AS a2
  FROM resolved v JOIN flat o ON o.asset_id = v.original_id
  JOIN flat n ON n.asset_id = v.output_id AND n.p = o.p),
grey AS (SELECT *, 0.299::DOUBLE * r1 + 0.587::DOUBLE * g1 + 0.114::DOUBLE * b1 AS p,
  0.299::DOUBLE * r2 + 0.587::DOUBLE * g2 + 0.114::DOUBLE * b2 AS q,
  (r1 - r2) * (r1 - r2) + (g1 - g2) * (g1 - g2) + (b1 - b2) * (b1 - b2) + (a1 - a2) * (a1 - a2)
    AS sq FROM compared),
measured AS (
  SELECT original_id, format, any_value(ssim_min) AS ssim_min, any_value(psnr_min) AS psnr_min,
    {SSIM} AS ssim,
    round(10 * log10(65025.0::DOUBLE / CASE WHEN sum(sq) = 0 THEN 1e-10
      ELSE sum(sq) / CAST(count(*) * 4 AS DOUBLE) END), 6) AS psnr
  FROM grey GROUP BY original_id, format),
gated AS (
  SELECT m.original_id, m.format, ssim, psnr, CASE WHEN has_alpha AND format = 'webp'
      THEN least(ssim_min, 0.80) ELSE ssim_min END AS ssim_min,
    CASE WHEN has_alpha AND format = 'webp' THEN least(psnr_min, 19.0) ELSE psnr_min END AS psnr_min
  FROM measured m JOIN colours c ON c.asset_id = m.original_id)"""


def gated(spark, sf, outputs=None):
    plan = resolved(spark, sf).select(
        F.col("output_id").alias("pair_id"), "original_id", "output_id", "format", "ssim_min",
        "psnr_min",
    )
    lines = rgba_lines(spark, sf)
    return G.raster_gate(G.measure_pairs(plan, lines, lines if outputs is None else outputs, window=4))


@query(
    "raster_gate",
    f"WITH {MEASURED_SQL} SELECT original_id, format, ssim, psnr, round(ssim_min, 6) AS ssim_min, "
    "round(psnr_min, 6) AS psnr_min, ssim >= ssim_min AND psnr >= psnr_min AS passed FROM gated",
)
def raster_gate(spark, sf):
    return gated(spark, sf).select(
        "original_id", "format", "ssim", "psnr", F.round("ssim_min", 6).alias("ssim_min"),
        F.round("psnr_min", 6).alias("psnr_min"), "passed",
    )


@query(
    "gate_summary",
    f"""WITH {MEASURED_SQL} SELECT format, count(*) AS pairs,
      count(*) FILTER (NOT (ssim >= ssim_min AND psnr >= psnr_min)) AS failures,
      CASE WHEN count(*) FILTER (NOT (ssim >= ssim_min AND psnr >= psnr_min)) > 0 THEN 'failed'
        ELSE 'passed' END AS verdict
    FROM gated GROUP BY format""",
)
def gate_summary(spark, sf):
    return G.gate_summary(gated(spark, sf), ["format"])


READABLE = "output_id % 7 <> 3"


@query(
    "raster_gate_unreadable",
    f"""WITH {MEASURED_SQL}, every AS (
      SELECT r.original_id, r.format, {READABLE} AS readable,
        ssim >= g.ssim_min AND psnr >= g.psnr_min AS good
      FROM resolved r JOIN gated g ON g.original_id = r.original_id AND g.format = r.format)
    SELECT original_id, format, readable AND good AS passed,
      CASE WHEN NOT readable THEN 'original or output could not be read' END AS error FROM every""",
)
def raster_gate_unreadable(spark, sf):
    """Some outputs have no pixels: their pairs must fail."""
    outputs = rgba_lines(spark, sf).filter(READABLE.replace("output_id", "asset_id"))
    return gated(spark, sf, outputs).select("original_id", "format", "passed", "error")


def vector_gated(spark, sf, outputs=None):
    lines = grey_lines(spark, sf)
    measured = G.measure_vector_pairs(
        pairs(spark, sf), lines, lines if outputs is None else outputs
    )
    return G.svg_gate(measured.select("pair_id", "ssim", "sharpness_ratio"), ssim_min=0.1)


VECTOR_SQL = f"""{EDGES}, sides AS (SELECT o.asset_id AS pair_id, o.i, o.v AS p, n.v AS q
      FROM samples o JOIN samples n ON n.asset_id = o.asset_id + 1 AND n.i = o.i),
    s AS (SELECT pair_id, {SSIM} AS ssim FROM sides GROUP BY pair_id),
    r AS (SELECT asset_id, round(energy, 6) AS e FROM edges),
    vector AS (SELECT s.pair_id, ssim, round(n.e / o.e, 6) AS sharpness_ratio
      FROM s JOIN r o ON o.asset_id = pair_id JOIN r n ON n.asset_id = pair_id + 1)"""


@query(
    "svg_gate",
    f"""WITH {VECTOR_SQL} SELECT pair_id, ssim, sharpness_ratio,
      ssim >= 0.1 AND sharpness_ratio >= 1.08 AS passed FROM vector""",
)
def svg_gate(spark, sf):
    return vector_gated(spark, sf).drop("error")


@query(
    "svg_gate_unreadable",
    f"""WITH {VECTOR_SQL}, every AS (
      SELECT pair_id, (pair_id + 1) % 7 <> 3 AS readable, ssim, sharpness_ratio FROM vector)
    SELECT pair_id, CASE WHEN readable THEN ssim END AS ssim,
      CASE WHEN readable THEN sharpness_ratio END AS sharpness_ratio,
      readable AND ssim >= 0.1 AND sharpness_ratio >= 1.08 AS passed,
      CASE WHEN NOT readable THEN 'original or output could not be read' END AS error FROM every""",
)
def svg_gate_unreadable(spark, sf):
    return vector_gated(spark, sf, grey_lines(spark, sf).filter("asset_id % 7 <> 3"))


# Size ceilings --------------------------------------------------------------------------------

BASELINES_SQL = """baseline_rows AS (
  SELECT 'part' || p_partkey AS file, 'webp' AS format, p_size * 1024.0::DOUBLE AS size_bytes
    FROM part WHERE p_partkey % 4 < 2
  UNION ALL SELECT 'part' || p_partkey, 'avif', 0.0 FROM part WHERE p_partkey % 4 < 2
  UNION ALL SELECT 'part' || p_partkey, 'svg', p_size * 1048576.0::DOUBLE FROM part
    WHERE p_partkey % 4 >= 2)"""


def baseline_texts(spark, sf):
    part = read_table(spark, sf, "part")
    name = F.concat(F.lit('{ // ceilings\n "part'), F.col("p_partkey").cast("string"), F.lit('": '))
    size = F.col("p_size").cast("string")
    many = F.concat(F.lit('{"webp": "'), size, F.lit('KB", "avif": "'), size, F.lit('B"}'))
    one = F.concat(F.lit('"'), size, F.lit('MB"'))
    body = F.when(F.col("p_partkey") % 4 < 2, many).otherwise(one)
    return part.select(F.concat(name, body, F.lit(" }")).alias("value"))


@query(
    "load_baselines",
    f"WITH {BASELINES_SQL} SELECT file, format, size_bytes FROM baseline_rows",
)
def load_baselines(spark, sf):
    return configs.baselines_from(baseline_texts(spark, sf))


SHIPPED = """shipped AS (
  SELECT l_orderkey AS result_id, l_linenumber AS line, 'part' || l_partkey AS file,
    CASE l_returnflag WHEN 'A' THEN 'webp' WHEN 'N' THEN 'avif' ELSE 'svg' END AS format,
    CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem)"""


@query(
    "size_gate",
    f"""WITH {SHIPPED}, {BASELINES_SQL},
    tolerances AS (SELECT 'part' || s_suppkey AS file, 'webp' AS format,
      1.0 + s_nationkey / 50.0::DOUBLE AS tolerance FROM supplier)
    SELECT result_id, line, s.file, s.format, size,
      round(size_bytes * coalesce(tolerance, 1.10), 2) AS ceiling,
      CASE WHEN coalesce(size_bytes <= 0, true) THEN 'skipped'
        WHEN round(size / 1024.0::DOUBLE, 1) * 1024 <= size_bytes * coalesce(tolerance, 1.10)
        THEN 'pass' ELSE 'fail' END AS verdict
    FROM shipped s LEFT JOIN baseline_rows b ON b.file = s.file AND b.format = s.format
    LEFT JOIN tolerances t ON t.file = s.file AND t.format = s.format""",
)
def size_gate(spark, sf):
    fmt = F.when(F.col("l_returnflag") == "A", "webp").when(F.col("l_returnflag") == "N", "avif")
    shipped = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("result_id"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("file"),
        fmt.otherwise("svg").alias("format"),
        F.floor("l_extendedprice").alias("size"),
    )
    overrides = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("part"), F.col("s_suppkey").cast("string")).alias("file"),
        F.lit("webp").alias("format"),
        (1.0 + F.col("s_nationkey") / 50.0).alias("tolerance"),
    )
    return G.size_gate(shipped, configs.baselines_from(baseline_texts(spark, sf)), overrides)


# Timings ------------------------------------------------------------------------------------------

@query(
    "stage_timing",
    """WITH marks AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, epoch_us(ts) // 1000 AS ms
      FROM events),
    wide AS (SELECT user_id, day, min(ms) FILTER (event_type = 'signup') AS t0,
      min(ms) FILTER (event_type = 'view') AS t1, min(ms) FILTER (event_type = 'click') AS t2,
      min(ms) FILTER (event_type = 'purchase') AS t3
      FROM marks WHERE event_type <> 'error' GROUP BY ALL)
    SELECT user_id, day, CAST(t1 - coalesce(t0, 0) AS BIGINT) AS decode_ms,
      CAST(t2 - t1 AS BIGINT) AS classify_ms, CAST(t3 - t2 AS BIGINT) AS encode_ms FROM wide""",
)
def stage_timing(spark, sf):
    rows = read_table(spark, sf, "events")
    at_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    marks = rows.select("user_id", F.to_date("ts").alias("day"),
                        F.col("event_type").alias("mark"), at_ms.alias("at_ms"))
    return stats.stage_timing(marks, ["user_id", "day"], ("signup", "view", "click", "purchase"))


@query(
    "benchmark_summary",
    """SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS fast_avg,
      round(avg(value) FILTER (event_type = 'purchase'), 6) AS slow_avg,
      round(avg(value) FILTER (event_type = 'purchase') / nullif(avg(value)
        FILTER (event_type = 'click'), 0), 6) AS speedup
    FROM events GROUP BY user_id""",
)
def benchmark_summary(spark, sf):
    runs = read_table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("variant"), F.col("value").alias("elapsed")
    )
    return stats.benchmark_summary(runs, ("click", "purchase"), ["user_id"])
