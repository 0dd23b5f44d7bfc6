"""Embeddings as small images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import intake, pixels as P
from .base import PIXELS, SAMPLES, grids, pairs, query

LUMA = "least(255, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5))"


def rgba_lines(spark, sf):
    return P.grid_lines(grids(spark, sf, 4))


def rgba_pixels(spark, sf):
    return P.explode_pixels(rgba_lines(spark, sf))


@query("explode_pixels", f"WITH {PIXELS} SELECT asset_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, g, b, a FROM pixels")
def explode_pixels(spark, sf):
    return rgba_pixels(spark, sf).select("asset_id", "x", "y", "r", "g", "b", "a")


@query(
    "unique_colors",
    f"WITH {PIXELS} SELECT asset_id, count(DISTINCT (r, g, b)) AS unique_colors FROM pixels "
    "GROUP BY asset_id",
)
def unique_colors(spark, sf):
    return P.line_colors(rgba_lines(spark, sf))


@query(
    "unique_colors_exploded",
    f"WITH {PIXELS} SELECT asset_id, count(DISTINCT (r, g, b)) AS unique_colors FROM pixels "
    "GROUP BY asset_id",
)
def unique_colors_exploded(spark, sf):
    """From pixels that are rows already."""
    return P.unique_colors(rgba_pixels(spark, sf))


HISTOGRAM = f"""{PIXELS}, histogram AS (
  SELECT asset_id, CAST({LUMA} AS INT) AS luma, count(*) AS n FROM pixels GROUP BY ALL)"""
ENTROPY = f"""{HISTOGRAM}, entropies AS (
  SELECT h.asset_id, round(abs(-sum(n / total * log2(n / total))), 6) AS entropy
  FROM histogram h JOIN (SELECT asset_id, CAST(sum(n) AS DOUBLE) AS total FROM histogram
    GROUP BY asset_id) t ON t.asset_id = h.asset_id GROUP BY h.asset_id)"""


@query("luma_histogram", f"WITH {HISTOGRAM} SELECT asset_id, luma, n FROM histogram")
def luma_histogram(spark, sf):
    return P.luma_histogram(rgba_pixels(spark, sf))


@query("luma_entropy", f"WITH {ENTROPY} SELECT asset_id, entropy FROM entropies")
def luma_entropy(spark, sf):
    return P.luma_entropy(rgba_pixels(spark, sf))


@query(
    "transparency",
    f"WITH {PIXELS} SELECT asset_id, bool_or(a < 140) AS has_alpha, bool_or(a < 140) AND "
    "count(*) < 800000 AS small_transparent FROM pixels GROUP BY asset_id",
)
def transparency(spark, sf):
    # Byte values lie around 127: lift them so that both outcomes occur.
    lifted = rgba_pixels(spark, sf).withColumn("a", F.least(F.lit(255), F.col("a") + 115))
    return P.transparency(lifted)


@query(
    "classify_content",
    f"""WITH {ENTROPY}, colours AS (
      SELECT asset_id, count(DISTINCT (r, g, b)) AS unique_colors FROM pixels GROUP BY asset_id)
    SELECT c.asset_id, unique_colors, entropy,
      CASE WHEN unique_colors < 17 AND entropy < 3.7 THEN 'graphic' ELSE 'photo' END AS preset
    FROM colours c JOIN entropies e ON e.asset_id = c.asset_id""",
)
def classify_content(spark, sf):
    return P.classify_content(rgba_lines(spark, sf), small_px=10, colours=17, entropy=3.7).select(
        "asset_id", "unique_colors", "entropy", "preset"
    )


@query(
    "stride_sample",
    f"WITH {PIXELS} SELECT asset_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r FROM pixels "
    "WHERE (y * 4 + x) % 3 = 0",
)
def stride_sample(spark, sf):
    return P.explode_pixels(rgba_lines(spark, sf), cap=6).select("asset_id", "x", "y", "r")


def sql_flat(c: str) -> str:
    return f"CAST(floor({c} * (a / 255.0::DOUBLE) + 255 * (1 - a / 255.0::DOUBLE) + 0.5) AS INT)"


@query(
    "alpha_composite",
    f"WITH {PIXELS} SELECT asset_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {sql_flat('r')} AS r, {sql_flat('g')} AS g, "
    f"{sql_flat('b')} AS b, 255 AS a FROM pixels",
)
def alpha_composite(spark, sf):
    return P.alpha_composite(rgba_pixels(spark, sf), (255, 255, 255)).select(
        "asset_id", "x", "y", "r", "g", "b", "a"
    )


def grey_lines(spark, sf):
    return P.grid_lines(grids(spark, sf))


RESAMPLED = f"""{SAMPLES},
cells AS (SELECT asset_id, i % 8 AS x, i // 8 AS y, v FROM samples),
targets AS (
  SELECT ox, oy, CAST(floor(ox * 8 / 3.0::DOUBLE) AS INT) AS x0,
    CAST(floor(oy * 8 / 3.0::DOUBLE) AS INT) AS y0,
    ox * (8 / 3.0::DOUBLE) - floor(ox * (8 / 3.0::DOUBLE)) AS fx,
    oy * (8 / 3.0::DOUBLE) - floor(oy * (8 / 3.0::DOUBLE)) AS fy
  FROM range(3) AS a(ox), range(3) AS b(oy)),
resampled AS (
  SELECT asset_id, ox, oy, round(sum(v
    * CASE WHEN x = x0 THEN 1 - fx ELSE fx END * CASE WHEN y = y0 THEN 1 - fy ELSE fy END), 6) AS v
  FROM cells JOIN targets ON x IN (x0, least(x0 + 1, 7)) AND y IN (y0, least(y0 + 1, 7))
  GROUP BY asset_id, ox, oy)"""


@query(
    "grid_resample",
    f"WITH {RESAMPLED} SELECT asset_id, CAST(ox AS INT) AS x, CAST(oy AS INT) AS y, v FROM resampled",
)
def grid_resample(spark, sf):
    small = P.grid_resample(grey_lines(spark, sf), 3, 3)
    return small.select(
        "asset_id", "y", F.posexplode("samples").alias("x", "v")
    ).withColumn("v", F.round("v", 6))


@query(
    "dimension_invariant",
    f"""SELECT vec_id AS asset_id, CASE WHEN vec_id % 2 = 0 THEN
      'SVG dimension invariant failed at post-raster: expected 3x4, got 3x3' END AS error
    FROM embeddings""",
)
def dimension_invariant(spark, sf):
    """Resampled sizes against expected ones that are wrong for even ids."""
    small = P.grid_resample(grey_lines(spark, sf), 3, 3).filter("y = 0")
    odd = F.col("asset_id") % 2
    expected = grids(spark, sf).select("asset_id", F.lit(3).alias("width"),
                                       (4 - odd).cast("int").alias("height"))
    return intake.dimension_invariant(small, expected, "post-raster").select("asset_id", "error")


EDGES = f"""{SAMPLES},
cells AS (SELECT asset_id, i % 8 AS x, i // 8 AS y, v FROM samples),
near AS (
  SELECT c.asset_id, c.x, c.y,
    sum(n.v * (n.x - c.x) * CASE WHEN n.y = c.y THEN 2 ELSE 1 END) AS gx,
    sum(n.v * (n.y - c.y) * CASE WHEN n.x = c.x THEN 2 ELSE 1 END) AS gy
  FROM cells c JOIN cells n ON n.asset_id = c.asset_id
    AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1
  WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6 GROUP BY ALL),
edges AS (SELECT asset_id, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS energy FROM near
  GROUP BY asset_id)"""


@query(
    "edge_energy",
    f"WITH {EDGES} SELECT asset_id, round(energy, 6) AS edge_energy FROM edges",
)
def edge_energy(spark, sf):
    return P.edge_energy(grey_lines(spark, sf))


@query(
    "sharpness_ratio",
    f"""WITH {EDGES}, r AS (SELECT asset_id, round(energy, 6) AS e FROM edges)
    SELECT a.asset_id AS pair_id, round(b.e / a.e, 6) AS sharpness_ratio
    FROM r a JOIN r b ON b.asset_id = a.asset_id + 1""",
)
def sharpness_ratio(spark, sf):
    energy = P.edge_energy(grey_lines(spark, sf))
    return P.sharpness_ratio(pairs(spark, sf), energy, energy)


PAIRED = f"""{SAMPLES}, sides AS (SELECT o.asset_id AS pair_id, o.i, o.v AS p, n.v AS q
  FROM samples o JOIN samples n ON n.asset_id = o.asset_id + 1 AND n.i = o.i)"""
PSNR = """round(10 * log10(65025.0::DOUBLE / CASE WHEN sum((p - q) * (p - q)) = 0 THEN 1e-10
  ELSE sum((p - q) * (p - q)) / CAST(count(*) AS DOUBLE) END), 6)"""
SSIM = f"""round((2 * avg(p) * avg(q) + {(0.01 * 255) ** 2!r}::DOUBLE)
  * (2 * covar_pop(p, q) + {(0.03 * 255) ** 2!r}::DOUBLE)
  / ((avg(p) * avg(p) + avg(q) * avg(q) + {(0.01 * 255) ** 2!r}::DOUBLE)
  * (var_pop(p) + var_pop(q) + {(0.03 * 255) ** 2!r}::DOUBLE)), 6)"""


def grey_pairs(spark, sf):
    lines = grey_lines(spark, sf)
    return P.pair_lines(P.fitted_outputs(pairs(spark, sf), lines, lines), lines)


@query("psnr", f"WITH {PAIRED} SELECT pair_id, {PSNR} AS psnr FROM sides GROUP BY pair_id")
def psnr(spark, sf):
    return P.psnr(grey_pairs(spark, sf))


@query("ssim", f"WITH {PAIRED} SELECT pair_id, {SSIM} AS ssim FROM sides GROUP BY pair_id")
def ssim(spark, sf):
    return P.ssim(grey_pairs(spark, sf))


@query(
    "fitted_outputs",
    f"""WITH {SAMPLES} SELECT asset_id - 1 AS pair_id, CAST(i // 8 AS INT) AS y,
      string_agg(v, ',' ORDER BY i) AS samples FROM samples WHERE asset_id > 0
    GROUP BY asset_id, i // 8""",
)
def fitted_outputs(spark, sf):
    """The general path on outputs of the right size, which must come through unchanged."""
    lines = grey_lines(spark, sf)
    return P.fitted_outputs(pairs(spark, sf), lines, lines).select(
        "pair_id", "y", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples")
    )


@query(
    "fitted_outputs_resized",
    f"""WITH {RESAMPLED}, small AS (
      SELECT asset_id, ox, oy, CAST(floor(v + 0.5) AS INT) AS v FROM resampled),
    back AS (
      SELECT tx, ty, CAST(floor(tx * 3 / 8.0::DOUBLE) AS INT) AS x0,
        CAST(floor(ty * 3 / 8.0::DOUBLE) AS INT) AS y0,
        tx * (3 / 8.0::DOUBLE) - floor(tx * (3 / 8.0::DOUBLE)) AS fx,
        ty * (3 / 8.0::DOUBLE) - floor(ty * (3 / 8.0::DOUBLE)) AS fy
      FROM range(8) AS a(tx), range(8) AS b(ty)),
    near AS (
      SELECT asset_id, tx, ty, v * (CASE WHEN ox = x0 THEN 1 - fx ELSE 0 END
          + CASE WHEN ox = least(x0 + 1, 2) THEN fx ELSE 0 END)
        * (CASE WHEN oy = y0 THEN 1 - fy ELSE 0 END
          + CASE WHEN oy = least(y0 + 1, 2) THEN fy ELSE 0 END) AS part
      FROM small JOIN back ON ox IN (x0, least(x0 + 1, 2)) AND oy IN (y0, least(y0 + 1, 2)))
    SELECT asset_id - 1 AS pair_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y,
      CAST(floor(round(sum(part), 6) + 0.5) AS INT) AS v
    FROM near WHERE asset_id > 0 GROUP BY asset_id, tx, ty""",
)
def fitted_outputs_resized(spark, sf):
    """Outputs of three by three pixels, brought back to the eight by eight of their originals."""
    lines = grey_lines(spark, sf)
    small = P.grid_resample(lines, 3, 3).withColumn(
        "samples", F.transform("samples", lambda v: P.half_up(F.round(v, 6)).cast("int"))
    )
    return P.fitted_outputs(pairs(spark, sf), lines, small).select(
        "pair_id", "y", F.posexplode("samples").alias("x", "v")
    )


@query(
    "ssim_tiles",
    f"""WITH {PAIRED}, tiles AS (SELECT pair_id, {SSIM.replace(', 6)', ', 15)')} AS s FROM sides
      GROUP BY pair_id, i // 32, (i % 8) // 4)
    SELECT pair_id, round(avg(s), 6) AS ssim FROM tiles GROUP BY pair_id""",
)
def ssim_tiles(spark, sf):
    """Four 4x4 tiles per image."""
    return P.ssim(grey_pairs(spark, sf), window=4)
