"""Web pages as vector documents, with thresholds scaled to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..plans.session import read_table
from .base import query

# Pages hold no paths and no data links: class values stand for paths, site links for data links.
METADATA = r"""bare AS (
  SELECT page_id, html AS whole, regexp_replace(html, '<!--.*?-->|<!\[CDATA\[.*?\]\]>', '', 'gs') AS html
  FROM pages),
metadata AS (
  SELECT page_id, whole AS html, CAST(strlen(whole) AS BIGINT) AS size,
    len(regexp_extract_all(html, '<[a-zA-Z]')) AS nodes,
    len(regexp_extract_all(array_to_string(
      regexp_extract_all(html, '\s(?:class|lang)\s*=\s*("[^"]*"|''[^'']*'')', 1), ' '),
      '[a-df-zA-DF-Z]')) AS segments,
    coalesce(list_sum(list_transform(
      regexp_extract_all(html, '\s(?:xlink:)?href\s*=\s*("/[^"]*"|''/[^'']*'')', 1),
      lambda v: length(v) - 2)), 0) AS raster,
    regexp_matches(html, '<(?:script|footer)[\s/>]') AS filters
  FROM bare)"""


def metadata(spark, sf):
    html = F.col("bare")
    pages = read_table(spark, sf, "pages").withColumn("bare", M.without_comments(F.col("html")))
    return pages.select(
        "page_id",
        "html",
        F.octet_length("html").cast("bigint").alias("size"),
        M.node_count(html).alias("nodes"),
        M.segment_count(html, "(?:class|lang)").alias("segments"),
        M.raster_bytes(html, "/").alias("raster"),
        M.has_filters(html, "script|footer").alias("filters"),
    )


@query(
    "markup_metadata",
    f"""WITH {METADATA} SELECT page_id, CAST(nodes AS INT) AS nodes,
      CAST(segments AS INT) AS segments, CAST(raster AS BIGINT) AS raster, filters FROM metadata""",
)
def markup_metadata(spark, sf):
    return metadata(spark, sf).select("page_id", "nodes", "segments", "raster", "filters")


@query(
    "svg_class",
    f"""WITH {METADATA} SELECT page_id, CASE WHEN raster > 45 THEN 'HYBRID'
      WHEN nodes > 40 OR segments > 6 THEN 'COMPLEX' ELSE 'SIMPLE' END AS type FROM metadata""",
)
def svg_class(spark, sf):
    kind = M.svg_class(F.col("raster") - 45, F.col("nodes"), F.col("segments"), 40, 6)
    return metadata(spark, sf).select("page_id", kind.alias("type"))


LIMITS = dict(
    tiny=1500, nodes_max=60, segments_max=8, raster_max=60, raster_hybrid=20, dominance=0.015,
    nodes_anchor=40,
)


@query(
    "representation_decision",
    f"""WITH {METADATA}, flagged AS (SELECT page_id, size < 1500 AS is_tiny,
      nodes > 60 OR segments > 8 AS vector_complex, raster > 60 AS heavy_hybrid,
      raster > 20 AND raster / CAST(greatest(1, size) AS DOUBLE) > 0.015 AS hybrid_dominant,
      raster > 0 AND nodes > 40 AS complexity_anchor FROM metadata),
    decided AS (SELECT *, NOT is_tiny AND (vector_complex OR heavy_hybrid OR hybrid_dominant
      OR complexity_anchor) AS wrap FROM flagged)
    SELECT *, CASE WHEN wrap THEN 'svg (webp-wrapped)' ELSE 'svg (optimized)' END AS label
    FROM decided""",
)
def representation_decision(spark, sf):
    flags = M.representation_flags(
        F.col("size"), F.col("nodes"), F.col("segments"), F.col("raster"), **LIMITS
    )
    rows = metadata(spark, sf).select("page_id", *[c.alias(n) for n, c in flags.items()])
    return rows.withColumn("label", M.representation_label(F.col("wrap")))


WRAPPED = """wrapped AS (
  SELECT page_id, page_id % 900 + 1 AS w, page_id % 700 + 1 AS h,
    ['webp', 'jpeg', 'png'][page_id % 3 + 1] AS fmt, html FROM pages),
texts AS (
  SELECT page_id, html, fmt, '<svg width="' || w || '" height="' || h || '" viewBox="0 0 ' || w ||
    ' ' || h || '" xmlns="http://www.w3.org/2000/svg">' || chr(10) ||
    '  <image href="data:image/' || fmt || ';base64,' || to_base64(encode(html)) || '" width="' ||
    w || '" height="' || h || '" />' || chr(10) || '</svg>' AS wrapper FROM wrapped)"""


def wrapped(spark, sf):
    fmt = F.element_at(
        F.array(F.lit("webp"), F.lit("jpeg"), F.lit("png")), (F.col("page_id") % 3 + 1).cast("int")
    )
    wrapper = M.wrap_markup(
        F.col("page_id") % 900 + 1, F.col("page_id") % 700 + 1, fmt, F.encode("html", "UTF-8")
    )
    return read_table(spark, sf, "pages").select("page_id", wrapper.alias("wrapper"))


@query("wrap_markup", f"WITH {WRAPPED} SELECT page_id, wrapper FROM texts")
def wrap_markup(spark, sf):
    return wrapped(spark, sf)


@query(
    "extract_embedded",
    f"WITH {WRAPPED} SELECT page_id, fmt AS type, html AS payload FROM texts",
)
def extract_embedded(spark, sf):
    text = F.col("wrapper")
    return wrapped(spark, sf).select(
        "page_id",
        M.embedded_type(text).alias("type"),
        F.decode(M.embedded_bytes(text), "UTF-8").alias("payload"),
    )


@query(
    "root_dimensions",
    r"""SELECT page_id, regexp_replace(html, '<html([^>]*)>',
      '<html width="' || (page_id % 900 + 1) || '" height="' || (page_id % 700 + 1) || '"\1>')
      AS html FROM (SELECT page_id, regexp_replace(html, '<html +', '<html ') AS html FROM pages)""",
)
def root_dimensions(spark, sf):
    changed = M.root_dimensions(
        F.col("html"), F.col("page_id") % 900 + 1, F.col("page_id") % 700 + 1, "html"
    )
    return read_table(spark, sf, "pages").select("page_id", changed.alias("html"))
