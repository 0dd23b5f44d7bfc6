"""Stand-ins for asset tables, built from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..operators.tasks import latest_result
from ..plans.session import read_table, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        def shipped(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf)

        QUERIES[name] = shipped
        if sql:
            ORACLE[name] = sql
        return run

    return register


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Orders as queue items ---------------------------------------------------------------------

ITEM_FORMATS = ["jpg", "png", "webp", "svg", "avif"]


def items(spark: SparkSession, sf: str) -> DataFrame:
    extension = pick(ITEM_FORMATS, F.col("o_custkey") % 5)
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        F.col("o_orderpriority").alias("batch_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("img-"), (F.col("o_custkey") % 100).cast("string"), F.lit("."), extension)
        .alias("name"),
        extension.alias("original_format"),
        F.floor("o_totalprice").alias("original_size"),
        F.when(F.col("o_orderstatus") == "P", K.PROCESSING).otherwise(K.PENDING).alias("status"),
        F.lit(0).alias("progress"),
    )


ITEMS = f"""items AS (
  SELECT o_orderkey AS asset_id, o_orderpriority AS batch_id, o_orderkey AS ordinal,
    'img-' || (o_custkey % 100) || '.' || {sql_list(ITEM_FORMATS)}[o_custkey % 5 + 1] AS name,
    {sql_list(ITEM_FORMATS)}[o_custkey % 5 + 1] AS original_format,
    CAST(floor(o_totalprice) AS BIGINT) AS original_size,
    CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'pending' END AS status,
    0 AS progress
  FROM orders)"""


# Lineitems as reports about results ----------------------------------------------------------

REPORT_ORDER = ["shipped", "line", "part", "supp", "size"]


def reports(spark: SparkSession, sf: str) -> DataFrame:
    status = (
        F.when(F.col("l_linestatus") == "F", K.SUCCESS)
        .when(F.col("l_linenumber") == 1, K.ERROR)
        .otherwise(K.PENDING)
    )
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        F.when(F.col("l_returnflag") == "A", "webp").when(F.col("l_returnflag") == "N", "avif")
        .otherwise("png").alias("format"),
        F.floor("l_extendedprice").alias("size"),
        status.alias("status"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


REPORTS = """reports AS (
  SELECT l_orderkey AS asset_id,
    CASE l_returnflag WHEN 'A' THEN 'webp' WHEN 'N' THEN 'avif' ELSE 'png' END AS format,
    CAST(floor(l_extendedprice) AS BIGINT) AS size,
    CASE WHEN l_linestatus = 'F' THEN 'success' WHEN l_linenumber = 1 THEN 'error'
         ELSE 'pending' END AS status,
    l_shipdate AS shipped, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp
  FROM lineitem)"""

LAST = "shipped DESC, line DESC, part DESC, supp DESC, size DESC"


def results(spark: SparkSession, sf: str) -> DataFrame:
    return latest_result(reports(spark, sf), REPORT_ORDER).select(
        "asset_id", "format", "status", "size"
    )


RESULTS = f"""{REPORTS},
results AS (
  SELECT asset_id, format, status, size FROM reports
  QUALIFY row_number() OVER (PARTITION BY asset_id, format ORDER BY {LAST}) = 1)"""


# Documents as asset files ----------------------------------------------------------------------

EXTENSIONS = [
    "png", "jpg", "jpeg", "webp", "avif", "svg", "gif", "heic", "zip", "PNG", "txt", "tiff",
    "jxl", "bmp",
]
HEADERS = [
    "89504E470D0A1A0A0000000D", "FFD8FFE000104A4649460001", "524946460000000057454250",
    "0000001C667479706176696600", "3C7376672F3E", "EFBBBF3C737667", "00",
]
DOC_LIMIT = 20_000


def assets(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    doc = F.col("doc_id")
    header = pick(HEADERS, F.floor(doc / 14) % 7)
    columns = [
        doc.alias("asset_id"),
        F.col("source").alias("batch_id"),
        doc.alias("ordinal"),
        F.concat("source", F.lit("-"), doc.cast("string"), F.lit("."), pick(EXTENSIONS, doc % 14))
        .alias("name"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.concat(F.unhex(header), F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("content"),
        "lang",
    ]
    return read_table(spark, sf, "documents").select(*columns, *(["text"] if text else []))


ASSETS = f"""assets AS (
  SELECT doc_id AS asset_id, source AS batch_id, doc_id AS ordinal,
    source || '-' || doc_id || '.' || {sql_list(EXTENSIONS)}[doc_id % 14 + 1] AS name,
    lower({sql_list(EXTENSIONS)}[doc_id % 14 + 1]) AS extension,
    CAST(strlen(text) AS BIGINT) AS size,
    {sql_list(HEADERS)}[(doc_id // 14) % 7 + 1] || hex(encode(coalesce(text, ''))) AS header,
    text, lang
  FROM documents)"""

SUPPORTED = "extension IN (" + ", ".join(f"'{e}'" for e in K.INPUT_EXTENSIONS) + ")"

MAGIC = """coalesce(CASE
    WHEN extension = 'png' THEN starts_with(header, '89504E470D0A1A0A')
    WHEN extension IN ('jpg', 'jpeg') THEN starts_with(header, 'FFD8FF')
    WHEN extension = 'webp' THEN starts_with(header, '52494646') AND header[17:24] = '57454250'
    WHEN extension = 'avif' THEN header[9:16] = '66747970' AND length(header) >= 24
    WHEN extension = 'svg' THEN (starts_with(header, '3C') AND length(header) >= 4)
      OR starts_with(header, 'EFBBBF') END, false)"""

MIME = (
    "CASE extension "
    + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in K.MIME_BY_EXTENSION.items())
    + f" ELSE '{K.DEFAULT_MIME}' END"
)


# Embeddings as small images --------------------------------------------------------------------

def sample_bytes() -> Column:
    return F.transform(
        "embedding",
        lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5)))
        .cast("int"),
    )


def grids(spark: SparkSession, sf: str, channels: int = 1) -> DataFrame:
    """8x8 grey images (channels=1) or 4x4 RGBA images (channels=4)."""
    side = 8 if channels == 1 else 4
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("asset_id"),
        F.lit(side).alias("width"),
        F.lit(side).alias("height"),
        F.lit(channels).alias("channels"),
        sample_bytes().alias("samples"),
    )


SAMPLES = """samples AS (
  SELECT vec_id AS asset_id, i AS i,
    CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5))) AS INT) AS v
  FROM embeddings, range(64) AS t(i))"""

PIXELS = f"""{SAMPLES},
pixels AS (
  SELECT asset_id, i // 4 AS p, (i // 4) % 4 AS x, (i // 4) // 4 AS y,
    max(CASE WHEN i % 4 = 0 THEN v END) AS r, max(CASE WHEN i % 4 = 1 THEN v END) AS g,
    max(CASE WHEN i % 4 = 2 THEN v END) AS b, max(CASE WHEN i % 4 = 3 THEN v END) AS a
  FROM samples GROUP BY asset_id, i // 4)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each image with its successor as its output."""
    ids = read_table(spark, sf, "embeddings").select("vec_id")
    following = ids.select((F.col("vec_id") - 1).alias("original_id"),
                           F.col("vec_id").alias("output_id"))
    return ids.select(F.col("vec_id").alias("original_id")).join(following, "original_id").select(
        F.col("original_id").alias("pair_id"), "original_id", "output_id"
    )


# Events as worker messages ---------------------------------------------------------------------

def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
