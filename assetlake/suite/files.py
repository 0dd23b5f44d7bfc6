"""Folders, archives and exports. Archives are built from the documents, 25 in each."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions import constants as K
from ..plans.session import durable, new_shared_path, read_table
from ..sources.archives import expand_archives
from ..sources.assets import compare_inventories, inventory, scan_assets
from ..sources.exports import export_batch
from ..sources.images import image_lines, scan_images
from .base import ASSETS, MAGIC, MIME, SAMPLES, assets, grids, query
from .queue import PACK_BYTES, PACK_FILES, PACKED

EXPANDED_LIMIT = 60_000


FOLDER_FILES = 1000


def written(documents, folder: str):
    """The files of (name, text) that tasks write, the text and a newline each, in full folders.

    Their names are fixed by partition and order, so a retried task writes the same files again.
    A folder or a committed partition per file would cost more than the file: folders are
    listed by a task each, and what a task writes into a partition is moved by the driver.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = fs.FileSystem.from_uri(folder.removeprefix("file:"))
        partition, number = TaskContext.get().partitionId(), 0
        for part in parts:
            for name, text in zip(*(part.column(c).to_pylist() for c in ("name", "text")), strict=True):
                place = f"{path}/{partition}-{number // FOLDER_FILES}"
                if number % FOLDER_FILES == 0:
                    target.create_dir(place)
                with target.open_output_stream(f"{place}/{name}.{partition}-{number}.txt") as out:
                    out.write(f"{text}\n".encode())
                number += 1
        yield pa.RecordBatch.from_pydict({"files": [number]})

    shared, root = fs.FileSystem.from_uri(folder.removeprefix("file:"))
    shared.create_dir(root)
    documents.select("name", "text").mapInArrow(write, "files bigint").agg(F.sum("files")).first()
    return scan_assets(documents.sparkSession, folder, "*.txt")


def document():
    """The document that a file name names."""
    return F.regexp_extract("path", r"/([^/.]+)\.[0-9]+-[0-9]+\.txt$", 1)


def named_texts(spark, sf):
    documents = read_table(spark, sf, "documents").filter("text IS NOT NULL")
    return documents.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), "text")


@query(
    "scan_assets",
    """SELECT 'doc' || doc_id AS key, octet_length(encode(text || chr(10))) AS size,
      sha256(text || chr(10)) AS digest FROM documents WHERE text IS NOT NULL""",
)
def scan_assets_query(spark, sf):
    """Every document as a file, scanned with its contents."""
    files = written(named_texts(spark, sf).drop("doc_id"), new_shared_path(spark, "scanned"))
    return inventory(files, document()).select("key", "size", "digest")


@query(
    "compare_inventories",
    """WITH old AS (SELECT 'doc' || doc_id AS key, doc_id, text || chr(10) AS body FROM documents
      WHERE text IS NOT NULL),
    new AS (SELECT CASE WHEN doc_id % 7 = 1 THEN 'new' || doc_id ELSE key END AS key,
        CASE WHEN doc_id % 5 = 2 THEN 'x' || body ELSE body END AS body
      FROM old WHERE doc_id % 11 <> 3),
    merged AS (SELECT coalesce(o.key, n.key) AS key, coalesce(n.body, o.body) AS body,
      CASE WHEN n.key IS NULL THEN 'removed' WHEN o.key IS NULL THEN 'added'
        WHEN o.body = n.body THEN 'same' ELSE 'changed' END AS state
      FROM old o FULL JOIN new n ON n.key = o.key),
    placed AS (SELECT *, row_number() OVER (PARTITION BY body, state ORDER BY encode(key)) AS place
      FROM merged),
    moves AS (SELECT a.key, r.key AS was FROM placed a JOIN placed r
      ON a.state = 'added' AND r.state = 'removed' AND a.body = r.body AND a.place = r.place)
    SELECT m.key, v.was, CASE WHEN v.was IS NOT NULL THEN 'moved' ELSE state END AS state,
      octet_length(encode(body)) AS size, sha256(body) AS digest
    FROM merged m LEFT JOIN moves v ON v.key = m.key WHERE m.key NOT IN (SELECT was FROM moves)""",
)
def compare_inventories_query(spark, sf):
    """Documents as files, and again with some left out, renamed or changed."""
    texts, doc = named_texts(spark, sf), F.col("doc_id")
    later = texts.filter(doc % 11 != 3).select(
        F.when(doc % 7 == 1, F.concat(F.lit("new"), doc)).otherwise(F.col("name")).alias("name"),
        F.when(doc % 5 == 2, F.concat(F.lit("x"), "text")).otherwise(F.col("text")).alias("text"),
    )
    before = written(texts.drop("doc_id"), new_shared_path(spark, "before"))
    after = written(later, new_shared_path(spark, "after"))
    return compare_inventories(inventory(before, document()), inventory(after, document()))


def archives(spark, sf):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, body in zip(group["name"], group["body"], strict=True):
                archive.writestr(f"folder/{name}", body)
        content = buffer.getvalue()
        return pd.DataFrame(
            {"path": [f"/in/{group['pack'].iloc[0]}.zip"], "size": [len(content)],
             "content": [content]}
        )

    rows = assets(spark, sf, text=True).select(
        F.floor(F.col("asset_id") / 25).alias("pack"),
        "name",
        F.col("content").alias("body"),
    )
    packed = rows.groupBy("pack").applyInPandas(build, "path string, size bigint, content binary")
    return packed.withColumn("name", F.substring_index("path", "/", -1))


@query(
    "expand_archives",
    f"""WITH {ASSETS}, bodies AS (
      SELECT '/in/' || (asset_id // 25) || '.zip' AS archive_path, (asset_id // 25) || '.zip' AS zip,
        name, extension, header, length(header) // 2 AS bytes FROM assets),
    totals AS (SELECT archive_path, any_value(zip) AS zip, sum(bytes) > {EXPANDED_LIMIT} AS over
      FROM bodies GROUP BY archive_path)
    SELECT b.archive_path, b.name, CASE WHEN {MAGIC} THEN bytes ELSE 0 END AS size,
      CASE WHEN {MAGIC} THEN 'pending' ELSE 'error' END AS status,
      CASE WHEN NOT {MAGIC} THEN '{K.ERR_INVALID}' END AS error
    FROM bodies b JOIN totals t ON t.archive_path = b.archive_path
    WHERE NOT over AND {MIME} <> '{K.DEFAULT_MIME}'
    UNION ALL SELECT archive_path, zip, NULL, 'error', '{K.ERR_ZIP_PREFIX}{K.ERR_ZIP_BYTES}'
    FROM totals WHERE over""",
)
def expand_archives_query(spark, sf):
    return expand_archives(archives(spark, sf), max_bytes=EXPANDED_LIMIT).select(
        "archive_path", "name", "size", "status", "error"
    )


@query(
    "export_batch",
    f"""{PACKED} SELECT batch_id, ordinal, position, size,
      'small-' || name_base || '.jpg' AS export_name
    FROM (SELECT *, split_part(name, '.', 1) AS name_base FROM packed)""",
)
def export_batch_query(spark, sf):
    rows = assets(spark, sf, text=True).select(
        "batch_id", "ordinal", "name", F.lit("jpeg").alias("format"),
        F.lit(K.SUCCESS).alias("status"), "size", F.encode("text", "UTF-8").alias("content"),
    )
    manifest = export_batch(
        rows, new_shared_path(spark, "export"), prefix="small-", max_files=PACK_FILES,
        max_bytes=PACK_BYTES,
    )
    return manifest.select("batch_id", "ordinal", "position", "size", "export_name")


SHEET_ROWS = 4096


def grey_png(rows: np.ndarray) -> bytes:
    """Grey 8-bit PNG, one image line per row."""

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    height, width = rows.shape
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows.astype(np.uint8)]).tobytes()
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def write_sheets(samples, folder: str):
    """Write rows of 64 samples as sheets of up to 4096 lines; return where each row went.

    Tasks write to the shared folder under names fixed by partition and order, so a retried
    task writes the same files again.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Hadoop writes local paths as file:/x; Arrow wants /x.
        target, path = fs.FileSystem.from_uri(folder.removeprefix("file:"))
        target.create_dir(path)
        number = 0
        for part in parts:
            for start in range(0, len(part), SHEET_ROWS):
                sheet = part.iloc[start : start + SHEET_ROWS]
                name = f"sheet-{TaskContext.get().partitionId()}-{number}.png"
                number += 1
                with target.open_output_stream(f"{path}/{name}") as out:
                    out.write(grey_png(np.stack(sheet["samples"].to_numpy())))
                yield pd.DataFrame(
                    {"vec_id": sheet["asset_id"].to_numpy(), "sheet": name,
                     "y": np.arange(len(sheet), dtype=np.int32)}
                )

    return durable(
        samples.select("asset_id", "samples").mapInPandas(
            write, "vec_id bigint, sheet string, y int"
        )
    )


@query(
    "scan_images",
    f"""WITH {SAMPLES} SELECT asset_id AS vec_id, 64 AS width,
      string_agg(v, ',' ORDER BY i) AS samples FROM samples GROUP BY asset_id""",
)
def scan_images_query(spark, sf):
    """Embeddings written as grey image sheets, decoded again by the image source."""
    folder = new_shared_path(spark, "sheets")
    placed = write_sheets(grids(spark, sf), folder)
    lines = image_lines(scan_images(spark, folder)).withColumn(
        "sheet", F.substring_index("asset_id", "/", -1)
    )
    red = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: F.get("samples", x * 4))
    return lines.join(placed, ["sheet", "y"]).select(
        "vec_id", "width", F.array_join(red.cast("array<string>"), ",").alias("samples")
    )
