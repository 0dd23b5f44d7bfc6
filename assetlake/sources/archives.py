"""ZIP archives as member rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, constants as K
from ..operators.intake import member_verdict, union_intake

MEMBERS = (
    "archive_path string, member_path string, position int, size bigint, content binary, "
    "error string"
)
SCHEMA = pa.schema(
    [
        ("archive_path", pa.string()),
        ("member_path", pa.string()),
        ("position", pa.int32()),
        ("size", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
BATCH_BYTES = 16 * 1024 * 1024


def read_members(
    archives: DataFrame,
    max_members: int = K.MAX_ZIP_MEMBERS,
    max_bytes: int = K.MAX_ZIP_EXPANDED_BYTES,
) -> DataFrame:
    """One row per member, straight from the archive.

    An archive that cannot be read is one error row, and so is one over a limit: the first that
    its members cross, in their order. The directory shows it before anything is unpacked, so no
    task expands more than `max_bytes` of one archive. Members leave in small batches.
    """

    def crossed(sizes: list[int]) -> str | None:
        for count, total in enumerate(accumulate(sizes), 1):
            if count > max_members:
                return K.ERR_ZIP_COUNT
            if total > max_bytes:
                return K.ERR_ZIP_BYTES
        return None

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                # A repeated path keeps its first place and its last content.
                listed = {entry.filename: entry for entry in archive.infolist()}
                over = crossed([entry.file_size for entry in listed.values()])
                if over:
                    yield path, None, None, None, None, K.ERR_ZIP_PREFIX + over
                    return
                for position, (name, entry) in enumerate(listed.items()):
                    yield path, name, position, entry.file_size, archive.read(entry), None
        except Exception as broken:  # any unreadable archive is a row, not a failed job
            yield path, None, None, None, None, f"{K.ERR_ZIP_PREFIX}{broken}"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in members(path.as_py(), content.as_py()):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held >= BATCH_BYTES or len(rows) >= 1000:
                        yield as_batch(rows)
                        rows, held = [], 0
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA
        )

    return archives.select("path", "content").mapInArrow(expand, MEMBERS)


def expand_archives(
    assets: DataFrame,
    max_members: int = K.MAX_ZIP_MEMBERS,
    max_bytes: int = K.MAX_ZIP_EXPANDED_BYTES,
    max_zip_bytes: int = K.MAX_ZIP_BYTES,
) -> DataFrame:
    """Items from the `.zip` files among the assets, with the checks for archive members.

    An archive over a limit, over-long or unreadable, becomes a single error row. Each archive is
    read and unpacked once.
    """
    item = ["archive_path", "member_path", "position", "name", "size", "content", "status", "error"]
    archives = assets.filter(C.is_archive(F.col("name")))
    fits = F.col("size") <= max_zip_bytes
    own_name = F.substring_index("archive_path", "/", -1)
    members = read_members(archives.filter(fits), max_members, max_bytes)
    read = member_verdict(members.withColumnRenamed("error", "archive_error"), whole="archive_error")
    whole = F.col("archive_error").isNotNull()
    read = read.withColumns(
        {
            "name": F.when(whole, own_name).otherwise(F.col("name")),
            "status": F.when(whole, K.ERROR).otherwise(F.col("status")),
            "error": F.coalesce("archive_error", "error"),
        }
    ).select(*item)
    too_long = archives.filter(~fits).select(
        F.col("path").alias("archive_path"), "name", F.lit(K.ERROR).alias("status"),
        F.lit(K.ERR_ZIP_LIMIT).alias("error"),
    )
    return union_intake(read, too_long)
