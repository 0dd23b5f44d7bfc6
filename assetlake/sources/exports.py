"""Writing a packed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..operators.naming import named, unique_names
from ..operators.packing import greedy_pack


def pack_and_name(
    results: DataFrame,
    order: str = "ordinal",
    prefix: str = "",
    max_files: int = K.MAX_EXPORT_FILES,
    max_bytes: int = K.MAX_EXPORT_BYTES,
) -> DataFrame:
    """The manifest of an export: what is taken, in order, and under which unique name.

    `results`: batch_id, ordinal (one per result, unique in the batch), name, format, status, size.
    """
    taken = greedy_pack(results, [order], max_files, max_bytes)
    labels = results.select("batch_id", order, "name", "format")
    return unique_names(named(taken.join(labels, ["batch_id", order])), order, prefix)


def export_batch(
    results: DataFrame, path: str, order: str = "ordinal", prefix: str = "", **caps: int
) -> DataFrame:
    """Write payloads and a manifest below `path`, partitioned by batch; return the manifest.

    Payloads are joined in only for the rows that were taken.
    """
    manifest = pack_and_name(results.drop("content"), order, prefix, **caps)
    columns = ["batch_id", order, "position", "export_name", "format", "size"]
    manifest.select(*columns).write.mode("overwrite").partitionBy("batch_id").parquet(
        f"{path}/manifest"
    )
    reader = results.sparkSession.read.schema(manifest.select(*columns).schema)
    written = reader.parquet(f"{path}/manifest")
    payload = results.select("batch_id", order, "content").join(
        written.select("batch_id", order, "export_name"), ["batch_id", order]
    )
    payload.write.mode("overwrite").partitionBy("batch_id").parquet(f"{path}/files")
    return written.select(*columns, F.lit(f"{path}/files").alias("files"))
