"""The typed event feed of the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One flat row per message; `type` tells which columns are set.
TASK_EVENT = (
    "type string, asset_id string, format string, stage string, percent double, size bigint, "
    "label string, savings_pct int, error string, seq bigint, ts timestamp"
)


def read_task_events(
    spark: SparkSession,
    path: str,
    schema: str = TASK_EVENT,
    file_format: str = "parquet",
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming source over a folder of event files. The schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
