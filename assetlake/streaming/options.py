"""Bursts of option changes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as K
from ..plans.ordered import SLICE, Sliced

DEBOUNCE = timedelta(milliseconds=K.DEBOUNCE_MS)


def _numbered(changes: DataFrame, key: str, gap: timedelta) -> DataFrame:
    """Add `_burst`. Bursts are numbered within slices; a slice's first one may go on from before."""
    sliced = Sliced(changes, [key], ["ts", "seq"])
    inside = sliced.inside()
    quiet = F.col("ts") - F.lag("ts").over(inside) >= F.lit(gap)
    local = sliced.together(sliced.rows).withColumn(
        "_fresh", F.coalesce(quiet, F.lit(True)).cast("int")
    )
    local = local.withColumn("_local", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(key, SLICE).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("_local").alias("n")
    )
    slices = Window.partitionBy(key).orderBy(SLICE)
    goes_on = F.coalesce(F.col("first") - F.lag("last").over(slices) < F.lit(gap), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on.cast("int"))
    before = F.sum(F.col("n") - F.col("goes_on")).over(sliced.earlier())
    carry = ends.withColumn("_offset", before - F.col("goes_on")).filter("_offset IS NOT NULL")
    burst = F.col("_local") + F.coalesce("_offset", F.lit(0))
    return sliced.carried(local, carry, "_offset").withColumn("_burst", burst)


def debounce(
    changes: DataFrame, key: str, gap: timedelta = DEBOUNCE, delay: str | None = None
) -> DataFrame:
    """The last change of each burst, once the key has been quiet for `gap`.

    A change exactly `gap` after another starts a new burst. `force` holds if any change of the
    burst was forced.

    In batch, bursts are numbered by ordered slices and then added up, so a key with most of the
    changes is shared by many tasks. On a stream give `delay`, the lateness to wait for; session
    windows keep the open bursts, and `runs.drain` has Spark merge them before the shuffle.
    """
    at = F.struct("ts", "seq")
    values = [
        F.max_by("options", at).alias("options"),
        F.bool_or("force").alias("force"),
        F.count("*").alias("changes"),
    ]
    tick = timedelta(microseconds=1)
    if delay is None:
        numbered = _numbered(changes, key, gap)
        return (
            numbered.groupBy(key, "_burst")
            .agg(
                F.min("ts").alias("first_at"),
                (F.max("ts") + F.lit(gap)).alias("applied_at"),
                *values,
            )
            .drop("_burst")
        )
    # Session windows would merge changes exactly `gap` apart: one microsecond, the resolution
    # of time stamps, keeps them apart.
    window = F.session_window("ts", f"{gap // tick - 1} microseconds").alias("burst")
    return (
        changes.withWatermark("ts", delay)
        .groupBy(window, key)
        .agg(*values)
        .select(
            key,
            F.col("burst.start").alias("first_at"),
            (F.col("burst.end") + F.lit(tick)).alias("applied_at"),
            "options",
            "force",
            "changes",
        )
    )
