"""Queue statistics, timings and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.columns import half_up


def savings_percent(original: Column, optimized: Column) -> Column:
    """Signed percent with one decimal; 0 when nothing was read or nothing was written."""
    share = (original - optimized) / F.nullif(original, F.lit(0)).cast("double") * 100
    return F.when((original > 0) & (optimized != 0), F.round(share, 1)).otherwise(F.lit(0.0))


def summary_columns() -> list[Column]:
    """Aggregates over items that carry `original_size`, `optimized_size` and `status`."""
    status = F.col("status")
    finished = status.isin(K.SUCCESS, K.ERROR)
    return [
        F.count("*").alias("items"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_original"),
        F.coalesce(F.sum("optimized_size"), F.lit(0)).alias("total_optimized"),
        F.coalesce(F.bool_and(finished), F.lit(False)).alias("all_done"),
        F.count_if(status == K.SUCCESS).alias("successful"),
        F.count_if(status == K.PROCESSING).alias("processing"),
        F.coalesce(F.bool_or(finished), F.lit(False)).alias("has_finished"),
        (F.count_if(status == K.ERROR) == 0).alias("zero_errors"),
    ]


def queue_stats(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Queue summary, overall or per group. `items` come from `tasks.item_status`.

    Originals count once per item whatever its state; every successful format adds to the
    optimised total.
    """
    return items.groupBy(*(by or [])).agg(*summary_columns()).withColumn(
        "savings_pct", savings_percent(F.col("total_original"), F.col("total_optimized"))
    )


#: Counts that add up over items, and over signed changes of items.
COUNTS = (
    "items", "total_original", "total_optimized", "successful", "failed", "processing",
)


def queue_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """COUNTS per group, of items as `queue_stats` takes them."""
    status = F.col("status")
    values = (
        F.count("*"),
        F.coalesce(F.sum("original_size"), F.lit(0)),
        F.coalesce(F.sum("optimized_size"), F.lit(0)),
        *(F.count_if(status == named) for named in (K.SUCCESS, K.ERROR, K.PROCESSING)),
    )
    return items.groupBy(*(by or [])).agg(
        *(value.cast("bigint").alias(name) for value, name in zip(values, COUNTS, strict=True))
    )


def counted_stats(counts: DataFrame) -> DataFrame:
    """The columns of `queue_stats` from COUNTS per group. Groups without items left vanish."""
    by = [c for c in counts.columns if c not in COUNTS]
    finished = F.col("successful") + F.col("failed")
    known = counts.filter("items > 0") if by else counts.na.fill(0)
    return known.select(
        *by,
        "items",
        "total_original",
        "total_optimized",
        ((F.col("items") > 0) & (finished == F.col("items"))).alias("all_done"),
        "successful",
        "processing",
        (finished > 0).alias("has_finished"),
        (F.col("failed") == 0).alias("zero_errors"),
        savings_percent(F.col("total_original"), F.col("total_optimized")).alias("savings_pct"),
    )


def stage_timing(marks: DataFrame, task: list[str], names: tuple[str, str, str, str]) -> DataFrame:
    """Milliseconds per stage of each task from its first mark of each kind.

    `names`: start, decode end, classify end, encode end. A missing mark gives NULL.
    """
    first = {
        label: F.min(F.when(F.col("mark") == name, F.col("at_ms")))
        for label, name in zip(("t0", "t1", "t2", "t3"), names, strict=True)
    }
    wide = marks.filter(F.col("mark").isin(*names)).groupBy(*task).agg(
        *[c.alias(n) for n, c in first.items()]
    )
    return wide.select(
        *task,
        half_up(F.col("t1") - F.coalesce("t0", F.lit(0))).alias("decode_ms"),
        half_up(F.col("t2") - F.col("t1")).alias("classify_ms"),
        half_up(F.col("t3") - F.col("t2")).alias("encode_ms"),
    )


def benchmark_summary(runs: DataFrame, variants: tuple[str, str], by: list[str]) -> DataFrame:
    """Mean time of two variants and how much faster the first one is."""
    fast, slow = variants

    def mean(name: str) -> Column:
        return F.avg(F.when(F.col("variant") == name, F.col("elapsed")))

    return runs.groupBy(*by).agg(mean(fast).alias("fast_avg"), mean(slow).alias("slow_avg")).select(
        *by,
        F.round("fast_avg", 6).alias("fast_avg"),
        F.round("slow_avg", 6).alias("slow_avg"),
        F.round(F.col("slow_avg") / F.nullif(F.col("fast_avg"), F.lit(0.0)), 6).alias("speedup"),
    )
