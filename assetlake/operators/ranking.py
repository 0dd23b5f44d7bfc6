"""Queue order: who is next, and in what order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..plans.ordered import ranked


def queue_order(small_first: bool = True):
    """Ascending sort columns: visible first, then small (optional), then insertion order."""
    visible_last = (~F.col("visible")).cast("int")
    size = F.col("original_size") if small_first else F.lit(0).cast("bigint")
    return [visible_last, size, F.col("ordinal")]


def priority_rank(items: DataFrame, small_first: bool = True, slices: int | None = None) -> DataFrame:
    """Rank pending items of each batch. Needs `visible`; see `tasks.flag_visible`."""
    pending = items.filter(F.col("status") == K.PENDING)
    keyed = pending.withColumns(
        {f"_k{i}": c for i, c in enumerate(queue_order(small_first))}
    )
    order = [F.col(f"_k{i}") for i in range(3)]
    return ranked(keyed, ["batch_id"], order, "queue_rank", slices).drop("_k0", "_k1", "_k2")


def next_task(items: DataFrame, small_first: bool = True) -> DataFrame:
    """The item each batch processes next.

    A minimum over the order key, so every map task sends one row per batch.
    """
    pending = items.filter(F.col("status") == K.PENDING)
    key = [c.alias(f"k{i}") for i, c in enumerate(queue_order(small_first))]
    rest = [c for c in items.columns if c != "batch_id"]
    return (
        pending.groupBy("batch_id")
        .agg(F.min(F.struct(*key, *rest)).alias("item"))
        .select("batch_id", *[F.col(f"item.{c}").alias(c) for c in rest])
    )


def order_items(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items in the given order; ids that have no item are skipped.

    The sort is a range partitioning, so the result is written in order by many tasks.
    """
    return items.drop("ordinal").join(order, "asset_id").orderBy("ordinal")


def item_lookup(items: DataFrame, asset_id) -> DataFrame:
    return items.filter(F.col("asset_id") == asset_id)


def item_count(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"))
