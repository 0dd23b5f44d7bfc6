"""Ordered work inside groups that may hold any share of the rows.

A plain window puts a whole group into one task. Here the rows are cut into slices by a range
partitioning over (group, order), each slice is scanned on its own, and what the preceding slices
of a group hold is added. Only groups that cross a slice border need such a carry, so the carry
table has at most one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .session import stored

SLICE = "_slice"


def _sliced(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], slices: int | None
) -> DataFrame:
    """Cut into consecutive slices in (group, order): as many as shuffle partitions by default.

    Written once: the carry and the rows must see the same slicing.
    """
    keys = [*(F.col(c) for c in group), *order]
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return stored(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _same_slice(group: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)],
        F.col(SLICE) == F.col("_carry_slice"),
    )


class Sliced:
    """Rows in consecutive slices of (group, order), stored once, for several scans in that order.

    A scan looks at each slice of a group on its own (`inside`). What it needs of the slices before
    is gathered per (group, slice), at most one row per slice and group that crosses a border, and
    joined (`carried`), or comes as rows that stand in front of the slice's own.
    """

    def __init__(
        self, df: DataFrame, group: Sequence[str], order: Sequence[str], slices: int | None = None
    ):
        self.group, self.order = list(group), list(order)
        self.rows = _sliced(df, group, [F.col(c) for c in order], slices)

    def together(self, rows: DataFrame) -> DataFrame:
        """Rows of one slice of a group in one task, whatever else later scans group by."""
        return rows.repartition(*self.group, SLICE)

    def inside(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.group, *more, SLICE).orderBy(*self.order)

    def earlier(self, *more: str) -> WindowSpec:
        """Slices of a group in front of one, over rows per slice."""
        slices = Window.partitionBy(*self.group, *more).orderBy(SLICE)
        return slices.rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, rows: DataFrame, carry: DataFrame, *names: str) -> DataFrame:
        """Add columns of `carry`, which has one row per (group, slice); null where it has none."""
        named = carry.select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(self.group)],
            F.col(SLICE).alias("_carry_slice"),
            *names,
        )
        gone = [f"_g{i}" for i in range(len(self.group))]
        return rows.join(named, _same_slice(self.group), "left").drop(*gone, "_carry_slice")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per group. `order` must decide every tie."""
    valued = df.withColumns({f"_sum_{name}": value for name, value in totals.items()})
    sliced = _sliced(valued, group, order, slices)

    inside = Window.partitionBy(*group, SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.withColumns({name: F.sum(f"_sum_{name}").over(inside) for name in totals})

    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.groupBy(*group, SLICE)
        .agg(*[F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in totals], F.lit(1).alias("_one"))
        .withColumns(
            {f"_carry_{name}": F.sum(f"_sum_{name}").over(earlier) for name in totals}
            | {"_before": F.sum("_one").over(earlier)}
        )
        .filter(F.col("_before").isNotNull())
        .select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
            F.col(SLICE).alias("_carry_slice"),
            *[f"_carry_{name}" for name in totals],
        )
    )
    joined = local.join(carry, _same_slice(group), "left")
    # A sum over no values is NULL.
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(f"_carry_{name}").isNull(), F.col(name))
            .otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col(f"_carry_{name}"))
            .alias(name)
            for name in totals
        ],
    )


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the 1-based position inside the group."""
    return running_totals(df, group, order, {name: F.lit(1).cast("bigint")}, slices)


def previous_values(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Add, under each new name, the value a column had in the row before. Ascending order."""
    by = [F.col(c) for c in order]
    sliced = _sliced(df, group, by, slices)
    inside = Window.partitionBy(*group, SLICE).orderBy(*by)
    local = sliced.withColumns(
        {new: F.lag(c).over(inside) for new, c in previous.items()}
        | {"_first": F.row_number().over(inside) == 1}
    )
    slices = Window.partitionBy(*group).orderBy(SLICE)
    values = F.struct(*[F.col(c).alias(f"_carry_{new}") for new, c in previous.items()])
    carry = (
        sliced.groupBy(*group, SLICE)
        .agg(F.max_by(values, F.struct(*order)).alias("_last"))
        .withColumn("_last", F.lag("_last").over(slices))
        .filter(F.col("_last").isNotNull())
        .select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
            F.col(SLICE).alias("_carry_slice"),
            "_last.*",
        )
    )
    return local.join(carry, _same_slice(group), "left").select(
        *df.columns,
        *[
            F.when(F.col("_first"), F.col(f"_carry_{new}")).otherwise(F.col(new)).alias(new)
            for new in previous
        ],
    )


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, salts: int = 32
) -> DataFrame:
    """First k rows per group. Every stage keeps at most k rows per group and salt."""
    rows = df.withColumn("_salt", F.spark_partition_id() % salts)
    for keys in ([*group, "_salt"], list(group)):
        frame = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("_rn", F.row_number().over(frame)).filter(F.col("_rn") <= k)
        rows = rows.drop("_rn")
    return rows.drop("_salt")
