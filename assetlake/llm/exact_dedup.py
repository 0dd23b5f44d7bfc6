"""Exact copies among assets, by splitting them on successive bytes of their texts.

All assets start as one group. Level k of the radix splits every group by the next bytes of its
texts: bytes 0-63, then 64-511, 512-4,095 and so on, each level ending eight times as far as the one
before. An asset left alone in its group is unlike every other and drops out; assets whose text
ends within the bytes of a level are equal and are done; the rest go on. Bytes are compared as they
are, so no digest decides anything, and levels grow with the logarithm of the longest text.

A group may hold any share of the assets. The assets of one group are put together per slice of
`SLICE_ROWS` input rows first, as a list of row numbers beside the bytes they share, and only slices
meet afterwards: a group that a third of all assets belong to is one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, settled

#: First byte behind each level. The last one is the most that a row can hold.
LEVEL_ENDS = tuple(min(64 * 8**k, 2**31 - 1) for k in range(10))
#: Consecutive input rows whose equal bytes are put together before the shuffle; a power of two.
SLICE_ROWS = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _levels(ends: Sequence[int]) -> list[tuple[str, int, int]]:
    """(column, first byte, bytes) of each level."""
    starts = (0, *ends[:-1])
    return [(f"bytes_{k}", a, b - a) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


def _split(active: DataFrame, width: int) -> DataFrame:
    """(row, asset_id, part, group_size, best, ended) of assets that share a group and its bytes.

    `active` has (row, asset_id, part, bytes). `best` is the asset that stays; its row names the
    new group.
    """
    member = F.struct("asset_id", (-F.col("row")).alias("before"))
    heads = (
        active.withColumn("slice", F.floor(F.col("row") / SLICE_ROWS))
        .groupBy("slice", "part", "bytes")
        .agg(F.collect_list(member).alias("members"))
    )
    groups = (
        heads.groupBy("part", "bytes")
        .agg(
            F.sum(F.size("members")).alias("group_size"),
            F.max(F.array_max("members")).alias("best"),
        )
        .filter("group_size > 1")
    )
    return (
        heads.join(groups, ["part", "bytes"])
        .withColumn("ended", F.octet_length("bytes") < width)
        .select(F.explode("members").alias("member"), "group_size", "best", "ended")
        .select(
            (-F.col("member.before")).alias("row"),
            "member.asset_id",
            (-F.col("best.before")).alias("part"),
            "group_size",
            "best",
            "ended",
        )
    )


def drop_copies(assets: DataFrame, level_ends: Sequence[int] = LEVEL_ENDS) -> DataFrame:
    """Mark all but one of the assets whose texts are the same apart from the case of A-Z.

    assets: `asset_id` and `text`; other columns are ignored, whatever their names.
    level_ends: where each level of the radix ends, ascending, the last beyond every text.

    Returns one row per input row: asset_id, keep_id (the largest asset_id among equal texts),
    group_size (rows with that text), kept, text (lower-cased A-Z).

    A null text counts as empty; all empty texts are equal. A null asset_id counts as smaller than
    any other, so keep_id is null only if all ids of the group are. Of repeated rows with the
    largest id, the first in the order of the input stays. Texts of any length are compared whole.
    An empty table gives no rows.
    """
    levels = _levels(level_ends)
    whole = normalised(F.col("text")).cast("binary")
    rows = assets.select(F.col("asset_id").cast("long").alias("asset_id"), whole.alias("whole"))
    table = settled(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "asset_id",
            *(F.substring("whole", a + 1, n).alias(name) for name, a, n in levels),
        ),
        "levels",
    )
    first, _, width = levels[0]
    active = table.select("row", "asset_id", F.lit(0).cast("long").alias("part"), F.col(first).alias("bytes"))
    done = []
    for k, (_, _, width) in enumerate(levels):
        split = settled(_split(active, width), f"level-{k}")
        done.append(split.filter("ended"))
        left = split.filter("NOT ended").select("row", "asset_id", "part")
        n = left.limit(BROADCAST_ROWS + 1).count()
        if not n:
            break
        if k + 1 == len(levels):
            raise ValueError(f"a text is longer than {level_ends[-1]} bytes, the end of the last level")
        left = F.broadcast(left) if n <= BROADCAST_ROWS else left
        active = table.select("row", F.col(levels[k + 1][0]).alias("bytes")).join(left, "row")
    copies = reduce(DataFrame.unionByName, done).select(
        "row", "best.asset_id", "group_size", (F.col("row") == F.col("part")).alias("kept")
    )
    copies = copies.withColumnRenamed("asset_id", "keep_id")
    n = copies.limit(BROADCAST_ROWS + 1).count()
    copies = F.broadcast(copies) if n <= BROADCAST_ROWS else copies
    alone = F.col("kept").isNull()
    return table.join(copies, "row", "left").select(
        "asset_id",
        F.when(alone, F.col("asset_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        F.concat(*(F.col(name) for name, _, _ in levels)).cast("string").alias("text"),
    )
