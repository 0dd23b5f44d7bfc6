"""Copies of assets so that batches meet target shares of words, by entropy balancing.

Among all document rates that give every batch its target of words, entropy balancing picks the
one closest to taking each asset once. Its dual is convex with one multiplier per batch, and the
best rates are exponentials of the multipliers. Newton steps on the dual need the words of each
batch, which are added up before the shuffle; the steps of all batches run side by side. Rates
are then rounded into copies: every asset gets the whole copies of its rate, and the words that
are still missing go to further copies in the order of a hash of the ids, the last one in part.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_if_small, settled

WEIGHTS = (5, 2, 1)
#: No batch and no asset is taken more often than this.
LIMIT = 3
NEWTON_STEPS = 64
#: Hash bits that a level of the search for the last copy tells apart, and levels.
LEVEL_BITS, LEVELS = 10, 4

_SPACES = "\t\n\x0b\x0c\r"


def _sizes(assets: DataFrame) -> DataFrame:
    """(asset_id, batch_id, key, size, place): key stands for the batch, null included."""
    plain = F.translate(F.coalesce("text", F.lit("")), _SPACES, " " * len(_SPACES))
    return assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        "batch_id",
        F.coalesce(F.concat(F.lit("b"), "batch_id"), F.lit("none")).alias("key"),
        F.size(F.array_remove(F.split(plain, " "), "")).cast("long").alias("size"),
        F.xxhash64("asset_id").alias("place"),
    )


def _ranked(batches: DataFrame) -> DataFrame:
    """Add `rank` from 0, by code point, null last; no task orders more than a range of them."""
    order = [F.col("batch_id").isNull(), F.col("batch_id")]
    ranges = settled(
        batches.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "batches"
    )
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = ranges.groupBy("part").agg(F.count("*").alias("n"))
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order)
    return ranges.join(F.broadcast(offsets), "part").withColumn(
        "rank", F.row_number().over(inside) - 1 + F.col("before")
    )


def _targets(batches: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """Add `target`: shares of all words by weight; none above its limit, the rest shared anew."""
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")
    )
    batches = settled(
        _ranked(batches).select("key", "source_size", weight.cast("double").alias("weight")),
        "weights",
    )
    most = F.col("source_size") * limit
    level, before = 0.0, None
    while level != before:  # the level only grows, and ends when no more batches reach their limit
        full = most < F.col("weight") * level
        row = batches.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        before = level
        if row["all"] and row["open"]:
            level = max(level, (row["all"] - (row["full"] or 0)) / row["open"])
    return batches.withColumn(
        "target", F.least(most.cast("double"), F.col("weight") * level)
    )


def _rates(batches: DataFrame, limit: int) -> DataFrame:
    """Add `rate`, the exponential of the batch's multiplier.

    The dual of a batch is words * exp(m) - target * m; a Newton step takes off its slope over
    its curvature, 1 - target / (words * exp(m)).
    """
    ratio = F.col("target") / F.col("source_size")
    multiplier = F.aggregate(
        F.sequence(F.lit(1), F.lit(NEWTON_STEPS)),
        F.lit(0.0),
        lambda m, _: m - F.lit(1.0) + F.col("ratio") * F.exp(-m),
    )
    solved = F.least(F.exp(F.col("multiplier")), F.lit(float(limit)))
    return (
        batches.withColumn("ratio", F.when(F.col("source_size") > 0, ratio).otherwise(F.lit(1.0)))
        .withColumn("multiplier", multiplier)
        .withColumn("rate", F.when(F.col("ratio") > 0, solved).otherwise(F.lit(0.0)))
        .drop("ratio", "multiplier")
    )


def mix_batches(
    assets: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT
) -> DataFrame:
    """How often each asset is taken so that batches meet their targets.

    assets: `asset_id`, `batch_id`, `text`; other columns are ignored. An asset's size is its
    number of words between white space. Batches, ordered by code point with null last, weigh
    `weights` in turn and share the sum of all sizes; a target stops at `limit` times its batch's
    size, and what is over is shared by weight among the others.

    Returns one row per input row: `asset_id`, `batch_id`, `size`, `source_size` (of its batch),
    `target` (of its batch, in words), `rate` (balanced), `taken` (words taken, repeats counted:
    whole copies but for one asset per batch). The words taken of a batch are its target, rounded;
    of an asset no more than `limit` times its size. The same rows give the same result.

    Null text: size 0, taken 0. A batch without words: target 0. Repeated rows are taken each on
    its own. Null ids are taken like any other. Empty table: no rows.
    """
    docs = settled(_sizes(assets), "sizes")
    batches = docs.groupBy("key").agg(
        F.first("batch_id").alias("batch_id"), F.sum("size").alias("source_size")
    )
    rated = _rates(_targets(batches, weights, limit), limit)
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(limit)).cast("long")
    rated = settled(
        rated.withColumn("whole", whole).withColumn(
            "missing",
            F.greatest(
                F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")
            ),
        ),
        "rates",
    )
    rated = broadcast_if_small(rated.drop("weight"))

    # level by level, find the hash range of each batch in which its missing words end
    found, inside = None, docs.filter("size > 0").select("key", "size", "place")
    open_ = rated.select("key", "missing").filter("missing > 0")
    for level in range(LEVELS):
        shift = 64 - (level + 1) * LEVEL_BITS
        bucket = F.shiftrightunsigned("place", shift)
        sums = (
            inside.join(broadcast_if_small(open_), "key")
            .groupBy("key", "missing", bucket.alias("bucket"))
            .agg(F.sum("size").alias("held"))
        )
        # at most 2 ** LEVEL_BITS buckets of a batch; unsigned shifts keep the order of hashes
        running = Window.partitionBy("key").orderBy("bucket")
        cut = settled(
            sums.withColumn("reached", F.sum("held").over(running))
            .filter((F.col("reached") - F.col("held") < F.col("missing")) & (F.col("reached") >= F.col("missing")))
            .select("key", "bucket", (F.col("missing") - F.col("reached") + F.col("held")).alias("missing")),
            "cuts",
        )
        at = cut.select("key", "bucket")
        inside = (
            inside.withColumn("bucket", bucket)
            .join(broadcast_if_small(at), ["key", "bucket"])
            .select("key", "size", "place")
        )
        found = cut
        open_ = cut.select("key", "missing")
    # all assets before the last range get another copy; within it, in order of hash and id
    shift = 64 - LEVELS * LEVEL_BITS
    last = found.select(
        "key", F.col("bucket").alias("cut"), F.col("missing").alias("left")
    )
    marked = docs.join(rated.drop("batch_id"), "key", "left").join(
        broadcast_if_small(last), "key", "left"
    )
    bucket = F.shiftrightunsigned("place", shift)
    edge = marked.filter((F.col("size") > 0) & (bucket == F.col("cut")))
    order = Window.partitionBy("key").orderBy("place", "asset_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    so_far = F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    edge = edge.withColumn("before", so_far).withColumn("extra", part).drop("before")
    rest = marked.filter(~((F.col("size") > 0) & (bucket == F.col("cut"))) | F.col("cut").isNull())
    rest = rest.withColumn("extra", F.when(bucket < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    return edge.unionByName(rest).select(
        "asset_id",
        "batch_id",
        "size",
        "source_size",
        "target",
        "rate",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )
