"""Unique export names.

In order, a row takes `base.ext` if free, else `base-2.ext`, `base-3.ext`, ... The only other
rows that can hold `x-n.ext` are those of base `x` (as their n-th name) and the first row of
base `x-n` (as its own name). That gives an exact answer without walking a batch row by row:

1. number the rows of each base; without a base that looks like another's n-th name, that
   number is the suffix;
2. for each base `x-n` whose `x` exists, count the `x` rows that come before it. It gets its own
   name if `x` has not counted up to n by then;
3. otherwise `x` has it, and `x-n` starts at its second name. Names won by `x-n` are skipped by `x`.

Step 2 for n depends on the smaller ones. Bounds settle it: all smaller ones won at most and at
least so many; repeat until nothing is open. Each repeat settles at least the next one, and
usually everything. A parent that is a child itself (`x-2-2` of `x-2` of `x`) is settled under both
outcomes of its own name; chains are then resolved by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C
from ..plans.ordered import ranked, running_totals
from ..plans.session import durable

NAME = ["batch_id", "base", "ext"]
SUFFIX = r"^(.*)-([1-9][0-9]{0,17})$"


def named(rows: DataFrame) -> DataFrame:
    """Add base and extension from `name` and `format`."""
    return rows.withColumns(
        {"base": C.base_name(F.col("name")), "ext": C.extension_of_format(F.col("format"))}
    )


def numbered_name(slot: Column, prefix: str = "") -> Column:
    suffix = F.when(slot > 1, F.concat(F.lit("-"), slot.cast("string"))).otherwise("")
    return F.concat(F.lit(prefix), F.col("base"), suffix, F.lit("."), F.col("ext"))


def unique_names(rows: DataFrame, order: str = "ordinal", prefix: str = "", slices: int | None = None):
    """Add `export_name`. Needs batch_id, base, ext; `order` is unique inside a batch."""
    groups = durable(rows.groupBy(*NAME).agg(F.min(order).alias("first")))
    numbered = ranked(rows, NAME, [F.col(order)], "_j", slices)
    links = durable(_links(groups))
    if links.isEmpty():
        return numbered.withColumn("export_name", numbered_name(F.col("_j"), prefix)).drop("_j")

    settled = _settle(_rows_before(rows, links, order, slices), slices)
    started = settled.select(
        "batch_id", F.col("child").alias("base"), "ext",
        F.when(F.col("won"), 0).otherwise(1).alias("_o"),
    )
    offset = numbered.join(started, NAME, "left").withColumn("_o", F.coalesce("_o", F.lit(0)))
    slots = _skip_won(offset, settled, slices)
    return slots.withColumn("export_name", numbered_name(F.col("_slot"), prefix)).select(
        *rows.columns, "export_name"
    )


def _links(groups: DataFrame) -> DataFrame:
    """(parent x, child x-n) for every base that looks like another one's n-th name."""
    n = F.regexp_extract("base", SUFFIX, 2).try_cast("bigint")
    child = groups.withColumn("n", n).filter(F.col("n") >= 2).select(
        "batch_id", F.regexp_extract("base", SUFFIX, 1).alias("parent"), "ext",
        F.col("base").alias("child"), "n", "first",
    )
    parent = groups.select("batch_id", F.col("base").alias("parent"), "ext")
    return child.join(parent, ["batch_id", "parent", "ext"])


def _rows_before(rows: DataFrame, links: DataFrame, order: str, slices: int | None) -> DataFrame:
    """Rows of the parent that come before the child's first row."""
    parents = links.select("batch_id", F.col("parent").alias("base"), "ext").distinct()
    seen = rows.join(parents, NAME, "left_semi").select(
        "batch_id", F.col("base").alias("parent"), "ext", F.col(order).alias("at"),
        F.lit(1).alias("row"),
    )
    marks = links.withColumn("at", F.col("first")).withColumn("row", F.lit(0))
    both = seen.unionByName(marks, allowMissingColumns=True)
    counted = running_totals(
        both, ["batch_id", "parent", "ext"], [F.col("at")], {"before": F.col("row")}, slices=slices
    )
    return counted.filter("row = 0").drop("row", "at", "first")


LINK = ["batch_id", "child", "ext"]


def _settle(links: DataFrame, slices: int | None) -> DataFrame:
    """Add `won`: does the child get its own name? Also the parent's start offset.

    Where a parent is itself a child, its offset is 0 or 1 and not known yet, so the children of
    a parent are settled for both. What a link makes of the offset above it is then a function
    on {0, 1}; chains of these functions are composed by doubling.
    """
    above = links.select("batch_id", F.col("child").alias("parent"), "ext", F.lit(True).alias("chained"))
    links = durable(links.join(above, ["batch_id", "parent", "ext"], "left"))
    offsets = F.when(F.col("chained"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cases = _settle_level(durable(links.withColumn("offset", F.explode(offsets))), slices)
    won = [F.max(F.when(F.col("offset") == k, F.col("won"))).alias(f"won{k}") for k in (0, 1)]
    known = durable(
        links.drop("chained").join(cases.groupBy(*LINK).agg(*won), LINK)
    )
    own = _own_offsets(known).withColumnsRenamed({"child": "parent", "own": "offset"})
    return known.join(own, ["batch_id", "parent", "ext"], "left").withColumns(
        {
            "won": F.when(F.col("offset") == 1, F.col("won1")).otherwise(F.col("won0")),
            "offset": F.coalesce("offset", F.lit(0)),
        }
    ).drop("won0", "won1")


def _own_offsets(known: DataFrame) -> DataFrame:
    """(batch_id, child, ext, own): where the child starts numbering, 0 with its own name, else 1.

    Each round composes what a link makes of the offset above it with what the link it points to
    makes of the one above that, and points as far again: as many rounds as the logarithm of the
    longest chain.
    """
    start = [F.when(F.col(f"won{k}"), 0).otherwise(1).alias(f"o{k}") for k in (0, 1)]
    chained = F.col("won1").isNotNull()
    state = known.select(*LINK, F.when(chained, F.col("parent")).alias("up"), *start)
    done = None
    while True:
        state = durable(state)
        ends = state.filter("up IS NULL").select(*LINK, F.col("o0").alias("own"))
        done = ends if done is None else done.unionByName(ends)
        waiting = state.filter("up IS NOT NULL")
        if waiting.isEmpty():
            return done
        # links that have ended keep giving their offset to those that point at them
        ended = done.select(*LINK, F.lit(None).cast("string").alias("up"), *(F.col("own").alias(f"o{k}") for k in (0, 1)))
        target = ended.unionByName(waiting.select(*LINK, "up", "o0", "o1")).select(
            "batch_id", "ext", F.col("child").alias("up"), F.col("up").alias("next"),
            F.col("o0").alias("a0"), F.col("o1").alias("a1"),
        )
        state = waiting.join(target, ["batch_id", "ext", "up"]).select(
            *LINK,
            F.col("next").alias("up"),
            *(F.when(F.col(f"a{k}") == 0, F.col("o0")).otherwise(F.col("o1")).alias(f"o{k}") for k in (0, 1)),
        )


def _settle_level(ready: DataFrame, slices: int | None) -> DataFrame:
    """Add `won`, for the children of each parent under each offset of it."""
    need = F.col("n") - F.col("offset") - F.col("before")
    state = ready.withColumn("won", F.lit(None).cast("boolean"))
    while True:
        bounds = running_totals(
            state,
            ["batch_id", "parent", "ext", "offset"],
            [F.col("n")],
            {
                "at_most": F.coalesce(F.col("won"), F.lit(True)).cast("int"),
                "at_least": F.coalesce(F.col("won"), F.lit(False)).cast("int"),
            },
            slices=slices,
        )
        most = F.col("at_most") - F.coalesce(F.col("won"), F.lit(True)).cast("int")
        least = F.col("at_least") - F.coalesce(F.col("won"), F.lit(False)).cast("int")
        decided = F.when(most < need, True).when(least >= need, False)
        state = durable(bounds.withColumn("won", decided).drop("at_most", "at_least"))
        if state.filter("won is null").isEmpty():
            return state


def _skip_won(rows: DataFrame, settled: DataFrame, slices: int | None) -> DataFrame:
    """Slot of each row: its number, the start offset, and the names won by children below it."""
    won = ranked(
        settled.filter("won"), ["batch_id", "parent", "ext"], [F.col("n")], "i", slices=slices
    )
    markers = won.select(
        "batch_id", F.col("parent").alias("base"), "ext",
        (F.col("n") - F.col("offset") - (F.col("i") - 1)).alias("_j"),
        F.lit(1).alias("_won"),
        "n",
    )
    both = rows.withColumn("_won", F.lit(0)).unionByName(markers, allowMissingColumns=True)
    order = [F.col("_j"), F.col("_won").desc(), F.col("n")]
    counted = running_totals(both, NAME, order, {"_skipped": F.col("_won")}, slices=slices)
    slot = F.col("_j") + F.col("_o") + F.col("_skipped")
    return counted.filter("_won = 0").withColumn("_slot", slot)
