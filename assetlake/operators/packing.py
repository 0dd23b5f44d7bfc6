"""Greedy selection of results under a file and a byte cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..plans.ordered import first_per_group
from ..plans.session import durable, stored

WINDOW_ROWS = 200


def greedy_pack(
    results: DataFrame,
    order: list[str],
    max_files: int = K.MAX_EXPORT_FILES,
    max_bytes: int = K.MAX_EXPORT_BYTES,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Walk each batch in `order`; take a result if it still fits, else skip it and go on.

    Stops at `max_files`, or once the bytes reach the cap. `order` must decide every tie.

    The walk depends on everything taken before, so it cannot be one window. But room only
    shrinks: a row larger than the room left now can never be taken later. So each round looks
    at the next `window_rows` rows that would still fit, walks those, and moves on behind them.
    Rows are filtered and cut to the window before they are shuffled; a batch of any size sends
    only its window to one task. A round takes at least one result, so rounds are bounded by
    `max_files`; in practice room runs out within a few.
    """
    fits = (F.col("status") == K.SUCCESS) & (F.col("size") <= max_bytes)
    rows = stored(results.filter(fits).select("batch_id", *order, "size"), "packing")
    at = F.struct(*order)
    state = None
    taken = []
    while True:
        if state is None:
            open_rows = rows
        else:
            open_rows = (
                rows.join(state, "batch_id")
                .filter((at > F.col("last")) & (F.col("size") <= max_bytes - F.col("bytes")))
            )
        window = first_per_group(open_rows, ["batch_id"], [F.col(c) for c in order], window_rows)
        walked = durable(_walk(window, order, max_files, max_bytes, state is not None))
        taken.append(walked.select("batch_id", F.inline("taken")))
        state = walked.filter(
            (F.col("seen") == window_rows)
            & (F.col("files") < max_files)
            & (F.col("bytes") < max_bytes)
        ).select("batch_id", "files", "bytes", "last")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, taken)


def _walk(
    window: DataFrame, order: list[str], max_files: int, max_bytes: int, resumed: bool
) -> DataFrame:
    """Fold one bounded window per batch into the rows taken and the new state."""
    row = F.struct(*order, "size")
    files = F.first("files") if resumed else F.lit(0)
    used = F.first("bytes") if resumed else F.lit(0)
    gathered = window.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(row)).alias("window"),
        files.cast("bigint").alias("files0"),
        used.cast("bigint").alias("bytes0"),
    )
    kind = dict(window.dtypes)
    fields = ", ".join(
        f"{c}: {kind[c]}" for c in [*order, "size"]
    ) + ", position: bigint, total_bytes: bigint"
    start = F.struct(
        F.col("files0").alias("files"),
        F.col("bytes0").alias("bytes"),
        F.array().cast(f"array<struct<{fields}>>").alias("taken"),
    )

    def step(acc, x):
        fits = (
            (acc["files"] < max_files)
            & (acc["bytes"] < max_bytes)
            & (acc["bytes"] + x["size"] <= max_bytes)
        )
        files, used = acc["files"] + 1, acc["bytes"] + x["size"]
        accepted = F.struct(
            *[x[c].alias(c) for c in [*order, "size"]],
            files.alias("position"),
            used.alias("total_bytes"),
        )
        return F.when(
            fits,
            F.struct(
                files.alias("files"),
                used.alias("bytes"),
                F.concat(acc["taken"], F.array(accepted)).alias("taken"),
            ),
        ).otherwise(acc)

    folded = gathered.withColumn("out", F.aggregate("window", start, step))
    last = F.element_at("window", -1)
    return folded.select(
        "batch_id",
        F.size("window").alias("seen"),
        F.struct(*[last[c].alias(c) for c in order]).alias("last"),
        "out.files",
        "out.bytes",
        "out.taken",
    )
