"""Exact top-k search by distributed histogram selection.

Vectors are packed in blocks and every block of queries meets every block of candidates in a task
of its own, which scores all its pairs. The k-th highest score of each query is located without
moving scores: tasks report a lower bound and then histograms of the scores from there on, whose
sums name the bin that holds the k-th value; that bin is divided again until it is one score
wide. A last pass lets through what lies above the k-th value, and of its ties the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import NO_ID, settled

BLOCK = 4096
BINS = 64
#: Scores that a task holds at a time.
HELD = 1 << 21

PACKED = pa.schema(
    [
        ("block", pa.int64()),
        ("dim", pa.int32()),
        ("base", pa.int64()),
        ("ids", pa.binary()),
        ("dtype", pa.string()),
        ("matrix", pa.binary()),
    ]
)
PACKED_DDL = "block long, dim int, base long, ids binary, dtype string, matrix binary"
#: Of each query: bounds of its k-th score, and which of the scores from `lo` on it is.
STATE = ["uid", "lo", "hi", "need"]


def _pack(table: pa.Table) -> pa.Table:
    rows = {name: [] for name in PACKED.names}
    sizes = table["vector"].combine_chunks().value_lengths().to_numpy()
    ids = table["asset_id"].to_numpy()
    base = 0
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        part = table["vector"].take(pa.array(mine)).combine_chunks().flatten().to_numpy()
        matrix = part.reshape(len(mine), dim)
        order = np.lexsort((*matrix.T[::-1], ids[mine]))
        matrix = matrix[order]
        top = int(max(-matrix.min(initial=0), matrix.max(initial=0)))
        small = next(t for t in ("i1", "i2", "i4", "i8") if top <= np.iinfo(t).max)
        rows["block"].append(table["block"][0].as_py())
        rows["dim"].append(dim)
        rows["base"].append(base)
        base += len(mine)
        rows["ids"].append(ids[mine][order].astype(np.int64).tobytes())
        rows["dtype"].append(small)
        rows["matrix"].append(matrix.astype(small).tobytes())
    return pa.table(rows, PACKED)


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["matrix"], row["dtype"]).reshape(len(row["ids"]) // 8, row["dim"])


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum leaves their integers."""
    top = [int(np.abs(m.astype(float)).max(initial=0)) for m in (left, right)]
    bound = top[0] * top[1] * left.shape[1]
    if bound < 1 << 53:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return left.astype(np.int64) @ right.T.astype(np.int64)
    return (left.astype(object) @ right.T.astype(object)).astype(np.int64)  # raises on overflow


def _pairs(modulus: int, emit, columns: dict[str, pa.DataType]):
    """Run `emit` over the scores of a query block with a candidate block."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {name: [np.empty(0, np.int64)] for name in columns}
        rows = [{c.removeprefix("c_"): v for c, v in r.items()} for r in candidates.to_pylist()]
        by_dim = {row["dim"]: row for row in rows}
        for row in queries.to_pylist():
            other = by_dim.get(row["dim"])
            if other is None:
                continue
            ids = np.frombuffer(row["ids"], np.int64)
            asked = np.flatnonzero((ids % modulus == 0) & (ids != NO_ID))
            uids = (np.int64(row["block"]) << 32) + row["base"] + asked
            theirs = np.frombuffer(other["ids"], np.int64)
            left, right = _matrix(row), _matrix(other)
            state = []
            if "uid" in row:
                known, *state = (np.frombuffer(row[c], np.int64) for c in STATE)
                here = np.isin(uids, known)
                asked, uids = asked[here], uids[here]
                state = [s[np.searchsorted(known, uids)] for s in state]
            step = max(1, HELD // len(theirs))
            for a in range(0, len(asked), step):
                rows = asked[a : a + step]
                scores = _scores(left[rows], right)
                own = np.zeros(scores.shape, bool)
                if row["block"] == other["block"]:
                    own[np.arange(len(rows)), rows] = True
                mine = [s[a : a + step] for s in (uids, *state)]
                found = emit(ids[rows], scores, ~own, theirs, *mine)
                for name, values in zip(columns, found):
                    out[name].append(values)
        return pa.table(
            {c: pa.array(np.concatenate(out[c]).astype(np.int64), t) for c, t in columns.items()}
        )

    return run


def _bounds(k: int):
    def emit(_ids, scores, other, _theirs, uid):
        n = other.sum(axis=1)
        least = np.iinfo(np.int64).min
        top = np.where(other, scores, least)
        at = scores.shape[1] - min(k, scores.shape[1])
        kth = np.partition(top, at, axis=1)[:, at] if scores.shape[1] >= k else top[:, 0] * 0
        # where this block alone has k, the k-th of all is no lower
        sure = n >= k
        low = np.where(other, scores, np.iinfo(np.int64).max).min(axis=1)
        keep = n > 0
        return [x[keep] for x in (uid, n, np.where(sure, kth, least), top.max(axis=1), low)]

    return emit


def _histogram(_ids, scores, other, _theirs, uid, lo, hi, _need):
    width = -(-(hi - lo) // BINS)
    inside = other & (scores >= lo[:, None]) & (scores < hi[:, None])
    query, at = np.nonzero(inside)
    bins = (scores[query, at] - lo[query]) // width[query]
    key, count = np.unique(query * BINS + bins, return_counts=True)
    return uid[key // BINS], key % BINS, count


def _select(ids, scores, other, theirs, uid, lo, _hi, need):
    above = other & (scores > lo[:, None])
    ties = other & (scores == lo[:, None])
    # candidates stand in the order of their ids, so the first ties have the smallest
    ties &= np.cumsum(ties, axis=1) <= need[:, None]
    query, at = np.nonzero(above | ties)
    return uid[query], ids[query], theirs[at], scores[query, at]


def _with_state(packed: DataFrame, state: DataFrame) -> DataFrame:
    """Packed blocks with the state of their queries; a block has a bounded number of them."""
    rows = F.array_sort(F.collect_list(F.struct(*STATE)))
    packs = (
        state.groupBy(F.shiftright("uid", 32).alias("block"))
        .agg(rows.alias("rows"))
        .select("block", *(F.col(f"rows.{c}").alias(c) for c in STATE))
    )

    def to_bytes(tables):
        for t in tables:
            lists = {c: t.column(c).to_pylist() for c in STATE}
            blobs = {c: [np.array(v, np.int64).tobytes() for v in lists[c]] for c in STATE}
            yield pa.record_batch(
                {"block": t.column("block")} | {c: pa.array(b, pa.binary()) for c, b in blobs.items()}
            )

    ddl = "block long, " + ", ".join(f"{c} binary" for c in STATE)
    return packed.join(packs.mapInArrow(to_bytes, ddl), "block")


def top_k(assets: DataFrame, k: int = 20, modulus: int = 20, scale: int = 64) -> DataFrame:
    """The k highest-scoring assets for every query asset.

    assets: `asset_id`, `vector` (array of numbers); other columns are ignored. Components become
    floor(scale * x); a score is the integer inner product of two vectors of the same length.
    Queries are the rows whose id is divisible by `modulus`, candidates all rows but the query's
    own. Ties go to the smaller id.

    Returns `query_id`, `rank` (from 1), `vec_id`, `score`; fewer than k rows where there are
    fewer candidates.

    Vectors that are null or hold null, NaN or infinite components, or one whose scaled value is
    no long, take no part. Null id: no query, behind all others in ties. Rows that repeat an id
    are rows of their own: each is a query and a candidate of the other. Empty table: no rows.
    A score beyond long stops the job.
    """
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    limit = float(1 << 63) / scale
    # a comparison with NaN or null is not true here: NaN is above every number
    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < limit, F.lit(False)))
    rows = assets.filter(F.col("vector").isNotNull() & fine).select(
        F.coalesce(F.col("asset_id").cast("long"), F.lit(NO_ID)).alias("asset_id"),
        scaled.alias("vector"),
    )
    blocks = max(1, -(-rows.count() // BLOCK))
    # the row number spreads rows that are all alike
    place = F.pmod(F.xxhash64("asset_id", F.monotonically_increasing_id()), F.lit(blocks))
    packed = settled(
        rows.withColumn("block", place).groupBy("block").applyInArrow(_pack, PACKED_DDL), "vectors"
    )
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    candidates = packed.toDF(*(f"c_{c}" for c in packed.columns))
    candidates = candidates.select("*", others.alias("c_met")).groupBy("c_met", "c_block")

    def met(queries: DataFrame, emit, columns: dict[str, pa.DataType]) -> DataFrame:
        asked = queries.select("*", others.alias("met")).groupBy("block", "met")
        ddl = ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in columns.items())
        return asked.cogroup(candidates).applyInArrow(_pairs(modulus, emit, columns), ddl)

    long = pa.int64()
    bounds = met(packed, _bounds(k), {c: long for c in ("uid", "n", "kth", "top", "low")})
    state = bounds.groupBy("uid").agg(
        F.when(F.sum("n") <= k, F.min("low"))
        .otherwise(F.greatest(F.max("kth"), F.min("low")))
        .alias("lo"),
        (F.max("top") + 1).alias("hi"),
        (F.sum("n") <= k).alias("all"),
        F.lit(k).cast("long").alias("need"),
    )
    state = settled(state, "kth")
    while True:
        open_ = state.filter(~F.col("all") & (F.col("hi") - F.col("lo") > 1))
        if open_.isEmpty():
            break
        bins = met(
            _with_state(packed, open_), _histogram, {"uid": long, "bin": long, "count": long}
        )
        total = bins.groupBy("uid", "bin").agg(F.sum("count").alias("count"))
        above = F.sum("count").over(
            Window.partitionBy("uid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        )
        width = F.expr(f"(hi - lo + {BINS - 1}) div {BINS}")
        chosen = (
            total.withColumn("reached", above)
            .join(open_, "uid")
            .filter((F.col("reached") >= F.col("need")) & (F.col("reached") - F.col("count") < F.col("need")))
            .select(
                "uid",
                (F.col("lo") + F.col("bin") * width).alias("from"),
                F.least("hi", F.col("lo") + (F.col("bin") + 1) * width).alias("to"),
                (F.col("need") - F.col("reached") + F.col("count")).alias("left"),
            )
        )
        state = settled(
            state.join(chosen, "uid", "left").select(
                "uid",
                F.coalesce("from", "lo").alias("lo"),
                F.coalesce("to", "hi").alias("hi"),
                "all",
                F.coalesce("left", "need").alias("need"),
            ),
            "kth",
        )
    chosen = met(
        _with_state(packed, state),
        _select,
        {"uid": long, "query_id": long, "vec_id": long, "score": long},
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return (
        chosen.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            "query_id",
            "rank",
            F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"),
            "score",
        )
    )
