"""Jaccard self-join of shingle sets, as links collapsed to components.

A set of size s falls in the size band that holds s, and also in the next band where a set of
that band may be similar enough. In a band, at most k hashes differ between two linked sets. The
hash space is cut into m > k segments, so at least m - k segments hold the same hashes in both;
sets that agree on a segment form a tile. For a set of size s, k follows from s itself; with e
empty segments it has at least t = m - k - e tiles in common with each set that it is linked with.
So it leaves out the t - 1 of its tiles that most sets hold: the rarest common tile stays in both
sets. (Empty segments make no tile, unless t is below 1.)

Within a tile, hashed bitmaps bound the overlap of two sets from above by their bit counts; what
passes is decided by intersecting the sorted hash arrays. First every set of a tile is compared
with two members, a few times, which links the groups of copies without listing their pairs.
Tiles whose sets still belong to several components are then compared in full, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import (
    NO_ID,
    REQUEST,
    answered,
    blank_words,
    broadcast_if_small,
    combine,
    dealt,
    found,
    give_back,
    gram_hashes,
    lean,
    partitions,
    requests,
    rows_of,
    scrambled,
    settled,
    text_bytes,
    word_hashes,
)
from .components import components

#: Largest size of a band over its smallest.
BAND_RATIO = 1.5
#: Segments of a band besides those it needs, as a share of the hashes that may differ. With more
#: of them a set leaves out more of its tiles.
SPARE = 0.1
#: Times that the sets of a tile are compared with two of its members, before all are.
TURNS = 2
#: Bytes of a bitmap at most. A bound from fewer bits is looser, never wrong.
LARGEST_BITMAP = 4096
#: Bytes of the bitmap's sketch at most: it goes with every candidate pair.
LARGEST_SKETCH = 512
#: Tiles of a set that go with each of its tiles in a full comparison.
FIRST_TILES = 32
#: Sets of one block of a tile that is compared in full.
BLOCK = 256

SETS = pa.schema(
    [
        ("node", pa.int64()),
        ("row_key", pa.int64()),
        ("batch", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("n", pa.int64()),
        ("tiles", pa.list_(pa.int64())),
        ("bits", pa.binary()),
        ("sketch", pa.binary()),
    ]
)
SETS_DDL = (
    "node long, row_key long, batch int, ids array<long>, n long, tiles array<long>, bits binary, "
    "sketch binary"
)
PAIR_DDL = "a long, b long, n long, m long"


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words, the whole sequence as one."""
    hashes = word_hashes(blank_words(text))
    return np.unique(gram_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


@cache
def _bands(num: int, den: int, top: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) up to `top`."""
    bands, low = [], 1
    while low <= top:
        high = max(low, int(low * BAND_RATIO))
        differ = 2 * (den - num) * high // (den + num)
        empty = 0.012 * differ
        spare = 1 + ceil(empty + 3 * sqrt(empty) + SPARE * differ) if differ else 1
        bands.append((low, high, differ + spare))
        low = high + 1
    return bands


def _tiles(items: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, int]]:
    """(keys of tiles, how many of these each linked set has at least) of a set of sorted hashes,
    in its own band and those of all larger sets that it can be linked with."""
    n = len(items)
    mixed = scrambled(items)
    largest = n * den // num
    for level, (low, high, count) in enumerate(_bands(num, den, max(2 * n + 2, largest + 1))):
        if not (low <= n <= high or (n < low and n * den >= num * low)):
            continue
        # high 32 bits decide the segment, so segments are runs of the sorted array
        segment = ((items >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        place = (np.uint64(level) << np.uint64(40)) + segment[start]
        keys = scrambled(np.add.reduceat(mixed, start) ^ scrambled(place + np.uint64(1)))
        differ = (den - num) * (n + min(high, largest)) // (den + num)
        common = len(start) - differ
        if common < 1:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), segment[start])
            empty = scrambled((np.uint64(level) << np.uint64(40)) + empty + np.uint64(7))
            keys = np.concatenate((keys, empty))
        yield keys, max(1, common)


def _tile_keys(items: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.concatenate([keys for keys, _ in _tiles(items, num, den)])


def _kept_tiles(
    items: np.ndarray, num: int, den: int, shared: np.ndarray, held: np.ndarray
) -> np.ndarray:
    """Keys of the tiles by which a set meets all sets that it is linked with.

    shared: sorted keys that several sets have; held: how many, the same number for all sets that
    ask. Of equally frequent tiles the larger key goes first.
    """
    kept = []
    for keys, common in _tiles(items, num, den):
        known, at = found(keys, shared)
        keys, at = keys[known], at[known]
        order = np.lexsort((keys, held[at]) if len(keys) else (keys,))
        kept.append(keys[order[: max(0, len(keys) - common + 1)]])
    return np.unique(np.concatenate(kept))


def _bitmap(items: np.ndarray) -> bytes:
    """About four bits per item; a power of two, so that two widths can be folded to one."""
    width = min(8 * LARGEST_BITMAP, max(64, 1 << (4 * len(items) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[items & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sketch_bytes(bitmap: int) -> int:
    """A quarter of the bitmap: it tells sets apart that have little in common."""
    return min(bitmap, LARGEST_SKETCH, max(16, bitmap // 4))


def _folded(bits: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No two sets with these bitmaps and sizes have more hashes in common."""
    size = min(len(a), len(b)) // 8
    x, y = _folded(a, size), _folded(b, size)
    only_a = int(np.bitwise_count(x & ~y).sum())
    only_b = int(np.bitwise_count(y & ~x).sum())
    return min(n_a - only_a, n_b - only_b)


def _node(items: np.ndarray) -> int:
    """The set as a node: a 64-bit hash of its sorted hashes."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def _new_sets(
    table: pa.Table, size: int, ids_of: dict[int, list]
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each distinct shingle set of a batch once, as (node, key of a row, items).

    Fills the ids of each node. Sets are made one at a time, copies of a text only once.
    """
    seen: dict[bytes, int] = {}
    columns = (table[c].to_pylist() for c in ("asset_id", "row_key", "text"))
    for asset_id, key, text in zip(*columns):
        copy = xxhash.xxh3_128_digest(text)
        if copy not in seen:
            items = shingle_set(text, size)
            seen[copy] = node = _node(items)
            if node not in ids_of:
                ids_of[node] = []
                yield node, key, items
        ids_of[seen[copy]].append(asset_id)


def _ask(size: int, num: int, den: int, shards: int):
    def ask(table: pa.Table) -> pa.Table:
        batch, table = rows_of(table)
        keys = [np.empty(0, np.uint64)]
        for *_, items in _new_sets(table, size, {}):
            if len(items):
                keys.append(np.unique(_tile_keys(items, num, den)))
        keys, holders = np.unique(np.concatenate(keys), return_counts=True)
        return requests(batch, keys, np.minimum(holders, 255).astype(np.uint8), shards)

    return ask


def _emit(size: int, num: int, den: int):
    def emit(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SETS.empty_table()
        batch, docs = rows_of(docs)
        shared, held = answered(answers, "uint8")
        rows = {name: [] for name in SETS.names}
        ids_of: dict[int, list] = {}
        for node, key, items in _new_sets(docs, size, ids_of):
            tiles = _kept_tiles(items, num, den, shared, held) if len(items) else items
            bits = _bitmap(items) if len(tiles) else None
            rows["node"].append(node)
            rows["row_key"].append(key)
            rows["batch"].append(batch)
            rows["n"].append(len(items))
            rows["tiles"].append(tiles.view(np.int64))
            rows["bits"].append(bits)
            rows["sketch"].append(bits and _folded(bits, _sketch_bytes(len(bits)) // 8).tobytes())
        rows["ids"] = [ids_of[node] for node in rows["node"]]
        return pa.table(rows, SETS)

    return emit


def _items(size: int):
    """(node, items) of wanted nodes, from texts that may be theirs."""

    def items_of(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            nodes, items = [], []
            for wanted, text in zip(*(table.column(c).to_pylist() for c in ("node", "text"))):
                found_ = shingle_set(text, size)
                if _node(found_) == wanted:
                    nodes.append(wanted)
                    items.append(found_.tobytes())
            yield pa.record_batch(
                {"node": pa.array(nodes, pa.int64()), "items": pa.array(items, pa.binary())}
            )
            give_back()

    return items_of


def _bounded(num: int, den: int):
    def bounded(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            keep = [
                overlap_bound(x, y, n, m) * (num + den) >= num * (n + m)
                for x, y, n, m in zip(*(table.column(c).to_pylist() for c in ("x", "y", "n", "m")))
            ]
            yield table.select(["a", "b", "n", "m"]).filter(pa.array(keep, pa.bool_()))

    return bounded


def _exact(num: int, den: int):
    def exact(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            keep = []
            for x, y in zip(table.column("x").to_pylist(), table.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield table.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return exact


def _sides(pairs: DataFrame, sets: DataFrame, column: str, *more: str) -> DataFrame:
    """Pairs with a column of both sets, as x and y, and with the other columns of the first."""
    first = sets.select(F.col("node").alias("a"), F.col(column).alias("x"), *more)
    second = sets.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(first, "a").join(second, "b")


class Sets:
    """Distinct sets that share a tile with another one, and the assets that hold them."""

    def __init__(self, docs: DataFrame, held: DataFrame, size: int):
        self.docs, self.size = docs, size
        shared = held.filter(F.size("tiles") > 0)
        self.firsts = shared.groupBy("node").agg(
            F.min(F.array_min("ids")).alias("first_id"),
            F.min("row_key").alias("row_key"),
            F.min("batch").alias("kept"),
            F.count("*").alias("batches"),
        )
        # of a set that several batches hold, one row stands for all
        again = shared.select("node", "batch").join(self.firsts.filter("batches > 1"), "node")
        again = settled(again.filter("batch > kept").select("node", "batch"), "repeated-sets")
        self.rows = shared.join(broadcast_if_small(again), ["node", "batch"], "left_anti")

    def items(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of the nodes, made again from the text of a row of each."""
        wanted = self.firsts.join(broadcast_if_small(nodes), "node", "left_semi")
        wanted = broadcast_if_small(wanted.select("node", "row_key"))
        texts = self.docs.join(wanted, "row_key").select("node", "text")
        made = texts.mapInArrow(_items(self.size), "node long, items binary")
        return made.dropDuplicates(["node"])


def _close(pairs: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """The pairs that the bitmaps of their sets allow: sketches first, then whole bitmaps."""
    rows = sets.rows
    for column, label in (("sketch", "rough-pairs"), ("bits", "close-pairs")):
        close = _sides(pairs, rows.select("node", column), column)
        pairs = settled(close.mapInArrow(_bounded(num, den), PAIR_DDL), label)
        rows = rows.join(broadcast_if_small(_ends(pairs)), "node", "left_semi")
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _linked(pairs: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """The pairs (a, b, n, m) of nodes, with their sizes, whose sets are linked."""
    items = settled(sets.items(_ends(pairs)), "items")
    return _sides(pairs, items, "items").mapInArrow(_exact(num, den), "a long, b long")


def _compared(run: pa.Table, num: int, den: int) -> Iterator[tuple[int, ...]]:
    """Pairs of the two blocks of a run that differ in component and pass the bound."""
    n, block = run["n"].to_numpy(), run["block"].to_numpy()
    label, tile = run["label"].to_numpy(), run["tile"][0].as_py()
    mine = [np.array(m) for m in run["mine"].to_pylist()]
    low, high = run["low"][0].as_py(), run["high"][0].as_py()
    node, bits = run["node"].to_numpy(), run["bits"].to_pylist()
    size = min(map(len, bits)) // 8
    words = np.stack([_folded(b, size) for b in bits])
    for i in np.flatnonzero(block == low):
        ok = (block == high) & (label != label[i])
        ok &= (n * den >= n[i] * num) & (n[i] * den >= n * num)
        if low == high:
            ok[: i + 1] = False
        at = np.flatnonzero(ok)
        only_i = np.bitwise_count(words[i] & ~words[at]).sum(axis=1, dtype=np.int64)
        only_j = np.bitwise_count(words[at] & ~words[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(n[i] - only_i, n[at] - only_j)
        for j in at[bound * (num + den) >= num * (n[i] + n[at])]:
            # a pair that meets in several tiles counts in the first, as far as that is known
            both = np.intersect1d(mine[i], mine[j], assume_unique=True)
            if not len(both) or both[0] == tile:
                k, l = (i, j) if node[i] > node[j] else (j, i)
                yield node[k], node[l], n[k], n[l]


def _block_pairs(num: int, den: int):
    """Compare the rows of each run of one (tile, low, high); runs are short and in order."""

    def compare(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def pairs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            keys = [table[c].to_numpy() for c in ("tile", "low", "high")]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            start = np.append(np.flatnonzero(new), table.num_rows)
            runs = len(start) - (1 if last else 2)
            out = [
                pair
                for a, b in zip(start[:runs], start[1 : runs + 1])
                for pair in _compared(table.slice(a, b - a), num, den)
            ]
            found_ = pa.record_batch(
                {c: pa.array([p[k] for p in out], pa.int64()) for k, c in enumerate("abnm")}
            )
            return found_, table.slice(start[runs])

        for batch in tables:
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            if table.num_rows:
                out, carry = pairs(table, False)
                yield out
        if carry is not None and carry.num_rows:
            yield pairs(carry, True)[0]
        give_back()

    return compare


def _mixed(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the tiles whose sets belong to several components, with their labels.

    Tiles of three sets or fewer need no more: each pair has one of the two members that all
    were compared with.
    """
    named = tiles.filter("held > 3").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("tile").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = mixed.filter("x < y").select("tile")
    named = named.join(mixed, "tile").select("tile", "node", "n", "label", "held")
    return settled(named, "mixed-tiles")


def _to_two(rows: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs of each set of a tile with two members of it, another two each turn.

    Pairs of one component are left out, and those whose sizes differ too much.
    """
    picked = F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node", "n", "label")
    ends = rows.groupBy("tile").agg(F.min(picked).alias("lo"), F.max(picked).alias("hi"))
    one, two = F.struct("node", "n"), F.struct("end.node", "end.n")
    alike = (F.col("n") * den >= F.col("end.n") * num) & (F.col("end.n") * den >= F.col("n") * num)
    return (
        rows.join(ends, "tile")
        .select("node", "n", "label", F.explode(F.array("lo", "hi")).alias("end"))
        .filter(F.col("label") != F.col("end.label"))
        .filter(alike)
        .select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b"))
        .select(
            F.col("a.node").alias("a"),
            F.col("b.node").alias("b"),
            F.col("a.n").alias("n"),
            F.col("b.n").alias("m"),
        )
        .distinct()
    )


def _across(rows: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """Pairs of different components among the rows of `_mixed` that their bitmaps allow."""
    mine = rows.groupBy("node").agg(
        F.slice(F.sort_array(F.collect_list("tile")), 1, FIRST_TILES).alias("mine")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (
        rows.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
        .select("tile", "node", "n", "label", "block", other)
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .join(sets.rows.select("node", "bits").join(mine, "node"), "node")
        .repartition("tile", "low", "high")
        .sortWithinPartitions("tile", "low", "high")
        .mapInArrow(_block_pairs(num, den), PAIR_DDL)
        .distinct()
    )


def ngram_join(assets: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Components of assets whose shingle sets have a Jaccard similarity of num/den or more.

    assets: `asset_id`, `text`; other columns are ignored. Words stand between white space, A-Z
    lower-cased; a set holds the distinct shingles of `size` words, or the whole sequence where
    there are fewer. Two assets are linked when den * intersection >= num * union.

    Returns one row per input row: `asset_id`, `n_shingles`, `component_id` (the smallest
    asset_id reachable by links, its own included).

    Without words or text: no shingles, linked with nothing. Null id: behind all others; its
    component is null where it reaches no id. Rows that repeat an id are separate assets of that
    id. Empty table: no rows. Shingles and sets are told apart by 64-bit hashes.
    """
    spark = assets.sparkSession
    shards = partitions(spark)
    docs = assets.select(
        F.coalesce(F.col("asset_id").cast("long"), F.lit(NO_ID)).alias("asset_id"),
        text_bytes(F.col("text")).alias("text"),
    ).withColumn("row_key", F.xxhash64("asset_id", "text"))
    batches = dealt(docs, "asset_id", "text")
    asked = batches.applyInArrow(lean(_ask(size, num, den, shards)), REQUEST)
    answers = combine(asked, "sum", "uint8")
    held = settled(
        batches.cogroup(answers.groupBy("batch")).applyInArrow(lean(_emit(size, num, den)), SETS_DDL),
        "sets",
    )
    sets = Sets(docs, held, size)
    tiles = sets.rows.select("node", "n", F.explode("tiles").alias("tile"))
    held_by = tiles.groupBy("tile").agg(F.count("*").alias("held")).filter("held > 1")
    tiles = settled(tiles.join(held_by, "tile").withColumn("label", F.col("node")), "tiles")
    links, rows = None, tiles
    for turn in range(TURNS):
        close = _close(_to_two(rows, turn, num, den), sets, num, den)
        new = _linked(close, sets, num, den)
        links = settled(links.unionByName(new) if links else new, "tile-links")
        labels = components(links)
        rows = _mixed(tiles.drop("label"), labels)
        if rows.isEmpty():
            break
    else:
        across = settled(_across(rows, sets, num, den), "tile-pairs")
        labels = components(links.unionByName(_linked(across, sets, num, den)))
    first = (
        sets.firsts.select("node", "first_id")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    least = first.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found_ = first.join(least, "label").select("node", "component_id")
    own = F.when(F.col("n") == 0, F.col("asset_id")).otherwise(F.array_min("ids"))
    real = lambda c: F.when(c != NO_ID, c)
    return (
        held.select("node", "ids", "n", F.explode("ids").alias("asset_id"))
        .join(found_, "node", "left")
        .select(
            real(F.col("asset_id")).alias("asset_id"),
            F.col("n").alias("n_shingles"),
            real(F.coalesce(F.col("component_id"), own)).alias("component_id"),
        )
    )
