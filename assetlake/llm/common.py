"""Shared helpers: durable tables, words, hashes, held-out folds and key exchange.

Records are the library's assets: `asset_id` (BIGINT), `text` (the markup or caption text of the
asset, STRING), `batch_id` (the batch the asset came in with, STRING).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, functions as F

from ..plans.session import new_shared_path

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit to a blank.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SIGN = np.uint64(1 << 63)
#: Narrow rows (two keys) that may be broadcast: about 20 MB.
BROADCAST_ROWS = 200_000
#: An asset without an id sorts behind every other.
NO_ID = np.iinfo(np.int64).max


_scopes: list[list[str]] = []


def settled(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder once and read back, so that no later job runs `df` again.

    Within `scratch` the table goes at the end of the block, unless it is to `keep`.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `settled` wrote within the block; nothing later may read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast narrow rows, if they are no more than `rows`; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(asset_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false where the id is null."""
    code = F.crc32(asset_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(code, F.lit(modulus)) == remainder, F.lit(False))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all other non-ASCII characters."""
    return text.translate(ALNUM).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that any bits of the result may pick a shard."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, order: int) -> np.ndarray:
    """One hash for each run of `order` consecutive words."""
    n = max(0, len(hashes) - order + 1)
    out = np.full(n, np.uint64(order))
    for k in range(order):
        out = scrambled(out * MULTIPLIER + hashes[k : k + n])
    return out


def ordered_ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as uint64 that sort like the signed ids; a null id sorts last."""
    return column.fill_null(NO_ID).to_numpy().astype(np.int64).view(np.uint64) ^ SIGN


def give_back() -> None:
    """Return what a Python worker has freed to the machine; workers live through many tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable) -> Callable:
    """f of one or two groups, for applyInArrow; what it has freed is given back when it is done,
    not when the worker gets its next group: idle workers would hold it beside those that run."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            give_back()

    return one if f.__code__.co_argcount == 1 else two


# Key exchange -------------------------------------------------------------------------------
#
# Assets are dealt into batches by a hash of their id, as compressed blobs of rows. A batch asks
# about the distinct keys of its texts (n-grams, signatures, windows), each with a value that it
# has already added up, so a key that a third of all assets hold is asked once per batch. Shards,
# dealt by key hash, combine the values of all batches and answer every batch that asked. Both
# ways the keys of one batch for one shard travel as a single row of packed arrays.

DEALT = "batch int, rows binary"
REQUEST = "shard int, batch int, keys binary, vals binary"
ANSWER = "batch int, shard int, keys binary, vals binary"
#: Bytes of rows that a task holds before it sends them to their batches.
DEAL_BYTES = 1 << 24


def _deal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by("batch")
        batches, start = np.unique(table["batch"].to_numpy(), return_index=True)
        ends = np.append(start[1:], table.num_rows)
        table = table.drop_columns(["batch"])
        for batch, a, b in zip(batches, start, ends, strict=True):
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.slice(a, b - a))
            blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.record_batch({"batch": pa.array([batch], pa.int32()), "rows": blob})

    for table in tables:
        held.append(table)
        size += table.nbytes
        if size > DEAL_BYTES:
            yield from flush()
            held, size = [], 0
            give_back()
    if sum(t.num_rows for t in held):
        yield from flush()
    held = []
    give_back()


def dealt(df: DataFrame, *identity: str) -> GroupedData:
    """The rows by batch, as many as shuffle partitions; read them with `rows_of`."""
    count = F.lit(partitions(df.sparkSession))
    batch = F.pmod(F.xxhash64(*identity), count).cast("int")
    return df.withColumn("batch", batch).mapInArrow(_deal, DEALT).groupBy("batch")


def rows_of(table: pa.Table) -> tuple[int, pa.Table]:
    """(number of the batch, its rows) from one group of `dealt`."""
    give_back()
    parts = [pa.ipc.open_stream(blob).read_all() for blob in table["rows"].to_pylist()]
    return table["batch"][0].as_py(), pa.concat_tables(parts).combine_chunks()


def _planes(a: np.ndarray) -> bytes:
    """Byte planes one after the other, each by itself behind its length: what values have in
    common compresses well, and the high bytes of differences have few values."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    packed = [pa.compress(plane.tobytes(), "zstd", asbytes=True) for plane in planes]
    kept = [p if len(p) < len(a) else plane.tobytes() for p, plane in zip(packed, planes, strict=True)]
    return np.array([len(a), *map(len, kept)], np.int64).tobytes() + b"".join(kept)


def unpack_values(blob: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    count, *sizes = np.frombuffer(blob, np.int64, width + 1).tolist()
    planes, at = np.empty((width, count), np.uint8), 8 * (width + 1)
    for plane, size in zip(planes, sizes, strict=True):
        part = blob[at : at + size]
        plain = pa.decompress(part, count, "zstd", asbytes=True) if size < count else part
        plane[:] = np.frombuffer(plain, np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sums(sums: np.ndarray) -> bytes:
    """64-bit sums in as few bytes each as the largest of them needs, behind their width."""
    largest = int(sums.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if largest < 1 << 8 * w)
    return bytes([width]) + _planes(sums.astype(f"uint{8 * width}"))


def unpack_sums(blob: bytes) -> np.ndarray:
    return unpack_values(blob[1:], f"uint{8 * blob[0]}").astype(np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_values(blob, "uint64"), dtype=np.uint64)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by shard and key, used shards, start of each used shard in that order)."""
    shard = (keys >> np.uint64(40)) % np.uint64(shards)
    order = np.lexsort((keys, shard))
    used, start = np.unique(shard[order], return_index=True)
    return order, used.astype(np.int32), start


def requests(batch: int, keys: np.ndarray, vals: np.ndarray, shards: int) -> pa.Table:
    """Rows of REQUEST; keys need not be distinct."""
    order, used, start = by_shard(keys, shards)
    keys, vals = keys[order], vals[order]
    runs = list(pairwise([*start, len(keys)]))
    return pa.table(
        {
            "shard": pa.array(used, pa.int32()),
            "batch": pa.array(np.full(len(used), batch, np.int32)),
            "keys": pa.array([pack_keys(keys[a:b]) for a, b in runs], pa.binary()),
            "vals": pa.array([_planes(vals[a:b]) for a, b in runs], pa.binary()),
        }
    )


def _answers(kind: str, dtype: str, only_many: bool) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        notes = table.filter(pc.is_null(table["vals"]))
        table = table.filter(pc.is_valid(table["vals"]))
        notes = notes.select(["batch", "shard", "keys", "vals"])
        if not table.num_rows:
            return notes
        asked = [unpack_keys(b) for b in table["keys"].to_pylist()]
        keys = np.concatenate(asked)
        vals = np.concatenate([unpack_values(b, dtype) for b in table["vals"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        ranked, given = keys[order], vals[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        start = np.flatnonzero(new)
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        if kind == "sum":
            total = np.add.reduceat(given, start, dtype=np.uint64)
            many = total > 1
            if only_many:  # who asks so wants to know of keys with more than one, not how many
                total = np.minimum(total, np.iinfo(dtype).max).astype(dtype)
        else:
            total = np.minimum.reduceat(given, start)
            many = total != np.maximum.reduceat(given, start)
        out: dict[str, list] = {"keys": [], "vals": []}
        for mine, g in zip(asked, np.split(group, np.cumsum([len(a) for a in asked])[:-1])):
            if only_many:
                mine, g = mine[many[g]], g[many[g]]
            out["keys"].append(pack_keys(mine) if only_many else None)
            out["vals"].append(_planes(total[g]) if only_many else pack_sums(total[g]))
        answers = pa.table(
            {"batch": table["batch"], "shard": table["shard"]}
            | {name: pa.array(blobs, pa.binary()) for name, blobs in out.items()}
        )
        return pa.concat_tables([answers, notes])

    return answer


def combine(asked: DataFrame, kind: str, dtype: str, only_many: bool = True) -> DataFrame:
    """Rows of ANSWER for rows of REQUEST.

    kind `sum`: the sum of all values of a key; `only_many` leaves out keys with a sum of one or
    less and lets sums end at the largest value of `dtype`. kind `min`: the smallest value;
    `only_many` leaves out keys of which all values are the same. Where all keys are answered, it
    is by whole 64-bit sums without the keys, in the order in which they were asked. A row without values is a batch's note to itself and comes back as it is.
    """
    return asked.groupBy("shard").applyInArrow(lean(_answers(kind, dtype, only_many)), ANSWER)


def answered(table: pa.Table, dtype: str = "uint64") -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, values) of the answers to one batch."""
    table = table.filter(pc.is_valid(table["vals"]))
    if not table.num_rows:
        return np.empty(0, np.uint64), np.empty(0, dtype)
    keys = np.concatenate([unpack_keys(b) for b in table["keys"].to_pylist()])
    vals = np.concatenate([unpack_values(b, dtype) for b in table["vals"].to_pylist()])
    keys, first = np.unique(keys, return_index=True)
    return keys, vals[first]


def sums_of(table: pa.Table, keys: np.ndarray, shards: int) -> np.ndarray:
    """The answered sum for each of the keys that a batch asked about, in its order."""
    order, used, _ = by_shard(keys, shards)
    table = table.sort_by("shard")
    vals = np.concatenate([unpack_sums(b) for b in table["vals"].to_pylist()])
    if table["shard"].to_pylist() != used.tolist() or len(vals) != len(keys):
        raise ValueError("a batch was answered other keys than it asked about")
    out = np.empty(len(keys), np.uint64)
    out[order] = vals
    return out


def note(batch: int, shards: int, blob: bytes) -> pa.Table:
    """A row of REQUEST that comes back to its own batch unchanged."""
    schema = {"shard": pa.int32(), "batch": pa.int32(), "keys": pa.binary(), "vals": pa.binary()}
    return pa.Table.from_pydict(
        {"shard": [batch % shards], "batch": [batch], "keys": [blob], "vals": [None]},
        pa.schema(list(schema.items())),
    )


def notes_of(table: pa.Table) -> list[bytes]:
    return table.filter(pc.is_null(table["vals"]))["keys"].to_pylist()


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is in the sorted array `among`, its place there)."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at


def chunks(texts: list[bytes], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `size` bytes; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
