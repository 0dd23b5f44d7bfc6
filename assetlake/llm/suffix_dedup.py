"""Removal of repeated passages by prefix doubling over suffix positions.

A position's rank names the bytes that follow it. Ranks are refined at growing offsets, and a
position is dropped as soon as its rank is unique, since no longer string from there can repeat:

1. 16 bytes. Only a sample of positions needs a rank here: those with the smallest rank of some
   50-byte window (its anchor). Equal windows have equal anchors at equal places, so windows of
   an anchor whose rank is unique to one asset cannot repeat.
2. All bytes around an anchor that its windows reach. Where a smaller asset has the same, all
   windows of the anchor repeat; where every anchor of this rank has the same, none of the
   smallest asset's need another look.
3. The anchor with half of what its windows reach before it, and with half of that behind it:
   each window holds one of the two.
4. The threshold itself, 50 bytes: every window that is left, those that other windows cover
   whole included, since a larger asset may hold them alone.

Ranks are 64-bit names (equality is all that is asked of them). Each round shuffles the distinct
keys of a batch of assets, with the smallest id that holds them, and answers only keys that are
still shared; see key exchange in `common`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import (
    MULTIPLIER,
    REQUEST,
    answered,
    chunks,
    combine,
    dealt,
    found,
    lean,
    note,
    notes_of,
    ordered_ids,
    partitions,
    requests,
    rows_of,
    scrambled,
    text_bytes,
)

ANCHOR = 16
LENGTH = 50
#: Bytes of texts whose hashes are held at once: some dozen arrays of 8 bytes each.
STREAM_BYTES = 1 << 17
#: Keep keys of an anchor, its surroundings and its halves apart.
AROUND, BEFORE, BEHIND = (
    np.uint64(k) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
)

NOTHING = pa.schema(
    [("shard", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())]
)

KEPT = pa.schema(
    [
        ("asset_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept", pa.binary()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]
)
KEPT_DDL = (
    "asset_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
    "spans array<struct<start:long,length:long>>"
)


class Stream:
    """Bytes of several texts in a row, `length` zeros between them; text bytes count from 1."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, length: int):
        gap = b"\0" * length
        self.length = length
        sizes = np.array([len(t) for t in texts])
        self.starts = length + np.cumsum(np.r_[0, sizes[:-1] + length])
        self.ends = self.starts + sizes
        raw = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
        self.bytes = raw.astype(np.uint64) + np.uint64(1)
        for a, b in zip(np.r_[0, self.ends], np.r_[self.starts, len(raw)], strict=True):
            self.bytes[a:b] = 0
        self.text_ids = ids
        self._hashes = {1: (self.bytes, int(MULTIPLIER))}

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the n bytes from each position on, by doubling."""
        size = 1
        while size * 2 <= n:
            if size * 2 not in self._hashes:
                h, power = self._hashes[size]
                doubled = h[:-size] * np.uint64(power) + h[size:]
                self._hashes[size * 2] = (doubled, power * power % (1 << 64))
            size *= 2
        out, done = None, 0
        while size:
            if n - done >= size:
                h, power = self._hashes[size]
                if out is None:
                    out = h
                else:
                    end = min(len(out), len(h) - done)
                    out = out[:end] * np.uint64(power) + h[done : done + end]
                done += size
            size //= 2
        return scrambled(out[: len(self.bytes) - n + 1] + np.uint64(n))

    def windows(self) -> np.ndarray:
        """Whether a whole window of one text starts at each position."""
        valid = np.zeros(len(self.bytes), bool)
        for a, b in zip(self.starts, self.ends, strict=True):
            valid[a : max(a, b - self.length + 1)] = True
        return valid

    def ids_at(self, positions: np.ndarray) -> np.ndarray:
        return self.text_ids[self.text_of(positions)]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _sampled(stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranks of all positions, smallest rank of the window at each, sampled positions)."""
    ranks = stream.hashes(ANCHOR)
    width = stream.length - ANCHOR + 1
    least = _sliding(ranks, width, np.minimum)
    least = np.where(stream.windows()[: len(least)], least, 0)
    edge = np.zeros(width - 1, np.uint64)
    reached = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    return ranks, least, np.flatnonzero(reached == ranks)


def _anchored(stream: Stream, live: Lookup):
    """Windows whose anchor's rank is among `live`.

    (window starts, number of the anchor of each, anchor positions, their ranks)
    """
    ranks, least, sampled = _sampled(stream)
    starts = np.flatnonzero(stream.windows()[: len(least)])
    starts = starts[live.holds(least[starts])]
    least = least[starts]
    number = np.searchsorted(sampled, starts)
    wrong = np.flatnonzero(ranks[sampled[number]] != least)
    while len(wrong):  # the first sampled position with the smallest rank
        number[wrong] += 1
        wrong = wrong[ranks[sampled[number[wrong]]] != least[wrong]]
    used, number = np.unique(number, return_inverse=True)
    return starts, number, sampled[used], ranks[sampled[used]]


class Lookup:
    """A sorted array, and a bitmap that spares most of the search in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(10, (8 * len(keys)).bit_length())) - 1)
        self.bitmap = np.zeros(int(self.mask) + 1, bool)
        self.bitmap[keys & self.mask] = True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bitmap[keys & self.mask])
        out = np.zeros(len(keys), bool)
        out[maybe] = found(keys[maybe], self.keys)[0]
        return out


def _sorted_rows(table: pa.Table) -> pa.Table:
    """The same order in every round, so that notes may name texts by their place."""
    return table.sort_by([("asset_id", "ascending"), ("text", "ascending")])


def _streams(table: pa.Table, length: int):
    texts, ids = table["text"].to_pylist(), ordered_ids(table["asset_id"])
    for a, b in chunks(texts, STREAM_BYTES):
        yield a, Stream(texts[a:b], ids[a:b], length)


def _first_ranks(length: int, shards: int):
    def ask(table: pa.Table) -> pa.Table:
        batch, table = rows_of(table)
        keys, ids = [], []
        for _, stream in _streams(table, length):
            ranks, _, sampled = _sampled(stream)
            keys.append(ranks[sampled])
            ids.append(stream.ids_at(sampled))
        keys, _ = _extremes(np.concatenate(keys), np.concatenate(ids))
        keys, holders = np.unique(keys, return_counts=True)
        return requests(batch, keys, holders.astype(np.uint8), shards)

    return ask


def _surroundings(stream: Stream, anchors: np.ndarray) -> np.ndarray:
    reach = stream.length - ANCHOR
    return stream.hashes(stream.length + reach)[anchors - reach] ^ AROUND


def _halves(stream: Stream, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of each anchor with the bytes before it, and with those behind it.

    Half of what a window has besides its anchor: each window holds one of the two.
    """
    half = (stream.length - ANCHOR + 1) // 2
    ranks = stream.hashes(ANCHOR + half)
    return ranks[anchors - half] ^ BEFORE, ranks[anchors] ^ BEHIND


def _second_ranks(length: int, shards: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return NOTHING.empty_table()
        batch, docs = rows_of(docs)
        live = Lookup(answered(answers, "uint8")[0])
        keys, vals = [], []
        for _, stream in _streams(docs, length):
            _, _, anchors, ranks = _anchored(stream, live)
            around = _surroundings(stream, anchors)
            for k, v in (_extremes(around, stream.ids_at(anchors)), _extremes(ranks, around)):
                keys.append(k)
                vals.append(v)
        keys, vals = _extremes(np.concatenate(keys), np.concatenate(vals))
        return requests(batch, keys, vals, shards)

    return ask


def _third_ranks(length: int, shards: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return NOTHING.empty_table()
        batch, docs = rows_of(docs)
        docs = _sorted_rows(docs)
        shared, least = answered(answers)
        asked = Lookup(shared)
        keys, vals, spans = [], [], []
        for first, stream in _streams(docs, length):
            ranks, _, sampled = _sampled(stream)
            live = np.unique(ranks[sampled][asked.holds(ranks[sampled])])
            around = _surroundings(stream, sampled)
            live = np.union1d(live, ranks[sampled][asked.holds(around)])
            starts, number, anchors, ranks = _anchored(stream, Lookup(live))
            around = _surroundings(stream, anchors)
            known, at = found(around, shared)
            repeated = known & (least[at] < stream.ids_at(anchors))
            spans.append(_runs(stream, starts[repeated[number]], first))
            left = found(ranks, shared)[0] & ~repeated
            for half in _halves(stream, anchors[left]):
                k, v = _extremes(half, around[left])
                keys.append(k)
                vals.append(v)
        keys, vals = _extremes(np.concatenate(keys), np.concatenate(vals))
        return pa.concat_tables(
            [
                requests(batch, keys, vals, shards),
                note(batch, shards, np.concatenate(spans).tobytes()),
            ]
        )

    return ask


def _fourth_ranks(length: int, shards: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return NOTHING.empty_table()
        batch, docs = rows_of(docs)
        docs = _sorted_rows(docs)
        asked = Lookup(answered(answers)[0])
        spans = _spans_of(answers)
        keys, vals = [], []
        half = (length - ANCHOR + 1) // 2
        for first, stream in _streams(docs, length):
            ranks, _, sampled = _sampled(stream)
            before, behind = _halves(stream, sampled)
            live = ranks[sampled][asked.holds(before) | asked.holds(behind)]
            starts, number, anchors, _ = _anchored(stream, Lookup(np.unique(live)))
            before, behind = map(asked.holds, _halves(stream, anchors))
            early = starts <= anchors[number] - half
            late = starts + length >= anchors[number] + ANCHOR + half
            starts = starts[(early & before[number]) | (late & behind[number])]
            # a window that others cover may still be the source of one elsewhere; of one that
            # is known to repeat, the smallest asset with its surroundings asks
            starts = starts[~_known(stream, spans, first)[starts]]
            k, v = _extremes(stream.hashes(length)[starts], stream.ids_at(starts))
            keys.append(k)
            vals.append(v)
        keys, vals = _extremes(np.concatenate(keys), np.concatenate(vals))
        return pa.concat_tables(
            [requests(batch, keys, vals, shards), note(batch, shards, spans.tobytes())]
        )

    return ask


def _spans_of(answers: pa.Table) -> np.ndarray:
    """Rows (number of the text, begin, end) of a batch's note, by text."""
    spans = np.frombuffer(b"".join(notes_of(answers)), np.int64).reshape(-1, 3)
    return spans[np.argsort(spans[:, 0], kind="stable")]


def _edges(stream: Stream, spans: np.ndarray, first: int, less: int) -> np.ndarray:
    """1 where a span begins and -1 where it ends, `less` bytes before its end."""
    edges = np.zeros(len(stream.bytes) + 1, np.int32)
    a, b = np.searchsorted(spans[:, 0], [first, first + len(stream.starts)])
    offset = stream.starts[spans[a:b, 0] - first]
    np.add.at(edges, offset + spans[a:b, 1], 1)
    np.add.at(edges, offset + spans[a:b, 2] - less, -1)
    return edges


def _known(stream: Stream, spans: np.ndarray, first: int) -> np.ndarray:
    """Whether the window at each byte is one of those that the spans were made of."""
    return np.cumsum(_edges(stream, spans, first, stream.length - 1)[:-1]) > 0


def _gone(stream: Stream, spans: np.ndarray, first: int, starts: np.ndarray) -> np.ndarray:
    """Whether each byte is covered by the spans or by a window at `starts`."""
    edges = _edges(stream, spans, first, 0)
    if len(starts):
        edges[starts] += 1
        edges[starts + stream.length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _runs(stream: Stream, starts: np.ndarray, first: int) -> np.ndarray:
    """Rows (number of the text, begin, end) covered by each run of windows at adjacent starts."""
    if not len(starts):
        return np.empty((0, 3), np.int64)
    apart = np.flatnonzero(np.diff(starts) > 1)
    begin = starts[np.r_[0, apart + 1]]
    end = starts[np.r_[apart, len(starts) - 1]] + stream.length
    # windows of two texts are never closer than the gap between the texts
    text = stream.text_of(begin)
    return np.stack((text + first, begin - stream.starts[text], end - stream.starts[text]), 1)


def _removed(length: int, nothing: pa.Table):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return nothing
        _, docs = rows_of(docs)
        docs = _sorted_rows(docs)
        shared, least = answered(answers)
        asked = Lookup(shared)
        spans = _spans_of(answers)
        sizes, kept, counts, begins, ends = [], [], [], [], []
        for first, stream in _streams(docs, length):
            starts = np.flatnonzero(stream.windows())
            names = stream.hashes(length)[starts]
            hit = asked.holds(names)
            starts, names = starts[hit], names[hit]
            starts = starts[least[found(names, shared)[1]] < stream.ids_at(starts)]
            gone = _gone(stream, spans, first, starts)
            change = np.diff(np.r_[False, gone, False].astype(np.int8))
            begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            text = stream.text_of(begin)
            counts.append(np.bincount(text, minlength=len(stream.starts)))
            begins.append(begin - stream.starts[text])
            ends.append(end - stream.starts[text])
            for s, e in zip(stream.starts, stream.ends, strict=True):
                own_bytes = (stream.bytes[s:e] - np.uint64(1)).astype(np.uint8)
                kept.append(own_bytes[~gone[s:e]].tobytes())
                sizes.append(e - s)
        counts, begins, ends = map(np.concatenate, (counts, begins, ends))
        sizes = np.array(sizes, np.int64)
        spans = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(counts)], pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64())],
                ["start", "length"],
            ),
        )
        out = pa.table(
            [
                docs["asset_id"],
                pa.array(sizes),
                pa.array(sizes - np.array([len(k) for k in kept])),
                pa.array(counts, pa.int64()),
                pa.array(kept, pa.binary()),
                spans,
            ],
            schema=KEPT,
        )
        return out.append_column("carried", docs["carried"])

    return remove


def _extremes(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their smallest value, and again with the largest where that differs."""
    order = np.lexsort((vals, keys))
    keys, vals = keys[order], vals[order]
    if not len(keys):
        return keys, vals
    new = np.r_[True, keys[1:] != keys[:-1]]
    last = np.r_[new[1:], True]
    start = np.flatnonzero(new)
    differs = vals[start] != vals[last]
    return (
        np.concatenate((keys[start], keys[last][differs])),
        np.concatenate((vals[start], vals[last][differs])),
    )


def remove_repeats(
    assets: DataFrame, length: int = LENGTH, carry: Sequence[str] = ()
) -> DataFrame:
    """Cut what assets with a smaller id already say, byte for byte.

    assets: `asset_id`, `text`; of other columns, those in `carry` are returned. A byte goes if some `length`-byte
    string covers it that also starts in the text of an asset with a smaller id. Strings are
    judged on the input and never cross assets.

    Returns one row per input row: `asset_id`, `n_bytes`, `n_removed`, `n_spans` (maximal removed
    runs), `kept` (remaining bytes, joined), `spans` (start and length of each removed run) and
    `carried` (a struct of the columns in `carry`; an empty one is null).

    Null text counts as empty; texts under `length` bytes stay. A null id sorts behind all others.
    Repeated rows have the same id and so take nothing from each other. Empty table: no rows.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    shards = partitions(assets.sparkSession)
    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    rows = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        text_bytes(F.col("text")).alias("text"),
        carried.alias("carried"),
    )
    kind = rows.schema["carried"].dataType
    docs = dealt(rows, "asset_id", "text")
    answers = combine(docs.applyInArrow(lean(_first_ranks(length, shards)), REQUEST), "sum", "uint8")
    for ranks in (_second_ranks, _third_ranks, _fourth_ranks):
        groups = docs.cogroup(answers.groupBy("batch"))
        asked = groups.applyInArrow(lean(ranks(length, shards)), REQUEST)
        answers = combine(asked, "min", "uint64")
    nothing = KEPT.append(pa.field("carried", to_arrow_type(kind))).empty_table()
    schema = T.StructType([*T.StructType.fromDDL(KEPT_DDL), T.StructField("carried", kind)])
    removed = lean(_removed(length, nothing))
    return docs.cogroup(answers.groupBy("batch")).applyInArrow(removed, schema)
