"""Arithmetic on scan lines, a batch of them at a time.

Each function takes columns of a batch as Arrow arrays and gives partial sums, which Spark adds up.
Lines of one shape are stacked and measured together. Samples may come as ARRAY<INT> or, packed,
as BINARY with one byte a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import constants as K

#: Partial sums of a strip.
QUALITY = T.StructType().add("score", "double").add("tiles", "long")
QUALITY.add("squares", "long").add("samples", "long")
EDGES = T.StructType().add("total", "double").add("n", "long")

WEIGHTS = (K.LUMA_R, K.LUMA_G, K.LUMA_B)
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
#: Colours of a bucket of the 24-bit colour space, one bit each: what Spark's bitmaps hold.
BUCKET = 1 << 15
#: Up to so many pixels the colours of an image take less room one by one than as bitmaps.
FEW_PIXELS = 4096


def flat(samples: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all samples, first sample of each row and the end)."""
    if pa.types.is_binary(samples.type):
        sizes = pc.fill_null(pc.binary_length(samples), 0).to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(samples.drop_null().to_pylist()), np.uint8)
    else:
        sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy(zero_copy_only=False)
        values = samples.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def lines_of(strips: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all samples, first sample of each strip and the end, lines of each strip)."""
    count = pc.fill_null(pc.list_value_length(strips), 0).to_numpy(zero_copy_only=False)
    values, at = flat(strips.flatten())
    return values, at[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])], count


def shapes(*columns: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Rows that agree in all columns, together: (values, row numbers)."""
    if len(columns[0]):
        kinds, of = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        for kind, rows in zip(kinds.tolist(), np.split(order, np.cumsum(np.bincount(of))[:-1])):
            yield tuple(kind), rows


def stacked(values: np.ndarray, at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Samples of rows of one size, a row each."""
    return values[at[rows][:, None] + np.arange(size)]


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def half_up(values: np.ndarray) -> np.ndarray:
    return np.floor(values + 0.5)


def flattened(rgba: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """RGBA pixels (..., 4) on an opaque background."""
    share = rgba[..., 3:] / 255.0
    mixed = half_up(rgba[..., :3] * share + np.array(background) * (1 - share))
    return np.concatenate([mixed, np.full_like(mixed[..., :1], 255)], -1)


def grey(samples: np.ndarray, channels: int) -> np.ndarray:
    """Luma of (..., width * channels)."""
    if channels == 1:
        return samples.astype(np.float64)
    pixels = samples.reshape(*samples.shape[:-1], -1, channels)
    r, g, b = (pixels[..., k] * w for k, w in enumerate(WEIGHTS))
    return r + g + b


@arrow_udf(T.BinaryType())
def packed(samples: pa.Array) -> pa.Array:
    """One byte a sample."""
    values, at = flat(samples)
    data = pa.py_buffer(values.astype(np.uint8).tobytes())
    offsets = pa.py_buffer(at.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(samples), [None, offsets, data])


@arrow_udf(T.LongType())
def squared_errors(original: pa.Array, output: pa.Array) -> pa.Array:
    """Sum of squared differences of two lines; 0 where their lengths differ."""
    a, at = flat(original)
    b, bt = flat(output)
    size = np.diff(at)
    out = np.zeros(len(size), np.int64)
    for (n, m), rows in shapes(size, np.diff(bt)):
        if n == m:
            d = stacked(a, at, rows, n).astype(np.int64) - stacked(b, bt, rows, n)
            out[rows] = (d * d).sum(1)
    return pa.array(out)


def strip_quality(window: int, background: tuple[int, int, int]):
    """Of strips of up to `window` lines of both sides: (score, tiles, squares, samples).

    score: sum of the structural similarities of the strip's tiles (Wang et al. 2004; K1 = 0.01,
    K2 = 0.03, L = 255), with moments over the pixels of a tile. Originals marked `flatten` are
    put on the background first. Strips whose sides differ in size score 0.
    """

    @arrow_udf(QUALITY)
    def measure(
        channels: pa.Array, width: pa.Array, flatten: pa.Array, original: pa.Array, output: pa.Array
    ) -> pa.Array:
        (a, at, lines), (b, bt, others) = lines_of(original), lines_of(output)
        n = len(lines)
        score, tiles, squares = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        size = np.diff(at)
        kinds = shapes(ints(channels), ints(width), ints(flatten), lines, others, size, np.diff(bt))
        for (c, w, on_background, k, k2, s, s2), rows in kinds:
            columns = -(-w // window)
            tiles[rows] = columns
            if k != k2 or s != s2 or s != k * w * c:
                continue
            x = stacked(a, at, rows, s).astype(np.int64)
            y = stacked(b, bt, rows, s).astype(np.int64)
            if on_background and c == 4:
                x = flattened(x.reshape(len(rows), -1, 4), background).reshape(x.shape)
                x = x.astype(np.int64)
            squares[rows] = ((x - y) ** 2).sum(1)
            # sums over the lines of a strip, then over the columns of a tile
            p = grey(x.reshape(len(rows), k, w * c), c)
            q = grey(y.reshape(len(rows), k, w * c), c)
            start = np.arange(0, w, window)
            m = np.minimum(start + window, w) - start

            def mean(v: np.ndarray) -> np.ndarray:
                return np.add.reduceat(v.sum(1), start, axis=1) / (k * m)

            mx, my = mean(p), mean(q)
            vx, vy, cov = mean(p * p) - mx * mx, mean(q * q) - my * my, mean(p * q) - mx * my
            value = (2 * mx * my + C1) * (2 * cov + C2) / ((mx * mx + my * my + C1) * (vx + vy + C2))
            score[rows] = value.sum(1)
        return pa.StructArray.from_arrays(
            [pa.array(v) for v in (score, tiles, squares, size)],
            names=["score", "tiles", "squares", "samples"],
        )

    return measure


@arrow_udf(EDGES)
def strip_edges(channels: pa.Array, width: pa.Array, lines: pa.Array) -> pa.Array:
    """Sobel magnitudes of strips of consecutive lines: (sum, pixels).

    Measured are the lines between the first and the last, without the border columns.
    """
    values, at, count = lines_of(lines)
    total, n = np.zeros(len(count)), np.zeros(len(count), np.int64)
    for (c, w, k), rows in shapes(ints(channels), ints(width), count):
        if k < 3 or w < 3:
            continue
        # Grey is kept in single precision, as measured; the gradient is taken in double.
        lines_ = stacked(values, at, rows, k * w * c).reshape(len(rows), k, w * c)
        v = grey(lines_, c).astype(np.float32).astype(np.float64)
        up, mid, down = v[:, :-2], v[:, 1:-1], v[:, 2:]
        gx = (
            up[..., 2:] + 2 * mid[..., 2:] + down[..., 2:]
            - up[..., :-2] - 2 * mid[..., :-2] - down[..., :-2]
        )
        gy = (
            down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:]
            - up[..., :-2] - 2 * up[..., 1:-1] - up[..., 2:]
        )
        total[rows] = np.sqrt(gx * gx + gy * gy).sum((1, 2))
        n[rows] = (k - 2) * (w - 2)
    return pa.StructArray.from_arrays([pa.array(total), pa.array(n)], names=["total", "n"])


def _rows(values: list[np.ndarray], order: list[np.ndarray], n: int, kind: pa.DataType) -> pa.Array:
    """A list array of n rows from blocks of equally long rows and their numbers."""
    sizes = np.zeros(n, np.int64)
    for block, rows in zip(values, order):
        sizes[rows] = block.shape[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], kind.to_pandas_dtype())
    for block, rows in zip(values, order):
        out[at[rows][:, None] + np.arange(block.shape[1])] = block
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out, kind))


@arrow_udf(T.ArrayType(T.DoubleType()))
def resampled(samples: pa.Array, width: pa.Array, channels: pa.Array, target: pa.Array) -> pa.Array:
    """Lines brought to `target` pixels: source = x * scale, the right neighbour clamped."""
    values, at = flat(samples)
    blocks, order = [], []
    for (w, c, t, size), rows in shapes(ints(width), ints(channels), ints(target), np.diff(at)):
        line = stacked(values, at, rows, size).reshape(len(rows), w, c).astype(np.float64)
        source = np.arange(t) * (w / float(t))
        x0 = np.floor(source).astype(np.int64)
        x1, share = np.minimum(x0 + 1, w - 1), (source - x0)[:, None]
        blocks.append((line[:, x0] * (1 - share) + line[:, x1] * share).reshape(len(rows), t * c))
        order.append(rows)
    return _rows(blocks, order, len(samples), pa.float64())


def _mixed(top: pa.Array, bottom: pa.Array, share: pa.Array, whole: bool) -> pa.Array:
    a, at = flat(top)
    b, bt = flat(bottom)
    fy = share.to_numpy(zero_copy_only=False).astype(np.float64)
    blocks, order = [], []
    for (n, _), rows in shapes(np.diff(at), np.diff(bt)):
        f = fy[rows][:, None]
        block = stacked(a, at, rows, n) * (1 - f) + stacked(b, bt, rows, n) * f
        blocks.append(half_up(block).astype(np.int32) if whole else block)
        order.append(rows)
    return _rows(blocks, order, len(top), pa.int32() if whole else pa.float64())


@arrow_udf(T.ArrayType(T.DoubleType()))
def mixed(top: pa.Array, bottom: pa.Array, share: pa.Array) -> pa.Array:
    """Lines between two others, `share` of the way down."""
    return _mixed(top, bottom, share, whole=False)


@arrow_udf(T.ArrayType(T.IntegerType()))
def mixed_whole(top: pa.Array, bottom: pa.Array, share: pa.Array) -> pa.Array:
    """`mixed`, rounded half up."""
    return _mixed(top, bottom, share, whole=True)


# Colours ------------------------------------------------------------------------------------

#: Parts of the colours of an image, as `colour_parts` gives them; the type of ids comes first.
PARTS = (
    "kind string, bucket int, bits binary, few array<int>, "
    "luma array<struct<luma: int, n: bigint>>, clear boolean"
)
RAW, FLAT = "raw", "flat"
_LUMA = pa.struct([("luma", pa.int32()), ("n", pa.int64())])


def _part(ids: pa.Array, image: np.ndarray, kind: str, clear: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows of PARTS for images of a batch; columns that are not given are null."""
    n = len(image)
    types = {"bucket": pa.int32(), "bits": pa.binary(), "few": pa.list_(pa.int32()), "luma": pa.list_(_LUMA)}
    out = {"asset_id": ids.take(pa.array(image)), "kind": pa.array([kind] * n, pa.string())}
    for name, type_ in types.items():
        out[name] = columns.get(name, pa.nulls(n, type_))
    return pa.record_batch(out | {"clear": pa.array(clear[image])})


def _runs(groups: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values that ascend by group as one list for each of n groups."""
    at = np.searchsorted(groups, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def _bitmaps(image: np.ndarray, rgb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(image, bucket, bits) of distinct colours, a bounded number of bitmaps at a time."""
    buckets, row = np.unique(image << 9 | rgb // BUCKET, return_inverse=True)
    for a in range(0, len(buckets), 4096):
        some, part = buckets[a : a + 4096], (row >= a) & (row < a + 4096)
        bits, at = np.zeros((len(some), BUCKET // 8), np.uint8), rgb[part] % BUCKET
        np.bitwise_or.at(bits, (row[part] - a, at // 8), (1 << (at % 8)).astype(np.uint8))
        yield some >> 9, some & 511, pa.array([b.tobytes() for b in bits], pa.binary())


def colour_parts(cap: int | None, background: tuple[int, int, int] | None):
    """A function for mapInArrow from lines to the colours and luma counts of each batch.

    Per image of a batch: its distinct colours (`raw`) with its luma histogram, and those on the
    background (`flat`), if one is given. Colours come as one list for images of up to FEW_PIXELS
    pixels, else as bitmaps, one row a bucket of the colour space. `clear` tells whether the
    image has a transparent pixel. With `cap`, only positions 0, step, 2 * step, ... count.
    """

    def pixels(batch: pa.RecordBatch, image: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(RGBA of each pixel that counts, its image)."""
        values, at = flat(batch["samples"])
        w, c, y = (ints(batch[name]) for name in ("width", "channels", "y"))
        found, of = [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)]
        for (width, channels), lines in shapes(w, c):
            line = stacked(values, at, lines, width * channels).reshape(-1, channels)
            if channels == 1:
                line = np.concatenate([line] * 3 + [np.full_like(line, 255)], -1)
            owner = np.repeat(image[lines], width)
            if cap is not None:
                step = np.maximum(1, -(-area[owner] // cap))
                place = (y[lines][:, None] * width + np.arange(width)).reshape(-1)
                line, owner = line[place % step == 0], owner[place % step == 0]
            found.append(line.astype(np.int64))
            of.append(owner)
        return np.concatenate(found), np.concatenate(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["asset_id"].dictionary_encode(null_encoding="encode")
            image, ids = ints(ids.indices), ids.dictionary
            n = len(ids)
            area, clear = np.zeros(n, np.int64), np.zeros(n, bool)
            area[image] = ints(batch["width"]) * ints(batch["height"])
            rgba, of = pixels(batch, image, area)
            clear[of[rgba[:, 3] < 255]] = True
            luma = np.minimum(255, half_up(grey(rgba[:, :3], 3)[:, 0])).astype(np.int64)
            bins, count = np.unique(of << 8 | luma, return_counts=True)
            bars = pa.StructArray.from_arrays(
                [pa.array(bins & 255, pa.int32()), pa.array(count, pa.int64())], fields=list(_LUMA)
            )
            sides = {RAW: rgba}
            if background is not None:
                sides[FLAT] = flattened(rgba, background).astype(np.int64)
            for kind, side in sides.items():
                key = np.unique(of << 24 | side[:, 0] << 16 | side[:, 1] << 8 | side[:, 2])
                owner, rgb = key >> 24, key & 0xFFFFFF
                few = area[owner] <= FEW_PIXELS
                columns = {"few": _runs(owner[few], n, pa.array(rgb[few], pa.int32()))}
                if kind == RAW:
                    columns["luma"] = _runs(bins >> 8, n, bars)
                yield _part(ids, np.arange(n), kind, clear, **columns)
                for big, bucket, bits in _bitmaps(owner[~few], rgb[~few]):
                    yield _part(ids, big, kind, clear, bucket=pa.array(bucket, pa.int32()), bits=bits)

    return run
