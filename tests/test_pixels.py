"""Pixel measures against numpy on whole images."""

import math

import numpy as np
import pytest

from assetlake.operators import kernels as N, pixels as P

WEIGHTS = np.array([0.299, 0.587, 0.114])


def image(seed, height, width, channels=4, low=0, high=256):
    return np.random.default_rng(seed).integers(low, high, (height, width, channels))


def grids(spark, *images):
    rows = [
        (f"i{n}", im.shape[1], im.shape[0], im.shape[2], [int(v) for v in im.reshape(-1)])
        for n, im in enumerate(images)
    ]
    return spark.createDataFrame(
        rows, "asset_id string, width int, height int, channels int, samples array<int>"
    )


def values(df, column, key="asset_id"):
    return {r[key]: r[column] for r in df.collect()}


def pairs(spark):
    return spark.createDataFrame([("p", "i0", "i1")], "pair_id string, original_id string, output_id string")


def both(spark, a, b):
    lines = P.grid_lines(grids(spark, a, b))
    return P.pair_lines(P.fitted_outputs(pairs(spark), lines, lines), lines)


def luma(im):
    return im[..., 0].astype(float) if im.shape[2] == 1 else im[..., :3] @ WEIGHTS


def test_colours_entropy_and_alpha(spark):
    images = [image(1, 20, 30, high=5), image(2, 7, 9), np.full((4, 4, 4), 255)]
    pixels = P.explode_pixels(P.grid_lines(grids(spark, *images)))
    colours = values(P.unique_colors(pixels), "unique_colors")
    entropy = values(P.luma_entropy(pixels), "entropy")
    alpha = values(P.transparency(pixels), "has_alpha")
    by_line = values(P.image_facts(P.grid_lines(grids(spark, *images))), "has_alpha")
    both = {r.asset_id: r for r in P.colour_counts(pixels, (0, 0, 0)).collect()}
    flat = values(P.unique_colors(P.alpha_composite(pixels, (0, 0, 0))), "unique_colors")
    assert {k: (r.raw_colors, r.flat_colors) for k, r in both.items()} == {
        k: (colours[k], flat[k]) for k in colours
    }
    for n, im in enumerate(images):
        flat = im.reshape(-1, 4)
        assert colours[f"i{n}"] == len({tuple(p[:3]) for p in flat.tolist()})
        bins = np.bincount(np.minimum(255, np.floor(luma(im) + 0.5).astype(int)).reshape(-1))
        share = bins[bins > 0] / flat.shape[0]
        assert entropy[f"i{n}"] == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-6)
        assert 0 <= entropy[f"i{n}"] <= 8
        assert by_line[f"i{n}"] == alpha[f"i{n}"] == bool((flat[:, 3] < 255).any())


def test_classification(spark):
    index = np.arange(200 * 200 * 4)
    pattern = ((index * 31 + 17) % 256).reshape(200, 200, 4)
    small = np.full((10, 10, 4), 128)
    rows = {r.asset_id: r for r in P.classify_content(P.grid_lines(grids(spark, pattern, small))).collect()}
    assert (rows["i0"].unique_colors, rows["i0"].entropy, rows["i0"].preset) == (64, 6.0, "graphic")
    assert (rows["i1"].unique_colors, rows["i1"].preset) == (1, "photo")


@pytest.mark.parametrize("cap", [1, 7, 50, 62, 63, 1000])
def test_stride(spark, cap):
    im = image(3, 7, 9)
    lines = P.grid_lines(grids(spark, im))
    sampled = {(r.x, r.y, r.r) for r in P.explode_pixels(lines, cap).collect()}
    later = {(r.x, r.y, r.r) for r in P.stride_sample(P.explode_pixels(lines), cap).collect()}
    step = math.ceil(63 / cap) if 63 > cap else 1
    assert sampled == later == {(p % 9, p // 9, int(im[p // 9, p % 9, 0])) for p in range(0, 63, step)}


def test_composite(spark):
    im = image(4, 5, 6)
    lines = P.grid_lines(grids(spark, im))
    by_pixel = {
        (r.x, r.y): (r.r, r.g, r.b, r.a)
        for r in P.alpha_composite(P.explode_pixels(lines), (255, 0, 7)).collect()
    }
    by_line = {
        (r.x, r.y): (r.r, r.g, r.b, r.a)
        for r in P.explode_pixels(
            lines.withColumn("samples", P.flattened("samples", (255, 0, 7)))
        ).collect()
    }
    share = im[..., 3:] / 255
    want = np.floor(im[..., :3] * share + np.array([255, 0, 7]) * (1 - share) + 0.5).astype(int)
    assert by_pixel == by_line == {
        (x, y): (*map(int, want[y, x]), 255) for y in range(5) for x in range(6)
    }


def test_psnr(spark):
    a, b = image(5, 8, 8), image(6, 8, 8)
    mse = ((a - b) ** 2).mean()
    assert values(P.psnr(both(spark, a, b)), "psnr", "pair_id")["p"] == pytest.approx(
        10 * math.log10(255**2 / mse), abs=1e-6
    )
    same = values(P.psnr(both(spark, a, a)), "psnr", "pair_id")["p"]
    assert same == pytest.approx(10 * math.log10(255**2 / 1e-10), abs=1e-6)


@pytest.mark.parametrize("shape", [(8, 8, 1), (20, 13, 4)])
def test_ssim(spark, shape):
    a, b = image(7, *shape), image(8, *shape)
    x, y = luma(a), luma(b)
    scores = []
    for ty in range(0, shape[0], 8):
        for tx in range(0, shape[1], 8):
            p, q = x[ty : ty + 8, tx : tx + 8], y[ty : ty + 8, tx : tx + 8]
            c1, c2 = 2.55**2, 7.65**2
            cov = (p * q).mean() - p.mean() * q.mean()
            scores.append(
                (2 * p.mean() * q.mean() + c1) * (2 * cov + c2)
                / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var() + q.var() + c2))
            )
    assert values(P.ssim(both(spark, a, b)), "ssim", "pair_id")["p"] == pytest.approx(
        np.mean(scores), abs=2e-6
    )
    assert values(P.ssim(both(spark, a, a)), "ssim", "pair_id")["p"] == pytest.approx(1)


def test_edge_energy(spark):
    images = [image(9, 12, 17), image(10, 2, 2), image(11, 3, 3, 1), image(12, 2, 9)]
    found = values(P.edge_energy(P.grid_lines(grids(spark, *images))), "edge_energy")
    for n, im in enumerate(images):
        grey = luma(im).astype(np.float32).astype(float)
        if min(grey.shape) < 3:
            assert found[f"i{n}"] == 0
            continue
        gx = grey[:-2, 2:] + 2 * grey[1:-1, 2:] + grey[2:, 2:] - grey[:-2, :-2] - 2 * grey[1:-1, :-2] - grey[2:, :-2]
        gy = grey[2:, :-2] + 2 * grey[2:, 1:-1] + grey[2:, 2:] - grey[:-2, :-2] - 2 * grey[:-2, 1:-1] - grey[:-2, 2:]
        assert found[f"i{n}"] == pytest.approx(np.sqrt(gx**2 + gy**2).mean(), abs=1e-5)


@pytest.mark.parametrize("shape, out", [((8, 8, 1), (3, 3)), ((5, 7, 4), (10, 4)), ((4, 4, 4), (4, 4)), ((9, 2, 1), (5, 1))])
def test_resample(spark, shape, out):
    im = image(13, *shape).astype(float)
    width, height = out
    got = P.grid_resample(P.grid_lines(grids(spark, im.astype(int))), width, height).collect()
    result = np.zeros((height, width, shape[2]))
    for r in got:
        result[r.y] = np.array(r.samples).reshape(width, shape[2])
    assert len(got) == height
    for oy in range(height):
        for ox in range(width):
            sx, sy = ox * shape[1] / width, oy * shape[0] / height
            x0, y0 = int(sx), int(sy)
            x1, y1 = min(x0 + 1, shape[1] - 1), min(y0 + 1, shape[0] - 1)
            fx, fy = sx - x0, sy - y0
            top = im[y0, x0] * (1 - fx) + im[y0, x1] * fx
            bottom = im[y1, x0] * (1 - fx) + im[y1, x1] * fx
            assert result[oy, ox] == pytest.approx(top * (1 - fy) + bottom * fy)


def test_fitted_outputs(spark):
    """Outputs of another size are resampled to their original; equal sizes pass through."""
    a, b, c = image(14, 4, 6), image(15, 8, 12), image(16, 4, 6)
    lines = P.grid_lines(grids(spark, a, b, c))
    pairs = spark.createDataFrame(
        [("big", "i0", "i1"), ("same", "i0", "i2"), ("back", "i1", "i0")],
        "pair_id string, original_id string, output_id string",
    )
    got = {}
    for r in P.fitted_outputs(pairs, lines, lines).collect():
        got.setdefault((r.pair_id, r.width, r.height), {})[r.y] = r.samples
    assert {k: len(v) for k, v in got.items()} == {("big", 6, 4): 4, ("same", 6, 4): 4, ("back", 12, 8): 8}
    assert [got["same", 6, 4][y] for y in range(4)] == c.reshape(4, -1).tolist()
    assert [got["big", 6, 4][y] for y in range(4)] == b[::2, ::2].reshape(4, -1).tolist()
    assert P.quality(P.pair_lines(P.fitted_outputs(pairs, lines, lines), lines)).count() == 3


def lines_of(spark, *images):
    return P.grid_lines(grids(spark, *images))


@pytest.mark.parametrize("batch", [10_000, 17])
@pytest.mark.parametrize("cap", [None, 3000])
def test_colours_by_lists_and_bitmaps(spark, batch, cap):
    """Images on both sides of FEW_PIXELS, over one or many batches, as arrays and as bytes."""
    images = [image(20, 90, 70), image(21, 90, 70, high=4), image(22, 10, 9), image(23, 100, 60, 1),
              image(24, 64, 64), image(25, 1, 5000)]
    lines = lines_of(spark, *images)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = {r.asset_id: r for r in P.colour_facts(lines, cap, (9, 0, 200)).collect()}
        packed = P.colour_facts(P.packed_lines(lines), cap, (9, 0, 200)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.asset_id: r[1:4] for r in packed} == {k: r[1:4] for k, r in found.items()}
    for n, im in enumerate(images):
        rgba = np.repeat(im, 4, axis=2) if im.shape[2] == 1 else im
        rgba = rgba.reshape(-1, 4).copy()
        if im.shape[2] == 1:
            rgba[:, 3] = 255
        if cap:
            rgba = rgba[:: max(1, math.ceil(len(rgba) / cap))]
        share = rgba[:, 3:] / 255
        flat = np.floor(rgba[:, :3] * share + np.array([9, 0, 200]) * (1 - share) + 0.5)
        row = found[f"i{n}"]
        assert row.raw_colors == len(np.unique(rgba[:, :3], axis=0))
        assert row.flat_colors == len(np.unique(flat, axis=0))
        assert row.has_alpha == bool((rgba[:, 3] < 255).any())
        assert sum(part.n for part in row.luma) == len(rgba)


def test_rows_of_an_image_are_bounded_by_buckets(spark):
    big = image(26, 300, 300)
    lines = lines_of(spark, big).coalesce(1)
    schema = "asset_id string, " + N.PARTS
    parts = lines.select(*P.IMAGE, "channels", "y", "samples").mapInArrow(N.colour_parts(None, None), schema)
    assert parts.filter("bits IS NOT NULL").count() <= 512
    assert values(P.line_colors(lines), "unique_colors")["i0"] == len(np.unique(big[..., :3].reshape(-1, 3), axis=0))


@pytest.mark.parametrize("shape", [(150, 5), (64, 3), (65, 9), (129, 4)])
def test_edges_over_strips(spark, shape):
    im = image(27, *shape)
    grey = luma(im).astype(np.float32).astype(float)
    gx = grey[:-2, 2:] + 2 * grey[1:-1, 2:] + grey[2:, 2:] - grey[:-2, :-2] - 2 * grey[1:-1, :-2] - grey[2:, :-2]
    gy = grey[2:, :-2] + 2 * grey[2:, 1:-1] + grey[2:, 2:] - grey[:-2, :-2] - 2 * grey[:-2, 1:-1] - grey[:-2, 2:]
    want = np.sqrt(gx**2 + gy**2).mean()
    for lines in (lines_of(spark, im), P.packed_lines(lines_of(spark, im))):
        assert values(P.edge_energy(lines), "edge_energy")["i0"] == pytest.approx(want, abs=1e-5)


def test_pairs_of_many_shapes(spark):
    """Several pairs in a batch, packed or not, and one whose sides have other channels."""
    images = [image(30 + n, *s) for n, s in enumerate([(9, 17, 4), (9, 17, 4), (5, 6, 1), (5, 6, 1), (5, 6, 4)])]
    lines = lines_of(spark, *images)
    wanted = spark.createDataFrame([("a", "i0", "i1"), ("b", "i2", "i3"), ("c", "i3", "i4"), ("d", "i1", "i1")],
                                   "pair_id string, original_id string, output_id string")
    got = {}
    for name, side in (("array", lines), ("bytes", P.packed_lines(lines))):
        sides = P.pair_lines(P.fitted_outputs(wanted, side, side), side)
        got[name] = {r.pair_id: (r.ssim, r.psnr) for r in P.quality(sides).collect()}
        assert values(P.psnr(sides), "psnr", "pair_id") == {k: v[1] for k, v in got[name].items()}
    assert got["array"] == got["bytes"] and got["array"]["c"] == (0.0, 0.0)
    assert got["array"]["d"][0] == 1.0
    mse = ((images[0] - images[1]) ** 2).mean()
    assert got["array"]["a"][1] == pytest.approx(10 * math.log10(255**2 / mse), abs=1e-6)
