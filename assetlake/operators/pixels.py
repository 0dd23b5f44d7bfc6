"""Pixel measures.

Pixels travel as scan lines: one row per image line, `samples` holding its interleaved
channels. A line is bounded by the image width, so an image of any size is spread over many
rows; per-line sums stay inside whole rows, and only small partial sums are shuffled.

`lines`: asset_id, width, height, channels (1 grey or 4 RGBA), y, samples ARRAY<INT>. Measures of
lines take `packed_lines` as well; those that explode pixels do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import constants as K
from ..functions.columns import half_up
from . import kernels as N

IMAGE = ["asset_id", "width", "height"]
BLACK = (0, 0, 0)


def grid_lines(grids: DataFrame) -> DataFrame:
    """Split whole-image sample arrays into scan lines."""
    step = F.col("width") * F.col("channels")
    lines = F.transform(
        F.sequence(F.lit(0), F.col("height") - 1),
        lambda y: F.struct(y.alias("y"), F.slice("samples", y * step + 1, step).alias("samples")),
    )
    rest = [c for c in grids.columns if c != "samples"]
    return grids.select(*rest, F.inline(lines))


def packed_lines(lines: DataFrame) -> DataFrame:
    """Lines with `samples` as BINARY, one byte each: smaller where they are stored or shuffled."""
    if isinstance(lines.schema["samples"].dataType, T.BinaryType):
        return lines
    return lines.withColumn("samples", N.packed("samples"))


def stride(total: Column, cap: int) -> Column:
    """Sampling step that keeps at most `cap` positions."""
    return F.when(total > cap, F.ceil(total / F.lit(float(cap)))).otherwise(F.lit(1)).cast("bigint")


def explode_pixels(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per RGBA pixel; with `cap`, only positions 0, step, 2*step, ... of each image.

    The step is applied to the index sequence, so skipped pixels are never produced.
    """
    width = F.col("width").cast("bigint")
    step = F.lit(1).cast("bigint") if cap is None else stride(width * F.col("height"), cap)
    begin = F.col("y") * width
    first = F.pmod(-begin, step)
    xs = F.when(first < width, F.sequence(first, width - 1, step)).otherwise(
        F.array().cast("array<bigint>")
    )

    def pixel(x: Column) -> Column:
        at = (x * F.col("channels")).cast("int")
        grey = F.col("channels") == 1
        return F.struct(
            x.cast("int").alias("x"),
            F.get("samples", at).alias("r"),
            F.when(grey, F.get("samples", at)).otherwise(F.get("samples", at + 1)).alias("g"),
            F.when(grey, F.get("samples", at)).otherwise(F.get("samples", at + 2)).alias("b"),
            F.when(grey, F.lit(255)).otherwise(F.get("samples", at + 3)).alias("a"),
        )

    return lines.select(*IMAGE, "y", F.inline(F.transform(xs, pixel)))


def stride_sample(pixels: DataFrame, cap: int) -> DataFrame:
    """The same systematic sample on pixels that are already exploded."""
    width = F.col("width").cast("bigint")
    position = F.col("y") * width + F.col("x")
    return pixels.filter(F.pmod(position, stride(width * F.col("height"), cap)) == 0)


def rgb_key() -> Column:
    return F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))


def luma_bin() -> Column:
    y = K.LUMA_R * F.col("r") + K.LUMA_G * F.col("g") + K.LUMA_B * F.col("b")
    return F.least(F.lit(255), half_up(y)).cast("int")


def unique_colors(pixels: DataFrame) -> DataFrame:
    """Exact distinct RGB per image. Grouping by (image, colour) spreads a huge image."""
    return (
        pixels.groupBy("asset_id", rgb_key().alias("rgb")).agg(F.lit(1).alias("one"))
        .groupBy("asset_id").agg(F.count("*").alias("unique_colors"))
    )


def luma_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("asset_id", luma_bin().alias("luma")).agg(F.count("*").alias("n"))


def entropy_of(n: str = "n") -> Column:
    """Shannon entropy in bits of a histogram column, as an aggregate over its bins."""
    total = F.sum(n).cast("double")
    return F.log2(total) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total


def luma_entropy(pixels: DataFrame) -> DataFrame:
    return luma_histogram(pixels).groupBy("asset_id").agg(
        F.abs(F.round(entropy_of(), 6)).alias("entropy")
    )


def transparency(pixels: DataFrame, small_px: int = K.SMALL_TRANSPARENT_PX) -> DataFrame:
    any_alpha = F.bool_or(F.col("a") < 255)
    small = F.first("width").cast("bigint") * F.first("height") < small_px
    return pixels.groupBy("asset_id").agg(
        any_alpha.alias("has_alpha"), (small & any_alpha).alias("small_transparent")
    )


def colour_facts(
    lines: DataFrame, cap: int | None = None, background: tuple[int, int, int] | None = None
) -> DataFrame:
    """Per image: `raw_colors`, `flat_colors` on a background, `has_alpha`, and `luma` counts.

    Exact. Each batch of lines gives its distinct colours: small images as a list, others as
    bitmaps over buckets of the 24-bit colour space, which Spark joins; so no more rows are
    shuffled than an image has buckets. `luma` lists (luma, n) of batches and is not added up.
    """
    columns = lines.select(*IMAGE, "channels", "y", "samples")
    kind = lines.schema["asset_id"].dataType.simpleString()
    parts = columns.mapInArrow(N.colour_parts(cap, background), f"asset_id {kind}, {N.PARTS}")
    merged = parts.groupBy("asset_id", "kind", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("many"),
        F.size(F.array_distinct(F.flatten(F.collect_list("few")))).alias("few"),
        F.flatten(F.collect_list("luma")).alias("luma"),
        F.bool_or("clear").alias("clear"),
    )
    colours = F.col("many") + F.col("few")
    return merged.groupBy("asset_id").agg(
        F.sum(F.when(F.col("kind") == N.RAW, colours)).alias("raw_colors"),
        F.sum(F.when(F.col("kind") == N.FLAT, colours)).alias("flat_colors"),
        F.bool_or("clear").alias("has_alpha"),
        F.flatten(F.collect_list("luma")).alias("luma"),
    )


def line_colors(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """`unique_colors` from scan lines."""
    return colour_facts(lines, cap).select("asset_id", F.col("raw_colors").alias("unique_colors"))


def classify_content(
    lines: DataFrame,
    small_px: int = K.SMALL_IMAGE_PX,
    colours: int = K.GRAPHIC_COLOURS,
    entropy: float = K.GRAPHIC_ENTROPY,
    cap: int | None = None,
) -> DataFrame:
    """Photo or graphic per image, with the two measures behind it.

    Small images are photos by rule; they are measured like all others. Every pixel counts unless
    a `cap` asks for a sample.
    """
    area = F.col("width").cast("bigint") * F.col("height")
    shapes = lines.filter(F.col("y") == 0).select(*IMAGE)
    measured = (
        colour_facts(lines, cap)
        .select("asset_id", F.col("raw_colors").alias("unique_colors"), F.inline("luma"))
        .groupBy("asset_id", "unique_colors", "luma")
        .agg(F.sum("n").alias("n"))
        .groupBy("asset_id", "unique_colors")
        .agg(F.abs(F.round(entropy_of(), 6)).alias("entropy"))
    )
    few = (F.col("unique_colors") < colours) & (F.col("entropy") < entropy)
    graphic = few & (area >= small_px)
    return shapes.join(measured, "asset_id", "left").withColumn(
        "preset", F.when(graphic, "graphic").otherwise("photo")
    )


def alpha_composite(pixels: DataFrame, background: tuple[int, int, int]) -> DataFrame:
    """Flatten onto an opaque background."""
    share = F.col("a") / 255.0
    flat = {
        c: half_up(F.col(c) * share + bg * (1 - share)).cast("int")
        for c, bg in zip("rgb", background, strict=True)
    }
    return pixels.withColumns({**flat, "a": F.lit(255)})


def flattened(name: str, background: tuple[int, int, int]) -> Column:
    """RGBA samples of a scan line, flattened onto an opaque background."""
    bg = F.array(*[F.lit(v) for v in (*background, 255)])

    def flat(value: Column, i: Column) -> Column:
        channel = (i % 4).cast("int")
        share = F.get(name, (i - channel + 3).cast("int")) / 255.0
        mixed = half_up(value * share + F.get(bg, channel) * (1 - share)).cast("int")
        return F.when(channel == 3, F.lit(255)).otherwise(mixed)

    return F.transform(name, flat)


def image_facts(lines: DataFrame) -> DataFrame:
    """Size and transparency per image, from scan lines; no pixel is exploded."""
    below = F.exists(
        F.filter("samples", lambda v, i: i % 4 == 3), lambda v: v < 255
    )
    return lines.groupBy("asset_id").agg(
        F.first("width").alias("width"),
        F.first("height").alias("height"),
        F.bool_or((F.col("channels") == 4) & below).alias("has_alpha"),
    )


def colour_counts(pixels: DataFrame, background: tuple[int, int, int]) -> DataFrame:
    """Distinct colours per image as they are (`raw_colors`) and flattened (`flat_colors`), and
    whether any pixel is transparent (`has_alpha`).

    Equal pixels are merged first; all three then work on what is left.
    """
    merged = pixels.groupBy("asset_id", "r", "g", "b", "a").agg(F.lit(1).alias("one"))
    clear = (F.col("a") < 255).alias("clear")
    raw = merged.select("asset_id", clear, rgb_key().alias("raw"))
    flat = alpha_composite(merged, background).select("asset_id", rgb_key().alias("flat"))
    both = raw.unionByName(flat, allowMissingColumns=True)
    return both.groupBy("asset_id", "raw", "flat").agg(F.bool_or("clear").alias("clear")).groupBy(
        "asset_id"
    ).agg(
        F.count("raw").alias("raw_colors"),
        F.count("flat").alias("flat_colors"),
        F.bool_or("clear").alias("has_alpha"),
    )


def luma_of(name: str) -> Column:
    """Grey values of the scan line in column `name`."""
    weights = (K.LUMA_R, K.LUMA_G, K.LUMA_B)

    def grey(x: Column) -> Column:
        r, g, b = (F.get(name, x * 4 + i) * w for i, w in enumerate(weights))
        return r + g + b

    xs = F.sequence(F.lit(0), F.col("width") - 1)
    return F.when(
        F.col("channels") == 1, F.transform(name, lambda v: v.cast("double"))
    ).otherwise(F.transform(xs, grey))


def fitted_outputs(pairs: DataFrame, originals: DataFrame, outputs: DataFrame) -> DataFrame:
    """Scan lines of each pair's output, brought to the size of its original.

    `pairs`: pair_id, original_id, output_id, and columns to keep. Sizes are joined to the pairs,
    which are few, before the pairs meet any pixels. Outputs of the right size pass through.
    """
    sizes = originals.filter(F.col("y") == 0).select(
        F.col("asset_id").alias("original_id"),
        F.col("width").alias("_w"),
        F.col("height").alias("_h"),
    )
    named = outputs.withColumnRenamed("asset_id", "output_id")
    lines = named.join(pairs.join(sizes, "original_id"), "output_id")
    fits = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))
    resized = grid_resample(
        lines.filter(~fits), F.col("_w"), F.col("_h"), key=["pair_id"], whole=True
    )
    if isinstance(lines.schema["samples"].dataType, T.BinaryType):
        resized = resized.withColumn("samples", N.packed("samples"))
    whole = resized.join(pairs, "pair_id")
    return lines.filter(fits).drop("_w", "_h").unionByName(whole)


def pair_lines(fitted: DataFrame, originals: DataFrame) -> DataFrame:
    """Scan lines of both sides of each pair, side by side, as `original` and `output`.

    The sides join line by line, so no key ever holds a whole image. `same` tells whether both
    images have one size and number of channels; lines beyond the shorter image have no partner.
    """
    left = originals.select(
        F.col("asset_id").alias("original_id"),
        "y",
        F.col("samples").alias("original"),
        F.struct("width", "height", "channels").alias("_shape"),
    )
    return (
        fitted.withColumnRenamed("samples", "output")
        .join(left, ["original_id", "y"])
        .withColumn("same", F.struct("width", "height", "channels") == F.col("_shape"))
        .drop("_shape")
    )


def psnr_of(squares: Column, n: Column, same: Column) -> Column:
    mse = F.sum(squares) / F.sum(n).cast("double")
    floor = F.when(mse == 0, F.lit(1e-10)).otherwise(mse)
    value = 10 * F.log10(F.lit(255.0 * 255.0) / floor)
    return F.round(F.when(F.bool_and(same), value).otherwise(0.0), 6)


def psnr(lines: DataFrame) -> DataFrame:
    """Peak signal-to-noise ratio over all channels; unequal sizes give 0."""
    return (
        lines.select(
            "pair_id",
            N.squared_errors("original", "output").alias("squares"),
            (F.col("width") * F.col("channels")).alias("n"),
            "same",
        )
        .groupBy("pair_id")
        .agg(psnr_of(F.col("squares"), F.col("n"), F.col("same")).alias("psnr"))
    )


def quality(
    lines: DataFrame,
    window: int = 8,
    flatten: Column | None = None,
    background: tuple[int, int, int] = (0, 0, 0),
) -> DataFrame:
    """`ssim` and `psnr` of each pair in one pass; unequal sizes give 0.

    SSIM is the mean over non-overlapping luma tiles. Lines meet in strips of `window` lines,
    keyed by (pair, strip), so a large image is spread; a strip gives one row of sums. Where
    `flatten` holds, the original is put on the background first.
    """
    on = F.lit(False) if flatten is None else flatten
    strips = (
        lines.select(
            "pair_id", "width", "channels", "same", on.cast("int").alias("flatten"),
            F.floor(F.col("y") / window).alias("strip"),
            F.struct("y", "original", "output").alias("line"),
        )
        .groupBy("pair_id", "width", "channels", "flatten", "strip")
        .agg(F.bool_and("same").alias("same"), F.array_sort(F.collect_list("line")).alias("lines"))
    )
    sums = N.strip_quality(window, background)(
        "channels", "width", "flatten", F.col("lines.original"), F.col("lines.output")
    )
    score = F.sum("sums.score") / F.sum("sums.tiles")
    return (
        strips.select("pair_id", "same", sums.alias("sums"))
        .groupBy("pair_id")
        .agg(
            F.round(F.when(F.bool_and("same"), score).otherwise(0.0), 6).alias("ssim"),
            psnr_of(F.col("sums.squares"), F.col("sums.samples"), F.col("same")).alias("psnr"),
        )
    )


def ssim(lines: DataFrame, window: int = 8) -> DataFrame:
    return quality(lines, window).select("pair_id", "ssim")


#: Lines of a strip whose gradient is measured together, besides one above and one below.
EDGE_LINES = 64


def edge_energy(lines: DataFrame) -> DataFrame:
    """Mean Sobel magnitude over interior pixels; 0 below three pixels a side.

    Lines meet in strips, keyed by (image, strip), so the work of one image spreads over many
    tasks; border lines go to two strips.
    """
    near = F.array_distinct(
        F.array(*(F.floor((F.col("y") + d) / EDGE_LINES).cast("int") for d in (-1, 0, 1)))
    )
    strips = (
        lines.filter((F.col("width") >= 3) & (F.col("height") >= 3))
        .select(
            *IMAGE, "channels", F.explode(near).alias("strip"), F.struct("y", "samples").alias("line")
        )
        .groupBy(*IMAGE, "channels", "strip")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )
    sums = N.strip_edges("channels", "width", F.col("lines.samples"))
    energy = (
        strips.select("asset_id", sums.alias("sums"))
        .groupBy("asset_id")
        .agg((F.sum("sums.total") / F.sum("sums.n")).alias("energy"))
    )
    images = lines.filter(F.col("y") == 0).select("asset_id")
    return images.join(energy, "asset_id", "left").select(
        "asset_id", F.round(F.coalesce("energy", F.lit(0.0)), 6).alias("edge_energy")
    )


def sharpness_ratio(pairs: DataFrame, originals: DataFrame, outputs: DataFrame) -> DataFrame:
    """Edge energy of the output over that of the original; 1 when the original has none."""
    left = originals.select(
        F.col("asset_id").alias("original_id"), F.col("edge_energy").alias("original_energy")
    )
    right = outputs.select(
        F.col("asset_id").alias("output_id"), F.col("edge_energy").alias("output_energy")
    )
    ratio = F.when(
        F.col("original_energy") > 0, F.col("output_energy") / F.col("original_energy")
    ).otherwise(1.0)
    return pairs.join(left, "original_id").join(right, "output_id").select(
        "pair_id", F.round(ratio, 6).alias("sharpness_ratio")
    )


def grid_resample(
    lines: DataFrame,
    out_width: int | Column,
    out_height: int | Column,
    key: list[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """Bilinear resample: source = output x scale, neighbours clamped to the edge.

    Lines are narrowed first, where they are; then each goes to the output lines it helps,
    keyed by (image, output line). The target size may be a column. Values stay fractional,
    unless `whole` asks to round them half up.
    """
    key = key or ["asset_id"]
    ow = F.lit(out_width) if isinstance(out_width, int) else out_width
    oh = F.lit(out_height) if isinstance(out_height, int) else out_height
    h = F.col("height")

    narrowed = lines.select(
        *key, "channels", "height", "y",
        ow.alias("ow"), oh.alias("oh"),
        N.resampled("samples", "width", "channels", ow).alias("samples"),
    )
    scale = h / F.col("oh").cast("double")
    low = F.greatest(F.lit(0), F.ceil((F.col("y") - 1) / scale).cast("int"))
    high = F.least(F.col("oh") - 1, F.floor((F.col("y") + 1) / scale).cast("int"))
    targets = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    sent = narrowed.select("*", F.explode(targets).alias("oy"))
    y0 = F.floor(F.col("oy") * scale)
    # A clamped last line serves as both neighbours.
    y1 = F.least(y0 + 1, (h - 1).cast("bigint"))
    mixed = (N.mixed_whole if whole else N.mixed)("top", "bottom", "fy")
    return (
        sent.withColumns({"is_top": F.col("y") == y0, "is_bottom": F.col("y") == y1,
                          "fy": F.col("oy") * scale - y0})
        .filter("is_top or is_bottom")
        .groupBy(*key, "channels", "ow", "oh", "oy", "fy")
        .agg(
            F.max(F.when(F.col("is_top"), F.col("samples"))).alias("top"),
            F.max(F.when(F.col("is_bottom"), F.col("samples"))).alias("bottom"),
        )
        .select(
            *key,
            F.col("ow").alias("width"),
            F.col("oh").alias("height"),
            "channels",
            F.col("oy").alias("y"),
            mixed.alias("samples"),
        )
    )
