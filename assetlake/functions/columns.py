"""Scalar rules for one asset, task or result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K


def half_up(value: Column) -> Column:
    """Round halves towards +infinity, as the measured system does; BIGINT."""
    return F.floor(value + F.lit(0.5))


def file_extension(name: Column) -> Column:
    """Lower-cased text after the last dot; a name without a dot yields itself."""
    return F.lower(F.substring_index(name, ".", -1))


def base_name(name: Column) -> Column:
    """Text before the last dot; empty when there is no dot."""
    return F.when(F.instr(name, ".") == 0, F.lit("")).otherwise(
        F.regexp_replace(name, r"\.[^.]*$", "")
    )


def stem(name: Column) -> Column:
    """Name without its extension, keeping a leading-dot or dotless name whole."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_supported(extension: Column) -> Column:
    return extension.isin(K.INPUT_EXTENSIONS)


def is_archive(name: Column) -> Column:
    """Case-sensitive on purpose: `a.ZIP` is not an archive."""
    return F.endswith(name, F.lit(".zip"))


def mime_type(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.MIME_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit(K.DEFAULT_MIME))


def mime_of_format(fmt: Column) -> Column:
    return F.concat(F.lit("image/"), fmt)


def has_mime_prefix(mime: Column, prefix: str = "image/") -> Column:
    return F.startswith(mime, F.lit(prefix))


def size_error(
    size: Column,
    archive: Column | None = None,
    max_bytes: int = K.MAX_FILE_BYTES,
    max_zip_bytes: int = K.MAX_ZIP_BYTES,
) -> Column:
    """Message for an over-long file or archive, else NULL."""
    plain = F.when(size > max_bytes, F.lit(K.ERR_FILE_LIMIT))
    if archive is None:
        return plain
    return F.when(archive, F.when(size > max_zip_bytes, F.lit(K.ERR_ZIP_LIMIT))).otherwise(plain)


def magic_match(
    content: Column, extension: Column, heic: bool = False, extended: bool = False
) -> Column:
    """Do the leading bytes fit the extension? Only the first 12 bytes matter.

    `heic` also accepts HEIC/HEIF files that carry the `ftyp` box; `extended` those and GIF, BMP
    and TIFF files.
    """
    head = F.hex(F.substring(content, 1, 12))

    def at(offset: int, signature: str) -> Column:
        return F.substring(head, 2 * offset + 1, len(signature)) == F.lit(signature)

    boxed = at(4, "66747970") & (F.length(head) == 24)
    known = (
        F.when(extension == "png", at(0, "89504E470D0A1A0A"))
        .when(extension.isin("jpg", "jpeg"), at(0, "FFD8FF"))
        .when(extension == "webp", at(0, "52494646") & at(8, "57454250"))
        .when(extension == "avif", boxed)
        .when(extension == "svg", (at(0, "3C") & (F.length(head) >= 4)) | at(0, "EFBBBF"))
    )
    if extended:
        known = (
            known.when(extension == "gif", at(0, "474946383761") | at(0, "474946383961"))
            .when(extension == "bmp", at(0, "424D"))
            .when(extension.isin("tif", "tiff"), at(0, "49492A00") | at(0, "4D4D002A"))
        )
    if heic or extended:
        known = known.when(extension.isin("heic", "heif"), boxed)
    return F.coalesce(known, F.lit(False))


def intake_error(
    size: Column,
    extension: Column,
    magic_ok: Column,
    max_bytes: int = K.MAX_FILE_BYTES,
    heic: bool = False,
) -> Column:
    """First failing check in order: size, leading bytes, HEIC; NULL when all pass.

    With `heic`, files of that kind whose bytes fit are no error.
    """
    error = F.when(size > max_bytes, F.lit(K.ERR_FILE_LIMIT)).when(~magic_ok, F.lit(K.ERR_INVALID))
    return error if heic else error.when(extension.isin("heic", "heif"), F.lit(K.ERR_HEIC))


def pixel_error(width: Column, height: Column, max_pixels: int = K.MAX_PIXELS) -> Column:
    total = width.cast("double") * height.cast("double")
    bad = (total > max_pixels) | F.isnan(total) | total.isNull()
    return F.when(bad, F.lit(K.ERR_PIXELS))


def normalize_format(requested: Column, extension: Column) -> Column:
    def jpg(c: Column) -> Column:
        return F.when(c == "jpg", F.lit("jpeg")).otherwise(c)

    return F.when(
        requested == "original", F.coalesce(jpg(extension), F.lit("webp"))
    ).otherwise(jpg(requested))


def route(extension: Column, requested: Column) -> Column:
    vector = F.coalesce(extension == "svg", F.lit(False)) | (requested == "svg")
    return (
        F.when(vector & requested.isin(K.RASTER_FORMATS), F.lit("vector_to_raster"))
        .when(vector, F.lit("vector_keep"))
        .otherwise(F.lit("raster"))
    )


def effective_format(extension: Column, requested: Column) -> Column:
    """Format a raster task really encodes to: never svg."""
    final = normalize_format(requested, extension)
    return F.when(final == "svg", F.lit("webp")).otherwise(final)


def lossless_guard(lossless: Column, lossy: Column, ratio: float = K.LOSSLESS_GUARD) -> Column:
    return F.when(lossless <= lossy * ratio, F.lit("lossless")).otherwise(F.lit("lossy"))


def vector_bias_choice(wrapper: Column, vector: Column, bias: float = K.VECTOR_BIAS) -> Column:
    return F.when(wrapper < vector * bias, F.lit("wrapper")).otherwise(F.lit("vector"))


def size_kb(size: Column) -> Column:
    return F.round(size / F.lit(float(K.BYTES_PER_KB)), 1)


def display_size(size: Column) -> Column:
    """`512 B` below one KB, else KB with one decimal."""
    return F.when(size < K.BYTES_PER_KB, F.concat(size.cast("string"), F.lit(" B"))).otherwise(
        F.concat(size_kb(size).cast("decimal(20,1)").cast("string"), F.lit(" KB"))
    )


def absolute_savings(original: Column, size: Column) -> Column:
    """Whole percent, absolute: growth counts like shrinkage. 0 for an empty original.

    Growth beyond what an INT holds counts as the largest INT.
    """
    share = (original - size) / F.nullif(original, F.lit(0)).cast("double") * 100
    most = F.when(share.isNotNull(), F.least(F.abs(share), F.lit(float(2**31 - 1))))
    return F.coalesce(half_up(most), F.lit(0)).cast("int")


def signed_savings(original: Column, size: Column) -> Column:
    """Percent with one decimal, negative on growth; 0 unless both sizes are positive."""
    return F.when(
        (original > 0) & (size > 0), F.round((original - size) / original.cast("double") * 100, 1)
    ).otherwise(F.lit(0.0))


def effective_dpr(
    width: Column, height: Column, requested: Column, max_pixels: int = K.MAX_PIXELS
) -> Column:
    """Rounded pixel ratio within 1..3, lowered until width x height fits the pixel limit.

    Ratios that are no finite number count as 1. Products are doubles, which no size overflows.
    """
    ratio = requested.cast("double")
    finite = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) != F.lit(float("inf")))
    wanted = half_up(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(100.0)))
    dpr = F.coalesce(F.least(F.lit(K.DPR_MAX), F.greatest(F.lit(K.DPR_MIN), wanted)), F.lit(1))
    dpr = F.when(finite, dpr).otherwise(F.lit(1))
    w = F.greatest(F.lit(1.0), half_up(width).cast("double"))
    h = F.greatest(F.lit(1.0), half_up(height).cast("double"))
    fits = w * h * dpr * dpr <= max_pixels
    lower = F.when(w * h * 4 <= max_pixels, F.lit(2)).otherwise(F.lit(1))
    return F.when(fits, dpr).otherwise(F.greatest(F.lit(1), F.least(dpr - 1, lower))).cast("int")


def internal_render_size(
    width: Column, height: Column, max_pixels: int = K.MAX_PIXELS
) -> tuple[Column, Column]:
    """Four-fold supersampling, scaled down to fit the pixel limit but never below the base."""
    w = F.greatest(F.lit(1), half_up(width))
    h = F.greatest(F.lit(1), half_up(height))
    area = w.cast("double") * h
    scale = F.when(
        area * K.SVG_SUPERSAMPLE * K.SVG_SUPERSAMPLE > max_pixels,
        F.greatest(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / area)),
    ).otherwise(F.lit(float(K.SVG_SUPERSAMPLE)))
    return F.greatest(w, half_up(w * scale)), F.greatest(h, half_up(h * scale))


def clamp_quality(value: Column) -> Column:
    """Rounded and clamped to 1..100; NULL stays NULL."""
    clamped = F.least(F.lit(K.QUALITY_MAX), F.greatest(F.lit(K.QUALITY_MIN), half_up(value)))
    return F.when(value.isNotNull(), clamped).cast("int")


def lerp_quality(low: Column, high: Column, percent: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100.0))
    return half_up(low + (high - low) * share).cast("int")


def parse_size(text: Column) -> Column:
    """`19.1KB`, `2MB`, `1GB` to bytes; anything else is 0."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([KMG])B\s*$"
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    factor = (
        F.when(unit == "K", F.lit(1024.0))
        .when(unit == "M", F.lit(1024.0 * 1024))
        .when(unit == "G", F.lit(1024.0 * 1024 * 1024))
    )
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.coalesce(number * factor, F.lit(0.0))


def error_text(message: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(message, F.lit("")), F.lit(fallback))


def extension_of_format(fmt: Column) -> Column:
    return F.when(fmt == "jpeg", F.lit("jpg")).otherwise(fmt)


def download_name(name: Column, fmt: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), base_name(name), F.lit("."), extension_of_format(fmt))


def dimension_error(
    width: Column, height: Column, expected_width: Column, expected_height: Column, stage: str
) -> Column:
    text = F.format_string(
        f"SVG dimension invariant failed at {stage}: expected %dx%d, got %dx%d",
        expected_width, expected_height, width, height,
    )
    return F.when((width != expected_width) | (height != expected_height), text)


def successful_results(results: Column) -> Column:
    """Keep the successful entries of a format -> result map."""
    return F.map_filter(results, lambda _, r: r["status"] == K.SUCCESS)


def format_list(
    original: Column,
    formats: Column,
    use_original: bool | Column = True,
    include_original: bool | Column = False,
) -> Column:
    """Formats one item is encoded to: distinct, first occurrence kept in place."""
    source = F.when(original == "jpg", F.lit("jpeg")).otherwise(original)
    own = F.array(source)

    def flag(value: bool | Column) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    custom = F.when(flag(include_original), F.concat(own, formats)).otherwise(formats)
    return F.when(flag(use_original), own).otherwise(F.array_distinct(custom))
