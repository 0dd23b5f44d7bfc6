"""Fixed values that results depend on: statuses, limits, formats, messages, presets."""

# Status names.
PENDING = "pending"
PROCESSING = "processing"
SUCCESS = "success"
ERROR = "error"

# Limits.
MAX_FILE_BYTES = 25 * 1024 * 1024
MAX_ZIP_BYTES = 25 * 1024 * 1024
MAX_ZIP_MEMBERS = 1000
MAX_ZIP_EXPANDED_BYTES = 200 * 1024 * 1024
MAX_EXPORT_BYTES = 80 * 1024 * 1024
MAX_EXPORT_FILES = 200
MAX_PIXELS = 256_000_000
TASK_TIMEOUT_MS = 120_000
DEBOUNCE_MS = 300
BYTES_PER_KB = 1024

# Content classification.
SMALL_IMAGE_PX = 10_000
GRAPHIC_COLOURS = 2_500
GRAPHIC_ENTROPY = 6.5
UNMEASURED_PAIR = "original or output could not be read"
SMALL_TRANSPARENT_PX = 800_000
LUMA_R, LUMA_G, LUMA_B = 0.299, 0.587, 0.114

# Vector document thresholds.
SVG_NODES_MAX = 1500
SVG_SEGMENTS_MAX = 5000
SVG_RASTER_BYTES_MAX = 32768
SVG_TINY_BYTES = 4096
SVG_NODES_ANCHOR = 256
SVG_RASTER_BYTES_HYBRID = 4096
SVG_RASTER_DOMINANCE = 0.5
SVG_SUPERSAMPLE = 4
DPR_MIN, DPR_MAX = 1, 3
VECTOR_BIAS = 0.85
LOSSLESS_GUARD = 1.3
SVG_NAMESPACE = "http://www.w3.org/2000/svg"

# Encoder overrides for small transparent images.
WEBP_QUALITY_TRANSPARENT = 77
PNG_MILD_MIN, PNG_MILD_MAX = 90, 98

# Quality range and its interpolation table, format -> (min, max).
QUALITY_MIN, QUALITY_MAX = 1, 100
QUALITY_RANGES = {
    "avif": (20, 80),
    "webp": (30, 95),
    "jpeg": (30, 95),
    "png_min": (20, 72),
    "png_max": (50, 92),
}

# Gates.
SIZE_TOLERANCE = 1.10
SSIM_DEFAULT = 0.98
PSNR_DEFAULT = 30.0
PALETTE_COLOURS, PALETTE_SSIM, PALETTE_PSNR = 256, 0.35, 12.0
TRANSPARENT_SSIM, TRANSPARENT_PSNR = 0.80, 19.0
VECTOR_SSIM = 0.995
VECTOR_SHARPNESS = 1.08

# Messages.
ERR_FILE_LIMIT = "File exceeds 25MB limit"
ERR_ZIP_LIMIT = "ZIP exceeds 25MB limit"
ERR_INVALID = "Invalid or unsupported file content"
ERR_WORKER = "Worker error"
ERR_TIMEOUT = "Task timed out"
ERR_HEIC = "HEIC/HEIF is not supported in this browser. Use Safari or convert to JPEG/PNG first."
ERR_PIXELS = "Image dimensions too large (max 256 megapixels)"
ERR_DECODE = "Unsupported or corrupt image"
ERR_ZIP_PREFIX = "ZIP extraction failed: "
ERR_ZIP_COUNT = "Error: ZIP contains too many files"
ERR_ZIP_BYTES = "Error: ZIP uncompressed data too large"

# Formats.
INPUT_EXTENSIONS = [
    "svg", "png", "webp", "avif", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "heic", "heif",
]
RASTER_FORMATS = ["webp", "avif", "jpeg", "png"]
DEFAULT_MIME = "application/octet-stream"
MIME_BY_EXTENSION = {
    "svg": "image/svg+xml",
    "png": "image/png",
    "webp": "image/webp",
    "avif": "image/avif",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "jxl": "image/jxl",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "heic": "image/heic",
    "heif": "image/heif",
}

# Encoder presets, one row per (preset, format); flags are 0 or 1.
PRESET_NAMES = (
    "quality", "quality_max", "effort", "chroma_subsample", "sharp_yuv", "tune", "near_lossless",
    "chroma_quality", "chroma_delta_q", "sharpness", "sns_strength", "filter_strength",
    "filter_sharpness", "autofilter", "exact", "alpha_quality", "progressive", "trellis_multipass",
    "trellis_opt_zero", "trellis_opt_table", "trellis_loops", "separate_chroma_quality",
)
PRESET_COLUMNS = "preset string, format string, " + ", ".join(f"{n} int" for n in PRESET_NAMES)
_JPEG = dict(
    progressive=1, trellis_multipass=1, trellis_opt_zero=1, trellis_opt_table=1, trellis_loops=1
)
_VECTOR_AVIF = dict(chroma_subsample=0, chroma_delta_q=1, sharpness=1, sharp_yuv=1, tune=2)
_VECTOR_WEBP = dict(
    sharp_yuv=1, sns_strength=0, filter_strength=0, autofilter=0, exact=1, alpha_quality=100
)
_PRESETS = {
    ("photo", "avif"): dict(quality=55, effort=6, chroma_subsample=1, sharp_yuv=1, tune=2),
    ("photo", "webp"): dict(quality=72, effort=4, sharp_yuv=1),
    ("photo", "jpeg"): dict(quality=74, chroma_subsample=1, **_JPEG),
    ("photo", "png"): dict(quality=58, quality_max=78, effort=2),
    ("graphic", "avif"): dict(
        quality=56, effort=5, chroma_subsample=2, chroma_delta_q=1, sharp_yuv=1, tune=2
    ),
    ("graphic", "webp"): dict(quality=74, effort=5, sharp_yuv=1),
    ("graphic", "jpeg"): dict(quality=76, chroma_subsample=0, **_JPEG),
    ("graphic", "png"): dict(quality=58, quality_max=78, effort=4),
    ("vector_display", "avif"): dict(quality=90, effort=3, **_VECTOR_AVIF),
    ("vector_display", "webp"): dict(
        quality=100, effort=6, filter_sharpness=0, near_lossless=100, **_VECTOR_WEBP
    ),
    ("vector_display", "jpeg"): dict(
        quality=98, chroma_subsample=0, separate_chroma_quality=1, chroma_quality=98, **_JPEG
    ),
    ("vector_display", "png"): dict(quality=92, quality_max=99, effort=3),
    ("vector_safe", "avif"): dict(quality=75, effort=4, **_VECTOR_AVIF),
    ("vector_safe", "webp"): dict(
        quality=86, effort=4, filter_sharpness=7, near_lossless=90, **_VECTOR_WEBP
    ),
    ("vector_safe", "jpeg"): dict(
        quality=88, chroma_subsample=0, separate_chroma_quality=1, chroma_quality=92, **_JPEG
    ),
    ("vector_safe", "png"): dict(quality=90, quality_max=99, effort=2),
}
PRESETS = [(*key, *(row.get(n) for n in PRESET_NAMES)) for key, row in _PRESETS.items()]
ERR_NO_PRESET = "no encoder parameters for this preset and format"

# Codec registrations in order, with capability flags.
CODEC_COLUMNS = (
    "seq int, id string, format string, encode boolean, decode boolean, "
    "lossless boolean, transparency boolean, animation boolean, simd boolean"
)
CODECS = [
    (1, "mozjpeg", "jpeg", True, True, False, False, False, False),
    (2, "libwebp", "webp", True, True, True, True, False, True),
    (3, "aomenc", "avif", True, True, True, True, False, False),
    (4, "imagequant-oxipng", "png", True, False, True, True, False, False),
    (5, "libjxl", "jxl", True, True, True, True, True, False),
]
