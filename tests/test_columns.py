"""Scalar rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from assetlake.functions import columns as C, constants as K, markup as M
from assetlake.operators import intake


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "hexed, extension, expected",
    [
        ("89504E470D0A1A0A", "png", True),
        ("89504E470D0A1A", "png", False),
        ("FFD8FF", "jpg", True),
        ("89504E470D0A1A0A", "jpg", False),
        ("524946460000000057454250", "webp", True),
        ("5249464600000000574542", "webp", False),
        ("0000001C66747970", "avif", False),
        ("0000001C6674797061766966", "avif", True),
        ("3C73", "svg", True),
        ("3C", "svg", False),
        ("EFBBBF", "svg", True),
        ("474946383961", "gif", False),
    ],
)
def test_magic(spark, hexed, extension, expected):
    assert one(spark, C.magic_match(F.unhex(F.lit(hexed)), F.lit(extension))) is expected


def test_heic_only_when_asked(spark):
    content, heic = F.unhex(F.lit("0000001C6674797068656963")), F.lit("heic")
    assert one(spark, C.magic_match(content, heic)) is False
    assert one(spark, C.magic_match(content, heic, heic=True)) is True


@pytest.mark.parametrize(
    "name, extension, base",
    [("a.PNG", "png", "a"), ("a.b.jpg", "jpg", "a.b"), ("noext", "noext", ""), (".svg", "svg", "")],
)
def test_names(spark, name, extension, base):
    assert one(spark, C.file_extension(F.lit(name))) == extension
    assert one(spark, C.base_name(F.lit(name))) == base


def test_mime(spark):
    assert one(spark, C.mime_type(F.lit("svg"))) == "image/svg+xml"
    assert one(spark, C.mime_type(F.lit("jpg"))) == "image/jpeg"
    assert one(spark, C.mime_type(F.lit("bin"))) == K.DEFAULT_MIME


@pytest.mark.parametrize(
    "size, name, expected",
    [
        (26214400, "a.zip", None),
        (26214401, "a.zip", K.ERR_ZIP_LIMIT),
        (26214401, "a.ZIP", K.ERR_FILE_LIMIT),
        (26214401, "a.png", K.ERR_FILE_LIMIT),
    ],
)
def test_size_limits(spark, size, name, expected):
    assert one(spark, C.size_error(F.lit(size), C.is_archive(F.lit(name)))) == expected


@pytest.mark.parametrize(
    "w, h, dpr, expected",
    [(100, 100, 0.0, 1), (100, 100, 99.0, 3), (100, 100, 2.4, 2), (12000, 12000, 3.0, 1),
     (8000, 8000, 3.0, 2), (20000, 20000, 1.0, 1), (100, 100, float("nan"), 1)],
)
def test_effective_dpr(spark, w, h, dpr, expected):
    assert one(spark, C.effective_dpr(F.lit(w), F.lit(h), F.lit(dpr))) == expected


@pytest.mark.parametrize(
    "w, h, expected", [(120, 80, (480, 320)), (12000, 12000, (16000, 16000)), (0, 0, (4, 4))]
)
def test_internal_render_size(spark, w, h, expected):
    sizes = C.internal_render_size(F.lit(w), F.lit(h))
    assert tuple(one(spark, c) for c in sizes) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("19.1KB", 19558.4), ("2MB", 2097152), ("1gb", 1073741824), ("12", 0), ("3B", 0), ("x", 0)],
)
def test_parse_size(spark, text, expected):
    assert one(spark, C.parse_size(F.lit(text))) == pytest.approx(expected)


def test_quality(spark):
    assert one(spark, C.clamp_quality(F.lit(150.2))) == 100
    assert one(spark, C.clamp_quality(F.lit(-3.0))) == 1
    assert one(spark, C.clamp_quality(F.lit(2.5))) == 3
    assert one(spark, C.clamp_quality(F.lit(None).cast("double"))) is None
    assert one(spark, C.lerp_quality(F.lit(20), F.lit(80), F.lit(50))) == 50
    assert one(spark, C.lerp_quality(F.lit(20), F.lit(80), F.lit(500))) == 80


def test_savings(spark):
    assert one(spark, C.absolute_savings(F.lit(100), F.lit(150))) == 50
    assert one(spark, C.absolute_savings(F.lit(0), F.lit(150))) == 0
    assert one(spark, C.signed_savings(F.lit(100), F.lit(150))) == -50.0
    assert one(spark, C.signed_savings(F.lit(100), F.lit(0))) == 0.0
    assert one(spark, C.display_size(F.lit(1023))) == "1023 B"
    assert one(spark, C.display_size(F.lit(1536))) == "1.5 KB"


@pytest.mark.parametrize(
    "requested, extension, expected",
    [("original", "jpg", "jpeg"), ("original", None, "webp"), ("jpg", "png", "jpeg"),
     ("avif", "png", "avif"), ("original", "svg", "svg")],
)
def test_normalize_format(spark, requested, extension, expected):
    found = C.normalize_format(F.lit(requested), F.lit(extension).cast("string"))
    assert one(spark, found) == expected


def test_guards(spark):
    assert one(spark, C.lossless_guard(F.lit(130), F.lit(100))) == "lossless"
    assert one(spark, C.lossless_guard(F.lit(131), F.lit(100))) == "lossy"
    assert one(spark, C.vector_bias_choice(F.lit(84), F.lit(100))) == "wrapper"
    assert one(spark, C.vector_bias_choice(F.lit(85), F.lit(100))) == "vector"
    assert one(spark, C.pixel_error(F.lit(16000), F.lit(16000))) is None
    assert one(spark, C.pixel_error(F.lit(16001), F.lit(16000))) == K.ERR_PIXELS


def decide(spark, text):
    col = F.lit(text)
    nodes, segments, raster = M.node_count(col), M.segment_count(col), M.raster_bytes(col)
    size = F.octet_length(col)
    flags = M.representation_flags(size, nodes, segments, raster)
    return spark.range(1).select(
        nodes.alias("nodes"), segments.alias("segments"), raster.alias("raster"),
        M.svg_class(raster, nodes, segments).alias("type"), flags["wrap"].alias("wrap"),
        M.representation_label(flags["wrap"]).alias("label"),
        M.has_filters(col).alias("filters"),
    ).first()


def test_representation(spark):
    simple = decide(spark, "<svg><circle /></svg>".ljust(4096))
    assert (simple.type, simple.label) == ("SIMPLE", "svg (optimized)")
    heavy = decide(spark, "<svg>" + "<rect />" * 1501 + "</svg>")
    assert (heavy.nodes, heavy.type, heavy.label) == (1502, "COMPLEX", "svg (webp-wrapped)")
    uri = "data:image/png;base64," + "A" * 32768
    hybrid = decide(spark, f'<svg><image href="{uri}" /></svg>')
    assert (hybrid.raster, hybrid.type, hybrid.wrap) == (len(uri), "HYBRID", True)
    tiny = decide(spark, f"<svg><image xlink:href='data:x'/><mask id='m'/></svg>")
    assert (tiny.raster, tiny.wrap, tiny.filters) == (6, False, True)


def test_segments(spark):
    found = decide(spark, "<svg><path d='M0 0L1e5 2zC1' id='abc'/><g id=\"d\"/><p d=\"mE\"/></svg>")
    assert found.segments == 5


def test_wrapper_round_trip(spark):
    payload = F.lit(bytes(range(256)) * 5)
    text = M.wrap_markup(F.lit(10), F.lit(20), F.lit("webp"), payload)
    row = spark.range(1).select(
        text.alias("t"), M.embedded_type(text).alias("k"), M.embedded_bytes(text).alias("b")
    ).first()
    assert row.k == "webp" and bytes(row.b) == bytes(range(256)) * 5
    assert row.t.startswith('<svg width="10" height="20" viewBox="0 0 10 20"')
    assert one(spark, M.embedded_type(F.lit("<svg/>"))) is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<p/>", "<p/>"),
        ('<svg viewBox="0"><rect width="9"/></svg>',
         '<svg width="1" height="2" viewBox="0"><rect width="9"/></svg>'),
        ('  <?xml?><svg width="5" height=\'6\' stroke-width="3" a="b"></svg>',
         '<?xml?><svg width="1" height="2" stroke-width="3" a="b"></svg>'),
        ("<svg></svg>", '<svg width="1" height="2" ></svg>'),
    ],
)
def test_root_dimensions(spark, text, expected):
    assert one(spark, M.root_dimensions(F.lit(text), F.lit(1), F.lit(2))) == expected


def test_extreme_numbers(spark):
    big = F.lit(2**31 - 1)
    for ratio, want in ((float("inf"), 1), (float("-inf"), 1), (float("nan"), 1), (None, 1)):
        assert one(spark, C.effective_dpr(F.lit(100), F.lit(100), F.lit(ratio).cast("double"))) == want
    assert one(spark, C.effective_dpr(big, big, F.lit(3))) == 1
    assert one(spark, C.effective_dpr(F.lit(2**62), F.lit(2**62), F.lit(3))) == 1
    width, height = C.internal_render_size(F.lit(2**40), F.lit(2**40))
    assert (one(spark, width), one(spark, height)) == (2**40, 2**40)
    assert one(spark, C.absolute_savings(F.lit(1), F.lit(26_214_400))) == 2**31 - 1
    assert one(spark, C.absolute_savings(F.lit(1), F.lit(2**62))) == 2**31 - 1


def test_extended_magic(spark):
    heads = {"gif": "474946383961", "bmp": "424D0000", "tiff": "4D4D002A", "tif": "49492A00",
             "heif": "0000001C6674797068656963"}
    for extension, head in heads.items():
        content = F.unhex(F.lit(head))
        assert one(spark, C.magic_match(content, F.lit(extension))) is False
        assert one(spark, C.magic_match(content, F.lit(extension), extended=True)) is True
        assert one(spark, C.magic_match(F.unhex(F.lit("00" * 12)), F.lit(extension), extended=True)) is False
    files = spark.createDataFrame([("a.heic", 10, bytes.fromhex(heads["heif"]))],
                                  "name string, size bigint, content binary")
    assert intake.intake_verdict(files).first().status == K.ERROR
    assert intake.intake_verdict(files, extended_magic=True).first().status == K.PENDING


def test_markup_without_comments(spark):
    text = F.lit('<svg><!-- <path d="M0L1"/> --><![CDATA[<b/>]]><a d="M1"/></svg>')
    bare = M.without_comments(text)
    assert (one(spark, M.node_count(bare)), one(spark, M.segment_count(bare))) == (2, 1)
