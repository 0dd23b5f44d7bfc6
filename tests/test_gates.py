"""Pairing, thresholds and verdicts."""

from pyspark.sql import functions as F

from assetlake.operators import gates as G, pixels as P
from assetlake.sources import configs


def files(spark, *names):
    """Names, in batch 1 or where a name says so (2:name)."""
    rows = [(n, n.rpartition(":")[0] or "1", n.rpartition(":")[2]) for n in names]
    return spark.createDataFrame(rows, "asset_id string, batch_id string, name string")


def test_pairs_and_thresholds(spark):
    pairs = G.pair_outputs(
        files(spark, "a.png", "b.jpg", "c.svg"), files(spark, "a.webp", "a.avif", "b.webp", "c.webp", "a.gif")
    )
    assert {(r.original_name, r.output_name) for r in pairs.collect()} == {
        ("a.png", "a.webp"), ("a.png", "a.avif"), ("b.jpg", "b.webp")}
    thresholds = spark.createDataFrame(
        [("a.png", None, 0.9, None), ("a.png", "webp", None, 20.0), ("a", None, 0.1, 1.0),
         ("b", "webp", 0.5, None)],
        "file string, format string, ssim_min double, psnr_min double",
    )
    found = {r.output_name: (r.ssim_min, r.psnr_min)
             for r in G.resolve_thresholds(pairs, thresholds).collect()}
    assert found == {"a.webp": (0.9, 20.0), "a.avif": (0.9, 30.0), "b.webp": (0.5, 30.0)}


def test_thresholds_are_not_broadcast(spark):
    """Their maps take many times what Spark guesses from the size of their source."""
    rows = [("a.png", "a", "webp"), ("a.png", "a", "png"), ("f7", "f7", "png"), ("f8.png", "f8", "webp"),
            ("f9.png", None, "png"), ("none.png", "none", "png"), (None, "f8", "png")]
    pairs = spark.createDataFrame(rows, "original_name string, base string, format string")
    n = F.col("id") % 100000
    file = F.when(n == 9, "f9.png").otherwise(F.concat(F.lit("f"), n.cast("string")))
    thresholds = spark.range(200000).select(
        file.alias("file"), F.when(F.col("id") < 100000, "webp").alias("format"),
        (n / 200000.0).alias("ssim_min"), F.lit(None).cast("double").alias("psnr_min"),
    )
    found = G.resolve_thresholds(pairs, thresholds)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    limits = {(r.original_name, r.base, r.format): (r.ssim_min, r.psnr_min) for r in found.collect()}
    own = {("f7", "f7", "png"): 7, ("f8.png", "f8", "webp"): 8, ("f9.png", None, "png"): 9, (None, "f8", "png"): 8}
    assert limits == {row: (own[row] / 200000.0 if row in own else 0.98, 30.0) for row in rows}


def test_pairs_stay_in_their_batch(spark):
    both = files(spark, "img.png", "2:img.png")
    found = G.pair_outputs(both, both).select("original_id", "output_id").collect()
    assert sorted(map(tuple, found)) == [("2:img.png", "2:img.png"), ("img.png", "img.png")]


def test_repeated_baselines(spark):
    results = spark.createDataFrame([("a", "png", 1024)], "file string, format string, size bigint")
    baselines = spark.createDataFrame([("a", "png", 512.0), ("a", "png", 2048.0)],
                                      "file string, format string, size_bytes double")
    assert [r.verdict for r in G.size_gate(results, baselines).collect()] == ["pass"]


def test_later_baselines_win(spark):
    """In the order of the table, or of the text they were read from."""
    results = spark.createDataFrame([("a", "png", 1024), ("b", "svg", 1024)], "file string, format string, size bigint")
    schema = "file string, format string, size_bytes double, ordinal int"
    for first, second, verdict in ((512.0, 2048.0, "pass"), (2048.0, 512.0, "fail")):
        table = spark.createDataFrame([("a", "png", second, 2), ("a", "png", first, 1)], schema)
        found = {r.file: r.verdict for r in G.size_gate(results, table).collect()}
        assert found == {"a": verdict, "b": "skipped"}
    text = '{"a": {"png": "9KB", "webp": "9KB"}, "b": "9KB", "a": {"png": "9KB", "png": "0.5KB"}, "b": "0.5KB"}'
    read = configs.baselines_from(spark.createDataFrame([(text,)], "value string"))
    assert sorted(map(tuple, read.collect())) == [("a", "png", 512.0), ("b", "svg", 512.0)]
    assert {r.verdict for r in G.size_gate(results, read).collect()} == {"fail"}
    tolerances = configs.overrides_from(
        spark.createDataFrame([('{"a": {"png": 1}, "a": {"png": 1, "png": 4}}',)], "value string"))
    assert [r.tolerance for r in tolerances.collect()] == [4.0]
    limits = configs.thresholds_from(
        spark.createDataFrame([('{"a": {"ssimMin": 0.1}, "a": {"psnrMin": 3}}',)], "value string"))
    assert [(r.ssim_min, r.psnr_min) for r in limits.collect()] == [(None, 3.0)]


def test_size_gate(spark):
    results = spark.createDataFrame(
        [("a", "png", 28160), ("a", "png", 28262), ("a", "webp", 1), ("z", "png", 1), ("b", "png", 2048)],
        "file string, format string, size bigint",
    )
    baselines = spark.createDataFrame(
        [("a", "png", 25600.0), ("a", "webp", 0.0), ("b", "png", 1024.0)],
        "file string, format string, size_bytes double",
    )
    overrides = spark.createDataFrame([("b", "png", 2.0)], "file string, format string, tolerance double")
    found = [(r.file, r["size"], r.verdict) for r in G.size_gate(results, baselines, overrides).collect()]
    assert sorted(found) == [("a", 1, "skipped"), ("a", 28160, "pass"), ("a", 28262, "fail"),
                             ("b", 2048, "pass"), ("z", 1, "skipped")]


def test_raster_gate(spark):
    rows = [
        ("plain", "png", 0.97, 40.0, 300, 300, False),
        ("palette", "png", 0.36, 12.0, 257, 256, False),
        ("clear", "webp", 0.80, 19.0, 10, 300, True),
        ("opaque", "webp", 0.80, 19.0, 10, 300, False),
        ("clear-png", "png", 0.80, 19.0, 10, 300, True),
    ]
    measured = spark.createDataFrame(
        rows, "id string, format string, ssim double, psnr double, original_colors int, "
        "output_colors int, has_alpha boolean"
    ).withColumns({"ssim_min": F.lit(0.98), "psnr_min": F.lit(30.0)})
    gated = G.raster_gate(measured)
    assert {r.id for r in gated.collect() if r.passed} == {"palette", "clear"}
    summary = G.gate_summary(gated).first()
    assert (summary.pairs, summary.failures, summary.verdict) == (5, 3, "failed")
    assert G.gate_summary(gated.filter("false")).first().verdict == "skipped"
    assert G.gate_summary(gated.filter("passed")).first().verdict == "passed"


def test_svg_gate(spark):
    measured = spark.createDataFrame(
        [("a", 0.995, 1.08), ("b", 0.995, 1.07), ("c", 0.99, 2.0)],
        "pair_id string, ssim double, sharpness_ratio double",
    )
    assert [r.pair_id for r in G.svg_gate(measured).collect() if r.passed] == ["a"]


def test_measured_pairs(spark):
    """Transparent original: flattened for a jpeg, left alone for webp; sizes are aligned."""
    def grid(name, size, rgba):
        return (name, size, size, 4, list(rgba) * (size * size))

    schema = "asset_id string, width int, height int, channels int, samples array<int>"
    originals = P.grid_lines(spark.createDataFrame([grid("o", 4, (200, 100, 50, 0))], schema))
    outputs = P.grid_lines(
        spark.createDataFrame(
            [grid("black", 8, (0, 0, 0, 255)), grid("same", 4, (200, 100, 50, 0))], schema
        )
    )
    pairs = spark.createDataFrame(
        [("p1", "o", "black", "jpg"), ("p2", "o", "same", "webp"), ("p3", "o", "black", "webp")],
        "pair_id string, original_id string, output_id string, format string",
    ).withColumns({"ssim_min": F.lit(0.98), "psnr_min": F.lit(30.0)})
    rows = {r.pair_id: r for r in G.raster_gate(G.measure_pairs(pairs, originals, outputs)).collect()}
    assert (rows["p1"].passed, rows["p1"].has_alpha, rows["p1"].ssim) == (True, False, 1.0)
    assert (rows["p2"].passed, rows["p2"].has_alpha, rows["p2"].psnr_min) == (True, True, 19.0)
    assert rows["p3"].passed is False
    vector = G.measure_vector_pairs(pairs.filter("pair_id = 'p2'"), originals, outputs).first()
    assert (vector.ssim, vector.sharpness_ratio) == (1.0, 1.0)


def test_unreadable_and_unequal_sides(spark):
    def grid(name, w, h, v):
        return (name, w, h, 4, [v, v, v, 255] * (w * h))

    schema = "asset_id string, width int, height int, channels int, samples array<int>"
    lines = P.grid_lines(
        spark.createDataFrame([grid("a", 4, 4, 9), grid("b", 4, 4, 9), grid("tall", 4, 6, 9)], schema)
    )
    pairs = spark.createDataFrame(
        [("ok", "a", "b", "png"), ("lost", "a", "none", "png"), ("lost2", "none", "a", "webp")],
        "pair_id string, original_id string, output_id string, format string",
    ).withColumns({"ssim_min": F.lit(0.98), "psnr_min": F.lit(30.0)})
    gated = G.raster_gate(G.measure_pairs(pairs, lines, lines))
    rows = {r.pair_id: (r.passed, r.error is None) for r in gated.collect()}
    assert rows == {"ok": (True, True), "lost": (False, False), "lost2": (False, False)}
    summary = G.gate_summary(gated).first()
    assert (summary.pairs, summary.failures, summary.verdict) == (3, 2, "failed")
    vector = G.svg_gate(G.measure_vector_pairs(pairs, lines, lines), sharpness_min=0.0)
    assert {r.pair_id for r in vector.collect() if r.passed} == {"ok"}
    raw = lines.filter("asset_id = 'tall'").withColumns({"pair_id": F.lit("p"), "original_id": F.lit("a")})
    assert P.psnr(P.pair_lines(raw, lines)).first().psnr == 0.0
