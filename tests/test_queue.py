"""Tasks, results, statistics and intake on hand-made rows."""

from pyspark.sql import functions as F

from assetlake.functions import constants as K
from assetlake.operators import intake, stats, tasks

ITEM = (
    "asset_id string, name string, status string, progress int, original_size bigint, "
    "original_format string, ordinal bigint"
)
RESULT = "asset_id string, format string, status string, size bigint, label string, error string"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def results(spark, *rows):
    return spark.createDataFrame(list(rows), RESULT)


def feed(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "type string, asset_id string, format string, seq bigint, size bigint, label string, "
        "error string",
    )


def test_success_and_failure(spark):
    queue = items(spark, ("i1", "a.png", "processing", 0, 10, "png", 1),
                  ("i2", "b.png", "processing", 0, 10, "png", 2),
                  ("i3", "c.png", "pending", 0, 10, "png", 3))
    open_results = results(
        spark, ("i1", "webp", "processing", None, None, None),
        ("i2", "webp", "processing", None, None, None),
        ("i2", "avif", "pending", None, None, None),
    )
    outcomes = tasks.merge_outcomes(
        feed(spark, ("RESULT", "i1", "webp", 1, 3, "WEBP", None),
             ("RESULT", "i2", "webp", 2, 4, "WEBP", None),
             ("RESULT", "i9", "webp", 3, 5, "WEBP", None),
             ("RESULT", "i1", "png", 4, 5, "PNG", None)),
        feed(spark, ("TASK", "i2", "webp", 0, None, None, None)),
    )
    folded = tasks.apply_results(open_results, outcomes)
    found = {(r.asset_id, r.format): (r.status, r.size, r.error) for r in folded.collect()}
    assert found == {
        ("i1", "webp"): ("success", 3, None),
        # The error comes last; the size of the earlier success stays.
        ("i2", "webp"): ("error", 4, K.ERR_WORKER),
        ("i2", "avif"): ("pending", None, None),
    }
    status = {r.asset_id: (r.status, r.progress) for r in tasks.item_status(queue, folded).collect()}
    assert status == {"i1": ("success", 100), "i2": ("processing", 0), "i3": ("pending", 0)}


def test_expand(spark):
    queue = items(spark, ("i1", "a.jpg", "pending", 0, 1, "jpg", 1),
                  ("i2", "b.png", "error", 0, 1, "png", 2))
    formats = F.array(F.lit("webp"), F.lit("jpeg"), F.lit("webp"))

    def listed(**options):
        found = tasks.expand_tasks(queue, formats, **options).orderBy("task_ordinal").collect()
        return [(r.asset_id, r.format) for r in found]

    assert listed() == [("i1", "jpeg")]
    assert listed(use_original=False) == [("i1", "webp"), ("i1", "jpeg")]
    assert listed(use_original=False, include_original=True) == [("i1", "jpeg"), ("i1", "webp")]


def test_reapply(spark):
    queue = items(spark, ("i1", "a.png", "processing", 40, 1, "png", 1),
                  ("i2", "b.png", "success", 100, 1, "png", 2))
    old = results(spark, ("i1", "webp", "processing", None, None, None),
                  ("i2", "webp", "success", 5, "WEBP", None))
    formats = F.array(F.lit("avif"))

    def run(**options):
        new_items, new = tasks.reapply_options(queue, old, formats, use_original=False, **options)
        return (
            {r.asset_id: (r.status, r.progress) for r in new_items.collect()},
            {(r.asset_id, r.format, r.status) for r in new.collect()},
        )

    reset = ("pending", 0)
    assert run() == ({"i1": reset, "i2": ("success", 100)},
                     {("i1", "avif", "pending"), ("i2", "webp", "success")})
    assert run(force_all=True) == ({"i1": reset, "i2": reset},
                                   {("i1", "avif", "pending"), ("i2", "avif", "pending")})
    only = spark.createDataFrame([("i2",)], "asset_id string")
    assert run(ids=only) == ({"i1": ("processing", 40), "i2": reset},
                             {("i1", "webp", "processing"), ("i2", "avif", "pending")})


def test_clear_and_stats(spark):
    queue = items(spark, ("done", "a", "success", 100, 1000, "png", 1),
                  ("keep", "b", "processing", 0, 500, "png", 2)).withColumn(
        "optimized_size", F.when(F.col("asset_id") == "done", 600).otherwise(0))
    assert [r.asset_id for r in tasks.clear_finished(queue).collect()] == ["keep"]
    row = stats.queue_stats(queue).first()
    assert (row.total_original, row.total_optimized, row.savings_pct) == (1500, 600, 60.0)
    assert (row.all_done, row.successful, row.processing, row.zero_errors) == (False, 1, 1, True)
    empty = stats.queue_stats(queue.filter("false")).first()
    assert (empty.items, empty.all_done, empty.has_finished, empty.savings_pct) == (0, False, False, 0)


def test_codecs(spark):
    log = spark.createDataFrame(
        [(1, "old", "webp", True), (2, "new", "webp", True), (3, "old", "avif", True),
         (4, "none", "png", False)],
        "seq int, id string, format string, encode boolean",
    )
    wanted = spark.createDataFrame([("webp",), ("avif",), ("png",)], "format string")
    found = {r.format: r.codec_id for r in tasks.pick_codec(wanted, log).collect()}
    assert found == {"webp": "new", "avif": "old", "png": None}
    default = {r.format: r.codec_id for r in tasks.pick_codec(wanted, tasks.codecs(spark)).collect()}
    assert default == {"webp": "libwebp", "avif": "aomenc", "png": "imagequant-oxipng"}


def test_encode_plan(spark):
    rows = [("photo", "webp", True, True), ("graphic", "png", True, True), ("photo", "png", True, True),
            ("graphic", "jxl", True, True), ("graphic", "jpeg", True, False)]
    wanted = spark.createDataFrame(
        rows, "preset string, format string, has_alpha boolean, small_transparent boolean"
    )
    plan = {
        (r.preset, r.requested_format): (r.encoder, r.quality, r.quality_max, r.flatten_alpha,
                                         r.fallback_preset)
        for r in tasks.encode_plan(wanted).collect()
    }
    assert plan == {
        ("photo", "webp"): ("webp", 77, None, False, None),
        ("graphic", "png"): ("png", 58, 78, False, "photo"),
        ("photo", "png"): ("png", 90, 98, False, None),
        ("graphic", "jxl"): ("webp", 74, None, False, "photo"),
        ("graphic", "jpeg"): ("jpeg", 76, None, True, "photo"),
    }


def test_intake(spark):
    png = bytearray.fromhex("89504E470D0A1A0A")
    files = spark.createDataFrame(
        [("first.png", 8, png), ("a.txt", 8, png), ("a.ZIP", 8, png), ("a.gif", 8, png),
         ("big.png", 10**8, png), ("x.heic", 8, png)],
        "name string, size bigint, content binary",
    )
    found = {r.name: (r.status, r.error) for r in intake.intake_verdict(files).collect()}
    assert found == {
        "first.png": ("pending", None),
        "a.gif": ("error", K.ERR_INVALID),
        "big.png": ("error", K.ERR_FILE_LIMIT),
        "x.heic": ("error", K.ERR_INVALID),
    }


def test_stage_timing(spark):
    marks = spark.createDataFrame(
        [("t", "s", 0), ("t", "d", 10), ("t", "d", 99), ("t", "e", 40)],
        "task string, mark string, at_ms bigint",
    )
    row = stats.stage_timing(marks, ["task"], ("s", "d", "c", "e")).first()
    assert (row.decode_ms, row.classify_ms, row.encode_ms) == (10, None, None)
