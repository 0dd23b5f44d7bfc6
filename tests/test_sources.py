"""Readers and writers on files the test makes."""

import hashlib
import io
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assetlake.functions import constants as K
from assetlake.operators import intake, pixels as P
from assetlake.sources import archives, assets, configs, exports, images
from assetlake.suite import ORACLE, QUERIES
from assetlake.suite.files import document, written


def png(pixels):
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]

    def chunk(tag, body):
        crc = zlib.crc32(tag + body)
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", crc)

    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    header = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    made = {}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, shape in {"rgb.png": (5, 7, 3), "deep/rgba.png": (4, 4, 4), "deep/er/grey.png": (3, 6, 1)}.items():
        made[name.split("/")[-1]] = pixels = rng.integers(0, 256, shape)
        (tmp_path / name).write_bytes(png(pixels))
    (tmp_path / "a b+c%.png").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_bytes(b"x")
    return tmp_path, made


def test_scan_assets(spark, folder):
    root, _ = folder
    found = {r.name: r.size for r in assets.scan_assets(spark, str(root)).drop("content").collect()}
    assert set(found) == {"rgb.png", "rgba.png", "grey.png", "a b+c%.png", "note.txt"}
    assert found["note.txt"] == 1
    only = assets.scan_assets(spark, [str(root / "deep")], "*.png")
    assert {r.name for r in only.collect()} == {"rgba.png", "grey.png"}


def test_scan_lists_what_spark_lists(spark, tmp_path):
    """Odd names, links, nested roots, patterns and times: rows as Spark's own scan gives them."""
    for name in ["a b+c%.png", "_hidden/x.txt", "_k=1/y.txt", ".dot/z.txt", "sub/_metadata", "sub/._x", "sub/w._COPYING_",
                 "_metadata_dir/m.txt", "sub/_k=2.txt", "é/ü.txt", "plain.txt", "c%20d/e#f.txt", "sub/deep/p$(1).txt",
                 "sub/deep/new\nline.txt", "sub/x.PNG"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "hollow" / "folder").mkdir(parents=True)
    for link, target in {"linked": "sub", "link.txt": "plain.txt", "broken": "nothing", "loop": "loop"}.items():
        (tmp_path / link).symlink_to(tmp_path / target)
    root = str(tmp_path)
    columns = ["path", "size", "modified", "content"]

    def spark_scan(roots, glob):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(roots)
        return rows.select("path", "length", "modificationTime", "content")

    for roots, glob in [
        ([root], None), ([f"file:{root}/"], "*.txt"), ([root], "[!a-l]*.{txt,PNG}"), ([root], "?$(1).t*"),
        ([root, f"{root}/sub", f"{root}/sub/deep", root], None), ([f"{root}/_hidden"], None),
        ([f"{root}/a b+c%.png", f"{root}/_hidden/x.txt"], None), ([f"{root}/sub*/d*"], None),
        ([f"{root}/hollow"], None), ([f"{root}/sub/_metadata"], None), ([f"{root}/linked"], None),
    ]:
        found = assets.scan_assets(spark, roots, glob).select(*columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, spark_scan(roots, glob).collect())), (roots, glob)
    assert assets.scan_assets(spark, []).count() == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        assets.scan_assets(spark, [root, f"{root}/nothing"])


def test_scan_leaves_no_file_to_the_driver(spark, tmp_path):
    """Tasks list folders, in rounds; the plan that the driver holds names no file and no size."""
    for i in range(3):
        (tmp_path / f"far{i}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"far{i}" / "deep" / "er" / f"last{i}.txt").write_bytes(b"z")
    (tmp_path / "wide").mkdir()
    for i in range(assets.WALK_ENTRIES + 5):
        (tmp_path / "wide" / f"{i}.txt").write_bytes(b"1")
    files = assets.scan_assets(spark, [str(tmp_path / "wide"), str(tmp_path)])
    plan = files._jdf.queryExecution()
    assert not files.inputFiles() and "InMemoryFileIndex" not in plan.toString()
    assert plan.optimizedPlan().stats().sizeInBytes() > 2**60
    assert files.rdd.getNumPartitions() >= 2
    found = [r.path for r in files.select("path").collect()]
    assert len(found) == len(set(found)) == assets.WALK_ENTRIES + 8
    assert sum("/er/last" in path for path in found) == 3


def test_walk_hands_on_what_it_did_not_reach(tmp_path, monkeypatch):
    monkeypatch.setattr(assets, "WALK_ENTRIES", 4)
    monkeypatch.setattr(assets, "BATCH_ROWS", 3)
    for i in range(6):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.txt").write_bytes(b"12")
    waiting, files, rounds = [f"file:{tmp_path}"], [], 0
    while waiting:
        rows = [r for b in assets.walk(iter([assets.listing([(p, True, 0, 0) for p in waiting])])) for r in b.to_pylist()]
        waiting = [r["path"] for r in rows if r["folder"]]
        files += [(r["path"], r["size"]) for r in rows if not r["folder"]]
        rounds += 1
    assert sorted(files) == [(f"file:{tmp_path}/d{i}/f.txt", 2) for i in range(6)] and rounds == 2


def test_contents_leave_in_small_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(assets, "BATCH_BYTES", 10)
    bodies = [b"a" * 6, b"", b"b" * 6, b"c" * 30, b"d"]
    paths = []
    for i, body in enumerate(bodies):
        (tmp_path / f"{i}.gz").write_bytes(body)
        paths.append(f"file:{tmp_path}/{i}.gz")
    batches = list(assets.contents.func(iter([pa.array(paths), pa.array([], pa.string()), pa.array(paths[:1])])))
    assert [len(b) for b in batches] == [3, 1, 1, 1]
    assert [v for b in batches for v in b.to_pylist()] == bodies + bodies[:1]


def test_scan_keeps_what_only_spark_does(spark, folder):
    """A session that passes over missing files has Spark's scan."""
    root, _ = folder
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        files = assets.scan_assets(spark, str(root))
        (root / "note.txt").unlink()
        assert {r.name for r in files.collect()} == {"rgb.png", "rgba.png", "grey.png", "a b+c%.png"}
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")


def test_valid_assets_prune_content(spark, folder):
    root, _ = folder
    rows = assets.scan_valid_assets(spark, str(root), max_bytes=130)
    found = {r.name: (r.status, r.error) for r in rows.collect()}
    assert found["a b+c%.png"] == ("error", K.ERR_INVALID)
    assert found["grey.png"] == ("pending", None)
    assert found["rgb.png"] == ("error", K.ERR_FILE_LIMIT)
    assert "note.txt" not in found
    plan = assets.scan_assets(spark, str(root)).select("name", "size")._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]


def test_images(spark, folder):
    root, made = folder
    (root / "note.txt").unlink()
    scanned = images.scan_images(spark, str(root))
    errors = {r.asset_id.split("/")[-1]: r.error for r in scanned.drop("data").collect()}
    assert [n for n, e in errors.items() if e == K.ERR_DECODE] == ["a%20b+c%25.png"]
    lines = images.image_lines(scanned, pixels_per_batch=10)
    got = {}
    for r in lines.collect():
        name = r.asset_id.split("/")[-1]
        got.setdefault(name, np.zeros((r.height, r.width, 4), int))[r.y] = np.array(r.samples).reshape(-1, 4)
    assert set(got) == set(made)
    for name, pixels in made.items():
        want = np.full((*pixels.shape[:2], 4), 255)
        want[..., :3] = pixels[..., :3] if pixels.shape[2] > 1 else pixels
        if pixels.shape[2] == 4:
            want[..., 3] = pixels[..., 3]
        assert (got[name] == want).all(), name
    colours = P.unique_colors(P.explode_pixels(lines))
    assert colours.count() == 3


def test_dimension_invariant(spark, folder):
    root, _ = folder
    (root / "note.txt").unlink()
    scanned = images.scan_images(spark, str(root)).filter("error is null")
    expected = scanned.select("asset_id", F.lit(7).alias("width"), F.lit(5).alias("height"))
    rows = intake.dimension_invariant(scanned.drop("error"), expected)
    errors = {r.asset_id.split("/")[-1]: r.error for r in rows.collect()}
    assert errors["rgb.png"] is None
    assert errors["rgba.png"] == (
        "SVG dimension invariant failed at post-encode: expected 7x5, got 4x4"
    )


def archive(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/", 1) if name.startswith("dir") else name, body)
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    ok = b"\x89PNG\r\n\x1a\n" + b"0" * 20
    good = archive(**{"a.png": ok, "dir__b.PNG": ok, "bad.png": b"zz", "empty.png": b"", "n.txt": b"t",
                      "__MACOSX/c.png": ok, "x.jxl": ok})
    many = archive(**{f"f{i}.png": ok for i in range(30)})
    heavy = archive(**{"h.png": ok + b"0" * 5000})
    for name, body in {"good.zip": good, "many.zip": many, "heavy.zip": heavy, "broken.zip": b"PK",
                       "long.zip": good + b"0" * 40000, "UP.ZIP": good}.items():
        (tmp_path / name).write_bytes(body)
    rows = archives.expand_archives(
        assets.scan_assets(spark, str(tmp_path)), max_members=20, max_bytes=4000, max_zip_bytes=20000
    ).collect()
    good_rows = {r.name: (r.size, r.status, r.error) for r in rows if "good.zip" in r.archive_path}
    assert good_rows == {
        "a.png": (28, "pending", None),
        "b.PNG": (28, "pending", None),
        "bad.png": (0, "error", K.ERR_INVALID),
        "x.jxl": (0, "error", K.ERR_INVALID),
    }
    whole = {r.name: r.error for r in rows if "good.zip" not in r.archive_path}
    assert whole["many.zip"] == K.ERR_ZIP_PREFIX + K.ERR_ZIP_COUNT
    assert whole["heavy.zip"] == K.ERR_ZIP_PREFIX + K.ERR_ZIP_BYTES
    assert whole["broken.zip"].startswith(K.ERR_ZIP_PREFIX)
    assert whole["long.zip"] == K.ERR_ZIP_LIMIT
    assert len(whole) == 4


def test_archive_limits_crossed_at_once(spark):
    """A member may cross both limits; sizes may be unknown."""
    sizes = {"both": [1, 1, 9], "count": [1, 1, 1, 9], "bytes": [1, 9, 1], "unknown": [None, None, 9, 9],
             "nothing": [None, None, None]}
    members = spark.createDataFrame(
        [(a, i, s) for a, held in sizes.items() for i, s in enumerate(held)],
        "archive_path string, position int, size bigint",
    )
    for tie in (K.ERR_ZIP_COUNT, K.ERR_ZIP_BYTES):
        _, over = intake.archive_limits(members, max_members=2, max_bytes=8, tie=tie)
        errors = {r.archive_path: r.error.removeprefix(K.ERR_ZIP_PREFIX) for r in over.collect()}
        assert errors == {"both": tie, "count": K.ERR_ZIP_COUNT, "bytes": K.ERR_ZIP_BYTES,
                          "unknown": tie, "nothing": K.ERR_ZIP_COUNT}


def test_archive_limits_query_follows_its_sql(spark, tmp_path):
    """The 41st member of the archive crosses both limits; without sizes only the count is over."""
    rows = [(i, "a", "x" * (80_000 if i == 40 else 1_000), "en") for i in range(45)]
    rows += [(100 + i, "b", None, "en") for i in range(45)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string, lang string")
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r.archive_path, r.error) for r in QUERIES["archive_limits"](spark, str(tmp_path)).collect()}
    want = {(a, error) for a, *_, error in con.execute(ORACLE["archive_limits"]).fetchall()}
    assert got == want == {
        ("a", K.ERR_ZIP_PREFIX + K.ERR_ZIP_BYTES), ("b", K.ERR_ZIP_PREFIX + K.ERR_ZIP_COUNT)}


def test_configs(spark, tmp_path):
    (tmp_path / "expected.jsonc").write_text(
        '{\n // ceilings\n "a.svg": { "webp": "19.1KB", "png": "42.7KB" }, /* one\n line */\n'
        ' "b.svg": "0.7KB", "c.png": {"png": "2MB"}\n}'
    )
    found = {(r.file, r.format): r.size_bytes
             for r in configs.load_baselines(spark, str(tmp_path / "expected.jsonc")).collect()}
    assert found == {("a.svg", "webp"): pytest.approx(19558.4), ("a.svg", "png"): pytest.approx(43724.8),
                     ("b.svg", "svg"): pytest.approx(716.8), ("c.png", "png"): 2097152}
    (tmp_path / "overrides.jsonc").write_text("{\n // none\n}")
    assert configs.load_overrides(spark, str(tmp_path / "overrides.jsonc")).count() == 0
    (tmp_path / "t.jsonc").write_text(
        '{"_comment": "x", "a.png": {"ssimMin": 0.9, "formats": {"webp": {"psnrMin": 20}}},'
        ' "b.png": {"psnrMin": 25}}'
    )
    rows = {(r.file, r.format): (r.ssim_min, r.psnr_min)
            for r in configs.load_thresholds(spark, str(tmp_path / "t.jsonc")).collect()}
    assert rows == {("a.png", None): (0.9, None), ("a.png", "webp"): (None, 20.0),
                    ("b.png", None): (None, 25.0)}
    (tmp_path / "bad.jsonc").write_text('{"a": ')
    assert configs.load_thresholds(spark, str(tmp_path / "bad.jsonc")).count() == 0


def test_export(spark, tmp_path):
    rows = [("1", i, "pic.png", f, "success", 10, bytearray([i])) for i, f in
            enumerate(["jpeg", "jpeg", "webp", "jpeg"])] + [("2", 0, "x.png", "png", "error", 1, bytearray())]
    results = spark.createDataFrame(
        rows, "batch_id string, ordinal int, name string, format string, status string, size bigint, "
        "content binary"
    )
    manifest = exports.export_batch(results, str(tmp_path / "out"), max_bytes=30)
    assert {(r.batch_id, r.ordinal, r.position, r.export_name) for r in manifest.collect()} == {
        ("1", 0, 1, "pic.jpg"), ("1", 1, 2, "pic-2.jpg"), ("1", 2, 3, "pic.webp")}
    files = spark.read.parquet(str(tmp_path / "out" / "files"))
    assert {(r.export_name, bytes(r.content)) for r in files.collect()} == {
        ("pic.jpg", b"\x00"), ("pic-2.jpg", b"\x01"), ("pic.webp", b"\x02")}


def test_inventories(spark, tmp_path):
    """Copies pair up in order of their keys; files above the limit go by size and time."""
    def put(root, files):
        for name, body in files.items():
            path = tmp_path / root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body)

    put("old", {"a/same": b"1", "a/changed": b"2", "a/moved": b"3", "a/gone": b"4", "e1": b"copy", "e2": b"copy",
                "e3": b"copy", "big": b"x" * 100, "big-moved": b"y" * 100})
    put("new", {"a/same": b"1", "a/changed": b"two", "b/moved": b"3", "fresh": b"5", "e0": b"copy", "e2": b"copy",
                "f": b"copy", "f2": b"copy", "f3": b"copy", "big": b"z" * 101, "big-new": b"y" * 100})

    def listed(root):
        key = F.regexp_extract("path", f"/{root}/(.*)$", 1)
        return assets.inventory(assets.scan_assets(spark, str(tmp_path / root)), key, max_bytes=50)

    before, after = listed("old"), listed("new")
    digests = {r.key: r.digest for r in before.collect()}
    assert digests["a/same"] == hashlib.sha256(b"1").hexdigest() and digests["big"] is None
    rows = assets.compare_inventories(before, after).collect()
    assert {r.key: (r.state, r.was) for r in rows} == {
        "a/same": ("same", None), "a/changed": ("changed", None), "b/moved": ("moved", "a/moved"),
        "a/gone": ("removed", None), "fresh": ("added", None), "e2": ("same", None),
        "e0": ("moved", "e1"), "f": ("moved", "e3"), "f2": ("added", None), "f3": ("added", None),
        "big": ("changed", None), "big-moved": ("removed", None), "big-new": ("added", None),
    }
    assert len(rows) == 13 and {r["size"] for r in rows if r.key == "a/changed"} == {3}
    nothing = before.filter("false")
    assert {r.state for r in assets.compare_inventories(nothing, after).collect()} == {"added"}
    assert {r.state for r in assets.compare_inventories(before, before).collect()} == {"same"}


def test_written_files_share_folders(spark, tmp_path):
    """2,500 texts take a folder per 1,000 files of a task; none is lost, repeated names included."""
    rows = [(f"doc{i // 2}", f"text {i}\né") for i in range(2500)]
    texts = spark.createDataFrame(rows, "name string, text string").coalesce(1)
    files = written(texts, str(tmp_path / "many"))
    found = assets.inventory(files, document()).select("key", "digest").collect()
    assert sorted(map(tuple, found)) == sorted(
        (name, hashlib.sha256(f"{text}\n".encode()).hexdigest()) for name, text in rows
    )
    assert len({r.path.rsplit("/", 1)[0] for r in files.select("path").collect()}) == 3
    assert written(texts.filter("false"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["scan_assets", "compare_inventories"])
def test_file_queries_follow_their_sql(spark, tmp_path, name):
    """Texts that repeat, are empty or missing; what the scans give does not name the files."""
    rows = [(i, None if i % 13 == 5 else "" if i % 13 == 6 else f"text é {i % 40}\n") for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(tmp_path))
    assert not [path for path in got.inputFiles() if path.endswith(".txt")]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
