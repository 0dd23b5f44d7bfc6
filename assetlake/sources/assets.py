"""Files and folders as asset rows."""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterable, Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions import columns as C, constants as K
from ..plans.ordered import ranked
from ..plans.session import durable, stored

LISTING = "path string, folder boolean, size bigint, modified bigint"
#: A task that has seen this many entries leaves further subfolders to the next round.
WALK_ENTRIES = 10_000
#: Folders, files and bytes of contents that a task is given.
TASK_FOLDERS, TASK_FILES, TASK_BYTES = 100, 10_000, 64 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024
BATCH_ROWS = 10_000


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def scan_assets(
    spark: SparkSession, roots: str | Iterable[str], glob: str | None = None
) -> DataFrame:
    """One row per file below the roots. `content` is read only where a query uses it.

    A filter on `size` reaches the scan, so over-long files are never loaded; one on what is made of
    contents reads them for itself. As with Spark's file scans, files of no bytes and names that begin
    with `_` or `.` are passed over.

    Folders of the `file` scheme are listed by tasks, and the list lies in the shared folder, so the
    driver holds no file. Other schemes only Spark's own scan can open: its driver holds an entry per
    file, and so it does where the session tells it to pass over missing or corrupt files.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    places = local_places(spark, roots)
    if places:
        files = listed_files(spark, places, glob)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        files = reader.load(roots).select(
            "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content"
        )
    return files.select(
        F.col("path").alias("asset_id"),
        "path",
        file_name(F.col("path")).alias("name"),
        "size",
        "modified",
        "content",
    )


def local_places(spark: SparkSession, roots: list[str]) -> list[str] | None:
    """Qualified paths of the roots, if all exist in folders that tasks can open by themselves."""
    if any(
        spark.conf.get(f"spark.sql.files.{kind}", "false").lower() == "true"
        for kind in ("ignoreMissingFiles", "ignoreCorruptFiles")
    ):
        return None
    places = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        path = files.makeQualified(path)
        if not path.toString().startswith("file:/"):
            return None
        if any(c in "{}[]*?\\" for c in path.toString()):
            found = [status.getPath().toString() for status in files.globStatus(path) or []]
        else:
            found = [path.toString()] if files.exists(path) else []
        if not found:
            return None  # Spark's scan says what is missing
        places += found
    return list(dict.fromkeys(places))


def listed_files(spark: SparkSession, places: list[str], glob: str | None) -> DataFrame:
    """(path, size, modified, content) of the files below `places`, dealt into tasks of some size."""
    files = walked(spark, places).filter("size > 0")
    if glob:
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        files = files.filter(file_name(F.col("path")).rlike(rf"\A(?s:{pattern})\z"))
    if len(places) > 1:  # one place may lie below another
        files = files.dropDuplicates(["path"])
    count, size = files.agg(F.count("path"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, ceil(count / TASK_FILES), ceil(size / TASK_BYTES))
    dealt = durable(files.repartition(max(1, min(count, tasks)), "path"))
    # The planner must not take contents to be as small as their list: it would broadcast them.
    unsized = DataFrame(spark._jsparkSession.createDataFrame(dealt._jdf.javaRDD(), dealt._jdf.schema()), spark)
    return unsized.select(
        "path", "size", F.timestamp_micros("modified").alias("modified"), contents("path").alias("content")
    )


def walked(spark: SparkSession, places: list[str]) -> DataFrame:
    """(path, size, modified in microseconds) of every file below `places`, listed in rounds.

    A task lists the folders it is given and goes on into their subfolders until it has seen
    `WALK_ENTRIES`; what it did not come to is dealt to the tasks of the next round.
    """
    folders, count, rounds = spark.createDataFrame([(p,) for p in places], "path string"), len(places), []
    while count:
        tasks = max(spark.sparkContext.defaultParallelism, ceil(count / TASK_FOLDERS))
        dealt = folders.select("path").repartition(min(count, tasks))
        found = stored(dealt.mapInArrow(walk, LISTING), "listing")
        rounds.append(found.filter("NOT folder").drop("folder"))
        folders = found.filter("folder")
        count = folders.count()
    return reduce(DataFrame.unionByName, rounds)


def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LISTING below the given paths: files, and folders that are still to be listed."""
    rows: list[tuple] = []
    seen = 0
    for part in parts:
        for given in part.column(0).to_pylist():
            waiting = [given]
            while waiting:
                place = waiting.pop()
                if place is not given and seen >= WALK_ENTRIES:
                    rows.append((place, True, None, None))
                else:
                    for path, about in entries(place):
                        seen += 1
                        if stat.S_ISDIR(about.st_mode):
                            if seen < WALK_ENTRIES:
                                waiting.append(path)
                            else:
                                rows.append((path, True, None, None))
                        else:
                            # times in milliseconds, as Hadoop has them
                            rows.append((path, False, about.st_size, about.st_mtime_ns // 1_000_000 * 1000))
                        if len(rows) >= BATCH_ROWS:
                            yield listing(rows)
                            rows = []
                if len(rows) >= BATCH_ROWS:
                    yield listing(rows)
                    rows = []
    yield listing(rows)


def listing(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "folder": pa.bool_(), "size": pa.int64(), "modified": pa.int64()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds)
    )


def entries(place: str) -> Iterator[tuple[str, os.stat_result]]:
    """What lies in a folder, or the file itself, without the names that Spark's scans pass over."""
    local = place.removeprefix("file:")
    if os.path.isdir(local):
        with os.scandir(local) as inside:
            for entry in inside:
                try:
                    about = entry.stat()
                except OSError as error:  # a link to nothing
                    if error.errno not in (errno.ENOENT, errno.ELOOP):
                        raise
                    continue
                if not passed_over(entry.name, stat.S_ISDIR(about.st_mode)):
                    yield f"{place.rstrip('/')}/{entry.name}", about
    elif not passed_over(os.path.basename(local), False):
        yield place, os.stat(local)


def passed_over(name: str, folder: bool) -> bool:
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if name.startswith(("_metadata", "_common_metadata")):
        return hidden and not folder
    return hidden or name.endswith("._COPYING_")


@arrow_udf(T.BinaryType())
def contents(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bytes of each file, in batches of about BATCH_BYTES."""
    for part in paths:
        held: list[bytes] = []
        size = 0
        for path in part.to_pylist():
            with open(path.removeprefix("file:"), "rb") as file:
                held.append(file.read())
            size += len(held[-1])
            if size >= BATCH_BYTES:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.binary())


def scan_valid_assets(
    spark: SparkSession, roots: str | Iterable[str], max_bytes: int = K.MAX_FILE_BYTES
) -> DataFrame:
    """Loose files with their intake verdict; content is loaded only for acceptable sizes.

    Two reads of the scan: sizes of all files, contents of those within the limit.
    """
    from ..operators.intake import intake_verdict

    files = scan_assets(spark, roots).filter(C.is_supported(C.file_extension(F.col("name"))))
    small = intake_verdict(files.filter(F.col("size") <= max_bytes), max_bytes=max_bytes)
    large = (
        files.filter(F.col("size") > max_bytes)
        .select("asset_id", "path", "name", "size", "modified")
        .withColumns(
            {
                "content": F.lit(None).cast("binary"),
                "extension": C.file_extension(F.col("name")),
                "error": F.lit(K.ERR_FILE_LIMIT),
                "status": F.lit(K.ERROR),
            }
        )
    )
    return small.unionByName(large)


# Inventories ---------------------------------------------------------------------------------

ADDED, CHANGED, REMOVED, MOVED, SAME = "added", "changed", "removed", "moved", "same"


def inventory(files: DataFrame, key: Column, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """(key, name, size, modified, digest) of files as `scan_assets` gives them.

    key: what names a file within its collection, such as its path below the root; it is unique.
    The digest is the sha256 of the contents. Contents are read once, as the digest is made, and
    leave no task; files above `max_bytes` are not read and have no digest.
    """
    columns = [key.alias("key"), "name", "size", "modified"]
    small = files.filter(F.col("size") <= max_bytes).select(
        *columns, F.sha2("content", 256).alias("digest")
    )
    large = files.filter(F.col("size") > max_bytes).select(
        *columns, F.lit(None).cast("string").alias("digest")
    )
    return small.unionByName(large)


def compare_inventories(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each file between two inventories: (key, was, state, size, digest).

    state: same, changed, added, removed, or moved, with the key it had before in `was`. Files with
    a digest are compared by it; those without, by size and time of change, and they never count
    as moved. A file that is gone and a new one with its contents make a move; of several with the
    same contents, the first by key are paired first, and what is left was removed or added. Each
    file of either side appears once, removed ones with their last size and digest.
    """
    names = ["size", "modified", "digest"]

    def side(inventory: DataFrame, prefix: str) -> DataFrame:
        return inventory.select("key", F.lit(True).alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in names))

    both = side(before, "old").join(side(after, "new"), "key", "full")
    digests = F.col("old_digest").isNotNull() | F.col("new_digest").isNotNull()
    same = F.when(digests, F.col("old_digest").eqNullSafe(F.col("new_digest"))).otherwise(
        (F.col("old_size") == F.col("new_size")) & F.col("old_modified").eqNullSafe(F.col("new_modified"))
    )
    state = (
        F.when(F.col("new").isNull(), REMOVED)
        .when(F.col("old").isNull(), ADDED)
        .when(same, SAME)
        .otherwise(CHANGED)
    )
    # one run of the comparison serves both sides of a move
    rows = stored(
        both.select(
            "key", state.alias("state"),
            *(F.when(F.col("new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in ("size", "digest")),
        ),
        "inventories",
    )
    moving = rows.filter(F.col("state").isin(ADDED, REMOVED) & F.col("digest").isNotNull())
    # places among files of the same contents, on each side, however many there are
    placed = ranked(moving, ["digest", "state"], [F.col("key")], "place")
    gone = placed.filter(F.col("state") == REMOVED).select("digest", "place", F.col("key").alias("was"))
    here = placed.filter(F.col("state") == ADDED).select("digest", "place", "key")
    moves = here.join(gone, ["digest", "place"]).select("key", "was")
    kept = rows.join(moves.select(F.col("was").alias("key")), "key", "left_anti")
    known = kept.join(moves, "key", "left")
    return known.select(
        "key",
        "was",
        F.when(F.col("was").isNotNull(), MOVED).otherwise(F.col("state")).alias("state"),
        "size",
        "digest",
    )
