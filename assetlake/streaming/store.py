"""A change log that streams commit to and readers see whole: one base and the deltas behind it.

    manifest.json     names the base, the deltas and the last committed epoch
    base-<number>     everything up to a commit, folded
    delta-<number>    the rows of one epoch

A folder counts once the manifest names it, and the manifest is replaced in one step. So a writer
may stop anywhere: before the manifest is replaced nothing has happened and the replayed epoch
writes the same folder again; afterwards the replayed epoch is known and runs for the state of the
stream alone. After `FOLD_EVERY` deltas they are folded with the base into a new one. Folders of one
fold are deleted at the next, so that readers of the old manifest can finish; their number does not
grow with the age of a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Deltas between two folds.
FOLD_EVERY = 50
MANIFEST = "manifest.json"
#: What Spark calls the id of the stream that runs a batch; it lives in the stream's checkpoint.
QUERY_ID = "sql.streaming.queryId"


class ChangeLog:
    """Rows of one schema under `path`; a single stream writes, anyone reads.

    fold: folds rows of the log into fewer that mean the same.
    """

    def __init__(
        self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame] | None = None
    ):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at(MANIFEST).getFileSystem(self._conf)

    def manifest(self) -> dict | None:
        """What is committed; None before `create`."""
        files, place = self._files(), self._at(MANIFEST)
        if not files.exists(place):
            return None
        stream = files.open(place)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _replace(self, manifest: dict) -> None:
        files, fresh = self._files(), self._at(f"{MANIFEST}.next")
        stream = files.create(fresh, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        fresh, place = files.makeQualified(fresh), files.makeQualified(self._at(MANIFEST))
        context = self._jvm.org.apache.hadoop.fs.FileContext
        context.getFileContext(fresh.toUri(), self._conf).rename(fresh, place, how)

    def _discard(self, names: list[str]) -> None:
        for name in names:
            self._files().delete(self._at(name), True)

    def create(self, base: DataFrame) -> None:
        """Start the log with these rows, unless it exists."""
        if self.manifest() is None:
            base.write.mode("overwrite").parquet(f"{self.path}/base-0")
            nothing = {"number": 0, "run": None, "epoch": -1, "deltas": [], "superseded": []}
            self._replace(nothing | {"base": "base-0"})

    def rows(self) -> DataFrame:
        """All committed rows."""
        known = self.manifest()
        names = [known["base"], *known["deltas"]]
        base = self.spark.read.parquet(f"{self.path}/{known['base']}")
        return self.spark.read.schema(base.schema).parquet(*(f"{self.path}/{n}" for n in names))

    def commit(self, epoch: int, make: Callable[[int], DataFrame], continues: bool = True) -> None:
        """Add the rows that `make` gives for the number of this commit, once per epoch of a stream.

        continues: whether a stream with a new checkpoint may add to the log of an earlier one.
        """
        known = self.manifest()
        run = self.spark._jsc.sc().getLocalProperty(QUERY_ID)
        if known["run"] not in (None, run) and not continues:
            raise ValueError(f"the log {self.path} belongs to a stream whose checkpoint is lost")
        if known["run"] != run or epoch > known["epoch"]:
            number = known["number"] + 1
            name = f"delta-{number}"
            make(number).write.mode("overwrite").parquet(f"{self.path}/{name}")
            known |= {"number": number, "run": run, "epoch": epoch, "deltas": [*known["deltas"], name]}
            self._replace(known)
        else:  # the state of a stream has to see every epoch, whether it is known here or not
            make(known["number"]).write.format("noop").mode("overwrite").save()
        if self.fold and len(known["deltas"]) >= FOLD_EVERY:
            self._folded(known)

    def _folded(self, known: dict) -> None:
        name = f"base-{known['number']}"
        self.fold(self.rows()).write.mode("overwrite").parquet(f"{self.path}/{name}")
        old = known["superseded"]
        now = {"base": name, "deltas": [], "superseded": [known["base"], *known["deltas"]]}
        self._replace(known | now)
        self._discard(old)
