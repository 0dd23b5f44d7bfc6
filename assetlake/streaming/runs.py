"""Running a stream over what is there now, into the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..plans.session import new_shared_path

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A commit writes the changes of an epoch, not all of the state.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keep state outside the JVM heap, and merge sessions of a busy key before the shuffle.

    The stateful processors need this provider.
    """
    wanted = {PROVIDER: ROCKSDB, CHANGELOG: "true", LOCAL_SESSIONS: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything available; the ended query, whose progress can be read."""
    with rocksdb_state(SparkSession.getActiveSession()):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available, append it to files, and read those back."""
    spark = stream.sparkSession
    path = new_shared_path(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append")
    run(writer.option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress"))
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
