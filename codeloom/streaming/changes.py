"""A stream of file changes kept as versions of a table: the incremental form of scanning a tree again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

EVENT = "path string, content string, is_deletion boolean, seq bigint, at timestamp"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path by seq; of two with the same seq the one that isn't a deletion, then the later content."""
    order = F.struct("seq", (~F.col("is_deletion")).alias("kept"), "content")
    last = events.where("path is not null").groupBy("path").agg(F.max_by(F.struct("content", "is_deletion", "seq"), order).alias("e"))
    return last.select("path", "e.*")


def merged(state: DataFrame, events: DataFrame) -> DataFrame:
    """state (path, content, is_deletion, seq) after events; deletions stay as rows, so that late older events lose."""
    columns = ["path", "content", "is_deletion", "seq"]
    return latest(state.select(columns).unionByName(events.select(columns)))


def versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions of the table, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def forget(spark: SparkSession, table: str, kept: int = 3) -> None:
    """Deletes all but the newest complete versions: a batch that runs again needs the one before it."""
    for v in versions(spark, table)[:-kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The newest complete version (path, content, is_deletion, seq), or that before a batch; empty if there is none."""
    known = [v for v in versions(spark, table) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], EVENT).drop("at")
    return spark.read.parquet(f"{table}/v={known[-1]}")


def maintain(events: DataFrame, table: str, checkpoint: str, delay: str = "1 hour", kept: int = 3) -> DataStreamWriter:
    """A writer that merges each batch of a stream of EVENT rows into a new version of table; the newest `kept` stay.

    Repeated events are dropped within the delay.  A batch that runs again after a failure starts from the version
    before it and overwrites its own, so every event counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        merged(current(batch.sparkSession, table, number), batch).write.mode("overwrite").parquet(f"{table}/v={number}")
        forget(batch.sparkSession, table, kept)

    fresh = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["path", "seq"])
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
