"""The change feed of a versioned table.

Each statement of a table adds its row events under ``changes/lsn=<n>`` once it counts. A subscription
is a file-source stream over that folder: its checkpoint holds the position, ``limit`` is
files a batch, and the stream is stateless, so any lost task is read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.store import Folder, VersionedTable, replay


def subscribe(table: VersionedTable, from_lsn: int = 0, limit: int | None = None, ops: tuple[str, ...] = ("PUT", "DELETE"), keys_only: bool = False) -> DataFrame:
    """The events after ``from_lsn`` as a stream: lsn, op and the row, or its key alone."""
    shape = table.changes().schema
    reader = table.spark.readStream.schema(shape)
    if limit:
        reader = reader.option("maxFilesPerTrigger", limit)
    events = reader.parquet(f"{table.path}/changes").withColumn("lsn", F.col("lsn").cast("long"))
    events = events.filter((F.col("lsn") > from_lsn) & F.col("op").isin(*ops))
    return events.select("lsn", "op", *table.key) if keys_only else events.select("lsn", "op", *[f.name for f in shape if f.name not in ("lsn", "op")])


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Delivers all events that are there and ends; a later call goes on from there."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def follow(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "50 milliseconds") -> StreamingQuery:
    """Delivers events as they come, until the query is stopped."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def events(table: VersionedTable, from_lsn: int = 0, limit: int | None = None) -> DataFrame:
    """The feed as a table, in order: what a statement that shows it returns."""
    rows = table.changes().filter(F.col("lsn") > from_lsn).orderBy("lsn", *table.key)
    return rows.limit(limit) if limit else rows


class Replica:
    """The latest state of a table, kept up from its feed. A batch is applied once: the
    version that holds it is named after it, and a version that exists isn't written again."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], like: DataFrame):
        self.spark, self.path, self.key, self.like, self.folder = spark, path.rstrip("/"), key, like.limit(0), Folder(spark, path)

    def _newest(self) -> int:
        return max((int(n[2:]) for n in self.folder.names() if n.startswith("b=") and self.folder.exists(n, "_SUCCESS")), default=-1)

    def read(self) -> DataFrame:
        n = self._newest()
        return self.like if n < 0 else self.spark.read.schema(self.like.schema).parquet(f"{self.path}/b={n}")

    def apply(self, batch: DataFrame, number: int) -> None:
        if self.folder.exists(f"b={number}", "_SUCCESS"):
            return
        replay(self.read(), batch, self.key).write.mode("overwrite").parquet(f"{self.path}/b={number}")
