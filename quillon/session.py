"""Sessions and the tables of a directory."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of a data directory, one Parquet file or folder each.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: What the engine asks of a session. Shuffle partitions are the cluster's choice: adaptive
#: execution coalesces small ones and splits skewed ones.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("quillon")
    if master:
        builder = builder.master(master)
    for key, value in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str = "q") -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, which all executors
    share; deleted when the driver exits. Only where all runs on this machine it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def sql_over(spark: SparkSession, sf_dir: str, text: str, *names: str, **args) -> DataFrame:
    """A query whose tables, given by name, are those of ``sf_dir``. Views are replaced by
    the next call; the returned frame keeps the tables it was analysed with."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args or None)
