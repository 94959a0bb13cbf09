"""Tables written to the shared checkpoint folder, to cut lineage so that lost executors cost no recomputation of it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine (as in tests), a temporary one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` and reads it back; the files go when the driver ends, or by `drop`."""
    spark = df.sparkSession
    path = f"{folder(spark)}/scenewright-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, name: str) -> str:
    """The address of a new folder in the shared folder, which goes when the driver ends."""
    at = f"{folder(spark)}/scenewright-{name}-{uuid.uuid4().hex}"
    at = f"file://{at}" if at.startswith("/") else at
    keep_until_end(spark, at)
    return at


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `saved` wrote; nothing may read them later."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            for path in [p for p in _written if p.rsplit("/", 1)[1] in f]:
                _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    _written[path] = spark


@atexit.register
def _clear() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return
