"""Cutting lineage through tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables written here and not yet removed.
WRITTEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="haplomill-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/haplomill/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in shared storage, read back, and the table's path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in shared storage and read it back, so that a lost executor never
    recomputes what is upstream of it."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table of written(); only once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def clean(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the tables written after the first `since`, but those in keep; only once nothing reads them any more."""
    for path in WRITTEN[since:]:
        if path not in keep:
            remove(spark, path)
