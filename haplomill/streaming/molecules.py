"""Molecules and mate pairs over unbounded reads, with position or time as event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import scratch_path


def stream_molecules(reads: DataFrame, gap: str, late: str, time: str = "ts", barcode: str = "bx") -> DataFrame:
    """Extents of molecules: a session per barcode closes once no read came within gap and the watermark has passed."""
    s = reads.withWatermark(time, late).groupBy(barcode, F.session_window(time, gap))
    return s.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_reads")).drop("session_window")


def stream_mates(first: DataFrame, second: DataFrame, reach: str, time: str = "ts", read: str = "read") -> DataFrame:
    """Pairs of mates whose times lie within reach. A mate waits in the state store until the watermark says that its
    partner can't come any more, so there is no limit to how many wait, and none is lost for their number."""
    a = first.withWatermark(time, reach).select(F.col(read).alias("read"), F.col(time).alias("t1"))
    b = second.withWatermark(time, reach).select(F.col(read).alias("read2"), F.col(time).alias("t2"))
    return a.join(b, F.expr(f"read = read2 AND t2 BETWEEN t1 - INTERVAL {reach} AND t1 + INTERVAL {reach}")).select("read", "t1", "t2")


def stream_bins(reads: DataFrame, width: str, late: str, time: str = "ts", key: str = "bx") -> DataFrame:
    """Reads of each key in tumbling bins of event time; a read later than the watermark is dropped."""
    g = reads.withWatermark(time, late).groupBy(key, F.window(time, width))
    return g.agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, written by batches to a table in shared storage, and read back."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_path(spark, name + "-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
