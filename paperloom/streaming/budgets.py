"""Streaming forms of token budgets, job states and upload arrival, and time slices for their replay in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def token_load(calls: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Tokens by provider over sliding windows; calls later than the watermark are dropped."""
    sliding = F.window("ts", window, slide)
    return calls.withWatermark("ts", late).groupBy("provider", sliding.alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).select("provider", "w.start", "w.end", "tokens", "calls")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job, for output mode update or complete."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))


def arrivals(spark: SparkSession, path: str, schema: str, key: str = "sha256", late: str = "10 minutes") -> DataFrame:
    """New files of a folder as a stream, each checksum once within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def time_slices(calls: DataFrame, reach: int, least: int = 3_600_000_000) -> DataFrame:
    """calls with slice and own: calls (time ``us`` in microseconds) in slices of time, for windows that look back by ``reach``.

    A window by provider alone would put all calls of a provider in one task. Here it is a window by provider and slice: each
    slice also holds copies (own is false) of the calls of the last ``reach`` before it. Windows must not look further back
    than that for anything that decides their result; copies are dropped after them. A null time makes a slice of its own.
    """
    width = max(least, reach)
    slice_ = ((F.col("us") - F.pmod("us", F.lit(width))) / width).cast("long")
    copied = F.when((slice_ + 1) * width - F.col("us") <= reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = calls.select("*", slice_.alias("_first"), F.explode(copied).alias("_later"))
    return dealt.withColumns({"slice": F.col("_first") + F.col("_later"), "own": F.col("_later") == 0}).drop("_first", "_later")
