"""Contiguous shards of nearly equal byte size, from global prefix sums.

The rows are laid out in one order. Every partition adds up its own sizes; the partitions' totals give each partition
its offset, so each row knows the byte at which it starts. The byte axis is cut at equal targets, and a row goes to the
shard in which its middle byte lies: shards are contiguous, and each is within one row's size of the target.

Defined results: a null text has no bytes but still the overhead; an empty table gives no rows; repeated rows are rows
of their own, next to each other; rows that tie in the order are laid out by their place in the input; very long texts
count as one row each, so a shard is off its target by one such row at most. Further columns, whatever their names and
types, are carried along; only an input column that is itself named shard, slot or shard_start gives way to the new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import prefix_sums, text_crc32, utf8_bytes


def assign_shards(rows: DataFrame, n_shards: int, size: str, order: Sequence[str | Column]) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in each shard) and ``shard_start`` (global byte).

    ``size`` names a long column of positive sizes. Rows that tie in ``order`` are spread by their place in the input,
    so a key that holds a third of all rows still falls into many range partitions.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot", "shard_start")]
    keys = [(F.col(f"`{o}`") if isinstance(o, str) else o).alias(f"key{k}") for k, o in enumerate(order)]
    tied = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *keys, F.col(f"`{size}`").alias("size"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"))
    laid, total = prefix_sums(tied, [*(f"key{k}" for k in range(len(keys))), "tie"], {"shard_start": "size", "place": "one"}, "shards")
    middle = 2 * F.col("shard_start") + F.col("size")
    cut = laid.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, 2 * total["shard_start"])))).cast("int"))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("place") - F.col("first")).alias("slot"), "shard_start")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard; the rows are already laid out by shard, so a task writes few files."""
    sharded.write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The sharding of documents as digests: only ids, sizes and checksums are shuffled, not the texts."""
    slim = docs.select("doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    placed = assign_shards(slim, n_shards, "size", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "shard_start")
