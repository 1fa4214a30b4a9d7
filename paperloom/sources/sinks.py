"""Writers of chunks, topics and rendered exams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, partition: str = "course_id") -> None:
    """Append chunk rows; a row whose vector length differs from the others' stops the write."""
    if "embedding" in chunks.columns:
        sizes = chunks.where("embedding is not null").select(F.size("embedding").alias("n")).distinct().limit(2).collect()
        if len(sizes) > 1:
            raise ValueError("vectors of different lengths")
    chunks.write.mode("append").partitionBy(partition).parquet(path)


def write_topics(topics: DataFrame, mapping: DataFrame, path: str) -> None:
    """Topics with keys made from course and name, so that a repeated write gives the same keys, and their map."""
    keyed = topics.withColumn("topic_key", F.md5(F.concat_ws("\x1f", F.col("course_id").cast("string"), "name")))
    keyed.write.mode("overwrite").parquet(f"{path}/topics")
    mapping.write.mode("overwrite").parquet(f"{path}/topic_chunk_map")


def write_tex(exams: DataFrame, path: str, key: str, body: str) -> None:
    """A folder for each exam with its rendered text in one file: an exam is one row, so no other text is in it."""
    exams.select(key, F.col(body).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def append_rows(rows: DataFrame, path: str, *partition: str) -> None:
    """Append to a log; nothing that stands there is touched, and a failed job adds nothing."""
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def latest(log: DataFrame, key: str, column: str, *order: str) -> DataFrame:
    """The current view of a log: for each key the column of its last row, and the number of rows."""
    return log.groupBy(key).agg(F.max_by(column, F.struct(*order)).alias(column), F.count("*").alias("n"))
