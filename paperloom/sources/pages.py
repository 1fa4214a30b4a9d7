"""Readers of files: pages of text, uploads with their checksums, and a pluggable page parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes], list[str]]


def form_feed_pages(content: bytes) -> list[str]:
    """Pages of a plain text file, which form feeds divide."""
    return content.decode("utf-8", "replace").split("\f")


def read_pages(spark: SparkSession, path: str, parser: Parser = form_feed_pages) -> DataFrame:
    """path, page_number (from 1) and text of every page of every file; the parser runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, t) for p, c in zip(pdf["path"], pdf["content"]) for k, t in enumerate(parser(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page_number long, text string")


def read_uploads(spark: SparkSession, path: str, suffix: str = ".pdf", most: int = 50 * 1024 * 1024) -> DataFrame:
    """path, length, sha256, stored_name and the reason of a rejection (null: accepted)."""
    files = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    reason = F.when(~F.lower("path").endswith(suffix), "suffix").when(F.col("length") > most, "size")
    return files.select("path", "length", sha.alias("sha256"), F.concat(F.left(sha, F.lit(12)), F.lit("_"), F.md5("path"), F.lit(suffix)).alias("stored_name"), reason.alias("rejected"))
