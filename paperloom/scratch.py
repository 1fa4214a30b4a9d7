"""Tables that later steps share, written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that are still there, by the session that wrote them; each open ``temporary`` block has a list of its own.
_BLOCKS: list[list[tuple[SparkSession, str]]] = [[]]


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in local mode. On a cluster a local folder would be another one on each machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or f"/tmp/paperloom-{os.getuid()}"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder. It is deleted at the end of the ``temporary`` block around, or of the interpreter."""
    path = f"{scratch_dir(spark)}/paperloom/{uuid.uuid4().hex}"
    _BLOCKS[-1].append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: later steps do not depend on lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(block: list[tuple[SparkSession, str]]) -> None:
    for spark, path in block:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            pass
    block.clear()


@contextmanager
def temporary() -> Iterator[None]:
    """Tables written in this block are deleted when it ends: read or write a query's rows within it."""
    _BLOCKS.append([])
    try:
        yield
    finally:
        _remove(_BLOCKS.pop())


atexit.register(lambda: [_remove(block) for block in _BLOCKS])
