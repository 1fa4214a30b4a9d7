"""Helpers shared by the operators: tables in the shared scratch folder, global prefix sums, word hashes."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType
from pyspark.sql.window import Window

#: White space of the word rules: space, tab, LF, VT, FF and CR, and nothing else.
SPACES = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own in local mode.

    On a cluster a local folder would be another one on each machine, so there the setting must be given.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or f"/tmp/paperloom-{os.getuid()}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    path = f"{scratch_dir(spark)}/paperloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def write_scratch(df: DataFrame, label: str, owner: SparkSession | None = None) -> str:
    """Write df as a table in the shared folder (of the owner's session) and return its path."""
    path = scratch_path(owner or df.sparkSession, label)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later steps do not depend on lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, label))


def prefix_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str], label: str) -> tuple[DataFrame, dict[str, int]]:
    """Add to each row the sums of the rows before it in a global order, and return the totals.

    ``sums`` maps a new column to the long column that it adds up. Rows are dealt out by ranges of ``order``, each
    partition is summed by itself, and the totals of the partitions (one row each) are summed up over the partitions.
    Rows that tie in ``order`` share a partition, so a caller with large ties ends ``order`` with something that differs.
    """
    names, source = list(sums), df.schema
    out = StructType([*source.fields, StructField("_part", LongType()), *(StructField(n, LongType()) for n in names)])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns.append(pa.array(np.full(batch.num_rows, part, dtype=np.int64)))
            for name in names:
                value = batch.column(batch.schema.get_field_index(sums[name])).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = carry[name] + np.cumsum(value)
                columns.append(pa.array(upto - value))
                carry[name] = int(upto[-1]) if len(upto) else carry[name]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialise(ranged.mapInArrow(running, out), label)
    last = [F.max(F.col(n) + F.col(sums[n])).alias(n) for n in names]
    parts = local.groupBy("_part").agg(*last)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, not for each document
    offsets = parts.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names))
    total = parts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    joined = local.join(F.broadcast(offsets), "_part")
    whole = joined.select(*(F.col(f"`{c}`") for c in source.names), *((F.col(n) + F.col(f"_o_{n}")).alias(n) for n in names))
    return whole, {n: int(total[n]) for n in names}


#: Bytes of rows that are broadcast at most (8 bytes for each column and 8 for the row; twice to four times that as a hash table).
BROADCAST_BYTES = 24 << 20


def small(table: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast of a table of numbers (or of short keys) if it is counted to have few bytes, else leave the join to Spark."""
    most = most_bytes // (8 * len(table.columns) + 8)
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Keys that may be looked up apart: those with more than this part of all rows.
HOT_KEYS = 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of a table that has one row for each key, null where it has none.

    A table of few bytes is broadcast. Else the keys with over a HOT_KEYS-th of all rows, which are at most HOT_KEYS, are
    broadcast with their row of the table, so that no key's rows meet in one task; only the others are shuffled.
    """
    few = BROADCAST_BYTES // (64 * len(table.columns))  # short strings: 64 bytes each
    if table.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    most = rows.count() // HOT_KEYS
    hot = materialise(table.join(counts.where(F.col("_rows") > most), key), "hot-keys")
    is_hot = F.broadcast(hot.select(key))
    apart = rows.join(F.broadcast(hot.drop("_rows")), key)
    rest = rows.where(F.col(key).isNull()).unionByName(rows.where(F.col(key).isNotNull()).join(is_hot, key, "left_anti"))
    return apart.unionByName(rest.join(table, key, "left"))


def _hashable(column: Column, kind: DataType) -> Column:
    """column without maps, which have no order and no hash in Spark: their entries in the order of the keys instead."""
    if isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(column))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), _hashable(F.element_at(column, k), kind.valueType).alias("v")))
    if isinstance(kind, ArrayType) and "map<" in kind.simpleString():
        return F.transform(column, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, StructType) and "map<" in kind.simpleString():
        return F.when(column.isNotNull(), F.struct(*(_hashable(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return column


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row, of any type and name."""
    return F.xxhash64(*(_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes, of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def n_words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("long")


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds), in place of which any good mixer would do."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text that are hashed at a time; one longer text is cut at white space.
HASH_CHUNK = 1 << 18
_BASE = 0x100000001B3
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def powers(base: int, n: int, made: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base to the powers 1 to n, kept for the next chunk."""
    if base not in made or len(made[base]) < n:
        made[base] = np.multiply.accumulate(np.full(max(n, HASH_CHUNK + 1), base, dtype=np.uint64))
    return made[base][:n]


def _hash_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of data: differences of one running polynomial, all words at once."""
    codes = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[codes], [True]])))
    starts, ends = edges[::2], edges[1::2]
    upto = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes)), out=upto[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(codes))
    return mix64((upto[ends] - upto[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of at most HASH_CHUNK bytes that end at white space, or longer where a word is longer."""
    while len(text) > HASH_CHUNK:
        at = max(text.rfind(bytes([c]), 0, HASH_CHUNK) for c in (9, 10, 11, 12, 13, 32))
        if at < 0:
            after = [k for c in (9, 10, 11, 12, 13, 32) if (k := text.find(bytes([c]), HASH_CHUNK)) >= 0]
            at = min(after, default=len(text) - 1)
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def hashed_words(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words (between ASCII white space, A-Z lower-cased), in order."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])])
            hashes, starts = _hash_chunk(b"\n".join(group).lower())
            yield from np.split(hashes, np.searchsorted(starts, begins[1:-1]))
        group.clear()

    for text in texts:
        text = text or b""
        if size + len(text) > HASH_CHUNK:
            yield from flush()
            size = 0
        if len(text) > HASH_CHUNK:
            yield np.concatenate([_hash_chunk(part.lower())[0] for part in _cut(text)])
        else:
            group.append(text)
            size += len(text) + 1
    yield from flush()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500, column: int | None = None, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that what is made of a batch stays small.

    If the place of a text (or binary) column is given, a slice also has at most ``most_bytes`` of it, or one row.
    """
    for batch in batches:
        size = None if column is None else np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            stop = min(start + rows, batch.num_rows)
            if size is not None:
                stop = min(stop, max(start + 1, int(np.searchsorted(size, size[start] + most_bytes, side="right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k neighbouring entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix64(out)
