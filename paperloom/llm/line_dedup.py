"""Line deduplication by pairwise alignment.

Documents are lists of line hashes. Each shortest run of lines with enough words (from each line on and up to each line)
that several documents hold names the earliest of them, so a document is paired with the earliest holders of its runs:
at most two pairs a line, however many documents share a run, and no shared block is without a pair.
Spark joins the two lists of each pair, patience diff aligns them (lines that are unique on both sides and keep their
order, then the same between them), and aligned blocks of enough words are deleted from the later document. A block goes
on where up to GAP lines of either side have been put in or changed, so a passage with an edited line is one block, whose
common lines go and whose edited line stays. What alignment must leave (lines that repeat, blocks in another order) is
looked up by hashes of the shortest runs of enough words; ``n_aligned`` tells how many lines went by alignment. A line that
only many short pages share, such as a menu entry, forms no block of enough words and stays.

Earlier means a smaller doc_id (null first), then a smaller text hash. Defined results: a null text stays null and has
no lines; an empty text is one line without words, and is never deleted; very long texts are aligned whole, a pair at a
time; rows that are wholly equal in doc_id and text are one document, so none is deleted for the other's sake; an empty
table gives no rows; further columns, whatever their names and types, are carried along by drop_repeats.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import SPACES, materialise, mix64, powers, slices

#: Base of the polynomial hash of a run.
BASE = 0x9E3779B97F4A7C15
#: Words of a block that is deleted.
BLOCK_WORDS = 20
#: Lines that an edit may put between two lines of a block, on either side; pairs that are aligned at a time.
GAP, PAIRS = 1, 64

Span = tuple[int, int, int, int]


def _anchors(a: list[int], b: list[int], span: Span) -> list[tuple[int, int]]:
    """The longest rising chain of lines that occur once on both sides of the span."""
    a0, a1, b0, b1 = span
    once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {line: i for i, line in enumerate(a[a0:a1], a0) if once_a[line] == 1 and once_b[line] == 1}
    piles: list[int] = []
    tops: list[tuple[int, int, int]] = []  # position in a and b, and the entry below
    index: list[int] = []
    for j in range(b0, b1):
        if (i := at.get(b[j])) is not None:
            k = bisect_left(piles, i)
            tops.append((i, j, index[k - 1] if k else -1))
            piles[k : k + 1] = [i]
            index[k : k + 1] = [len(tops) - 1]
    chain, k = [], index[-1] if index else -1
    while k >= 0:
        i, j, k = tops[k]
        chain.append((i, j))
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), rising on both sides."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 < a1 and b0 < b1 and (chain := _anchors(a, b, (a0, a1, b0, b1))):
            matched += chain
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(matched)


def runs(lines: np.ndarray, words: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the shortest runs of ``least`` words or more from each line on and up to each line.

    The documents lie one after the other and start at ``begins`` (which ends with the number of lines). A line of a longer
    run is in one of these runs that lies within it: up to the line, or else from the longer run's first line on.
    """
    n = len(lines)
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.arange(n)
    end = np.searchsorted(upto, upto[:-1] + least, side="left")
    start = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    on, up = end <= begins[doc + 1], start >= begins[doc]
    both = np.unique(np.concatenate([at[on] * (n + 1) + end[on], start[up] * (n + 1) + at[up] + 1]))
    start, end = both // (n + 1), both % (n + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(lines.view(np.uint64)) * powers(BASE, n), dtype=np.uint64)])
    back = powers(pow(BASE, -1, 1 << 64), n)
    return start, end, mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64)


def aligned_blocks(a: list[int], b: list[int], words: list[int], least: int, gap: int = GAP) -> list[int]:
    """Positions in b of the aligned lines of blocks with ``least`` words or more: neighbours in a block have at most ``gap`` other lines between them on either side."""
    out, block = [], []
    for i, j in [*patience(a, b), (len(a) + gap + 9, len(b) + gap + 9)]:
        if block and (i - block[-1][0] > gap + 1 or j - block[-1][1] > gap + 1):
            if sum(words[k] for _, k in block) >= least:
                out += [k for _, k in block]
            block = []
        block.append((i, j))
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], least: int, gap: int = GAP) -> tuple[list[int], list[int]]:
    """Positions in b that go by alignment, and those that go besides: unbroken blocks of a that alignment does not pass."""
    gone, own = set(aligned_blocks(a, b, words, least, gap)), set(a)
    rest: list[int] = []
    if any(line in own for k, line in enumerate(b) if k not in gone):
        known = dict(zip(b, words))
        of_a, of_b = (runs(np.array(x, dtype=np.int64), np.array([known.get(line, 0) for line in x], dtype=np.int64), np.array([0, len(x)]), least) for x in (a, b))
        start, end = (x[np.isin(of_b[2], of_a[2])] for x in of_b[:2])
        deep = np.cumsum(np.bincount(start, minlength=len(b) + 1) - np.bincount(end, minlength=len(b) + 1))
        rest = [k for k in np.flatnonzero(deep[:-1]).tolist() if k not in gone]
    return sorted(gone), rest


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _run_seeds(lists: DataFrame, block_words: int) -> DataFrame:
    """doc and run: the hashes of the shortest runs of enough words of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines, words = batch.column(2), batch.column(3)
            begins = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            start, _, found = runs(lines.flatten().to_numpy(zero_copy_only=False), words.flatten().to_numpy(zero_copy_only=False), begins, block_words)
            doc = pa.array(np.searchsorted(begins, start, side="right") - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(found)], names=["doc_id", "text_hash", "run"])

    made = lists.mapInArrow(run, f"doc_id {dict(lists.dtypes)['doc_id']}, text_hash long, run long")
    return made.select(F.struct("doc_id", "text_hash").alias("doc"), "run")


def repeated_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, gap: int = GAP) -> DataFrame:
    """doc_id, text_hash, the positions of the lines to delete, and how many of them alignment found, for documents that have any."""
    per_line = F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.array_remove(F.split(x, SPACES), "")).alias("words")))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), per_line.alias("l"))
    lists = materialise(own.select("doc_id", "text_hash", F.col("l.line").alias("lines"), F.col("l.words").alias("words")), "lines")
    seeds = _run_seeds(lists, block_words)
    held = seeds.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    pairs = seeds.join(held, "run").where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "first").distinct()
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.text_hash") == F.col(f"{y}.text_hash"))
    later = pairs.join(lists.alias("b"), same("doc", "b")).select("first", "doc", F.col("lines").alias("b_lines"), "words")
    both = later.join(lists.alias("a"), same("first", "a")).select("doc.doc_id", "doc.text_hash", F.col("a.lines").alias("a_lines"), "b_lines", later["words"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=PAIRS):  # a pair's lists are Python numbers only while it is aligned
            doc_id, text_hash, a, b, words = (batch.column(k) for k in range(5))
            found = [common_blocks(x.as_py(), y.as_py(), w.as_py(), block_words, gap) for x, y, w in zip(a, b, words)]
            by_alignment, besides = (pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([doc_id, text_hash, by_alignment, besides], names=["doc_id", "text_hash", "aligned", "besides"])

    found = both.mapInArrow(align, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, aligned array<int>, besides array<int>")
    tell = lambda column, how: F.transform(column, lambda x: F.struct(x.alias("line"), F.lit(how).alias("aligned")))
    each = found.select("doc_id", "text_hash", F.explode(F.concat(tell("aligned", True), tell("besides", False))).alias("x"))
    return each.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("x.line")).alias("gone"), F.size(F.collect_set(F.when(F.col("x.aligned"), F.col("x.line")))).alias("n_aligned"))  # a document's own lines


def drop_repeats(docs: DataFrame, block_words: int = BLOCK_WORDS, gap: int = GAP) -> DataFrame:
    """row (the columns of docs), text with repeated blocks deleted, gone (positions of deleted lines, null if none), n_aligned and n_lines."""
    gone = repeated_lines(docs, block_words, gap).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "gone", "n_aligned")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    split = joined.withColumn("every", F.when(F.col("gone").isNotNull(), _lines(F.col("text"))))
    left = F.array_join(F.filter("every", lambda x, k: ~F.array_contains("gone", k)), "\n")
    return split.select("row", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text")).alias("text"), "gone", F.coalesce("n_aligned", F.lit(0)).cast("long").alias("n_aligned"), F.size(_lines(F.col("text"))).alias("n_lines"))


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, gap: int = GAP) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_aligned (of these), deleted (line positions from 0) and the text that is left."""
    out = drop_repeats(docs.select("doc_id", "text"), block_words, gap)
    none = F.array().cast("array<int>")
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), "n_aligned", F.coalesce("gone", none).alias("deleted"), "text")


def keep_new_lines(docs: DataFrame) -> DataFrame:
    """docs with its columns: repeated blocks deleted, n_chars brought up to date, rows dropped of which nothing is left."""
    out = drop_repeats(docs).where("gone is null or text <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
