"""Importance resampling towards a target: documents whose word runs look like the target's are drawn more often.

Features are runs of one and two words, hashed by CRC-32 into buckets. How much more often a bucket is met in the target
than in the documents is its gain; a document's weight is the mean of its gains, and the draw without replacement takes
the highest weights after Gumbel noise that a hash of the id gives.

Features are made from the UTF-8 buffer of an Arrow batch as a whole: a table of 256 entries says which bytes belong to
words and folds A-Z, differences of neighbouring classes are the word bounds, and the CRC registers of all words advance
together, one byte a step, by the CRC's own table. The register after a word and a space is where the pair with the next
word goes on. After STEPS bytes the few longer words are finished one by one from their registers.

Defined results: a null or empty text has no features, weight 0 and is not drawn; a very long text is handled in pieces
of about PIECE bytes that share one word, so no pair is lost; ties in score go to the smaller doc_id, null ids last (their
noise is that of an empty id); repeated rows are rows of their own with ranks of their own; an empty table gives no rows,
an empty target the gains of empty counts; further columns do not reach the scores, and resample() keeps them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import prefix_sums, slices
from paperloom.registry import spread

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
PIECE, STEPS = 1 << 20, 48

_BYTES = np.arange(256, dtype=np.uint32)
#: Word bytes: digits, letters and all bytes of longer code points.
_IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def _crc_table() -> np.ndarray:
    """What eight shifts make of each register byte under the reflected CRC-32 polynomial."""
    table = _BYTES.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC, _FRESH = _crc_table(), np.uint32(0xFFFFFFFF)


def advance(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """The CRC registers after the runs of codes at starts, all runs advanced by one byte at each step."""
    longest_first = np.argsort(-lengths, kind="stable")
    at, left, r = starts[longest_first], lengths[longest_first], registers[longest_first]
    steps = min(int(left[0]), STEPS) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(steps), side="left")  # how many runs are longer than each step
    for step, n in enumerate(active):
        r[:n] = _CRC[(r[:n] ^ codes[at[:n] + step]) & np.uint32(0xFF)] ^ (r[:n] >> np.uint32(8))
    for k in range(int(np.searchsorted(-left, -STEPS, side="left"))):
        rest = codes[at[k] + STEPS : at[k] + left[k]]
        r[k] = zlib.crc32(rest, int(r[k] ^ _FRESH)) ^ 0xFFFFFFFF
    out = np.empty_like(r)
    out[longest_first] = r
    return out


def _pieces(codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Codes, text bounds, number of the first text, and whether the first word has been counted, for texts that lie side by side.

    Short texts stay together. A text over PIECE bytes is cut behind a word, and its next piece begins with that word again.
    """
    first = 0
    while first < len(begins) - 1:
        start = int(begins[first])
        last = max(first + 1, int(np.searchsorted(begins, start + PIECE, side="right")) - 1)
        if int(begins[last]) - start <= PIECE:
            yield codes[start : begins[last]], begins[first : last + 1] - start, first, False
        else:
            stop, again, end = int(begins[last]), False, start
            while end < stop:
                end = min(end + PIECE, stop)
                while end < stop and _IN_WORD[codes[end]]:
                    end += 1
                yield codes[start:end], np.array([0, end - start]), first, again
                back = end
                while back > start and not _IN_WORD[codes[back - 1]]:
                    back -= 1
                again = back > start
                while back > start and _IN_WORD[codes[back - 1]]:
                    back -= 1
                start = back if again else end  # where the last word begins, if there is one
        first = last


def hashed_features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the texts: the texts' numbers of its words, those of its features, and the features' buckets."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    begins = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    for codes, bounds, first, again in _pieces(whole, begins):
        codes = _LOWER[codes]
        inside = np.concatenate([[False], _IN_WORD[codes], [False]])
        new_text = np.zeros(len(codes) + 1, dtype=bool)
        new_text[bounds[:-1]] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | new_text))
        lengths = np.flatnonzero(inside[:-1] & (~inside[1:] | new_text)) - starts
        text = first + np.searchsorted(bounds, starts, side="right") - 1
        single = advance(codes, starts, lengths, np.full(len(starts), _FRESH))
        pair = np.flatnonzero(text[1:] == text[:-1])
        spaced = single[pair]
        spaced = _CRC[(spaced ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (spaced >> np.uint32(8))
        double = advance(codes, starts[pair + 1], lengths[pair + 1], spaced)
        own = slice(1, None) if again else slice(None)
        registers = np.concatenate([single[own], double]) ^ _FRESH
        yield text[own], np.concatenate([text[own], text[pair]]), (registers % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of the column text fall into each bucket, at most ``buckets`` rows; each task adds up its own first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, column=0):
            for _, _, found in hashed_features(batch.column(0), buckets):
                n += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["bucket", "n"])

    return spread(texts.select("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Gains:
    """A gain for each bucket; their number is fixed, so they may travel with every task."""

    by_bucket: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> Gains:
        def counts(texts: DataFrame) -> np.ndarray:
            n = np.zeros(buckets)
            for row in bucket_counts(texts, buckets).collect():  # at most ``buckets`` rows
                n[row["bucket"]] = row["n"]
            return n

        s, t = counts(docs), counts(target)
        return Gains(np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def weigh(docs: DataFrame, gains: Gains) -> DataFrame:
    """The rows of docs with ``n_words``, ``n_features``, ``weight`` (floored mean gain) and ``score`` in place of columns of these names."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_words", "n_features", "weight", "score")]
    rows = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("row"), "text")
    table = gains.by_bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=1):
            words, features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for word_text, feature_text, found in hashed_features(batch.column(1), len(table)):
                words += np.bincount(word_text, minlength=batch.num_rows)
                features += np.bincount(feature_text, minlength=batch.num_rows)
                np.add.at(total, feature_text, table[found])
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["row", "n_words", "n_features", "weight"])

    weighed = spread(rows).mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return weighed.select("row.*", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("row.doc_id"))).alias("score"))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row: ranks 1, 2, 3... for the drawn ones, null for the others.

    Ids and numbers are dealt out by ranges of the score; a row's rank is its place in its range and the sizes of the ranges before.
    """
    scored = weigh(docs.select("doc_id", "text"), Gains.fit(docs, target)).drop("text")
    rows = scored.withColumn("eligible", (F.col("n_words") >= min_words).cast("long")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    laid, total = prefix_sums(rows, order, {"before": "eligible"}, "importance")
    drawn = (F.col("eligible") == 1) & (F.col("before") < percent * total["before"] // 100)
    return laid.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("before") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows with all their columns, n_words, n_features, weight and score.

    Texts are not shuffled: the last drawn row's score and id are found among ids and numbers, and rows are kept by them
    where they lie. Rows that tie with the last one in both come along.
    """
    last = ranked(docs, target, percent, min_words).where("rank IS NOT NULL").orderBy(F.col("rank").desc()).select("score", "doc_id").first()
    scored = weigh(docs, Gains.fit(docs, target)).where(F.col("n_words") >= min_words)
    if last is None:
        return scored.limit(0)
    upto = F.lit(True) if last["doc_id"] is None else F.col("doc_id") <= F.lit(last["doc_id"])
    return scored.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & upto))


def importance_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return ranked(docs, target)
