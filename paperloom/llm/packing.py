"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Only the number of pieces of each length matters for the packing, so the counts (as many numbers as a sequence has
tokens, whatever the corpus) are packed: the longest piece opens a sequence, the longest piece that fits fills it until
none does, then its smallest piece is replaced by the two unpacked pieces that fill the widened gap most tightly, if
they fill it better. The same filling is repeated as often as the counts allow. The pieces themselves are laid out by
length with global prefix sums; a piece's place in that order tells its sequence and its offset.

Defined results: a null or empty text is one piece that holds the end token alone; documents longer than a sequence are
cut into full pieces, the first of which takes the rest; repeated rows are documents of their own; an empty table gives
no rows. Further columns play no part.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialise, prefix_sums, row_hash, slices
from paperloom.registry import spread

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """The encoder of a byte-level BPE rank file; the ids equal those of the tokenizers file of the same vocabulary.

    That file, of the same name, lists the added tokens; where a text has one of them, it is that token.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {token["content"]: token["id"] for token in json.load(f)["added_tokens"]}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: bpe.encode(text, allowed_special="all") if any(token in text for token in added) else bpe.encode_ordinary(text)


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first takes what is left over."""
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, most: int, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document (column ids holds the ids, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = byte_bpe(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for batch in slices(batches, column=1):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), 0], dtype="<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), most)):
                    own = ids[start : start + length]
                    for name, value in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None)):
                        out[name].append(value)
            types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            names = [n for n in out if with_ids or n != "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.int64())) for n in names], names=names)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack_counts(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """counts[n]: pieces of length n, up to the length of a sequence. Returns fillings and how often each is used."""
    left, most, fillings = counts.astype(np.int64).copy(), len(counts) - 1, []
    lengths = np.arange(most + 1)
    while left.any():
        bin_, gap = [], most
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            bin_.append(longest)
            left[longest] -= 1
            gap -= longest
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            below = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest unpacked piece up to each length
            one = np.flatnonzero(left[:room])
            two = below[room - one]
            alone = (two == one) & (left[one] < 2)
            two[alone] = below[one[alone] - 1]
            sums = np.where(two > 0, one + two, 0)
            if len(sums) and sums.max() > small:
                k = int(sums.argmax())
                pair = [int(one[k]), int(two[k])]
                left[small] += 1
                left[pair] -= 1 if pair[0] != pair[1] else 0
                if pair[0] == pair[1]:
                    left[pair[0]] -= 2
                bin_[-1:] = sorted(pair, reverse=True)
        uses = Counter(bin_)
        more = int(min(left[n] // k for n, k in uses.items()))
        for n, k in uses.items():
            left[n] -= more * k
        fillings.append((bin_, more + 1))
    return fillings


def places(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of the order by length: rows from ``row`` on go to sequences from ``first`` on, at ``offset`` in them.

    The number of runs is bounded by the fillings and thus by the lengths, not by the pieces.
    """
    next_row = np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist()
    runs, sequence = [], 0
    for bin_, times in pack_counts(counts):
        offset = 0
        for n in bin_:
            runs.append((next_row[n], sequence, offset))
            next_row[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
    return {"row": table[:, 0], "first": table[:, 1], "offset": table[:, 2]}


def pack(cut: DataFrame, most: int) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length and more)."""
    laid, _ = prefix_sums(cut.withColumns({"_one": F.lit(1).cast("long"), "_tie": F.monotonically_increasing_id()}), ["length", "doc_id", "piece", "start", row_hash(cut), "_tie"], {"_row": "_one"}, "pieces")
    counts = np.zeros(most + 1, dtype=np.int64)
    for length, n in laid.groupBy("length").count().collect():  # at most as many rows as a sequence has tokens
        counts[length] = n
    runs, names = places(counts), cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("_row")).to_numpy()
            k = np.searchsorted(runs["row"], rows, side="right") - 1
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(runs["first"][k] + rows - runs["row"][k]), pa.array(runs["offset"][k])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return laid.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, most: int = 2048, ranks_path: str | None = None) -> DataFrame:
    """The pieces of all documents with their places; texts are read once and never shuffled."""
    return pack(materialise(pieces(docs, most, ranks_path), "tokenised"), most)
