"""Mixing sources to target weights with the cube method of balanced sampling.

Each source has a target in words. A document is taken floor(target / source size) times for sure and once more with
the fractional rest as its inclusion probability. The flight phase moves these probabilities along directions that leave
both the number of documents and their words unchanged, to one of the two ends of the way, drawn so that every
probability keeps its expectation; each step settles a document. Steps are led by the largest open document and balanced
by those next to it in size, so that only small documents are left. The flight runs in bounded blocks of a source side
by side; what stays fractional (two documents of a block at most) goes on to the next round, until a source fits into one
block, whose last one or two documents are landed by draws with their remaining probabilities, the first of which keeps
the number of documents.

Defined results: a null text has size 0; very long texts are documents like others; a null source is a source of its own,
after all others; sources without words get target 0; repeated rows are documents of their own; ties are broken by
hashes; an empty table gives no rows; further columns may have any name and type and count as part of the row. Every draw
comes from hashes of the rows, so reruns agree.
"""

from __future__ import annotations

from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialise, n_words, prefix_sums, row_hash, small

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents of a flight block.
BLOCK = 4096
#: Documents that take part in a step of the flight.
STEP = 48
NEAR = 1e-9


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each source: ``source_size``, ``source_rows`` and ``target``.

    ``sizes`` has source and size. Targets are in proportion to the weights, but stop at ``most`` times the source's
    size; what is above is dealt to the others by weight until none is above. Sources are ordered by code point.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ordered, total = prefix_sums(totals.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"_rank": "_one", "_before": "source_size"}, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = ordered.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    wanted, level, capped = share * total["_before"], 0.0, -1
    while True:  # ends: each round caps at least one more source
        is_capped = F.col("cap") < F.lit(level) * F.col("weight")
        got = table.agg(F.sum(F.when(is_capped, F.col("cap"))).alias("cap"), F.sum(F.when(~is_capped, F.col("weight"))).alias("weight"), F.count_if(is_capped).alias("n")).first()
        if got["n"] == capped or not got["weight"]:
            break
        capped, level = got["n"], max(0.0, wanted - (got["cap"] or 0)) / got["weight"]
    target = F.when(F.col("cap") < F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", "source_rows", target.alias("target"), "_rank")


def _draw(chance: np.ndarray, way: np.ndarray, draw: float) -> np.ndarray:
    """Go along ``way`` or against it until a chance is 0 or 1; the nearer end is likelier, so no expectation moves."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (1 - chance) / np.abs(way), chance / np.abs(way)
    moving = way != 0
    ahead = np.min(np.where(way > 0, up, down)[moving])
    back = np.min(np.where(way > 0, down, up)[moving])
    moved = chance + way * (ahead if draw * (ahead + back) < back else -back)
    return np.where(moved < NEAR, 0.0, np.where(moved > 1 - NEAR, 1.0, moved))


def _direction(sizes: np.ndarray) -> np.ndarray:
    """A direction in the null space of (count, words): the first document, and the smallest change of the others that balances it."""
    others = sizes[1:] - sizes[1:].mean()
    spread = float(others @ others)
    way = np.empty(len(sizes))
    if spread == 0 and sizes[0] != sizes[1]:
        way[:] = 0.0  # the others are of one size, which is not that of the first: they can only balance each other
        way[1:3] = 1.0, -1.0
        return way
    way[0] = 1.0
    way[1:] = -1.0 / len(others)
    if spread:
        way[1:] -= others * (float(sizes[0] - sizes[1:].mean()) / spread)
    return way / np.abs(way).max()


def flight(sizes: list[int], chance: list[float], seed: int) -> list[float]:
    """Move chances along the null space of (count, words) until at most two are between 0 and 1."""
    sizes, chance, draw = np.asarray(sizes, dtype=float), np.asarray(chance, dtype=float).copy(), Random(seed).random
    open_, after = np.arange(min(STEP, len(sizes))), min(STEP, len(sizes))
    while True:
        open_ = open_[(chance[open_] > 0) & (chance[open_] < 1)]
        more = np.arange(after, min(after + STEP - len(open_), len(sizes)))
        if len(more):
            open_, after = np.concatenate([open_, more]), after + len(more)
        elif len(open_) <= 2:
            return chance.tolist()
        if len(open_) > 2:
            chance[open_] = _draw(chance[open_], _direction(sizes[open_]), draw())


def land(chance: list[float], seed: int) -> list[float]:
    """Settle the last one or two chances: first with the number of documents kept, then by a draw."""
    chance, draw = np.asarray(chance, dtype=float).copy(), Random(seed).random
    while len(left := np.flatnonzero((chance > 0) & (chance < 1))):
        chance[left[:2]] = _draw(chance[left[:2]], np.array([1.0, -1.0])[: len(left)], draw())
    return chance.tolist()


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "_order", "doc_id", "_row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    seed = int(pdf["_order"].min())
    chance = flight(pdf["size"].tolist(), pdf["_chance"].tolist(), seed)
    pdf["_chance"] = land(chance, seed + 1) if pdf["_blocks"].iloc[0] == 1 else chance
    return pdf


def balance(rows: DataFrame) -> DataFrame:
    """Turn ``_chance`` of every row into 0 or 1, keeping each ``_rank``'s count and words.

    Rows carry doc_id, size, _row (tells repeated rows apart), _rank (of the source) and _chance.
    """
    settled, open_ = rows.where(~F.col("_chance").between(NEAR, 1 - NEAR)), rows.where(F.col("_chance").between(NEAR, 1 - NEAR))
    done, turn = [settled.withColumn("_chance", F.round("_chance"))], 0
    while True:
        turn += 1
        blocks = open_.groupBy("_rank").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
        spread = open_.join(small(blocks), "_rank").withColumn("_order", F.xxhash64("doc_id", "_row", F.lit(turn)))
        spread = spread.withColumn("_block", F.pmod("_order", "_blocks"))
        dealt = spread.repartition("_rank", "_block")  # else a source's blocks can stay together
        flown = materialise(dealt.groupBy("_rank", "_block").applyInPandas(_fly, spread.schema), "flight").select(rows.columns)
        done.append(flown.where(F.col("_chance").isin(0.0, 1.0)))
        open_ = flown.where(~F.col("_chance").isin(0.0, 1.0))
        if open_.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def decide(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """One row for each document: doc_id, size, source, _hash (of the whole row), target, source_size, copies.

    Only ids, sizes and hashes are shuffled. Equal rows are counted first and told apart by number afterwards.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(docs).alias("_hash"))
    counted = materialise(slim.groupBy("doc_id", "source", "size", "_hash").agg(F.count("*").alias("_n")), "mix")
    weighed = counted.select("source", (F.col("size") * F.col("_n")).alias("size"), "_n")
    targets = source_targets(weighed, share).drop("source_rows")
    rows = counted.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(ratio + NEAR)
    rows = rows.withColumn("_sure", sure.cast("long")).withColumn("_chance", F.greatest(F.lit(0.0), ratio - sure))
    return balance(rows).withColumn("copies", F.col("_sure") + F.col("_chance").cast("long")).drop("_sure", "_chance", "_rank")


def mix(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: each as often as it is taken.

    Equal rows are merged before they are joined to their number of copies; whichever of them is taken is the same.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    keyed = docs.select(key, row_hash(docs).alias("hash"), F.struct(*columns).alias("row"))
    copies = decide(docs, share).groupBy(key, F.col("_hash").alias("hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    joined = keyed.join(copies.where("copies > 0"), ["id", "hash"])
    merged = joined.where("n > 1").groupBy("id", "hash").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    both = joined.where("n = 1").select("row", "copies").unionByName(merged.select("row", "copies"))
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix_digest(docs: DataFrame, share: float = 1.5) -> DataFrame:
    return decide(docs, share).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
