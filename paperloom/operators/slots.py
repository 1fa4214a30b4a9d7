"""Slots of a generation job: each takes chunks that no earlier slot of the job has used, and is tried up to three times."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import rules

#: Attempts of a slot, chunks of an attempt, and the share of trivial questions above which harder slots must analyse.
ATTEMPTS, CHUNKS, TRIVIAL_SHARE = 3, 4, 0.30
#: The step of an attempt's seed, and the cognitive level that a difficulty asks for.
SEED_STEP = 0x9E3779B9
#: Jobs whose slots are put out at a time.
JOBS = 200
FILLED = pa.schema({"job_id": pa.int64(), "slot": pa.int64(), "attempts": pa.int32(), "chunks": pa.list_(pa.int64()), "bloom": pa.string()})
BLOOM = {"easy": "understand", "medium": "apply", "hard": "analyze"}


def _shuffled(chunk: int, seed: int) -> int:
    """The place of a chunk among equal scores under a seed."""
    return ((chunk * 0x9E3779B97F4A7C15) ^ (seed * 0xBF58476D1CE4E5B9)) % (1 << 64)


def fill(slots: list[tuple], candidates: dict[int, list[tuple[int, float]]], seed: int, k: int = CHUNKS) -> list[tuple]:
    """One job. slots: (slot, topic, difficulty, trivial, ok by attempt); candidates by topic: (chunk, score).

    Returns (slot, attempts, chunks, bloom) with no chunks where every attempt failed. Chunks of a failed attempt are not
    tried again for the same slot, but later slots may have them.
    """
    used: set[int] = set()
    accepted, trivial_so_far, out = 0, 0, []
    for slot, topic, difficulty, trivial, replies in slots:
        bloom = BLOOM.get(difficulty, "apply")
        if difficulty != "easy" and accepted and trivial_so_far / accepted > TRIVIAL_SHARE:
            bloom = "analyze"
        failed: set[int] = set()
        taken: list[int] = []
        attempt = 0
        for attempt in range(1, ATTEMPTS + 1):
            own = seed ^ (attempt * SEED_STEP)
            free = [(-score, _shuffled(chunk, own), chunk) for chunk, score in candidates.get(topic, ()) if chunk not in used and chunk not in failed]
            picked = [chunk for _, _, chunk in sorted(free)[:k]]
            if picked and replies[attempt - 1]:
                taken = picked
                break
            failed.update(picked)
        used.update(taken)
        accepted, trivial_so_far = accepted + bool(taken), trivial_so_far + bool(taken and trivial)
        out.append((slot, attempt, sorted(taken), bloom))
    return out


def filled(batch: pa.RecordBatch, k: int = CHUNKS) -> Iterator[pa.RecordBatch]:
    """The filled slots of a batch of jobs (job_id, slots, heads); only one job's chunks are Python objects at a time."""
    jobs, slots, heads = (batch.column(name) for name in ("job_id", "slots", "heads"))
    for start in range(0, batch.num_rows, JOBS):
        rows = []
        for at in range(start, min(start + JOBS, batch.num_rows)):
            job, known, own = jobs[at].as_py(), {}, heads[at].values
            if own is not None:
                for topic, head in zip(own.field("topic_id").to_pylist(), own.field("head")):
                    known[topic] = [*zip(head.values.field("chunk_id").to_pylist(), head.values.field("score").to_pylist())]
            rows += [(job, *r) for r in fill([(s["slot"], s["topic_id"], s["difficulty"], s["trivial"], s["replies"]) for s in slots[at].as_py()], known, job, k)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), FILLED.types)], schema=FILLED)


def fill_slots(slots: DataFrame, topic_chunks: DataFrame, k: int = CHUNKS) -> DataFrame:
    """job_id, slot, attempts, chunks, bloom of the slots (job_id, slot, topic_id, difficulty, stem, replies array<boolean>).

    topic_chunks: topic_id, chunk_id, score (null counts 0). A job looks at no more of a topic than its slots can use up, so
    of each topic only the head by score goes to the jobs (chunks of equal score at its end fall to the smaller id). Jobs run
    side by side; a job is as large as its blueprint.
    """
    longest = slots.groupBy("job_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    score = F.coalesce("score", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "chunk_id"))
    head = topic_chunks.select("topic_id", "chunk_id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k * (longest + ATTEMPTS))
    heads = head.groupBy("topic_id").agg(F.collect_list(F.struct("chunk_id", "score")).alias("head"))
    asked = slots.select("job_id", "slot", "topic_id", "difficulty", rules.is_trivial(F.col("stem")).alias("trivial"), "replies")
    own = asked.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("slot", "topic_id", "difficulty", "trivial", "replies"))).alias("slots"))
    needed = asked.select("job_id", "topic_id").distinct().join(heads, "topic_id").groupBy("job_id").agg(F.collect_list(F.struct("topic_id", "head")).alias("heads"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (out for batch in batches for out in filled(batch, k))

    return own.join(needed, "job_id", "left").mapInArrow(run, "job_id long, slot long, attempts int, chunks array<long>, bloom string")
