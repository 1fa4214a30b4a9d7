"""Job lifecycles as a stream against a batch fold and a plain loop; embeddings by a model that is loaded once a worker."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import embedding
from paperloom.streaming import jobs
from paperloom.streaming.budgets import arrivals, job_states

EVENT = "job_id long, event_id long, ts timestamp, status string"


def run(spark, folder, batches, late="1 hour"):
    """The attempts of events (job_id, event_id, seconds, status) that arrive batch by batch, then one long after."""
    end = max(e[2] for b in batches for e in b) + 10**6
    for b in [*batches, [(-1, -1, end, "running")]]:
        rows = spark.createDataFrame(b, "job_id long, event_id long, s double, status string").select("job_id", "event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "status")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with jobs.keyed_state(spark):
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        jobs.attempts(stream, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(jobs.ATTEMPT).parquet(f"{folder}/out").collect())


def plain(events):
    out = []
    for job in {e[0] for e in events}:
        attempt, now = 0, None
        for _, _, s, status in sorted((e for e in events if e[0] == job), key=lambda e: (e[2], e[1])):
            us = int(s * 1_000_000)
            if now and us - now[1] > 600_000_000:
                out.append((job, attempt, "timeout", now[0], now[1] + 600_000_000, now[2]))
                now = None
            if now is None:
                attempt, now = attempt + 1, [us, us, 0]
            now[1], now[2] = us, now[2] + 1
            if status in ("success", "failure"):
                out.append((job, attempt, status, now[0], us, now[2]))
                now = None
        if now:
            out.append((job, attempt, "timeout", now[0], now[1] + 600_000_000, now[2]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_watermark(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.randint(1, 6), k, 1000.0 + rng.choice([0, 600, 0.5, 601, 1200]) * rng.randint(0, 30) + rng.randint(0, 2), rng.choice(["queued", "running", "running", "success", "failure"])) for k in range(150)]
    arrival = sorted(events, key=lambda e: e[2] - rng.random() * 3500)
    batches = [arrival[k : k + 40] for k in range(0, len(arrival), 40)]
    got = run(spark, str(tmp_path), batches)
    assert got == plain(events)
    table = spark.createDataFrame(events, "job_id long, event_id long, s double, status string").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    assert sorted(tuple(r) for r in jobs.fold(table).collect()) == plain(events)
    assert {r[2] for r in got} == {"success", "failure", "timeout"}


def test_silence_is_allowed_up_to_its_length_and_late_events_are_dropped(spark, tmp_path):
    batches = [[(1, 1, 1000.0, "queued"), (1, 2, 1600.0, "running"), (2, 3, 1000.0, "running"), (2, 4, 1600.001, "success")], [(3, 5, 50000.0, "success")], [(4, 6, 50000.0, "success")], [(1, 7, 1700.0, "success"), (3, 8, 50001.0, "running")]]
    second = 1_000_000
    assert run(spark, str(tmp_path), batches) == [
        (1, 1, "timeout", 1000 * second, 2200 * second, 2),  # the success came after the watermark had passed it
        (2, 1, "timeout", 1000 * second, 1600 * second, 1),
        (2, 2, "success", 1600 * second + 1000, 1600 * second + 1000, 1),
        (3, 1, "success", 50000 * second, 50000 * second, 1),
        (3, 2, "timeout", 50001 * second, 50601 * second, 1),
        (4, 1, "success", 50000 * second, 50000 * second, 1),
    ]


def test_latest_states_and_arrivals(spark, tmp_path):
    rows = [(1, 1, 5.0, "queued"), (1, 2, 9.0, "success"), (2, 3, 7.0, "running")]
    table = spark.createDataFrame(rows, "job_id long, event_id long, s double, status string").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    assert {(r["job_id"], r["status"], r["n_events"]) for r in job_states(table).collect()} == {(1, "success", 2), (2, "running", 1)}
    table.select(F.col("status").alias("sha256"), "ts").union(table.select("status", "ts")).write.parquet(f"{tmp_path}/in")
    q = arrivals(spark, f"{tmp_path}/in", "sha256 string, ts timestamp").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrived").count() == 3


def counting(folder):
    """A loader of a model that notes each load and each call in a folder; made here, so that it travels to the workers by value."""
    import os
    import random

    class Counting:
        size = 3

        def __init__(self):
            open(f"{folder}/load-{os.getpid()}-{random.random()}", "w").close()

        def encode(self, texts):
            with open(f"{folder}/calls-{os.getpid()}", "a") as f:
                f.write(f"{len(texts)}\n")
            return [[float(len(t)), 1.0, 0.0] for t in texts]

        def health_check(self):
            return True

    return Counting


def test_one_load_a_worker_and_small_batches(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 50 == 1, " \n").otherwise(F.repeat(F.lit("x"), (F.col("id") % 9 + 1).cast("int"))).alias("text"), F.lit(7).alias("embedding")).repartition(7)
    for _ in range(2):  # the second job finds the models of the first
        got = {r["id"]: r["embedding"] for r in embedding.embed(rows, "text", 3, f"counting-{folder}", counting(folder)).collect()}
    for k, v in got.items():
        if k % 50 < 2:
            assert v is None
        else:
            want = np.array([k % 9 + 1.0, 1.0, 0.0])
            assert v == pytest.approx(list(want / np.sqrt((want * want).sum())))
    loads = [f.split("-")[1] for f in os.listdir(folder) if f.startswith("load")]
    assert len(loads) == len(set(loads)) >= 1  # each process loads once, whatever the number of its tasks
    calls = [int(n) for f in os.listdir(folder) if f.startswith("calls") for n in open(f"{folder}/{f}")]
    assert sum(calls) == 2 * 960 and max(calls) <= embedding.BATCH and len(calls) < 2 * 960 / 20


def test_wrong_sizes_stop_and_health_is_told(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(Exception, match="shape"):
        embedding.embed(rows, "text", 4, f"wrong-{folder}", counting(folder)).collect()
    assert tuple(embedding.health(spark).first()) == ("hashed", True, None)

    def broken():
        raise OSError("no weights")

    assert tuple(embedding.health(spark, f"broken-{folder}", broken).first()) == (f"broken-{folder}", False, "OSError: no weights")


def test_hashed_model_is_the_hashed_embedding(spark):
    from paperloom.operators.models import hashed_embedding

    rows = spark.createDataFrame([(1, "The tree and the Graph"), (2, "a b"), (3, "été tree")], "id long, text string")
    both = embedding.embed(rows.withColumn("column", hashed_embedding(F.col("text"))), "text", 64).collect()
    for r in both:
        assert r["embedding"] == pytest.approx([x or 0.0 for x in r["column"]])
