"""Context chunks, duplicates and vector search against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import generation, vectors


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(1)
    vecs = {k: rng.normal(size=5).tolist() for k in range(40)}
    vecs[40] = vecs[3]
    df = spark.createDataFrame([(k, v) for k, v in vecs.items()], "id long, vec array<double>")
    got = {}
    for r in vectors.nearest(df, df.where("id % 10 = 0"), 4, skip=lambda ids, q: ids == q).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 41, 10):
        a = np.array(vecs[q])
        order = sorted((-round(float(a @ np.array(v) / (np.linalg.norm(a) * np.linalg.norm(v))), 5), k) for k, v in vecs.items() if k != q)
        assert [k for _, k in sorted(got[q])] == [k for _, k in order[:4]]
    assert vectors.nearest(df.limit(0), df, 2).count() == vectors.nearest(df, df.limit(0), 2).count() == 0


def test_duplicates_against_a_plain_loop(spark):
    """Pairs by rare tokens, and acceptance in rounds, on chains of more and more changed sets."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(80):
        base = [f"g{k // 16}t{x}" for x in range(20)]
        for at in rng.integers(0, 20, rng.integers(0, 5)):
            base[at] = f"x{rng.integers(0, 30)}"
        rows.append((k, k // 16 % 2, sorted(set(base))))
    df = spark.createDataFrame(rows, "id long, part int, t array<string>")
    like = lambda a, b: len(set(a) & set(b)) > 0.72 * len(set(a) | set(b))
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and like(a[2], b[2])}
    pairs = generation.near_pairs(df, 0.72, ("part",))
    assert {tuple(r) for r in pairs.collect()} == want and len(want) > 100
    kept, gone = [], set()
    for k, part, t in rows:
        if any(p == part and like(t, s) for p, s in kept):
            gone.add(k)
        else:
            kept.append((part, t))
    assert {r["id"] for r in generation.greedy_duplicates(pairs).collect()} == gone


def test_stages_of_context_chunks(spark):
    """Each request takes its chunks from another stage."""
    unit = lambda k: [1.0 if i == k else 0.0 for i in range(3)]
    chunks = [(k, k // 10, k % 10, unit(k % 3) if k % 10 < 9 else None, k % 10 != 8, k in (1, 21, 22), k // 10 in (2, 3) and k % 10 < 6 or k // 10 == 3, k % 2 == 0) for k in range(50)]
    c = spark.createDataFrame(chunks, "chunk_id long, course_id long, chunk_index long, vec array<double>, allowed boolean, boilerplate boolean, used boolean, penalised boolean")
    texts = c.select("chunk_id", F.when(F.col("boilerplate"), "This internal assessment follows the mark allocation.").otherwise("The sum of the angles is two right angles.").alias("content"))
    c = c.drop("boilerplate")
    requests = spark.createDataFrame([(0, 0, unit(0)), (1, 1, None), (2, 2, unit(0)), (3, 3, unit(1)), (4, 4, None), (5, 9, None)], "request_id long, course_id long, q array<double>")
    mapped = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.9), (1, 10, None), (2, 20, 0.9), (2, 22, 0.9)], "request_id long, chunk_id long, score double")
    got = {}
    for r in generation.context_chunks(requests, mapped, c, texts, k=1, min_score=0.3).collect():
        got[r["request_id"]] = (r["chunk_id"], r["stage"])
    # 0: its topic's other chunk, as 1 is boilerplate; 1: the topic's, score unknown; 2, 3: a wider search; 4: the course's first; 5: nothing
    assert got[0] == (3, 2) and got[1] == (10, 1) and got[4] == (41, 5) and 5 not in got
    assert got[2][1] in (3, 4) and got[3][1] in (4, 5)


def test_context_keeps_to_its_budget(spark):
    long = "Sentence one is here. " * 100
    rows = [(1, 1, long), (1, 2, "short"), (1, 3, "Lemma 1 holds\nno sign\n- bullet point here\nx := y holds\nab:=c in words"), (1, 4, "LEMMA 1 HOLDS\n" + "\n".join(f"fact {k} is true" for k in range(900))), (2, 1, "only one")]
    df = spark.createDataFrame(rows, "request_id long, rank int, content string")
    got = {r["request_id"]: r["context"] for r in generation.build_context(df).collect()}
    head, facts = got[1].split("\n\n[Key Facts]\n")
    assert head == "[Evidence 1]\n" + long[:1400][: long[:1400].rfind(".") + 1] + " …\n\n[Evidence 2]\nshort"
    lines = facts.split("\n")
    assert lines[:4] == ["• Lemma 1 holds", "• - bullet point here", "• ab:=c in words", "• fact 0 is true"]
    assert len(got[1]) <= 8000 and len(got[1]) > 7900 and got[2] == "[Evidence 1]\nonly one"


def test_evidence_without_a_late_full_stop(spark):
    df = spark.createDataFrame([("a. " + "b" * 2000,), ("c" * 1400,)], "x string")
    assert [r[0] for r in df.select(generation.evidence(F.col("x"))).collect()] == ["a. " + "b" * 1397 + " …", "c" * 1400]
