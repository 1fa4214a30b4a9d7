"""Vector index, phrase counts, bin joins and the topic map against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.operators import page_join, phrases, vector_index
from paperloom.plans.retrieval import topic_chunk_map


def clusters(rng, n, width=8, centres=12):
    middle = rng.normal(size=(centres, width)) * 3
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 0.1
    x[::97] = 0
    x[5:9] = x[5]
    return x


def cosines(x, q):
    return np.round(x @ q / ((np.sqrt((x * x).sum(axis=1)) + 1e-10) * (np.sqrt(q @ q) + 1e-10)), 5)


@pytest.fixture(scope="module")
def laid(spark):
    x = clusters(np.random.default_rng(1), 1500)
    rows = [(k, [float(c) for c in v], k % 3) for k, v in enumerate(x)] + [(9000, None, 0)]
    return x, spark.createDataFrame(rows, "id long, vec array<double>, scope long").cache()


@pytest.mark.parametrize("scoped", [False, True])
def test_index_finds_the_nearest(spark, laid, monkeypatch, scoped):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    x, df = laid
    vectors = df if scoped else df.drop("scope")
    asked = vectors.where("id % 100 = 7 or id in (0, 97, 9000)").withColumn("skip", F.array("id", F.col("id") + 1))
    got = {}
    for r in vector_index.search(vector_index.build_index(vectors), asked, 12).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    queries = [k for k in range(len(x)) if k % 100 == 7 or k in (0, 97)]
    assert sorted(got) == queries
    for k in queries:
        s = cosines(x, x[k])
        own = [(-s[j], j) for j in range(len(x)) if j not in (k, k + 1) and (not scoped or j % 3 == k % 3)]
        assert [got[k][r] for r in range(1, 13)] == [(j, pytest.approx(-c, abs=2e-5)) for c, j in sorted(own)[:12]]


def test_range_search_is_whole_and_skips_lists(spark, laid):
    x, df = laid
    index, asked = vector_index.build_index(df.drop("scope")), df.drop("scope").where("id % 50 = 3")
    got = {(r["query_id"], r["vec_id"]) for r in vector_index.search_range(index, asked, 0.98).collect()}
    assert got == {(k, int(j)) for k in range(3, len(x), 50) for j in np.flatnonzero(cosines(x, x[k]) >= 0.98)}
    share = vector_index.searched_share(index, asked, 0.98).first()
    assert share["seen"] < 0.5 * share["whole"]


def test_least_score_and_no_vectors(spark, laid):
    _, df = laid
    index = vector_index.build_index(df)
    assert vector_index.search(index, df.where("id = 7"), 2000, 0.999).where("score < 0.999").count() == 0
    none = vector_index.build_index(df.limit(0))
    assert vector_index.search(none, df.where("id < 0"), 3).count() == 0


def test_phrases_are_counted_as_by_hand(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
    texts = [(k, k % 2, "".join(word() for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(98, 0, ""), (99, 1, None)]
    needles = [(s, word()) for s in (0, 1) for _ in range(25)] + [(0, ""), (0, None), (7, "a")]
    got = {(r["id"], r["needle"]): (r["n"], r["early"]) for r in phrases.phrase_hits(spark.createDataFrame(texts, "id long, scope long, text string"), spark.createDataFrame(needles, "scope long, needle string")).collect()}
    want = {(i, n): (t.count(n), n in t[:120]) for i, s, t in texts if t for own, n in needles if own == s and n and n in t}
    assert got == want


@pytest.mark.parametrize("most_bytes", [phrases.BROADCAST_BYTES, 0])
def test_relevance_counts_names_and_keywords(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", most_bytes)
    texts = [(1, 0, "On Graph Theory. graph theory of graphs"), (2, 0, "x" * 130 + " Graph THEORY again"), (3, 0, "a paragraph"), (4, 1, "graph theory"), (5, 0, None), (6, 0, "C++ and C++")]
    topics = [(10, 0, "Graph Theory"), (11, 0, "Graph graph"), (12, 0, "C++"), (13, 0, None), (14, 0, "")]
    got = {(r["topic_id"], r["id"]): (r["by_phrase"], r["by_keywords"]) for r in phrases.term_relevance(spark.createDataFrame(topics, "topic_id long, scope long, name string"), spark.createDataFrame(texts, "id long, scope long, text string")).collect()}
    for t, _, name in topics[:3]:
        for i, scope, text in texts:
            if scope or not text:
                continue
            low, needle = text.lower(), name.lower()
            words = max(1, len(re.findall("[a-z]{3,}", low)))
            phrase, kw = low.count(needle), sum(low.count(w) for w in re.findall("[a-z]{3,}", needle))
            want = (phrase * (2 if needle in low[:120] else 1) / words, (2 * phrase + kw) / words)
            assert got.pop((t, i), (0, 0)) == pytest.approx(want)
    assert not got


def test_bins_give_each_pair_once(spark):
    rng = np.random.default_rng(4)
    spans = [(int(s), int(a), int(a + n)) for s, a, n in zip(rng.integers(0, 2, 80), rng.integers(-20, 400, 80), rng.integers(-1, 90, 80))]
    a, b = spans[:40], spans[40:]
    left, right = (spark.createDataFrame(rows, f"scope long, {n}_first long, {n}_last long") for rows, n in ((a, "a"), (b, "b")))
    got = Counter((r["scope"], r["a_first"], r["a_last"], r["b_first"], r["b_last"]) for r in page_join.overlapping(left, right, 16).collect())
    assert got == Counter((s, *x, *y) for s, *x in a for t, *y in b if s == t and x[0] <= y[1] and y[0] <= x[1])
    points = [(s, k) for s in (0, 1) for k in range(0, 400, 7)]
    joined = page_join.in_ranges(spark.createDataFrame(points, "scope long, page long"), right.withColumnsRenamed({"b_first": "first", "b_last": "last"}), width=16)
    assert Counter(tuple(r) for r in joined.select("scope", "page", "first", "last").collect()) == Counter((s, p, f, x) for s, p in points for t, f, x in b if s == t and f <= p <= x)
    assert "_bin" in joined._jdf.queryExecution().executedPlan().toString()


def test_every_path_of_the_map_fires(spark, small):
    n = Counter(r["path"] for r in topic_chunk_map(spark, small).collect())
    assert set(n) == {1, 2, 3}


def test_scratch_ends_with_its_block(spark, tmp_path):
    with scratch.temporary():
        path = scratch.scratch_path(spark)
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
