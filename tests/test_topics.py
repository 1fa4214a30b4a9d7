"""Topic extraction, slots and time slices against plain loops and hand cases."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators import headings, slots, topics
from paperloom.streaming.budgets import time_slices


def test_heading_lines(spark):
    pages = [(1, 1, "LECTURE NOTES\n1.2 Sets and Maps\nplain words"), (1, 2, "LECTURE NOTES\nChapter IV: Trees\nSEE WWW.EXAMPLE.ORG"), (1, 3, "Lecture notes\n  3.1.4.1 Deep (part)  \nON GRAPHS-AND TREES"), (1, 4, "plain"), (1, 5, "plain"), (2, 1, ""), (3, 1, None)]
    rows = headings.regex_headings(spark.createDataFrame(pages, "doc_id long, page_number long, text string")).collect()
    assert [tuple(r)[1:7] for r in sorted(rows)] == [
        (1, 1, "numbered", "Sets and Maps", "SECTION", 1),
        (2, 1, "labelled", "Trees", "CHAPTER", 2),
        (3, 1, "numbered", "Deep (part)", "HEADING", 2),
        (3, 2, "caps", "On Graphs-And Trees", "HEADING", None),
    ]
    assert {r["confidence"] for r in rows} == {round(0.30 + 0.20 / 2 + 0.15 / 4, 6)}
    assert headings.regex_headings(spark.createDataFrame([], "doc_id long, page_number long, text string")).count() == 0


def test_layout_merges_by_the_running_maximum(spark):
    spans = [(1, p, 0, "Running head", 14.0, False) for p in (1, 2, 3)] + [(1, p, 9, "words of the body text", 10.0, False) for p in (1, 2, 3, 4) for _ in range(4)]
    spans += [(1, 1, 1, "Graphs", 16.0, False), (1, 1, 2, "and Trees", 16.5, False), (1, 1, 3, "Small part", 12.5, False), (1, 2, 1, "Bold part", 10.5, True), (1, 2, 2, "abc", 20.0, False)]
    rows = headings.layout_headings(spark.createDataFrame(spans, "doc_id long, page long, seq long, text string, size double, bold boolean")).collect()
    assert [tuple(r)[1:6] for r in sorted(rows)] == [(1, 1, "Graphs and Trees", "CHAPTER", 0), (1, 3, "Small part", "SECTION", 1), (2, 1, "Bold part", "HEADING", None)]


def test_contents(spark):
    pages = [(1, 1, "words\nand words\nand more"), (1, 2, "Contents\n\n1.1 Sets ..... 3\n    2.1 Trees of\tOrder . . 7\nIndex ..... 9\nSETS AND MAPS\nsets\nSets ..... 4"), (1, 3, "Contents\nOther Part ..... 3\nThird Part"), (2, 21, "Contents\nSets ..... 3\nMaps ..... 4"), (3, 1, "Contents\nSets ..... 3")]
    df = spark.createDataFrame(pages, "doc_id long, page_number long, text string")
    found = sorted(tuple(r)[1:] for r in headings.contents_from_text(df).collect())
    assert [(r[1], r[2], r[3], r[4]) for r in found] == [(2, "Sets", "CHAPTER", 3), (3, "Trees of\tOrder", "SECTION", 7), (5, "SETS AND MAPS", "CHAPTER", None)]
    outline = spark.createDataFrame([(3, 1, "Maps", 5)], "doc_id long, seq int, title string, page int")
    assert {(r["doc_id"], r["origin"]) for r in headings.contents(outline, df).collect()} == {(1, "text"), (3, "outline")}


def test_slots_take_disjoint_chunks(spark):
    """Only heads of topics go to the jobs: the result is that of a loop over all chunks of the topics."""
    rng = np.random.default_rng(3)
    chunks = [(t, t * 1000 + c, float(s)) for t in range(3) for c, s in enumerate(rng.permutation(200))]
    asked = [(j, s, int(rng.integers(0, 4)), ["easy", "hard"][s % 2], ["Define x", "Why is x so?"][int(rng.integers(0, 2))], [bool(x) for x in rng.random(3) < 0.5]) for j in range(6) for s in range(j + 1)]
    df = spark.createDataFrame(asked, "job_id long, slot long, topic_id long, difficulty string, stem string, replies array<boolean>")
    got = {(r["job_id"], r["slot"]): r for r in slots.fill_slots(df, spark.createDataFrame(chunks, "topic_id long, chunk_id long, score double")).collect()}
    assert len(got) == len(asked)
    for j in range(6):
        used, kept, easy = set(), 0, 0
        for _, s, topic, difficulty, stem, replies in (a for a in asked if a[0] == j):
            r, tried, want, last = got[j, s], set(), [], 3
            assert r["bloom"] == ("understand" if difficulty == "easy" else "analyze")
            for n in range(3):
                best = [c for t, c, _ in sorted(chunks, key=lambda x: -x[2]) if t == topic and c not in used | tried][:4]
                tried |= set(best)
                if best and replies[n]:
                    want, last = best, n + 1
                    break
            used |= set(want)
            assert (r["chunks"], r["attempts"]) == (sorted(want), last)
    assert slots.fill_slots(df.limit(0), spark.createDataFrame(chunks, "topic_id long, chunk_id long, score double")).count() == 0


def test_too_many_trivial_questions_raise_the_level():
    asked = [(1, 0, "medium", True, [True] * 3), (2, 0, "medium", False, [True] * 3), (3, 0, "easy", False, [True] * 3), (4, 9, "medium", False, [True] * 3)]
    rows = slots.fill(asked, {0: [(c, 0.0) for c in range(9)]}, seed=5)
    assert [r[3] for r in rows] == ["apply", "analyze", "understand", "analyze"]
    assert [len(r[2]) for r in rows] == [4, 4, 1, 0] and sorted(c for r in rows for c in r[2]) == list(range(9))


def test_time_slices_hold_what_windows_look_back_to(spark):
    rng = np.random.default_rng(4)
    calls = [(k, int(rng.integers(0, 2)), int(t)) for k, t in enumerate(rng.integers(-500, 1500, 300) // 5 * 5)]
    df = time_slices(spark.createDataFrame(calls, "id long, provider int, us long"), 100, least=150)
    load = F.sum("id").over(Window.partitionBy("provider", "slice").orderBy("us").rangeBetween(-100, 0))
    got = {r["id"]: r["load"] for r in df.withColumn("load", load).where("own").collect()}
    assert got == {k: sum(i for i, q, u in calls if q == p and us - 100 <= u <= us) for k, p, us in calls}


def test_labels_of_clusters(spark):
    rng = np.random.default_rng(5)
    words = ["graph", "trees", "flow", "maps", "with", "set", "cycle"]
    vecs = rng.normal(size=(30, 3)) + [2, 0, 0]
    rows = [(k % 3, k, (v / np.linalg.norm(v)).tolist(), " ".join(rng.choice(words, rng.integers(1, 30))), k) for k, v in enumerate(vecs)] + [(7, 99, [0.0, 0.0, 0.0], None, 1)]
    got = {r["cluster"]: r for r in topics.cluster_topics(spark.createDataFrame(rows, "cluster int, chunk_id long, vec array<double>, text string, page long")).collect()}
    assert sorted(got) == [0, 1, 2]
    for c, r in got.items():
        own = [x for x in rows if x[0] == c]
        texts = [x[3].split() for x in own]
        df, weight = Counter(w for t in texts for w in set(t)), defaultdict(float)
        for t in texts:
            for w in t:
                if len(w) >= 4 and w != "with":
                    weight[w] += t.count(w) / len(t) * math.log(len(texts) / df[w])
        centre = np.mean([x[2] for x in own], axis=0)
        mean = float(np.mean([np.dot(x[2], centre) for x in own]))
        assert r["title"] == " / ".join(w.title() for w, _ in sorted(weight.items(), key=lambda e: (-round(e[1], 9), e[0]))[:3])
        assert r["confidence"] == round(0.25 + 0.30 * min(1.0, max(0.0, (mean - 0.3) / 0.6)), 6)
        assert (r["n"], r["first_page"], r["last_page"]) == (10, c, 27 + c)


def test_names_of_topics(spark):
    text = "Chapter 7: Graph Theory\nChapter 8\nGraph\n1.2. Sets of maps\nPage 4\nthis line ends.\nrandom walks\n" + "simple random walks mix. " * 3 + "the random walk"
    df = spark.createDataFrame([(text,), (None,), ("",)], "content string")
    assert {r["name"] for r in topics.heading_names(df).collect()} == {"Graph Theory", "Graph", "Sets Of Maps"}
    rows = sorted(topics.topic_names(df).collect())
    names = [r["name"] for r in rows]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert names[0] == "Sets Of Maps" and "Simple Random Walks" in names  # a phrase runs on from "Graph Theory" and is longer
    assert not any(a != b and a.lower() in b.lower() for a in names for b in names)
    assert topics.topic_names(spark.createDataFrame([], "content string")).count() == 0
