"""Cases of the reviews that the small tables do not hold."""

import hashlib
import random
import re
import timeit
import tracemalloc
import unicodedata
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.catalog import ORACLES, QUERIES
from paperloom.functions import cleaning, notation, rules, similarity
from paperloom.operators import embedding, headings, slots, token_pairs, topics, vector_index
from paperloom.operators.apportion import largest_remainder, shares_within
from paperloom.operators.generation import build_context
from paperloom.plans import generation
from paperloom.streaming import jobs
from tests.test_oracles import rows


def same(spark, folder, name):
    """A query's rows, which must be those of its SQL on the parquet tables in folder."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df, found = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert want and rows(df.columns, [tuple(r) for r in df.collect()]) == want
    return want


def put(folder, name, sql):
    duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("blank", [160, 0x2003, 0x3000, 32])
def test_lines_lose_blanks_of_any_kind(spark, tmp_path, blank):
    put(tmp_path, "documents", f"SELECT 8::BIGINT AS doc_id, concat(chr({blank}), 'Order of Growth', chr({blank}), chr(10), 'Small.', chr({blank})) AS text")
    assert len(same(spark, tmp_path, "heading_lines")) == 1


def test_facts_that_differ_by_blanks_come_once(spark):
    data = [(1, 1, "Evidence."), (1, 2, "More."), (1, 3, "x is the order of growth"), (1, 4, "X is the order of growth \nwidth is what is called w")]
    (row,) = build_context(spark.createDataFrame(data, "request_id long, rank int, content string")).collect()
    assert row.context.endswith("[Key Facts]\n• x is the order of growth\n• width is what is called w")


def test_centres_with_large_ids(spark, tmp_path):
    # the second centre is nearer by two millionths, which its id outweighs
    put(tmp_path, "embeddings", "SELECT id::BIGINT AS vec_id, [x, 0]::FLOAT[] AS embedding, 0 AS label FROM (VALUES (1, 0.0), (50, 1.000002), (5000, 1.0)) AS t(id, x)")
    assert ("50.00000", "1.00000") in same(spark, tmp_path, "euclid_argmin")


def test_all_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_pairs, "BLOCK", 7)
    monkeypatch.setattr(token_pairs, "WIDTH", 5)
    sets = {k: None if k == 30 else sorted({f"w{k * j % 11}" for j in range(k % 6)}) for k in range(60)}
    df = spark.createDataFrame([(k, k % 2, t) for k, t in sets.items()], "id long, scope long, t array<string>")
    found = token_pairs.common_tokens(df).collect()
    assert len(found) == 2 * 30 * 29 // 2 == len({(r.a, r.b) for r in found})
    for r in found:
        x, y = sets[r.a], sets[r.b]
        assert r.a < r.b and r.a % 2 == r.b % 2
        assert (r.common, {r.n, r.m}) == ((None, {None}) if x is None or y is None else (len({*x} & {*y}), {len(x), len(y)}))


def test_maps_fill_eight_places(spark, small):
    assert "sim >= 0.1)" in ORACLES["topk_map_sim"]
    found = QUERIES["topk_map_sim"](spark, small).groupBy("topic_id").count().collect()
    assert found and all(r["count"] == 8 for r in found)


def test_maps_search_every_vector(spark, tmp_path):
    # ids divisible by ten are searched like others; only the next three are mapped already
    put(tmp_path, "embeddings", "SELECT id::BIGINT AS vec_id, (CASE WHEN id % 10 = 0 OR id = 52 THEN [1, 0] ELSE [0, 1] END)::FLOAT[] AS embedding, 0 AS label FROM range(75) AS t(id)")
    same(spark, tmp_path, "topk_map_sim")
    found = sorted((r.topic_id, r.chunk_id) for r in QUERIES["topk_map_sim"](spark, str(tmp_path)).collect())
    assert found == [(0, k) for k in (10, 20, 30, 40, 50, 52, 60, 70)] + [(50, k) for k in (0, 10, 20, 30, 40, 60, 70)]


def test_texts_are_classed_and_mended_with_few_looks(spark):
    """Every match of a rule or pattern has one of its pieces, also in odd case, so nothing is skipped that it would find."""
    said = {
        "Internal\tASSESSMENT and External assessment, Mark  Allocation": "admin_assessment", "  12. REFERENCES  ": "references_boilerplate", "x\n p. 12\nPAGE 3 of 4\n[1] a": "references_boilerplate",
        "MCS — a title — page 7": "references_boilerplate", "Exercise 3": "exercise", "(a) Find x (b) SHOW y": "exercise", "nothing": "instructional", None: "instructional",
    }
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", rules.classify(F.col("t")).alias("c"))
    assert {r.t: r.c.chunk_type for r in df.collect()} == said
    names = [name for group in (rules.ADMIN, rules.REFERENCES, rules.EXERCISE) for name, _, _ in group]
    assert sorted(names) == sorted(rules.NEEDS)

    def plain(text):
        for bad, good in notation.LITERALS.items():
            text = F.replace(text, F.lit(bad), F.lit(good))
        for pattern, good in notation.PATTERNS:
            text = F.regexp_replace(text, pattern, good)
        return text

    odd = [".Ab  D c1 / . x y/ 8z: E y: 3a:", "a IFF b IMPLIES c AND d OR NOT e FORALL EXISTS NEQ SUBSETEQ SUBSET UNION INTERSECT EMPTYSET", "x 2 A x2{ a 2 b a <  = b >= c  d", "IFFY 2 8 3 E D /", "", None]
    both = spark.createDataFrame([(t,) for t in odd], "t string").select(notation.repair_math(F.col("t")).alias("a"), plain(F.col("t")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]


@pytest.mark.parametrize("name", ["blueprint_expand", "slot_explode", "largest_remainder"])
def test_shares_are_worked_out_within_rows(spark, small, name):
    """A task that sorts or gathers its part of the table needs memory that grows with it."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Sort", "Window"))


def test_shares_within_rows_are_those_of_the_window(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0, 1, 7, 100, -3]), *(rng.choice([None, 0.0, 0.25, 0.34, 0.33, 1.0]) for _ in range(4))) for g in range(300)]
    df = spark.createDataFrame(rows, "g long, total long, w0 double, w1 double, w2 double, w3 double")
    each = df.select("g", "total", F.posexplode(F.array("w0", "w1", "w2", "w3")).alias("k", "w")).where("w is not null")
    want = {(r.g, r.k): r.share for r in largest_remainder(each, ["g"], "total", "w", "k").collect()}
    got = {(r.g, k): x for r in shares_within(df, F.col("total"), [F.col(f"w{k}") for k in range(4)]).collect() for k, x in enumerate(r.shares) if r[f"w{k}"] is not None}
    assert got == want


def most_memory(f):
    """What f returns, and the most bytes that Python's objects took meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_few_texts_at_a_time_are_normalised():
    texts = pa.array([f"ﬁ é e\u0301 {k} " + "ж" * 10_000 for k in range(2000)] + [None, ""])  # 40 MB as Python objects
    got, most = most_memory(lambda: cleaning._nfkc.func(texts))
    assert most < 10_000_000
    assert got.to_pylist() == [None if x is None else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()]
    assert len(cleaning._nfkc.func(texts.slice(0, 0))) == 0


def test_one_job_at_a_time_has_its_chunks(monkeypatch):
    monkeypatch.setattr(slots, "JOBS", 7)
    head = [{"chunk_id": c, "score": c % 7 / 7} for c in range(300)]
    asked = [{"slot": 1, "topic_id": 3, "difficulty": "hard", "trivial": False, "replies": [True] * 3}, {"slot": 2, "topic_id": 4, "difficulty": "easy", "trivial": True, "replies": [False] * 3}]
    rows = [{"job_id": k, "slots": asked, "heads": None if k == 5 else [{"topic_id": 3, "head": head[k % 9 :]}]} for k in range(1000)]
    batch = pa.RecordBatch.from_pylist(rows)
    parts, most = most_memory(lambda: [*slots.filled(batch.slice(2), 4)])
    assert most < 5_000_000  # all chunks at once are 300000 objects of some hundred bytes
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    plain = [(s["slot"], s["topic_id"], s["difficulty"], s["trivial"], s["replies"]) for s in asked]
    assert got == [(r["job_id"], *x) for r in rows[2:] for x in slots.fill(plain, {h["topic_id"]: [tuple(c.values()) for c in h["head"]] for h in r["heads"] or ()}, r["job_id"], 4)]


def test_words_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(topics, "WORDS", 10)
    lists = pa.array([["a"] * n if n is not None else None for n in (3, 7, 1, None, 0, 25, 4, 4, 4)])
    parts = [p.to_pylist() for p in topics._parts(lists.slice(1))]
    assert [x for p in parts for x in p] == lists.to_pylist()[1:]
    assert all(len(p) == 1 or sum(len(x or ()) for x in p) <= 10 for p in parts)


def plain_phrases(texts, sizes):
    found = Counter()
    for words in (re.findall("[a-z]{3,}", (t or "").lower()) for t in texts):
        for n in sizes:
            runs = (words[k : k + n] for k in range(len(words) - n + 1))
            found.update((n, " ".join(r)) for r in runs if r[0] not in topics.STOPWORDS and r[-1] not in topics.STOPWORDS)
    return found


@pytest.mark.parametrize("sizes", [(2, 3), (1, 2), (3,), (2, 4, 5), (1,)])
def test_phrases_are_counted_by_places(sizes, monkeypatch):
    monkeypatch.setattr(topics, "PLACES", 3)
    rng, vocabulary = random.Random(len(sizes)), ["the", "with", "graph", "set", "ab", "x", "map", "é", "you", "tree", "naïve"]
    for _ in range(60):
        texts = [rng.choice([None, *(gap.join(rng.choices(vocabulary, k=rng.randrange(12))) for gap in (" ", "\n", ", "))]) for _ in range(rng.randrange(6))]
        parts = [topics._word_runs(pa.array(t, pa.string()), sizes) for t in (texts[::2], texts[1::2])]
        places = pa.Table.from_batches(parts).to_pandas().groupby("place")
        owns = [pa.Table.from_pandas(own, parts[0].schema, preserve_index=False) for _, own in places]
        got = [(r["size"], r["phrase"], r["n"]) for own in owns for r in topics._run_counts(own, sizes, None).to_pylist()]
        want = plain_phrases(texts, sizes)
        assert sorted(got) == sorted((*k, n) for k, n in want.items())
        top = [(r["size"], -r["n"], r["phrase"]) for own in owns for r in topics._run_counts(own, sizes, dict.fromkeys(sizes, 2)).to_pylist()]
        assert all(sorted(t for t in top if t[0] == s)[:2] == sorted((k, -n, p) for (k, p), n in want.items() if k == s)[:2] for s in sizes)


def test_phrases_take_few_bytes_on_their_way(spark, small):
    text = spark.read.parquet(f"{small}/documents.parquet").selectExpr("lower(text) AS content")
    texts = [r.content for r in text.collect()]
    want = plain_phrases(texts, (2, 3))
    sent = topics._word_runs(pa.array(texts), (2, 3))
    assert sent.column("runs").nbytes + 12 * len(sent) < 0.5 * sum(len(p) + 16 for _, p in want)  # every phrase was a row of its own, with its size and count
    assert {(r["size"], r["phrase"]): r["n"] for r in topics.phrase_counts(text.repartition(5)).collect()} == want
    best = topics.top_phrases(text.repartition(5)).collect()
    assert [(r["phrase"], r["n"]) for r in best if r["size"] == 3] == sorted(((p, n) for (s, p), n in want.items() if s == 3), key=lambda x: (-x[1], x[0]))[: topics.TRIGRAMS]


def test_heading_lines_and_names_are_made_once(spark):
    df = spark.createDataFrame([("  1.2 Order of  growth \t\n\x0bSHORTEST PATHS\r\n  \nNo heading, here.\nChapter 3: trees of ORDER",)], "content string")
    names = topics.heading_names(df)
    assert sorted(r["name"] for r in names.collect()) == ["Order Of Growth", "Shortest Paths", "Trees Of Order"]
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("split(content") == 1 and "^\\s+|" not in plan


def test_a_worker_keeps_few_words(monkeypatch):
    monkeypatch.setattr(embedding, "KNOWN", 50)
    model = embedding.HashedModel(8)
    words = ["".join(rng.choices("abcdef", k=5)) for rng in [random.Random(7)] for _ in range(400)]
    again = model.encode([" ".join(words), " ".join(words[::-1])])
    assert model._slot.cache_info().currsize <= 50
    assert again.tolist() == [[sum(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8 == k for w in words) for k in range(8)]] * 2


def test_few_distances_at_a_time():
    batch = pa.RecordBatch.from_pydict({"id": list(range(3 * vector_index.BLOCK + 1))})
    parts = [*vector_index._few([batch, batch.slice(0, 0)])]
    assert max(p.num_rows for p in parts) == vector_index.BLOCK
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(batch.num_rows))


def test_question_vectors_are_made_once_by_the_model(spark, small):
    made = generation._vectors(generation.candidates(spark, small))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "MapInArrow" not in plan  # read from what was written
    assert made.where("vec is not null").count() > 0


@pytest.mark.parametrize("part", [30, 4096])
def test_a_query_is_sent_once_to_a_part(spark, monkeypatch, part):
    """Vectors without clusters, where nothing can be left out: rows grow with the parts, not with the lists."""
    monkeypatch.setattr(vector_index, "PART", part)
    monkeypatch.setattr(vector_index, "ASKED", part)
    rng = random.Random(5)
    vec = [[rng.choice([0.0, 1.0, 2.0]) for _ in range(12)] for _ in range(400)]
    df = spark.createDataFrame([(k, v, k % 2) for k, v in enumerate(vec)], "id long, vec array<double>, scope long")
    sent, look = [], vector_index._look
    monkeypatch.setattr(vector_index, "_look", lambda index, probes, *rest: sent.append(probes.count()) or look(index, probes, *rest))
    index = vector_index.build_index(df)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector_index.search(index, df.withColumn("skip", F.array("id")), 3).collect()}
    parts = index.cells.select("scope", "part").distinct().count()
    assert sum(sent) <= 200 * parts < 200 * index.cells.count()
    length = [sum(c * c for c in v) ** 0.5 + 1e-10 for v in vec]
    for k, v in enumerate(vec):
        own = sorted((-round(sum(a * b for a, b in zip(v, vec[j])) / length[j] / length[k], 5), j) for j in range(k % 2, 400, 2) if j != k)
        for r, (score, j) in enumerate(own[:3], 1):
            assert found[k, r][1] == pytest.approx(-score, abs=2e-5) and (found[k, r][0] == j or abs(own[3][0] - own[0][0]) < 2e-5 or found[k, r][0] in {i for s, i in own if abs(s - score) < 2e-5})


def test_a_batch_of_a_job_costs_few_calls_to_the_state():
    calls = Counter()

    class Value:
        now = None

        def get(self):
            calls["get"] += 1
            return self.now

        def update(self, value):
            calls["update"] += 1
            self.now = value

    class Handle:
        timers = set()

        def getValueState(self, name, schema):  # noqa: N802
            return Value()

        def registerTimer(self, ms):  # noqa: N802
            calls["register"] += 1
            self.timers.add(ms)

        def deleteTimer(self, ms):  # noqa: N802
            calls["delete"] += 1
            self.timers.remove(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    minute, job = 60_000, jobs.Lifecycle()
    job.init(handle := Handle())
    batch = [{"us": k * minute * 1000, "event_id": k, "status": "running"} for k in range(100)]
    assert not list(job.handleInputRows((7,), iter(batch), At(0))) and handle.timers == {minute}
    assert not list(job.handleExpiredTimer((7,), At(50 * minute), At(minute))) and calls["register"] == 2
    assert calls["get"] == calls["update"] == 2  # before: a call for each event
    (row,) = job.handleInputRows((7,), iter([{"us": 99 * minute * 1000, "event_id": 100, "status": "success"}]), At(200 * minute))
    assert (row.attempt, row.status, row.started, row.ended, row.n_events) == (1, "success", 0, 99 * minute * 1000, 101)
    assert calls["get"] == calls["update"] == 3 and calls["delete"] == 1


def test_characters_of_a_title_are_sorted_once(spark):
    def taken(n):
        df = spark.range(200).select(F.concat(F.repeat(F.lit("abcdefghij"), n // 10), F.col("id").cast("string")).alias("t")).coalesce(1)
        return min(timeit.repeat(lambda: df.select(F.sum(F.size(similarity.character_set(F.col("t"))))).collect(), number=1, repeat=3))

    df = spark.createDataFrame([(t,) for t in ("banana", "", "aé a", None)], "t string")
    assert [r[0] and sorted(r[0]) for r in df.select(similarity.character_set(F.col("t"))).collect()] == [["a1", "a2", "a3", "b1", "n1", "n2"], ["1"], [" 1", "a1", "a2", "é1"], None]
    assert taken(300) < 2 + taken(10)  # before: some seconds more, as 200 titles of 300 characters were sorted 300 times each


def test_the_length_of_a_vector_is_worked_out_once(spark):
    def taken(width):
        df = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda x: (x + F.col("id")).cast("float")).alias("v")).coalesce(1)
        return min(timeit.repeat(lambda: df.select(F.sum(similarity.l2_normalise(F.col("v"))[1])).collect(), number=1, repeat=2))

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(similarity.l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert taken(2000) < 2 + taken(10)  # before: 2000 lengths of 2000 components for each of 20 vectors


def test_pages_are_looked_through_once_for_headings(spark):
    pages = spark.createDataFrame([(1, k, f"{k}.1  Matchings {k}\nCHAPTER {k}: FLOWS\ntext") for k in range(1, 6)], "doc_id long, page_number long, text string")
    plan = headings.regex_headings(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "posexplode" not in plan  # read from what was written
