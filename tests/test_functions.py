"""Literal cases of the text functions, rule tables and operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import cleaning, notation, rules
from paperloom.functions.similarity import matching_ratio
from paperloom.operators import chunking
from paperloom.operators.apportion import largest_remainder
from paperloom.operators.topic_filter import postprocess
from paperloom.operators.topics import merge_headings

from paperloom.plans.text import MATH_CASES, MCS_CASES
from paperloom.sources.pages import read_pages, read_uploads
from paperloom.streaming.budgets import token_load


def apply(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("bad", "good"), MATH_CASES)
def test_math(spark, bad, good):
    assert apply(spark, notation.repair_math, bad) == good


@pytest.mark.parametrize(("bad", "good"), MCS_CASES)
def test_notation(spark, bad, good):
    assert apply(spark, notation.repair_notation, bad) == good


@pytest.mark.parametrize(("bad", "good"), [("ﬁle  a b ", "file a b"), ("a\n\n\n\nb", "a\n\nb"), ("a\x00b\x7f", "ab"), ("", ""), (None, None)])
def test_clean(spark, bad, good):
    assert apply(spark, cleaning.clean, bad) == good


@pytest.mark.parametrize(("bad", "good"), [("a_b & 5%", "a\\_b \\& 5\\%"), ("\\{", "\\textbackslash{}\\{"), ("~^", "\\textasciitilde{}\\textasciicircum{}"), (None, ""), ("", "")])
def test_tex(spark, bad, good):
    assert apply(spark, notation.escape_tex, bad) == good


@pytest.mark.parametrize(("text", "kind"), [("This internal assessment follows the assessment criteria", "admin_assessment"), ("text\nReferences\n[1] Author", "references_boilerplate"), ("Problem 7\n(a) Find x.", "exercise"), ("A graph has nodes.", "instructional"), ("", "instructional")])
def test_classify(spark, text, kind):
    assert apply(spark, rules.classify, text)["chunk_type"] == kind


@pytest.mark.parametrize(("stem", "trivial"), [("What is a set?", True), ("Define entropy.", True), ("Why does it converge?", False)])
def test_trivial(spark, stem, trivial):
    assert apply(spark, rules.is_trivial, stem) is trivial


def test_hard_split(spark):
    df = spark.range(1).select(chunking.hard_split(F.lit(200), 100, 20).alias("s"))
    assert [tuple(x) for x in df.first()["s"]] == [(0, 100), (80, 180), (160, 200)]


def test_chunks_cover_the_text(spark):
    text = " ".join(f"Sentence number {k} has some words." for k in range(200))
    spans = [tuple(s) for s in apply(spark, lambda c: chunking.chunk_spans(c, 500, 80), text)]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[0] < b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert [tuple(s) for s in apply(spark, lambda c: chunking.chunk_spans(c, 500, 80), "word " * 400)] == [(0, 2000)]


def test_fingerprint_ignores_case_and_labels(spark):
    a, b = (apply(spark, notation.fingerprint, x) for x in ("What is A) entropy?", "what is   entropy"))
    assert a == b == hashlib.sha256(b"what is entropy").hexdigest()


def test_apportionment(spark):
    df = spark.createDataFrame([("a", 10, k, w) for k, w in enumerate((1.0, 1.0, 1.0))] + [("z", 5, k, 0.0) for k in range(2)], "g string, total long, k int, w double")
    got = {(r["g"], r["k"]): r["share"] for r in largest_remainder(df, ["g"], "total", "w", "k").collect()}
    assert got == {("a", 0): 4, ("a", 1): 3, ("a", 2): 3, ("z", 0): 0, ("z", 1): 0}


def test_headings_merge_with_the_running_maximum(spark):
    df = spark.createDataFrame([(1, 1, 1, 10.0, "a"), (1, 1, 2, 10.9, "b"), (1, 1, 3, 11.8, "c"), (1, 1, 4, 10.0, "d")], "doc_id long, page long, seq long, size double, text string")
    assert sorted(r["text"] for r in merge_headings(df).collect()) == ["a b c", "d"]


def test_near_titles_go(spark):
    df = spark.createDataFrame([(1, 1, "Graph theory", 0.9, 3), (1, 2, "Graph theories", 0.5, 1), (1, 3, "Sets", 0.4, 2)], "course_id long, seq long, title string, confidence double, page long")
    assert [r["title"] for r in postprocess(df).orderBy("rank").collect()] == ["Sets", "Graph theory"]
    assert spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(matching_ratio(F.col("a"), F.col("b")).alias("r")).first()["r"] == 0.75


def test_pages_and_uploads(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("one\ftwo".encode())
    assert [(r["page_number"], r["text"]) for r in read_pages(spark, str(tmp_path)).orderBy("page_number").collect()] == [(1, "one"), (2, "two")]
    assert read_uploads(spark, str(tmp_path)).first()["rejected"] == "suffix"


def test_token_stream(spark, tmp_path):
    rows = spark.createDataFrame([("p", "2024-01-01 00:00:05", 10), ("p", "2024-01-01 00:00:15", 5)], "provider string, t string, tokens long")
    rows.select("provider", F.to_timestamp("t").alias("ts"), "tokens").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("provider string, ts timestamp, tokens long").parquet(str(tmp_path / "in"))
    q = token_load(stream).writeStream.format("memory").queryName("load").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("load").agg(F.max("tokens")).first()[0] == 15
