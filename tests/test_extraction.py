"""Choice of extractors, trees and warnings against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import extraction

FOUND = "doc_id long, seq long, title string, level string, confidence double, start_page long, end_page long, parent string, overall double"


class Listed:
    """An extractor with given rows that notes which documents it was asked for."""

    def __init__(self, spark, method, rows):
        self.method, self.seen, self.rows = method, None, spark.createDataFrame(rows, FOUND)

    def extract(self, books):
        self.seen = {r["doc_id"] for r in books.chunks.select("doc_id").distinct().collect()}
        return self.rows.join(books.chunks.select("doc_id").distinct(), "doc_id", "left_semi")


@pytest.fixture(scope="module")
def books(spark):
    chunks = [(d, d * 100 + p, p, None, f"words of Sets {d} and Maps") for d in range(8) for p in range(1, 11)] + [(8, 801, None, None, "no pages, Sets"), (9, 901, 1, None, None)]
    outline = [(1, 1, 1, "Part I", 1), (1, 2, 1, "Chapter 2: Sets", 0), (1, 3, 2, "2.1  Maps of   Sets", 4), (1, 4, 3, "Trees", 4), (1, 5, 9, "Walks", None), (2, 1, 1, "x", 3)]
    return extraction.Books(
        spark.createDataFrame(outline, "doc_id long, seq int, level int, title string, page int"),
        spark.createDataFrame([(0, 1, "1.2 Sets and Maps")], "doc_id long, page_number long, text string"),
        spark.createDataFrame([(0, 1, 1, "Sets", 12.0, False)], "doc_id long, page long, seq long, text string, size double, bold boolean"),
        spark.createDataFrame(chunks, "doc_id long, chunk_id long, page long, vec array<double>, text string"),
    )


def rows_of(doc, n, overall, start=None, end=None, level="CHAPTER"):
    return [(doc, k, f"Sets {chr(65 + k)} {'maps' * k}", level, 0.5, start, end, None, overall) for k in range(n)]


def test_settled_documents_leave(spark, books):
    first = Listed(spark, "PDF_OUTLINE", rows_of(0, 3, 0.8, 1, 2) + rows_of(1, 3, 0.8, 1, 1) + rows_of(2, 2, 0.9, 1, 10) + rows_of(3, 3, 0.74, 1, 5) + rows_of(8, 3, 0.8))
    second = Listed(spark, "REGEX_HEADINGS", rows_of(0, 9, 0.99, 1, 9) + rows_of(1, 20, 0.62, 2, 9) + rows_of(3, 3, 0.74, 1, 5) + rows_of(4, 51, 0.9, 1, 9))
    selection = extraction.select_topics(books, [first, second])
    assert second.seen == {1, 2, 3, 4, 5, 6, 7, 9}  # documents 0 and 8 are settled: sane and sure
    tried = {(r["doc_id"], r["place"]): r for r in selection.tried.collect()}
    assert [tried[k, 0]["cov"] for k in (0, 1, 2, 3, 8)] == [0.2, 0.1, 1.0, 0.5, 1.0]
    assert tried[1, 0]["score"] == pytest.approx(0.8 + 0.015) and tried[1, 1]["score"] == pytest.approx(0.62 * 1.3 + 0.1)
    assert tried[2, 0]["score"] == pytest.approx(0.9 * 0.7 + 0.01) and not tried[4, 1]["usable"]
    assert {r["doc_id"]: r["method"] for r in selection.chosen.collect()} == {0: "PDF_OUTLINE", 1: "REGEX_HEADINGS", 2: "PDF_OUTLINE", 3: "PDF_OUTLINE", 4: "REGEX_HEADINGS", 8: "PDF_OUTLINE"}
    assert {r["doc_id"]: r["n"] for r in selection.topics.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 20, 2: 2, 3: 3, 4: 51, 8: 3}


def test_coverage_is_the_union_of_ranges(spark, books):
    rng = random.Random(8)
    rows = []
    for doc in range(8):
        for k in range(rng.randint(1, 9)):
            start = rng.choice([None, *range(1, 12)])
            rows.append((doc, k, "t", "CHAPTER", 0.5, start, rng.choice([None, start, (start or 1) + 2, (start or 1) - 1]), None, 0.5))
    got = {r["doc_id"]: r["cov"] for r in extraction.results(spark.createDataFrame(rows, FOUND), books.chunks).collect()}
    for doc in range(8):
        own = [(r[5], r[6]) for r in rows if r[0] == doc]
        pages = {p for a, b in own if a is not None for p in range(a, (a if b is None else b) + 1)}
        want = min(1.0, len(pages) / 10) if any(a is not None for a, _ in own) else min(1.0, len(own) / 1.0)
        assert got[doc] == pytest.approx(want), doc


def test_outline_entries(spark, books):
    got = [tuple(r) for r in extraction.OutlineExtractor().extract(books).orderBy("doc_id", "seq").collect()]
    overall = pytest.approx(0.60 + 0.04 + 0.01)
    assert got == [
        (1, 2, "Sets", "CHAPTER", 0.95, None, 3, None, overall),
        (1, 3, "Maps of Sets", "SECTION", 0.95, 4, 4, "Sets", overall),
        (1, 4, "Trees", "SUBSECTION", 0.95, 4, 10, "Maps of Sets", overall),
        (1, 5, "Walks", "SUBSECTION", 0.95, None, 10, "Maps of Sets", overall),
    ]


def test_parents(spark):
    rng = random.Random(3)
    rows = [(d, k, f"T{rng.randint(0, 9)}", rng.choice(["CHAPTER", "SECTION", "SUBSECTION", "HEADING"]), rng.choice([None, None, "", "T1", "gone"])) for d in range(6) for k in range(1, 20)]
    got = {(r["doc_id"], r["rank"]): r["parent_rank"] for r in extraction.with_parents(spark.createDataFrame(rows, "doc_id long, rank int, title string, level string, parent string")).collect()}
    above = {"SECTION": "CHAPTER", "SUBSECTION": "SECTION"}
    for d, k, _, level, parent in rows:
        own = [r for r in rows if r[0] == d]
        if parent:
            want = max((r[1] for r in own if r[2] == parent), default=None)
        else:
            want = max((r[1] for r in own if r[1] < k and level in above and r[3] == above[level]), default=None)
        assert got[d, k] == want


def test_whole_extraction(spark, books):
    first = Listed(spark, "PDF_OUTLINE", [(0, 0, "Chapter 1", "CHAPTER", 0.9, 1, 4, None, 0.5), (0, 1, "Sets", "CHAPTER", 0.9, 1, 4, None, 0.5), (0, 2, "Maps", "SECTION", 0.9, 3, 5, None, 0.5), (1, 0, "Index", "CHAPTER", 0.9, 1, 1, None, 0.4), (2, 0, "12", "CHAPTER", 0.9, 1, 1, None, 0.9)])
    out = extraction.extract_topics(books, [first])
    topics = {(r["doc_id"], r["title"]): r for r in out.topics.collect()}
    assert set(topics) == {(0, "Chapter"), (0, "Sets"), (0, "Maps"), (1, "Index")}
    assert topics[0, "Maps"]["parent_rank"] == topics[0, "Sets"]["rank"] and topics[0, "Sets"]["coverage"] == 0.4 and topics[0, "Sets"]["source"] == "TOC"
    meta = {r["doc_id"]: r for r in out.meta.collect()}
    assert len(meta) == 10
    assert (meta[0]["n_topics"], meta[0]["coverage"], meta[0]["low"], meta[0]["sane"]) == (3, 0.5, False, True)
    assert meta[1]["low"] and meta[2]["low"] and meta[2]["method"] == "PDF_OUTLINE" and meta[2]["n_topics"] == 0
    assert (meta[5]["method"], meta[5]["confidence"], meta[5]["low"]) == ("NONE", 0.0, True)


def test_clusters_over_documents(spark, books):
    rows = [(d, d * 100 + k, k, [1.0 if j == (d + k) % 3 else 0.01 * d for j in range(3)], f"{['graphs', 'matrices', 'integrals'][(d + k) % 3]} words {k}") for d in range(4) for k in range(1, 12)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, page long, vec array<double>, text string")
    found = extraction.ClusterExtractor(least=3, most=3).extract(extraction.Books(books.outline, books.pages, books.spans, chunks)).collect()
    assert {r["doc_id"] for r in found} == {0, 1, 2, 3} and all(r["level"] == "CLUSTER" and r["overall"] <= 0.55 for r in found)
    assert extraction.ClusterExtractor().extract(books).count() == 0
