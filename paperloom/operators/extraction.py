"""Topics of documents: several extractors are tried in turn, the best result is chosen, cleaned, ordered into a tree and mapped to chunks.

An extractor is tried only on documents that no earlier one settled: a result that is sane and sure ends the search for its
document, which leaves by an anti-join before the next extractor reads anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import similarity
from paperloom.functions.cleaning import trim_blanks, trim_space
from paperloom.operators import headings
from paperloom.operators.topic_filter import postprocess
from paperloom.operators.topic_map import map_chunks
from paperloom.operators.topics import cluster_topics
from paperloom.scratch import written

#: Fewest and most topics of a sane result, its least coverage of pages, confidence that settles a document, and one that is low.
SANE, LEAST_COVERAGE, SURE, LOW = (3, 50), 0.20, 0.75, 0.45
#: Sources that topics are filed under, by method.
SOURCES = {"PDF_OUTLINE": "TOC", "LAYOUT_HEADINGS": "AUTO", "REGEX_HEADINGS": "AUTO", "EMBEDDING_CLUSTERS": "AUTO"}
#: Fixed value: what stands before the title of an outline's entry.
PREFIX = r"(?i)^(?:(?:chapter|section|part|unit|lecture|module|appendix|slide)\s*[\d.]*\s*[:\-–]?\s*|[\d]+(?:\.[\d]+)*\.?\s+)"
FOUND = ("doc_id", "seq", "title", "level", "confidence", "start_page", "end_page", "parent", "overall")


@dataclass(frozen=True)
class Books:
    """What extractors read. outline: doc_id, seq, level (from 1), title, page. pages: doc_id, page_number, text. spans: doc_id, page, seq, text, size, bold. chunks: doc_id, chunk_id, page, vec, text."""

    outline: DataFrame
    pages: DataFrame
    spans: DataFrame
    chunks: DataFrame

    def only(self, docs: DataFrame) -> Books:
        return replace(self, **{name: getattr(self, name).join(docs, "doc_id", "left_semi") for name in ("outline", "pages", "spans", "chunks")})


class Extractor(Protocol):
    """method names the result; extract() gives the columns FOUND: overall is the confidence of a document's whole result."""

    method: str

    def extract(self, books: Books) -> DataFrame: ...


def _last_page(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.coalesce(F.max("page"), F.lit(0)).cast("long").alias("total"))


def entry_title(raw: Column) -> Column:
    """The title of an outline's entry without its number."""
    return F.regexp_replace(trim_space(F.regexp_replace(raw, PREFIX, "")), r"\s{2,}", " ")


class OutlineExtractor:
    """The outline that a document brings along; an entry ends before the next one with a page, the last ones with the document."""

    method = "PDF_OUTLINE"

    def extract(self, books: Books) -> DataFrame:
        later = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
        page = F.when(F.col("page") > 0, F.col("page").cast("long"))
        rows = books.outline.select("doc_id", F.col("seq").cast("long").alias("seq"), F.greatest(F.lit(1), F.least(F.lit(3), "level")).alias("depth"), trim_blanks(F.coalesce("title", F.lit(""))).alias("raw"), page.alias("start_page"))
        rows = rows.withColumn("next", F.first("start_page", ignorenulls=True).over(later)).join(_last_page(books.chunks), "doc_id", "left")
        end = F.when(F.col("next").isNotNull(), F.greatest(F.col("next") - 1, F.coalesce("start_page", F.lit(1)))).otherwise(F.nullif("total", F.lit(0)))
        level = F.when((F.col("depth") == 1) & F.col("raw").rlike(r"(?i)^part\b"), "PART").when(F.col("depth") == 1, "CHAPTER").when(F.col("depth") == 2, "SECTION").otherwise("SUBSECTION")
        named = rows.select("doc_id", "seq", entry_title(F.col("raw")).alias("title"), level.alias("level"), "start_page", end.alias("end_page")).where(F.length("title") >= 3)
        before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        last = lambda level: F.last(F.when(F.col("level") == level, F.col("title")), ignorenulls=True).over(before)
        parent = F.when(F.col("level") == "SECTION", last("CHAPTER")).when(F.col("level") == "SUBSECTION", last("SECTION"))
        own = Window.partitionBy("doc_id")
        n = lambda level, most: F.least(F.count_if(F.col("level") == level).over(own), F.lit(most))
        overall = F.least(F.lit(0.98), 0.60 + 0.04 * n("CHAPTER", 8) + 0.01 * n("SECTION", 20))
        return named.select("doc_id", "seq", "title", "level", F.lit(0.95).alias("confidence"), "start_page", "end_page", parent.alias("parent"), F.round(overall, 6).alias("overall"))


class LayoutExtractor:
    """Large and bold spans."""

    method = "LAYOUT_HEADINGS"

    def extract(self, books: Books) -> DataFrame:
        found = headings.layout_headings(books.spans)
        seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq")).cast("long")
        return found.select("doc_id", seq.alias("seq"), "title", "level", "confidence", F.col("page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), F.lit(None).cast("string").alias("parent"), "overall")


class RegexExtractor:
    """Lines that look like headings."""

    method = "REGEX_HEADINGS"

    def extract(self, books: Books) -> DataFrame:
        found = headings.regex_headings(books.pages)
        seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_no", "title")).cast("long")
        return found.select("doc_id", seq.alias("seq"), "title", "level", "confidence", F.col("page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), F.lit(None).cast("string").alias("parent"), F.col("confidence").alias("overall"))


class ClusterExtractor:
    """Clusters of the vectors of all open documents' chunks; a cluster is a topic of the documents that it has chunks of.

    One seeded k-means runs over all documents, since one for each would be a loop of jobs. The share of a cluster in a
    document is treated as a cluster of that document.
    """

    method = "EMBEDDING_CLUSTERS"

    def __init__(self, least: int = 5, most: int = 40, members: int = 20) -> None:
        self.least, self.most, self.members = least, most, members

    def extract(self, books: Books) -> DataFrame:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        chunks = books.chunks.where("vec is not null")
        n = chunks.count()
        if n < self.least:
            return chunks.limit(0).selectExpr("doc_id", "0L AS seq", "'' AS title", "'' AS level", "0D AS confidence", "0L AS start_page", "0L AS end_page", "'' AS parent", "0D AS overall")
        vectors = chunks.withColumn("features", array_to_vector(similarity.l2_normalise(F.col("vec"))))
        fitted = KMeans(k=max(self.least, min(self.most, n // self.members)), seed=42, maxIter=50).fit(vectors)
        own = fitted.transform(vectors).select(F.struct("doc_id", F.col("prediction").alias("k")).alias("cluster"), "chunk_id", similarity.l2_normalise(F.col("vec")).alias("vec"), "text", F.col("page").cast("long").alias("page"))
        topics = cluster_topics(own)
        doc = Window.partitionBy("cluster.doc_id")
        overall = F.least(F.lit(0.55), F.avg("confidence").over(doc))
        return topics.select("cluster.doc_id", F.col("cluster.k").cast("long").alias("seq"), "title", F.lit("CLUSTER").alias("level"), "confidence", F.col("first_page").alias("start_page"), F.col("last_page").alias("end_page"), F.lit(None).cast("string").alias("parent"), F.round(overall, 6).alias("overall"))


def all_extractors() -> list[Extractor]:
    return [OutlineExtractor(), LayoutExtractor(), RegexExtractor(), ClusterExtractor()]


def results(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n, conf, cov, usable, sane, score of one extractor's topics.

    Coverage is the share of pages in the topics' ranges; without page numbers in the document it is 1, and without any in
    the topics it is a tenth of the pages' count for each.
    """
    paged = found.join(_last_page(chunks), "doc_id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "end_page": F.when(F.col("start_page").isNotNull(), F.coalesce("end_page", "start_page"))})
    before = Window.partitionBy("doc_id").orderBy("start_page", "end_page").rowsBetween(Window.unboundedPreceding, -1)
    new_from = F.greatest("start_page", F.max("end_page").over(before) + 1)  # pages that no range before holds
    paged = paged.withColumn("new", F.when(F.col("start_page").isNotNull(), F.greatest(F.lit(0), F.col("end_page") - new_from + 1)).otherwise(0))
    facts = paged.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("overall").alias("conf"), F.max("total").alias("total"), F.bool_or(F.col("start_page").isNotNull()).alias("paged"), F.coalesce(F.sum("new"), F.lit(0)).alias("covered"))
    cov = F.when(F.col("total") == 0, 1.0).when(~F.col("paged"), F.col("n") / F.greatest(F.lit(1.0), F.col("total") / 10)).otherwise(F.col("covered") / F.col("total"))
    rows = facts.withColumn("cov", F.round(F.least(F.lit(1.0), cov), 6))
    usable = F.col("n").between(*SANE)
    rows = rows.withColumn("usable", usable).withColumn("sane", usable & (F.col("cov") >= LEAST_COVERAGE))
    score = F.col("conf") * F.when(F.col("sane"), 1.30).when(F.col("usable"), 1.00).otherwise(0.70) + F.least(F.lit(1.0), F.col("n") / 20.0) * 0.10
    return rows.select("doc_id", "n", "conf", "cov", "usable", "sane", F.round(score, 6).alias("score"))


def is_low(conf: Column, sane: Column, coverage: Column) -> Column:
    """Whether a result deserves a warning: not sure, or neither sane nor covering, unless it is both sane and sure."""
    return ((conf < LOW) | (~sane & (coverage < LEAST_COVERAGE))) & ~((conf >= SURE) & sane)


@dataclass(frozen=True)
class Selection:
    """tried: doc_id, place (of the extractor, from 0), method, and results(). chosen: the one row of each document. topics: FOUND of the chosen."""

    tried: DataFrame
    chosen: DataFrame
    topics: DataFrame


def select_topics(books: Books, extractors: Sequence[Extractor]) -> Selection:
    """Run the extractors in turn, each on the documents that are still open; the best score wins, of equals the earlier extractor."""
    pages = written(_last_page(books.chunks).withColumnRenamed("total", "page"))  # all that results need of the chunks
    open_ = pages.select("doc_id")
    tried, found = [], []
    for place, extractor in enumerate(extractors):
        rows = written(extractor.extract(books.only(open_) if place else books).select(*FOUND).join(open_, "doc_id", "left_semi"))
        scored = written(results(rows, pages).select("doc_id", F.lit(place).alias("place"), F.lit(extractor.method).alias("method"), "n", "conf", "cov", "usable", "sane", "score"))
        tried.append(scored)
        found.append(rows.withColumn("place", F.lit(place)))
        open_ = written(open_.join(scored.where(F.col("sane") & (F.col("conf") >= SURE)), "doc_id", "left_anti"))
    scores, rows = tried[0], found[0]
    for more, topics in zip(tried[1:], found[1:]):
        scores, rows = scores.unionByName(more), rows.unionByName(topics)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "place"))
    chosen = written(scores.withColumn("r", best).where("r = 1").drop("r"))
    return Selection(scores, chosen, rows.join(chosen.select("doc_id", "place"), ["doc_id", "place"]).drop("place"))


def with_parents(topics: DataFrame) -> DataFrame:
    """topics (doc_id, rank, title, level, parent title) with ``parent_rank``: of the topic of that title, else of the last chapter (of a section) or section (of a subsection) before."""
    titled = topics.groupBy("doc_id", F.col("title").alias("parent")).agg(F.max("rank").alias("named_rank"))
    before = Window.partitionBy("doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda level: F.last(F.when(F.col("level") == level, F.col("rank")), ignorenulls=True).over(before)
    near = F.when(F.col("level") == "SECTION", last("CHAPTER")).when(F.col("level") == "SUBSECTION", last("SECTION"))
    rows = topics.withColumn("near", near).join(titled, ["doc_id", "parent"], "left")
    named = F.col("parent").isNotNull() & (F.col("parent") != "")
    return rows.withColumn("parent_rank", F.when(named, F.col("named_rank")).otherwise(F.col("near"))).drop("near", "named_rank")


@dataclass(frozen=True)
class Extraction:
    """topics: doc_id, rank, title, level, confidence, start_page, end_page, parent_rank, source, coverage. mapping: doc_id, rank, chunk_id, score, path. meta: doc_id, method, confidence, low, coverage, n_topics, sane."""

    topics: DataFrame
    mapping: DataFrame
    meta: DataFrame


def extract_topics(books: Books, extractors: Sequence[Extractor], titles: DataFrame | None = None) -> Extraction:
    """The whole way, for all documents side by side. titles: title and vec of titles that have a vector, if any."""
    selection = select_topics(books, extractors)
    asked = selection.topics.select(F.col("doc_id").alias("course_id"), "seq", "title", "confidence", F.col("start_page").alias("page"), "level", "end_page", "parent")
    clean = postprocess(asked).withColumnsRenamed({"course_id": "doc_id", "page": "start_page"})
    tree = written(with_parents(clean))
    topic_id = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("rank").cast("string"))
    wanted = tree.select(topic_id.alias("topic_id"), F.col("doc_id").alias("course_id"), F.col("title").alias("name"), "start_page", "end_page")
    if titles is None:
        wanted = wanted.withColumn("vec", F.lit(None).cast(dict(books.chunks.dtypes)["vec"]))
    else:
        wanted = wanted.join(titles.select(F.col("title").alias("name"), "vec"), "name", "left")
    mapped = map_chunks(wanted, books.chunks.select("chunk_id", F.col("doc_id").alias("course_id"), "page", "vec", "text"))
    key = F.split("topic_id", "/")
    mapping = written(mapped.select(key[0].cast(dict(books.chunks.dtypes)["doc_id"]).alias("doc_id"), key[1].cast("int").alias("rank"), "chunk_id", "score", "path"))
    total = books.chunks.groupBy("doc_id").agg(F.count("*").alias("total"))
    own = mapping.groupBy("doc_id", "rank").agg(F.count_distinct("chunk_id").alias("n"))
    source = selection.chosen.select("doc_id", F.coalesce(*(F.when(F.col("method") == m, s) for m, s in SOURCES.items()), F.lit("AUTO")).alias("source"))
    topics = tree.join(own, ["doc_id", "rank"], "left").join(total, "doc_id").join(source, "doc_id")
    topics = topics.select("doc_id", "rank", "title", "level", "confidence", "start_page", "end_page", "parent_rank", "source", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 4).alias("coverage"))
    kept = tree.groupBy("doc_id").agg(F.count("*").alias("n_topics"))
    covered = mapping.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("covered"))
    meta = total.join(selection.chosen, "doc_id", "left").join(kept, "doc_id", "left").join(covered, "doc_id", "left")
    coverage = F.round(F.coalesce("covered", F.lit(0)) / F.col("total"), 4)
    conf, sane, some = F.coalesce("conf", F.lit(0.0)), F.coalesce("sane", F.lit(False)), F.coalesce("n_topics", F.lit(0)) > 0
    meta = meta.select("doc_id", F.coalesce("method", F.lit("NONE")).alias("method"), F.round(conf, 4).alias("confidence"), F.when(some, is_low(conf, sane, coverage)).otherwise(True).alias("low"), coverage.alias("coverage"), F.coalesce("n_topics", F.lit(0)).alias("n_topics"), sane.alias("sane"))
    return Extraction(topics, mapping, meta)
