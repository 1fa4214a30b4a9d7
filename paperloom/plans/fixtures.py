"""Inputs of the registered queries, derived from the generated tables in the same way for Spark and for DuckDB.

Each fixture is a DataFrame function and the SQL of a common table expression; ``with_sql`` puts the latter before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.registry import spread, table

_DERIVE = """CASE doc_id % 8
 WHEN 1 THEN concat('References', chr(10), '[1] A.', chr(10), text)
 WHEN 2 THEN concat('This internal assessment follows the mark allocation.', chr(10), text)
 WHEN 3 THEN concat('Problem 7', chr(10), '(a) Find x. (b) Show y.', chr(10), text)
 WHEN 4 THEN replace(text, chr(10), concat(chr(10), chr(10), chr(10), chr(10)))
 WHEN 5 THEN concat(replace(text, ' ', '  '), chr(160), chr(10), chr(1), 'end')
 WHEN 6 THEN replace(text, '.', ' [1] [2] [3].')
 WHEN 7 THEN concat('1.2 Title Case Heading', chr(10), 'CHAPTER 3: SOMETHING', chr(10), text)
 ELSE text END"""


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, course_id, chunk_index, content: every document with artefacts put in by doc_id."""
    content = F.expr(_DERIVE)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", (F.col("doc_id") % 5).alias("course_id"), (F.col("doc_id") % 10).alias("chunk_index"), content.alias("content"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, set_id, course_id, blueprint_id, type, difficulty, bloom, status, stem: the user turns as questions."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        *(F.expr(e).alias(n) for n, e in _STEM_COLUMNS.items()),
    )


_STEM_COLUMNS = {
    "set_id": "conv_id % 20",
    "course_id": "conv_id % 20 % 5",
    "blueprint_id": "nullif(conv_id % 7, 0)",
    "type": "CASE conv_id % 4 WHEN 0 THEN 'mcq' WHEN 1 THEN 'true_false' WHEN 2 THEN 'short_answer' ELSE 'essay' END",
    "difficulty": "CASE conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END",
    "bloom": "CASE conv_id % 6 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'apply' WHEN 3 THEN 'analyze' WHEN 4 THEN 'evaluate' ELSE 'create' END",
    "status": "CASE (conv_id + turn) % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'approved' ELSE 'rejected' END",
    "stem": "concat(CASE conv_id % 5 WHEN 0 THEN 'What is the ' WHEN 1 THEN 'Define ' WHEN 2 THEN 'Compare and contrast ' WHEN 3 THEN 'Calculate ' ELSE '' END, text)",
}

_OPTION_TEXT = "CASE WHEN k = 3 AND question_id % 3 = 0 THEN substr(stem, 1, 12) WHEN k = 2 AND question_id % 11 = 0 THEN 'All of the above.' WHEN k = 1 AND question_id % 13 = 0 THEN concat(stem, stem, stem) ELSE substr(stem, 1 + k * 7, 12) END"


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, k, label, text, is_correct: four options of each multiple-choice question, some of them faulty."""
    each = stems(spark, sf_dir).where("type = 'mcq'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return each.select("question_id", "k", F.substring(F.lit("ABCD"), F.col("k") + 1, F.lit(1)).alias("label"), F.expr(_OPTION_TEXT).alias("text"), F.expr("k = question_id % 5").alias("is_correct"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, course_id, name, parent_id, is_auto: nations as topics of five courses."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("topic_id"), F.expr("cast(n_nationkey % 5 as bigint)").alias("course_id"), F.col("n_name").alias("name"), F.expr("cast(CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey % 5 END as bigint)").alias("parent_id"), F.expr("n_nationkey % 3 <> 0").alias("is_auto"))


def topic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, chunk_id, score: two topics for each document, some without a score."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    score = "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 97 / 100.0D END"
    first = d.selectExpr("doc_id % 25 AS topic_id", "doc_id AS chunk_id", f"{score} AS score")
    return first.unionByName(d.where("(doc_id * 7 + 3) % 25 <> doc_id % 25").selectExpr("(doc_id * 7 + 3) % 25 AS topic_id", "doc_id AS chunk_id", "0.05D AS score"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, level, title, page: an outline of each order from its line items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return items.selectExpr("l_orderkey AS doc_id", "l_linenumber AS seq", "cast(1 + l_partkey % 3 AS int) AS level", "concat(CASE l_partkey % 4 WHEN 0 THEN 'Chapter 3: ' WHEN 1 THEN '1.2 ' ELSE '' END, 'Part ', cast(l_partkey AS string)) AS title", "cast(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_linenumber * 3 + l_suppkey % 3 END AS int) AS page")


# twenty documents are the pages of a book: a running header, here and there a heading line, and a printed table of contents
_BOOK_TEXT = """CASE
 WHEN doc_id % 20 = 0 AND doc_id % 3 = 0 THEN concat('LECTURE NOTES ON GRAPHS', chr(10), 'Contents', chr(10), '1.1 Sets and Maps ..... 3', chr(10), '    2.1 Trees of Order ', doc_id, ' . . . . ', 5 + doc_id % 9, chr(10), '        Walks on Graphs and Trees', chr(10), '  Sets and  maps ..... 4', chr(10), 'Index ..... 99', chr(10), 'Homework Problems ..... 12')
 WHEN doc_id % 20 = 2 AND doc_id % 3 <> 1 THEN concat('Trees in Order ..... 8', chr(10), 'lower case line', chr(10), 'Flows of Order ', doc_id, ' .... 9', chr(10), '      Cuts and Flows . . 11', chr(10), 'Trees in Order ..... 9')
 ELSE concat('LECTURE NOTES ON GRAPHS', chr(10), CASE doc_id % 9
  WHEN 1 THEN concat(1 + doc_id % 20, '.2  Matchings and Covers ', doc_id, chr(10))
  WHEN 2 THEN concat('Chapter ', 1 + doc_id % 20, ': Flows of Order ', doc_id, chr(10))
  WHEN 3 THEN concat('  INDUCTION (PART ', doc_id, ')', chr(10), 'AND RECURSION-TREES', chr(10))
  WHEN 4 THEN concat('HTTP://WWW.EXAMPLE.ORG', chr(10), '12345678901', chr(10))
  WHEN 5 THEN concat('1.2.3.4 Deep Part', chr(10), '7 Order of Growth', chr(10), '3.1.4 Small Part', chr(10)) ELSE '' END, text) END"""
_SPAN = {"size": "CASE WHEN length(text) <= 80 THEN 10 + length(text) % 5 ELSE 10 END", "bold": "length(text) % 7 = 0"}


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, text: the pages of books."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.floor(F.col("doc_id") / 20).alias("doc_id"), (F.col("doc_id") % 20 + 1).alias("page_number"), F.expr(_BOOK_TEXT).alias("text"))


def book_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, seq, text, size, bold: the lines of the books' pages as layout spans."""
    lines = books(spark, sf_dir).select("doc_id", F.col("page_number").alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return lines.select("doc_id", "page", F.col("seq").cast("long").alias("seq"), "text", F.expr(_SPAN["size"]).cast("double").alias("size"), F.expr(_SPAN["bold"]).alias("bold"))


# chunks that name topics: early, late and again, or only a word of a name; a page each, and the vector of the same id
_PLANTED = """CASE doc_id % 12
 WHEN 0 THEN concat('On Nation_', doc_id % 25, ': ', text)
 WHEN 2 THEN concat(text, ' About NATION_', doc_id % 25, ', nation_', doc_id % 25, 'nation_', doc_id % 25, '.')
 WHEN 3 THEN concat(text, ' of the nations and nationalities')
 ELSE text END"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, course_id, page, vec, text: the documents as chunks of courses."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    chunks = d.select(F.col("doc_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 5).alias("course_id"), (F.col("doc_id") % 997).alias("page"), F.expr(_PLANTED).alias("text"))
    return chunks.join(vectors, "doc_id", "left").drop("doc_id")


_PAGED = {
    "start_page": "cast(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 3 END as bigint)",
    "end_page": "cast(CASE n_nationkey % 4 WHEN 1 THEN n_nationkey * 3 + 29 WHEN 2 THEN n_nationkey * 3 + 4 END as bigint)",
}


def paged_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, course_id, name, start_page, end_page, vec: topics with many pages, few, one or none, and some without a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("topic_id"), F.col("embedding").alias("vec"))
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("topic_id"), *(F.expr(e).alias(n) for n, e in _PAGED.items()))
    t = topics(spark, sf_dir).select("topic_id", "course_id", "name").join(pages, "topic_id").join(vectors.where("topic_id < 25 and topic_id % 3 <> 0"), "topic_id", "left")
    return t.select("topic_id", "course_id", "name", "start_page", "end_page", "vec")


CTE = {
    "planted": f"SELECT doc_id AS chunk_id, doc_id % 5 AS course_id, doc_id % 997 AS page, embedding::DOUBLE[] AS vec, {_PLANTED} AS text FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "paged_topics": f"SELECT topic_id, course_id, name, {', '.join(f'{e} AS {n}' for n, e in _PAGED.items())}, CASE WHEN topic_id % 3 <> 0 THEN embedding::DOUBLE[] END AS vec FROM topics JOIN nation ON n_nationkey = topic_id LEFT JOIN embeddings ON vec_id = topic_id",
    "books": f"SELECT cast(floor(doc_id / 20) AS BIGINT) AS doc_id, doc_id % 20 + 1 AS page_number, {_BOOK_TEXT} AS text FROM documents WHERE text IS NOT NULL",
    "book_lines": "SELECT doc_id, page_number AS page, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM books",
    "book_spans": f"SELECT doc_id, page, line_no AS seq, raw AS text, cast({_SPAN['size'].replace('text', 'raw')} AS DOUBLE) AS size, {_SPAN['bold'].replace('text', 'raw')} AS bold FROM book_lines",
    "derived": f"SELECT doc_id, doc_id % 5 AS course_id, doc_id % 10 AS chunk_index, {_DERIVE} AS content FROM documents",
    "stems": "SELECT conv_id * 100 + turn AS question_id, " + ", ".join(f"{e} AS {n}" for n, e in _STEM_COLUMNS.items()) + " FROM conversations WHERE role = 'user'",
    "options": f"SELECT question_id, k, substr('ABCD', k + 1, 1) AS label, {_OPTION_TEXT} AS text, k = question_id % 5 AS is_correct FROM stems, (SELECT cast(unnest(range(4)) AS INTEGER) AS k) WHERE type = 'mcq'",
    "topics": "SELECT cast(n_nationkey AS BIGINT) AS topic_id, cast(n_nationkey % 5 AS BIGINT) AS course_id, n_name AS name, cast(CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey % 5 END AS BIGINT) AS parent_id, n_nationkey % 3 <> 0 AS is_auto FROM nation",
    "topic_map": "SELECT doc_id % 25 AS topic_id, doc_id AS chunk_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 97 / 100.0::DOUBLE END AS score FROM documents UNION ALL SELECT (doc_id * 7 + 3) % 25, doc_id, 0.05::DOUBLE FROM documents WHERE (doc_id * 7 + 3) % 25 <> doc_id % 25",
    "outline": "SELECT l_orderkey AS doc_id, l_linenumber AS seq, 1 + l_partkey % 3 AS level, concat(CASE l_partkey % 4 WHEN 0 THEN 'Chapter 3: ' WHEN 1 THEN '1.2 ' ELSE '' END, 'Part ', l_partkey) AS title, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_linenumber * 3 + l_suppkey % 3 END AS page FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)",
}


def with_sql(names: str, body: str) -> str:
    """body after the named fixtures (options needs stems before it)."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names.split()) + " " + body


#: DuckDB: strip all white space at both ends.
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"
