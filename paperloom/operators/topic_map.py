"""Which chunks belong to a topic: by pages, by similarity where pages give too few, by term frequency where both give none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators.page_join import in_ranges
from paperloom.operators.phrases import term_relevance
from paperloom.operators.vector_index import build_index, search
from paperloom.scratch import written

#: Score of a page match; page matches that are enough; most similar chunks and the least similarity; the same for term frequency, and its largest score.
PAGE_SCORE, PAGE_ENOUGH, SIM_MOST, SIM_LEAST, TF_MOST, TF_LEAST, TF_CAP = 0.80, 2, 8, 0.30, 5, 0.01, 0.75


def frequent_terms(topics: DataFrame, texts: DataFrame) -> DataFrame:
    """topic_id, chunk_id and score of the TF_MOST chunks in which a topic's name and keywords are most frequent."""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("s"), "id"))
    s = term_relevance(topics, texts).select("topic_id", "id", F.round("by_keywords", 6).alias("s")).where(F.col("s") >= TF_LEAST)
    return s.withColumn("r", rank).where(F.col("r") <= TF_MOST).select("topic_id", F.col("id").alias("chunk_id"), F.round(F.least("s", F.lit(TF_CAP)), 4).alias("score"))


def map_chunks(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """topic_id, chunk_id, score and path (1 to 3), for the chunks of a topic's course.

    topics: topic_id, course_id, name, start_page, end_page (null: one page), vec (or null). chunks: chunk_id, course_id, page,
    vec (or null), text. Chunks that the pages gave take no place among the similar ones.
    """
    spans = topics.where("start_page is not null").select("topic_id", F.col("course_id").alias("scope"), F.col("start_page").alias("first"), F.coalesce("end_page", "start_page").alias("last"))
    pages = in_ranges(chunks.where("page is not null").select("chunk_id", F.col("course_id").alias("scope"), "page"), spans)
    pages = written(pages.select("topic_id", "chunk_id").distinct())
    mapped = pages.groupBy("topic_id").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("chunk_id")), 1, PAGE_ENOUGH).alias("skip"))
    few = topics.join(mapped, "topic_id", "left").where(F.coalesce("n", F.lit(0)) < PAGE_ENOUGH)  # so skip holds all of their page matches
    index = build_index(chunks.select(F.col("chunk_id").alias("id"), "vec", F.col("course_id").alias("scope")))
    asked = few.select(F.col("topic_id").alias("id"), "vec", F.col("course_id").alias("scope"), "skip")
    near = written(search(index, asked, SIM_MOST, SIM_LEAST).select(F.col("query_id").alias("topic_id"), F.col("vec_id").alias("chunk_id"), F.round("score", 4).alias("score")))
    none = topics.join(pages.select("topic_id").unionByName(near.select("topic_id")).distinct(), "topic_id", "left_anti")
    terms = frequent_terms(none.select("topic_id", F.col("course_id").alias("scope"), "name"), chunks.select(F.col("chunk_id").alias("id"), F.col("course_id").alias("scope"), "text"))
    first = pages.select("topic_id", "chunk_id", F.lit(PAGE_SCORE).alias("score"), F.lit(1).alias("path"))
    return first.unionByName(near.withColumn("path", F.lit(2))).unionByName(terms.withColumn("path", F.lit(3)))
