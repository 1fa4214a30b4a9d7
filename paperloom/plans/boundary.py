"""Queries at the edges: sinks that are written and read back, model replies, responses, and jobs that react to arrivals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from paperloom.functions import notation
from paperloom.operators import chunking, models, slots
from paperloom.operators.page_join import overlapping
from paperloom.plans.assessment import _EXPORT_SQL as EXPORT_SQL
from paperloom.plans.assessment import CONFIG_SCHEMA, VALIDATIONS_SQL, export_render, validators_run
from paperloom.plans.chunks import _CLASS, _OFFSETS, _classified, _pages
from paperloom.plans.fixtures import options, stems, topic_map, topics, with_sql
from paperloom.plans.text import MATH_CASES, _cases, _spelled
from paperloom.registry import query, table
from paperloom.scratch import scratch_path, written
from paperloom.sources import sinks
from paperloom.streaming.budgets import arrivals


_cases("norm_alias", notation.repair_math, MATH_CASES, _spelled("text"))


@query("src_pdf_spans", "SELECT l_orderkey AS doc_id, l_suppkey % 3 AS page, l_linenumber AS seq, l_quantity AS size, l_returnflag = 'R' AS bold FROM lineitem")
def src_pdf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_suppkey % 3 AS page", "l_linenumber AS seq", "l_quantity AS size", "l_returnflag = 'R' AS bold")


@query("src_unclassified_batches", with_sql("derived", f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS batch FROM ({_CLASS}) WHERE chunk_type = 'instructional' AND score = 0"))
def src_unclassified_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 500 in id order; the numbering counts whole partitions first, so no partition holds all rows. Texts are classed once, and partitions are numbered once."""
    rows = _classified(spark, sf_dir).where("chunk_type = 'instructional' AND score = 0").select("doc_id")
    parts = written(written(rows).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    own = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return placed.select("doc_id", F.floor((F.col("before") + own) / 500).alias("batch"))


@query("sink_chunks", "SELECT doc_id % 5 AS course_id, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1")
def sink_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_chunks(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("course_id"), "text"), path)
    return spark.read.parquet(path).groupBy(F.col("course_id").cast("long").alias("course_id")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("sink_topics", with_sql("topics topic_map", "SELECT t.topic_id, md5(concat(course_id, chr(31), name)) AS topic_key, n FROM topics t JOIN (SELECT topic_id, count(*) AS n FROM topic_map GROUP BY 1) m USING (topic_id)"))
def sink_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_topics(topics(spark, sf_dir), topic_map(spark, sf_dir), path)
    counts = spark.read.parquet(f"{path}/topic_chunk_map").groupBy("topic_id").agg(F.count("*").alias("n"))
    return spark.read.parquet(f"{path}/topics").join(counts, "topic_id").select("topic_id", "topic_key", "n")


@query("sink_question_family", with_sql("stems options topic_map", "SELECT 'questions' AS kind, count(*) AS n FROM stems UNION ALL SELECT 'options', count(*) FROM options UNION ALL SELECT 'sources', count(*) FROM stems JOIN topic_map ON topic_id = set_id WHERE score > 0.9"))
def sink_question_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, options and sources go to tables of their own."""
    path = scratch_path(spark)
    q = stems(spark, sf_dir)
    sources = q.join(topic_map(spark, sf_dir).where("score > 0.9").withColumnRenamed("topic_id", "set_id"), "set_id").select("question_id", "chunk_id")
    for name, rows in (("questions", q), ("options", options(spark, sf_dir)), ("sources", sources)):
        rows.write.parquet(f"{path}/{name}")
    kinds = [spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("questions", "options", "sources")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("sink_tex", with_sql("stems options", f"SELECT exam_id, length(paper) AS chars, md5(paper) AS digest FROM ({EXPORT_SQL})"))
def sink_tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exam's paper is a file of its own, read back whole."""
    path = scratch_path(spark)
    sinks.write_tex(export_render(spark, sf_dir), path, "exam_id", "paper")
    paper = F.regexp_replace("value", r"\n\z", "")
    return spark.read.text(path, wholetext=True).select(F.col("exam_id").cast("long").alias("exam_id"), F.length(paper).cast("long").alias("chars"), F.md5(paper).alias("digest"))


@query("sink_validation", with_sql("stems options topic_map", VALIDATIONS_SQL))
def sink_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are appended, kind after kind, to the log of validations, and read back."""
    path, rows = scratch_path(spark), validators_run(spark, sf_dir)
    for kind in ("grounding", "distractor", "difficulty", "bloom", "triviality", "correctness"):
        sinks.append_rows(rows.where(F.col("validation_type") == kind), path, "validation_type")
    return spark.read.parquet(path).select("question_id", "validation_type", "status", "passed", "score", "outcome")


@query("sink_job_progress", "SELECT user_id AS job_id, arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000 + event_id % 1000000) AS status, count(*) AS n_events FROM events GROUP BY 1")
def sink_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates are appended in two batches; the view of the log has each job's last state."""
    path = scratch_path(spark)
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", (F.col("event_id") % 1000000).alias("no"), (F.col("event_id") % 2).alias("batch"))
    for batch in (1, 0):
        sinks.append_rows(log.where(F.col("batch") == batch), path, "batch")
    return sinks.latest(spark.read.parquet(path), "job_id", "status", "ts", "no").withColumnRenamed("n", "n_events")


REPLY_SCHEMA = StructType().add("level", "string").add("confidence", "double").json()


@query("json_schema_instruction", with_sql("stems", "SELECT question_id, concat(stem, chr(10), 'Reply as JSON of this schema:', chr(10), '" + REPLY_SCHEMA + "') AS prompt FROM stems"))
def json_schema_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt with the schema of the wanted reply at its end."""
    return stems(spark, sf_dir).select("question_id", F.concat("stem", F.lit("\nReply as JSON of this schema:\n"), F.lit(REPLY_SCHEMA)).alias("prompt"))


_LEVEL = "CASE length(stem) % 4 WHEN 0 THEN 'easy' WHEN 2 THEN 'hard' ELSE 'medium' END"


@query("llm_difficulty", with_sql("stems", f"SELECT question_id, {_LEVEL} AS level FROM stems"))
def llm_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that the model names; anything unknown is medium."""
    replies = models.generate(stems(spark, sf_dir), models.StandIn(), "question_id", "stem")
    level = F.from_json("reply", "level string")["level"]
    return replies.select(F.col("id").alias("question_id"), F.when(level.isin("easy", "medium", "hard"), level).otherwise("medium").alias("level"))


@query("llm_bloom", with_sql("stems", f"SELECT question_id, CASE {_LEVEL} WHEN 'easy' THEN 'remember' WHEN 'hard' THEN 'analyze' ELSE 'apply' END AS level FROM stems"))
def llm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("level")
    return llm_difficulty(spark, sf_dir).select("question_id", F.when(level == "easy", "remember").when(level == "hard", "analyze").otherwise("apply").alias("level"))


@query("llm_parse_retry", with_sql("stems", "SELECT question_id, CASE WHEN length(stem) % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM stems"))
def llm_parse_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = models.generate(stems(spark, sf_dir), models.StandIn(), "question_id", "stem")
    return replies.select(F.col("id").alias("question_id"), "attempts")


@query("defaults_fill", "SELECT o_orderkey, 0 AS mcq, 0 AS total_points FROM orders")
def defaults_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty configuration for every blueprint."""
    empty = json.dumps(models.default_value(StructType.fromDDL(CONFIG_SCHEMA.removeprefix("struct<").removesuffix(">"))))
    c = F.from_json(F.lit(empty), CONFIG_SCHEMA)
    return table(spark, sf_dir, "orders").select("o_orderkey", c["counts"]["mcq"].alias("mcq"), c["total_points"].alias("total_points"))


_CITED = "doc_id * 37 % 1000 AS a_first, doc_id * 37 % 1000 + 799 AS a_last"


@query("range_join_char", f"SELECT doc_id, page_number FROM (SELECT *, char_start + length(text) AS char_end, {_CITED} FROM ({_OFFSETS})) WHERE char_end > a_first AND char_start <= a_last")
def range_join_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that overlap a passage of 800 characters of their document, which starts elsewhere in each."""
    passages = table(spark, sf_dir, "documents").selectExpr("doc_id AS scope", *_CITED.split(", "))
    pages = chunking.page_offsets(_pages(spark, sf_dir)).select(F.col("doc_id").alias("scope"), "page_number", F.col("char_start").alias("b_first"), (F.col("char_end") - 1).alias("b_last"))
    return overlapping(passages, pages, chunking.CHAR_WIDTH).select(F.col("scope").alias("doc_id"), "page_number")


@query("map_counter", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def map_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of each source; of equals, the one seen first."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "first"))).where("r = 1").select("source", "lang", "n")


@query("id_uuid4", "SELECT doc_id, md5(concat('document:', doc_id)) AS id FROM documents")
def id_uuid4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from what they name, so that a repeated run gives the same ones."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("document:"), F.col("doc_id").cast("string"))).alias("id"))


@query("response_shape", with_sql("stems options", "SELECT set_id, count(*) AS n_questions, sum(CASE WHEN type = 'mcq' THEN 4 ELSE 0 END)::BIGINT AS n_options FROM stems GROUP BY 1"))
def response_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with their questions and options nested, and the counts taken from the nesting."""
    own = options(spark, sf_dir).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("k", "label", "text"))).alias("options"))
    q = stems(spark, sf_dir).join(own, "question_id", "left").groupBy("set_id").agg(F.collect_list(F.struct("question_id", "stem", "options")).alias("questions"))
    n = F.aggregate("questions", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.size(x["options"]), F.lit(0)))
    return q.select("set_id", F.size("questions").alias("n_questions"), n.alias("n_options"))


@query("topic_save_v1", with_sql("topics topic_map", "SELECT t.topic_id, round(coalesce(max(score), 0), 6) AS best, round(count(DISTINCT chunk_id) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS coverage FROM topics t LEFT JOIN topic_map m USING (topic_id) GROUP BY 1"))
def topic_save_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic with its best relevance and the share of chunks that it covers."""
    total = float(max(1, table(spark, sf_dir, "documents").count()))
    sums = topic_map(spark, sf_dir).groupBy("topic_id").agg(F.max("score").alias("best"), F.count_distinct("chunk_id").alias("n"))
    joined = topics(spark, sf_dir).join(sums, "topic_id", "left")
    return joined.select("topic_id", F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), F.round(F.coalesce("n", F.lit(0)) / F.lit(total), 6).alias("coverage"))


@query("slot_loop")
def slot_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as the slots of their conversation's job, over the chunks of their topic; replies by question and attempt."""
    replies = F.array(*(F.pmod(F.xxhash64("question_id", F.lit(k)), F.lit(4)) != 0 for k in range(slots.ATTEMPTS)))
    asked = stems(spark, sf_dir).select(F.floor(F.col("question_id") / 100).alias("job_id"), F.col("question_id").alias("slot"), (F.col("question_id") % 25).alias("topic_id"), "difficulty", "stem", replies.alias("replies"))
    return slots.fill_slots(asked, topic_map(spark, sf_dir))


# questions that are put into exams: an approved one, one that is in it already, one that is not approved, and one that does not exist
_ASKED = "CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 20 WHEN 1 THEN (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) WHEN 2 THEN 7 ELSE -5 END"


@query("exam_add", f"""WITH a AS (SELECT o_orderkey AS exam_id, {_ASKED} AS question_id FROM orders), h AS (SELECT l_orderkey AS exam_id, count(*) AS n, max(l_linenumber) AS latest FROM lineitem GROUP BY 1)
SELECT exam_id, question_id, result, CASE WHEN result = 'ok' THEN coalesce(latest, 0) + 1 END AS position FROM (SELECT a.exam_id, a.question_id, latest, CASE WHEN p.p_partkey IS NULL THEN 'unknown' WHEN p.p_partkey % 10 = 7 THEN 'not_approved' WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = a.exam_id AND l.l_partkey = a.question_id) THEN 'already' ELSE 'ok' END AS result FROM a LEFT JOIN part p ON p.p_partkey = a.question_id LEFT JOIN h ON h.exam_id = a.exam_id)""")
def exam_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question goes behind the last one of an exam, unless it is unknown, not approved (parts ending in 7), or in it already."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), F.col("l_partkey").alias("question_id"), "l_linenumber")
    held = items.groupBy("exam_id").agg(F.max("l_linenumber").alias("latest"), F.min("question_id").alias("own"))
    key = F.col("exam_id") % 4
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exam_id"), "o_custkey").join(held, "exam_id", "left")
    asked = asked.select("exam_id", "latest", F.when(key == 0, F.col("o_custkey") % 20).when(key == 1, F.col("own")).when(key == 2, 7).otherwise(-5).cast("long").alias("question_id"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 10 == 7).alias("open"))
    there = items.select("exam_id", "question_id").distinct().withColumn("there", F.lit(True))
    both = asked.join(known, "question_id", "left").join(there, ["exam_id", "question_id"], "left")
    result = F.when(F.col("open").isNull(), "unknown").when(F.col("open"), "not_approved").when(F.col("there"), "already").otherwise("ok")
    return both.select("exam_id", "question_id", result.alias("result"), F.when(result == "ok", F.coalesce("latest", F.lit(0)) + 1).alias("position"))


@query("rt_ingest_on_upload", "SELECT count(DISTINCT sha256(html)) AS processed FROM pages")
def rt_ingest_on_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive as a file stream, and each content is processed once."""
    path, at = scratch_path(spark), F.timestamp_micros(F.col("page_id") + 1_000_000)
    table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"), at.alias("ts")).write.parquet(f"{path}/in")  # the arrivals
    once = arrivals(spark, f"{path}/in", "page_id long, sha string, ts timestamp", "sha", "1 day")
    once.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("page_id long, sha string, ts timestamp").parquet(f"{path}/out").agg(F.count("*").alias("processed"))


@query("rt_task_queue", "SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events")
def rt_task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in micro-batches with acknowledgement by checkpoint; a batch that is delivered again overwrites its own folder."""
    path = scratch_path(spark)
    arrived = table(spark, sf_dir, "events").select("event_id", "event_type")
    arrived.write.parquet(f"{path}/in")

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    spark.readStream.schema(arrived.schema).parquet(f"{path}/in").writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))
