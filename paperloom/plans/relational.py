"""Queries over joins, aggregations, windows, sorting, paging and set operations of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.ordinals import ordinal, ordinal_sql
from paperloom.operators import topics as topic_ops
from paperloom.operators.page_join import in_ranges
from paperloom.plans.chunks import NGRAMS_SQL
from paperloom.plans.fixtures import derived, options, outline, stems, topic_map, topics, with_sql
from paperloom.plans.topics import HEADING_NAMES_SQL
from paperloom.registry import query, spread, table
from paperloom.scratch import written

TYPE_ORD = ordinal_sql("type", "question_type")


@query("join_topic_chunks", with_sql("topic_map", "SELECT m.topic_id, m.chunk_id, m.score, d.source FROM topic_map m JOIN documents d ON d.doc_id = m.chunk_id WHERE d.source <> 'src0'"))
def join_topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source <> 'src0'").select(F.col("doc_id").alias("chunk_id"), "source")
    return topic_map(spark, sf_dir).join(d, "chunk_id").select("topic_id", "chunk_id", "score", "source")


@query("join_similarity_scope", "SELECT vec_id, label, source FROM embeddings JOIN documents ON doc_id = vec_id WHERE doc_id % 5 = 2")
def join_similarity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 2").select(F.col("doc_id").alias("vec_id"), "source")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(d, "vec_id")


_BLUEPRINTS = "SELECT DISTINCT cast(n_regionkey AS BIGINT) AS blueprint_id, 'Blueprint ' || n_regionkey AS title FROM nation"


def _blueprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("blueprint_id"), F.concat(F.lit("Blueprint "), F.col("r_regionkey").cast("string")).alias("title"))


@query("join_question_blueprint", with_sql("stems", f"SELECT question_id, s.blueprint_id, title FROM stems s LEFT JOIN ({_BLUEPRINTS}) b USING (blueprint_id)"))
def join_question_blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).join(_blueprints(spark, sf_dir), "blueprint_id", "left").select("question_id", "blueprint_id", "title")


@query("join_topics_left_count", with_sql("topics topic_map", "SELECT t.topic_id, name, coalesce(n, 0) AS chunk_count FROM topics t LEFT JOIN (SELECT topic_id, count(*) AS n FROM topic_map WHERE score > 0.9 GROUP BY 1) c USING (topic_id)"))
def join_topics_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = topic_map(spark, sf_dir).where("score > 0.9").groupBy("topic_id").agg(F.count("*").alias("n"))
    return topics(spark, sf_dir).join(counts, "topic_id", "left").select("topic_id", "name", F.coalesce("n", F.lit(0)).alias("chunk_count"))


@query("agg_chunk_count", with_sql("topic_map", "SELECT topic_id, count(*) AS n FROM topic_map GROUP BY 1"))
def agg_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_map(spark, sf_dir).groupBy("topic_id").agg(F.count("*").alias("n"))


@query("anti_not_in", with_sql("stems", "SELECT question_id FROM stems WHERE status = 'approved' AND type = 'mcq' AND question_id NOT IN (SELECT question_id FROM stems WHERE blueprint_id = 3)"))
def anti_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stems(spark, sf_dir)
    return q.where("status = 'approved' AND type = 'mcq'").join(q.where("blueprint_id = 3").select("question_id"), "question_id", "left_anti").select("question_id")


@query("semi_in", with_sql("topics topic_map", "SELECT topic_id, name FROM topics WHERE course_id = 2 AND topic_id IN (SELECT topic_id FROM topic_map WHERE score >= 0.5)"))
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = topic_map(spark, sf_dir).where("score >= 0.5").select("topic_id")
    return topics(spark, sf_dir).where("course_id = 2").join(wanted, "topic_id", "left_semi").select("topic_id", "name")


@query("join_recent_questions", with_sql("stems", "SELECT course_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY question_id DESC) AS r FROM stems) WHERE r <= 100"))
def join_recent_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("question_id")))
    return stems(spark, sf_dir).withColumn("r", rank).where("r <= 100").select("course_id", "question_id")


_SOURCES = "SELECT question_id, course_id, question_id % 97 AS chunk_id FROM stems"


@query("join_recent_sources", with_sql("stems", f"SELECT DISTINCT chunk_id FROM (SELECT * FROM ({_SOURCES}) ORDER BY question_id DESC LIMIT 200)"))
def join_recent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is on source rows, before they are made distinct."""
    rows = stems(spark, sf_dir).select("question_id", (F.col("question_id") % 97).alias("chunk_id"))
    return rows.orderBy(F.desc("question_id")).limit(200).select("chunk_id").distinct()


query("set_recent_chunk_ids", with_sql("stems", f"SELECT DISTINCT chunk_id FROM (SELECT * FROM ({_SOURCES}) ORDER BY question_id DESC LIMIT 200)"))(join_recent_sources)


@query("join_eager_graph", with_sql("stems options", "SELECT q.question_id, q.type, coalesce(n, 0) AS n_options, coalesce(labels, '') AS labels FROM stems q LEFT JOIN (SELECT question_id, count(*) AS n, string_agg(label || '=' || text, '; ' ORDER BY k) AS labels FROM options GROUP BY 1) o USING (question_id)"))
def join_eager_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = options(spark, sf_dir).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("k", "label", "text"))).alias("o"))
    joined = stems(spark, sf_dir).join(own, "question_id", "left")
    labels = F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit("="), x["text"])), "; ")
    return joined.select("question_id", "type", F.coalesce(F.size("o"), F.lit(0)).alias("n_options"), F.coalesce(labels, F.lit("")).alias("labels"))


_RANGES = "SELECT l_orderkey AS topic_id, min(l_linenumber) * 10 AS a, max(l_linenumber) * 12 AS b FROM lineitem WHERE l_orderkey <= 400 GROUP BY 1"


@query("range_join_pages", "SELECT topic_id, doc_id AS chunk_id FROM (SELECT cast(n_nationkey AS BIGINT) AS topic_id, n_nationkey % 5 AS course, n_nationkey * 3 AS a, n_nationkey * 3 + 10 AS b FROM nation) t JOIN (SELECT doc_id, doc_id % 5 AS course, doc_id % 80 AS page FROM documents) c ON c.course = t.course AND page BETWEEN a AND b")
def range_join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics span pages of their course: spans fall into bins of pages, so chunks and spans meet by equal keys."""
    t = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS topic_id", "cast(n_nationkey % 5 AS bigint) AS scope", "n_nationkey * 3 AS first", "n_nationkey * 3 + 10 AS last")
    c = table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "doc_id % 5 AS scope", "doc_id % 80 AS page")
    return in_ranges(c, t).select("topic_id", "chunk_id")


@query("self_join_dominance", "SELECT DISTINCT s_name AS name FROM (SELECT 'topic ' || s_suppkey AS s_name FROM supplier) a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE 'topic ' || b.s_suppkey <> a.s_name AND contains('topic ' || b.s_suppkey, a.s_name))")
def self_join_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name goes if it lies in a longer one. Prefixes and inner parts are looked up by equality, not by comparing all pairs."""
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("topic "), F.col("s_suppkey").cast("string")).alias("name")).distinct()
    n = F.length("name")
    parts = names.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(i.alias("i"), F.substring("name", i, k).alias("part")))))).alias("p"), n.alias("n"))
    inner = parts.where(F.length("p.part") < F.col("n")).select(F.col("p.part").alias("name")).distinct()
    return names.join(inner, "name", "left_anti")


@query("self_join_hierarchy", with_sql("topics", "SELECT p.topic_id, p.name, count(c.topic_id) AS n_children FROM topics p LEFT JOIN topics c ON c.parent_id = p.topic_id WHERE p.parent_id IS NULL GROUP BY 1, 2"))
def self_join_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topics(spark, sf_dir)
    children = t.groupBy(F.col("parent_id").alias("topic_id")).agg(F.count("*").alias("n"))
    return t.where("parent_id is null").join(children, "topic_id", "left").select("topic_id", "name", F.coalesce("n", F.lit(0)).alias("n_children"))


@query("agg_status_counts", with_sql("stems", "SELECT set_id, count(*) AS total, count_if(status = 'draft') AS draft, count_if(status = 'reviewed') AS reviewed, count_if(status = 'approved') AS approved, count_if(status = 'rejected') AS rejected FROM stems GROUP BY 1"))
def agg_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("draft", "reviewed", "approved", "rejected")]
    return stems(spark, sf_dir).groupBy("set_id").agg(F.count("*").alias("total"), *counts)


@query("agg_group_by_blueprint", with_sql("stems", "SELECT coalesce(blueprint_id::VARCHAR, 'No Blueprint') AS grp, count(*) AS n, min(question_id) AS first_id FROM stems GROUP BY 1"))
def agg_group_by_blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).groupBy(F.coalesce(F.col("blueprint_id").cast("string"), F.lit("No Blueprint")).alias("grp")).agg(F.count("*").alias("n"), F.min("question_id").alias("first_id"))


@query("agg_total_points", "SELECT l_orderkey AS exam_id, cast(trunc(sum(l_quantity) * 1.5) AS INTEGER) AS total_points, count(*) AS n FROM lineitem GROUP BY 1")
def agg_total_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as exams: points are summed and truncated."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("exam_id")).agg((F.sum("l_quantity") * 1.5).cast("int").alias("total_points"), F.count("*").alias("n"))


@query("agg_exam_size", "SELECT l_orderkey AS exam_id, count(*) AS n_slots FROM lineitem GROUP BY 1")
def agg_exam_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("exam_id")).agg(F.count("*").alias("n_slots"))


@query("agg_total_questions", "SELECT o_orderkey AS id, o_orderkey % 4 + o_orderkey % 3 + o_orderkey % 7 + o_orderkey % 2 AS total, (o_orderkey % 5) * 25 + (o_custkey % 4) * 25 + (o_orderkey % 3) * 10 = 100 AS mix_ok FROM orders")
def agg_total_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of all types, and whether the percentages of the three difficulties make 100."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), (k % 4 + k % 3 + k % 7 + k % 2).alias("total"), ((k % 5) * 25 + (c % 4) * 25 + (k % 3) * 10 == 100).alias("mix_ok"))


@query("agg_coverage_topic", with_sql("topic_map", "SELECT topic_id, round(count(DISTINCT chunk_id) / (SELECT count(*) FROM documents)::DOUBLE, 4) AS coverage FROM topic_map GROUP BY 1"))
def agg_coverage_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "documents").count()
    return topic_map(spark, sf_dir).groupBy("topic_id").agg(F.round(F.count_distinct("chunk_id") / F.lit(float(max(1, total))), 4).alias("coverage"))


@query("agg_coverage_course", with_sql("topics topic_map", "SELECT course_id, count(DISTINCT chunk_id) AS covered FROM topic_map JOIN topics USING (topic_id) GROUP BY 1"))
def agg_coverage_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_map(spark, sf_dir).join(F.broadcast(topics(spark, sf_dir)), "topic_id").groupBy("course_id").agg(F.count_distinct("chunk_id").alias("covered"))


@query("set_covered", with_sql("topic_map", "SELECT DISTINCT chunk_id FROM topic_map"))
def set_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_map(spark, sf_dir).select("chunk_id").distinct()


@query("agg_est_coverage", "SELECT l_orderkey AS doc_id, least(1.0, count(DISTINCT p) / 30.0::DOUBLE) AS coverage FROM (SELECT l_orderkey, unnest(range(l_linenumber, l_linenumber + l_suppkey % 6 + 1)) AS p FROM lineitem) GROUP BY 1")
def agg_est_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages under page ranges, over 30 pages."""
    first = F.col("l_linenumber").cast("long")
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.sequence(first, first + F.col("l_suppkey") % 6)).alias("p"))
    return pages.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.least(F.lit(1.0), F.count_distinct("p") / F.lit(30.0)).alias("coverage"))


@query("agg_term_freq", with_sql("derived", "").rstrip() + f", {HEADING_NAMES_SQL} SELECT 1::BIGINT AS size, name AS term, count(*) AS n FROM hn GROUP BY 1, 2 UNION ALL SELECT size, phrase, n FROM (" + NGRAMS_SQL.replace("TEXTS", "content").replace("ROWS", "derived") + ")")
def agg_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each heading (size 1), bigram and trigram stands in the chunks."""
    chunks = derived(spark, sf_dir)
    heads = topic_ops.heading_names(chunks).groupBy(F.col("name").alias("term")).agg(F.count("*").alias("n"))
    return heads.select(F.lit(1).cast("long").alias("size"), "term", "n").unionByName(topic_ops.phrase_counts(chunks).withColumnRenamed("phrase", "term"))


_CLUSTER_STOP = "[" + ", ".join(f"'{w}'" for w in topic_ops.CLUSTER_STOPWORDS) + "]"


@query("agg_tfidf", f"WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: NOT list_contains({_CLUSTER_STOP}, x))) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM f GROUP BY 1), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1) SELECT f.term, round(sum(tf * (tf / len::DOUBLE)) * ln((SELECT count(*) FROM documents) / any_value(df)::DOUBLE), 6) AS score FROM f JOIN l USING (doc_id) JOIN d USING (term) GROUP BY 1")
def agg_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every word over all documents."""
    return topic_ops.term_weights(spread(table(spark, sf_dir, "documents").select("text")))


@query("agg_page_spread", "SELECT line, count(DISTINCT source) AS pages FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1 HAVING count(DISTINCT source) >= 0.28 * (SELECT count(DISTINCT source) FROM documents)")
def agg_page_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on at least 28 % of the sources are boilerplate."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count_distinct("source").alias("n")).first()["n"]
    lines = docs.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count_distinct("source").alias("pages")).where(F.col("pages") >= 0.28 * n)


@query("agg_median_font", "SELECT l_orderkey AS doc_id, median(l_quantity) AS median_size FROM lineitem GROUP BY 1")
def agg_median_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.median("l_quantity").alias("median_size"))


@query("heading_layout", "SELECT l_orderkey AS doc_id, l_linenumber AS seq FROM (SELECT *, median(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_quantity >= 1.2 * m OR (l_returnflag = 'R' AND l_quantity >= 1.05 * m)")
def heading_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as layout spans: quantity is the size, a flag is bold."""
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), "l_quantity", "l_returnflag")
    medians = spans.groupBy("doc_id").agg(F.median("l_quantity").alias("m"))
    big = (F.col("l_quantity") >= 1.2 * F.col("m")) | ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 1.05 * F.col("m")))
    return spans.join(medians, "doc_id").where(big).select("doc_id", "seq")


@query("dedup_first", with_sql("outline", "SELECT doc_id, seq, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY seq) AS r FROM outline) WHERE r = 1"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id", F.lower("title")).orderBy("seq"))
    return outline(spark, sf_dir).withColumn("r", rank).where("r = 1").select("doc_id", "seq", "title")


_NEXT = "first_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query("win_next_start", with_sql("outline", f"SELECT doc_id, seq, page, CASE WHEN {_NEXT} IS NULL THEN 99 ELSE greatest({_NEXT} - 1, page) END AS end_page FROM outline"))
def win_next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    follows = F.first("page", ignorenulls=True).over(after)
    return outline(spark, sf_dir).withColumn("n", follows).select("doc_id", "seq", "page", F.when(F.col("n").isNull(), 99).otherwise(F.greatest(F.col("n") - 1, "page")).alias("end_page"))


@query("win_next_simple", with_sql("outline", "SELECT doc_id, seq, lead(page) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS end_page FROM outline"))
def win_next_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir).select("doc_id", "seq", (F.lead("page").over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("end_page"))


@query("win_last_at_level", with_sql("outline", "SELECT doc_id, seq, CASE level WHEN 1 THEN NULL WHEN 2 THEN max(CASE WHEN level = 1 THEN seq END) OVER w ELSE max(CASE WHEN level = 2 THEN seq END) OVER w END AS parent_seq FROM outline WINDOW w AS (PARTITION BY doc_id ORDER BY seq)"))
def win_last_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = Window.partitionBy("doc_id").orderBy("seq")
    last = lambda n: F.last(F.when(F.col("level") == n, F.col("seq")), ignorenulls=True).over(upto)
    rows = outline(spark, sf_dir).withColumns({"one": last(1), "two": last(2)})
    return rows.select("doc_id", "seq", F.when(F.col("level") == 2, F.col("one")).when(F.col("level") == 3, F.col("two")).alias("parent_seq"))


@query("win_last_parent", with_sql("outline", "SELECT doc_id, seq, CASE level WHEN 2 THEN ch WHEN 3 THEN max(CASE WHEN level = 2 THEN seq END) OVER (PARTITION BY doc_id, ch ORDER BY seq) END AS parent_seq FROM (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq) AS ch FROM outline)"))
def win_last_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new chapter resets the last section."""
    chapter = F.last(F.when(F.col("level") == 1, F.col("seq")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq"))
    section = F.last(F.when(F.col("level") == 2, F.col("seq")), ignorenulls=True).over(Window.partitionBy("doc_id", "ch").orderBy("seq"))
    rows = outline(spark, sf_dir).withColumn("ch", chapter).withColumn("sec", section)
    return rows.select("doc_id", "seq", F.when(F.col("level") == 2, F.col("ch")).when(F.col("level") == 3, F.col("sec")).alias("parent_seq"))


query("topic_hierarchy", with_sql("outline", "SELECT doc_id, seq, CASE level WHEN 2 THEN ch WHEN 3 THEN max(CASE WHEN level = 2 THEN seq END) OVER (PARTITION BY doc_id, ch ORDER BY seq) END AS parent_seq FROM (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq) AS ch FROM outline)"))(win_last_parent)


@query("win_position", with_sql("stems", f"SELECT set_id, question_id, row_number() OVER (PARTITION BY set_id ORDER BY {TYPE_ORD}, question_id) AS position FROM stems WHERE status = 'approved'"))
def win_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("set_id").orderBy(ordinal(F.col("type"), "question_type"), "question_id")
    return stems(spark, sf_dir).where("status = 'approved'").select("set_id", "question_id", F.row_number().over(order).alias("position"))


query("exam_assemble", with_sql("stems", f"SELECT set_id, question_id, row_number() OVER (PARTITION BY set_id ORDER BY {TYPE_ORD}, question_id) AS position FROM stems WHERE status = 'approved'"))(win_position)


@query("win_recompact", "SELECT l_orderkey AS exam_id, l_partkey AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS position FROM lineitem WHERE l_returnflag <> 'R'")
def win_recompact(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return left.select(F.col("l_orderkey").alias("exam_id"), F.col("l_partkey").alias("question_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("position"))


@query("win_next_position", "SELECT o_orderkey AS exam_id, coalesce(max(l_linenumber), 0) + 1 AS next_position FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def win_next_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("m"))
    return table(spark, sf_dir, "orders").join(last, "o_orderkey", "left").select(F.col("o_orderkey").alias("exam_id"), (F.coalesce("m", F.lit(0)) + 1).alias("next_position"))


@query("win_char_budget", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(least(n_chars, 220) + 3) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 5000")
def win_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are positive, so a running sum within the budget is the same as stopping at the first overflow."""
    used = F.sum(F.least("n_chars", F.lit(220)) + 3).over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", used.alias("used")).where("used <= 5000").select("source", "doc_id")


@query("win_latest_document", "SELECT source, max_by(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents GROUP BY 1")
def win_latest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("topk_topic", with_sql("topic_map", "SELECT topic_id, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, chunk_id) AS r FROM topic_map) WHERE r <= 10 AND (score IS NULL OR score >= 0.1)"))
def topk_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing score passes the least score and is reported as 0."""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc_nulls_last("score"), "chunk_id"))
    return topic_map(spark, sf_dir).withColumn("r", rank).where("r <= 10 AND (score is null OR score >= 0.1)").select("topic_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))


query("retrieve_by_topic", with_sql("topic_map", "SELECT topic_id, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, chunk_id) AS r FROM topic_map) WHERE r <= 10 AND (score IS NULL OR score >= 0.1)"))(topk_topic)
query("null_handling", with_sql("topic_map", "SELECT topic_id, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, chunk_id) AS r FROM topic_map) WHERE r <= 10 AND (score IS NULL OR score >= 0.1)"))(topk_topic)


@query("topk_keyphrase", " UNION ALL ".join(f"SELECT size, phrase, n, round(n * pow((length(phrase) - {k - 1}) / {k}::DOUBLE, 2), 6) AS score FROM (SELECT * FROM ({NGRAMS_SQL.replace('TEXTS', 'text').replace('ROWS', 'documents')}) WHERE size = {k} ORDER BY n DESC, phrase LIMIT {most})" for k, most in ((3, topic_ops.TRIGRAMS), (2, topic_ops.BIGRAMS))))
def topk_keyphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 most frequent trigrams and 80 bigrams, with their scores."""
    return topic_ops.top_phrases(spread(table(spark, sf_dir, "documents").select(F.col("text").alias("content"))))


query("keyphrase_score", "SELECT p_partkey, p_size * pow(length(p_name) / len(string_split(p_name, ' '))::DOUBLE, 2) AS score FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.pow(F.length("p_name") / F.size(F.split("p_name", " ")), F.lit(2.0))).alias("score"))
)


@query("topk_topics_cap", "SELECT course_id, seq, row_number() OVER (PARTITION BY course_id ORDER BY page, seq) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY confidence DESC, seq) AS r FROM (SELECT floor(p_partkey / 40)::BIGINT AS course_id, p_partkey AS seq, p_partkey % 97 AS confidence, CASE WHEN p_size % 9 = 0 THEN 999999 ELSE p_size END AS page FROM part)) WHERE r <= 25")
def topk_topics_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 topics of a course of most confidence, in the order of their pages; those without a page come last."""
    t = table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 40) AS bigint) AS course_id", "p_partkey AS seq", "p_partkey % 97 AS confidence", "CASE WHEN p_size % 9 = 0 THEN 999999 ELSE p_size END AS page")
    own = Window.partitionBy("course_id")
    kept = t.withColumn("r", F.row_number().over(own.orderBy(F.desc("confidence"), "seq"))).where("r <= 25")
    return kept.select("course_id", "seq", F.row_number().over(own.orderBy("page", "seq")).alias("rank"))


@query("sort_band_seeded", with_sql("topic_map", "SELECT topic_id, chunk_id, row_number() OVER (PARTITION BY topic_id ORDER BY round_even(coalesce(score, 0) * 20, 0) / 20 DESC, md5('7:' || chunk_id)) AS rank FROM topic_map"))
def sort_band_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in bands of a twentieth, half to even; ties in an order drawn from a seed."""
    order = Window.partitionBy("topic_id").orderBy(F.desc(F.bround(F.coalesce("score", F.lit(0.0)) * 20, 0) / 20), F.md5(F.concat(F.lit("7:"), F.col("chunk_id").cast("string"))))
    return topic_map(spark, sf_dir).select("topic_id", "chunk_id", F.row_number().over(order).alias("rank"))


@query("sort_fresh_first", with_sql("topic_map", "SELECT topic_id, chunk_id FROM (SELECT *, chunk_id % 3 = 0 AS stale, count_if(chunk_id % 3 <> 0) OVER (PARTITION BY topic_id) AS fresh, row_number() OVER (PARTITION BY topic_id ORDER BY chunk_id % 3 = 0, score DESC NULLS LAST, chunk_id) AS r FROM topic_map) WHERE r <= 20 AND NOT (stale AND fresh >= 20)"))
def sort_fresh_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalised chunks come last, and not at all if there are enough fresh ones."""
    own = Window.partitionBy("topic_id")
    stale = F.col("chunk_id") % 3 == 0
    ranked = topic_map(spark, sf_dir).withColumns({"stale": stale, "fresh": F.count_if(~stale).over(own), "r": F.row_number().over(own.orderBy(stale, F.desc_nulls_last("score"), "chunk_id"))})
    return ranked.where("r <= 20 AND NOT (stale AND fresh >= 20)").select("topic_id", "chunk_id")


@query("sort_kept_by_page", with_sql("outline", "SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(nullif(page, 0), 999999), title, seq) AS rank FROM outline"))
def sort_kept_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(F.nullif("page", F.lit(0)), F.lit(999999)), "title", "seq")
    return outline(spark, sf_dir).select("doc_id", "seq", F.row_number().over(order).alias("rank"))


@query("page_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@query("newest_first", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("rank"))


@query("name_order", with_sql("topics", "SELECT topic_id, name, row_number() OVER (PARTITION BY course_id ORDER BY name) AS rank FROM topics"))
def name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).select("topic_id", "name", F.row_number().over(Window.partitionBy("course_id").orderBy("name")).alias("rank"))


@query("shuffle_seeded", with_sql("stems", "SELECT set_id, question_id, row_number() OVER (PARTITION BY set_id ORDER BY md5('42:' || question_id)) AS rank FROM stems"))
def shuffle_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("set_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("question_id").cast("string"))))
    return stems(spark, sf_dir).select("set_id", "question_id", F.row_number().over(order).alias("rank"))


query("shuffle_unseeded", with_sql("stems", "SELECT set_id, question_id, row_number() OVER (PARTITION BY set_id ORDER BY md5('42:' || question_id)) AS rank FROM stems"))(shuffle_seeded)


@query("set_candidate_union", with_sql("topic_map", "SELECT topic_id, chunk_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, chunk_id ORDER BY stage, rank) AS r FROM (SELECT topic_id, chunk_id, 1 AS stage, chunk_id AS rank FROM topic_map UNION ALL SELECT topic_id, (chunk_id * 3) % 500, 2, chunk_id FROM topic_map)) WHERE r = 1"))
def set_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = topic_map(spark, sf_dir)
    both = m.select("topic_id", "chunk_id", F.lit(1).alias("stage"), F.col("chunk_id").alias("rank")).unionByName(m.select("topic_id", (F.col("chunk_id") * 3 % 500).alias("chunk_id"), F.lit(2).alias("stage"), F.col("chunk_id").alias("rank")))
    first = F.row_number().over(Window.partitionBy("topic_id", "chunk_id").orderBy("stage", "rank"))
    return both.withColumn("r", first).where("r = 1").select("topic_id", "chunk_id", "stage")


@query("set_exclude", with_sql("topic_map", "SELECT topic_id, chunk_id FROM topic_map WHERE chunk_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM documents WHERE lang = 'de')"))
def set_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    gone = d.where("source = 'src1'").select(F.col("doc_id").alias("chunk_id")).union(d.where("lang = 'de'").select("doc_id")).distinct()
    return topic_map(spark, sf_dir).join(gone, "chunk_id", "left_anti").select("topic_id", "chunk_id")


@query("list_filters", with_sql("stems", "SELECT question_id FROM stems WHERE type = 'mcq' AND difficulty = 'hard' AND status = 'approved'"))
def list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"type": "mcq", "difficulty": "hard", "status": "approved"}
    q = stems(spark, sf_dir)
    for column, value in wanted.items():
        q = q.where(F.col(column) == value)
    return q.select("question_id")


@query("bloom_filter", with_sql("stems", "SELECT question_id FROM stems WHERE bloom = 'apply'"))
def bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).where("bloom = 'apply'").select("question_id")


@query("noisy_suspect", with_sql("topics topic_map", "SELECT t.topic_id, count(m.chunk_id) / (SELECT greatest(1, count(*)) FROM documents)::DOUBLE < 0.01 OR (count(m.chunk_id) = 0 AND is_auto) AS suspect FROM topics t LEFT JOIN topic_map m ON m.topic_id = t.topic_id AND m.score > 0.9 GROUP BY 1, is_auto"))
def noisy_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic that covers less than a hundredth of all chunks, or none though it was found automatically."""
    total = float(max(1, table(spark, sf_dir, "documents").count()))
    counts = topic_map(spark, sf_dir).where("score > 0.9").groupBy("topic_id").agg(F.count("*").alias("n"))
    t = topics(spark, sf_dir).join(counts, "topic_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return t.select("topic_id", ((F.col("n") / total < 0.01) | ((F.col("n") == 0) & F.col("is_auto"))).alias("suspect"))


@query("min_context_gate", with_sql("stems topic_map", "SELECT question_id FROM stems WHERE set_id IN (SELECT topic_id FROM topic_map WHERE score > 0.5 GROUP BY 1 HAVING count(*) >= 3)"))
def min_context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    enough = topic_map(spark, sf_dir).where("score > 0.5").groupBy(F.col("topic_id").alias("set_id")).agg(F.count("*").alias("n")).where("n >= 3")
    return stems(spark, sf_dir).join(enough, "set_id", "left_semi").select("question_id")


@query("set_token_jaccard", with_sql("stems", "WITH t AS (SELECT question_id, list_distinct(list_filter(regexp_split_to_array(lower(stem), '[^\\pL\\pN_]+'), lambda x: length(x) >= 3)) AS a FROM stems), p AS (SELECT x.question_id, x.a, y.a AS b FROM t x JOIN t y ON y.question_id = x.question_id + 2) SELECT question_id, len(list_intersect(a, b)) AS both_n, len(list_distinct(list_concat(a, b))) AS any_n FROM p").replace(") WITH t AS", "), t AS"))
def set_token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.similarity import tokens

    t = stems(spark, sf_dir).select("question_id", tokens(F.col("stem")).alias("a"))
    p = t.join(t.select((F.col("question_id") - 2).alias("question_id"), F.col("a").alias("b")), "question_id")
    return p.select("question_id", F.size(F.array_intersect("a", "b")).alias("both_n"), F.size(F.array_union("a", "b")).alias("any_n"))


@query("set_key_equality", with_sql("stems options", "SELECT question_id, string_agg(label, '' ORDER BY label) = 'ABCD' AS keys_ok FROM options WHERE NOT (k = 3 AND question_id % 7 = 0) GROUP BY 1"))
def set_key_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = options(spark, sf_dir).where("NOT (k = 3 AND question_id % 7 = 0)").groupBy("question_id").agg(F.sort_array(F.collect_set("label")).alias("keys"))
    wanted = F.array(*map(F.lit, "ABCD"))
    return keys.select("question_id", ((F.size(F.array_except(wanted, "keys")) == 0) & (F.size(F.array_except("keys", wanted)) == 0)).alias("keys_ok"))
