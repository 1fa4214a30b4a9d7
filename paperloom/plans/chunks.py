"""Queries over sources, chunking, line classifiers, filters and chunk classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import cleaning, rules, similarity
from paperloom.operators import chunking
from paperloom.operators.generation import FACTS, is_fact
from paperloom.operators.headings import HEADING_REGEX
from paperloom.operators import topics as topic_ops
from paperloom.operators.topics import HEADING, STOPWORDS
from paperloom.plans.fixtures import derived, literal, outline, stems, strip, with_sql
from paperloom.registry import query, spread, table

SIZE, OVERLAP = 3000, 400
# pages: a document's paragraphs (lines) are its pages
_PAGES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number FROM documents"
_OFFSETS = f"SELECT doc_id, page_number, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM ({_PAGES})"
_PARTS = "string_split(regexp_replace(content, '([.!?])(\\s+)|(\\n\\n+)', '\\1' || chr(2) || '\\2\\3' || chr(2), 'g'), chr(2))"
_UNITS = f"""parts AS (SELECT doc_id, content, unnest({_PARTS}) AS part, unnest(range(len({_PARTS}))) AS k FROM derived),
placed AS (SELECT doc_id, part, k, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, pos, pos + length(part) AS stop FROM placed WHERE k % 2 = 0 AND regexp_matches(part, '\\S'))"""
_WALK = f"""walk AS (SELECT doc_id, 0::BIGINT AS i, 0::HUGEINT AS start, NULL::HUGEINT AS s, NULL::HUGEINT AS e FROM derived
UNION ALL SELECT w.doc_id, u.i, CASE WHEN u.stop - w.start > {SIZE} AND w.start < u.pos THEN greatest(w.start, u.pos - {OVERLAP}) ELSE w.start END,
CASE WHEN u.stop - w.start > {SIZE} AND w.start < u.pos THEN w.start END, CASE WHEN u.stop - w.start > {SIZE} AND w.start < u.pos THEN u.pos END
FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.i = w.i + 1),
spans AS (SELECT doc_id, s, e FROM walk WHERE s IS NOT NULL UNION ALL
SELECT w.doc_id, w.start, length(d.content) FROM walk w JOIN derived d ON d.doc_id = w.doc_id JOIN (SELECT doc_id, max(i) AS i FROM walk GROUP BY 1) m ON m.doc_id = w.doc_id AND m.i = w.i WHERE w.start < length(d.content))"""
_CHUNKED = with_sql("derived", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _UNITS + ", " + _WALK


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return split.select("doc_id", (F.col("k") + 1).alias("page_number"), "text")


@query("src_pdf_pages", _PAGES)
def src_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)


@query("src_page_offsets", f"SELECT doc_id, page_number, char_start, char_start + length(text) AS char_end FROM ({_OFFSETS})")
def src_page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_offsets(_pages(spark, sf_dir)).select("doc_id", "page_number", "char_start", "char_end")


@query("src_pages_to_text", "SELECT doc_id, text FROM documents")
def src_pages_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return _pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


@query("src_pdf_outline", with_sql("outline", "SELECT * FROM outline"))
def src_pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir)


@query("src_upload", "SELECT page_id, octet_length(encode(html)) AS size, sha256(html) AS sha, CASE WHEN page_id % 5 = 0 THEN 'suffix' WHEN octet_length(encode(html)) > 2000 THEN 'size' ELSE 'ok' END AS verdict FROM pages")
def src_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of uploads (suffix by page number, a size limit of 2000 here) with the reason of a rejection."""
    p = table(spark, sf_dir, "pages").withColumn("filename", F.when(F.col("page_id") % 5 == 0, "x.txt").otherwise("x.pdf"))
    verdict = F.when(~F.lower("filename").endswith(".pdf"), "suffix").when(F.octet_length("html") > 2000, "size").otherwise("ok")
    return p.select("page_id", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha"), verdict.alias("verdict"))


@query("src_table_scan", "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3'")
def src_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "source", "n_chars")


@query("split_sentences", with_sql("derived", "") .rstrip() + ", " + _UNITS + " SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("doc_id", F.size(chunking.sentences(F.col("content"))).alias("n_units"))


@query("build_chunks", _CHUNKED + " SELECT doc_id, s AS start, e AS stop FROM spans")
def build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = derived(spark, sf_dir).select("doc_id", F.explode(chunking.chunk_spans(F.col("content"), SIZE, OVERLAP)).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("hard_split", f"SELECT doc_id, s AS start, least(s + {SIZE}, n) AS stop FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(1, length(text) - {OVERLAP}), {SIZE - OVERLAP})) AS s FROM documents WHERE length(text) > 0)")
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.hard_split(F.length("text"), SIZE, OVERLAP)).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("chunk_document", _CHUNKED + f", c AS (SELECT spans.doc_id, row_number() OVER (PARTITION BY spans.doc_id ORDER BY s, e) - 1 AS chunk_index, s, e, {strip('substr(content, (s + 1)::BIGINT, (e - s)::BIGINT)')} AS t FROM spans JOIN derived USING (doc_id)) SELECT doc_id, chunk_index, s AS start_char, e AS end_char, sha256(t) AS content_sha FROM c WHERE t <> ''")
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(derived(spark, sf_dir).select("doc_id", "content"), "content", SIZE, OVERLAP)
    return chunks.select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("chunk_content", 256).alias("content_sha"))


@query("page_range", f"SELECT w.doc_id, w.chunk_index, min(p.page_number) AS page_start, max(p.page_number) AS page_end FROM (SELECT doc_id, s // {SIZE - OVERLAP} AS chunk_index, s, least(s + {SIZE}, n) AS e FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(1, length(text) - {OVERLAP}), {SIZE - OVERLAP})) AS s FROM documents)) w JOIN (SELECT *, char_start + length(text) AS char_end FROM ({_OFFSETS})) p ON p.doc_id = w.doc_id AND p.char_end > w.s AND p.char_start < w.e GROUP BY 1, 2")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.hard_split(F.length("text"), SIZE, OVERLAP)).alias("chunk_index", "s"))
    chunks = windows.select("doc_id", "chunk_index", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))
    return chunking.page_ranges(chunks, chunking.page_offsets(_pages(spark, sf_dir)))


@query("tokens_jaccard", "SELECT question_id, len(list_distinct(list_filter(regexp_split_to_array(lower(stem), '[^\\pL\\pN_]+'), lambda t: length(t) >= 3))) AS n_tokens FROM stems".join([with_sql("stems", ""), ""]))
def tokens_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", F.size(similarity.tokens(F.col("stem"))).alias("n_tokens"))


_STOP_SQL = "[" + ", ".join(map(literal, STOPWORDS)) + "]"


NGRAMS_SQL = " UNION ALL ".join(
    f"SELECT {n}::BIGINT AS size, array_to_string(g, ' ') AS phrase, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) AS g FROM (SELECT regexp_extract_all(lower(TEXTS), '[a-z]{{3,}}') AS w FROM ROWS)) WHERE NOT list_contains({_STOP_SQL}, g[1]) AND NOT list_contains({_STOP_SQL}, g[{n}]) GROUP BY 1, 2"
    for n in (2, 3)
)


@query("ngrams", NGRAMS_SQL.replace("TEXTS", "text").replace("ROWS", "documents"))
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two and of three words that no stop word opens or closes, over all texts."""
    return topic_ops.phrase_counts(spread(table(spark, sf_dir, "documents").select(F.col("text").alias("content"))))


_LINES = "l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS raw, unnest(range(len(string_split(content, chr(10))))) AS line_no FROM derived)"
_HEADING_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, {literal(p)}) THEN {literal(k)}" for p, k in zip(HEADING, ("keyword", "numbered", "caps", "title"))) + " END"


@query("heading_lines", with_sql("derived", "").rstrip() + ", " + _LINES + f" SELECT * FROM (SELECT doc_id, line_no, {_HEADING_SQL} AS kind FROM (SELECT doc_id, line_no, trim(raw) AS line FROM l) WHERE length(line) BETWEEN 3 AND 80 AND NOT regexp_matches(line, '[.,;]\\s*$')) WHERE kind IS NOT NULL")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "raw")).withColumn("line", cleaning.trim_blanks("raw"))
    kind = F.coalesce(*(F.when(F.col("line").rlike(p), k) for p, k in zip(HEADING, ("keyword", "numbered", "caps", "title"))))
    fits = F.length("line").between(3, 80) & ~F.col("line").rlike(r"[.,;]\s*$")
    return lines.where(fits).select("doc_id", "line_no", kind.alias("kind")).where("kind is not null")


_FACT_SQL = " OR ".join(f"regexp_matches(line, {literal(p)})" for p in FACTS)


@query("key_facts", with_sql("derived", "").rstrip() + ", " + _LINES + f" SELECT doc_id, line_no, substr(line, 1, 220) AS fact FROM (SELECT doc_id, line_no, {strip('raw')} AS line FROM l) WHERE length(line) >= 10 AND ({_FACT_SQL})")
def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "raw")).withColumn("line", cleaning.trim_space(F.col("raw")))
    return lines.where(is_fact(F.col("line"))).select("doc_id", "line_no", F.substring("line", 1, 220).alias("fact"))


def _sql_score(rule_list: list[tuple[str, str, int]], cap: int) -> str:
    return " + ".join(f"{w} * least({cap}, len(regexp_extract_all(content, {literal('(?im)' + p)})))" for _, p, w in rule_list)


_CLASS = f"SELECT doc_id, CASE WHEN a >= 5 THEN 'admin_assessment' WHEN r >= 5 THEN 'references_boilerplate' WHEN x >= 4 THEN 'exercise' ELSE 'instructional' END AS chunk_type, CASE WHEN a >= 5 THEN a WHEN r >= 5 THEN r WHEN x >= 4 THEN x ELSE 0 END AS score FROM (SELECT doc_id, {_sql_score(rules.ADMIN, 1)} AS a, {_sql_score(rules.REFERENCES, 2)} AS r, {_sql_score(rules.EXERCISE, 3)} AS x FROM derived)"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("doc_id", "course_id", rules.classify(F.col("content")).alias("c")).select("doc_id", "course_id", "c.*")


@query("classify_chunk", with_sql("derived", _CLASS))
def classify_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "chunk_type", "score")


@query("agg_type_distribution", with_sql("derived", f"SELECT chunk_type, count(*) AS n FROM ({_CLASS}) GROUP BY 1"))
def agg_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query("chunk_type_filter", with_sql("derived", f"SELECT doc_id FROM ({_CLASS}) WHERE chunk_type NOT IN ('admin_assessment', 'references_boilerplate')"))
def chunk_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where(~F.col("chunk_type").isin("admin_assessment", "references_boilerplate")).select("doc_id")


@query("unclassified", with_sql("derived", f"SELECT doc_id FROM ({_CLASS}) WHERE chunk_type = 'instructional' AND score = 0"))
def unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("chunk_type = 'instructional' AND score = 0").select("doc_id")


@query("backfill_classes", with_sql("derived", f"SELECT count(*) AS processed, count_if(chunk_type <> 'instructional') AS changed, count_if(chunk_type = 'instructional') AS skipped FROM ({_CLASS})"))
def backfill_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).agg(F.count("*").alias("processed"), F.count_if(F.col("chunk_type") != "instructional").alias("changed"), F.count_if(F.col("chunk_type") == "instructional").alias("skipped"))


_BARE = strip("content")
EXCLUDED_SQL = f"SELECT doc_id, course_id, chunk_index, content, regexp_matches(substr(b, 1, 300), {literal('(?im)' + rules.EXCLUDED_HEADING)}) OR (w < 80 AND c >= 4) OR c > 0.15 * w OR (n > 0 AND s > 0.40 * n) AS excluded FROM (SELECT *, len(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS w, len(regexp_extract_all(b, {literal(rules.CITATION)})) AS c, len(regexp_extract_all(b, {literal('(?i)' + rules.SEE_ALSO)})) AS s, len(list_filter(regexp_split_to_array(b, '[.!?]+'), lambda x: regexp_matches(x, '\\S'))) AS n FROM (SELECT *, {_BARE} AS b FROM derived))"


@query("is_excluded", with_sql("derived", f"SELECT doc_id, excluded FROM ({EXCLUDED_SQL})"))
def is_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("doc_id", rules.is_excluded(F.col("content")).alias("excluded"))


@query("agg_excluded_count", with_sql("derived", f"SELECT course_id, count_if(excluded) AS n FROM ({EXCLUDED_SQL}) GROUP BY 1"))
def agg_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).groupBy("course_id").agg(F.count_if(rules.is_excluded(F.col("content"))).alias("n"))


TRIVIAL_SQL = "regexp_matches(lower(trim(stem)), " + literal("|".join(rules.TRIVIAL)) + ")"


@query("is_trivial", with_sql("stems", f"SELECT question_id, {TRIVIAL_SQL} AS trivial FROM stems"))
def is_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", rules.is_trivial(F.col("stem")).alias("trivial"))


@query("reject_trivial", with_sql("stems", f"SELECT question_id, {TRIVIAL_SQL} AND difficulty <> 'easy' AND bloom <> 'remember' AS rejected FROM stems"))
def reject_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", rules.reject_trivial(F.col("stem"), F.col("difficulty"), F.col("bloom")).alias("rejected"))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(stem, {literal('(?i)' + pattern)}))"


DIFFICULTY_SQL = f"SELECT *, CASE WHEN sc > 2 THEN 'hard' WHEN sc > 0 THEN 'medium' ELSE 'easy' END AS level, CASE WHEN sc > 2 THEN least(0.5::DOUBLE + h * 0.08::DOUBLE, 0.75) WHEN sc > 0 THEN 0.55 ELSE least(0.5::DOUBLE + e * 0.08::DOUBLE, 0.70) END AS confidence FROM (SELECT *, 2.0 * h + m - e + 0.5 * (x // 2) - CASE WHEN w <= 8 THEN 1 ELSE 0 END AS sc FROM (SELECT *, least(4, {_n(rules.HARD)}) AS h, least(4, {_n(rules.MEDIUM)}) AS m, {_n(rules.EASY)} AS e, {_n(rules.COMPOUND)} AS x, len(list_filter(regexp_split_to_array(trim(stem), '\\s+'), lambda t: t <> '')) AS w FROM stems))"


@query("difficulty_heur", with_sql("stems", f"SELECT question_id, level, confidence FROM ({DIFFICULTY_SQL})"))
def difficulty_heur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", rules.difficulty(F.col("stem")).alias("d")).select("question_id", "d.*")


@query("tag_difficulty", with_sql("stems", f"SELECT question_id, CASE WHEN {TRIVIAL_SQL} THEN 'easy' ELSE level END AS level, CASE WHEN {TRIVIAL_SQL} AND level <> 'easy' THEN greatest(confidence, 0.55) ELSE confidence END AS confidence FROM ({DIFFICULTY_SQL})"))
def tag_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", rules.tag_difficulty(F.col("stem")).alias("d")).select("question_id", "d.*")


CLAUSE_SQL = "string_split(string_split(stem, '?')[1], '.')[1]"
BLOOM_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, {literal(f'(?i)\\b({v})\\b')}) THEN {literal(k)}" for k, v in rules.BLOOM.items()) + " ELSE 'remember' END"
VERB_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, {literal(f'(?i)\\b({v})\\b')}) THEN lower(regexp_extract(c, {literal(f'(?i)\\b({v})\\b')}, 1))" for v in rules.BLOOM.values()) + " END"


@query("bloom_heur", with_sql("stems", f"SELECT question_id, {BLOOM_SQL} AS level, {VERB_SQL} AS verb FROM (SELECT *, {CLAUSE_SQL} AS c FROM stems)"))
def bloom_heur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", rules.bloom(F.col("stem")).alias("b")).select("question_id", "b.level", "b.verb")


@query("tag_bloom", with_sql("stems", f"SELECT question_id, CASE WHEN {TRIVIAL_SQL} AND b NOT IN ('remember', 'understand') THEN 'understand' ELSE b END AS level FROM (SELECT *, {BLOOM_SQL} AS b FROM (SELECT *, {CLAUSE_SQL} AS c FROM stems))"))
def tag_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", rules.tag_bloom(F.col("stem")).alias("level"))


@query("bloom_for_difficulty", with_sql("stems", "SELECT question_id, CASE difficulty WHEN 'easy' THEN 'understand' WHEN 'medium' THEN 'apply' ELSE 'analyze' END AS bloom_default FROM stems"))
def bloom_for_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = F.create_map(*(F.lit(x) for x in ("easy", "understand", "medium", "apply", "hard", "analyze")))
    return stems(spark, sf_dir).select("question_id", default[F.col("difficulty")].alias("bloom_default"))


_TOC = f"length(regexp_replace(trim(p_name), '[^a-zA-Z]', '', 'g')) < 3 OR list_contains([{', '.join(map(literal, rules.TOC_NOISE))}], lower(trim(p_name))) OR " + " OR ".join(f"regexp_matches(trim(p_name), {literal(p)})" for p in rules.TOC_NOISE_PATTERNS)


def _noise(name: str, f, sql: str) -> None:  # noqa: ANN001
    """Part names, some of them replaced by noise, by key."""
    names = "CASE p_partkey % 9 WHEN 0 THEN 'Contents' WHEN 1 THEN 'Homework Problems' WHEN 2 THEN 'Page 7' WHEN 3 THEN 'Z N' WHEN 4 THEN 'Chapter 3' ELSE p_name END"

    @query(name, f"SELECT p_partkey, {sql} AS noise FROM (SELECT p_partkey, {names} AS p_name FROM part)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", F.expr(names).alias("p_name")).select("p_partkey", f(F.col("p_name")).alias("noise"))


_noise("noise_title_toc", rules.is_toc_noise, _TOC)
_noise("noise_topic_svc", rules.is_service_noise, _TOC + " OR " + " OR ".join(f"regexp_matches(trim(p_name), {literal(p)})" for p in rules.SERVICE_NOISE_PATTERNS))
_noise("noise_topic_pp", rules.is_topic_noise, f"list_contains([{', '.join(map(literal, rules.TOPIC_NOISE))}], trim(lower(p_name))) OR " + " OR ".join(f"regexp_matches(trim(lower(p_name)), {literal(p)})" for p in rules.TOPIC_NOISE_PATTERNS))


_TOC_PAGE = "string_split(text, chr(10))"


@query("toc_page_detect", "SELECT doc_id, n >= 3 AND (heads > 0 OR hits >= 0.4 * n) AS is_toc FROM (SELECT doc_id, count(*) AS n, count_if(k <= 5 AND regexp_matches(line, '(?i)^\\s*(table\\s+of\\s+)?contents?\\s*$|^\\s*list\\s+of\\s+chapters?\\s*$')) AS heads, count_if(regexp_matches(line, '[.\\s]{3,}\\d{1,4}\\s*$|[\\s.·*]+(\\d{1,4})\\s*$')) AS hits FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 'Contents' WHEN l_partkey % 2 = 0 THEN concat('Part ', l_partkey, ' is long') ELSE concat('Part ..... ', l_linenumber) END AS line FROM lineitem) GROUP BY 1)")
def toc_page_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are orders, and their lines come from the line items."""
    line = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0), F.lit("Contents")).when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" is long"))).otherwise(F.concat(F.lit("Part ..... "), F.col("l_linenumber").cast("string")))
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("k"), line.alias("line"))
    head = F.col("line").rlike(r"(?i)^\s*(table\s+of\s+)?contents?\s*$|^\s*list\s+of\s+chapters?\s*$") & (F.col("k") <= 5)
    hit = F.col("line").rlike(r"[.\s]{3,}\d{1,4}\s*$|[\s.·*]+(\d{1,4})\s*$")
    sums = ranked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(head).alias("heads"), F.count_if(hit).alias("hits"))
    return sums.select("doc_id", ((F.col("n") >= 3) & ((F.col("heads") > 0) | (F.col("hits") >= 0.4 * F.col("n")))).alias("is_toc"))


_PAGE_LINES = "SELECT page_id, k, line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(len(string_split(html, chr(10))))) AS k FROM pages)"


@query("toc_parse", "WITH l AS (SELECT doc_id, seq, concat(repeat(' ', (seq % 8)::BIGINT), CASE WHEN page IS NULL THEN '' ELSE '2.1 ' END, title, ' ..... ', seq) AS raw FROM outline) SELECT doc_id, seq, regexp_replace(regexp_replace(trim(raw), '^([\\d.]+\\.?\\s+)', ''), '[\\s.]{2,}\\d{1,4}\\s*$', '') AS title, seq AS page, CASE WHEN seq % 8 <= 2 THEN 'CHAPTER' WHEN seq % 8 <= 5 THEN 'SECTION' ELSE 'SUBSECTION' END AS level FROM l WHERE regexp_matches(trim(raw), '^([\\d.]+\\.?\\s+)?[A-Z][^\\n]{2,70}?([\\s.·]{2,}\\d{1,4})?\\s*$')".join([with_sql("outline", "").rstrip() + ", ", ""]).replace(", WITH l", ", l"))
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline rows written as indented lines with dotted leaders, and parsed back."""
    raw = F.concat(F.repeat(F.lit(" "), (F.col("seq") % 8).cast("int")), F.when(F.col("page").isNull(), "").otherwise("2.1 "), "title", F.lit(" ..... "), F.col("seq").cast("string"))
    lines = outline(spark, sf_dir).select("doc_id", "seq", raw.alias("raw")).withColumn("line", cleaning.trim_blanks("raw"))
    pattern = r"^(?:[\d.]+\.?\s+)?([A-Z][^\n]{2,70}?)(?:[\s.·]{2,}(\d{1,4}))?\s*$"
    indent = F.length("raw") - F.length(F.ltrim("raw"))
    level = F.when(indent <= 2, "CHAPTER").when(indent <= 5, "SECTION").otherwise("SUBSECTION")
    return lines.where(F.col("line").rlike(pattern)).select("doc_id", "seq", F.regexp_extract("line", pattern, 1).alias("title"), F.regexp_extract("line", pattern, 2).cast("int").alias("page"), level.alias("level"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim(raw), {literal(p)}) THEN {literal(k)}" for k, p in HEADING_REGEX.items()) + " END"


@query("heading_regex", with_sql("derived", "").rstrip() + ", " + _LINES + f" SELECT * FROM (SELECT doc_id, line_no, {_KIND} AS kind FROM l) WHERE kind IS NOT NULL")
def heading_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "raw"))
    kind = F.coalesce(*(F.when(cleaning.trim_blanks("raw").rlike(p), k) for k, p in HEADING_REGEX.items()))
    return lines.select("doc_id", "line_no", kind.alias("kind")).where("kind is not null")
