"""Queries over topic extraction, selection and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import notation, rules
from paperloom.operators import extraction, headings
from paperloom.operators import topics as ops
from paperloom.operators.topic_filter import postprocess
from paperloom.plans.chunks import _TOC as TOC_NOISE_SQL
from paperloom.plans.fixtures import book_spans, books, derived, literal, outline, strip, topics, with_sql
from paperloom.registry import query, table

@query("agg_confidence", with_sql("outline", "SELECT doc_id, round(least(0.98, 0.60 + 0.04 * least(count_if(level = 1), 8) + 0.01 * least(count_if(level = 2), 20)), 6) AS confidence FROM outline GROUP BY 1"))
def agg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an outline, from its chapters and sections."""
    n = lambda level, most: F.least(F.count_if(F.col("level") == level), F.lit(most))
    return outline(spark, sf_dir).groupBy("doc_id").agg(F.round(F.least(F.lit(0.98), 0.60 + 0.04 * n(1, 8) + 0.01 * n(2, 20)), 6).alias("confidence"))


_NEXT = "first_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query("pdf_outline_topics", with_sql("outline", f"SELECT doc_id, seq, CASE level WHEN 1 THEN 'CHAPTER' WHEN 2 THEN 'SECTION' ELSE 'SUBSECTION' END AS level, page, CASE WHEN {_NEXT} IS NULL THEN 99 ELSE greatest({_NEXT} - 1, page) END AS end_page, 0.95 AS confidence FROM outline"))
def pdf_outline_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    follows = F.first("page", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    level = F.when(F.col("level") == 1, "CHAPTER").when(F.col("level") == 2, "SECTION").otherwise("SUBSECTION")
    rows = outline(spark, sf_dir).withColumn("n", follows)
    return rows.select("doc_id", "seq", level.alias("level"), "page", F.when(F.col("n").isNull(), 99).otherwise(F.greatest(F.col("n") - 1, "page")).alias("end_page"), F.lit(0.95).alias("confidence"))


_TITLE = """CASE p_partkey % 13 WHEN 0 THEN 'Chapter 7' WHEN 1 THEN concat('Slide 3: ', p_name, ' parts') WHEN 2 THEN concat('1.2  ', p_name, '  and  parts 45') WHEN 3 THEN concat('"', initcap(p_name), ' parts!"')
 WHEN 4 THEN 'References' WHEN 5 THEN 'www.example.org' ELSE concat(p_name, ' ', p_type, ' ', p_partkey % 5) END"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles of courses of 40; every seventh course has nothing but noise."""
    title = f"CASE WHEN floor(p_partkey / 40) % 7 = 3 THEN element_at(array('Summary', 'Table of Contents', 'Glossary', '12', 'Index'), cast(p_partkey % 5 + 1 as int)) ELSE {_TITLE} END AS title"
    return table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 40) AS bigint) AS course_id", "p_partkey AS seq", title, "(p_partkey % 97) / 100.0D AS confidence", "cast(p_size % 30 AS bigint) AS page")


@query("topic_postprocess")
def topic_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess(_extracted(spark, sf_dir)).select("course_id", "seq", "title", F.col("rank").cast("long").alias("rank"))


_SPANS = "SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq, size, text) AS i FROM (SELECT l_orderkey AS doc_id, (l_suppkey % 3)::BIGINT AS page, l_linenumber::BIGINT AS seq, l_quantity::DOUBLE AS size, l_partkey::VARCHAR AS text FROM lineitem)"


@query("heading_merge", f"""WITH RECURSIVE c AS ({_SPANS}),
w AS (SELECT doc_id, page, i, seq, size, text, i AS g FROM c WHERE i = 1 UNION ALL SELECT doc_id, page, i, CASE WHEN j THEN a ELSE seq END, CASE WHEN j THEN greatest(b, size) ELSE size END, CASE WHEN j THEN t || ' ' || text ELSE text END, CASE WHEN j THEN g ELSE i END FROM (SELECT c.*, w.seq AS a, w.size AS b, w.text AS t, w.g, abs(w.size - c.size) < 1.0 AS j FROM w JOIN c ON c.doc_id = w.doc_id AND c.page = w.page AND c.i = w.i + 1))
SELECT doc_id, page, seq, size, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, g ORDER BY i DESC) AS latest FROM w) WHERE latest = 1""")
def heading_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "cast(l_suppkey % 3 AS bigint) AS page", "cast(l_linenumber AS bigint) AS seq", "l_quantity AS size", "cast(l_partkey AS string) AS text")
    return ops.merge_headings(spans)


_LINE = strip("raw")
_MARKED = "SELECT h.*, p.n_pages, o.n_on / p.n_pages::DOUBLE >= {share} AS boilerplate FROM {hits} h JOIN (SELECT doc_id, count(DISTINCT page_number) AS n_pages FROM books GROUP BY 1) p USING (doc_id) JOIN (SELECT doc_id, lower(title) AS low, count(DISTINCT page) AS n_on FROM {hits} GROUP BY 1, 2) o ON o.doc_id = h.doc_id AND o.low = lower(h.title)"
_LAYOUT = f"""facts AS (SELECT doc_id, median(size) AS m FROM book_spans GROUP BY 1),
found AS (SELECT doc_id, page, seq, size, {strip('text')} AS title FROM book_spans JOIN facts USING (doc_id) WHERE length({strip('text')}) BETWEEN 4 AND 120 AND (size >= 1.2 * m OR (bold AND size >= 1.05 * m))),
marked AS ({_MARKED.format(share=0.30, hits='found')}),
sums AS (SELECT doc_id, sum(n) AS n_spans, count_if(NOT b) AS headed, max(n_pages) AS n_pages FROM (SELECT doc_id, page, count(*) AS n, bool_or(boilerplate) AS b, max(n_pages) AS n_pages FROM marked GROUP BY 1, 2) GROUP BY 1),
clean AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq, size, title) AS i FROM marked WHERE NOT boilerplate),
walk AS (SELECT doc_id, i, page, size, title, i AS g FROM clean WHERE i = 1 UNION ALL
SELECT c.doc_id, c.i, c.page, CASE WHEN j THEN greatest(w_size, c.size) ELSE c.size END, CASE WHEN j THEN w_title || ' ' || c.title ELSE c.title END, CASE WHEN j THEN g ELSE c.i END
FROM (SELECT c.*, w.size AS w_size, w.title AS w_title, w.g, w.page = c.page AND abs(w.size - c.size) < 1.0 AS j FROM walk w JOIN clean c ON c.doc_id = w.doc_id AND c.i = w.i + 1) c),
merged AS (SELECT w.doc_id, w.page, c.seq, w.size, w.title FROM walk w JOIN (SELECT doc_id, g, max(i) AS i FROM walk GROUP BY 1, 2) l USING (doc_id, g, i) JOIN clean c ON c.doc_id = w.doc_id AND c.i = w.g)
SELECT doc_id, page, seq, title, CASE WHEN size >= 0.9 * max(size) OVER own THEN 'CHAPTER' WHEN size >= 1.2 * m THEN 'SECTION' ELSE 'HEADING' END AS level, lead(page) OVER (PARTITION BY doc_id ORDER BY page, seq) - 1 AS end_page, round(least(0.85, 0.50 + 0.005 * n_spans), 6)::DOUBLE AS confidence,
round(least(0.82, 0.35 + 0.35 * least(headed / n_pages::DOUBLE, 1.0) + 0.02 * least(count(*) OVER own, 10)), 6) AS overall FROM merged JOIN facts USING (doc_id) JOIN sums USING (doc_id) WINDOW own AS (PARTITION BY doc_id)"""


@query("layout_topics", with_sql("books book_lines book_spans", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _LAYOUT)
def layout_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.layout_headings(book_spans(spark, sf_dir))


_HIT_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, {literal(p)}) THEN {literal(k)}" for k, p in headings.HEADING_REGEX.items()) + " END"
_REGEX = f"""l AS (SELECT doc_id, page, line_no, {_LINE} AS line FROM book_lines),
h AS (SELECT * FROM (SELECT *, {_HIT_KIND} AS kind FROM l WHERE length(line) BETWEEN 4 AND 120) WHERE kind IS NOT NULL AND NOT (kind = 'caps' AND regexp_matches(line, {literal(headings.ADDRESS)}))),
t AS (SELECT doc_id, page, line_no, kind, CASE kind WHEN 'numbered' THEN {strip(f"regexp_extract(line, {literal(headings.HEADING_REGEX['numbered'])}, 2)")} WHEN 'labelled' THEN {strip(f"regexp_extract(line, {literal(headings.HEADING_REGEX['labelled'])}, 2)")}
ELSE array_to_string(list_transform(regexp_extract_all(lower(line), '[a-z]+|[^a-z]+'), lambda r: concat(upper(r[1]), r[2:])), '') END AS title,
CASE WHEN kind = 'labelled' THEN 'CHAPTER' WHEN kind = 'caps' THEN 'HEADING' ELSE coalesce(['CHAPTER', 'SECTION', 'SUBSECTION'][1 + len(string_split(regexp_extract(line, '^[0-9.]+'), '.')) - 1], 'HEADING') END AS level FROM h),
kept AS (SELECT * FROM ({_MARKED.format(share=0.28, hits='t')}) WHERE NOT boilerplate)
SELECT doc_id, page, line_no, kind, title, level, lead(page) OVER (PARTITION BY doc_id ORDER BY page, line_no, title) - 1 AS end_page, round(least(0.72, 0.30 + 0.20 * avg(CASE WHEN kind = 'numbered' THEN 1.0 ELSE 0.0 END) OVER own + 0.15 * avg(CASE WHEN kind = 'labelled' THEN 1.0 ELSE 0.0 END) OVER own), 6) AS confidence FROM kept WINDOW own AS (PARTITION BY doc_id)"""


@query("regex_topics", with_sql("books book_lines", "").rstrip() + ", " + _REGEX)
def regex_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.regex_headings(books(spark, sf_dir))


_ENTRY, _SUFFIX = literal(headings.TOC_ENTRY), literal(notation.PAGE_SUFFIX)
_TOC_TITLE = f"regexp_replace(trim(regexp_replace(trim(regexp_replace(raw_title, {_SUFFIX}, '')), '[.\\s]{{2,}}$', '')), '\\s{{2,}}', ' ', 'g')"
_CONTENTS = f"""l AS (SELECT doc_id, page AS page_number, line_no, raw, {_LINE} AS line FROM book_lines),
f AS (SELECT doc_id, page_number, count(*) >= 3 AND (bool_or(k <= 5 AND regexp_matches(line, {literal(headings.TOC_HEAD)})) OR count_if(regexp_matches(line, {literal(headings.TOC_PAGED)})) >= 0.4 * count(*)) AS toc
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS k FROM l WHERE line <> '') GROUP BY 1, 2),
e AS (SELECT doc_id, page_number, line_no, length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS indent, {strip(f"regexp_extract(line, {_ENTRY}, 1)")} AS raw_title, TRY_CAST(nullif(regexp_extract(line, {_ENTRY}, 2), '') AS INTEGER) AS told
FROM l JOIN f USING (doc_id, page_number) WHERE toc AND page_number <= 20 AND regexp_matches(line, {_ENTRY})),
n AS (SELECT doc_id, page_number, line_no, {_TOC_TITLE} AS title, CASE WHEN indent <= 2 THEN 'CHAPTER' WHEN indent <= 5 THEN 'SECTION' ELSE 'SUBSECTION' END AS level, coalesce(told, TRY_CAST(nullif(regexp_extract(raw_title, {_SUFFIX}, 1), '') AS INTEGER)) AS page FROM e),
scanned AS (SELECT doc_id, page_number, line_no, title, level, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(trim(title)), '\\s+', ' ', 'g') ORDER BY line_no) AS r
FROM (SELECT *, min(page_number) OVER (PARTITION BY doc_id) AS first FROM n WHERE NOT ({TOC_NOISE_SQL.replace('p_name', 'title')}) AND length(title) >= 3) WHERE page_number = first) WHERE r = 1)"""


@query("toc_from_text", with_sql("books book_lines", "").rstrip() + ", " + _CONTENTS + " SELECT * FROM scanned")
def toc_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.contents_from_text(books(spark, sf_dir))


@query("toc_union", with_sql("books book_lines outline", "").rstrip() + ", " + _CONTENTS + " SELECT doc_id, seq, title, page, 'outline' AS origin FROM outline WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, line_no, title, page, 'text' FROM scanned WHERE doc_id NOT IN (SELECT doc_id FROM outline WHERE doc_id % 3 <> 0)")
def toc_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three documents have an outline; the books among the others are scanned."""
    return headings.contents(outline(spark, sf_dir).where("doc_id % 3 <> 0"), books(spark, sf_dir))


_OUTLINE_TITLE = "concat(CASE seq % 3 WHEN 0 THEN 'Chapter 3: ' WHEN 1 THEN '1.2  ' ELSE '' END, 'Theory ', chr(cast(64 + seq as int)), ' of ', title)"


def library(spark: SparkSession, sf_dir: str) -> extraction.Books:
    """The books as extractors read them: two of three have an outline, and each page is a chunk."""
    pages = books(spark, sf_dir)
    entries = outline(spark, sf_dir).where("doc_id % 3 <> 0").join(pages.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("title", F.expr(_OUTLINE_TITLE))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    chunks = pages.select("doc_id", (F.col("doc_id") * 20 + F.col("page_number") - 1).alias("chunk_id"), F.col("page_number").alias("page"), "text").join(vectors, "chunk_id", "left")
    return extraction.Books(entries, pages, book_spans(spark, sf_dir), chunks.select("doc_id", "chunk_id", "page", "vec", "text"))


def _selection(spark: SparkSession, sf_dir: str) -> extraction.Selection:
    return extraction.select_topics(library(spark, sf_dir), extraction.all_extractors()[:3])


_ENTRY_TITLE = f"regexp_replace({strip(f'regexp_replace(raw, {literal(extraction.PREFIX)}, {literal(str())})')}, '\\s{{2,}}', ' ', 'g')"
_N = "least(count_if(level = '{0}') OVER own, {1})"
# all extractors run on all books here, and what would not have been tried is left out by its place
_EXTRACTED = f"""tot AS (SELECT doc_id, max(page_number) AS total FROM books GROUP BY 1),
ent AS (SELECT doc_id, seq, level AS depth, trim({_OUTLINE_TITLE}) AS raw, CASE WHEN page > 0 THEN page END AS first, total FROM outline JOIN tot USING (doc_id) WHERE doc_id % 3 <> 0),
nxt AS (SELECT *, first_value(first IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM ent),
ttl AS (SELECT doc_id, seq, {_ENTRY_TITLE} AS title, CASE WHEN depth = 1 AND regexp_matches(raw, '(?i)^part\\b') THEN 'PART' WHEN depth = 1 THEN 'CHAPTER' WHEN depth = 2 THEN 'SECTION' ELSE 'SUBSECTION' END AS level, first, CASE WHEN nx IS NOT NULL THEN greatest(nx - 1, coalesce(first, 1)) ELSE nullif(total, 0) END AS last FROM nxt),
found AS (SELECT doc_id, 0 AS place, 'PDF_OUTLINE' AS method, first, last, round(least(0.98, 0.60 + 0.04 * {_N.format('CHAPTER', 8)} + 0.01 * {_N.format('SECTION', 20)}), 6)::DOUBLE AS conf FROM ttl WHERE length(title) >= 3 WINDOW own AS (PARTITION BY doc_id)
UNION ALL SELECT doc_id, 1, 'LAYOUT_HEADINGS', page, end_page, overall::DOUBLE FROM (WITH RECURSIVE {_LAYOUT})
UNION ALL SELECT doc_id, 2, 'REGEX_HEADINGS', page, end_page, confidence::DOUBLE FROM (WITH {_REGEX})),
cvd AS (SELECT doc_id, place, count(*) AS covered FROM (SELECT DISTINCT doc_id, place, unnest(range(first::BIGINT, coalesce(last, first)::BIGINT + 1)) AS page FROM found) GROUP BY 1, 2),
res AS (SELECT doc_id, place, method, count(*) AS n, max(conf) AS conf, round(least(1.0, CASE WHEN max(total) = 0 THEN 1.0 WHEN count(first) = 0 THEN count(*) / greatest(1.0, max(total) / 10.0) ELSE coalesce(max(covered), 0) / max(total)::DOUBLE END), 6)::DOUBLE AS cov FROM found JOIN tot USING (doc_id) LEFT JOIN cvd USING (doc_id, place) GROUP BY 1, 2, 3),
scd AS (SELECT *, n BETWEEN 3 AND 50 AND cov >= 0.2 AS sane, round(conf * CASE WHEN n BETWEEN 3 AND 50 AND cov >= 0.2 THEN 1.3 WHEN n BETWEEN 3 AND 50 THEN 1.0 ELSE 0.7 END + least(1.0, n / 20.0) * 0.1, 6)::DOUBLE AS score FROM res),
tried AS (SELECT * FROM scd a WHERE NOT EXISTS (SELECT 1 FROM scd b WHERE b.doc_id = a.doc_id AND b.place < a.place AND b.sane AND b.conf >= 0.75))"""


def _extracted_sql(body: str) -> str:
    return with_sql("books book_lines book_spans outline", "").rstrip() + f", {_EXTRACTED} {body}"


@query("extractor_score", _extracted_sql("SELECT doc_id, method, n, conf, cov, score FROM tried"))
def extractor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the extractors that were tried on a book: those after a first one that is sane and sure are not."""
    return _selection(spark, sf_dir).tried.select("doc_id", "method", "n", "conf", "cov", "score")


@query("topic_select", _extracted_sql("SELECT doc_id, method FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM tried) WHERE r = 1"))
def topic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best extractor of each book."""
    return _selection(spark, sf_dir).chosen.select("doc_id", "method")


@query("low_confidence_flag", _extracted_sql("SELECT doc_id, method, (conf < 0.45 OR (NOT sane AND cov < 0.2)) AND NOT (conf >= 0.75 AND sane) AS low FROM tried"))
def low_confidence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = extraction.is_low(F.col("conf"), F.col("sane"), F.col("cov"))
    return _selection(spark, sf_dir).tried.select("doc_id", "method", low.alias("low"))


def _extraction(spark: SparkSession, sf_dir: str) -> extraction.Extraction:
    return extraction.extract_topics(library(spark, sf_dir), extraction.all_extractors())


@query("topic_orchestrate")
def topic_orchestrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of every book by whichever extractor wins, clean, in a tree, with their coverage."""
    return _extraction(spark, sf_dir).topics


@query("topic_extraction_meta")
def topic_extraction_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a book's topics came about, and whether they deserve a warning."""
    return _extraction(spark, sf_dir).meta


@query("topic_reextract", with_sql("topics", "SELECT topic_id, name, 'MANUAL' AS source FROM topics WHERE NOT is_auto UNION ALL SELECT 1000 + r_regionkey, r_name, 'AUTO' FROM region"))
def topic_reextract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual topics stay, automatic ones are replaced."""
    manual = topics(spark, sf_dir).where("NOT is_auto").select("topic_id", "name", F.lit("MANUAL").alias("source"))
    return manual.unionByName(table(spark, sf_dir, "region").select((1000 + F.col("r_regionkey")).cast("long").alias("topic_id"), F.col("r_name").alias("name"), F.lit("AUTO").alias("source")))


@query("topic_crud", with_sql("topics", "SELECT topic_id, CASE WHEN topic_id = 3 THEN 'Renamed' ELSE name END AS name FROM topics WHERE topic_id <> 7 UNION ALL SELECT 99, 'New'"))
def topic_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic renamed, one deleted, one created."""
    t = topics(spark, sf_dir).where("topic_id <> 7").select("topic_id", F.when(F.col("topic_id") == 3, "Renamed").otherwise(F.col("name")).alias("name"))
    return t.unionByName(spark.range(99, 100).select(F.col("id").alias("topic_id"), F.lit("New").alias("name")))


@query("topic_tree_view", with_sql("topics", "SELECT t.topic_id, repeat('  ', CASE WHEN t.parent_id IS NULL THEN 0 ELSE 1 END) || t.name AS line, coalesce(p.name, t.name) AS top FROM topics t LEFT JOIN topics p ON p.topic_id = t.parent_id"))
def topic_tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topics(spark, sf_dir)
    parents = t.select(F.col("topic_id").alias("parent_id"), F.col("name").alias("parent_name"))
    depth = F.when(F.col("parent_id").isNull(), "").otherwise("  ")
    return t.join(parents, "parent_id", "left").select("topic_id", F.concat(depth, "name").alias("line"), F.coalesce("parent_name", "name").alias("top"))


_SERVICE_NOISE = (TOC_NOISE_SQL + " OR " + " OR ".join(f"regexp_matches(trim(p_name), {literal(p)})" for p in rules.SERVICE_NOISE_PATTERNS)).replace("p_name", "name")
_STOP = "[" + ", ".join(map(literal, ops.STOPWORDS)) + "]"
_HEAD_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, {literal(p)}) THEN {literal(k)}" for p, k in zip(ops.HEADING, ("keyword", "numbered", "caps", "title"))) + " END"
_BARE = "trim(regexp_replace({x}, '^[\\d.\\-–•*]+\\s*', ''))"


def _titled(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(regexp_replace({_BARE.format(x=x)}, '\\s+', ' ', 'g'), '\\pL+|\\PL+'), lambda r: concat(upper(r[1]), lower(r[2:]))), '')"


def _top(n: int, most: int) -> str:
    return f"""SELECT row_number() OVER (ORDER BY n DESC, g) AS r, {_titled('g')} AS name, round(n * pow((length(g) - {n - 1}) / {n}.0::DOUBLE, 2), 6) AS score FROM
(SELECT array_to_string(g, ' ') AS g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) AS g FROM t) WHERE NOT list_contains({_STOP}, g[1]) AND NOT list_contains({_STOP}, g[{n}]) GROUP BY 1 ORDER BY n DESC, g LIMIT {most})"""


HEADING_NAMES_SQL = f"""l AS (SELECT {strip('raw')} AS line FROM (SELECT unnest(string_split(content, chr(10))) AS raw FROM derived)),
k AS (SELECT line, {_HEAD_KIND} AS kind, trim(regexp_extract(line, '[:\\-–]\\s*(.+)$', 1)) AS sub, {_BARE.format(x='line')} AS bare FROM l WHERE length(line) BETWEEN 3 AND 80 AND NOT regexp_matches(line, '[.,;]\\s*$')),
c AS (SELECT CASE kind WHEN 'keyword' THEN CASE WHEN NOT regexp_matches(line, '(?i)^({notation.STRUCTURAL})\\s*[\\d.\\-–]*\\s*$') AND length(sub) >= 3 THEN sub END WHEN 'numbered' THEN CASE WHEN length(bare) >= 3 THEN bare END ELSE line END AS x FROM k WHERE kind IS NOT NULL),
hn AS (SELECT name FROM (SELECT {_titled('x')} AS name FROM c WHERE x IS NOT NULL) WHERE length(name) >= 3 AND NOT ({_SERVICE_NOISE}))"""
_NAMES = f"""{HEADING_NAMES_SQL},
heads AS (SELECT row_number() OVER (ORDER BY n DESC, name) AS r, name FROM (SELECT name, count(*) AS n FROM hn GROUP BY 1 ORDER BY n DESC, name LIMIT 25)),
t AS (SELECT regexp_extract_all(lower(content), '[a-z]{{3,}}') AS w FROM derived),
tri AS (SELECT * FROM ({_top(3, ops.TRIGRAMS)}) WHERE NOT ({_SERVICE_NOISE})),
bi AS (SELECT * FROM ({_top(2, ops.BIGRAMS)}) WHERE NOT ({_SERVICE_NOISE})),
free AS (SELECT name, score FROM tri UNION ALL SELECT name, score FROM bi b WHERE NOT EXISTS (SELECT 1 FROM tri WHERE contains(lower(tri.name), lower(b.name))) AND NOT EXISTS (SELECT 1 FROM bi o WHERE o.r < b.r AND contains(lower(o.name), lower(b.name)))),
put AS (SELECT r, name FROM heads UNION ALL SELECT 1000 + row_number() OVER (ORDER BY score DESC, name), name FROM free WHERE name NOT IN (SELECT name FROM heads)),
names AS (SELECT row_number() OVER (ORDER BY r) AS r, name FROM put ORDER BY r LIMIT 50)
SELECT cast(row_number() OVER (ORDER BY r) AS INTEGER) AS rank, name FROM names a WHERE NOT EXISTS (SELECT 1 FROM names b WHERE lower(b.name) <> lower(a.name) AND contains(lower(b.name), lower(a.name))) AND NOT EXISTS (SELECT 1 FROM names b WHERE b.r < a.r AND lower(b.name) = lower(a.name)) ORDER BY r LIMIT 25"""


@query("topic_names_v1", with_sql("derived", "").rstrip() + ", " + _NAMES)
def topic_names_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.topic_names(derived(spark, sf_dir))
