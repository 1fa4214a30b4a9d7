"""Topics from the pages of documents: heading lines by pattern, headings by layout, and printed tables of contents.

Pages are rows (doc_id, page_number from 1, text), layout spans are rows (doc_id, page, seq, text, size, bold). Everything
is keyed by document, so documents run side by side, and only headings, not texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import notation, rules
from paperloom.functions.cleaning import trim_blanks
from paperloom.operators.topics import merge_headings
from paperloom.scratch import written

#: Heading lines by pattern, tried in this order.
HEADING_REGEX = {"numbered": r"^(\d+(?:\.\d+){0,3})\s{1,4}([A-Z][\pL\pN_ ,\-:()/'\"]+)$", "labelled": r"(?i)^(Chapter|Section|Part|Unit|Module|Topic|Lecture)\s+[\dIVX]+\s*[:\-–—.]?\s+(.+)$", "caps": r"^[A-Z0-9][A-Z0-9 ,:;\-/&()]{8,}$"}
#: Fixed value: lines in capitals that are no heading.
ADDRESS = r"(?i)https?://|^\d+$|www\."
#: Lines of a table of contents.
TOC_HEAD = r"(?i)^\s*(table\s+of\s+)?contents?\s*$|^\s*list\s+of\s+chapters?\s*$"
TOC_PAGED = r"[.\s]{3,}\d{1,4}\s*$|[\s.·*]+(\d{1,4})\s*$"
TOC_ENTRY = r"^(?:[\d.]+\.?\s+)?([A-Z][^\n]{2,70}?)(?:[\s.·]{2,}(\d{1,4}))?\s*$"
#: Shortest and longest heading, pages that are scanned, and pages that may hold a table of contents.
LENGTHS, MOST_PAGES, TOC_PAGES = (4, 120), 300, 20


def strip(text: Column) -> Column:
    """text without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def mark_boilerplate(headings: DataFrame, n_pages: DataFrame, share: float) -> DataFrame:
    """Add n_pages, and whether the title (in any case) heads at least that share of the document's pages.

    The headings are written first, as they are read twice: pages are looked through once.
    """
    headings, low = written(headings), F.lower("title")
    on = headings.groupBy("doc_id", low.alias("low")).agg(F.count_distinct("page").alias("on"))
    return headings.withColumn("low", low).join(on, ["doc_id", "low"]).join(n_pages, "doc_id").withColumn("boilerplate", F.col("on") / F.col("n_pages") >= share).drop("low", "on")


def _end_page(order: list[str]) -> Column:
    return F.lead("page").over(Window.partitionBy("doc_id").orderBy(*order)) - 1


def regex_headings(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """doc_id, page, line_no, kind, title, level, end_page, confidence of the lines that look like headings.

    A title on 28 % of a document's pages is a running header and no topic; the confidence rewards numbered and labelled
    headings.
    """
    scanned = pages.where(F.col("page_number") <= most_pages)
    n_pages = scanned.groupBy("doc_id").agg(F.count_distinct("page_number").alias("n_pages"))
    lines = scanned.select("doc_id", F.col("page_number").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumns({"line": strip(F.col("line")), "line_no": F.col("line_no").cast("long")}).where(F.length("line").between(*LENGTHS))
    kind = F.coalesce(*(F.when(F.col("line").rlike(p), k) for k, p in HEADING_REGEX.items()))
    hits = lines.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~((F.col("kind") == "caps") & F.col("line").rlike(ADDRESS)))
    part = lambda k: strip(F.regexp_extract("line", HEADING_REGEX[k], 2))
    dots = F.length(F.regexp_extract("line", r"^[\d.]+", 0)) - F.length(F.replace(F.regexp_extract("line", r"^[\d.]+", 0), F.lit(".")))
    runs = F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    caps = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, LENGTHS[1]))), "")
    numbered, labelled = F.col("kind") == "numbered", F.col("kind") == "labelled"
    title = F.when(numbered, part("numbered")).when(labelled, part("labelled")).otherwise(caps)
    level = F.when(labelled | (numbered & (dots == 0)), "CHAPTER").when(numbered & (dots == 1), "SECTION").when(numbered & (dots == 2), "SUBSECTION").otherwise("HEADING")
    kept = mark_boilerplate(hits.select("doc_id", "page", "line_no", "kind", title.alias("title"), level.alias("level")), n_pages, 0.28).where(~F.col("boilerplate"))
    own = Window.partitionBy("doc_id")
    share = lambda k: F.avg((F.col("kind") == k).cast("double")).over(own)
    confidence = F.least(F.lit(0.72), 0.30 + 0.20 * share("numbered") + 0.15 * share("labelled"))
    return kept.select("doc_id", "page", "line_no", "kind", "title", "level", _end_page(["page", "line_no", "title"]).alias("end_page"), F.round(confidence, 6).alias("confidence"))


def layout_headings(spans: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """doc_id, page, seq, title, level, end_page, confidence and overall (of the document) of large or bold spans.

    Spans at 1.2 times the median size (bold ones at 1.05) are headings; those on 30 % of the pages are boilerplate; what is
    left is merged within a page, and chapters have at least .9 of the largest size.
    """
    scanned = spans.where(F.col("page") <= most_pages)
    facts = written(scanned.groupBy("doc_id").agg(F.median(F.when(F.col("size") > 0, F.col("size"))).alias("median"), F.count_distinct("page").alias("n_pages")))
    named = scanned.withColumn("title", strip(F.col("text"))).where(F.length("title").between(*LENGTHS))
    big = (F.col("size") >= 1.2 * F.col("median")) | (F.col("bold") & (F.col("size") >= 1.05 * F.col("median")))
    found = named.join(facts.select("doc_id", "median"), "doc_id").where(big).select("doc_id", "page", "seq", "size", "title")
    marked = mark_boilerplate(found, facts.select("doc_id", "n_pages"), 0.30)
    clean_pages = marked.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.bool_or("boilerplate").alias("b"), F.first("n_pages").alias("n_pages"))
    sums = clean_pages.groupBy("doc_id").agg(F.sum("n").alias("n_spans"), F.count_if(~F.col("b")).alias("headed"), F.first("n_pages").alias("n_pages"))
    merged = merge_headings(marked.where(~F.col("boilerplate")).select("doc_id", "page", "seq", "size", F.col("title").alias("text")))
    own = Window.partitionBy("doc_id")
    rows = merged.withColumns({"largest": F.max("size").over(own), "n_topics": F.count("*").over(own), "end_page": _end_page(["page", "seq"])}).join(facts.select("doc_id", "median"), "doc_id").join(sums, "doc_id")
    level = F.when(F.col("size") >= 0.9 * F.col("largest"), "CHAPTER").when(F.col("size") >= 1.2 * F.col("median"), "SECTION").otherwise("HEADING")
    overall = F.least(F.lit(0.82), 0.35 + 0.35 * F.least(F.col("headed") / F.col("n_pages"), F.lit(1.0)) + 0.02 * F.least(F.col("n_topics"), F.lit(10)))
    confidence = F.least(F.lit(0.85), 0.50 + 0.005 * F.col("n_spans"))
    return rows.select("doc_id", "page", "seq", F.col("text").alias("title"), level.alias("level"), "end_page", F.round(confidence, 6).alias("confidence"), F.round(overall, 6).alias("overall"))


def contents_from_text(pages: DataFrame, most_pages: int = TOC_PAGES) -> DataFrame:
    """doc_id, page_number, line_no, title, level, page of the entries of the first page that is a table of contents.

    A page is one if a heading of it stands in its first five lines with text, or if 40 % of these lines end in a page number.
    Of titles that agree but for case and spaces the first stays.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    head = F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(TOC_HEAD))
    hits = F.size(F.filter(lines, lambda x: x.rlike(TOC_PAGED)))
    tocs = pages.where((F.col("page_number") <= most_pages) & (F.size(lines) >= 3) & (head | (hits >= 0.4 * F.size(lines))))
    raw = tocs.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumns({"line": strip(F.col("raw")), "line_no": F.col("line_no").cast("long")})
    found = strip(F.regexp_extract("line", TOC_ENTRY, 1))
    page = F.coalesce(F.nullif(F.regexp_extract("line", TOC_ENTRY, 2), F.lit("")).cast("int"), notation.toc_page(found))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    level = F.when(indent <= 2, "CHAPTER").when(indent <= 5, "SECTION").otherwise("SUBSECTION")
    entries = raw.where(F.col("line").rlike(TOC_ENTRY)).select("doc_id", "page_number", "line_no", notation.toc_title(found).alias("title"), level.alias("level"), page.alias("page"))
    entries = entries.where(~rules.is_toc_noise(F.col("title")) & (F.length("title") >= 3))
    first = entries.withColumn("first", F.min("page_number").over(Window.partitionBy("doc_id"))).where("page_number = first").drop("first")
    key = F.regexp_replace(F.lower(trim_blanks("title")), r"\s+", " ")
    rank = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("line_no"))
    return first.withColumn("rank", rank).where("rank = 1").drop("rank")


def contents(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, seq, title, page, origin: a document's outline (doc_id, seq, title, page), or its printed contents where it has none."""
    scanned = contents_from_text(pages).join(outline.select("doc_id").distinct(), "doc_id", "left_anti")
    listed = outline.select("doc_id", F.col("seq").cast("long").alias("seq"), "title", F.col("page").cast("long").alias("page"), F.lit("outline").alias("origin"))
    return listed.unionByName(scanned.select("doc_id", F.col("line_no").alias("seq"), "title", F.col("page").cast("long").alias("page"), F.lit("text").alias("origin")))
