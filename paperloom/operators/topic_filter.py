"""What becomes of extracted titles: normalised, without noise and near copies, capped, and never none where there were some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.cleaning import nfkc, trim_space
from paperloom.functions.similarity import character_set, matching_ratio
from paperloom.operators.generation import greedy_duplicates
from paperloom.operators.token_pairs import common_tokens
from paperloom.operators.topics import MOST_TOPICS
from paperloom.scratch import written

#: Ratio from which titles are near copies; shortest title; page that stands for none in the order.
NEAR_RATIO, SHORTEST, NO_PAGE = 0.82, 3, 999_999

#: What is cut off a title, in this order.
TRAILING_PAGE, LEADING_NUMBER, SLIDE_PREFIX = r"(?U)\s+\d{1,4}$", r"(?iU)^(\d+(\.\d+)*|[IVXLC]+\.?)\s+", r"(?iU)^slide\s*\d+\s*[:\-–]?\s*"
EDGES = ".-–—:;,!?\"'()[]{}"
#: Titles that are noise.
NOISE_TITLES = [
    "introduction", "conclusions", "summary", "preface",
    "acknowledgements", "acknowledgments", "contents", "table of contents",
    "bibliography", "references", "index", "appendix", "glossary",
    "list of figures", "list of tables", "abstract", "foreword",
    "further reading", "answers", "solutions", "footnotes",
    "copyright", "license", "all rights reserved",
    "page", "slide", "figure", "table", "equation",
]
#: Patterns of noise, on lower case.
NOISE_PATTERNS = [
    r"^ch(apter)?\s*\d+\s*$",
    r"^section\s*\d+(\.\d+)*\s*$",
    r"^part\s+(i{1,3}v?|vi{0,3}|\d+)\s*$",
    r"^\d+(\.\d+)*\s*$",
    r"^[^a-z]{0,2}[a-z]?[^a-z]{0,2}$",
    r"^[\W_]+$",
    r"^\d{1,4}\s*$",
    r"^https?://",
    r"^www\.",
    r"^slide\s*\d+",
    r"^page\s*\d+",
    r"copyright|©|\(c\)\s*\d{4}",
]
#: Fixed value: what not even the last resort keeps.
MINIMAL_BAD = r"(?iU)^[\W\d_]+$|^https?://|copyright|©"


def normalise(title: Column) -> Column:
    title = F.regexp_replace(nfkc(title), TRAILING_PAGE, "")
    title = trim_space(F.regexp_replace(title, LEADING_NUMBER, ""))
    title = trim_space(F.regexp_replace(title, SLIDE_PREFIX, ""))
    title = trim_space(F.regexp_replace(title, r"(?U)\s{2,}", " "))
    return F.btrim(title, F.lit(EDGES))


def is_noise(title: Column) -> Column:
    low = trim_space(F.lower(title))
    hit = low.isin(NOISE_TITLES)
    for pattern in NOISE_PATTERNS:
        hit = hit | low.rlike(f"(?U){pattern}")
    return hit


def without_near_copies(topics: DataFrame) -> DataFrame:
    """topics (course_id, seq, title, confidence, ...) without those that are too like an accepted one of more confidence.

    The matching ratio is at most twice the common character counts over both lengths, which products of small blocks of a
    course's titles give; only pairs that reach it are matched. Who is accepted is settled in rounds, over all courses.
    """
    named = topics.select(F.col("seq").cast("long").alias("id"), F.col("course_id").alias("scope"), character_set(F.lower("title")).alias("t"))
    able = common_tokens(written(named), NEAR_RATIO - 1e-9).select(F.col("scope").alias("course_id"), "a", "b")
    side = lambda n: topics.select("course_id", F.col("seq").cast("long").alias(n), F.struct((-F.col("confidence")).alias("c"), "seq").alias(f"{n}_place"), F.col("title").alias(f"{n}_title"))
    both = able.join(side("a"), ["course_id", "a"]).join(side("b"), ["course_id", "b"]).withColumns({n: F.struct("course_id", F.col(n).alias("seq")) for n in ("a", "b")})
    in_order = F.col("a_place") < F.col("b_place")
    first = lambda x, y: F.when(in_order, F.col(x)).otherwise(F.col(y))
    turned = both.select(first("a", "b").alias("a"), first("b", "a").alias("b"), first("a_title", "b_title").alias("held"), first("b_title", "a_title").alias("new"))
    copies = greedy_duplicates(turned.where(matching_ratio(F.col("new"), F.col("held")) >= NEAR_RATIO).select("a", "b"))
    return topics.join(copies.select("id.course_id", "id.seq"), ["course_id", "seq"], "left_anti")


def postprocess(topics: DataFrame, most: int = MOST_TOPICS) -> DataFrame:
    """The kept topics (course_id, seq, title, confidence, page, and what else they have) with the title normalised, and rank.

    A course keeps its ``most`` most confident topics, in the order of pages and titles. Where noise leaves none, all titles
    that have letters stay, uncapped. seq tells a course's topics apart; a null confidence counts as 0.
    """
    named = topics.withColumns({"title": normalise(F.col("title")), "confidence": F.coalesce("confidence", F.lit(0.0))}).where(F.length("title") >= SHORTEST)
    named = written(named.withColumns({"_good": ~is_noise(F.col("title")), "_able": ~F.col("title").rlike(MINIMAL_BAD)}))
    good = named.where("_good").select("course_id").distinct()
    rest = named.where("_able").join(good, "course_id", "left_anti")
    open_ = named.where("_good").unionByName(rest)
    kept = written(without_near_copies(open_))
    page = F.when(F.coalesce("page", F.lit(0)) == 0, NO_PAGE).otherwise(F.col("page"))
    sure = F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("confidence"), page, "title", "seq"))
    capped = kept.withColumn("_place", sure).where(~F.col("_good") | (F.col("_place") <= most))
    rank = F.row_number().over(Window.partitionBy("course_id").orderBy(page, "title", F.desc("confidence"), "seq"))
    return capped.withColumn("rank", rank).drop("_good", "_able", "_place")
