"""Post-processing of topics against a plain loop."""

import difflib
import random
import re
import unicodedata

import pytest

from paperloom.operators import topic_filter
from paperloom.plans.topics import topic_postprocess

NOISE = [re.compile(p, re.I) for p in topic_filter.NOISE_PATTERNS]
MINIMAL = re.compile(r"^[\W\d_]+$|^https?://|copyright|©", re.I)


def plain_title(title):
    title = re.sub(r"\s+\d{1,4}$", "", unicodedata.normalize("NFKC", title))
    title = re.sub(r"(?i)^(\d+(\.\d+)*|[IVXLC]+\.?)\s+", "", title).strip()
    title = re.sub(r"(?i)^slide\s*\d+\s*[:\-–]?\s*", "", title).strip()
    return re.sub(r"\s{2,}", " ", title).strip().strip(topic_filter.EDGES)


def plain_noise(title):
    low = title.lower().strip()
    return low in topic_filter.NOISE_TITLES or any(p.search(low) for p in NOISE)


def plain(entries):
    """The kept entries of a course (seq, title, confidence, page), in order."""

    def unlike(rows):
        kept = []
        for r in sorted(rows, key=lambda r: (-r[2], r[0])):
            if not any(difflib.SequenceMatcher(None, r[1].lower(), k[1].lower()).ratio() >= 0.82 for k in kept):
                kept.append(r)
        return sorted(kept, key=lambda r: (r[3] or 999999, r[1]))

    named = [(s, plain_title(t), c or 0.0, p) for s, t, c, p in entries if t is not None]
    named = [r for r in named if len(r[1]) >= 3]
    good = unlike([r for r in named if not plain_noise(r[1])])
    if good:
        most = sorted(good, key=lambda r: -r[2])[:25]
        return sorted(most, key=lambda r: (r[3] or 999999, r[1]))
    return unlike([r for r in named if not MINIMAL.search(r[1])])


def test_equal_to_a_plain_loop(spark):
    rng = random.Random(6)
    words = "graph graphs tree trees flow order orders theory cut cuts matching Übung été ﬁeld".split()
    noise = ["Chapter 7", "Summary", "12", "www.x.org", "(c) 1999", "§", "Table of Contents", "A1", "IV Sets", "Slide 3: Sets", "3.1 Sets and maps 44", "  Sets  and maps ", '"Sets!"', None, "", "数学", "part ii"]
    rows = []
    for course in range(14):
        for seq in range(70):
            title = rng.choice(noise) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
            if course == 5:
                title = rng.choice(["Summary", "12", "Index", "copyright 2001"])
            rows.append((course, seq, title, None if rng.random() < 0.05 else rng.choice([0.5, 0.7, 0.9]), rng.choice([None, 0, 1, 2, 3])))
    got = topic_filter.postprocess(spark.createDataFrame(rows, "course_id long, seq long, title string, confidence double, page long")).collect()
    for course in range(14):
        mine = [(r["title"], r["confidence"], r["page"]) for r in sorted((r for r in got if r["course_id"] == course), key=lambda r: r["rank"])]
        want = [(t, c, p) for _, t, c, p in plain([r[1:] for r in rows if r[0] == course])]
        assert sorted(map(str, mine)) == sorted(map(str, want)) and [m[0] for m in mine] == [w[0] for w in want], course
    assert {r["title"] for r in got if r["course_id"] == 5} == {"Summary", "Index"}  # the last resort: only noise, but it has letters


@pytest.mark.parametrize("title", ["1.2 Sets 45", "Slide 10 – Trees", "x  y", "“Sets”", "…(Sets)", "ﬁeld", "IV. Maps", "iv maps", "- - Sets - 3", "12", "(c) 2001", "a1"])
def test_titles(spark, title):
    row = spark.range(1).select(topic_filter.normalise(topic_filter.F.lit(title)).alias("t"), topic_filter.is_noise(topic_filter.F.lit(title)).alias("n")).first()
    assert tuple(row) == (plain_title(title), plain_noise(title))


def test_no_topics(spark):
    assert topic_filter.postprocess(spark.createDataFrame([], "course_id long, seq long, title string, confidence double, page long")).count() == 0


def test_every_branch_of_the_query_fires(spark, small):
    rows = topic_postprocess(spark, small).collect()
    courses = {r["course_id"]: sum(x["course_id"] == r["course_id"] for x in rows) for r in rows}
    assert max(courses.values()) <= 25 and {r["title"] for r in rows if r["course_id"] == 3} >= {"Summary", "Index"}
    assert not any(r["title"] in ("Summary", "References", "www.example.org") for r in rows if r["course_id"] != 3)
