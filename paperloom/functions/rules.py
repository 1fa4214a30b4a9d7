"""Rule tables and the columns that score them: chunk classes, exclusion, triviality, difficulty, cognitive level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.cleaning import trim_blanks

#: Rules of administrative text (name, pattern, weight), each counted once.
ADMIN = [
    ("phrase:internal_assessment", r"\binternal\s+assessment\b", 3),
    ("phrase:external_assessment", r"\bexternal\s+assessment\b", 3),
    ("phrase:assessment_criteria", r"\bassessment\s+criteria\b", 3),
    ("phrase:mark_allocation", r"\bmark\s+allocation\b", 3),
    ("phrase:weighting", r"\bweighting\b", 2),
    ("phrase:final_assessment", r"\bfinal\s+assessment\b", 3),
    ("phrase:assessment_objective", r"\bassessment\s+objective", 2),
    ("struct:paper_1_2", r"\bpaper\s+[12]\b", 2),
    ("struct:section_A_B", r"\bsection\s+[abc]\b", 1),
    ("struct:duration", r"\bduration\b", 2),
    ("struct:worth_N_marks", r"\bworth\s+\d+\s+marks?\b", 3),
    ("struct:compulsory", r"\bcompulsory\b", 2),
    ("struct:prescribed_by", r"\bprescribed\s+by\b", 2),
    ("struct:syllabus_aims", r"\bsyllabus\s+aims?\b", 2),
    ("struct:learning_outcomes", r"\blearning\s+outcomes?\b", 1),
    ("struct:ib_diploma", r"\bib\s+diploma\b", 3),
    ("struct:grade_boundary", r"\bgrade\s+boundar", 3),
    ("struct:markscheme", r"\bmark\s*scheme\b", 3),
    ("struct:total_marks", r"\btotal\s+marks?\b", 2),
]
#: Rules of references and boilerplate, each counted twice at most.
REFERENCES = [
    ("heading:references", r"(?:^|\n)\s*\d*\.?\s*references?\s*$", 5),
    ("heading:bibliography", r"(?:^|\n)\s*\d*\.?\s*bibliography\s*$", 5),
    ("heading:index", r"(?:^|\n)\s*index\s*$", 5),
    ("heading:glossary", r"(?:^|\n)\s*\d*\.?\s*glossary\s*$", 5),
    ("heading:further_reading", r"(?:^|\n)\s*further\s+reading\s*$", 5),
    ("artifact:mcs_page_header", r"\bmcs\s*[—\-]\s*.{2,60}\s*[—\-]\s*page\s*\d+", 5),
    ("artifact:page_watermark", r"(?:^|\n)\s*(?:page|p\.)\s*\d+\s*(?:of\s*\d+)?\s*$", 2),
    ("pattern:numbered_ref", r"^\s*\[\d+\]\s+\w", 3),
    ("heading:problems_for", r"\bproblems?\s+for\s+(?:section|chapter)\b", 5),
    ("heading:class_problems", r"\bclass\s+problems?\b", 5),
    ("heading:practice_problems", r"\bpractice\s+problems?\b", 5),
    ("heading:homework_problems", r"\bhomework\s+problems?\b", 5),
    ("heading:exercises_section", r"\bexercises\s+for\s+(?:section|chapter)\b", 5),
    ("heading:review_problems", r"(?:^|\n)\s*review\s+problems?\s*$", 5),
    ("heading:answers", r"(?:^|\n)\s*\d*\.?\s*answers?\s*$", 5),
]
#: Rules of exercises, each counted three times at most.
EXERCISE = [
    ("starts:problem_N", r"^\s*(?:problem|exercise)\s+\d+", 4),
    ("pattern:sub_parts", r"\([a-e]\)\s+\w", 2),
    ("imperative:find_show_prove", r"\b(?:find|show|prove|determine|evaluate|calculate|solve|verify|simplify)\b", 1),
]
#: Of each rule, lower-case pieces one of which every match has: a text without them needs no look by the pattern.
NEEDS = {
    "phrase:internal_assessment": ["internal"], "phrase:external_assessment": ["external"], "phrase:assessment_criteria": ["criteria"],
    "phrase:mark_allocation": ["allocation"], "phrase:weighting": ["weighting"], "phrase:final_assessment": ["final"],
    "phrase:assessment_objective": ["objective"], "struct:paper_1_2": ["paper"], "struct:section_A_B": ["section"],
    "struct:duration": ["duration"], "struct:worth_N_marks": ["worth"], "struct:compulsory": ["compulsory"],
    "struct:prescribed_by": ["prescribed"], "struct:syllabus_aims": ["syllabus"], "struct:learning_outcomes": ["outcome"],
    "struct:ib_diploma": ["diploma"], "struct:grade_boundary": ["boundar"], "struct:markscheme": ["scheme"], "struct:total_marks": ["total"],
    "heading:references": ["reference"], "heading:bibliography": ["bibliography"], "heading:index": ["index"], "heading:glossary": ["glossary"],
    "heading:further_reading": ["further"], "artifact:mcs_page_header": ["mcs"], "artifact:page_watermark": ["page", "p."],
    "pattern:numbered_ref": ["["], "heading:problems_for": ["problem"], "heading:class_problems": ["problem"], "heading:practice_problems": ["practice"],
    "heading:homework_problems": ["homework"], "heading:exercises_section": ["exercises"], "heading:review_problems": ["review"], "heading:answers": ["answer"],
    "starts:problem_N": ["problem", "exercise"], "pattern:sub_parts": ["("],
    "imperative:find_show_prove": ["find", "show", "prove", "determine", "evaluate", "calculate", "solve", "verify", "simplify"],
}
THRESHOLDS = {"admin": 5, "references": 5, "exercise": 4}


def _bound(value: Column, body) -> Column:  # noqa: ANN001
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hits(text: Column, low: Column, rules: list[tuple[str, str, int]], cap: int) -> Column:
    """How often each rule's pattern is found, up to cap; one that counts once needs no more than its first place. low: text in lower case."""

    def count(name: str, p: str) -> Column:
        able = F.lit(False)
        for piece in NEEDS[name]:
            able = able | F.contains(low, F.lit(piece))
        found = text.rlike(f"(?im){p}").cast("int") if cap == 1 else F.least(F.regexp_count(text, F.lit(f"(?im){p}")), F.lit(cap))
        return F.when(able, found).otherwise(0)

    return F.array(*(count(name, p) for name, p, _ in rules))


def _score(hits: Column, rules: list[tuple[str, str, int]]) -> Column:
    return F.aggregate(F.zip_with(hits, F.array(*(F.lit(w) for _, _, w in rules)), lambda n, w: n * w), F.lit(0), lambda s, x: s + x)


def _names(hits: Column, rules: list[tuple[str, str, int]], counted: bool) -> Column:
    said = lambda n, name: F.concat(name, F.lit("(×"), n.cast("string"), F.lit(")")) if counted else name
    return F.array_compact(F.zip_with(hits, F.array(*(F.lit(name) for name, _, _ in rules)), lambda n, name: F.when(n > 0, said(n, name))))


def classify(text: Column) -> Column:
    """struct(chunk_type, score, matched): the first class whose score reaches its threshold.

    Hits are counted once: each group's array is bound to a name by a lambda over an array of one entry, and the rules of
    a later class are only looked at if the classes before it are not reached.
    """

    def out(kind: str, score: Column, names: Column) -> Column:
        return F.struct(F.lit(kind).alias("chunk_type"), score.cast("int").alias("score"), names.alias("matched"))

    def decide(low: Column, admin: Column) -> Column:
        fired = _names(admin, ADMIN, False)

        def next_class(kind: str, rules: list[tuple[str, str, int]], cap: int, threshold: int, otherwise: Column) -> Column:
            found = lambda x: F.when(x["s"] >= threshold, out(kind, x["s"], F.concat(fired, _names(x["h"], rules, True)))).otherwise(otherwise)
            scored = lambda h: F.struct(h.alias("h"), _score(h, rules).alias("s"))
            return _bound(_bound(_hits(text, low, rules, cap), scored), found)

        none = out("instructional", F.lit(0), F.array().cast("array<string>"))
        tasks = next_class("exercise", EXERCISE, 3, THRESHOLDS["exercise"], none)
        refs = next_class("references_boilerplate", REFERENCES, 2, THRESHOLDS["references"], tasks)
        return _bound(_score(admin, ADMIN), lambda s: F.when(s >= THRESHOLDS["admin"], out("admin_assessment", s, fired)).otherwise(refs))

    return _bound(F.lower(text), lambda low: _bound(_hits(text, low, ADMIN, 1), lambda admin: decide(low, admin)))


#: Openings that mark text as unfit for questions, citations, and cross-references.
EXCLUDED_HEADING = r"^\s*(?:(?:\d+[\.\d]*\s+)?references?\b|bibliography\b|(?:homework|practice|exam|review)\s+problems?\b|problems?\s+for\s+(?:section|chapter)\b|further\s+reading\b|acknowledgements?\b|(?:list\s+of\s+)?(?:figures?|tables?|abbreviations?|symbols?)\b|^\s*index\s*$)"
CITATION = r"\[[A-Za-z0-9,\.\s]{1,30}\]"
SEE_ALSO = r"\b(?:see|cf\.?|refer\s+to|as\s+in)\s+\["


def is_excluded(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.size(F.array_remove(F.split(bare, r"\s+"), ""))
    cited, seen = F.regexp_count(bare, F.lit(CITATION)), F.regexp_count(bare, F.lit(f"(?i){SEE_ALSO}"))
    sentences = F.size(F.filter(F.split(bare, "[.!?]+"), lambda s: s.rlike(r"\S")))
    rules = F.substring(bare, 1, 300).rlike(f"(?im){EXCLUDED_HEADING}") | (words == 0) | ((words < 80) & (cited >= 4)) | (cited > 0.15 * words) | ((sentences > 0) & (seen > 0.40 * sentences))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(False)).otherwise(rules)


#: Openings of recall questions, on the lower-case stem.
TRIVIAL = [
    r"^what\s+is\s+(?:a|an|the)\s+\w", r"^what\s+are\s+(?:a|an|the)\s+\w", r"^define\s+",
    r"^what\s+does\s+.{1,60}\s+(?:mean|assert|represent|denote|stand\s+for)", r"^state\s+the\s+definition\s+of\s+",
    r"^give\s+(?:a|an|the)\s+definition\s+of\s+", r"^which\s+term\s+refers\s+to\s+", r"^what\s+is\s+meant\s+by\s+",
    r"^(?:briefly\s+)?explain\s+what\s+(?:a|an|the)\s+\w+\s+is", r"^what\s+symbol\s+", r"^which\s+notation\s+",
]


def is_trivial(stem: Column) -> Column:
    return F.coalesce(F.lower(trim_blanks(stem)).rlike("|".join(TRIVIAL)), F.lit(False))


def reject_trivial(stem: Column, difficulty: Column, bloom: Column) -> Column:
    return is_trivial(stem) & (F.lower(difficulty) != "easy") & (F.lower(bloom) != "remember")


#: Verb stems by difficulty, and signs of a compound sentence.
HARD = r"\b(evaluat|analys|analyz|synthesiz|design|justify|critiqu|compar|contrast|differentiat|assess|argue|formulat|construct|develop|creat)\w*\b"
MEDIUM = r"\b(explain|describ|illustrat|classif|summariz|interpret|appl|demonstrat|calculat|solv|show|outline|discuss|predict|relate)\w*\b"
EASY = r"\b(identif|list|name|state|defin|recall|recogniz|what is|which|who|when|where)\w*\b"
COMPOUND = r"(,|\band\b|\bor\b|\bbut\b|\bhowever\b|\btherefore\b)"


def difficulty(stem: Column) -> Column:
    """struct(level, confidence) from verb counts, compound signs and length."""
    count = lambda p: F.regexp_count(stem, F.lit(f"(?i){p}"))
    hard, medium, easy = F.least(count(HARD), F.lit(4)), F.least(count(MEDIUM), F.lit(4)), count(EASY)
    words = F.size(F.array_remove(F.split(trim_blanks(stem), r"\s+"), ""))
    score = 2.0 * hard + medium - easy + 0.5 * F.floor(count(COMPOUND) / 2) - F.when(words <= 8, 1.0).otherwise(0.0)
    out = lambda level, conf: F.struct(F.lit(level).alias("level"), conf.cast("double").alias("confidence"))
    return F.when(score > 2, out("hard", F.least(0.5 + hard * 0.08, F.lit(0.75)))).when(score > 0, out("medium", F.lit(0.55))).otherwise(out("easy", F.least(0.5 + easy * 0.08, F.lit(0.70))))


#: Verbs by cognitive level, highest first.
BLOOM = {
    "create": "design|create|construct|develop|formulate|plan|compose|produce|invent|build|generate|devise|hypothesize|synthesize|synthesise",
    "evaluate": "evaluate|judge|critique|justify|defend|assess|appraise|argue|prioritize|prioritise|recommend|select|decide|conclude",
    "analyze": r"analyze|analyse|differentiate|distinguish|examine|compare|contrast|categorize|categorise|classify|investigate|break\s+down|outline|relate|dissect|infer",
    "apply": r"calculate|solve|apply|use|demonstrate|implement|execute|carry\s+out|operate|show|illustrate|compute|predict|determine",
    "understand": r"explain|summarize|summarise|describe|paraphrase|interpret|identify|convert|translate|discuss|review|restate|give\s+an\s+example",
    "remember": "define|list|recall|recognise|recognize|name|state|repeat|label|match|arrange|memorize|memorise|locate|quote",
}


def bloom(stem: Column) -> Column:
    """struct(level, confidence, verb) from the first clause."""
    clause = F.substring_index(F.substring_index(stem, "?", 1), ".", 1)
    out = F.struct(F.lit("remember").alias("level"), F.lit(0.40).alias("confidence"), F.lit(None).cast("string").alias("verb"))
    for level, verbs in reversed(BLOOM.items()):
        pattern = rf"(?i)\b({verbs})\b"
        found = F.struct(F.lit(level).alias("level"), F.lit(0.65).alias("confidence"), F.lower(F.regexp_extract(clause, pattern, 1)).alias("verb"))
        out = F.when(clause.rlike(pattern), found).otherwise(out)
    return out


def tag_difficulty(stem: Column) -> Column:
    """difficulty(), but a recall question is easy with at least 0.55."""
    d = difficulty(stem)
    easy = F.struct(F.lit("easy").alias("level"), F.greatest(d["confidence"], F.lit(0.55)).alias("confidence"))
    return F.when(is_trivial(stem) & (d["level"] != "easy"), easy).otherwise(d)


def tag_bloom(stem: Column) -> Column:
    """Level of bloom(), but a recall question is at most at understand."""
    level = bloom(stem)["level"]
    return F.when(is_trivial(stem) & ~level.isin("remember", "understand"), F.lit("understand")).otherwise(level)


#: Titles that are never topics, by source of the title.
TOC_NOISE = ("contents", "table of contents", "index", "references", "bibliography", "acknowledgements", "acknowledgments", "preface", "foreword", "about the author", "copyright", "list of figures", "list of tables", "list of algorithms")
TOC_NOISE_PATTERNS = [r"(?i)homework\s+problems?", r"(?i)practice\s+problems?", r"(?i)problems?\s+for\s+section", r"(?i)section\s+practice\s+problems?", r"(?i)^mcs\s*page?\b", r"\bwwd\b", r"^[A-Z\s]{1,5}$"]
SERVICE_NOISE_PATTERNS = [r"(?i)^page\s*\d*$", r"(?i)^chapter\s*$", r"(?i)^section\s*$", r"(?i)^part\s*$", r"(?i)^mcs\s+page\s+\d"]
TOPIC_NOISE = ("introduction", "conclusions", "summary", "preface", "acknowledgements", "acknowledgments", "contents", "table of contents", "bibliography", "references", "index", "appendix", "glossary", "list of figures", "list of tables", "abstract", "foreword", "further reading", "answers", "solutions", "footnotes", "copyright", "license", "all rights reserved", "page", "slide", "figure", "table", "equation")
TOPIC_NOISE_PATTERNS = [r"^ch(apter)?\s*\d+\s*$", r"^section\s*\d+(\.\d+)*\s*$", r"^part\s+(i{1,3}v?|vi{0,3}|\d+)\s*$", r"^\d+(\.\d+)*\s*$", r"^[^a-z]{0,2}[a-z]?[^a-z]{0,2}$", r"^[\W_]+$", r"^\d{1,4}\s*$", r"^https?://", r"^www\.", r"^slide\s*\d+", r"^page\s*\d+", r"copyright|©|\(c\)\s*\d{4}"]


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def is_toc_noise(title: Column) -> Column:
    bare = trim_blanks(title)
    return (F.length(F.regexp_replace(bare, "[^a-zA-Z]", "")) < 3) | F.lower(bare).isin(*TOC_NOISE) | _any(bare, TOC_NOISE_PATTERNS)


def is_service_noise(title: Column) -> Column:
    return is_toc_noise(title) | _any(trim_blanks(title), SERVICE_NOISE_PATTERNS)


def is_topic_noise(title: Column) -> Column:
    low = trim_blanks(F.lower(title))
    return low.isin(*TOPIC_NOISE) | _any(low, TOPIC_NOISE_PATTERNS)
