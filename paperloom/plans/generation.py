"""Queries over new questions: blacklists, recent duplicates, and the gates of the four generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import notation, rules, similarity
from paperloom.operators.embedding import embed
from paperloom.operators.generation import greedy_duplicates, near_pairs
from paperloom.operators.vector_index import build_index, search
from paperloom.plans.fixtures import literal, options, stems, with_sql
from paperloom.registry import query, spread
from paperloom.scratch import written

#: Cosines from which a question is like a blacklisted or a recent one; recent questions of a course; questions that a set asks for.
BLACKLIST, RECENT, NEWEST, COUNT = 0.90, 0.92, 100, 5

# candidates: the questions, and every sixth once more with a word added
_AGAIN = "question_id + 50 AS question_id, set_id, course_id, blueprint_id, type, difficulty, bloom, status, concat(stem, ' again') AS stem"
CANDIDATES_SQL = f"c AS (SELECT * FROM stems UNION ALL SELECT {_AGAIN} FROM stems WHERE question_id % 6 = 0)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stems(spark, sf_dir)
    return q.unionByName(q.where("question_id % 6 = 0").selectExpr(*(x.strip() for x in _AGAIN.replace("concat(stem, ' again')", "stem || ' again'").split(","))))


def _vectors(q: DataFrame) -> DataFrame:
    """id, scope, vec and skip; written, as an index reads its vectors three times."""
    slim = q.select(F.col("question_id").alias("id"), F.col("course_id").alias("scope"), F.array("question_id").alias("skip"), "stem")
    return written(embed(spread(slim), "stem", 64).select("id", "scope", F.col("embedding").alias("vec"), "skip"))


def matches(asked: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """question_id, reason and similarity: an equal fingerprint in the course first, then the largest cosine.

    Both sides have question_id, course_id and stem; a question is not compared with itself.
    """
    print_ = notation.fingerprint(F.col("stem")).alias("print")
    prints = listed.select("course_id", print_, "question_id").groupBy("course_id", "print").agg(F.min("question_id").alias("least"), F.max("question_id").alias("most"))
    exact = asked.select("question_id", "course_id", print_).join(prints, ["course_id", "print"], "left").select("question_id", F.coalesce((F.col("least") != F.col("question_id")) | (F.col("most") != F.col("question_id")), F.lit(False)).alias("exact"))
    top = search(build_index(_vectors(listed)), _vectors(asked), 1, metric="dot").select(F.col("query_id").alias("question_id"), "score")
    score = F.coalesce("score", F.lit(0.0))
    reason = F.when(F.col("exact"), "fingerprint").when(score >= threshold, "similarity").otherwise("")
    return exact.join(top, "question_id", "left").select("question_id", reason.alias("reason"), score.alias("similarity"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).where("status = 'rejected'")


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("question_id")))
    return stems(spark, sf_dir).where("status = 'approved'").withColumn("r", newest).where(F.col("r") <= NEWEST)


_SLOTS = "list_transform(regexp_extract_all(lower(stem), '[a-z]{3,}'), lambda w: ('0x' || md5(w)[:8])::BIGINT % 64)"
_EMBEDDED = f"SELECT *, list_transform(range(64), lambda k: len(list_filter(s, lambda x: x = k))::DOUBLE) AS v FROM (SELECT *, {_SLOTS} AS s FROM LISTED)"
_COS = "CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) END"
_NEW = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY question_id DESC) AS r FROM stems WHERE status = 'approved') WHERE r <= 100)"
_BAD = "(SELECT * FROM stems WHERE status = 'rejected')"


def _match_sql(listed: str, threshold: float) -> str:
    both = f"SELECT a.question_id, max(CASE WHEN lower(trim(a.stem)) = lower(trim(b.stem)) THEN 1 ELSE 0 END) AS e, max(round({_COS}, 5)) AS m FROM ({_EMBEDDED.replace('LISTED', 'c')}) a LEFT JOIN ({_EMBEDDED.replace('LISTED', listed)}) b ON a.course_id = b.course_id AND a.question_id <> b.question_id GROUP BY 1"
    return f"SELECT question_id, CASE WHEN e = 1 THEN 'fingerprint' WHEN m >= {threshold} THEN 'similarity' ELSE '' END AS reason, coalesce(m, 0.0)::DOUBLE AS similarity FROM ({both})"


@query("is_blacklisted", with_sql("stems", "").rstrip() + f", {CANDIDATES_SQL} {_match_sql(_BAD, BLACKLIST)}")
def is_blacklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(candidates(spark, sf_dir), _listed(spark, sf_dir), BLACKLIST)


@query("is_recent_duplicate", with_sql("stems", "").rstrip() + f", {CANDIDATES_SQL} {_match_sql(_NEW, RECENT)}")
def is_recent_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(candidates(spark, sf_dir), _recent(spark, sf_dir), RECENT)


# replies of the generating and the checking model, by the question's number
_REPLY = {
    "answer": "CASE WHEN question_id % 9 = 4 THEN ' ' ELSE substr(stem, 3, 30) END",
    "points": "CASE WHEN question_id % 4 = 1 THEN NULL ELSE concat('point ', question_id % 10, '; point two') END",
    "guidance": "CASE WHEN question_id % 3 = 1 THEN NULL ELSE 'Weigh both sides.' END",
    "claimed": "question_id % 2 = 0",
    "verdict": "CASE question_id % 5 WHEN 0 THEN 'wrong' WHEN 1 THEN 'several' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'error' ELSE 'right' END",
    "said": "substr('ABCD', cast(1 + question_id % 3 AS int), 1)",
    "confidence": "CASE WHEN question_id % 7 < 5 THEN 0.9D ELSE 0.6D END",
}
_REPLIES = ", ".join(f"{x.replace('0.9D', '0.9::DOUBLE').replace('0.6D', '0.6::DOUBLE')} AS {name}" for name, x in _REPLY.items())

#: For each type of question: whether its parts are there, whether the checker's verdict rejects it, and its stored answer.
KINDS = {
    "mcq": ("n_options = 4 AND n_correct = 1", "verdict = 'several' OR verdict = 'wrong' AND confidence >= 0.8 AND said <> key", "concat(key, ': ', option)"),
    "true_false": ("true", "verdict = 'ambiguous'", "CASE WHEN claimed <> (verdict = 'wrong' AND confidence >= 0.8) THEN 'True' ELSE 'False' END"),
    "short_answer": ("trim(answer) <> ''", "false", "answer || coalesce(' | ' || points, '')"),
    "essay": ("trim(answer) <> ''", "false", "concat(answer, ' | ', coalesce(guidance, 'Depth (10 pts): full marks for both sides'))"),
}


def gates(q: DataFrame, structure: Column, rejected: Column, answer: Column, count: int = COUNT) -> DataFrame:
    """question_id, gate (the first that stops a candidate, in order, or saved) and the answer stored with it.

    q has question_id, set_id, stem, difficulty, bloom, listed and recent. A duplicate is like an earlier question of its
    set that is saved; a set takes no more than ``count``.
    """
    known = q.withColumn("whole", (F.length(F.trim("stem")) > 0) & structure).withColumn("refused", rejected)
    known = known.withColumn("trivial", rules.reject_trivial(F.col("stem"), F.col("difficulty"), F.col("bloom")))
    able = F.col("whole") & ~F.col("trivial") & ~F.col("listed") & ~F.col("recent") & ~F.col("refused")
    known = written(known.withColumn("able", able))  # the searches above run once
    pairs = near_pairs(known.where("whole").select(F.col("question_id").alias("id"), "set_id", similarity.tokens(F.col("stem")).alias("t")), 0.72, ("set_id",))
    good = known.where("able").select("question_id")
    first = pairs.join(good.withColumnRenamed("question_id", "a"), "a")  # an earlier question counts if nothing else stops it
    among = greedy_duplicates(first.join(good.withColumnRenamed("question_id", "b"), "b").select("a", "b"))
    again = first.join(among.withColumnRenamed("id", "a"), "a", "left_anti").select(F.col("b").alias("question_id")).distinct().withColumn("again", F.lit(True))
    known = known.join(again, "question_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    place = F.sum((F.col("able") & ~F.col("again")).cast("int")).over(Window.partitionBy("set_id").orderBy("question_id"))
    gate = F.when(~F.col("whole"), "structure").when(F.col("again"), "duplicate").when(F.col("trivial"), "trivial").when(F.col("listed"), "blacklisted").when(F.col("recent"), "recent").when(F.col("refused"), "incorrect").when(place > count, "surplus").otherwise("saved")
    return known.withColumn("gate", gate).select("question_id", "gate", F.when(F.col("gate") == "saved", answer).alias("answer"))


def _asked(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    q = candidates(spark, sf_dir).where(F.col("type") == kind).withColumns({name: F.expr(x) for name, x in _REPLY.items()})
    found = lambda listed, threshold, name: matches(q, listed, threshold).select("question_id", (F.col("reason") != "").alias(name))
    q = q.join(found(_listed(spark, sf_dir), BLACKLIST, "listed"), "question_id").join(found(_recent(spark, sf_dir), RECENT, "recent"), "question_id")
    if kind == "mcq":
        right = F.min_by(F.struct("label", "text"), F.when(F.col("is_correct"), F.col("k")))
        own = options(spark, sf_dir).groupBy("question_id").agg(F.count("*").alias("n_options"), F.count_if("is_correct").alias("n_correct"), right.alias("right"))
        q = q.join(own.select(F.col("question_id").alias("of"), "n_options", "n_correct", F.col("right.label").alias("key"), F.col("right.text").alias("option")), F.expr("of = question_id - if(stem like '% again' and question_id % 100 >= 50, 50, 0)"), "left").fillna(0, ["n_options", "n_correct"])
    return q


def _gates_sql(kind: str) -> str:
    structure, rejected, answer = KINDS[kind]
    tokens = "list_distinct(list_filter(regexp_split_to_array(lower(stem), '[^\\pL\\pN_]+'), lambda x: length(x) >= 3))"
    own = "o AS (SELECT question_id AS of, count(*) AS n_options, count_if(is_correct) AS n_correct, min_by(label, CASE WHEN is_correct THEN k END) AS key, min_by(text, CASE WHEN is_correct THEN k END) AS option FROM options GROUP BY 1), "
    joined = "LEFT JOIN o ON of = question_id - CASE WHEN stem LIKE '% again' AND question_id % 100 >= 50 THEN 50 ELSE 0 END" if kind == "mcq" else ""
    structure = structure.replace("n_options", "coalesce(n_options, 0)").replace("n_correct", "coalesce(n_correct, 0)")
    return with_sql("stems options", "").rstrip() + f""", {CANDIDATES_SQL}, {own if kind == 'mcq' else ''}bl AS ({_match_sql(_BAD, BLACKLIST)}), rc AS ({_match_sql(_NEW, RECENT)}),
q AS (SELECT *, length(trim(stem)) > 0 AND ({structure}) AS whole, regexp_matches(lower(trim(stem)), {literal('|'.join(rules.TRIVIAL))}) AND difficulty <> 'easy' AND bloom <> 'remember' AS trivial, {rejected} AS refused, {tokens} AS t
FROM (SELECT c.*, {_REPLIES}, bl.reason <> '' AS listed, rc.reason <> '' AS recent FROM c JOIN bl USING (question_id) JOIN rc USING (question_id) WHERE type = '{kind}') {joined}),
u AS (SELECT *, coalesce(whole AND NOT trivial AND NOT listed AND NOT recent AND NOT refused, false) AS able FROM q),
p AS (SELECT x.question_id AS a, y.question_id AS b FROM u x JOIN u y ON x.set_id = y.set_id AND x.question_id < y.question_id AND x.whole AND y.whole AND x.able WHERE len(list_intersect(x.t, y.t)) > 0.72 * len(list_distinct(list_concat(x.t, y.t)))),
d AS (SELECT DISTINCT b FROM p WHERE a NOT IN (SELECT b FROM p)),
g AS (SELECT *, question_id IN (SELECT b FROM d) AS again FROM u),
h AS (SELECT *, sum((able AND NOT again)::INTEGER) OVER (PARTITION BY set_id ORDER BY question_id) AS place FROM g),
i AS (SELECT *, CASE WHEN NOT whole THEN 'structure' WHEN again THEN 'duplicate' WHEN trivial THEN 'trivial' WHEN listed THEN 'blacklisted' WHEN recent THEN 'recent' WHEN refused THEN 'incorrect' WHEN place > {COUNT} THEN 'surplus' ELSE 'saved' END AS gate FROM h)
SELECT question_id, gate, CASE WHEN gate = 'saved' THEN {answer} END AS answer FROM i"""


def _generator(name: str, kind: str) -> None:
    @query(name, _gates_sql(kind))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each candidate with the first gate that stops it, and the answer that is stored with a saved one."""
        return gates(_asked(spark, sf_dir, kind), *(F.coalesce(F.expr(x), F.lit(False)) if k < 2 else F.expr(x) for k, x in enumerate(KINDS[kind])))


for _name, _kind in (("gen_mcq", "mcq"), ("gen_tf", "true_false"), ("gen_sa", "short_answer"), ("gen_essay", "essay")):
    _generator(_name, _kind)
