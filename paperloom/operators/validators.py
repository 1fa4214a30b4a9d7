"""Checks of generated questions that do not depend on each other: one that fails leaves the rows of the others.

A validator is a function from questions to rows. Each runs as a job of its own, whose rows are written; where it raises, the
questions that it should have judged get rows with status ``error`` in its place. A validator that can tell which question
it cannot judge leaves that question's score null, and only this row is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import notation, rules
from paperloom.scratch import written

#: Scores of outcomes, and of the verdicts of a checking model (any other verdict is open).
OUTCOMES = {"pass": 1.0, "warn": 0.5, "fail": 0.0}
VERDICTS = {"correct": 1.0, "ambiguous": 0.5, "wrong_label": 0.0, "wrong_correct": 0.0, "multiple_correct": 0.0, "incorrect": 0.0, "error": 0.5}
#: Options that refer to other options.
CATCH_ALL = ("all of the above", "all of the above.", "none of the above", "none of the above.", "all of these", "none of these", "both a and b", "both of the above")
ROW = ("question_id", "validation_type", "status", "passed", "score", "outcome", "detail")


@dataclass(frozen=True)
class Validator:
    """judge() gives question_id, outcome, passed, score and detail (JSON) for questions, of the types given (all, if none are)."""

    kind: str
    judge: Callable[[DataFrame], DataFrame]
    types: tuple[str, ...] = ()

    def asked(self, questions: DataFrame) -> DataFrame:
        return questions.where(F.col("type").isin(*self.types)) if self.types else questions


def _scored(rows: DataFrame, outcome: Column, *facts: str | Column) -> DataFrame:
    score = F.coalesce(*(F.when(F.col("outcome") == o, s) for o, s in OUTCOMES.items()))
    judged = rows.withColumn("outcome", outcome)
    return judged.select("question_id", "outcome", (F.col("outcome") != "fail").alias("passed"), score.alias("score"), F.to_json(F.struct("outcome", *facts)).alias("detail"))


def grounding(sources: DataFrame) -> Validator:
    """Questions without sources fail, those none of whose sources names a chunk warn. sources: question_id, chunk_id (or null)."""
    own = sources.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("sources"), F.count("chunk_id").alias("linked"))

    def judge(questions: DataFrame) -> DataFrame:
        q = questions.select("question_id").join(own, F.col("question_id") == F.col("id"), "left").fillna(0, ["sources", "linked"])
        return _scored(q, F.when(F.col("sources") == 0, "fail").when(F.col("linked") == 0, "warn").otherwise("pass"), "sources", "linked")

    return Validator("grounding", judge)


def option_facts(options: DataFrame) -> DataFrame:
    """question_id, n, c, dup, ca, outlier: options, correct ones, repeated texts, references to other options, and whether one is over three times as long as the mean."""
    norm, n = notation.option_text(F.col("text")), F.length("text")
    return options.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), (F.count("*") - F.count_distinct(norm)).alias("dup"), F.count_if(norm.isin(*CATCH_ALL)).alias("ca"), (F.max(n) > 3 * F.avg(n)).alias("outlier"))


def option_outcome() -> Column:
    wrong = (F.col("n") != 4) | (F.col("c") != 1) | (F.col("dup") > 0)
    return F.when(wrong, "fail").when((F.col("ca") > 0) | F.col("outlier"), "warn").otherwise("pass")


def distractors(options: DataFrame) -> Validator:
    """options: question_id, text, is_correct. A question without options fails."""
    facts = option_facts(options).withColumnRenamed("question_id", "id")

    def judge(questions: DataFrame) -> DataFrame:
        q = questions.select("question_id").join(facts, F.col("question_id") == F.col("id"), "left").fillna(0, ["n", "c", "dup", "ca"]).fillna(False, ["outlier"])
        return _scored(q, option_outcome(), F.col("n").alias("option_count"), F.col("c").alias("correct_count"))

    return Validator("distractor", judge, ("mcq",))


def _tagged(questions: DataFrame, level: Column, confidence: Column) -> DataFrame:
    """A tag is no gate: it always passes."""
    q = questions.withColumns({"outcome": level, "score": confidence})
    return q.select("question_id", "outcome", F.lit(True).alias("passed"), "score", F.to_json(F.struct(F.col("outcome").alias("level"), F.col("score").alias("confidence"))).alias("detail"))


def difficulty() -> Validator:
    def judge(questions: DataFrame) -> DataFrame:
        tag = rules.tag_difficulty(F.col("stem"))
        return _tagged(questions, tag["level"], tag["confidence"])

    return Validator("difficulty", judge)


def bloom() -> Validator:
    def judge(questions: DataFrame) -> DataFrame:
        heuristic, level = rules.bloom(F.col("stem")), rules.tag_bloom(F.col("stem"))
        raised = F.when(level != heuristic["level"], F.greatest(heuristic["confidence"], F.lit(0.55))).otherwise(heuristic["confidence"])
        return _tagged(questions, level, raised)

    return Validator("bloom", judge)


def triviality() -> Validator:
    """A recall question fails unless the slot asked for one: then it warns. difficulty and bloom are what the slot asked for."""

    def judge(questions: DataFrame) -> DataFrame:
        wanted = (F.lower("difficulty") == "easy") | (F.lower("bloom") == "remember")
        trivial = rules.is_trivial(F.col("stem"))
        return _scored(questions, F.when(~trivial, "pass").when(wanted, "warn").otherwise("fail"), trivial.alias("trivial"), "difficulty", "bloom")

    return Validator("triviality", judge)


def correctness(verdicts: DataFrame) -> Validator:
    """What a checking model said before, for the questions that it was asked about. verdicts: question_id, verdict, rejects."""
    said = verdicts.withColumnRenamed("question_id", "id")

    def judge(questions: DataFrame) -> DataFrame:
        q = questions.select("question_id").join(said, F.col("question_id") == F.col("id"))
        score = F.coalesce(*(F.when(F.col("verdict") == v, s) for v, s in VERDICTS.items()), F.lit(0.5))
        return q.select("question_id", F.col("verdict").alias("outcome"), (~F.col("rejects")).alias("passed"), score.alias("score"), F.to_json(F.struct("verdict", "rejects")).alias("detail"))

    return Validator("correctness", judge, ("mcq", "true_false"))


def run_validators(questions: DataFrame, validators: Sequence[Validator]) -> DataFrame:
    """The rows (ROW) of all validators for questions (question_id, type, stem, difficulty, bloom)."""
    rows = None
    for validator in validators:
        asked = validator.asked(questions)
        judged = F.col("score").isNotNull()
        try:
            found = validator.judge(asked).select("question_id", F.lit(validator.kind).alias("validation_type"), F.when(judged, "ok").otherwise("error").alias("status"), F.when(judged, F.col("passed")).alias("passed"), F.col("score").cast("double").alias("score"), "outcome", "detail")
            own = written(found)
        except (PySparkException, Py4JJavaError) as broken:  # this one only: the others' rows stand
            null = lambda kind, name: F.lit(None).cast(kind).alias(name)
            reason = F.to_json(F.struct(F.lit(type(broken).__name__).alias("raised")))
            own = asked.select("question_id", F.lit(validator.kind).alias("validation_type"), F.lit("error").alias("status"), null("boolean", "passed"), null("double", "score"), null("string", "outcome"), reason.alias("detail"))
        rows = own if rows is None else rows.unionByName(own)
    return rows
