"""Six validators, each for itself, and what is left when one of them breaks."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import validators
from paperloom.plans.assessment import validators_run


@pytest.fixture(scope="module")
def made(spark):
    questions = [(1, "mcq", "Compare and contrast trees and graphs in theory, and justify it.", "hard", "analyze"), (2, "mcq", "What is a tree?", "easy", "apply"), (3, "true_false", "What is a tree?", "medium", "apply"), (4, "essay", None, None, None)]
    options = [(1, t, k == 0) for k, t in enumerate(["one", "two", "six", "ten"])] + [(2, "one", True), (2, "two", False), (2, "All of the above", False), (2, "ten", False)]
    sources = [(1, 10), (1, None), (2, None)]
    verdicts = [(1, "correct", False), (2, "wrong_label", True), (3, "unheard of", False), (4, "correct", False)]
    return (
        spark.createDataFrame(questions, "question_id long, type string, stem string, difficulty string, bloom string"),
        spark.createDataFrame(options, "question_id long, text string, is_correct boolean"),
        spark.createDataFrame(sources, "question_id long, chunk_id long"),
        spark.createDataFrame(verdicts, "question_id long, verdict string, rejects boolean"),
    )


def kinds(made):
    _, options, sources, verdicts = made
    return [validators.grounding(sources), validators.distractors(options), validators.difficulty(), validators.bloom(), validators.triviality(), validators.correctness(verdicts)]


def test_rows_of_six_kinds(made):
    rows = {(r["validation_type"], r["question_id"]): r for r in validators.run_validators(made[0], kinds(made)).collect()}
    outcome = {k: r["outcome"] for k, r in rows.items()}
    assert [outcome["grounding", k] for k in (1, 2, 3, 4)] == ["pass", "warn", "fail", "fail"]
    assert [outcome.get(("distractor", k)) for k in (1, 2, 3, 4)] == ["pass", "warn", None, None]
    assert outcome["difficulty", 1] == "hard" and outcome["difficulty", 2] == "easy" and 0 <= rows["difficulty", 1]["score"] <= 1
    assert outcome["bloom", 1] == "evaluate" and rows["bloom", 1]["passed"]
    assert [outcome["triviality", k] for k in (1, 2, 3, 4)] == ["pass", "warn", "fail", "pass"]
    assert [(rows["correctness", k]["score"], rows["correctness", k]["passed"]) for k in (1, 2, 3)] == [(1.0, True), (0.0, False), (0.5, True)]
    assert ("correctness", 4) not in rows  # an essay has no key
    assert all(r["status"] == ("ok" if r["score"] is not None else "error") for r in rows.values())
    details = {k: json.loads(r["detail"]) for k, r in rows.items() if r["detail"]}
    assert details["grounding", 1] == {"outcome": "pass", "sources": 2, "linked": 1}
    assert details["distractor", 2] == {"outcome": "warn", "option_count": 4, "correct_count": 1}
    assert details["triviality", 2] == {"outcome": "warn", "trivial": True, "difficulty": "easy", "bloom": "apply"}
    assert details["difficulty", 2] == {"level": "easy", "confidence": rows["difficulty", 2]["score"]}
    assert details["correctness", 2] == {"verdict": "wrong_label", "rejects": True}


@pytest.mark.parametrize("broken", range(6))
def test_a_broken_validator_leaves_the_others(made, broken):
    own = kinds(made)
    whole = {tuple(r) for r in validators.run_validators(made[0], own).collect()}
    name = own[broken].kind
    judge = lambda q: q.select("question_id", F.raise_error(F.lit("broken")).alias("outcome"), F.lit(True).alias("passed"), F.lit(1.0).alias("score"), F.lit("").alias("detail"))
    own[broken] = validators.Validator(name, judge, own[broken].types)
    rows = {tuple(r) for r in validators.run_validators(made[0], own).collect()}
    assert {r for r in rows if r[1] != name} == {r for r in whole if r[1] != name}
    failed = [r for r in rows if r[1] == name]
    assert len(failed) == own[broken].asked(made[0]).count() and all(r[2] == "error" and r[3] is None and r[4] is None and "raised" in r[6] for r in failed)


def test_a_validator_with_an_unknown_column_is_broken_too(made):
    gone = validators.Validator("gone", lambda q: q.select("no_such_column"))
    rows = validators.run_validators(made[0], [gone, validators.difficulty()]).collect()
    assert {("gone", "error"), ("difficulty", "ok")} <= {(r["validation_type"], r["status"]) for r in rows}


def test_one_row_may_be_an_error(made):
    part = validators.Validator("part", lambda q: q.select("question_id", F.lit("pass").alias("outcome"), F.lit(True).alias("passed"), F.try_divide(F.lit(1.0), F.col("question_id") - 2).alias("score"), F.lit(None).cast("string").alias("detail")))
    rows = {r["question_id"]: (r["status"], r["passed"]) for r in validators.run_validators(made[0], [part]).collect()}
    assert rows == {1: ("ok", True), 2: ("error", None), 3: ("ok", True), 4: ("ok", True)}


def test_every_outcome_of_the_query(spark, small):
    rows = {(r["validation_type"], r["outcome"]) for r in validators_run(spark, small).collect()}
    assert {k for k, _ in rows} == {"grounding", "distractor", "difficulty", "bloom", "triviality", "correctness"}
    assert {("grounding", "pass"), ("grounding", "fail"), ("distractor", "fail"), ("triviality", "fail"), ("triviality", "warn"), ("triviality", "pass"), ("correctness", "ambiguous")} <= rows
