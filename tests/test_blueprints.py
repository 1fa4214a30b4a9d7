"""Blueprint slots and reasons against plain apportionment."""

import json
import random
from collections import defaultdict

import pytest

from paperloom.operators import blueprints


def shared(total, weights):
    whole = sum(weights.values())
    if not total or not whole:
        return dict.fromkeys(weights, 0)
    raw = {k: total * w / whole for k, w in weights.items()}
    out = {k: int(v) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: round(raw[k] - out[k], 9), reverse=True)[: total - sum(out.values())]:
        out[k] += 1
    return out


def plain_slots(config):
    counts, mix = config["question_counts"], config["difficulty_mix"]
    asked = {t: counts[t] for t in blueprints.TYPES if counts.get(t, 0) > 0}
    topics = config["topic_mix"]["topics"] if config["topic_mix"]["mode"] == "manual" else [None]
    for no, entry in enumerate(topics):
        of_type = asked if entry is None else shared(entry["question_count"], asked)
        for t, n in of_type.items():
            for level, share in shared(n, {x: mix[x] for x in blueprints.LEVELS}).items():
                if share:
                    yield (no, entry and entry["topic_id"], t, level, share)


def configs(spark, rows):
    return blueprints.parsed(spark.createDataFrame([(k, c if c is None or isinstance(c, str) else json.dumps(c)) for k, c in enumerate(rows)], "blueprint_id long, config_json string"))


def test_slots_of_both_modes(spark):
    rng = random.Random(9)
    rows = []
    for k in range(120):
        topics = [{"topic_id": rng.randint(1, 4), "question_count": rng.randint(0, 9)} for _ in range(rng.randint(0, 4))]
        mix = rng.choice([{"easy": 0.3, "medium": 0.4, "hard": 0.3}, {"easy": 0.0, "medium": 1.0, "hard": 0.0}, {"easy": 0.0, "medium": 0.0, "hard": 0.0}, {"easy": 0.34, "medium": 0.33, "hard": 0.33}])
        rows.append({"question_counts": {t: rng.choice([0, 0, 1, 3, 10]) for t in blueprints.TYPES}, "difficulty_mix": mix, "topic_mix": {"mode": rng.choice(["auto", "manual"]), "topics": topics}})
    got = defaultdict(set)
    for r in blueprints.expand(configs(spark, rows)).collect():
        got[r["blueprint_id"]].add(tuple(r)[1:])
    for k, config in enumerate(rows):
        assert got[k] == set(plain_slots(config)), config
        if config["topic_mix"]["mode"] == "manual" and sum(config["difficulty_mix"].values()) and sum(config["question_counts"].values()):
            for no, entry in enumerate(config["topic_mix"]["topics"]):
                assert sum(s[-1] for s in got[k] if s[0] == no) == entry["question_count"]  # both levels of shares add up


GOOD = {"question_counts": {"mcq": 3}, "total_points": 10}
BAD = {
    "no_questions": {"question_counts": {"mcq": 0}},
    "ranges": {"difficulty_mix": {"easy": 1.5, "medium": -0.5, "hard": 0}},
    "difficulty_sum": {"difficulty_mix": {"easy": 0.5, "medium": 0.1, "hard": 0.1}},
    "bloom_sum": {"bloom_mix": {"apply": 0.5}},
    "topic_mode": {"topic_mix": {"mode": "other"}},
    "manual_topics": {"topic_mix": {"mode": "manual", "topics": []}},
    "manual_total": {"topic_mix": {"mode": "manual", "topics": [{"topic_id": 1, "question_count": 2}]}},
    "points": {"total_points": 0},
    "duration": {"duration_minutes": 4},
}


def test_each_reason_stands_alone(spark):
    rows = [GOOD, *({**GOOD, **change} for change in BAD.values()), "no json", None, {**GOOD, "topic_mix": {"mode": "manual", "topics": [{"question_count": 3}]}}, {**GOOD, "bloom_mix": {"apply": 0.995}, "duration_minutes": 5}]
    got = {r["blueprint_id"]: r["reasons"] for r in blueprints.reasons(configs(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == ["", *BAD, "no_questions", "no_questions", "ranges", ""]


@pytest.mark.parametrize("name", ["blueprint_expand", "config_validation"])
def test_fixture_reaches_everything(spark, small, name):
    from paperloom.catalog import QUERIES

    rows = QUERIES[name](spark, small).collect()
    if name == "blueprint_expand":
        assert {r["topic_no"] for r in rows} == {0, 1} and {r["topic_id"] is None for r in rows} == {True, False}
    else:
        assert {x for r in rows for x in r["reasons"].split(",") if x} >= set(BAD) - {"topic_mode"}
