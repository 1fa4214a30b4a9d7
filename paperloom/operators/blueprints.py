"""Blueprints of exams: their configuration as JSON, reasons to reject it, and the slots that it asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.apportion import shares_within

#: Types and levels in their order, and what a configuration has where it says nothing.
TYPES = ["mcq", "true_false", "short_answer", "essay"]
LEVELS = ["easy", "medium", "hard"]
BLOOM = ["remember", "understand", "apply", "analyze", "evaluate", "create"]
DEFAULT_MIX = {"easy": 0.34, "medium": 0.33, "hard": 0.33}
DEFAULT_POINTS, LEAST_POINTS, LEAST_MINUTES = 100, 1, 5
#: What sums of proportions may be.
SUMS = (0.99, 1.01)

SCHEMA = (
    "question_counts struct<" + ",".join(f"{t}:bigint" for t in TYPES) + ">, difficulty_mix struct<" + ",".join(f"{x}:double" for x in LEVELS) + ">, bloom_mix struct<" + ",".join(f"{b}:double" for b in BLOOM)
    + ">, topic_mix struct<mode:string,topics:array<struct<topic_id:bigint,question_count:bigint>>>, total_points bigint, duration_minutes bigint"
)


def parsed(configs: DataFrame) -> DataFrame:
    """configs (blueprint_id, config_json) with their parts as columns and defaults filled in; text that is no JSON has null counts."""
    c = configs.withColumn("c", F.from_json("config_json", SCHEMA))
    count = lambda t: F.when(F.col("c.question_counts").isNotNull(), F.coalesce(F.col(f"c.question_counts.{t}"), F.lit(0))).alias(t)
    mix = F.struct(*(F.coalesce(F.col(f"c.difficulty_mix.{x}"), F.lit(DEFAULT_MIX[x])).alias(x) for x in LEVELS))
    bloom = F.when(F.col("c.bloom_mix").isNotNull(), F.struct(*(F.coalesce(F.col(f"c.bloom_mix.{b}"), F.lit(0.0)).alias(b) for b in BLOOM)))
    topics = F.coalesce("c.topic_mix.topics", F.array().cast("array<struct<topic_id:bigint,question_count:bigint>>"))
    return c.select(
        "blueprint_id", F.struct(*map(count, TYPES)).alias("counts"), mix.alias("mix"), bloom.alias("bloom"), F.coalesce("c.topic_mix.mode", F.lit("auto")).alias("mode"), topics.alias("topics"),
        F.coalesce("c.total_points", F.lit(DEFAULT_POINTS)).alias("points"), F.col("c.duration_minutes").alias("minutes"),
    )


def _sum(struct: str, names: list[str]) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + F.col(f"{struct}.{name}")
    return total


def reasons(configs: DataFrame) -> DataFrame:
    """blueprint_id and reasons (comma-joined, none: accepted) of parsed configurations."""
    outside = lambda x: F.coalesce((x < 0) | (x > 1), F.lit(False))
    bad = F.exists("topics", lambda t: F.coalesce(t["question_count"] < 1, F.lit(True)) | t["topic_id"].isNull())
    for t in TYPES:
        bad = bad | F.coalesce(F.col(f"counts.{t}") < 0, F.lit(False))
    for x in LEVELS:
        bad = bad | outside(F.col(f"mix.{x}"))
    for b in BLOOM:
        bad = bad | outside(F.col(f"bloom.{b}"))
    total, manual = _sum("counts", TYPES), F.col("mode") == "manual"
    asked = F.aggregate("topics", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(t["question_count"], F.lit(0)))
    rules = {
        "no_questions": total.isNull() | (total < 1),
        "ranges": bad,
        "difficulty_sum": ~F.round(_sum("mix", LEVELS), 9).between(*SUMS),
        "bloom_sum": F.col("bloom").isNotNull() & ~F.round(_sum("bloom", BLOOM), 9).between(*SUMS),
        "topic_mode": ~F.col("mode").isin("auto", "manual"),
        "manual_topics": manual & (F.size("topics") == 0),
        "manual_total": manual & (F.size("topics") > 0) & (asked != total),
        "points": F.col("points") < LEAST_POINTS,
        "duration": F.col("minutes") < LEAST_MINUTES,
    }
    return configs.select("blueprint_id", F.concat_ws(",", *(F.when(rule, F.lit(name)) for name, rule in rules.items())).alias("reasons"))


def expand(configs: DataFrame) -> DataFrame:
    """blueprint_id, topic_no, topic_id, type, level, share of every combination of parsed configurations that gets a question.

    Automatic: each type's count is shared out over the levels. Manual: each listed topic's count is shared out over the types
    by their counts, and what a type gets there over the levels. Both are the same chain of two apportionments, since an
    automatic blueprint is one without topic whose types have their counts already; a listed topic may come twice. A blueprint
    is one row, and so is a group of shares: rows are only mapped, and no table is sorted or shuffled.
    """
    auto = F.array(F.struct(F.lit(None).cast("long").alias("topic_id"), F.lit(None).cast("long").alias("question_count")))
    each = configs.select("blueprint_id", "counts", "mix", F.posexplode(F.when(F.col("mode") == "manual", F.col("topics")).otherwise(auto)).alias("topic_no", "t"))
    each = each.select("blueprint_id", "topic_no", F.col("t.topic_id").alias("topic_id"), F.col("t.question_count").alias("given"), "counts", "mix")
    asked = [F.when(F.col(f"counts.{t}") > 0, F.col(f"counts.{t}")) for t in TYPES]
    shared = shares_within(each, F.coalesce("given", F.lit(0)), asked)
    types = F.array(*(F.struct(F.lit(t).alias("type"), F.when(asked[k].isNotNull(), F.when(F.col("given").isNull(), asked[k]).otherwise(F.col("shares")[k])).alias("total")) for k, t in enumerate(TYPES)))
    of_type = shared.select("blueprint_id", "topic_no", "topic_id", "mix", F.explode(types).alias("y")).select("blueprint_id", "topic_no", "topic_id", "mix", "y.*").where("total is not null")
    of_level = shares_within(of_type, F.col("total"), [F.col(f"mix.{x}") for x in LEVELS])
    levels = F.array(*(F.struct(F.lit(x).alias("level"), F.col("shares")[k].alias("share")) for k, x in enumerate(LEVELS)))
    return of_level.select("blueprint_id", "topic_no", "topic_id", "type", F.explode(levels).alias("l")).select("blueprint_id", "topic_no", "topic_id", "type", "l.*").where("share > 0")
