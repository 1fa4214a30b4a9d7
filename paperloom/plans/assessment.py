"""Queries over blueprints, question checks, review states, exams, exports, jobs and model budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import notation, rules
from paperloom.functions.ordinals import ordinal, ordinal_sql
from paperloom.operators import blueprints, validators
from paperloom.operators.apportion import shares_within
from paperloom.plans.chunks import BLOOM_SQL, CLAUSE_SQL, DIFFICULTY_SQL, TRIVIAL_SQL, VERB_SQL
from paperloom.plans.fixtures import literal, options, stems, strip, topic_map, with_sql
from paperloom.plans.text import tex_sql
from paperloom.registry import query, table
from paperloom.scratch import scratch_path
from paperloom.streaming import jobs
from paperloom.streaming.budgets import time_slices

# blueprints: orders, with counts by type and a difficulty mix from their keys
_COUNTS = {"mcq": "o_orderkey % 7", "true_false": "o_orderkey % 5", "short_answer": "o_orderkey % 3", "essay": "o_orderkey % 2"}
_MIX = {"easy": "(1 + o_custkey % 3)", "medium": "2", "hard": "(o_custkey % 2)"}
_CELLS = (
    "SELECT o_orderkey AS blueprint_id, t.type, t.type_ord, t.total, d.level, d.level_ord, d.w FROM orders, "
    + "LATERAL (VALUES " + ", ".join(f"('{t}', {k}, {e})" for k, (t, e) in enumerate(_COUNTS.items())) + ") AS t(type, type_ord, total), "
    + "LATERAL (VALUES " + ", ".join(f"('{d}', {k}, {e})" for k, (d, e) in enumerate(_MIX.items())) + ") AS d(level, level_ord, w)"
)
_SHARES = f"SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY blueprint_id, type ORDER BY round(raw - fl, 9) DESC, level_ord) <= total - sum(fl) OVER (PARTITION BY blueprint_id, type) THEN 1 ELSE 0 END AS share FROM (SELECT *, floor(raw)::BIGINT AS fl FROM (SELECT *, total * w / (sum(w) OVER (PARTITION BY blueprint_id, type))::DOUBLE AS raw FROM ({_CELLS})))"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blueprint_id, type, level and share of every combination that gets a question."""
    types = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(k).alias("type_ord"), F.expr(e).alias("total")) for k, (t, e) in enumerate(_COUNTS.items())))
    rows = table(spark, sf_dir, "orders").select("*", F.explode(types).alias("t")).select(F.col("o_orderkey").alias("blueprint_id"), "t.*", *(F.expr(e).cast("long").alias(d) for d, e in _MIX.items()))
    shared = shares_within(rows, F.col("total"), [F.col(d) for d in _MIX])
    levels = F.array(*(F.struct(F.lit(d).alias("level"), F.lit(k).alias("level_ord"), F.col(d).alias("w"), F.col("shares")[k].alias("share")) for k, d in enumerate(_MIX)))
    return shared.select("blueprint_id", "type", "type_ord", "total", F.explode(levels).alias("d")).select("blueprint_id", "type", "type_ord", "total", "d.*")


@query("largest_remainder", f"SELECT blueprint_id, type, level, share FROM ({_SHARES})")
def q_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("blueprint_id", "type", "level", "share")


# configurations as JSON: automatic and manual topics, sums that fail, values out of range, and text that is no JSON
_CONFIG_JSON = """CASE WHEN o_orderkey % 41 = 0 THEN 'no json' ELSE concat('{"question_counts":{"mcq":', o_orderkey % 7, ',"true_false":', o_orderkey % 5, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat(',"short_answer":', o_orderkey % 3) END, ',"essay":', o_orderkey % 2 - CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 0 END, '}',
 CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',"difficulty_mix":{"easy":0.3,"medium":0.4,"hard":0.3}' WHEN 2 THEN ',"difficulty_mix":{"easy":0.25,"medium":0.75,"hard":0.0}' ELSE ',"difficulty_mix":{"easy":0.0,"medium":0.0,"hard":0.0}' END,
 CASE o_custkey % 5 WHEN 0 THEN ',"bloom_mix":{"apply":0.5,"create":0.5}' WHEN 1 THEN ',"bloom_mix":{"remember":0.7,"apply":0.7}' ELSE '' END,
 CASE o_orderkey % 4 WHEN 0 THEN concat(',"topic_mix":{"mode":"manual","topics":[{"topic_id":', o_custkey % 25, ',"question_count":', o_orderkey % 7 + o_orderkey % 5, '},{"topic_id":', o_custkey % 7, ',"question_count":', o_orderkey % 3, '}]}') WHEN 1 THEN concat(',"topic_mix":{"mode":"manual","topics":[{"topic_id":', o_custkey % 25, ',"question_count":', o_orderkey % 7 + o_orderkey % 5 + o_orderkey % 3 + o_orderkey % 2, '}]}') WHEN 2 THEN CASE WHEN o_custkey % 9 = 0 THEN ',"topic_mix":{"mode":"manual","topics":[]}' ELSE '' END ELSE ',"topic_mix":{"mode":"auto","topics":[]}' END,
 ',"total_points":', o_orderkey % 90, CASE WHEN o_orderkey % 3 = 0 THEN concat(',"duration_minutes":', o_orderkey % 60) ELSE '' END, '}') END"""
_CONFIG_TYPES = '{"question_counts":{' + ",".join(f'"{t}":"BIGINT"' for t in blueprints.TYPES) + '},"difficulty_mix":{' + ",".join(f'"{x}":"DOUBLE"' for x in blueprints.LEVELS) + '},"bloom_mix":{' + ",".join(f'"{x}":"DOUBLE"' for x in blueprints.BLOOM) + '},"topic_mix":{"mode":"VARCHAR","topics":[{"topic_id":"BIGINT","question_count":"BIGINT"}]},"total_points":"BIGINT","duration_minutes":"BIGINT"}'
_TYPES_SQL = ", ".join(f"('{t}', {k}, CASE WHEN c.question_counts IS NOT NULL THEN coalesce(c.question_counts.{t}, 0) END)" for k, t in enumerate(blueprints.TYPES))
_LEVELS_SQL = ", ".join(f"('{x}', {k}, coalesce(c.difficulty_mix.{x}, {w}))" for k, (x, w) in enumerate(blueprints.DEFAULT_MIX.items()))
_DECODED = f"cf AS (SELECT blueprint_id, from_json(config, '{_CONFIG_TYPES}') AS c FROM (SELECT o_orderkey AS blueprint_id, CASE WHEN x = 'no json' THEN NULL ELSE x::JSON END AS config FROM (SELECT o_orderkey, {_CONFIG_JSON} AS x FROM orders)))"


def _apportioned(rows: str, group: str, weight: str, order: str) -> str:
    """The largest-remainder shares of rows with a total."""
    raw = f"SELECT *, CASE WHEN sum({weight}) OVER (PARTITION BY {group}) > 0 THEN total * {weight} / (sum({weight}) OVER (PARTITION BY {group}))::DOUBLE ELSE 0 END AS raw, sum({weight}) OVER (PARTITION BY {group}) AS al FROM {rows}"
    return f"SELECT *, fl + CASE WHEN al > 0 AND row_number() OVER (PARTITION BY {group} ORDER BY round(raw - fl, 9) DESC, {order}) <= total - sum(fl) OVER (PARTITION BY {group}) THEN 1 ELSE 0 END AS share FROM (SELECT *, floor(raw)::BIGINT AS fl FROM ({raw}))"


_EXPANDED = f"""{_DECODED},
tn AS (SELECT blueprint_id, c, unnest(CASE WHEN coalesce(c.topic_mix.mode, 'auto') = 'manual' THEN list_transform(coalesce(c.topic_mix.topics, []), lambda t, i: struct_pack(no := i - 1, topic_id := t.topic_id, n := t.question_count)) ELSE [struct_pack(no := 0, topic_id := NULL::BIGINT, n := NULL::BIGINT)] END) AS t FROM cf),
ty AS (SELECT blueprint_id, c, t.no AS topic_no, t.topic_id AS topic_id, t.n AS n, coalesce(t.n, 0) AS total, y.type, y.type_ord, y.asked FROM tn, LATERAL (VALUES {_TYPES_SQL}) AS y(type, type_ord, asked) WHERE y.asked > 0),
ts AS ({_apportioned('ty', 'blueprint_id, topic_no', 'asked', 'type_ord')}),
lv AS (SELECT blueprint_id, topic_no, topic_id, type, CASE WHEN n IS NULL THEN asked ELSE share END AS total, l.level, l.level_ord, l.w FROM ts, LATERAL (VALUES {_LEVELS_SQL}) AS l(level, level_ord, w)),
ex AS (SELECT * FROM ({_apportioned('lv', 'blueprint_id, topic_no, type', 'w', 'level_ord')}) WHERE share > 0)"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprints.parsed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("blueprint_id"), F.expr(_CONFIG_JSON).alias("config_json")))


@query("blueprint_expand", f"WITH {_EXPANDED} SELECT blueprint_id, topic_no, topic_id, type, level, share::BIGINT AS share FROM ex")
def blueprint_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of automatic and manual blueprints."""
    return blueprints.expand(_configs(spark, sf_dir)).withColumn("topic_no", F.col("topic_no").cast("long"))


@query("slot_explode", f"WITH {_EXPANDED} SELECT blueprint_id, topic_no, type, level, unnest(range(1, share::BIGINT + 1)) AS item FROM ex")
def slot_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprint_expand(spark, sf_dir).select("blueprint_id", "topic_no", "type", "level", F.explode(F.sequence(F.lit(1).cast("long"), "share")).alias("item"))


@query("ceil_div", "SELECT o_orderkey, cast(ceil((o_orderkey % 17) / 4.0) AS BIGINT) AS per_type FROM orders")
def ceil_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ceil((F.col("o_orderkey") % 17) / 4.0).alias("per_type"))


@query("practice_plan", "SELECT o_orderkey, t AS topic, per_type, cast(ceil(per_type / 3.0) AS BIGINT) AS per_topic FROM (SELECT o_orderkey, cast(ceil((o_orderkey % 17) / 4.0) AS BIGINT) AS per_type, unnest(range(3)) AS t FROM orders) WHERE per_type > 0")
def practice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ceilings twice, so that a plan can overshoot."""
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.ceil((F.col("o_orderkey") % 17) / 4.0).alias("per_type"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("topic"))
    return each.where("per_type > 0").select("o_orderkey", "topic", "per_type", F.ceil(F.col("per_type") / 3.0).alias("per_topic"))


_MIX_SUM = " + ".join(f"coalesce(c.difficulty_mix.{x}, {w})" for x, w in blueprints.DEFAULT_MIX.items())
_BLOOM_SUM = " + ".join(f"coalesce(c.bloom_mix.{x}, 0)" for x in blueprints.BLOOM)
_TOTAL = "CASE WHEN c.question_counts IS NOT NULL THEN " + " + ".join(f"coalesce(c.question_counts.{t}, 0)" for t in blueprints.TYPES) + " END"
_OUT_OF_RANGE = " OR ".join([f"c.question_counts.{t} < 0" for t in blueprints.TYPES] + [f"c.difficulty_mix.{x} NOT BETWEEN 0 AND 1" for x in blueprints.LEVELS] + [f"c.bloom_mix.{x} NOT BETWEEN 0 AND 1" for x in blueprints.BLOOM] + ["len(list_filter(c.topic_mix.topics, lambda t: t.topic_id IS NULL OR coalesce(t.question_count, 0) < 1)) > 0"])


@query("config_validation", f"""WITH {_DECODED} SELECT blueprint_id, concat_ws(',', CASE WHEN coalesce({_TOTAL}, 0) < 1 THEN 'no_questions' END, CASE WHEN {_OUT_OF_RANGE} THEN 'ranges' END, CASE WHEN round({_MIX_SUM}, 9) NOT BETWEEN 0.99 AND 1.01 THEN 'difficulty_sum' END,
CASE WHEN c.bloom_mix IS NOT NULL AND round({_BLOOM_SUM}, 9) NOT BETWEEN 0.99 AND 1.01 THEN 'bloom_sum' END, CASE WHEN coalesce(c.topic_mix.mode, 'auto') NOT IN ('auto', 'manual') THEN 'topic_mode' END, CASE WHEN c.topic_mix.mode = 'manual' AND coalesce(len(c.topic_mix.topics), 0) = 0 THEN 'manual_topics' END,
CASE WHEN c.topic_mix.mode = 'manual' AND len(c.topic_mix.topics) > 0 AND list_sum(list_transform(c.topic_mix.topics, lambda t: t.question_count)) <> {_TOTAL} THEN 'manual_total' END, CASE WHEN coalesce(c.total_points, 100) < 1 THEN 'points' END, CASE WHEN c.duration_minutes < 5 THEN 'duration' END) AS reasons FROM cf""")
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for a rejection of a blueprint's configuration; none: accepted."""
    return blueprints.reasons(_configs(spark, sf_dir))


_CONFIG = "'{\"counts\":{\"mcq\":' || (o_orderkey % 7) || ',\"essay\":' || (o_orderkey % 3) || '},\"total_points\":' || (o_orderkey % 90) || '}'"
CONFIG_SCHEMA = "struct<counts: struct<mcq: bigint, essay: bigint>, total_points: bigint>"


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"counts":{"mcq":'), (k % 7).cast("string"), F.lit(',"essay":'), (k % 3).cast("string"), F.lit('},"total_points":'), (k % 90).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("config_json"))


@query("json_config_decode", f"SELECT o_orderkey, (c->'counts'->>'mcq')::BIGINT AS mcq, (c->'counts'->>'essay')::BIGINT AS essay, (c->>'total_points')::BIGINT AS total_points FROM (SELECT o_orderkey, ({_CONFIG})::JSON AS c FROM orders)")
def json_config_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _config(spark, sf_dir).select("o_orderkey", F.from_json("config_json", CONFIG_SCHEMA).alias("c"))
    return c.select("o_orderkey", "c.counts.mcq", "c.counts.essay", "c.total_points")


@query("json_list_projection", f"SELECT o_orderkey, (c->'counts'->>'mcq')::BIGINT + (c->'counts'->>'essay')::BIGINT AS total_questions, (c->>'total_points')::BIGINT AS total_points FROM (SELECT o_orderkey, ({_CONFIG})::JSON AS c FROM orders)")
def json_list_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = json_config_decode(spark, sf_dir)
    return d.select("o_orderkey", (F.col("mcq") + F.col("essay")).alias("total_questions"), "total_points")


@query("json_config_encode", f"SELECT o_orderkey, {_CONFIG} AS config_json FROM orders")
def json_config_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _config(spark, sf_dir).select("o_orderkey", F.from_json("config_json", CONFIG_SCHEMA).alias("c"))
    return c.select("o_orderkey", F.to_json("c").alias("config_json"))


def repair_json(text: Column, schema: str) -> Column:
    """Parse as it is, then without code fences, then the outermost braces; null if all fail."""
    strict = {"mode": "PERMISSIVE"}
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.from_json(t, schema, strict) for t in (text, fenced, braces)]
    first = lambda parsed: F.when(F.coalesce(*(parsed[f] for f in ("counts",))).isNotNull(), parsed)
    return F.coalesce(*map(first, tries))


@query("json_repair", f"SELECT o_orderkey, (c->'counts'->>'mcq')::BIGINT AS mcq FROM (SELECT o_orderkey, ({_CONFIG})::JSON AS c FROM orders)")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of models: plain, in a code fence, or with words around."""
    k = F.col("o_orderkey") % 3
    reply = F.when(k == 0, F.col("config_json")).when(k == 1, F.concat(F.lit("```json\n"), "config_json", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "config_json", F.lit(" Done.")))
    return _config(spark, sf_dir).select("o_orderkey", repair_json(reply, CONFIG_SCHEMA)["counts"]["mcq"].alias("mcq"))


@query("enum_parse_default", "SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'hard' WHEN '2-high' THEN 'hard' WHEN '5-low' THEN 'easy' ELSE 'medium' END AS level FROM orders")
def enum_parse_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lower(F.trim("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(p.isin("1-urgent", "2-high"), "hard").when(p == "5-low", "easy").otherwise("medium").alias("level"))


_OPT_NORM = "trim(regexp_replace(regexp_replace(" + strip("lower(text)") + ", '^\\.+|\\.+$', '', 'g'), '\\s+', ' ', 'g'))"
_CHECKED = f"SELECT question_id, count(*) AS n, count_if(is_correct) AS c, count(*) - count(DISTINCT {_OPT_NORM}) AS dup, count_if({_OPT_NORM} IN ({', '.join(repr(x) for x in validators.CATCH_ALL)})) AS ca, max(length(text)) > 3 * avg(length(text)) AS outlier FROM options GROUP BY 1"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validators.option_facts(options(spark, sf_dir))


@query("validate_distractors", with_sql("stems options", f"SELECT question_id, CASE WHEN n <> 4 OR c <> 1 OR dup > 0 THEN 'fail' WHEN ca > 0 OR outlier THEN 'warn' ELSE 'pass' END AS outcome, CASE WHEN n <> 4 OR c <> 1 OR dup > 0 THEN 0.0 WHEN ca > 0 OR outlier THEN 0.5 ELSE 1.0 END AS score, n AS option_count, c AS correct_count FROM ({_CHECKED})"))
def validate_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = validators.option_outcome()
    score = F.when(outcome == "fail", 0.0).when(outcome == "warn", 0.5).otherwise(1.0)
    return _checked(spark, sf_dir).select("question_id", outcome.alias("outcome"), score.alias("score"), F.col("n").alias("option_count"), F.col("c").alias("correct_count"))


@query("length_outlier", with_sql("stems options", "SELECT question_id, arg_min(label, k) AS label FROM (SELECT *, max(length(text)) OVER w AS m, avg(length(text)) OVER w AS a FROM options WINDOW w AS (PARTITION BY question_id)) WHERE length(text) = m AND m > 3 * a GROUP BY 1"))
def length_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the longest options, if it is over three times the mean."""
    best = F.min_by(F.struct("label", F.length("text").alias("m")), F.struct((-F.length("text")).alias("l"), F.col("k")))
    return options(spark, sf_dir).groupBy("question_id").agg(best.alias("b"), F.avg(F.length("text")).alias("a")).where("b.m > 3 * a").select("question_id", "b.label")


@query("mcq_structure", with_sql("stems options", "SELECT question_id, length(trim(any_value(stem))) > 0 AND count(*) = 4 AND string_agg(label, '' ORDER BY label) = 'ABCD' AND count_if(is_correct) = 1 AS ok FROM options JOIN stems USING (question_id) GROUP BY 1"))
def mcq_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = options(spark, sf_dir).groupBy("question_id").agg(F.collect_list(F.struct("label", "is_correct")).alias("o"))
    joined = stems(spark, sf_dir).join(own, "question_id")
    keys = F.array_sort(F.transform("o", lambda x: x["label"])) == F.array(*map(F.lit, "ABCD"))
    one = F.size(F.filter("o", lambda x: x["is_correct"])) == 1
    return joined.select("question_id", ((F.length(F.trim("stem")) > 0) & (F.size("o") == 4) & keys & one).alias("ok"))


@query("array_first_match", with_sql("stems options", "SELECT question_id, coalesce(min(CASE WHEN is_correct THEN label END), '?') AS answer FROM options GROUP BY 1"))
def array_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = options(spark, sf_dir).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("k", "label", "is_correct"))).alias("o"))
    return own.select("question_id", F.coalesce(F.get(F.filter("o", lambda x: x["is_correct"]), F.lit(0))["label"], F.lit("?")).alias("answer"))


@query("array_join_text", with_sql("stems options", "SELECT question_id, string_agg(label || ') ' || text, chr(10) ORDER BY k) AS listing FROM options GROUP BY 1"))
def array_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = options(spark, sf_dir).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("k", "label", "text"))).alias("o"))
    return own.select("question_id", F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit(") "), x["text"])), "\n").alias("listing"))


@query("array_slice_first_n", with_sql("topic_map", "SELECT topic_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY chunk_id) AS r FROM topic_map) WHERE r <= 3 GROUP BY 1"))
def array_slice_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("chunk_id"))
    top = topic_map(spark, sf_dir).withColumn("r", rank).where("r <= 3").groupBy("topic_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return top.select("topic_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("first_ids"))


_GROUND = "SELECT question_id, count(c) AS sources, count(CASE WHEN c % 3 <> 0 THEN 1 END) AS linked FROM (SELECT q.question_id, m.chunk_id AS c FROM stems q LEFT JOIN topic_map m ON m.topic_id = q.set_id AND m.score > 0.9) GROUP BY 1"


@query("validate_grounding", with_sql("stems topic_map", f"SELECT question_id, CASE WHEN sources = 0 THEN 'fail' WHEN linked = 0 THEN 'warn' ELSE 'pass' END AS outcome, CASE WHEN sources = 0 THEN 0.0 WHEN linked = 0 THEN 0.5 ELSE 1.0 END AS score FROM ({_GROUND})"))
def validate_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No sources fail; sources without a chunk warn."""
    sources = topic_map(spark, sf_dir).where("score > 0.9").groupBy(F.col("topic_id").alias("set_id")).agg(F.count("*").alias("sources"), F.count_if(F.col("chunk_id") % 3 != 0).alias("linked"))
    q = stems(spark, sf_dir).join(sources, "set_id", "left").fillna(0, ["sources", "linked"])
    none, loose = F.col("sources") == 0, F.col("linked") == 0
    return q.select("question_id", F.when(none, "fail").when(loose, "warn").otherwise("pass").alias("outcome"), F.when(none, 0.0).when(loose, 0.5).otherwise(1.0).alias("score"))


query("validate_grounding_batch", with_sql("stems topic_map", f"SELECT question_id, CASE WHEN sources = 0 THEN 'fail' WHEN linked = 0 THEN 'warn' ELSE 'pass' END AS outcome, CASE WHEN sources = 0 THEN 0.0 WHEN linked = 0 THEN 0.5 ELSE 1.0 END AS score FROM ({_GROUND})"))(validate_grounding)

_VERDICT = "CASE question_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'ambiguous' ELSE 'error' END"


@query("verify_tf", with_sql("stems", f"SELECT question_id, CASE v WHEN 'incorrect' THEN CASE WHEN conf >= 0.8 THEN 'flip' ELSE 'keep' END WHEN 'ambiguous' THEN 'reject' ELSE 'keep' END AS decision FROM (SELECT question_id, {_VERDICT} AS v, (question_id % 10) / 10.0 AS conf FROM stems)"))
def verify_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confident contrary verdict flips, an ambiguous one rejects, and errors keep."""
    q = stems(spark, sf_dir).select("question_id", F.expr(_VERDICT).alias("v"), ((F.col("question_id") % 10) / 10.0).alias("conf"))
    flip = (F.col("v") == "incorrect") & (F.col("conf") >= 0.8)
    return q.select("question_id", F.when(flip, "flip").when(F.col("v") == "ambiguous", "reject").otherwise("keep").alias("decision"))


@query("persist_correctness", with_sql("stems", f"SELECT question_id, CASE v WHEN 'correct' THEN 1.0 WHEN 'ambiguous' THEN 0.5 WHEN 'incorrect' THEN 0.0 END AS score FROM (SELECT question_id, {_VERDICT} AS v FROM stems)"))
def persist_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.create_map(*(F.lit(x) for x in ("correct", 1.0, "ambiguous", 0.5, "incorrect", 0.0)))
    return stems(spark, sf_dir).select("question_id", scores[F.expr(_VERDICT)].alias("score"))


query("map_lookup", with_sql("stems", f"SELECT question_id, CASE v WHEN 'correct' THEN 1.0 WHEN 'ambiguous' THEN 0.5 WHEN 'incorrect' THEN 0.0 END AS score FROM (SELECT question_id, {_VERDICT} AS v FROM stems)"))(persist_correctness)


@query("validate_triviality", with_sql("stems", "SELECT question_id, CASE WHEN NOT t THEN 'pass' WHEN difficulty = 'easy' OR bloom = 'remember' THEN 'warn' ELSE 'fail' END AS outcome FROM (SELECT *, regexp_matches(lower(trim(stem)), " + literal("|".join(rules.TRIVIAL)) + ") AS t FROM stems)"))
def validate_triviality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.functions.rules import is_trivial

    wanted = (F.col("difficulty") == "easy") | (F.col("bloom") == "remember")
    return stems(spark, sf_dir).select("question_id", F.when(~is_trivial(F.col("stem")), "pass").when(wanted, "warn").otherwise("fail").alias("outcome"))


_SOURCED = "SELECT q.question_id, CASE WHEN m.chunk_id % 3 <> 0 THEN m.chunk_id END AS chunk_id FROM stems q JOIN topic_map m ON m.topic_id = q.set_id AND m.score > 0.9"
_GATE = "SELECT question_id, '{0}' AS validation_type, 'ok' AS status, outcome <> 'fail' AS passed, CASE outcome WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, outcome FROM ({1})"
VALIDATIONS_SQL = " UNION ALL ".join([
    _GATE.format("grounding", "SELECT question_id, CASE WHEN count(s) = 0 THEN 'fail' WHEN count(c) = 0 THEN 'warn' ELSE 'pass' END AS outcome FROM (SELECT q.question_id, x.question_id AS s, x.chunk_id AS c FROM stems q LEFT JOIN (" + _SOURCED + ") x USING (question_id)) GROUP BY 1"),
    _GATE.format("distractor", f"SELECT question_id, CASE WHEN n <> 4 OR c <> 1 OR dup > 0 THEN 'fail' WHEN ca > 0 OR outlier THEN 'warn' ELSE 'pass' END AS outcome FROM ({_CHECKED})"),
    f"SELECT question_id, 'difficulty', 'ok', true, (CASE WHEN {TRIVIAL_SQL} AND level <> 'easy' THEN greatest(confidence, 0.55) ELSE confidence END)::DOUBLE, CASE WHEN {TRIVIAL_SQL} THEN 'easy' ELSE level END FROM ({DIFFICULTY_SQL})",
    f"SELECT question_id, 'bloom', 'ok', true, (CASE WHEN raised THEN greatest(conf, 0.55) ELSE conf END)::DOUBLE, CASE WHEN raised THEN 'understand' ELSE b END FROM (SELECT *, {TRIVIAL_SQL} AND b NOT IN ('remember', 'understand') AS raised, CASE WHEN v IS NULL THEN 0.40 ELSE 0.65 END AS conf FROM (SELECT *, {BLOOM_SQL} AS b, {VERB_SQL} AS v FROM (SELECT *, {CLAUSE_SQL} AS c FROM stems)))",
    _GATE.format("triviality", f"SELECT question_id, CASE WHEN NOT {TRIVIAL_SQL} THEN 'pass' WHEN difficulty = 'easy' OR bloom = 'remember' THEN 'warn' ELSE 'fail' END AS outcome FROM stems"),
    f"SELECT question_id, 'correctness', 'ok', v <> 'ambiguous', (CASE v WHEN 'correct' THEN 1.0 WHEN 'incorrect' THEN 0.0 ELSE 0.5 END)::DOUBLE, v FROM (SELECT question_id, {_VERDICT} AS v FROM stems WHERE type IN ('mcq', 'true_false') AND question_id % 7 <> 0)",
])


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds; the checking model was asked about six of seven questions."""
    q = stems(spark, sf_dir)
    sources = topic_map(spark, sf_dir).where("score > 0.9").select(F.col("topic_id").alias("set_id"), F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id")).alias("chunk_id")).join(q.select("question_id", "set_id"), "set_id")
    verdict = F.expr(_VERDICT)
    verdicts = q.where("question_id % 7 <> 0").select("question_id", verdict.alias("verdict"), (verdict == "ambiguous").alias("rejects"))
    kinds = [validators.grounding(sources), validators.distractors(options(spark, sf_dir)), validators.difficulty(), validators.bloom(), validators.triviality(), validators.correctness(verdicts)]
    return validators.run_validators(q, kinds)


@query("validators_run", with_sql("stems options topic_map", VALIDATIONS_SQL))
def validators_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the validators, one after the other."""
    return _validated(spark, sf_dir).drop("detail")


_ACTION = "CASE WHEN question_id % 2 = 0 THEN 'approved' ELSE 'rejected' END"
_REASON = "CASE question_id % 5 WHEN 1 THEN 'off topic' WHEN 3 THEN ' ' END"
_PRINT = "lower(trim(regexp_replace(stem, '\\s+', ' ', 'g')))"


@query("question_transitions", with_sql("stems", f"SELECT question_id, a AS action, CASE WHEN a = status THEN 'conflict' ELSE 'ok' END AS result, CASE WHEN a = status THEN status ELSE a END AS new_status, CASE WHEN a <> status AND a = 'rejected' AND trim(r) <> '' THEN trim(r) END AS explanation, a <> status AND a = 'rejected' AS blacklists FROM (SELECT *, {_ACTION} AS a, {_REASON} AS r FROM stems)"))
def question_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approving an approved question, or rejecting a rejected one, is a conflict; a rejection takes its reason down and goes to the blacklist."""
    q = stems(spark, sf_dir).withColumns({"a": F.expr(_ACTION), "r": F.trim(F.expr(_REASON))})
    same = F.col("a") == F.col("status")
    rejects = ~same & (F.col("a") == "rejected")
    return q.select("question_id", F.col("a").alias("action"), F.when(same, "conflict").otherwise("ok").alias("result"), F.when(same, F.col("status")).otherwise(F.col("a")).alias("new_status"), F.when(rejects & (F.col("r") != ""), F.col("r")).alias("explanation"), rejects.alias("blacklists"))


@query("blacklist_on_reject", with_sql("stems", f"SELECT course_id, md5({_PRINT}) AS fingerprint, min(question_id) AS question_id, count(*) AS n FROM stems WHERE status <> 'rejected' AND ({_ACTION}) = 'rejected' AND {_PRINT} <> '' GROUP BY 1, 2"))
def blacklist_on_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rejections add to a course's blacklist: each fingerprint once, by its first question."""
    rejected = question_transitions(spark, sf_dir).where("blacklists").select("question_id")
    print_ = F.lower(F.trim(F.regexp_replace("stem", r"\s+", " ")))
    q = stems(spark, sf_dir).join(rejected, "question_id", "left_semi").where(print_ != "")
    return q.groupBy("course_id", F.md5(print_).alias("fingerprint")).agg(F.min("question_id").alias("question_id"), F.count("*").alias("n"))


# option edits: new text for one option, a new key for some questions, and two keys (an error) for others
_EDITS = "CASE WHEN question_id % 3 = 0 AND k = 1 THEN concat('New ', text) END AS new_text, CASE question_id % 4 WHEN 0 THEN k = 2 WHEN 1 THEN k >= 2 END AS new_key"


@query("question_patch", with_sql("stems options", f"""SELECT question_id, coalesce(p, stem) AS stem, result, CASE WHEN result = 'ok' AND (p IS NOT NULL OR edited) AND status = 'rejected' THEN 'reviewed' ELSE status END AS status, CASE WHEN result = 'ok' THEN edited_options END AS options
FROM (SELECT *, CASE WHEN question_id % 3 = 0 THEN 'New ' || stem END AS p FROM stems) JOIN (SELECT question_id, CASE WHEN count_if(ck) = 1 OR NOT bool_or(new_key IS NOT NULL) THEN 'ok' ELSE 'one_correct' END AS result, bool_or(new_text IS NOT NULL OR new_key IS NOT NULL) AS edited, string_agg(concat(label, CASE WHEN ck THEN '*' ELSE '' END, ') ', coalesce(new_text, text)), chr(10) ORDER BY k) AS edited_options FROM (SELECT *, coalesce(new_key, is_correct) AS ck FROM (SELECT *, {_EDITS} FROM options)) GROUP BY 1) USING (question_id)"""))
def question_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only given fields change; options that would have other than one key are refused; edited content takes a rejected question back to review."""
    edits = options(spark, sf_dir).select("*", *(F.expr(x) for x in _EDITS.replace(", CASE question_id", "|CASE question_id").split("|")))
    keyed = edits.withColumn("ck", F.coalesce("new_key", "is_correct"))
    rows = F.array_sort(F.collect_list(F.struct("k", "label", "ck", F.coalesce("new_text", "text").alias("t"))))
    own = keyed.groupBy("question_id").agg(F.count_if("ck").alias("keys"), F.bool_or(F.col("new_key").isNotNull()).alias("rekeyed"), F.bool_or(F.col("new_key").isNotNull() | F.col("new_text").isNotNull()).alias("edited"), rows.alias("o"))
    listing = F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.when(x["ck"], "*").otherwise(""), F.lit(") "), x["t"])), "\n")
    ok = (F.col("keys") == 1) | ~F.col("rekeyed")
    q = stems(spark, sf_dir).withColumn("p", F.when(F.col("question_id") % 3 == 0, F.concat(F.lit("New "), "stem"))).join(own, "question_id")
    back = ok & (F.col("p").isNotNull() | F.col("edited")) & (F.col("status") == "rejected")
    return q.select("question_id", F.coalesce("p", "stem").alias("stem"), F.when(ok, "ok").otherwise("one_correct").alias("result"), F.when(back, "reviewed").otherwise(F.col("status")).alias("status"), F.when(ok, listing).alias("options"))


@query("replacement_candidates", with_sql("stems", "SELECT type, question_id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY question_id DESC) AS r FROM stems WHERE status = 'approved' AND question_id NOT IN (SELECT question_id FROM stems WHERE blueprint_id = 2)) WHERE r <= 100"))
def replacement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stems(spark, sf_dir)
    free = q.where("status = 'approved'").join(q.where("blueprint_id = 2").select("question_id"), "question_id", "left_anti")
    return free.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("question_id")))).where("r <= 100").select("type", "question_id")


@query("blueprint_replace", with_sql("stems", "SELECT a.question_id AS old_id, b.question_id AS new_id, CASE WHEN a.blueprint_id IS NULL THEN 'not_mapped' WHEN b.status <> 'approved' THEN 'not_approved' WHEN a.type <> b.type THEN 'other_type' WHEN b.blueprint_id = a.blueprint_id THEN 'present' ELSE 'ok' END AS verdict FROM stems a JOIN stems b ON b.question_id = a.question_id + 400"))
def blueprint_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules in their order; the first that is broken names the verdict."""
    q = stems(spark, sf_dir)
    a, b = q.alias("a"), q.withColumn("key", F.col("question_id") - 400).alias("b")
    verdict = F.when(F.col("a.blueprint_id").isNull(), "not_mapped").when(F.col("b.status") != "approved", "not_approved").when(F.col("a.type") != F.col("b.type"), "other_type").when(F.col("b.blueprint_id") == F.col("a.blueprint_id"), "present").otherwise("ok")
    return a.join(b, F.col("a.question_id") == F.col("b.key")).select(F.col("a.question_id").alias("old_id"), F.col("b.question_id").alias("new_id"), verdict.alias("verdict"))


@query("course_delete", with_sql("stems options", "SELECT question_id, label FROM options WHERE question_id IN (SELECT question_id FROM stems WHERE course_id <> 2)"))
def course_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the options after a course goes with all that hangs on it."""
    gone = stems(spark, sf_dir).where("course_id = 2").select("question_id")
    return options(spark, sf_dir).join(gone, "question_id", "left_anti").select("question_id", "label")


@query("blueprint_delete_cascade", with_sql("stems", "SELECT question_id, CASE WHEN blueprint_id = 4 THEN NULL ELSE blueprint_id END AS blueprint_id FROM stems"))
def blueprint_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", F.nullif("blueprint_id", F.lit(4)).alias("blueprint_id"))


@query("document_delete", with_sql("topic_map", "SELECT topic_id, chunk_id FROM topic_map WHERE chunk_id % 10 <> 3"))
def document_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").alias("chunk_id"))
    return topic_map(spark, sf_dir).join(gone, "chunk_id", "left_anti").select("topic_id", "chunk_id")


@query("exam_move", "SELECT l_orderkey AS exam_id, l_partkey AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE r WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE r END) AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem)")
def exam_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap the second and third slot and number anew."""
    own = Window.partitionBy("l_orderkey")
    r = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(own.orderBy("l_linenumber", "l_partkey")))
    place = F.when(F.col("r") == 2, 3).when(F.col("r") == 3, 2).otherwise(F.col("r"))
    return r.select(F.col("l_orderkey").alias("exam_id"), F.col("l_partkey").alias("question_id"), F.row_number().over(own.orderBy(place)).alias("position"))


# orders of exams: the questions backwards, with one place given twice, one question of another exam, or one place left out
_NEW_PLACE = "CASE l_orderkey % 5 WHEN 0 THEN greatest(l_linenumber, 2) WHEN 2 THEN 20 - 2 * l_linenumber ELSE 8 - l_linenumber END"
_NAMED = "CASE WHEN l_orderkey % 5 = 1 AND l_linenumber = 1 THEN -1 ELSE l_partkey END"


@query("exam_reorder", f"""WITH s AS (SELECT l_orderkey AS exam_id, l_partkey AS question_id, l_linenumber AS place, {_NAMED} AS named, {_NEW_PLACE} AS wanted FROM lineitem),
v AS (SELECT exam_id, CASE WHEN bool_or(named <> question_id) THEN 'foreign' WHEN count(*) <> count(DISTINCT wanted) THEN 'duplicate' WHEN min(wanted) < 1 THEN 'place' ELSE 'ok' END AS result FROM s GROUP BY 1)
SELECT exam_id, question_id, result, row_number() OVER (PARTITION BY exam_id ORDER BY CASE WHEN result = 'ok' THEN wanted ELSE place END, place, question_id) AS position FROM s JOIN v USING (exam_id)""")
def exam_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders with foreign questions or a place given twice change nothing; accepted ones are closed up from 1."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), F.col("l_partkey").alias("question_id"), F.col("l_linenumber").alias("place"), F.expr(_NAMED).alias("named"), F.expr(_NEW_PLACE).alias("wanted"))
    own = Window.partitionBy("exam_id")
    faults = s.groupBy("exam_id").agg(F.bool_or(F.col("named") != F.col("question_id")).alias("foreign"), (F.count("*") != F.count_distinct("wanted")).alias("twice"), F.min("wanted").alias("least"))
    result = F.when(F.col("foreign"), "foreign").when(F.col("twice"), "duplicate").when(F.col("least") < 1, "place").otherwise("ok")
    both = s.join(faults.select("exam_id", result.alias("result")), "exam_id")
    order = F.when(F.col("result") == "ok", F.col("wanted")).otherwise(F.col("place"))
    return both.select("exam_id", "question_id", "result", F.row_number().over(own.orderBy(order, "place", "question_id")).alias("position"))


_BEFORE_EXPORT = "SELECT *, question_id // 100 AS exam_id FROM stems"
_EXPORT_SQL = f"""SELECT exam_id, string_agg(concat('\\item ', body, CASE WHEN type = 'mcq' THEN coalesce(chr(10) || o, '') WHEN type = 'true_false' THEN chr(10) || 'True / False' WHEN type = 'short_answer' THEN chr(10) || '\\vspace{{3cm}}' ELSE chr(10) || '\\vspace{{8cm}}' END), chr(10) ORDER BY {ordinal_sql("type", "question_type")}, question_id) AS paper,
string_agg(concat('\\textbf{{Question ', position, '.}} ', CASE WHEN type = 'mcq' THEN coalesce(good, 'N/A') WHEN type = 'true_false' THEN CASE WHEN question_id % 2 = 0 THEN 'True' ELSE 'False' END WHEN type = 'short_answer' THEN concat('Model answer: ', body[:40]) ELSE 'Key points: See explanation.' END), chr(10) ORDER BY position) AS answers
FROM (SELECT q.*, o.o, o.good, {tex_sql("stem")} AS body, row_number() OVER (PARTITION BY exam_id ORDER BY {ordinal_sql("type", "question_type")}, question_id) AS position FROM ({_BEFORE_EXPORT}) q
LEFT JOIN (SELECT question_id, string_agg(label || ') ' || {tex_sql("text")}, chr(10) ORDER BY k) AS o, min(CASE WHEN is_correct THEN label || ') ' || {tex_sql("text")} END) AS good FROM options GROUP BY 1) o USING (question_id)) GROUP BY 1"""


@query("export_render", with_sql("stems options", _EXPORT_SQL))
def export_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper and the answer key of each exam (the questions of a conversation), escaped, by type and number."""
    escape = lambda x: notation.escape_tex(F.col(x))
    line = F.concat("label", F.lit(") "), escape("text"))
    own = options(spark, sf_dir).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("s")))).alias("o"), F.min(F.when(F.col("is_correct"), line)).alias("right"))
    q = stems(spark, sf_dir).withColumn("exam_id", F.floor(F.col("question_id") / 100)).join(own, "question_id", "left").withColumn("body", escape("stem"))
    q = q.withColumn("position", F.row_number().over(Window.partitionBy("exam_id").orderBy(ordinal(F.col("type"), "question_type"), "question_id")))
    kind = F.col("type")
    space = F.when(kind == "mcq", F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("o", lambda x: x["s"]), "\n")), F.lit(""))).when(kind == "true_false", "\nTrue / False").when(kind == "short_answer", "\n\\vspace{3cm}").otherwise("\n\\vspace{8cm}")
    answer = F.when(kind == "mcq", F.coalesce("right", F.lit("N/A"))).when(kind == "true_false", F.when(F.col("question_id") % 2 == 0, "True").otherwise("False")).when(kind == "short_answer", F.concat(F.lit("Model answer: "), F.substring("body", 1, 40))).otherwise("Key points: See explanation.")
    item = F.struct("position", F.concat(F.lit("\\item "), "body", space).alias("paper"), F.concat(F.lit("\\textbf{Question "), F.col("position").cast("string"), F.lit(".} "), answer).alias("answer"))
    rows = q.groupBy("exam_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # an exam's own questions
    joined = lambda name: F.array_join(F.transform("items", lambda x: x[name]), "\n")
    return rows.select("exam_id", joined("paper").alias("paper"), joined("answer").alias("answers"))


@query("prompt_render", with_sql("stems", "SELECT question_id, concat('Topic: ', set_id, chr(10), 'Difficulty: ', difficulty, chr(10), CASE WHEN bloom <> 'create' THEN concat('Level: ', bloom, chr(10)) ELSE '' END, stem) AS prompt FROM stems"))
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("bloom") != "create", F.concat(F.lit("Level: "), "bloom", F.lit("\n"))).otherwise("")
    return stems(spark, sf_dir).select("question_id", F.concat(F.lit("Topic: "), F.col("set_id").cast("string"), F.lit("\nDifficulty: "), "difficulty", F.lit("\n"), level, "stem").alias("prompt"))


@query("persist_sources", with_sql("stems topic_map", "SELECT question_id, chunk_id FROM stems JOIN topic_map ON topic_id = set_id WHERE score > 0.9"))
def persist_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = topic_map(spark, sf_dir).where("score > 0.9").select(F.col("topic_id").alias("set_id"), "chunk_id")
    return stems(spark, sf_dir).join(m, "set_id").select("question_id", "chunk_id")


# attempts of a job: each question used a chunk and belongs to a slot; rejected ones have a reason
_ATTEMPTS = {"slot": "question_id // 100 % 3", "chunk_id": "question_id % 37", "generated": "status <> 'rejected'", "reason": "CASE WHEN status = 'rejected' THEN concat('question ', question_id, ': ', CASE WHEN question_id % 2 = 0 THEN 'blacklisted' ELSE 'near duplicate' END) END"}
_JOB_SQL = f"""ta AS (SELECT set_id, question_id, {", ".join(f"{e} AS {n}" for n, e in _ATTEMPTS.items())}, {TRIVIAL_SQL} AS trivial FROM stems),
js AS (SELECT set_id, count(*) AS requested, count_if(generated)::BIGINT AS generated, count_if(NOT generated)::BIGINT AS failed, count(DISTINCT chunk_id) AS unique_chunks, count_if(generated AND trivial)::BIGINT AS trivial, round(count_if(generated AND trivial) / greatest(1, count_if(generated))::DOUBLE, 2) AS trivial_fraction,
count_if(NOT generated AND question_id % 2 = 0)::BIGINT AS blacklist_avoided, count_if(NOT generated AND question_id % 2 <> 0)::BIGINT AS dedup_avoided, list(reason ORDER BY question_id) FILTER (reason IS NOT NULL) AS rs FROM ta GROUP BY 1)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {**_ATTEMPTS, "slot": "cast(floor(question_id / 100) % 3 as bigint)"}
    return stems(spark, sf_dir).select("set_id", "question_id", *(F.expr(e).alias(n) for n, e in made.items()), rules.is_trivial(F.col("stem")).alias("trivial"))


def _job_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = F.col("generated"), ~F.col("generated")
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("question_id", "reason")))), 1, 20)  # of a job's own questions
    grouped = _attempts(spark, sf_dir).groupBy("set_id").agg(
        F.count("*").alias("requested"), F.count_if(good).alias("n_good"), F.count_if(bad).alias("failed"), F.count_distinct("chunk_id").alias("unique_chunks"), F.count_if(good & F.col("trivial")).alias("n_trivial"),
        F.count_if(bad & (F.col("question_id") % 2 == 0)).alias("blacklist_avoided"), F.count_if(bad & (F.col("question_id") % 2 != 0)).alias("dedup_avoided"), first.alias("first"),
    )
    fraction = F.round(F.col("n_trivial") / F.greatest(F.lit(1), F.col("n_good")), 2)
    return grouped.select("set_id", "requested", F.col("n_good").alias("generated"), "failed", "unique_chunks", F.col("n_trivial").alias("trivial"), fraction.alias("trivial_fraction"), "blacklist_avoided", "dedup_avoided", F.transform("first", lambda x: x["reason"]).alias("reasons"))


@query("agg_job_summary", with_sql("stems", "").rstrip() + f", {_JOB_SQL} SELECT * EXCLUDE (rs), coalesce(array_to_string(rs[:20], '; '), '') AS reasons, concat(CASE WHEN generated < requested THEN 'PARTIAL — ' ELSE '' END, 'Generated ', generated, '/', requested, ' question(s).') AS message FROM js")
def agg_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job made of its questions: counts, chunks, recall questions, what memory avoided, and the first twenty reasons."""
    told = F.concat(F.when(F.col("generated") < F.col("requested"), "PARTIAL — ").otherwise(""), F.lit("Generated "), F.col("generated").cast("string"), F.lit("/"), F.col("requested").cast("string"), F.lit(" question(s)."))
    return _job_facts(spark, sf_dir).withColumn("message", told).withColumn("reasons", F.array_join("reasons", "; "))


@query("json_job_summary", with_sql("stems", "").rstrip() + f""", {_JOB_SQL}, sl AS (SELECT set_id, string_agg(concat('{{"slot":', slot, ',"requested":', r, ',"generated":', g, '}}'), ',' ORDER BY slot) AS slots FROM (SELECT set_id, slot, count(*) AS r, count_if(generated) AS g FROM ta GROUP BY 1, 2) GROUP BY 1)
SELECT set_id, concat('{{"requested":', requested, ',"generated":', generated, ',"failed":', failed, ',"failure_reasons":[', coalesce(array_to_string(list_transform(rs[:20], lambda r: concat('"', r, '"')), ','), ''), '],"unique_chunks_used":', unique_chunks, ',"trivial_questions":', trivial, ',"trivial_fraction":', trivial_fraction, ',"blacklist_avoided":', blacklist_avoided, ',"cross_run_dedup_avoided":', dedup_avoided, ',"slots":[', slots, ']}}') AS summary FROM js JOIN sl USING (set_id)""")
def json_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as JSON, with what became of each slot."""
    slot = _attempts(spark, sf_dir).groupBy("set_id", "slot").agg(F.count("*").alias("requested"), F.count_if("generated").alias("generated"))
    slots = slot.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("slot", "requested", "generated"))).alias("slots"))
    names = {"reasons": "failure_reasons", "unique_chunks": "unique_chunks_used", "trivial": "trivial_questions", "trivial_fraction": "trivial_fraction", "blacklist_avoided": "blacklist_avoided", "dedup_avoided": "cross_run_dedup_avoided"}
    row = F.struct("requested", "generated", "failed", *(F.col(n).alias(m) for n, m in names.items()), "slots")
    return _job_facts(spark, sf_dir).join(slots, "set_id").select("set_id", F.to_json(row).alias("summary"))


query("json_detail_encode")(lambda spark, sf_dir: _validated(spark, sf_dir).select("question_id", "validation_type", "detail"))


@query("progress_pct", "SELECT l_orderkey, l_linenumber, cast(floor(r / n::DOUBLE * 90) AS BIGINT) AS pct FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey")
    r = table(spark, sf_dir, "lineitem").withColumns({"r": F.row_number().over(own.orderBy("l_linenumber", "l_partkey")), "n": F.count("*").over(own)})
    return r.select("l_orderkey", "l_linenumber", F.floor(F.col("r") / F.col("n") * 90).alias("pct"))


@query("seed_derive", "SELECT o_orderkey, ('0x' || right(md5(o_orderkey::VARCHAR), 8))::BIGINT AS seed, xor(('0x' || right(md5(o_orderkey::VARCHAR), 8))::BIGINT, 2 * 2654435769) AS second_seed FROM orders")
def seed_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The low 32 bits of an id, and the seed of the second attempt."""
    seed = F.conv(F.right(F.md5(F.col("o_orderkey").cast("string")), F.lit(8)), 16, 10).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", seed.alias("seed"), seed.bitwiseXOR(F.lit(2 * 2654435769)).alias("second_seed"))


@query("math_scalars", "SELECT o_orderkey, round_even(o_totalprice / 1000, 1) AS half_even, floor(o_totalprice) AS fl, ceil(o_totalprice) AS ce, least(1.0, greatest(0.0, o_totalprice / 100000)) AS clamped FROM orders")
def math_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bround(p / 1000, 1).alias("half_even"), F.floor(p).alias("fl"), F.ceil(p).alias("ce"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / 100000)).alias("clamped"))


# replies of the generating model for each set: some call their context insufficient, some hold no question, some are no JSON
_SET_REPLY = "CASE set_id % 6 WHEN 0 THEN '{\"insufficient_context\": true, \"questions\": [{\"stem\": \"x\"}]}' WHEN 1 THEN '{\"insufficient_context\": false, \"questions\": []}' WHEN 2 THEN 'no reply' WHEN 3 THEN '{\"questions\": [{\"stem\": \"x\"}]}' ELSE '{\"insufficient_context\": false, \"questions\": [{\"stem\": \"x\"}, {\"stem\": \"y\"}]}' END"


@query("grounding_gate", with_sql("stems", f"SELECT question_id, n FROM (SELECT question_id, CASE WHEN json_valid(r) THEN coalesce((r::JSON ->> 'insufficient_context')::BOOLEAN, false) END AS short, CASE WHEN json_valid(r) THEN json_array_length(r::JSON, '$.questions')::INTEGER END AS n FROM (SELECT question_id, {_SET_REPLY} AS r FROM stems)) WHERE NOT short AND n > 0"))
def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose reply calls the context insufficient, holds no question, or cannot be read are dropped whole."""
    reply = F.from_json(F.expr(_SET_REPLY), "insufficient_context boolean, questions array<struct<stem:string>>")
    q = stems(spark, sf_dir).select("question_id", reply.alias("r"))
    return q.where(~F.coalesce("r.insufficient_context", F.lit(False)) & (F.size("r.questions") > 0)).select("question_id", F.size("r.questions").alias("n"))


# verdicts of the checking model on multiple choice as it writes them, the key that it names, and the key that was claimed
_MCQ_VERDICT = {
    "raw": "CASE question_id % 6 WHEN 0 THEN 'Correct' WHEN 1 THEN ' wrong correct ' WHEN 2 THEN 'WRONG_CORRECT' WHEN 3 THEN 'multiple_correct' WHEN 4 THEN 'no idea' ELSE 'error' END",
    "named": "CASE question_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' b' WHEN 2 THEN 'E' ELSE 'A' END",
    "claimed": "CASE WHEN question_id % 2 = 0 THEN 'A' ELSE 'B' END",
    "confidence": "CASE WHEN question_id % 7 < 5 THEN 0.8 ELSE 0.6 END",
}
_MCQ_SEEN = ", ".join(f"{x} AS {name}" for name, x in _MCQ_VERDICT.items())


@query("verify_mcq", with_sql("stems", f"SELECT question_id, verdict, key, CASE WHEN verdict = 'multiple_correct' OR (verdict = 'wrong_correct' AND confidence >= 0.8 AND key <> claimed) THEN 'reject' ELSE 'keep' END AS decision FROM (SELECT question_id, claimed, confidence, CASE WHEN v IN ('correct', 'wrong_correct', 'multiple_correct', 'ambiguous', 'error') THEN v ELSE 'ambiguous' END AS verdict, CASE WHEN k IN ('A', 'B', 'C', 'D') THEN k ELSE claimed END AS key FROM (SELECT question_id, claimed, confidence, replace(trim(lower(raw)), ' ', '_') AS v, trim(upper(named)) AS k FROM (SELECT question_id, {_MCQ_SEEN} FROM stems WHERE type = 'mcq')))"))
def verify_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several right options reject, a confident other key rejects; a verdict that names the claimed key contradicts itself and keeps."""
    seen = stems(spark, sf_dir).where("type = 'mcq'").select("question_id", *(F.expr(x).alias(name) for name, x in _MCQ_VERDICT.items()))
    said, named = F.replace(F.trim(F.lower("raw")), F.lit(" "), F.lit("_")), F.trim(F.upper("named"))
    verdict = F.when(said.isin("correct", "wrong_correct", "multiple_correct", "ambiguous", "error"), said).otherwise("ambiguous")
    judged = seen.select("question_id", "claimed", "confidence", verdict.alias("verdict"), F.when(named.isin(*"ABCD"), named).otherwise(F.col("claimed")).alias("key"))
    other = (F.col("verdict") == "wrong_correct") & (F.col("confidence") >= 0.8) & (F.col("key") != F.col("claimed"))
    return judged.select("question_id", "verdict", "key", F.when(other | (F.col("verdict") == "multiple_correct"), "reject").otherwise("keep").alias("decision"))


@query("nonempty_sa", with_sql("stems", "SELECT question_id FROM stems WHERE type IN ('short_answer', 'essay') AND length(trim(stem)) > 0"))
def nonempty_sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).where(F.col("type").isin("short_answer", "essay") & (F.length(F.trim("stem")) > 0)).select("question_id")


# model calls: events as calls (user: provider, hundred times the value: tokens)
_CALLS = "SELECT event_id, user_id % 20 AS provider, ts, cast(floor(abs(value) * 100) AS BIGINT) AS tokens, event_type FROM events"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 20).alias("provider"), "ts", F.floor(F.abs("value") * 100).alias("tokens"), "event_type")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("rt_token_budget", f"SELECT event_id, sum(tokens) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)::BIGINT AS offered FROM ({_CALLS})")
def rt_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a provider was offered in the 60 seconds up to each call."""
    sliced = time_slices(_timed(spark, sf_dir), 60_000_000)
    load = F.sum("tokens").over(Window.partitionBy("provider", "slice").orderBy("us").rangeBetween(-60_000_000, 0))
    return sliced.select("event_id", "own", load.alias("offered")).where("own").drop("own")


@query("rt_circuit_breaker", f"SELECT event_id, coalesce(epoch_us(ts) - f <= 600000000, false) AS open FROM (SELECT *, max(CASE WHEN event_type = 'error' OR tokens % 7 = 0 THEN epoch_us(ts) END) OVER (PARTITION BY provider ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM ({_CALLS}))")
def rt_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that come within 600 seconds of their provider's last failure."""
    sliced = time_slices(_timed(spark, sf_dir), 600_000_000)
    before = Window.partitionBy("provider", "slice").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max(F.when((F.col("event_type") == "error") | (F.col("tokens") % 7 == 0), F.col("us"))).over(before)
    return sliced.select("event_id", "own", F.coalesce(F.col("us") - failed <= 600_000_000, F.lit(False)).alias("open")).where("own").drop("own")


@query("rt_throttle", f"SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY provider ORDER BY epoch_us(ts), event_id) < 6500000, false) AS too_soon FROM ({_CALLS})")
def rt_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = time_slices(_timed(spark, sf_dir), 6_500_000)
    last = F.lag("us").over(Window.partitionBy("provider", "slice").orderBy("us", "event_id"))
    return sliced.select("event_id", "own", F.coalesce(F.col("us") - last < 6_500_000, F.lit(False)).alias("too_soon")).where("own").drop("own")


# replies of an overloaded provider: some with a header, some with a hint in the body
_HEADER = "CASE event_id % 4 WHEN 0 THEN cast(event_id % 30 AS {text}) WHEN 1 THEN 'soon' END"
_BODY = "CASE event_id % 3 WHEN 0 THEN concat('Rate limit. Please try again in ', event_id % 9, '.5s') ELSE 'Rate limit.' END"
_HINTS = [r"^\s*([0-9]+(?:\.[0-9]+)?)\s*$", r"try again in ([0-9]+(?:\.[0-9]+)?)s"]


@query("rt_retry_backoff", f"SELECT event_id, least(20.0, coalesce(TRY_CAST(nullif(regexp_extract(coalesce(h, ''), '{_HINTS[0]}', 1), '') AS DOUBLE) + 1, TRY_CAST(nullif(regexp_extract(b, '{_HINTS[1]}', 1), '') AS DOUBLE) + 1, pow(2, attempt) + jitter)) AS wait_s FROM (SELECT event_id, {_HEADER.format(text='VARCHAR')} AS h, {_BODY} AS b, 1 + event_id % 3 AS attempt, ('0x' || md5(event_id::VARCHAR)[:4])::BIGINT / 65536.0::DOUBLE * 1.5 AS jitter FROM events)")
def rt_retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait after a refusal: the header's seconds and one more, else the body's hint and one more, else 2^attempt and jitter; 20 at most."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_HEADER.format(text="string")).alias("h"), F.expr(_BODY).alias("b"), (1 + F.col("event_id") % 3).alias("attempt"))
    found = lambda column, hint: F.nullif(F.regexp_extract(F.coalesce(column, F.lit("")), hint, 1), F.lit("")).cast("double") + 1
    jitter = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 4), 16, 10).cast("long") / 65536.0 * 1.5
    return e.select("event_id", F.least(F.lit(20.0), F.coalesce(found("h", _HINTS[0]), found("b", _HINTS[1]), F.pow(F.lit(2.0), "attempt") + jitter)).alias("wait_s"))


# job events: a minute of the log is a second, and event types are statuses
_JOB_US = "epoch_us(ts) // 60"
_JOB_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'running' END"


@query("rt_job_lifecycle", f"""WITH e AS (SELECT user_id AS job_id, event_id, {_JOB_US} AS us, {_JOB_STATUS} AS status FROM events),
n AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR lag(status) OVER w IN ('success', 'failure') OR us - lag(us) OVER w > 600000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id)),
a AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS attempt FROM n),
g AS (SELECT job_id, attempt, last(status ORDER BY us, event_id) AS s, min(us)::BIGINT AS started, max(us)::BIGINT AS latest, count(*) AS n_events FROM a GROUP BY 1, 2)
SELECT job_id, attempt, CASE WHEN s IN ('success', 'failure') THEN s ELSE 'timeout' END AS status, started, CASE WHEN s IN ('success', 'failure') THEN latest ELSE latest + 600000000 END AS ended, n_events FROM g""")
def rt_job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arrive in four files, out of order by up to half the watermark's delay; an event of no job long after ends all silences."""
    path = scratch_path(spark)
    us = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60)
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.timestamp_micros(us).alias("ts"), F.expr(_JOB_STATUS).alias("status"))
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(1_800_000_000))
    arrival = (F.unix_micros("ts") - jitter).alias("arrival")
    first, last = log.agg(F.min(arrival), F.max(arrival)).first()
    quarter = F.least(F.lit(3), F.floor((F.col("arrival") - (first or 0)) * 4 / max(1, (last or 0) - (first or 0))))
    parts = log.select("*", arrival).select("*", quarter.alias("part"))
    for k in range(4):
        parts.where(F.col("part") == k).select("job_id", "event_id", "ts", "status").coalesce(1).write.mode("append").parquet(f"{path}/in")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit((last or 0) + 10**11)).alias("ts"), F.lit("running").alias("status"))
    end.coalesce(1).write.mode("append").parquet(f"{path}/in")
    with jobs.keyed_state(spark):
        stream = spark.readStream.schema("job_id long, event_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = jobs.attempts(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.ATTEMPT).parquet(f"{path}/out")


def rt_latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each job from its log, as a poll sees it."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", F.col("event_id") % 1000000)).alias("status"), F.count("*").alias("n_events"))


for _alias in ("rt_polling",):
    query(_alias, "SELECT user_id AS job_id, arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000 + event_id % 1000000) AS status, count(*) AS n_events FROM events GROUP BY 1")(rt_latest_states)
