"""What generation needs: context chunks of a request by stages, the context text, and duplicates among new questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import rules, similarity
from paperloom.functions.cleaning import trim_blanks, trim_space
from paperloom.scratch import written


def _top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


#: Bytes of request vectors that are broadcast at most.
BROADCAST_BYTES = 16 << 20


def _sized(requests: DataFrame) -> DataFrame:
    """The requests, broadcast if their vectors are counted to have few bytes; else Spark joins them by course."""
    size = requests.agg(F.coalesce(F.sum(8 * F.size("q") + 32), F.lit(0))).first()[0]
    return F.broadcast(requests) if size <= BROADCAST_BYTES else requests


def context_chunks(requests: DataFrame, mapped: DataFrame, chunks: DataFrame, texts: DataFrame, k: int = 10, min_score: float = 0.0, broad_score: float = 0.05) -> DataFrame:
    """The k context chunks of every request: request_id, chunk_id, stage, score, rank.

    requests: request_id, course_id, q (query vector or null). mapped: request_id, chunk_id, score (null: unknown).
    chunks: chunk_id, course_id, chunk_index, vec (or null), allowed (by class), used, penalised. texts: chunk_id, content;
    only those of chunks that come into question are judged as boilerplate. Stages: chunks of the topic; chunks like the query, while there is room for 3 k; both without
    boilerplate and used chunks. If none is left: a wider search for unseen chunks, unused ones first; if still none, the
    course's first chunks with a neutral score. Chunks that are not penalised come first.
    """
    fetch = 3 * k
    own = chunks.where("allowed")
    topic = mapped.join(own.select("chunk_id", "used"), "chunk_id").where(F.col("score").isNull() | (F.col("score") >= min_score))
    topic = _top(topic, fetch, F.desc_nulls_last("score"), "chunk_id").withColumns({"score": F.coalesce("score", F.lit(0.0)), "stage": F.lit(1)})
    vectors = own.where("vec is not null").select("chunk_id", "course_id", "vec", "used")
    asked = _sized(requests.where("q is not null").select("request_id", "course_id", "q"))
    scored = vectors.join(asked, "course_id").select("request_id", "chunk_id", "used", F.round(similarity.cosine(F.col("vec"), F.col("q")), 5).alias("score"))
    wide = written(_top(scored, 4 * fetch, F.desc("score"), "chunk_id").where(F.col("score") >= F.least(F.lit(min_score), F.lit(broad_score))))
    topic = written(topic)
    chosen = wide.select("chunk_id").unionByName(topic.select("chunk_id")).distinct()
    judged = written(texts.join(chosen, "chunk_id", "left_semi").select("chunk_id", rules.is_excluded(F.col("content")).alias("boilerplate")))
    wide, topic = wide.join(judged, "chunk_id"), topic.join(judged, "chunk_id")
    room = topic.groupBy("request_id").agg(F.count("*").alias("n"))
    near = _top(wide, fetch, F.desc("score"), "chunk_id").where(F.col("score") >= min_score).join(topic.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti")
    near = near.join(room, "request_id", "left").withColumn("free", fetch - F.coalesce("n", F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "chunk_id"))
    near = near.withColumn("place", place).where("place <= free").withColumn("stage", F.lit(2))
    names = ["request_id", "chunk_id", "stage", "score", "boilerplate", "used"]
    seen = written(topic.select(names).unionByName(near.select(names)))
    first = seen.where("not boilerplate and not used")
    empty = requests.select("request_id", "course_id").join(first.select("request_id"), "request_id", "left_anti")
    unseen = wide.where((F.col("score") >= broad_score) & ~F.col("boilerplate")).join(empty.select("request_id"), "request_id", "left_semi").join(seen.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti")
    fresh = F.count_if(~F.col("used")).over(Window.partitionBy("request_id"))
    broad = unseen.withColumn("fresh", fresh).where("fresh = 0 or not used").withColumn("stage", F.when(F.col("fresh") > 0, 3).otherwise(4))
    still = empty.join(broad.select("request_id"), "request_id", "left_anti")
    course = still.join(own.where("vec is not null").select("chunk_id", "course_id", "chunk_index"), "course_id")
    course = _top(course, 2 * k, "chunk_index", "chunk_id").select("request_id", "chunk_id", F.lit(5).alias("stage"), F.lit(0.5).alias("score"))
    short = ["request_id", "chunk_id", "stage", "score"]
    staged = first.select(short).unionByName(broad.select(short)).unionByName(course)
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("penalised", F.desc("score"), "stage", "chunk_id"))
    return staged.join(chunks.select("chunk_id", "penalised"), "chunk_id").withColumn("rank", rank).where(F.col("rank") <= k).select(*short, "rank")


#: Signs of a key fact. Word boundaries stand on both sides of the last group's signs as well.
FACTS = [
    r"(?i)^(theorem|lemma|proposition|corollary|definition|proof|claim|remark)\b",
    r"^[\s]*[-•*·]\s+\S",
    r"[=+\-*/^∑∏∫√≤≥≠∈∉∀∃λμσαβγδεζηθ]{2,}|\\frac|\\sum|\\int|\\prod|\\lim|\\inf|\\sup|<=>|->|<-|::",
    r"(?i)(^|[^\pL\pN_])(is|are|means|defined as|denoted by|denoted|called|iff)($|[^\pL\pN_])|[\pL\pN_](:=|≡)[\pL\pN_]",
]
#: Characters of a piece of evidence, of a fact, and of the whole context; pieces of evidence.
EVIDENCE, FACT, BUDGET, PIECES = 1400, 220, 8000, 2


def is_fact(line: Column) -> Column:
    """Of a line without white space around it."""
    hit = F.lit(False)
    for p in FACTS:
        hit = hit | line.rlike(p)
    return (F.length(line) >= 10) & hit


def evidence(content: Column, most: int = EVIDENCE) -> Column:
    """The text, cut at its last full stop in the second half of what fits, else where it stops fitting."""
    text = trim_space(content)
    head = F.substring(text, 1, most)
    stop = most - F.instr(F.reverse(head), ".")  # from 0; most if there is none
    cut = F.when((F.instr(head, ".") > 0) & (stop > most // 2), F.substring(head, F.lit(1), (stop + 1).cast("int"))).otherwise(head)
    return F.when(F.length(text) > most, F.concat(cut, F.lit(" …"))).otherwise(text)


def build_context(ranked: DataFrame, budget: int = BUDGET, pieces: int = PIECES) -> DataFrame:
    """request_id and context, from request_id, rank (from 1) and content of its few chunks.

    The first chunks are evidence; key facts of the others follow, each once, in order, while they fit into the budget.
    """
    body = F.concat(F.lit("[Evidence "), F.col("rank").cast("string"), F.lit("]\n"), evidence(F.col("content")))
    sections = ranked.where(F.col("rank") <= pieces).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", body.alias("text")))).alias("e"))
    sections = sections.select("request_id", F.transform("e", lambda x: x["text"]).alias("evidence"))
    left = budget - 20 - F.aggregate("evidence", F.lit(0), lambda s, x: s + F.length(x) + 2)
    lines = ranked.where(F.col("rank") > pieces).select("request_id", "rank", F.posexplode(F.split("content", "\n")).alias("line_no", "raw")).withColumn("line", trim_space(F.col("raw")))
    facts = lines.where(is_fact(F.col("line"))).withColumn("fact", F.substring("line", 1, FACT))
    once = F.row_number().over(Window.partitionBy("request_id", trim_blanks(F.lower("fact"))).orderBy("rank", "line_no"))
    upto = Window.partitionBy("request_id").orderBy("rank", "line_no")
    kept = facts.withColumn("again", once).where("again = 1").withColumn("used", F.sum(F.length("fact") + 3).over(upto))
    fits = kept.join(sections.select("request_id", left.alias("left")), "request_id").where("left > 100 and used <= left")
    listed = fits.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line_no", "fact"))), lambda x: F.concat(F.lit("• "), x["fact"])), "\n").alias("facts"))
    parts = F.concat("evidence", F.when(F.col("facts").isNotNull(), F.array(F.concat(F.lit("[Key Facts]\n"), "facts"))).otherwise(F.array().cast("array<string>")))
    return sections.join(listed, "request_id", "left").select("request_id", F.array_join(parts, "\n\n").alias("context"))


def near_pairs(tokens: DataFrame, threshold: float, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of ids whose token sets (column t) have a Jaccard similarity above the threshold, within the columns given.

    They are found by their rarest tokens: a pair shares one of a set's first n - ceil(threshold n) + 1 tokens in any one order.
    """
    each = tokens.select("id", *within, F.size("t").alias("n"), F.explode("t").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    prefix = written(each.join(often, "token").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).select("id", *within, "n", "token"))
    x, y = prefix.select(F.col("id").alias("a"), *within, "token", "n"), prefix.select(F.col("id").alias("b"), *within, "token", F.col("n").alias("m"))
    able = (F.col("a") < F.col("b")) & (F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n"))
    pairs = x.join(y, ["token", *within]).where(able).select("a", "b").distinct()
    both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("t").alias("s")), "a").join(tokens.select(F.col("id").alias("b"), "t"), "b")
    return both.where(F.size(F.array_intersect("s", "t")) > threshold * F.size(F.array_union("s", "t"))).select("a", "b")


def greedy_duplicates(pairs: DataFrame) -> DataFrame:
    """Ids that an earlier, accepted id is too similar to. ``pairs`` has a (earlier) and b.

    Settled in rounds: whoever has no open earlier neighbour is accepted, and its later neighbours are duplicates. Few
    rounds are needed, as each settles the first of every chain.
    """
    open_, found = written(pairs), pairs.select(F.col("b").alias("id")).limit(0)
    while not open_.isEmpty():
        first = open_.select("a").join(open_.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        gone = written(open_.join(first, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        found = found.unionByName(gone)
        rest = open_.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
        open_ = written(rest.join(first, "a", "left_anti"))
    return found
