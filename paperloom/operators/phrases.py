"""Occurrences of many phrases in many texts, and the relevance of texts to topics by them.

The phrases of a scope make one keyword automaton, and each text of the scope runs through it once: the cost follows the
texts and the hits, not topics times texts. Occurrences count inside words as well, and do not overlap, as in a plain
left-to-right search for each phrase.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of phrases that are broadcast at most; beyond, texts and phrases meet by a shuffle on the scope.
BROADCAST_BYTES = 16 << 20
#: Characters in which a phrase counts as early; automata that a task keeps.
EARLY, AUTOMATA = 120, 64
KEYWORD = "[a-z]{3,}"


def _automaton(needles: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for needle in needles:
        found.add_word(needle, needle)
    found.make_automaton()
    return found


def count_all(automaton: ahocorasick.Automaton, text: str) -> dict[str, list[int]]:
    """For each needle that occurs: how often, without overlap, and where the first one ends."""
    hits: dict[str, list[int]] = {}
    last: dict[str, int] = {}
    for end, needle in automaton.iter(text):
        if end - len(needle) >= last.get(needle, -1):
            last[needle] = end
            hits.setdefault(needle, [0, end + 1])[0] += 1
    return hits


def phrase_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """id, needle, n and early (within the first EARLY characters) of the needles of its scope that occur in a text.

    texts: id, scope, text (lower case). needles: scope, needle; empty and null ones never occur.
    """
    own = needles.where("needle <> ''").groupBy("scope").agg(F.sort_array(F.collect_set("needle")).alias("needles"))
    size = own.agg(F.coalesce(F.sum(F.aggregate("needles", F.lit(16).cast("long"), lambda n, x: n + F.octet_length(x) + 16)), F.lit(0))).first()[0]
    both = texts.where("text is not null").select("id", "scope", "text").join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "scope")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, ...], ahocorasick.Automaton] = {}
        for batch in batches:
            ids, names, counts, early, at = [], [], [], [], 0
            for at, (text, own_needles) in enumerate(zip(batch.column(1), batch.column(2))):
                key = tuple(own_needles.as_py())
                if key not in kept:
                    if len(kept) >= AUTOMATA:
                        kept.clear()
                    kept[key] = _automaton(key)
                for needle, (n, first) in count_all(kept[key], text.as_py()).items():
                    ids.append(at)
                    names.append(needle)
                    counts.append(n)
                    early.append(first <= EARLY)
            arrays = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(early, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "needle", "n", "early"])

    kind = dict(texts.dtypes)["id"]
    return both.select("id", "text", "needles").mapInArrow(run, f"id {kind}, needle string, n long, early boolean")


def term_relevance(topics: DataFrame, texts: DataFrame) -> DataFrame:
    """topic_id, id, by_phrase and by_keywords, for texts of a topic's scope in which its name or one of its keywords occurs.

    topics: topic_id, scope, name. texts: id, scope, text. ``by_phrase`` is the name's count over the text's words (of three
    letters or more), doubled where it is early, before it is set in relation to the topic's best; ``by_keywords`` counts the
    name twice and adds its keywords, each as often as the name has it.
    """
    named = topics.select("topic_id", "scope", F.lower("name").alias("name"))
    words = F.regexp_extract_all("name", F.lit(KEYWORD), F.lit(0))
    each = F.concat(F.array(F.struct(F.col("name").alias("needle"), F.lit(1).alias("phrase"), F.lit(2).alias("weight"))), F.transform(words, lambda w: F.struct(w.alias("needle"), F.lit(0).alias("phrase"), F.lit(1).alias("weight"))))
    wanted = named.where("name <> ''").select("topic_id", "scope", F.explode(each).alias("e")).groupBy("topic_id", "scope", "e.needle").agg(F.max("e.phrase").alias("phrase"), F.sum("e.weight").alias("weight"))
    low = texts.select("id", "scope", F.lower("text").alias("text"))
    hits = phrase_hits(low, wanted.select("scope", "needle").distinct())
    counted = low.select("id", "scope", F.greatest(F.lit(1), F.regexp_count("text", F.lit(KEYWORD))).alias("words"))
    scored = hits.join(counted, "id").join(wanted, ["scope", "needle"])
    sums = scored.groupBy("topic_id", "id").agg(
        F.sum(F.col("phrase") * F.col("n") * F.when(F.col("early"), 2).otherwise(1)).alias("phrase"),
        F.sum(F.col("weight") * F.col("n")).alias("all"),
        F.first("words").alias("words"),
    )
    return sums.select("topic_id", "id", (F.col("phrase") / F.col("words")).alias("by_phrase"), (F.col("all") / F.col("words")).alias("by_keywords"))


def best_share(relevance: DataFrame) -> DataFrame:
    """topic_id, id and score: by_phrase over the topic's largest; texts without the name are left out."""
    most = F.max("by_phrase").over(Window.partitionBy("topic_id"))
    return relevance.where("by_phrase > 0").select("topic_id", "id", F.round(F.col("by_phrase") / most, 6).alias("score"))
