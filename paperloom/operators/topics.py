"""Topic operators: heading merges in order, names by headings and phrases, labels of clusters."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import notation, rules
from paperloom.functions.cleaning import trim_blanks
from paperloom.scratch import written

#: Most topics of a course.
MOST_TOPICS = 25
#: Most frequent phrases of three and of two words that may name a topic.
TRIGRAMS, BIGRAMS = 60, 80
#: Words, and bytes of text, that are counted at a time; places to which runs of words are dealt out.
WORDS, TEXT, PLACES = 1 << 18, 4 << 20, 4096

#: Words that neither start nor end a phrase.
STOPWORDS = "a about above after again against all also am an and any are as at be because been before being between both but by can cannot could did do does doing down during each few for from further get got had has have having he her here him his how i if in into is it its itself let me more most my no nor not now of off on once only or other our out over own per same she should so some such than that the their them then there these they this those through to under until up us was we were what when where which while who will with would you your".split()
#: Lines that are headings, and the ones that never are.
HEADING = [r"(?i)^(Chapter|Section|Unit|Lecture|Topic|Part|Module|Appendix)\s*[\d:–\-]", r"^(\d+\.)+(\d+)?\s+[A-Z]", r"^[A-Z][A-Z\s\-/]{2,}$", r"^[A-Z][a-zA-Z\s\-/:()']{2,}$"]
#: Words that label no cluster.
CLUSTER_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "that", "this", "these", "those", "it",
    "its", "which", "who", "from", "by", "as", "not", "no", "if", "then", "so", "we", "you", "they", "i", "he", "she", "all", "also",
]


def heading_names(chunks: DataFrame) -> DataFrame:
    """name of each heading line of content: the subtitle of a labelled one, else the line, without numbering, in title case."""
    # lines and names come out of explode, so that what is asked of them does not work them out again
    lines = chunks.select(F.explode(F.transform(F.split("content", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")))).alias("line"))
    kind = F.coalesce(*(F.when(F.col("line").rlike(p), k) for p, k in zip(HEADING, ("keyword", "numbered", "caps", "title"))))
    fits = F.length("line").between(3, 80) & ~F.col("line").rlike(r"[.,;]\s*$")
    bare = F.col("line").rlike(rf"(?i)^({notation.STRUCTURAL})\s*[\d.\-–]*\s*$")
    after = trim_blanks(F.regexp_extract("line", r"[:\-–]\s*(.+)$", 1))
    stem = trim_blanks(F.regexp_replace("line", r"^[\d.\-–•*]+\s*", ""))
    name = F.when(F.col("kind") == "keyword", F.when(~bare & (F.length(after) >= 3), after)).when(F.col("kind") == "numbered", F.when(F.length(stem) >= 3, stem)).otherwise(F.col("line"))
    named = lines.where(fits).withColumn("kind", kind).where("kind is not null").select(F.explode(F.array(notation.title_case(name))).alias("name"))
    return named.where((F.length("name") >= 3) & ~rules.is_service_noise(F.col("name")))


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    """A column of word lists in parts of at most WORDS words, or of texts in parts of TEXT bytes; or one list or text."""
    lists = pa.types.is_list(column.type)
    length, most = (pc.list_value_length, WORDS) if lists else (pc.binary_length, TEXT)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield column.slice(start, stop - start)
        start = stop


def _word_runs(texts: pa.Array, sizes: Sequence[int]) -> pa.RecordBatch:
    """The longest runs of words at all places of lower-case texts, as rows of place, n and runs: see phrase_counts."""
    texts = texts.drop_null()
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "\n")
    raw = np.frombuffer(joined[0].as_buffer(), np.uint8)
    edges = np.flatnonzero(np.diff(((raw >= 97) & (raw <= 122)).astype(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    start, stop = (x[stop - start >= 3] for x in (start, stop))
    text = np.searchsorted(np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1), start, side="right")
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[start], inside[stop] = 1, -1  # a word ends before the next one starts
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(0, np.cumsum(stop - start)).astype(np.int32)), pa.py_buffer(letters)).dictionary_encode()
    known, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    open_ = pc.invert(pc.is_in(known, pa.array(STOPWORDS))).to_numpy(zero_copy_only=False)[code]

    long = np.zeros(len(code), np.int64)  # the most words of a run that starts at a word, 0 if there is none
    for n in sorted(sizes):
        last = np.arange(n - 1, len(code))
        ends = open_[last] & (text[last] == text[: len(last)])
        long[: len(last)][ends] = n
    at = np.flatnonzero(open_ & (long > 0))
    run = [code[at]] + [np.where(long[at] > k, code[np.minimum(at + k, len(code) - 1)], -1) for k in range(1, max(sizes))]
    key, bound = run[0], len(known)
    for x in run[1:]:
        if bound * (len(known) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = len(key)
        key, bound = key * (len(known) + 1) + x + 1, bound * (len(known) + 1)
    _, index, n = np.unique(key, return_index=True, return_counts=True)
    run = [x[index] for x in run]
    sums = np.array([zlib.crc32(w.as_buffer()) for w in known], np.int64)
    place = (sums[run[0]] * 31 + (sums[run[1]] if min(sizes) > 1 else 0)) % PLACES  # all places of a phrase in texts agree in these words
    order = np.lexsort((np.arange(len(n)), n, place))
    place, n = place[order], n[order]
    opens = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(n, prepend=-1) != 0))
    runs = pc.binary_join_element_wise(*(known.take(pa.array(x[order], mask=x[order] < 0)) for x in run), " ", null_handling="skip")
    runs = pc.binary_join(pa.ListArray.from_arrays(np.append(opens, len(n)).astype(np.int32), runs), "\n")
    return pa.RecordBatch.from_arrays([pa.array(place[opens].astype(np.int32)), pa.array(n[opens]), runs], names=["place", "n", "runs"])


def _run_counts(sent: pa.Table, sizes: Sequence[int], most: dict[int, int] | None) -> pa.Table:
    """size, phrase and n of the runs of one place, of each size only the most frequent ones if there is a limit."""
    lists = pc.split_pattern(sent.column("runs").combine_chunks(), "\n")
    n = np.repeat(sent.column("n").to_numpy(), pc.list_value_length(lists).to_numpy())

    def summed(texts: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        coded = texts.dictionary_encode()
        return coded.dictionary, np.bincount(coded.indices.to_numpy(), weights=n, minlength=len(coded.dictionary)).astype(np.int64)

    runs, n = summed(lists.flatten(), n)
    words = pc.split_pattern(runs, " ")
    length, tables = pc.list_value_length(words).to_numpy(), []
    for size in sizes:
        at = np.flatnonzero(length >= size)
        own = words.take(pa.array(at))
        ends = pc.invert(pc.is_in(pc.list_element(own, size - 1), pa.array(STOPWORDS))).to_numpy(zero_copy_only=False)
        phrase, total = summed(pc.binary_join(pc.list_slice(own.filter(pa.array(ends)), 0, size), " "), n[at[ends]])
        own = pa.table({"size": pa.array(np.full(len(total), size)), "phrase": phrase, "n": total})
        tables.append(own if most is None or len(own) <= most[size] else own.take(pc.select_k_unstable(own, most[size], [("n", "descending"), ("phrase", "ascending")])))
    return pa.concat_tables(tables)


def phrase_counts(chunks: DataFrame, sizes: Sequence[int] = (2, 3), most: dict[int, int] | None = None) -> DataFrame:
    """size, phrase and n of all runs of so many words (of three letters or more) that no stop word opens or closes.

    Of a place in a text only the longest run is shuffled, as shorter ones are its head. Runs are dealt out to PLACES by their
    first two words (one, if single words count), and those of a part of the input that stand there n times travel as one text, which takes few bytes. A
    part has at most TEXT bytes, or one text. With ``most``, of each size only so many of each place that are the most frequent
    (ties to the smaller phrase): those of all places are among them, since a phrase has one place.
    """
    sizes = sorted(set(sizes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch.column(0))):
            yield _word_runs(part, sizes)

    sent = chunks.select(F.lower("content").alias("text")).mapInArrow(run, "place int, n long, runs string")
    return sent.groupBy("place").applyInArrow(lambda own: _run_counts(own, sizes, most), "size long, phrase string, n long")


def phrase_score(n: Column, phrase: Column, size: int) -> Column:
    """Frequency times the squared mean length of the words."""
    length = (F.length(phrase) - (size - 1)) / size
    return F.round(n * length * length, 6)


def top_phrases(chunks: DataFrame) -> DataFrame:
    """size, phrase, n, score of the TRIGRAMS and BIGRAMS most frequent phrases of chunks."""
    counts = written(phrase_counts(chunks, (2, 3), {3: TRIGRAMS, 2: BIGRAMS}))
    top = lambda size, most: counts.where(F.col("size") == size).orderBy(F.desc("n"), "phrase").limit(most).withColumn("score", phrase_score(F.col("n"), F.col("phrase"), size))
    return top(3, TRIGRAMS).unionByName(top(2, BIGRAMS))


def topic_names(chunks: DataFrame, most: int = MOST_TOPICS) -> DataFrame:
    """rank and name of the topics of a course's chunks (content): repeated headings first, then key phrases.

    A phrase of two words is left out if it lies in one of three or in a more frequent one of two; of names of which one lies
    in the other the longer stays. Counting is distributed; what is merged in one row is at most ``most`` headings, TRIGRAMS
    and BIGRAMS phrases.
    """
    heads = heading_names(chunks).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    heads = heads.select(F.lit(1).alias("kind"), F.struct((-F.col("n")).alias("n"), F.col("name").alias("g")).alias("rank"), "name", F.lit(0.0).alias("score"))
    found = top_phrases(chunks)
    phrases = found.select(F.col("size").cast("int").alias("kind"), F.struct((-F.col("n")).alias("n"), F.col("phrase").alias("g")).alias("rank"), notation.title_case(F.col("phrase")).alias("name"), "score")
    phrases = phrases.where(~rules.is_service_noise(F.col("name")))
    row = heads.unionByName(phrases).groupBy().agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "name", "score"))).alias("a"))
    inside = lambda x, y: F.contains(F.lower(y["name"]), F.lower(x["name"]))
    covered = lambda x: F.exists("a", lambda y: inside(x, y) & ((y["kind"] == 3) | ((y["kind"] == 2) & (y["rank"] < x["rank"]))))
    first = F.transform(F.filter("a", lambda x: x["kind"] == 1), lambda x: x["name"])
    free = F.filter("a", lambda x: (x["kind"] == 3) | ((x["kind"] == 2) & ~covered(x)))
    row = row.select(first.alias("first"), F.array_sort(F.transform(free, lambda x: F.struct((-x["score"]).alias("s"), x["name"].alias("name")))).alias("free"))
    new = F.transform(F.filter("free", lambda x: ~F.array_contains("first", x["name"])), lambda x: x["name"])
    row = row.select(F.concat("first", F.slice(new, F.lit(1), F.greatest(F.lit(0), F.lit(2 * most) - F.size("first")))).alias("names"))
    low = F.transform("names", F.lower)
    row = row.select("names", low.alias("low"))
    longer = lambda i: F.exists("low", lambda y: (y != F.get("low", i)) & F.contains(y, F.get("low", i)))
    again = lambda i: F.array_position("low", F.get("low", i)) <= i
    kept = F.filter("names", lambda x, i: ~longer(i) & ~again(i))
    return row.select(F.posexplode(F.slice(kept, 1, most)).alias("rank", "name")).select((F.col("rank") + 1).alias("rank"), "name")


def term_weights(texts: DataFrame) -> DataFrame:
    """term and score: the sum over texts of each occurrence's share of its text, times the log of texts over texts with the term.

    A term's count enters twice, as each occurrence adds the share. Words have four letters or more, and CLUSTER_STOPWORDS do
    not count, neither as terms nor in a text's length. Texts lie whole in a batch, so counts are added up there, over so many
    texts at a time as have WORDS words, and only distinct terms are shuffled.
    """
    stop = pa.array(CLUSTER_STOPWORDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in (part for batch in batches for part in _parts(batch.column(0))):
            text = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            flat = words.flatten()
            kept = pc.invert(pc.is_in(flat, stop)).to_numpy(zero_copy_only=False)
            coded, text = flat.filter(pa.array(kept)).dictionary_encode(), text[kept]
            size = max(1, len(coded.dictionary))
            pair, n = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            share = n * (n / np.bincount(text, minlength=len(words))[pair // size])
            term = pair % size
            sums = (pa.array(np.bincount(term, weights=share, minlength=len(coded.dictionary))), pa.array(np.bincount(term, minlength=len(coded.dictionary)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([coded.dictionary, *sums], names=["term", "share", "df"])

    words = texts.select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w"))
    sums = words.mapInArrow(run, "term string, share double, df long").groupBy("term").agg(F.sum("share").alias("share"), F.sum("df").alias("df"))
    return sums.select("term", F.round(F.col("share") * F.log(F.lit(float(max(1, texts.count()))) / F.col("df")), 6).alias("score"))


def cluster_topics(members: DataFrame) -> DataFrame:
    """cluster, title, confidence, n, first_page, last_page of clusters of chunks (cluster, chunk_id, vec of unit length, text, page).

    The title joins the three words of most weight: counts squared over lengths, times the log of the cluster's chunks over
    those with the word (ties to the smaller word). The confidence maps the mean cosine to the cluster's mean vector from
    .3-.9 to .25-.55. A cluster without such words gives no topic.
    """
    words = members.select("cluster", "chunk_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    tf = words.select("cluster", "chunk_id", F.size("w").alias("len"), F.explode("w").alias("word")).groupBy("cluster", "chunk_id", "word").agg(F.count("*").alias("c"), F.first("len").alias("len"))
    sums = tf.groupBy("cluster", "word").agg(F.sum(F.col("c") * F.col("c") / F.col("len")).alias("tf"), F.count("*").alias("df"))
    facts = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), Summarizer.mean(array_to_vector("vec")).alias("centre"))
    weight = F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 9)
    named = sums.where((F.length("word") >= 4) & ~F.col("word").isin(CLUSTER_STOPWORDS)).join(facts.select("cluster", "n"), "cluster").withColumn("weight", weight)
    best = named.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "word"))).where("r <= 3")
    titles = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: F.initcap(x["word"])), " / ").alias("title"))
    cosine = F.aggregate(vector_to_array("centre"), F.lit(0.0), lambda s, x: s + x * x)
    confidence = 0.25 + 0.30 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - 0.30) / 0.60))
    return facts.withColumn("confidence", F.round(confidence, 6)).join(titles, "cluster").select("cluster", "title", "confidence", "n", "first_page", "last_page")


def merge_headings(spans: DataFrame) -> DataFrame:
    """doc_id, page, seq, size, text: neighbouring spans of a page join while their size is within 1 of the running maximum.

    A fold over the ordered spans of a page, since each comparison is with what was joined before.
    """
    kind = "array<struct<seq:bigint,size:double,text:string>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["seq"].alias("seq"), F.greatest(last["size"], x["size"]).alias("size"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))
        merges = (F.size(done) > 0) & (F.abs(F.try_element_at(done, F.lit(-1))["size"] - x["size"]) < 1.0)
        return F.when(merges, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    ordered = F.array_sort(F.collect_list(F.struct("seq", "size", "text")))
    pages = spans.groupBy("doc_id", "page").agg(ordered.alias("spans"))
    merged = pages.select("doc_id", "page", F.explode(F.aggregate("spans", F.array().cast(kind), step)).alias("m"))
    return merged.select("doc_id", "page", "m.*")
