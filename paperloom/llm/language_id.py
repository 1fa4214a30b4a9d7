"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

The model counts hashed letter pairs, letter triples and whole words by language over all labelled documents that are
not held out; every partition counts by itself and Spark adds the counts up. The table has BUCKETS numbers for each
language, whatever the corpus. A word is scored by the languages that were seen to use its script. The best path through
a text may change language from word to word at a fixed penalty, which labels spans of mixed text; the document takes
the language that most of its letters are in.

Defined results: a null text or one without letters is ``und`` with score 0; with no labelled documents all are ``und``;
ties go to the first language by code point; a null doc_id counts as the empty text for the hold-out rule; repeated rows
get the same result each; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.registry import spread

#: Size of the hashed feature table of each language, smoothing, cost of a change of language in nats, text bytes handled at a time.
BUCKETS, SMOOTH, SWITCH, CHUNK = 1 << 16, 0.5, 9.0, 4_000_000
#: A language uses a script that at least this share of its letters is in.
SCRIPT_SHARE = 0.01
#: First code points of script ranges (each up to the next), and the scripts' names.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other")]
_STARTS, _KINDS = np.array([s for s, _ in SCRIPTS]), sorted({k for _, k in SCRIPTS})
_KIND_OF = np.array([_KINDS.index(k) for _, k in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; a run of numerals has none, and is no word."""
    words = _WORD.findall(text.lower()) if text else []
    return words if "".join(words).isalpha() else [w for w in words if any(map(str.isalpha, w))]


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of words, the word that each belongs to, and each word's script."""
    codes = np.frombuffer("".join(f"\n {w} " for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    breaks = codes == 10
    word = np.cumsum(breaks) - 1
    mul = np.uint64(0x9E3779B97F4A7C15)
    two = codes[:-1] * np.uint64(0x100000001B3) + codes[1:]
    three = two[:-1] * np.uint64(0x100000001B3) + codes[2:]
    ok2 = ~(breaks[:-1] | breaks[1:])
    ok3 = ok2[:-1] & ok2[1:]
    starts = np.flatnonzero(breaks)
    power = (codes + np.uint64(7)) * (mul * (np.arange(len(codes), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), np.diff([*starts, len(codes)])) + np.uint64(1)) | np.uint64(1))
    whole = np.add.reduceat(power, starts)
    buckets = np.concatenate([two[ok2], three[ok3] ^ np.uint64(0x5555), whole ^ np.uint64(0xAAAA)]) * mul >> np.uint64(48)
    owners = np.concatenate([word[:-1][ok2], word[:-2][ok3], np.arange(len(words))])
    scripts = _KIND_OF[np.searchsorted(_STARTS, codes[starts + 2], side="right") - 1]
    return buckets.astype(np.int64), owners, scripts


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK bytes of text, or of one row."""
    size = np.cumsum([len(v) for v in (x.as_py() or "" for x in batch.column(column))])
    start = 0
    while start < batch.num_rows:
        upto = (size[start - 1] if start else 0) + CHUNK
        stop = max(start + 1, int(np.searchsorted(size, upto, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # bucket x language, log probabilities
    uses: np.ndarray  # script x language


def train(labelled: DataFrame) -> LanguageModel:
    """labelled: text and lang. Counting runs on Spark; the model's size is BUCKETS times the number of languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _chunks(batch, 0):
                seen: dict[str, Counter] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen.setdefault(lang, Counter()).update(words_of(text))
                for lang, counter in seen.items():
                    if counter:
                        times, letters = np.fromiter(counter.values(), dtype=np.float64), np.array([len(w) for w in counter])
                        buckets, owners, scripts = _features(list(counter))
                        sums = table.setdefault(lang, np.zeros(BUCKETS + len(_KINDS)))
                        sums[:BUCKETS] += np.bincount(buckets, times[owners], BUCKETS)
                        sums[BUCKETS:] += np.bincount(scripts, times * letters, len(_KINDS))
        for lang, sums in table.items():
            there = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there), pa.array(sums[there].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = spread(labelled.select("text", "lang")).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique(), key=lambda x: x.encode())
    dense = np.zeros((BUCKETS + len(_KINDS), len(languages)))
    dense[counts["bucket"].to_numpy(dtype=np.int64), [languages.index(x) for x in counts["lang"]]] = counts["n"]
    features, letters = dense[:BUCKETS] + SMOOTH, dense[BUCKETS:]
    return LanguageModel(languages, np.log(features / features.sum(axis=0)), letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def word_scores(model: LanguageModel, words: list[str]) -> np.ndarray:
    buckets, owners, scripts = _features(words)
    total = np.zeros((len(words), len(model.languages)))
    for k in range(len(model.languages)):
        total[:, k] = np.bincount(owners, model.scores[buckets, k], len(words))
    uses = model.uses[scripts]
    return np.where(uses | ~uses.any(axis=1, keepdims=True), total - total.max(axis=1, keepdims=True), -1e3)


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; scores of all texts' words one after the other, handled word by word for all texts at once."""
    n_lang = scores.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    offsets, lengths = offsets[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")  # texts longer than each step
    came = np.zeros(scores.shape, dtype=np.int16)
    path, stay = np.zeros(len(scores), dtype=np.int16), np.arange(n_lang, dtype=np.int16)
    last = np.zeros((len(lengths), n_lang))
    for t, n in enumerate(active):
        at = offsets[:n] + t
        if t:
            before = last[:n]
            top = before.argmax(axis=1)
            jump = before[np.arange(n), top] - switch
            moved = before < jump[:, None]
            came[at] = np.where(moved, top[:, None], stay)
            last[:n] = np.where(moved, jump[:, None], before) + scores[at]
        else:
            last[:n] = scores[at]
    now = last.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        path[at] = now[:n]
        now[:n] = came[at, now[:n]] if t else now[:n]
    return path


def label_words(model: LanguageModel, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray]:
    """The words of each text, and the language index of each word of all of them."""
    words = [words_of(t) for t in texts]
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for own in words for w in own), dtype=np.int64)
    if not len(ids) or not model.languages:
        return words, np.zeros(len(ids), dtype=np.int16)
    return words, best_paths(word_scores(model, list(index))[ids], np.array([len(own) for own in words]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the share of the letters in that language) and spans (first word, end word, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in _chunks(batch, 1):
                words, path = label_words(model, part.column(1).to_pylist())
                rows, at = [], 0
                for own in words:
                    langs = path[at : at + len(own)]
                    at += len(own)
                    if not own or not model.languages:
                        rows.append(("und", 0.0, []))
                        continue
                    letters = np.bincount(langs, [len(w) for w in own], len(model.languages))
                    cuts = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), len(own)]
                    spans = [{"start": s, "end": e, "lang": model.languages[langs[s]]} for s, e in zip(cuts, cuts[1:])]
                    rows.append((model.languages[int(letters.argmax())], float(letters.max() / letters.sum()), spans))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                out = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], kind)]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names=["doc_id", "lang_pred", "score", "spans"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def language_digest(docs: DataFrame) -> DataFrame:
    model = train(docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
