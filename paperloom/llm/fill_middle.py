"""Fill-in-the-middle: a text is cut in two places drawn from its id, and its middle goes to the end.

Cuts are given in units (code points, or lines), so they can be found only when all units are counted. Both is a parallel
scan of an automaton over bytes: a text falls into chunks and lanes, each gives its transition function (the end state for
every start state) and its counts for every start state; composing the functions, which is associative, resolves the state
in which each lane is really entered. Then counts add up, and only the lane that holds a cut is scanned again.

Texts of at most CHUNK bytes are chunks of their own and are scanned batch by batch. Longer ones are dealt out chunk by
chunk, whatever document they belong to: tasks scan chunks, one row a document composes the chunks' functions (a string has
less than 2**31 bytes, so there are at most 32768), and the chunks with cuts are looked up and scanned for the places.

Defined results: a null text counts as empty; an empty text, and one that contains a mark, stays plain; a null doc_id draws
as an empty one; cuts may coincide or lie at an end, their parts are then empty; repeated rows give repeated results; an
empty table gives no rows; further columns are carried along, but those named like a new column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialise, slices, small, utf8_bytes
from paperloom.registry import spread

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
CHUNK, LANE = 1 << 16, 128
FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Automaton:
    """step[state, byte] is the next state, emit[state, byte] whether the byte begins a unit (or completes a mark). State 0 is the start."""

    step: np.ndarray
    emit: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step)


def code_points() -> Automaton:
    """The state is the number of bytes that the code point at hand still lacks."""
    lead = np.select([np.arange(256) >= 0xF0, np.arange(256) >= 0xE0, np.arange(256) >= 0xC0], [3, 2, 1], 0)
    step = np.stack([lead] + [np.full(256, s - 1) for s in (1, 2, 3)])
    emit = np.zeros((4, 256), dtype=np.int64)
    emit[0] = 1
    return Automaton(step, emit)


def lines() -> Automaton:
    """State 0 stands before a line, state 1 within one; a line holds its line feed."""
    step = np.ones((2, 256), dtype=np.int64)
    step[:, 10] = 0
    emit = np.zeros((2, 256), dtype=np.int64)
    emit[0] = 1
    return Automaton(step, emit)


def marks() -> Automaton:
    """Counts the three marks: state 1 follows their common first byte, state 2 one of their letters."""
    step, emit = np.zeros((3, 256), dtype=np.int64), np.zeros((3, 256), dtype=np.int64)
    step[:, ord(PREFIX[0])] = 1
    step[1, [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = 2
    emit[2, ord(PREFIX[2])] = 1
    return Automaton(step, emit)


def scan(auto: Automaton, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lane and each start state the end state and the count; all lanes advance by a byte at each step."""
    longest_first = np.argsort(-lengths, kind="stable")
    at, left = starts[longest_first], lengths[longest_first]
    step, emit = (auto.step * 256).ravel(), auto.emit.ravel()
    state = np.tile(np.arange(auto.states) * 256, (len(at), 1))
    count = np.zeros_like(state)
    steps = int(left[0]) if len(left) else 0
    for j, n in enumerate(np.searchsorted(-left, -np.arange(steps), side="left")):
        seen = state[:n] + codes[at[:n] + j][:, None]
        count[:n] += emit[seen]
        state[:n] = step[seen]
    ends, counts = np.empty_like(state), np.empty_like(count)
    ends[longest_first], counts[longest_first] = state // 256, count
    return ends, counts


def composed(ends: np.ndarray) -> np.ndarray:
    """Row i: the function of lanes 0 to i one after the other, by doubling."""
    whole, reach = ends.copy(), 1
    while reach < len(whole):
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], axis=1)
        reach *= 2
    return whole


def _lanes(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the lanes of texts that lie side by side, and the text of each; an empty text has none."""
    sizes = np.diff(begins)
    per = -(-sizes // LANE)
    text = np.repeat(np.arange(len(sizes)), per)
    inside = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * LANE
    return begins[text] + inside, np.minimum(LANE, sizes[text] - inside), text


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    begins = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), begins


class Scanned:
    """The lanes of some texts with the state in which each is entered and the units before it."""

    def __init__(self, auto: Automaton, texts: pa.Array, entered: np.ndarray | None = None):
        self.auto, (self.codes, self.begins) = auto, _buffer(texts)
        self.starts, self.lengths, self.text = _lanes(self.begins)
        ends, counts = scan(auto, self.codes, self.starts, self.lengths)
        entered = np.zeros(len(texts), dtype=np.int64) if entered is None else entered
        first = np.ones(len(self.text), dtype=bool)
        first[1:] = self.text[1:] != self.text[:-1]
        known = entered[self.text[first]]
        ends[first] = np.take_along_axis(ends[first], known[:, None], axis=1)  # the first lane's start state is known: a constant function
        self.entry = np.concatenate([[0], composed(ends)[:-1, 0]])[: len(first)].astype(np.int64)
        self.entry[first] = known
        own = np.take_along_axis(counts, self.entry[:, None], axis=1)[:, 0]
        self.upto, self.own = np.cumsum(own), own
        self.n = np.bincount(self.text, weights=own, minlength=len(texts)).astype(np.int64)
        self.base = np.cumsum(self.n) - self.n

    def offsets(self, unit: np.ndarray) -> np.ndarray:
        """For each text the byte at which its unit of this number begins, or its length where it has no more units."""
        out = np.diff(self.begins).astype(np.int64)
        some = np.flatnonzero(unit < self.n)
        lane = np.searchsorted(self.upto, self.base[some] + unit[some], side="right")
        rest = self.base[some] + unit[some] - (self.upto[lane] - self.own[lane])
        state, found = self.entry[lane], np.full(len(some), -1, dtype=np.int64)
        for j in range(int(self.lengths[lane].max(initial=0))):
            code = self.codes[np.minimum(self.starts[lane] + j, len(self.codes) - 1)]
            hit = (self.auto.emit[state, code] == 1) & (j < self.lengths[lane])
            found = np.where(hit & (rest == 0) & (found < 0), self.starts[lane] + j, found)
            rest, state = rest - hit, self.auto.step[state, code]
        out[some] = found - self.begins[some]
        return out


def functions_of(auto: Automaton, chunks: pa.Array) -> tuple[list[list[int]], list[list[int]]]:
    """For each chunk its end state and its count for every start state."""
    codes, begins = _buffer(chunks)
    starts, lengths, chunk = _lanes(begins)
    ends, counts = scan(auto, codes, starts, lengths)
    at = np.searchsorted(chunk, np.arange(len(chunks) + 1))
    all_ends, all_counts = [], []
    for a, b in zip(at[:-1], at[1:]):
        whole = composed(ends[a:b])
        entries = np.concatenate([np.arange(auto.states)[None, :], whole])
        all_ends.append(entries[-1].tolist())
        all_counts.append(np.take_along_axis(counts[a:b], entries[:-1], axis=1).sum(axis=0).tolist())
    return all_ends, all_counts


def _draw(k: int) -> Column:
    """The k-th group of eight digits of the id's SHA-256 as a number."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _short(rows: DataFrame, unit: Automaton) -> DataFrame:
    """rows with n, hits (marks in the text), low and high (units before the cuts) and their bytes, chunk by chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, mark = unit, marks()
        for batch in slices(batches, column=1):
            units, hits = Scanned(auto, batch.column(1)), Scanned(mark, batch.column(1)).n
            draws = [batch.column(k).to_numpy(zero_copy_only=False) % (units.n + 1) for k in (2, 3)]
            low, high = np.minimum(*draws), np.maximum(*draws)
            values = (units.n, hits, low, high, units.offsets(low), units.offsets(high))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, values)], names=["row", "text", *PLACES])

    kind = rows.schema["row"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"row {kind}, text string, " + ", ".join(f"{p} long" for p in PLACES))


PLACES = ("n", "hits", "low", "high", "low_byte", "high_byte")


def _long(rows: DataFrame, unit: Automaton) -> DataFrame:
    """The same as _short for long texts, whose chunks are dealt out to all tasks. Equal texts of one id are scanned once."""
    mark = marks()
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "text"), 256))
    size, numbers = F.octet_length("text"), F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / CHUNK).cast("int"))
    cut = lambda k: F.struct(k.alias("chunk"), F.substring(F.col("text").cast("binary"), k * CHUNK + 1, F.least(size, F.lit(CHUNK))).alias("bytes"))
    # the chunks are made within the row, so that no chunk's row carries the whole text
    pieces = keyed.select("key", "h1", "h2", F.explode(F.transform(numbers, cut)).alias("piece")).select("key", "h1", "h2", "piece.*")
    chunks = materialise(pieces.groupBy("key", "chunk").agg(*(F.first(c).alias(c) for c in ("h1", "h2", "bytes"))), "fill-middle-chunks")

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=4):
            found = [values for auto in (unit, mark) for values in functions_of(auto, batch.column(4))]
            arrays = [*batch.columns[:4], pa.array(pc.binary_length(batch.column(4)), pa.int64()), *(pa.array(f, pa.list_(pa.int64())) for f in found)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "chunk", "h1", "h2", "size", *SUMMARY])

    summaries = chunks.select("key", "chunk", "h1", "h2", "bytes").mapInArrow(summarise, "key string, chunk int, h1 long, h2 long, size long, " + ", ".join(f"{s} array<long>" for s in SUMMARY))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "size", *SUMMARY)))  # at most 2**31 / CHUNK of them

    def compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=16):
            out = []
            for row in batch.to_pylist():
                state, inside, n, hits, before, entries = 0, 0, 0, 0, [], []
                for p in row["parts"]:
                    before.append(n)
                    entries.append(state)
                    n, state = n + p["counts"][state], p["ends"][state]
                    hits, inside = hits + p["mark_counts"][inside], p["mark_ends"][inside]
                low, high = sorted((row["h1"] % (n + 1), row["h2"] % (n + 1)))
                for which, cut in enumerate((low, high)):
                    k = min(int(np.searchsorted(before, cut, side="right")) - 1, len(before) - 1)
                    out.append((row["key"], n, hits, low, high, which, row["parts"][k]["chunk"], entries[k], cut - before[k]))
            columns = list(zip(*out)) or [()] * len(CUTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "key" else pa.int64()) for name, c in zip(CUTS, columns)], names=list(CUTS))

    whole = summaries.groupBy("key").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), parts.alias("parts"))
    cuts = whole.mapInArrow(compose, "key string, " + ", ".join(f"{c} long" for c in CUTS[1:])).withColumn("chunk", F.col("chunk").cast("int"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=1):
            state, unit_no, chunk = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4))
            byte = chunk * CHUNK + Scanned(unit, batch.column(1), state).offsets(unit_no)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(byte)], names=["cut", "byte"])

    kept = F.struct("key", "n", "hits", "low", "high", "which").alias("cut")
    asked = chunks.select("key", "chunk", "bytes").join(small(materialise(cuts, "fill-middle-cuts")), ["key", "chunk"]).select(kept, "bytes", "state", "unit", "chunk")
    placed = asked.mapInArrow(place, "cut struct<key:string,n:long,hits:long,low:long,high:long,which:long>, byte long")
    byte = lambda which: F.max(F.when(F.col("cut.which") == which, F.col("byte")))
    found = placed.groupBy(*(F.col(f"cut.{c}").alias(c) for c in ("key", "n", "hits", "low", "high"))).agg(byte(0).alias("low_byte"), byte(1).alias("high_byte"))
    return keyed.join(small(materialise(found, "fill-middle-places")), "key").select("row", "text", *PLACES)


SUMMARY = ("ends", "counts", "mark_ends", "mark_counts")
CUTS = ("key", "n", "hits", "low", "high", "which", "chunk", "state", "unit")


def transform(docs: DataFrame, unit: Automaton | None = None) -> DataFrame:
    """The rows of docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (units; null if plain) and output."""
    unit = unit or code_points()
    kept = [c for c in docs.columns if c.lower() not in FIELDS]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text.alias("text"))
    rows = rows.select("row", "text", _draw(1).alias("h1"), _draw(2).alias("h2"))
    is_long = utf8_bytes(F.col("text")) > CHUNK
    cut = _short(rows.where(~is_long), unit)
    if not rows.where(is_long).isEmpty():
        cut = cut.unionByName(_long(rows.where(is_long), unit))
    plain = (F.col("text") == "") | (F.col("hits") > 0) | (_draw(3) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(_draw(4) % 100 < SPM_BELOW, "spm").otherwise("psm")
    data = F.col("text").cast("binary")
    part = lambda start, stop: F.substring(data, start + 1, stop - start).cast("string")
    zero, size = F.lit(0).cast("int"), F.octet_length("text")
    low, high = F.col("low_byte").cast("int"), F.col("high_byte").cast("int")
    prefix, middle, suffix = part(zero, low), part(low, high), part(high, size)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    moved = lambda units: F.when(F.col("form") != "plain", units)
    return cut.withColumn("form", form).select("row.*", "n", "form", moved(F.col("low")).alias("prefix_chars"), moved(F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from which transform() made the output. Texts hold no mark, so the first of each kind is the one that was put in."""

    def after(text: Column, mark: str) -> tuple[Column, Column]:
        """What stands before the first mark, and behind it."""
        head = F.substring_index(text, mark, 1)
        start = F.octet_length(head) + len(mark) + 1
        return head, F.substring(text.cast("binary"), start, F.octet_length(text)).cast("string")

    first, rest = after(F.substring(output.cast("binary"), 4, F.octet_length(output)).cast("string"), SUFFIX)
    suffix, middle = after(rest, MIDDLE)
    last, tail = after(F.substring(output.cast("binary"), 4, F.octet_length(output)).cast("string"), PREFIX)
    prefix, centre = after(tail, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, suffix)).otherwise(F.concat(prefix, centre, last))


def fill_middle_digest(docs: DataFrame) -> DataFrame:
    moved = transform(docs.select("doc_id", "text"))
    digest = lambda text: F.sha2(text, 256)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
