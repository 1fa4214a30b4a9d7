"""Interleaved document sequences with media columns.

An HTML page is parsed into ordered items: texts, and references to media with their captions. Media are stored once for
each digest of their payload; a digest join resolves the references, however many a page has, and positions and captions
stay with their items. The payload of a medium is stored without loss as an 8-bit grey image of 64 samples a row (PNG),
is read back from the stored bytes, and its features are computed from what was read.

Defined results: a null text or page counts as empty (an empty payload is one row of zeros, an empty page has no items);
very long texts are handled in slices that are bounded in bytes; references without a stored medium keep their place with
a null payload; references to one digest resolve to the same medium each; in a figure within a figure, a caption belongs
to the innermost; repeated rows are rows of their own that share the stored medium; an empty table gives no rows; further
columns are carried along by interleave() and resolve(), but those named like a new column (items; an item's fields; the
media's columns) give way to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, utf8_bytes

ROW = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def pad(data: bytes) -> bytes:
    """Append zeros up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store(payload: bytes) -> bytes:
    """A grey PNG with one payload byte for each sample."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    plain = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # each row starts with filter type 0
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + _chunk(b"IEND", b"")


def read(stored: bytes) -> bytes:
    """The samples of a PNG that store() wrote; a damaged chunk raises ValueError."""
    if not stored.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, data = len(_SIGNATURE), []
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        data += [body] if kind == b"IDAT" else []
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Whole numbers only, so that equal samples give equal text: rows, sum, range, distinct values, counts of 8 levels."""
    values = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(values, minlength=256)
    there = np.flatnonzero(counts)
    levels = "/".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    return f"rows={len(values) // ROW};sum={int(values.sum(dtype=np.int64))};min={there[0]};max={there[-1]};distinct={len(there)};levels={levels}"


class _Items(HTMLParser):
    """Collects the items of a page in order."""

    MEDIA = {"img": "image", "video": "video", "audio": "audio"}
    SILENT = {"script", "style", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []  # where the items of each open figure start
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        self.hidden += tag in self.SILENT
        if tag == "figure":
            self.flush()
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA and at.get("src"):
            self.flush()
            self.items.append({"kind": self.MEDIA[tag], "text": None, "digest": at["src"].removeprefix("media:"), "caption": at.get("alt") or at.get("title")})
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "section", "article"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.SILENT))
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                item["caption"] = words if item["kind"] != "text" else None
            self.caption = None
        elif tag == "figure":
            self.flush()
            if self.figures:
                self.figures.pop()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    page = _Items()
    page.feed(html or "")
    page.close()
    page.flush()
    return [{"position": k, **item} for k, item in enumerate(page.items)]


def interleave(pages: DataFrame) -> DataFrame:
    """Replace the column html by ``items``; all other columns stay."""
    names = [c for c in pages.columns if c not in ("html", "items")]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], column=batch.num_columns - 1):
                items = pa.array([parse(h.as_py()) for h in part.column(part.num_columns - 1)], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], items], names=[*names, "items"])

    schema = "".join(f"`{n}` {t}, " for n, t in pages.dtypes if n in names)
    return pages.select(*(f"`{n}`" for n in names), "html").mapInArrow(run, f"{schema}items {ITEMS}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each item, in place: the columns of sequences, the item's fields, and those of media (one row a digest).

    Texts have no digest; in the join each goes by a key drawn for it, so that they do not gather in one task.
    """
    new = {"position", "kind", "text", "digest", "caption", *(c.lower() for c in media.columns)}
    kept = [F.col(f"`{c}`") for c in sequences.columns if c != "items" and c.lower() not in new]
    each = sequences.select(F.struct(*kept, F.lit(0).alias("_none")).alias("row"), F.explode_outer("items").alias("item"))
    keyed = each.withColumn("key", F.coalesce("item.digest", F.concat(F.lit("no medium "), F.rand(0).cast("string"))))
    stored = media.select(F.col("digest").alias("stored"), F.struct(*(f"`{c}`" for c in media.columns if c != "digest")).alias("medium"))
    return keyed.join(stored, F.col("key") == F.col("stored"), "left").select("row.*", "item.*", "medium.*").drop("_none")


def _digest(text: Column) -> Column:
    """SHA-256 of a text's payload, in lowercase hexadecimal digits."""
    n = utf8_bytes(text)
    rows = F.greatest(F.lit(1).cast("long"), F.ceil(n / ROW)) * ROW
    return F.sha2(F.rpad(F.coalesce(text, F.lit("")).cast("binary"), rows.cast("int"), F.lit(b"\x00")), 256)


def stored_media(texts: DataFrame) -> DataFrame:
    """digest and media (the stored file) of the payload of every text, one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=0):
            data = [pad(t.as_py() or b"") for t in part.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array([store(d) for d in data], pa.binary())], names=["digest", "media"])

    return texts.select("text").mapInArrow(run, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def described(media: DataFrame) -> DataFrame:
    """digest and media (stored files) to digest and what is found in the samples that are read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=1):
            rows = []
            for file in part.column(1):
                stored = file.as_py()
                samples = read(stored)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            columns = list(zip(*rows))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and html: the lines of the text as paragraphs, and after the first of them the text's own image with its caption."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(plain, "\n", 1)
    rest = F.replace(F.substr(plain, F.length(first) + 2), F.lit("\n"), F.lit("</p><p>"))
    n = utf8_bytes(F.col("text"))
    figure = F.concat(F.lit('<figure><img src="media:'), _digest(F.col("text")), F.lit('"><figcaption>'), n.cast("string"), F.lit(" bytes</figcaption></figure>"))
    return docs.select("doc_id", n.alias("n_bytes"), F.concat(F.lit("<p>"), first, F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p>")).alias("html"))


def media_digest(docs: DataFrame) -> DataFrame:
    """Every document as an interleaved sequence of its paragraphs and its text's medium, which is resolved and read back.

    Only the references go through the join; n_texts counts the text items around them.
    """
    sequences = interleave(document_pages(docs))
    references = sequences.withColumn("n_texts", F.size(F.filter("items", lambda i: i["kind"] == "text")).cast("long")).withColumn("items", F.filter("items", lambda i: i["digest"].isNotNull()))
    found = resolve(references, described(stored_media(docs)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_texts")
