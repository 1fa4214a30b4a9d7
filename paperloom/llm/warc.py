"""WARC archives: pages are written as transactions, archives are read as records, and records are assembled to captures.

A page becomes a request, a response and a metadata record that name each other by WARC-Concurrent-To. Of pages with equal
payloads the one with the smallest page_id is stored as response; the others become revisit records, which name it and
carry no payload. Archives are gzip files of WARC/1.1 records, written by Spark's text writer with the blank lines
between records as its separator, one archive a task. They are read by the text reader, whose separator is where the next
record begins; a record whose block holds such a place itself is put together again by its Content-Length, as a
compressed file is read by one task, in order. Only one record is held at a time.

assemble() joins requests, responses and metadata through the concurrent-to identifiers, in either direction and over one
record in between, and gives one nested row a capture; resolve() joins revisits to what they refer to.

Defined results: a null html counts as empty; null page_ids come last when the smallest is sought; of repeated rows one is
the response and the others revisit it; a null url gives no target; characters that a header cannot hold are
percent-encoded in the target; very long payloads are one record each; an empty table gives no archives and no rows;
records without a capture are no row of assemble(); a record that names several captures belongs to the first by name; a
block that ends before its Content-Length is marked as incomplete; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import lookup, materialise, scratch_path, slices
from paperloom.registry import spread

VERSION, END = "WARC/1.1", "\r\n\r\n"
NEXT_RECORD = f"{END}{VERSION}\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
#: Bytes of payloads in a batch that is handed back.
OUT_BYTES = 8 << 20

RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target string, date string, stated_digest string,"
    " content_type string, http_head string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, complete boolean"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts))).urn}>"


def _target(url: str | None) -> str | None:
    return None if url is None else "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def render(kind: str, own_id: str, content_type: str, block: str, **named: str | None) -> str:
    """One record without the blank lines at its end; names are header names with _ for -."""
    data = block.encode()
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": DATE, **{k.replace("_", "-"): v for k, v in named.items() if v is not None}}
    lines = [VERSION, *(f"{k}: {v}" for k, v in head.items()), f"Content-Type: {content_type}", f"Content-Length: {len(data)}"]
    return "\r\n".join(lines) + END + block


def page_records(no: int, page_id: object, url: str | None, html: str, digest: str, first: int) -> Iterator[str]:
    """Request, response (or revisit) and metadata of one page; ``first`` is the number of the page that holds the payload."""
    capture, target = record_id("capture", no), _target(url)
    yield render("request", record_id("request", no), "application/http; msgtype=request", f"GET {target or '/'} HTTP/1.1\r\n\r\n", WARC_Target_URI=target, WARC_Concurrent_To=capture)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
    common = {"WARC_Target_URI": target, "WARC_Payload_Digest": f"sha1:{digest}"}
    if first == no:
        yield render("response", capture, "application/http; msgtype=response", http + html, **common)
    else:
        yield render("revisit", capture, "application/http; msgtype=response", http, **common, WARC_Profile=PROFILE, WARC_Refers_To=record_id("capture", first))
    about = "" if page_id is None else f"page-id: {page_id}\r\n"
    yield render("metadata", record_id("metadata", no), "application/warc-fields", about, WARC_Target_URI=target, WARC_Concurrent_To=capture)


def numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, html, no (a number of the row's own) and key (SHA-256 of the payload), written once so that numbers stay."""
    html = F.coalesce("html", F.lit(""))
    rows = spread(pages.select("page_id", "url", html.alias("html"))).withColumn("no", F.monotonically_increasing_id())
    return materialise(rows.withColumn("key", F.sha2("html", 256)), "warc-pages")


def write_pages(pages: DataFrame, path: str) -> None:
    """Write the pages as archives under path. Only keys of payloads that repeat are joined back; payloads are not shuffled for few of them."""
    rows = numbered(pages)
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "no"))
    repeated = rows.groupBy("key").agg(F.count("*").alias("n"), smallest.alias("first")).where("n > 1").select("key", F.col("first.no").alias("first"))
    told = lookup(rows, materialise(repeated, "warc-repeated"), "key").select("no", "page_id", "url", "html", F.coalesce("first", "no").alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in slices(batches, column=3):
            records = []
            for no, page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if not opened:
                    records.append(render("warcinfo", record_id("warcinfo", no), "application/warc-fields", f"format: {VERSION}\r\n"))
                    opened = True
                records += page_records(no, page_id, url, html, digest_of(html.encode()), first)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["record"])

    told.mapInArrow(run, "record string").write.option("lineSep", END).option("compression", "gzip").text(path)


@dataclass
class Parsed:
    """The record that is being read: its bytes so far, and its header once that is complete."""

    data: bytearray = field(default_factory=bytearray)
    head: list[tuple[str, str]] | None = None
    start: int = 0
    length: int = 0

    def add(self, more: bytes) -> None:
        known = max(0, len(self.data) - len(END))
        self.data += more
        if self.head is None and (at := self.data.find(END.encode(), known)) >= 0:
            lines = self.data[:at].decode("utf-8", "replace").split("\r\n")
            self.head = [(name.strip().lower(), value.strip()) for name, _, value in (line.partition(":") for line in lines)]
            self.start, self.length = at + len(END), next((int(v) for k, v in self.head if k == "content-length" and v.isdigit()), 0)

    @property
    def complete(self) -> bool:
        return self.head is not None and len(self.data) - self.start >= self.length

    def row(self) -> tuple:
        head = dict(reversed(self.head or []))
        block = bytes(self.data[self.start : self.start + self.length])
        kind, content = head.get("warc-type"), head.get("content-type", "")
        http, fields, payload = None, None, block
        if content.startswith("application/http"):
            http_head, _, payload = block.partition(END.encode())
            http = http_head.decode("latin-1")
        elif content.startswith("application/warc-fields"):
            fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in reversed(block.decode("utf-8", "replace").split("\r\n"))) if k.strip()]
            fields = list(dict(fields).items())
        stated = head.get("warc-payload-digest")
        near = [v for k, v in self.head or [] if k == "warc-concurrent-to"]
        return (
            head.get("warc-record-id"), kind, near, head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), stated and stated.partition(":")[2],
            content, http, fields, payload, len(payload), digest_of(payload), self.complete,
        )


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type")]
    + [("concurrent_to", pa.list_(pa.string()))]
    + [(n, pa.string()) for n in ("refers_to", "target", "date", "stated_digest", "content_type", "http_head")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_())]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the gzip archives under path, without warcinfo; payloads, their lengths and digests are what was read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now, current = [], 0, None, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for batch in slices(batches, column=0):
            for value, name, block_start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if block_start:
                    raise ValueError(f"{name} is read in parts: archives must be compressed files")
                data = value.as_buffer().to_pybytes()
                if name == now and current is not None and not current.complete:
                    current.add(NEXT_RECORD.encode() + data)  # the block itself held the separator
                else:
                    if current is not None:
                        rows.append(current.row())
                        held += current.length
                    if name != now:
                        now, data = name, data.removeprefix(f"{VERSION}\r\n".encode())
                    current = Parsed()
                    current.add(data)
                if held > OUT_BYTES or len(rows) >= 2000:
                    yield out()
                    rows, held = [], 0
        if current is not None:
            rows.append(current.row())
        yield out()

    raw = spark.read.option("lineSep", NEXT_RECORD).text(path).select(F.col("value").cast("binary").alias("value"), "_metadata.file_path", "_metadata.file_block_start")
    return raw.mapInArrow(run, RECORD).where("record_type <> 'warcinfo'")


def owners(records: DataFrame) -> DataFrame:
    """record_id and capture: each capture is its own, other records belong to one that they name, that names them, or that a record between them does.

    Only identifiers are joined. Links of captures are left out of the second round, so a record takes the nearest capture.
    """
    ids = records.select("record_id", F.col("record_type").isin(*CAPTURES).alias("is_capture"), F.explode_outer("concurrent_to").alias("other"))
    ids = materialise(ids, "warc-links")
    named = ids.where("other IS NOT NULL")
    links = named.select(F.col("record_id").alias("a"), F.col("other").alias("b")).unionByName(named.select(F.col("other").alias("a"), F.col("record_id").alias("b")))
    captures = ids.where("is_capture").select("record_id").distinct()
    rest = ids.where("NOT is_capture").select("record_id").distinct()
    near = links.join(rest, F.col("a") == F.col("record_id"), "left_semi")
    first = near.join(captures, F.col("b") == F.col("record_id")).groupBy(F.col("a").alias("record_id")).agg(F.min("b").alias("capture"))
    first = materialise(first, "warc-owners")
    left = near.join(first, F.col("a") == F.col("record_id"), "left_anti")
    second = left.join(first, F.col("b") == F.col("record_id")).groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias("capture"))
    return captures.select("record_id", F.col("record_id").alias("capture")).unionByName(first).unionByName(second)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a capture: its id, type, target, date, refers_to, payload (on request), and the nested requests and metadata by record_id.

    A capture's records meet in its row, as its nested lists hold them; without payloads none is shuffled.
    """
    slim = records if payloads else records.drop("payload")
    main = [c for c in slim.columns if c not in ("concurrent_to", "fields")]
    joined = slim.join(owners(records), "record_id")
    request = F.struct("record_id", "target", "date", "http_head", *(["payload"] if payloads else []))
    about = F.struct("record_id", "content_type", "fields", *(["payload"] if payloads else []))
    kind = F.col("record_type")
    before = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    listed = lambda what, row: F.array_sort(F.collect_list(F.when(kind == what, row)), before).alias(what)
    grouped = joined.groupBy("capture").agg(
        F.max(F.when(kind.isin(*CAPTURES), F.struct(*main))).alias("c"),
        listed("request", request),
        listed("metadata", about),
    )
    return grouped.select("c.*", "request", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """captures with ``referred``: id, payload length, digest and metadata of the response that a revisit refers to, else null."""
    asked = captures.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct()
    held = captures.join(asked, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to")).agg(F.first(F.struct("record_id", "payload_bytes", "payload_digest", "metadata")).alias("referred"))
    return lookup(captures, materialise(held, "warc-referred"), "refers_to")


def warc_digest(pages: DataFrame) -> DataFrame:
    """The pages written as archives in the shared folder and read back, as ids, lengths and digests."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(pages, path)
    records = materialise(read_records(spark, path).drop("payload"), "warc-records")  # the archives are read once; lengths and digests are those of what was read
    captures = resolve(materialise(assemble(records, payloads=False), "warc-captures"))
    kind = dict(pages.dtypes)["page_id"]
    page = lambda metadata: F.element_at(F.get(F.col(metadata), 0)["fields"], "page-id").cast(kind)
    own = F.col("record_type") == "revisit"
    return captures.select(
        page("metadata").alias("page_id"),
        F.when(own, F.col("referred.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("referred.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(own, page("referred.metadata")).alias("refers_to"),
    )
