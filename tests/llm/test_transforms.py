"""Importance resampling, fill-in-the-middle and WARC archives against plain Python, on hard rows."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import common, fill_middle, importance, warc
from paperloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    (1, "The Cat sat on the mat. " * 9), (2, None), (3, ""), (4, " \t--\n"), (5, "été ÅÉ 😀x " * 30), (6, "x" * 300 + " " + "y" * 100), (7, "one"), (8, "<P>one two"), (9, "a<S" + "<M" * 3),
    (9, "the same id, other words " * 8), (None, "no id at all " * 12), (None, "no id at all " * 12), (10, "The Cat sat on the mat. " * 9), (11, "ab€😀\n" * 3000), (12, "€" * 4000 + "<M>"),
    (13, "long words " + "z" * 5000 + " and more " * 900), (14, "\n\n\nx\n"),
]
KINDS = "doc_id long, text string, weight string, n long, row string, form int, bytes string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", 5, "r", 1, "b") for i, t in TEXTS], KINDS).repartition(3).cache()


@pytest.mark.parametrize("name", ["op11_importance", "op12_fill_middle", "op13_warc"])
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df, found = QUERIES[name](spark, small), con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == want and want


# importance resampling


def features(text):
    words = WORD.findall((text or "").translate(FOLD))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_features_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [t for _, t in TEXTS]
    got, words = [Counter() for _ in texts], np.zeros(len(texts), dtype=int)
    for word_text, feature_text, found in importance.hashed_features(pa.array(["skipped", *texts], pa.string())[1:]):
        words += np.bincount(word_text, minlength=len(texts))
        for k, b in zip(feature_text, found):
            got[k][b] += 1
    assert [dict(g) for g in got] == [dict(Counter(map(bucket, features(t)[1]))) for t in texts]
    assert words.tolist() == [len(features(t)[0]) for t in texts]


def expected_draw(rows, target):
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([t for _, t in rows], target))
    ds, dt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ds + 10000) / ((s[b] + 1) * (dt + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // max(1, len(found))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    order = sorted((k for k in range(len(out)) if out[k][4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    ranks = {k: n + 1 for n, k in enumerate(order[: 25 * len(order) // 100])}
    return sorted((*map(str, o[:4]), str(ranks.get(k))) for k, o in enumerate(out))


@pytest.mark.parametrize("target", [["the cat and the mat", "no id", None], []])
def test_ranks(spark, docs, target):
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.importance_digest(docs, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == expected_draw(TEXTS, target)


def test_resample_keeps_rows(spark, docs):
    target = spark.createDataFrame([("the cat and the mat",)], "text string")
    drawn = importance.resample(docs, target, percent=50)
    ranks = importance.ranked(docs, target, percent=50).where("rank IS NOT NULL")
    assert {c.lower() for c in docs.columns} <= set(drawn.columns)
    assert {(r["doc_id"], r["score"]) for r in drawn.collect()} == {(r["doc_id"], r["score"]) for r in ranks.collect()}
    assert importance.resample(docs.limit(0), target).count() == 0


def test_target_like_documents_are_drawn(spark):
    """Without likeness a quarter of the like documents would be drawn; with it nearly all of the drawn ones are."""
    rows = [(k, ("alpha beta gamma delta " if k % 4 == 0 else "one two three four ") * 20) for k in range(400)]
    ranks = importance.importance_digest(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("alpha beta gamma delta " * 50,)], "text string"))
    drawn = [r["doc_id"] for r in ranks.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(k % 4 == 0 for k in drawn) > 50


def test_registers():
    data = bytes(range(256)) * 3
    starts, lengths = np.array([0, 5, 700, 767, 3]), np.array([768, 0, 60, 1, importance.STEPS])
    got = importance.advance(np.frombuffer(data, dtype=np.uint8), starts, lengths, np.full(5, 0xFFFFFFFF, dtype=np.uint32)) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[s : s + n]) for s, n in zip(starts, lengths)]


# fill-in-the-middle


def moved(i, text):
    text = text or ""
    n, digits = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (i, n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.mark.parametrize("chunk", [1 << 16, 4096, 50])
def test_cuts(spark, docs, monkeypatch, chunk):
    """The same cuts whether a text is scanned at once or in chunks that split code points and marks."""
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    out = fill_middle.transform(docs)
    got = out.select("doc_id", *fill_middle.FIELDS, fill_middle.restore(F.col("output"), F.col("form")).alias("again"), F.coalesce("text", F.lit("")).alias("text"), F.col("row").alias("kept"))
    rows = got.collect()
    key = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert sorted(str(tuple(r[k] for k in key)) for r in rows) == sorted(str(moved(i, t)) for i, t in TEXTS)
    assert all(r["again"] == r["text"] and r["kept"] == "r" for r in rows)


def test_all_forms_and_no_rows(spark, docs):
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert {r["form"] for r in fill_middle.transform(many).select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_lines_as_units(spark, monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    rows = [(k, "".join(f"line {j}\n" * (j % 3) for j in range(k)) + "end") for k in range(40)]
    for r in fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), fill_middle.lines()).collect():
        lines = r["text"].splitlines(keepends=True)
        assert r["n"] == len(lines)
        if r["form"] == "psm":
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            assert r["output"] == f"<P>{''.join(lines[:a])}<S>{''.join(lines[b:])}<M>{''.join(lines[a:b])}"


def test_functions_compose_in_any_grouping():
    """The function of a text is that of its parts one after the other, wherever it is parted; counts add up along it."""
    text = "aé€😀<P><<S>x".encode() * 20
    for auto in (fill_middle.code_points(), fill_middle.marks(), fill_middle.lines()):
        (whole,), (counts,) = fill_middle.functions_of(auto, pa.array([text], pa.binary()))
        for at in (1, 17, 130, 200):
            ends, parts = fill_middle.functions_of(auto, pa.array([text[:at], text[at:]], pa.binary()))
            assert [ends[1][ends[0][s]] for s in range(auto.states)] == whole
            assert [parts[0][s] + parts[1][ends[0][s]] for s in range(auto.states)] == counts
        state = 0
        for byte in text:
            state = int(auto.step[state, byte])
        assert state == whole[0]


# WARC

PAGES = [
    (5, "http://a b\r\nX: y", None), (4, None, ""), (6, "u", "<p>one</p>"), (7, "v", "<p>one</p>"), (3, "w", "<p>one</p>"), (8, "u", "WARC/1.1\r\nWARC-Type: request\r\n\r\nx\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny"),
    (9, "é", "é€" * 90000), (9, "é", "é€" * 90000), (None, None, "<p>one</p>"), (None, "u", "q"), (None, "u", "q"), (10, "u", "\r\n\r\nWARC/1.1\r\n"), (11, "u", "WARC/1.1\r\n"), (12, "u", "x\r\n\r\n"), (13, "u", "\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "n", "k") for p in PAGES], "page_id long, url string, html string, no string, key string").repartition(2).cache()


def expected_captures(pages):
    out, first = [], {}
    for page_id, html in sorted(((p, h or "") for p, _, h in pages), key=lambda r: (r[0] is None, r[0] or 0)):
        data = html.encode()
        again = html in first
        first.setdefault(html, page_id)
        out.append(str((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html] if again else None)))
    return sorted(out)


@pytest.mark.parametrize("bytes_of_broadcast", [common.BROADCAST_BYTES, 0])
def test_archives_round_trip(spark, pages, monkeypatch, bytes_of_broadcast):
    """The same captures whether repeated payloads are looked up in a broadcast table or with their hot keys apart."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", bytes_of_broadcast)
    assert sorted(str(tuple(r)) for r in warc.warc_digest(pages).collect()) == expected_captures(PAGES)


def test_hot_payloads_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(k, "u", "hot" if k % 3 else f"page {k // 2}") for k in range(60)]
    got = warc.warc_digest(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == expected_captures(rows)


def test_no_pages(spark, pages):
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_archives_are_plain_warc(spark, pages, tmp_path):
    """Each file is a row of records with true lengths, opened by a warcinfo record; nested rows hold all of a capture's records."""
    path = str(tmp_path / "archives")
    warc.write_pages(pages, path)
    n = Counter()
    for file in (tmp_path / "archives").glob("*.gz"):
        data, kinds = gzip.open(file).read(), []
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            length = int(fields["Content-Length"])
            assert rest[length : length + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[length + 4 :]
        assert not kinds or kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
        n.update(kinds)
    assert n["request"] == n["metadata"] == n["response"] + n["revisit"] == len(PAGES)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(captures) == len(PAGES) and all(len(c["request"]) == 1 and len(c["metadata"]) == 1 and c["complete"] for c in captures)
    assert all(c["stated_digest"] == c["payload_digest"] for c in captures if c["record_type"] == "response")
    assert {bytes(c["payload"]).decode() for c in captures if c["record_type"] == "response"} == {h or "" for _, _, h in PAGES}


def test_foreign_transactions(spark, tmp_path):
    """Links in either direction and over one record in between; records without a capture; a block that is cut short."""
    ids = {k: f"<urn:x:{k}>" for k in "abcdefgh"}
    records = [
        warc.render("response", ids["a"], "application/http", "HTTP/1.1 200 OK\r\n\r\nbody", WARC_Concurrent_To=ids["b"]),
        warc.render("request", ids["b"], "application/http", "GET / HTTP/1.1\r\n\r\n"),
        warc.render("metadata", ids["c"], "application/warc-fields", "via: x\r\n", WARC_Concurrent_To=ids["b"]),
        warc.render("metadata", ids["d"], "application/warc-fields", "via: y\r\n", WARC_Concurrent_To=ids["a"]),
        warc.render("metadata", ids["e"], "application/warc-fields", "", WARC_Concurrent_To="<urn:x:none>"),
        warc.render("resource", ids["f"], "text/plain", "plain\r\n\r\nWARC/1.1\r\nmore"),
        warc.render("response", ids["g"], "application/http", "HTTP/1.1 200 OK\r\n\r\ncut short")[:-5],
    ]
    with gzip.open(tmp_path / "one.warc.gz", "wb") as f:
        f.write("".join(r + "\r\n\r\n" for r in records[:-1]).encode() + records[-1].encode())
    rows = {r["record_id"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "one.warc.gz"))).collect()}
    assert sorted(rows) == [ids[k] for k in "afg"]
    assert [r["record_id"] for r in rows[ids["a"]]["metadata"]] == [ids["c"], ids["d"]] and [r["record_id"] for r in rows[ids["a"]]["request"]] == [ids["b"]]
    assert rows[ids["a"]]["metadata"][1]["fields"] == {"via": "y"} and bytes(rows[ids["a"]]["payload"]) == b"body"
    assert bytes(rows[ids["f"]]["payload"]) == b"plain\r\n\r\nWARC/1.1\r\nmore"
    assert [rows[ids[k]]["complete"] for k in "afg"] == [True, True, False]
