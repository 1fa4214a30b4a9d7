"""SQL twins of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from paperloom.llm import license_scan, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# CRC-32 by table: the table's entries follow from the reflected polynomial, the texts from their hexadecimal digits
_TABLE = "SELECT list(c ORDER BY i) AS crc_table FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))"
_BYTES = "list_transform(range(octet_length(encode(coalesce(text, '')))), lambda k: instr('0123456789ABCDEF', digits[2 * k + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * k + 2]) - 17)"
_CRC = f"SELECT doc_id, text, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS digits FROM documents), ({_TABLE})"
SHARDING = f"""WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, text_crc32 FROM ({_CRC})),
p AS (SELECT *, (sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS shard_start, (SELECT sum(size) FROM s)::BIGINT AS total FROM s),
c AS (SELECT *, least(23, floor((2 * shard_start + size) * 24 / (2 * total)::DOUBLE)::INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY shard_start) - 1 AS slot, NULL::INTEGER AS grown_shard, shard_start FROM c"""


def _template_rows() -> str:
    """A row for each template: number, label, exact, words of a window, words."""
    words = [[w.decode() for w in license_scan.words_of(t.wording.encode())] for t in license_scan.TEMPLATES]
    return ", ".join(f"({k}, '{t.label}', {str(t.exact).lower()}, {t.window}, {w!r})" for k, (t, w) in enumerate(zip(license_scan.TEMPLATES, words)))


LICENSES = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, k, unnest(range(len(ws) - k + 1)) AS pos, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram FROM w, (VALUES ({license_scan.PAIR}), ({license_scan.FOUR})) AS sizes(k) WHERE len(ws) >= k),
t(template, label, exact, k, tw) AS (VALUES {_template_rows()}),
p AS (SELECT template, exact, k, len(tw) - k + 1 AS grams, unnest(range(len(tw) - k + 1)) AS place, unnest(list_transform(range(1, len(tw) - k + 2), lambda i: array_to_string(tw[i:i + k - 1], ' '))) AS gram FROM t),
v AS (SELECT doc_id, template, exact, grams, pos - place AS diagonal, count(DISTINCT place) AS votes, min(pos) AS first, max(pos + p.k - 1) AS last FROM g JOIN p ON g.gram = p.gram AND g.k = p.k GROUP BY ALL),
e AS (SELECT * FROM v WHERE CASE WHEN exact THEN votes = grams ELSE votes >= least({license_scan.LEAST_VOTES}, grams) END),
a AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER k > {license_scan.NEIGHBOUR}, true) THEN 1 ELSE 0 END AS apart FROM e WINDOW k AS (PARTITION BY doc_id, template ORDER BY diagonal)),
n AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM a),
s AS (SELECT doc_id, template, span, list(diagonal) AS diagonals, min(first) AS first, max(last) AS last FROM n GROUP BY 1, 2, 3),
m AS (SELECT s.doc_id, label, exact, template, first, last, len(tw) AS long, len(list_filter(range(len(tw)), lambda i: len(list_filter(diagonals, lambda d: i + d >= 0 AND ws[i + d + 1] = tw[i + 1])) > 0)) / len(tw)::DOUBLE AS coverage FROM s JOIN t USING (template) JOIN w USING (doc_id)),
f AS (SELECT * FROM m WHERE CASE WHEN exact THEN coverage = 1 ELSE coverage >= {license_scan.COVERAGE} AND last - first + 1 <= {license_scan.STRETCH} * long END),
r AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN r USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.other, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1) m USING (doc_id)"""



def _kind(k: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: the texts between the matches and the matches, one after the other."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {k} AS kind, '{rule.name}' AS name, i, sum(before + n) OVER (PARTITION BY doc_id ORDER BY i) AS stop, n, held >= {rule.least} AS counts FROM (
SELECT doc_id, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(h, lambda x: length(x))) AS held, unnest(list_transform(b[:len(m)], lambda x: length(x))) AS before
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS h, regexp_split_to_array(t, '{pattern}') AS b FROM d))"""


_SPANS = " UNION ALL ".join(f"SELECT * FROM ({_kind(k, r)}) WHERE counts" for k, r in enumerate(secret_scan.RULES))
_JOINED = "coalesce(string_agg(concat(name, ':', (stop - n)::BIGINT, ':', stop::BIGINT), ',' ORDER BY stop - n, kind){}, '')"
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_SPANS})
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256({_JOINED.format(" FILTER (kind < 3)")}) AS base_sha256, {_JOINED.format(" FILTER (kind IS NOT NULL)")} AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY 1"""

# CRC-32 of the features: worked out once for each distinct one
_FEATURE_BYTES = "list_transform(range(octet_length(encode(f))), lambda k: instr('0123456789ABCDEF', digits[2 * k + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * k + 2]) - 17)"
IMPORTANCE = f"""WITH a AS (SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (SELECT id, own, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM a),
u AS (SELECT id, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: concat(ws[k], ' ', ws[k + 1])))) AS f FROM w),
h AS (SELECT DISTINCT f, hex(encode(f)) AS digits FROM u),
c AS (SELECT f, xor(list_reduce({_FEATURE_BYTES}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM h, ({_TABLE})),
b AS (SELECT id, own, bucket, count(*) AS n FROM u JOIN c USING (f) GROUP BY ALL),
t AS (SELECT coalesce(sum(n) FILTER (own), 0)::DOUBLE AS ds, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS dt FROM b),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE + 1) * (any_value(ds) + 10000)) / ((coalesce(sum(n) FILTER (own), 0)::DOUBLE + 1) * (any_value(dt) + 10000))))::BIGINT AS gain FROM b, t GROUP BY bucket),
d AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM b JOIN g USING (bucket) WHERE own GROUP BY id),
s AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS eligible,
coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('7:', w.id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d ON d.doc_id = w.id WHERE own),
r AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM r"""

FILL_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

ORACLES = {
    "op7_secret_scan": SECRETS, "op1_sharding": SHARDING, "op3_license_scan": LICENSES, "op9_jaccard_join": JACCARD,
    "op11_importance": IMPORTANCE, "op12_fill_middle": FILL_MIDDLE, "op13_warc": WARC,
}
