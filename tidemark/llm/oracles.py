"""DuckDB SQL with the results of those text queries that SQL can express."""

from __future__ import annotations

import string

from tidemark.llm import sharding
from tidemark.llm.lm_score import WORDS

_LOWERED = f"translate(coalesce(text,''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, strlen(coalesce(text,'')) AS n FROM documents),
places AS (SELECT doc_id, p, substr(h, 2*p+1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n-49))) AS p FROM docs)),
firsts AS (SELECT s, min(doc_id) AS f FROM places GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS b FROM (SELECT doc_id, p FROM places JOIN firsts USING (s) WHERE doc_id > f) CROSS JOIN (SELECT unnest(range(0, 50)) AS o)),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR prev <> b-1) AS n_spans FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS prev FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2*b+1, 2), '' ORDER BY b) AS k FROM (SELECT doc_id, h, unnest(range(0, n)) AS b FROM docs SEMI JOIN spans USING (doc_id)) ANTI JOIN gone USING (doc_id, b) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN s.doc_id IS NULL THEN d.h ELSE coalesce(k.k, '') END)) AS kept_sha256
FROM docs d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents)),
items AS (SELECT item_id, ws, len(ws) AS n, least(10, len(ws)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM benchmark) WHERE len(ws)>0),
runs AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') AS r FROM (SELECT item_id, ws, m, unnest(range(1, n-m+2)) AS i FROM items)),
places AS (SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') AS r FROM (SELECT doc_id, ws, m, unnest(range(1, greatest(1, n-m+2))) AS i FROM docs CROSS JOIN (SELECT DISTINCT m FROM runs))),
hits AS (SELECT DISTINCT doc_id, m, i, item_id FROM places JOIN runs USING (m, r)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items, sha256(coalesce(k.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named k USING (doc_id)"""


def _mixed(x: str) -> str:
    """The 32-bit finalizer of an unsigned expression."""
    for shift, factor in ((16, sharding.FIRST), (13, sharding.SECOND)):
        x = f"list_transform([{x}], lambda h: (xor(h, h >> {shift}) * {factor}::UBIGINT) & {sharding.LOW}::UBIGINT)[1]"
    return f"list_transform([{x}], lambda h: xor(h, h >> 16))[1]"


def _rounds(source: str) -> str:
    """One application of the permutation to ``x`` of ``source``, whose halves are ``a`` and ``b`` bits wide."""
    step = f"SELECT *, x >> b AS l, x & ((1::UBIGINT << b) - 1) AS r FROM {source}"
    for k, key in enumerate(sharding.Feistel(2).keys):
        width = "a" if k % 2 == 0 else "b"
        step = f"SELECT * EXCLUDE (l, r), r AS l, xor(l, {_mixed(f'xor(r, {key}::UBIGINT)')} & ((1::UBIGINT << {width}) - 1)) AS r FROM ({step})"
    return f"SELECT row_no, n, a, b, (l << b) | r AS x FROM ({step})"


# Fixed value: the reversed polynomial of CRC-32.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8),
 lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) s(i)))"""


def _crc(n: str, hexed: str) -> str:
    """CRC-32 of ``n`` bytes in hexadecimal digits, with the table ``t``."""
    byte = f"list_transform(range(0, {n}), lambda i: ('0x' || substr({hexed}, 2*i+1, 2))::BIGINT)"
    return f"xor(list_reduce({byte}, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295)"


SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
sized AS (SELECT doc_id, text, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, text, n + 1 AS size, {_crc("n", "h")} AS text_crc32 FROM sized, crc_table),
rows_no AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text) - 1 AS row_no FROM crcs),
domain AS (SELECT n, bits // 2 AS a, bits - bits // 2 AS b FROM (SELECT n, greatest(2, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END) AS bits FROM (SELECT count(*) AS n FROM documents))),
start AS (SELECT row_no, n, a, b, row_no::UBIGINT AS x FROM rows_no, domain),
walk AS ({_rounds("start")} UNION ALL {_rounds("(SELECT * FROM walk WHERE x >= n)")}),
places AS (SELECT row_no, x::BIGINT AS place FROM walk WHERE x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {sharding.SHARDS})::INTEGER AS shard, place // {sharding.SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM rows_no JOIN places USING (row_no)"""


TRIE = rf"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(e ORDER BY p) AS es, list(words ORDER BY p) AS ws FROM turns GROUP BY c),
heads AS (SELECT *, c - c % 20 AS base, {_crc("length(c::VARCHAR)", "hex(c::VARCHAR)")} % 4 AS h FROM own, crc_table),
whole AS (SELECT a.c, list_concat(coalesce(b.es, [])[1:a.h], a.es[a.h+1:]) AS es, list_concat(coalesce(b.ws, [])[1:a.h], a.ws[a.h+1:]) AS ws
  FROM heads a LEFT JOIN own b ON a.base = b.c),
members AS (SELECT c, d, len(es) AS n, array_to_string(es[1:d], '') AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words
  FROM (SELECT *, unnest(range(0, len(es) + 1)) AS d FROM whole)),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n) AS ends FROM members GROUP BY k, d),
kids AS (SELECT substr(k, 1, 64 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
below AS (SELECT substr(k, 1, 64 * j) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM counted) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM counted a JOIN below USING (k) LEFT JOIN nodes b ON a.d > 0 AND b.k = substr(a.k, 1, 64 * (a.d - 1))"""


def _model(name: str, rows: str) -> str:
    """Tables of one bigram model: pair, follower and word counts."""
    return f"""
{name}_pair AS (SELECT a, b, count(*) AS c FROM pairs {rows} GROUP BY a, b),
{name}_before AS (SELECT a, sum(c) AS seen, count(*) AS kinds FROM {name}_pair GROUP BY a),
{name}_word AS (SELECT b, sum(c) AS c FROM {name}_pair GROUP BY b),
{name}_all AS (SELECT coalesce(sum(c), 0) + (SELECT count(*) + 2 FROM vocab) AS n FROM {name}_pair)"""


def _loss(name: str) -> str:
    single = f"((coalesce({name}_word.c, 0) + 1.0) / (SELECT n FROM {name}_all))"
    return (f"-ln(CASE WHEN {name}_before.a IS NULL THEN {single} ELSE (coalesce({name}_pair.c, 0) + {name}_before.kinds * {single})"
            f" / CAST({name}_before.seen + {name}_before.kinds AS DOUBLE) END)")


def _joined(name: str) -> str:
    return (f"LEFT JOIN {name}_pair ON {name}_pair.a = kinds.a AND {name}_pair.b = kinds.b LEFT JOIN {name}_before ON {name}_before.a = kinds.a "
            f"LEFT JOIN {name}_word ON {name}_word.b = kinds.b")


CROSS_ENTROPY = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text,'')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws)+1)) AS i, unnest(ws) AS word FROM docs),
vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS k FROM (SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT {WORDS})),
seq AS (SELECT doc_id, i, coalesce(k, 1) AS code FROM words LEFT JOIN vocab USING (word) UNION ALL SELECT doc_id, len(ws)+1, 0 FROM docs WHERE len(ws) > 0),
pairs AS (SELECT doc_id, lag(code, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS a, code AS b FROM seq),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),{_model("target", "SEMI JOIN good USING (doc_id)")},{_model("background", "")},
kinds AS (SELECT DISTINCT a, b FROM pairs),
losses AS (SELECT kinds.a, kinds.b, {_loss("target")} AS t, {_loss("background")} AS g FROM kinds {_joined("target")} {_joined("background")})
SELECT d.doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(t, 0.0), 6) AS loss_target, round(coalesce(g, 0.0), 6) AS loss_background,
 round(coalesce(t - g, 0.0), 6) AS difference
FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n, avg(t) AS t, avg(g) AS g FROM pairs JOIN losses USING (a, b) GROUP BY doc_id) USING (doc_id)"""

ORACLES = {"op7_repeats": REPEATS, "op8_decontaminate": CONTAMINATION, "op9_cross_entropy": CROSS_ENTROPY, "op11_sharding": SHARDING,
           "op13_prefix_trie": TRIE}
