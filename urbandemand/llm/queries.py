"""The text operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_trie import prefix_trie
from .decontamination import SLOP, decontaminate
from .exact_dedup import exact_dedup
from .katz import score_katz
from .language import fit_languages, identify_language
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import find_personal_data
from .quality import fit_quality, score_quality
from .row_pattern import match_rows
from .secret_scan import scan_secrets
from .toxicity import fit_toxicity, score_toxicity
from .warc import archived


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    near = F.size("near_items").cast("long").alias("n_near_items")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", near, F.array_join("near_items", ",").alias("near_items"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, fit_languages(docs))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_katz(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rows(table(spark, sf_dir, "clicks"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_personal_data": op9_personal_data,
    "op10_toxicity": op10_toxicity,
    "op11_row_pattern": op11_row_pattern,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_warc": op13_warc,
}

_OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""

_OP7_SQL = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM s),
p AS (SELECT source, greatest(1, ceil(rate / 500.0))::INT AS parts, rate / greatest(1, ceil(rate / 500.0)) AS mean FROM r),
t AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
      FROM (SELECT source, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::INT + 1)) AS k FROM p)),
a AS (SELECT source, list(upto ORDER BY k) AS upto FROM t GROUP BY source),
u AS (SELECT d.doc_id, d.source, unnest(range(1, p.parts + 1)) AS part FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
v AS (SELECT doc_id, source, part, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS x FROM u),
c AS (SELECT v.doc_id, v.source, sum(len(list_filter(a.upto, lambda y: y <= v.x)))::INT AS n_copies
      FROM v JOIN a ON v.source IS NOT DISTINCT FROM a.source GROUP BY v.doc_id, v.source),
e AS (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1))::INT AS copy_no FROM c)
SELECT d.*, n_copies, copy_no,
       ('0x' || substr(md5('order7:' || d.doc_id || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM e JOIN documents d ON d.doc_id = e.doc_id
"""

_OP1_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
i2 AS (SELECT item_id, ws, least(len(ws), 10) AS span FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, span, ws[s : s + span - 1] AS w FROM (SELECT item_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS s FROM i2)),
spans AS (SELECT DISTINCT span FROM win),
dp AS (SELECT doc_id, s, span, ws[s : s + span - 1] AS w FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS s FROM dw, spans)),
h AS (SELECT dp.doc_id, dp.s, dp.span, win.item_id FROM dp JOIN win ON dp.w = win.w),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS q FROM dw),
freq AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
wp AS (SELECT item_id, w, span, unnest(w) AS term, unnest(range(span)) AS j FROM win),
anchor AS (SELECT item_id, w, span, arg_min(wp.term, (coalesce(n, 0), j)) AS term, arg_min(j, (coalesce(n, 0), j)) AS j FROM wp LEFT JOIN freq ON wp.term = freq.term GROUP BY ALL),
cand AS (SELECT DISTINCT doc_id, item_id, w, span, q - j + e AS d FROM tok JOIN anchor ON tok.term = anchor.term, (VALUES (-1), (0), (1)) AS x (e)),
nr AS (SELECT DISTINCT cand.doc_id, item_id::VARCHAR AS item_id FROM cand JOIN dw ON cand.doc_id = dw.doc_id
       WHERE len(list_filter(range(span), lambda j: list_contains(ws[greatest(d + j, 1) : d + j + 2], w[j + 1]))) = span),
ni AS (SELECT doc_id, count(*) AS n_near_items, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM nr GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items, coalesce(near_items, '') AS near_items
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id LEFT JOIN ni ON dw.doc_id = ni.doc_id
"""

_OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i : i + 4] AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.v)::BIGINT AS component_id, w.doc_id = min(r.v) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.u = w.doc_id GROUP BY w.doc_id, n.n
"""

_OP11_SQL = """
WITH r AS (SELECT client_id, ts, click_id, kind, floor(100 * value + 0.5)::BIGINT AS cents, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, kind NULLS FIRST, value NULLS FIRST) AS n
           FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)),
b AS (SELECT *, lag(cents) OVER w AS cents_before, coalesce(ts - lag(ts) OVER w <= INTERVAL 30 MINUTE, false) AS near, sum(coalesce(cents, 0)) OVER w AS upto FROM r WINDOW w AS (PARTITION BY client_id ORDER BY n)),
l AS (SELECT *, CASE WHEN near AND kind <> 'error' AND cents < cents_before THEN 'D' WHEN near AND kind <> 'error' AND cents > cents_before THEN 'U' ELSE 'x' END AS label FROM b),
s AS (SELECT *, sum((label = 'x')::INT) OVER (PARTITION BY client_id ORDER BY n) AS segment, lead(label) OVER (PARTITION BY client_id ORDER BY n) AS label_after FROM l),
g AS (SELECT client_id, segment, min(n) AS opens, string_agg(label, '' ORDER BY n) AS labels, max(n) FILTER (label = 'U') AS rise FROM s GROUP BY client_id, segment),
m AS (SELECT a.client_id, a.n, a.click_id AS first_id, e.click_id AS rise_id, p.click_id AS goal_id, a.cents, a.upto, e.upto AS rise_upto, p.cents AS goal_cents, g.rise,
             'A' || substr(g.labels, (a.n - g.opens + 2)::BIGINT, (g.rise - a.n)::BIGINT) AS labels
      FROM s a JOIN g ON a.client_id = g.client_id AND a.segment = g.segment AND a.cents IS NOT NULL AND a.label_after = 'D' AND g.rise > a.n
      JOIN s e ON e.client_id = a.client_id AND e.n = g.rise
      LEFT JOIN s p ON p.client_id = a.client_id AND p.n = g.rise + 1 AND p.near AND p.kind = 'click' AND p.cents >= a.cents)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY n) AS match_no, first_id, CASE WHEN goal_cents IS NULL THEN rise_id ELSE goal_id END AS last_id,
       rise - n + 1 + (goal_cents IS NOT NULL)::BIGINT AS n_rows, (rise_upto - upto + cents + coalesce(goal_cents, 0))::BIGINT AS sum_cents,
       sha256(labels || CASE WHEN goal_cents IS NULL THEN '' ELSE 'P' END) AS labels_sha256
FROM m
"""

_OP12_SQL = """
WITH c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
          lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h FROM c),
p AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN c b ON b.conv_id = h.base),
m AS (SELECT conv_id, path, d AS depth, path[1:d] AS node FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM p)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM m GROUP BY node, depth),
k AS (SELECT node[1:depth - 1] AS parent, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[n.depth][2]) END AS own_tokens FROM n LEFT JOIN k ON k.depth = n.depth AND k.parent = n.node),
t AS (SELECT node[1:d] AS node, d AS depth, sum((n_children = 0)::INT) AS n_leaves, sum(own_tokens) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN t ON t.depth = w.depth AND t.node = w.node LEFT JOIN w u ON w.depth > 0 AND u.depth = w.depth - 1 AND u.node = w.node[1:w.depth - 1]
"""

_OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep_id FROM pages)
SELECT page_id, strlen(payload) AS payload_bytes, CASE WHEN page_id IS NOT DISTINCT FROM keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep_id THEN keep_id END AS refers_to,
       list_reduce(list_transform(range(8), lambda k: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(payload), (5 * k + 1)::BIGINT, 5))::BIGINT >> s::INT) & 31) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": _OP1_SQL,
    "op2_near_dedup": _OP2_SQL,
    "op5_exact_dedup": _OP5_SQL,
    "op7_mixing": _OP7_SQL,
    "op11_row_pattern": _OP11_SQL,
    "op12_conversation_trie": _OP12_SQL,
    "op13_warc": _OP13_SQL,
}
