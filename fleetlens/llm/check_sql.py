"""DuckDB SQL that checks the queries, written apart from them. op4 (XXH64), op8 and the pipeline are beyond SQL."""

from __future__ import annotations

from fleetlens.llm.license_scan import TEMPLATES

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{SPACES}') AS ws FROM d),
lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
real AS (SELECT *, regexp_extract_all(line, '{SPACES}') AS lw FROM lines WHERE regexp_matches(line, '{SPACES}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM real GROUP BY 1),
win AS (SELECT doc_id, k, array_to_string(ws[k : k + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS k FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
rep AS (SELECT doc_id, count(*) AS n_rep FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 8)) FROM twice WHERE n > 1) GROUP BY 1),
norm AS (SELECT doc_id, source, t, translate(array_to_string(lw, ' '), '{UPPER}0123456789', '{LOWER}0000000000') AS line, len(lw) AS n FROM real),
freq AS (SELECT source, line, count(DISTINCT t) AS n_docs FROM norm GROUP BY ALL),
host AS (SELECT source, count(DISTINCT t) AS n_host FROM d GROUP BY 1),
bad AS (SELECT f.source, f.line FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE n_docs > 20 AND n_docs > least(0.05 * n_host, 1000)),
gone AS (SELECT doc_id, sum(n) AS n FROM norm JOIN bad ON norm.source IS NOT DISTINCT FROM bad.source AND norm.line = bad.line GROUP BY 1),
base AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       removed::BIGINT AS removed_words, (n_words - removed < 10 OR n_words - removed < 0.3 * n_words) AS depleted, NOT base_failed AND NOT depleted AS kept
FROM base
"""

OP2 = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({lower("text")}, '{ALNUM}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(ws)) AS width, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS g
       FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS k FROM i WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT width FROM iw),
d AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{ALNUM}') AS ws FROM documents),
dw AS (SELECT doc_id, width, k, array_to_string(ws[k : k + width - 1], ' ') AS g
       FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS k FROM d JOIN widths ON len(ws) >= width)),
hit AS (SELECT doc_id, k, dw.width, item FROM dw JOIN iw ON dw.width = iw.width AND dw.g = iw.g),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + width)) FROM (SELECT DISTINCT doc_id, k, width FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACES}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY 1),
weighed AS (SELECT *, [3, 1, 2][(rank % 3 + 1)::INT]::DOUBLE AS weight FROM s),
share AS (
  SELECT 0 AS round, rank, n, weight, 0::DOUBLE AS target, 1.5 * (SELECT sum(n) FROM s) AS rest FROM weighed
  UNION ALL
  SELECT round + 1, rank, n, weight, new, all_rest - sum(new) OVER () FROM (
    SELECT *, least(2 * n, target + CASE WHEN target < 2 * n THEN rest * weight / nullif(sum(CASE WHEN target < 2 * n THEN weight END) OVER (), 0) ELSE 0 END) AS new,
           sum(target) OVER () + rest AS all_rest FROM share)
  WHERE round < 60 AND rest > 1e-9),
final AS (SELECT rank, n, target FROM share WHERE round = (SELECT max(round) FROM share)),
stream AS (
  SELECT doc_id, rank, size, sum(size) OVER (PARTITION BY rank ORDER BY pass, md5('0:' || pass || ':' || doc_id)) - size AS place
  FROM d JOIN weighed ON d.source IS NOT DISTINCT FROM weighed.source, (VALUES (0), (1)) p(pass) WHERE size > 0),
taken AS (SELECT doc_id, sum(greatest(0, least(place + size, floor(target + 0.499999)::BIGINT) - place)) AS taken FROM stream JOIN final USING (rank) GROUP BY 1)
SELECT doc_id, size, n::BIGINT AS source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN weighed ON d.source IS NOT DISTINCT FROM weighed.source JOIN (SELECT rank, target FROM final) USING (rank) LEFT JOIN taken USING (doc_id)
"""

OP5 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
        FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN fit USING (page_id)
"""

OP6 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACES}') AS ws FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(ws[k : k + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35)),
many AS (SELECT doc_id, k FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM many),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_TEMPLATES = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all({lower("t")}, '{ALNUM}') AS ws FROM d),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w WHERE contains({lower("t")}, 'license') OR contains({lower("t")}, 'cc')),
places AS (SELECT doc_id, k - 1 AS k, label FROM starts JOIN p ON ws[k] = phrase[1] AND ws[k : k + len(phrase) - 1] = phrase),
base AS (SELECT doc_id, count(*) AS n, min(k) AS first, max(k) AS last, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY 1),
tpl AS (SELECT label, regexp_extract_all(text, '{ALNUM}') AS ws FROM (VALUES {_TEMPLATES}) v(label, text)),
clean AS (SELECT label, list_distinct(ws) AS words, 5 * ceil(2 * len(ws) / 5)::BIGINT AS width FROM tpl),
near AS (SELECT doc_id, ws, label, words, width FROM w, clean WHERE 10 * len(list_intersect(list_distinct(ws), words)) >= 8 * len(words)),
blocks AS (SELECT doc_id, label, words, list_distinct(ws[k : k + width - 1]) AS held FROM (SELECT *, unnest(range(1, len(ws) + 1, 5)) AS k FROM near)),
met AS (SELECT doc_id, label, len(list_intersect(held, words)) / len(words)::DOUBLE AS c, len(words) AS size, len(list_intersect(held, words)) AS common FROM blocks),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM met WHERE 10 * common >= 8 * size GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    return rf"""
SELECT doc_id, '{kind}' AS kind, sum(gap) OVER so_far + coalesce(sum(len) OVER before, 0) AS s, len, good FROM (
  SELECT doc_id, unnest(list_transform(gaps, lambda x: length(x))[1 : len(found)]) AS gap, unnest(list_transform(found, lambda x: length(x))) AS len,
         unnest(list_transform(kept, lambda x: length(x) >= {least})) AS good, unnest(range(len(found))) AS k
  FROM (SELECT doc_id, string_split_regex(t, $r${pattern}$r$) AS gaps, regexp_extract_all(t, $r${pattern}$r$) AS found, regexp_extract_all(t, $r${pattern}$r$, {group}) AS kept FROM d))
WINDOW so_far AS (PARTITION BY doc_id ORDER BY k), before AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|$)", 0, 1),
)
OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(f"SELECT * FROM ({_spans(*k)})" for k in _KINDS)}),
f AS (SELECT doc_id, kind, s, kind || ':' || s::BIGINT || ':' || (s + len)::BIGINT AS span, list_position(['assign', 'access', 'hex', 'pem'], kind) AS place FROM found WHERE good),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
             string_agg(span, ',' ORDER BY s, place) FILTER (kind <> 'pem') AS base, string_agg(span, ',' ORDER BY s, place) AS every FROM f GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, b, substr(h, 2 * b + 1, 498) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 200)) AS b FROM d)),
win AS (SELECT doc_id, b + k AS k, md5(substr(p, 2 * k + 1, 100)) AS g FROM (SELECT doc_id, b, p, unnest(range(length(p) // 2 - 49)) AS k FROM pieces WHERE length(p) >= 100)),
first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM win JOIN first USING (g) WHERE least < doc_id),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (k <> before + 1 OR before IS NULL) AS spans FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY 1),
bytes AS (SELECT doc_id, b + k AS k, substr(p, 2 * k + 1, 2) AS b FROM (SELECT doc_id, b, p, unnest(range(least(200, length(p) // 2))) AS k FROM pieces SEMI JOIN gone USING (doc_id))),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY k) AS h FROM bytes ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP13 = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
numbered AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (
  SELECT conv_id, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM numbered GROUP BY 1), crc_table),
plan AS (
  SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 5 AS base, least(c.h, coalesce(b.n, 0)) AS taken
  FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.conv_id - c.conv_id % 5),
turns AS (
  SELECT conv_id, pos - h + taken AS pos, id, bytes FROM numbered JOIN plan USING (conv_id) WHERE pos > h
  UNION ALL
  SELECT plan.conv_id, pos, id, bytes FROM plan JOIN numbered ON numbered.conv_id = base WHERE pos <= taken),
paths AS (SELECT conv_id, list(id ORDER BY pos) AS path, list(bytes ORDER BY pos) AS sizes FROM turns GROUP BY 1),
convs AS (SELECT conv_id, coalesce(path, []) AS path, coalesce(sizes, []) AS sizes FROM plan LEFT JOIN paths USING (conv_id)),
members AS (SELECT conv_id, d, path[1:d] AS node, len(path) = d AS stops, coalesce(sizes[d], 0) AS bytes FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM convs)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends
  FROM members GROUP BY ALL),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
under AS (
  SELECT node[1:above] AS node, sum(saved)::BIGINT AS saved, (count(*) FILTER (n_children = 0))::BIGINT AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS above FROM known) GROUP BY 1)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, under.n_leaves, under.saved AS saved_tokens, k.ends AS ends_sha256
FROM known k JOIN under ON under.node = k.node LEFT JOIN nodes p ON k.d > 0 AND p.node = k.node[1:k.d - 1]
"""

ORACLES = {
    "op1_line_frequency": OP1, "op2_decontamination": OP2, "op3_mixing": OP3, "op5_url_filter": OP5, "op6_substring_dedup": OP6,
    "op7_license_scan": OP7, "op9_secret_scan": OP9, "op10_suffix_array_dedup": OP10,
    "op11_topk_search": OP11, "op13_prefix_trie": OP13,
}
