"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

import re

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     l AS (SELECT h, n, max(page_id) AS lead FROM d GROUP BY h, n),
     c AS (SELECT d.page_id, d.n, d.h, CASE WHEN d.page_id <> l.lead THEN l.lead END AS lead FROM d JOIN l USING (h, n))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       translate(upper(array_to_string([to_base(CAST('0x' || substr(h, k, 10) AS BIGINT), 32, 8) FOR k IN [1, 11, 21, 31]], '')),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN lead IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CAST(lead AS BIGINT) AS refers_to
FROM c
"""

_MARKS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<role=", "|role>", "</role>"]
_broken = "|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in _MARKS)
_escapes = "len(regexp_extract_all({}, '" + _broken + "'))"
_follows = "CASE coalesce(before, '') WHEN '' THEN ['system', 'user'] WHEN 'system' THEN ['user'] WHEN 'user' THEN ['assistant'] WHEN 'assistant' THEN ['user'] ELSE [] END"

OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, NOT list_contains({_follows}, role) AS wrong,
        length(text) + {_escapes.format("text")} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) + {_escapes.format("role")} END AS chars FROM n),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(chars) AS formatted_chars, min(k) FILTER (wrong) AS first_wrong, max_by(role, k) AS last_role FROM s GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
       first_wrong IS NULL AND last_role = 'assistant' AS valid,
       CAST(coalesce(first_wrong, CASE WHEN last_role <> 'assistant' THEN n_turns END) AS BIGINT) AS first_invalid
FROM g
"""

OP4 = f"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, {WORDS.format(LOWER.format("text"))} AS ws FROM documents
           UNION ALL SELECT 1, item_id, {WORDS.format(LOWER.format("text"))} FROM benchmark),
s AS (SELECT DISTINCT kind, id, ws[i : i + 4] AS sh FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
q AS (SELECT id AS item_id, sh, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 1),
h AS (SELECT q.item_id, s.id AS doc_id, any_value(n_item) AS n_item, count(*) AS n_shared FROM q JOIN s ON s.kind = 0 AND s.sh = q.sh GROUP BY 1, 2)
SELECT item_id, doc_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared, round(n_shared / n_item, 6) AS containment
FROM h WHERE 100 * n_shared >= 75 * n_item
"""

OP5 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM v) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r),
f AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ks, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN f ON f.doc_id = w.doc_id
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, ws[i : i + 4] AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
        UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP9 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("text")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i : i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM v WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 50 * word_chars) AS kept
FROM b
"""

_HOST = LOWER.format("regexp_extract(substr({0}, instr({0}, '://') + 3), '^([^/?#]*)', 1)")
_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in _RULES)


def _op10(rounds: int = 12) -> str:
    """The rounds of the propagation one by one."""
    step = "SELECT kind, host, sum(score) AS score FROM (SELECT t.kind, t.dst AS host, 0.85 * s.score * t.share AS score FROM s{0} s JOIN t ON t.kind = s.kind AND t.src = s.host UNION ALL SELECT kind, host, 0.15 * score FROM s0) GROUP BY 1, 2"
    steps = ", ".join(f"s{k} AS ({step.format(k - 1)})" for k in range(1, rounds + 1))
    return f"""
WITH r(verdict, h, p) AS (VALUES {_values}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN {_HOST.format("url")} ELSE '' END AS host,
        CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
        regexp_extract_all(coalesce(html, ''), '(?i)\\bhref\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1) AS links FROM pages),
f AS (SELECT page_id, host, path, rule, verdict FROM (SELECT u.*, h || p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC) AS k
        FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) WHERE k = 1),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_transform(links, lambda x: {LOWER.format("x")})) AS dst FROM u) WHERE src <> '' AND src <> dst GROUP BY 1, 2),
hosts AS (SELECT host FROM u WHERE host <> '' UNION SELECT dst FROM l),
up AS (SELECT host AS a, regexp_extract(host, '^[^.]*\\.(.*)$', 1) AS b FROM hosts WHERE len(string_split(host, '.')) >= 4),
e AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, n FROM l UNION ALL SELECT a, b, 1 FROM up UNION ALL SELECT b, a, 1 FROM up) GROUP BY 1, 2),
k AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
t AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM k),
w AS (SELECT CASE WHEN verdict = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS w FROM f WHERE verdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
s0 AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS score FROM w), {steps},
z AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS tr, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS di FROM s{rounds} GROUP BY host)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE WHEN round(di / (tr + di), 9) > 0.6 THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN z ON z.host = f.host
"""

_TERMS = LOWER.format(r"unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))")

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, {_TERMS} AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (s.total + 5 * v.v) AS p,
             1 + (1000000000 * (k.all_n + 5)::HUGEINT) // (v.total + 5 * v.v) AS q
      FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
b AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(a.value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM b) WHERE part = 'pair' OR rank <= 50
"""

_RUNS = LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"

OP11 = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(k::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: {_CRC_STEP}) ORDER BY k) AS tab FROM range(256) t(k)),
r AS (SELECT id, run, count(*) AS uses FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_RUNS} AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, uses, [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(x) // 2)] AS bytes FROM (SELECT run, uses, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= 7)),
h AS (SELECT run, uses, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1]))) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, uses FROM h),
v AS (SELECT word, CAST(sum(uses) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(uses) >= 2),
k AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT k.word, v.word FROM k JOIN v ON v.word = k.rest UNION SELECT v.word, k.word FROM k JOIN v ON v.word = k.rest),
m AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'n': -v.n, 'b': encode(b)}}) AS best FROM p JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 10 * v.n THEN best END AS form, CASE WHEN x.n >= 10 * v.n THEN x.n END AS form_n
      FROM v LEFT JOIN m USING (word) LEFT JOIN v x ON x.word = best),
c AS (SELECT word, word AS root, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, CAST(n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL
"""

OP13 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""

ORACLE: dict[str, str] = {
    "op1_warc": OP1,
    "op2_chat_formatting": OP2,
    "op4_decontamination": OP4,
    "op5_substring_dedup": OP5,
    "op6_jaccard_join": OP6,
    "op9_quality_rules": OP9,
    "op10_url_filters": _op10(),
    "op11_spelling_variants": OP11,
    "op12_source_divergence": OP12,
    "op13_topk_search": OP13,
}
