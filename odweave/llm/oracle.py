"""SQL of another engine for the queries of this folder that SQL can express, written down apart from the operators."""

from __future__ import annotations

from itertools import permutations
from string import ascii_lowercase, ascii_uppercase

SPACES = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"
LOWER_WORDS = WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')")

CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?ROLE\])')) AS escapes,
  CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 13 ELSE 14 + length(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '[', '%5B'), '<', '%3C')) END AS frame FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(text) + escapes + frame) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(d, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, b FROM reach JOIN sides ON a = x),
root AS (SELECT d, min(x) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN root ON d = doc_id"""

SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, b0, substr(h, 2 * b0 + 1, 498) AS t FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49), 200)) AS b0 FROM d)),
win AS (SELECT doc_id, b0 + i AS p, substr(t, 2 * i + 1, 100) AS s FROM (SELECT doc_id, b0, t, unnest(range(0, length(t) // 2 - 49)) AS i FROM part)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
dup AS (SELECT doc_id, p FROM win JOIN f USING (s) WHERE m < doc_id),
cut AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM dup),
run AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM cut) GROUP BY doc_id, k),
span AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM run),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n, count(*) AS k FROM span JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

TARGETS = f"""WITH z AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM z GROUP BY source),
o AS (SELECT *, 2.0 * source_size / w AS fill FROM s),
l AS (SELECT fill, (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(2.0 * b.source_size) FROM o b WHERE b.fill < o.fill), 0.0)) / (SELECT sum(b.w) FROM o b WHERE b.fill >= o.fill) AS level FROM o),
t AS (SELECT source, source_size, least(2.0 * source_size, w * coalesce((SELECT level FROM l WHERE l.fill >= l.level ORDER BY l.fill LIMIT 1), 1e300)) AS target FROM o)
SELECT doc_id, size, source_size, floor(CAST(target AS DOUBLE) * 1e3 + 0.5) / 1e3 AS target FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source"""

_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
)
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS k, '{name}' AS kind, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n, length(regexp_extract(m[i], '{pattern}', {group})) >= {least} AS good
    FROM (SELECT doc_id, s, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS s, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m FROM documents))"""
    for k, (name, pattern, group, least) in enumerate(_KINDS)
)
SECRETS = f"""WITH x AS ({_SPANS}), g AS (SELECT * FROM x WHERE good),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS na, count(*) FILTER (k = 1) AS nk, count(*) FILTER (k = 2) AS nh, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS t FROM g GROUP BY 1)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(t, '')) AS base_sha256 FROM documents LEFT JOIN per USING (doc_id)"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat FROM rep CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY 1),
q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n_repeat, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q"""

# The checksum of a feature, byte by byte with the table of its polynomial; each distinct feature once.
RESAMPLING = f"""WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
w AS (SELECT *, list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, text, TRUE AS own FROM documents UNION ALL SELECT NULL, text, FALSE FROM benchmark)),
f AS (SELECT doc_id, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM u, poly),
x AS (SELECT doc_id, own, b FROM f JOIN c USING (f)),
n AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM x GROUP BY b),
z AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
g AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM n, z),
d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN g USING (b) WHERE own GROUP BY doc_id),
r AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (doc_id) WHERE own),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= (SELECT 25 * count(*) // 100 FROM q WHERE n_words >= 20) THEN k END AS rank FROM k"""

# Words hold no blanks, so one blank can stand for the end and two for the start.
LANGUAGE = f"""WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
l AS (SELECT doc_id, xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 1 AS held_out,
  list_concat(['  '], {LOWER_WORDS}, [' ']) AS l FROM documents, poly),
t AS (SELECT doc_id, held_out, l[i] AS v, l[i + 1] AS w FROM (SELECT *, unnest(range(1, len(l))) AS i FROM l)),
b AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
u AS (SELECT w, count(*) AS n, sum(c) AS c FROM b GROUP BY w),
k2 AS (SELECT count(*) FILTER (c = 1) AS a, count(*) FILTER (c = 2) AS b, count(*) FILTER (c = 3) AS c, count(*) FILTER (c = 4) AS d FROM b),
k1 AS (SELECT count(*) FILTER (n = 1) AS a, count(*) FILTER (n = 2) AS b, count(*) FILTER (n = 3) AS c, count(*) FILTER (n = 4) AS d, count(*) FILTER (n >= 3) AS m, count(*) AS types, sum(n)::DOUBLE AS total, sum(c)::BIGINT AS tokens FROM u),
d2 AS (SELECT CASE WHEN least(a, b, c, d) > 0 THEN [1 - 2 * a / (a + 2 * b) * b / a, 2 - 3 * a / (a + 2 * b) * c / b, 3 - 4 * a / (a + 2 * b) * d / c] END AS e FROM k2),
d1 AS (SELECT CASE WHEN least(a, b, c, d) > 0 THEN [1 - 2 * a / (a + 2 * b) * b / a, 2 - 3 * a / (a + 2 * b) * c / b, 3 - 4 * a / (a + 2 * b) * d / c] END AS e FROM k1),
f AS (SELECT CASE WHEN list_min(d1.e) >= 0 THEN d1.e ELSE [0.5, 1, 1.5]::DOUBLE[] END AS d1, CASE WHEN list_min(d2.e) >= 0 THEN d2.e ELSE [0.5, 1, 1.5]::DOUBLE[] END AS d2 FROM d1, d2),
low AS (SELECT *, (d1[1] * a + d1[2] * b + d1[3] * m) / total / (types + 1) AS rest FROM k1, f),
p1 AS (SELECT w, u.c, (n - d1[least(n, 3)]) / total + rest AS p FROM u, low),
ctx AS (SELECT v, sum(c)::DOUBLE AS total, d2[1] * count(*) FILTER (c = 1) + d2[2] * count(*) FILTER (c = 2) + d2[3] * count(*) FILTER (c >= 3) AS free FROM b, f GROUP BY v, d2),
s AS (SELECT t.doc_id, t.held_out, coalesce(p1.c, 0) AS c, log10((coalesce(p1.c, 0) + 0.5) / (tokens + 0.5 * (types + 1))) AS base,
  log10(CASE WHEN ctx.total IS NULL THEN coalesce(p, rest) ELSE (coalesce(b.c - d2[least(b.c, 3)], 0) + free * coalesce(p, rest)) / ctx.total END) AS s
  FROM t LEFT JOIN p1 USING (w) LEFT JOIN ctx USING (v) LEFT JOIN b ON b.v = t.v AND b.w = t.w, low)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, (SELECT tokens FROM k1) AS train_tokens, floor(sum(base) * 1e3 + 0.5) / 1e3 AS base_score, floor(sum(s) * 1e3 + 0.5) / 1e3 AS score FROM s GROUP BY ALL"""

_AUDIT_STEPS = ", ".join(f"('{''.join(p)}', {k + 1}, '{f}', '{''.join(p[:k])}')" for p in permutations("ABCDE") for k, f in enumerate(p))
AUDIT = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
f AS (SELECT *, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END) AS fails FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s(filter_order, step, f, before) AS (VALUES {_AUDIT_STEPS}),
c AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '.]') AS gone FROM m, s),
t AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t"""

SQL = {"op1_chat_format": CHAT, "op2_minhash_dedup": NEAR, "op8_suffix_dedup": SUFFIX, "mix_targets": TARGETS, "secret_base_spans": SECRETS, "quality_rule_counts": QUALITY, "lm_scores": LANGUAGE, "op12_target_resampling": RESAMPLING, "op13_filter_audit": AUDIT}
