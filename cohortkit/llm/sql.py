"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

# sizes -> weights in code point order -> water level from prefix sums -> seeded coin
OP10 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13)
              AS BIGINT)::DOUBLE / 4503599627370496.0 AS coin
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(2.0::DOUBLE * sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM ranked
  WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT *, least(2.0::DOUBLE * source_size,
                  coalesce((SELECT max(lev) FROM levels WHERE ratio > lev) * w, 2.0::DOUBLE * source_size)) AS target
  FROM levels)
SELECT s.doc_id, s.size, t.source_size, t.target,
       s.size * (floor(r)::BIGINT + CASE WHEN s.coin < r - floor(r) THEN 1 ELSE 0 END) AS taken
FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM target) t
JOIN sized s ON s.source IS NOT DISTINCT FROM t.source
"""


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: the text split at the matches, lengths added up."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT rid, '{kind}' AS kind, s AS start, s + length(hit) AS stop FROM (
  SELECT rid, unnest(h) AS hit, unnest(k) AS key, unnest(list_transform(range(1, len(h) + 1), lambda i:
    coalesce(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(list_slice(h, 1, i - 1), lambda x: length(x))), 0))) AS s
  FROM (SELECT rid, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS h,
               regexp_extract_all(t, '{pattern}', {group}) AS k FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE length(key) >= {least}"""


_DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents)"

OP1 = f"""
WITH {_DOCS},
f AS (
{_spans('assign', r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)}
UNION ALL {_spans('access', '(AKIA[A-Z0-9]+)', 1, 16)}
UNION ALL {_spans('hex', '([0-9a-f]+)', 1, 32)}
UNION ALL {_spans('pem', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1, 1)}),
r AS (SELECT *, CAST(s AS VARCHAR) AS _ FROM (SELECT rid, kind, start, stop, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS s,
  list_position(['assign', 'access', 'hex', 'pem'], kind) AS rank FROM f)),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE rank < 4) AS base,
  string_agg(s, ',' ORDER BY start, rank) AS spans FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""

OP5 = rf"""
WITH {_DOCS},
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
grams AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT rid, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
inside AS (SELECT rid, count(DISTINCT i + j) AS n FROM grams JOIN twice USING (rid, g), range(0, 5) t(j) GROUP BY 1),
stats AS (SELECT rid, doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN inside USING (rid)),
marked AS (SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS rep, 100 * n_symbols > 10 * word_chars AS sym,
  n_dup_lines >= 3 AS dup FROM stats),
host AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS f FROM (
  SELECT source, unnest(['few', 'rep', 'sym', 'dup']) AS rule, unnest([few, rep, sym, dup]) AS bad FROM marked) GROUP BY 1, 2),
prior AS (SELECT rule, avg(f / n) AS m, var_samp(f / n) AS v FROM host GROUP BY 1),
rates AS (SELECT source, max((f + m * wt) / (n + wt)) AS worst FROM (
  SELECT host.*, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 20.0 END AS wt FROM host JOIN prior USING (rule))
  GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed,
  NOT (few OR rep) AND worst <= 0.5 AS kept
FROM marked JOIN rates ON marked.source IS NOT DISTINCT FROM rates.source
"""

OP7 = rf"""
WITH {_DOCS},
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM d),
win AS (SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT rid, i + j AS i FROM win JOIN first USING (g), range(0, 13) t(j) WHERE f < doc_id),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM (
  SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""

_ALNUM = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP8 = rf"""
WITH {_DOCS},
w AS (SELECT rid, doc_id, {_ALNUM.format('t')} AS w FROM d),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT rid, n, i, item FROM dw JOIN iw USING (n, g)),
covered AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM hits, range(0, 10) t(j) WHERE j < n GROUP BY 1),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP9 = rf"""
WITH RECURSIVE {_DOCS},
w AS (SELECT rid, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM d),
sh AS (SELECT DISTINCT rid, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach ON reach.a = w.rid JOIN d o ON o.rid = reach.b LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid, w.doc_id
"""

# CRC-32 (reflected, polynomial 0xEDB88320): a table by eight shifts a byte, then a fold over the bytes of ASCII text
_CRC = """crct AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


# turns in order -> rebuilt turns -> prefix names -> nodes, subtrees by the names that start with a node's
OP11 = f"""
WITH {_CRC},
tu AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS n,
  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn ASC NULLS FIRST, k) AS i FROM tu),
h AS (SELECT c, {_crc('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM o), crct),
reb AS (SELECT h.c, o.k, o.n, 0 AS part, o.i FROM h JOIN o ON o.c = h.c - h.c % 100 AND o.i <= h.h
  UNION ALL SELECT h.c, o.k, o.n, 1, o.i FROM h JOIN o ON o.c = h.c AND o.i > h.h),
mem AS (SELECT c, n, row_number() OVER w AS d, string_agg(k, '') OVER w AS p FROM reb
  WINDOW w AS (PARTITION BY c ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT c, 0, 0, '' FROM h),
node AS (SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM mem GROUP BY p),
kids AS (SELECT p[:32 * (d - 1)] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
below AS (SELECT a.p, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n)::BIGINT AS saved
  FROM full_ a JOIN full_ b ON starts_with(b.p, a.p) GROUP BY 1),
last AS (SELECT c, max(d) AS d FROM mem GROUP BY 1),
ends AS (SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS s FROM mem JOIN last USING (c, d) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved AS saved_tokens,
  sha256(coalesce(ends.s, '')) AS ends_sha256
FROM full_ f JOIN below USING (p) LEFT JOIN ends USING (p) LEFT JOIN node u ON f.d > 0 AND u.p = f.p[:32 * (f.d - 1)]
"""

# damage -> faults -> one row at a time, the cheapest and then least edits for each state, up to two inserts before a row
OP13 = f"""
WITH RECURSIVE {_CRC},
raw AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crct),
dm AS (SELECT c, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
nb AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn ASC NULLS FIRST, role, text) AS i FROM dm),
st AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS f, left(role, 1) AS r,
  lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM nb),
ins(s, s2, e, roles) AS (VALUES ('', '', '', []), ('', 'u', 'I', ['user:']), ('', 'a', 'II', ['user:', 'assistant:']),
  ('s', 's', '', []), ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']),
  ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('u', 'u', 'II', ['assistant:', 'user:']),
  ('a', 'a', '', []), ('a', 'u', 'I', ['user:']), ('a', 'a', 'II', ['user:', 'assistant:'])),
nx(s, nxt, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
mv AS (SELECT c, i, ins.s, nxt, e || x.edit AS e, 3 * len(e) + x.cost AS cost, list_concat(roles, x.line) AS lines, x.s AS s3
  FROM st, ins JOIN nx ON nx.s = ins.s2, LATERAL (SELECT unnest([
    {{'edit': 'D', 'cost': 4, 's': ins.s2, 'line': []::VARCHAR[], 'ok': true}},
    {{'edit': 'K', 'cost': CASE WHEN f = 't' THEN 3 ELSE 0 END, 's': r, 'line': [st.role || ':' || text],
      'ok': f NOT IN ('b', 'd') AND (r = nxt OR (r = 's' AND ins.s2 = ''))}},
    {{'edit': 'R', 'cost': CASE WHEN f = 't' THEN 6 ELSE 3 END, 's': nxt, 'line': [nx.role || ':' || text], 'ok': f NOT IN ('b', 'd')}}]) AS x) WHERE x.ok),
dp(c, i, s, cost, e, lines) AS (
  SELECT DISTINCT c, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM st
  UNION ALL
  SELECT c, i, s, b.cost, b.e, b.lines FROM (
    SELECT dp.c, mv.i, mv.s3 AS s, min({{'cost': (dp.cost + mv.cost)::BIGINT, 'e': dp.e || mv.e, 'lines': list_concat(dp.lines, mv.lines)}}) AS b
    FROM dp JOIN mv ON mv.c IS NOT DISTINCT FROM dp.c AND mv.i = dp.i + 1 AND mv.s = dp.s GROUP BY ALL)),
n AS (SELECT c, max(i) AS i, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
  count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM st GROUP BY 1),
fin AS (SELECT dp.c, min({{'cost': dp.cost + x.cost, 'e': dp.e || x.e, 'lines': list_concat(dp.lines, x.lines)}}) AS b
  FROM dp JOIN n ON n.c IS NOT DISTINCT FROM dp.c AND n.i = dp.i JOIN (VALUES ('', 0, '', []), ('s', 6, 'II', ['user:', 'assistant:']),
    ('u', 3, 'I', ['assistant:']), ('a', 0, '', [])) x(s, cost, e, lines) ON x.s = dp.s GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit,
  sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.c IS NOT DISTINCT FROM o.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": OP1, "op5_host_rules": OP5, "op7_substrings": OP7, "op8_winnowing": OP8, "op9_jaccard_join": OP9,
    "op10_mixing": OP10, "op11_prefix_trie": OP11, "op13_structure_repair": OP13}
