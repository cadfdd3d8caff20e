"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str) -> str:
    """Words parted by ASCII white space."""
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '{_SPACE}'), lambda x: x <> '')"


def _only(column: str) -> str:
    """Lower-cased words of letters, digits and what isn't ASCII."""
    return f"regexp_extract_all({_LOWER.format(c=column)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP1 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_only('text')} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
d AS (SELECT doc_id, {_only('text')} AS w FROM documents),
windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item FROM windows JOIN patterns USING (n, p)),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN covered USING (doc_id)"""

#: Places at which a control string or the escape character begins, overlapping ones included.
_ESCAPES = "len(list_filter(range(1, length({c}) + 1), lambda i: substr({c}, i, 1) = '\\' OR substr({c}, i, 3) = '###' OR substr({c}, i, 7) = '</turn>'{more}))"

OP3 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
s AS (SELECT *, length('### : ') + length(' </turn>') + 1 + length(role) + length(text)
  + {_ESCAPES.format(c='text', more='')} + {_ESCAPES.format(c='role', more=" OR substr(role, i, 1) = ':'")} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER.format(c='text'))} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM d),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (nx + ny - shared)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, other) AS (SELECT x, y FROM both_ways UNION SELECT r.id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
least_ids AS (SELECT id, min(other) AS m FROM reach GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN least_ids ON id = doc_id"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT p, min(doc_id) AS first FROM windows GROUP BY p),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM windows JOIN firsts USING (p) WHERE first < doc_id GROUP BY doc_id),
left_over AS (SELECT d.doc_id, w, coalesce(len(g), 0) AS n_removed, CASE WHEN g IS NULL THEN w
  ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_words('text')} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, p) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
  word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length, n_dup_lines > 0.3 * n_lines AS repeated_lines FROM m),
rates AS (SELECT source, rule, count(*) AS docs, count(*) FILTER (WHERE failed) AS failed FROM (
  SELECT source, unnest(['few_words', 'repeats', 'symbols', 'word_length', 'repeated_lines']) AS rule,
    unnest([few_words, repeats, symbols, word_length, repeated_lines]) AS failed FROM f) GROUP BY source, rule),
prior AS (SELECT *, mean * (1 - mean) AS within, greatest(2.0, least(1000.0, mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-9) - 1)) AS weight
  FROM (SELECT rule, sum(failed) / sum(docs) AS mean, coalesce(var_samp(failed / docs), 0.0) AS var, avg(1.0 / docs) AS inv FROM rates GROUP BY rule)),
bad AS (SELECT DISTINCT source FROM (SELECT source, docs, within, weight, mean, (failed + mean * weight) / (docs + weight) AS rate
  FROM rates JOIN prior USING (rule)) WHERE docs >= 20 AND rate > 0.5 AND rate > mean + 3.0 * sqrt(within / (weight + 1)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
  NOT (few_words OR repeats) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f"""



def _op12(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds: every vector against every centroid, component by component."""
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS m
  FROM (SELECT id, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept CROSS JOIN c{r}) GROUP BY id)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT m.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY k) n ON n.k = c{r}.k)""")
    return f"""WITH {",\n".join(ctes)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = m.k"""


def _op13() -> str:
    """Row by row over four states, whole audits kept; then the edits one by one."""
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length({s}) + 1), lambda i: CAST(ord({s}[i]) AS UBIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(0 AS UBIGINT))), "
        "lambda x, y: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT))"
    )
    more = lambda state, cost, edit: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"
    none = "{'c': 1000000, 'a': ''}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    before = [f"acc.s[{i + 1}]" for i in range(4)]
    ready = [
        before[0], before[1], least(before[2], *(more(before[i], 3, "I") for i in (0, 1, 3))),
        least(before[3], more(before[2], 3, "I"), more(before[0], 6, "II"), more(before[1], 6, "II")),
    ]
    late = "(CASE WHEN x.cut THEN 3 ELSE 0 END)"
    gone = lambda i: more(f"p[{i + 1}]", 4, "D")
    when = lambda test, value: f"CASE WHEN {test} THEN {value} ELSE {none} END"
    rows = [
        gone(0),
        least(gone(1), when("x.i = 's'", more("p[1]", late, "K"))),
        least(gone(2), *(when("NOT x.must", more(f"p[{i}]", f"3 + {late}", "R")) for i in (1, 2, 4)), *(when("x.i = 'u'", more(f"p[{i}]", late, "K")) for i in (1, 2, 4))),
        least(gone(3), when("NOT x.must", more("p[3]", f"3 + {late}", "R")), when("x.i = 'a'", more("p[3]", late, "K"))),
    ]
    step = f"list_transform([[{', '.join(ready)}]], lambda p: [{', '.join(rows)}])[1]"
    part = "coalesce(CAST({c} AS VARCHAR), ' ')"
    key = f"{part.format(c='conv_id')} || ':' || {part.format(c='turn')}"
    order = "turn NULLS FIRST, sha256(role), md5(coalesce('=' || conv_id, '-') || ':' || length(role) || ':' || role || text)"
    same = "IS NOT DISTINCT FROM"
    return f"""
WITH keyed AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc.format(s=f'({key})')} % 20 AS k FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again
  FROM keyed WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS n, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM damaged),
faults AS MATERIALIZED (SELECT *, mark = '' AS blank, mark <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup,
  lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
marked AS (SELECT *, blank OR dup AS must, NOT blank AND NOT dup AND mark NOT IN ('.', '!', '?') AS cut FROM faults),
folded AS (SELECT conv_id, CASE WHEN count(DISTINCT turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_prepend({{'i': '', 'must': false, 'cut': false, 's': [{{'c': 0, 'a': ''}}, {none}, {none}, {none}]}},
      list({{'i': CASE WHEN must THEN '' ELSE i END, 'must': must, 'cut': cut, 's': [{none}, {none}, {none}, {none}]}} ORDER BY n)),
      lambda acc, x: {{'i': '', 'must': false, 'cut': false, 's': {step}}}) AS acc FROM marked GROUP BY conv_id),
best AS MATERIALIZED (SELECT * EXCLUDE (acc), {least(before[0], ready[3])} AS b FROM folded),
edits AS (SELECT conv_id, k, substr(b.a, k, 1) AS e FROM (SELECT conv_id, b, unnest(range(1, length(b.a) + 1)) AS k FROM best)),
placed AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w AS n, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS turn_no FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
turns AS (SELECT p.conv_id, k, e, turn_no, m.role, CASE WHEN e = 'I' THEN '' ELSE m.text END AS text FROM placed p LEFT JOIN marked m
  ON p.conv_id {same} m.conv_id AND p.n = m.n WHERE e <> 'D'),
led AS (SELECT *, max(CASE WHEN turn_no = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM turns),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (turn_no - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t
  FROM led GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id {same} c.conv_id LEFT JOIN texts ON texts.conv_id {same} c.conv_id"""


ORACLES = {
    "op1_decontamination": OP1, "op3_chat": OP3, "op5_near_dedup": OP5, "op6_substring_dedup": OP6, "op10_quality": OP10,
    "op12_centroids": _op12(), "op13_repair": _op13(),
}
