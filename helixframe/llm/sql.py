"""DuckDB SQL of the queries that SQL can express: written from what a query returns, not from how the operator works."""

from __future__ import annotations

from . import chat, license_scan

_BLANKS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_sql() -> str:
    escaped = "replace({}, '\\', '\\\\')"
    for c in sorted(chat.CHATML.controls, key=len, reverse=True):
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    around = len(chat.CHATML.open) - len("{role}") + len(chat.CHATML.close)
    role, text = escaped.format("role"), escaped.format("text")
    return f"""
WITH t AS (
  SELECT conv_id, turn, 0 AS step, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 0, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, step, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, step, role, text), '') AS loss,
    sum({around} + length({role}) + length({text})) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""


def _variants(ids: tuple[str, ...]) -> list[list[str]]:
    """All sequences that a rule stands for: each identifier that may be missing, present or not."""
    out: list[list[str]] = [[]]
    for i in ids:
        out = [v + [i.rstrip("?")] for v in out] + (out if i.endswith("?") else [])
    return out


def op3_sql() -> str:
    """Rules over lists of identifiers by position; a used-up element becomes a bar.  Known sentences inside others are
    found by trying all runs of lines, and no list of telling words decides what is looked up."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.KNOWN.items())
    steps, names = [], []
    for r, (name, ids) in enumerate(license_scan.RULES):
        starts = " || ".join(
            f"list_transform(list_filter(range(1, len(s) + 1), lambda i: s[i:i + {len(v) - 1}] = {v}), lambda i: {{'a': i, 'z': i + {len(v) - 1}}})" for v in _variants(ids)
        )
        # Of matches with one start the longest counts.
        steps.append(f"m{r} AS (SELECT *, list_sort({starts}) AS every FROM r{r - 1})")
        steps.append(f"n{r} AS (SELECT *, list_filter(every, lambda x, i: i = len(every) OR every[i + 1].a <> x.a) AS m FROM m{r})")
        steps.append(
            f"r{r} AS (SELECT * EXCLUDE (s, m, every), list_transform(m, lambda x: replace('{name}', '{{v}}', v[x.a])) AS l{r}, "
            f"list_transform(range(1, len(s) + 1), lambda i: CASE WHEN len(list_filter(m, lambda x: i >= x.a AND i <= x.z)) > 0 THEN '|' ELSE s[i] END) AS s FROM n{r})"
        )
        names.append(f"l{r}")
    flat = r"regexp_replace(lower({}), '[^a-z0-9.]+', ' ', 'g')"
    key = r"regexp_replace(regexp_replace({}, '[0-9]+([.][0-9]+)*', '#', 'g'), '^[. ]+|[. ]+$', '', 'g')"
    unit = r"[A-Za-z0-9]([A-Za-z0-9.:+-]*[A-Za-z0-9+])?([ \t]+WITH[ \t]+[A-Za-z0-9]([A-Za-z0-9.:+-]*[A-Za-z0-9+])?)?"
    tag = rf"(?i:spdx-license-identifier:)[( \t]*{unit}([) \t]*(AND|OR)[( \t]+{unit})*[) \t]*"
    most = max(len(k.split()) for k in license_scan.KNOWN)
    return rf"""
WITH known(key, name) AS (VALUES {known}),
tagged AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '({tag})', chr(1) || '\1' || chr(1), 'g') AS t FROM documents),
marked AS (SELECT doc_id, regexp_replace(t, '([.!?])[ \t\r]+', '\1' || chr(1), 'g') AS t FROM tagged),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([.!?])\n|(:)[ \t\r]*\n', '\1\2' || chr(1), 'g'), '\n[ \t\r#/*;%-]*\n', chr(1), 'g'), chr(1)) AS p FROM marked),
every AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM cut),
tags AS (SELECT doc_id, i, regexp_replace(s, '^(?i:spdx-license-identifier:)[ \t]*', '') AS e FROM every WHERE regexp_full_match(s, '{tag}')),
units AS (SELECT doc_id, i, unnest(u) AS v, generate_subscripts(u, 1) AS j
  FROM (SELECT doc_id, i, string_split_regex(trim(regexp_replace(e, '[() \t]+', ' ', 'g')), ' (AND|OR) ') AS u FROM tags)),
expressions AS (SELECT doc_id, string_agg(trim(replace(replace(regexp_replace(e, '[ \t]+', ' ', 'g'), '( ', '('), ' )', ')')), ';' ORDER BY i) AS expressions FROM tags GROUP BY doc_id),
sentences AS (SELECT e.doc_id, e.i, e.s, name FROM every e ANTI JOIN tags t ON t.doc_id = e.doc_id AND t.i = e.i LEFT JOIN known ON key = {key.format(flat.format("s"))}),
lines AS (SELECT doc_id, i, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(lower(x), '[a-z0-9.]')) AS x FROM sentences WHERE name IS NULL),
starts AS (SELECT *, unnest(range(1, len(x) + 1)) AS a FROM lines WHERE len(x) > 0),
blocks AS (SELECT doc_id, i, a, unnest(range(a, least(len(x), a + {most}) + 1)) AS z, x FROM starts
  WHERE len(list_filter({[k.split()[0] for k in license_scan.KNOWN]}, lambda k: contains(lower(x[a]), k))) > 0),
inside AS (SELECT doc_id, i, a, z, name, array_to_string(x[a:z], ' ') AS s FROM blocks JOIN known ON key = {key.format(flat.format("array_to_string(x[a:z], ' ')"))}),
longest AS (SELECT doc_id, i, a, max(z) AS z, arg_max(name, z) AS name, arg_max(s, z) AS s FROM inside GROUP BY 1, 2, 3),
outer_ AS (SELECT * FROM longest l WHERE NOT EXISTS (SELECT 1 FROM longest m WHERE m.doc_id = l.doc_id AND m.i = l.i AND m.a < l.a AND m.z >= l.a)),
ids AS (
  SELECT doc_id, i, 0 AS j, name, regexp_extract({flat.format("s")}, '[0-9]+([.][0-9]+)*') AS v FROM sentences WHERE name IS NOT NULL
  UNION ALL SELECT doc_id, i, a, name, regexp_extract({flat.format("s")}, '[0-9]+([.][0-9]+)*') FROM outer_
  UNION ALL SELECT doc_id, i, j, 'spdx', v FROM units),
r_1 AS (SELECT doc_id, list(name ORDER BY i, j) AS s, list(v ORDER BY i, j) AS v, count(*) AS n, string_agg(name || '@' || v, ',' ORDER BY i, j) AS sentence_ids FROM ids GROUP BY doc_id),
{", ".join(s.replace("FROM r-1", "FROM r_1") for s in steps)}
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
  coalesce(array_to_string({" || ".join(names)}, ','), '') AS licenses,
  coalesce(len(list_filter(s, lambda x: x <> '|')), 0) AS n_unmatched, coalesce(expressions, '') AS expressions
FROM documents d LEFT JOIN r{len(license_scan.RULES) - 1} r ON d.doc_id = r.doc_id LEFT JOIN expressions x ON d.doc_id = x.doc_id"""


def op5_sql(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANKS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s, len(w) < {k} AS short FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
rare AS (SELECT s, short FROM sh GROUP BY 1, 2 HAVING count(*) > 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN rare USING (s, short) JOIN sh b ON a.s = b.s AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""


def op6_sql(window: int) -> str:
    return rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
ip AS (SELECT DISTINCT item_id, least(len(w), {window}) AS m, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM ip),
hits AS (SELECT DISTINCT doc_id, item_id, i, x.m FROM (
    SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths WHERE len(w) >= m)) x
  JOIN ip ON ip.m = x.m AND ip.t = x.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op7_sql(shards: int) -> str:
    draw = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT)"
    best = f"(SELECT doc_id, arg_max(s, ({draw}, -s)) AS shard FROM (SELECT DISTINCT doc_id FROM documents), range(0, {{}}) r(s) GROUP BY 1)"
    # CRC-32 byte by byte, with the table of the reversed polynomial.
    entry = "list_reduce([b] || range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    crc = "list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))"
    return f"""
WITH steps AS MATERIALIZED (SELECT list({entry} ORDER BY b) AS t FROM (SELECT CAST(range AS BIGINT) AS b FROM range(0, 256))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor({crc}, 4294967295) AS text_crc32 FROM (
  SELECT doc_id, size, list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d), steps)
SELECT c.doc_id, c.size, CAST(c.text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY substr(md5(concat_ws('|', c.doc_id, c.size, c.text_crc32)), 1, 3), c.doc_id, c.size, c.text_crc32) - 1 AS slot,
  CAST(b.shard AS INTEGER) AS grown_shard
FROM c JOIN {best.format(shards)} a USING (doc_id) JOIN {best.format(shards + 1)} b USING (doc_id)"""


def op8_sql(window: int) -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM w WHERE len(w) >= {window})),
f AS (SELECT t, min(doc_id) AS first FROM p GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM p JOIN f USING (t) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""


def op11_sql(chars: int, documents: int) -> str:
    blanks = " || ".join(f"chr({i})" for i in (32, *range(9, 14)))
    key = f"translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM t),
keyed AS (SELECT *, {key} AS k FROM e),
f AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= {chars} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {documents}),
g AS (SELECT r, keyed.doc_id, line, i, coalesce(keyed.doc_id <> f.top, false) AS gone FROM keyed LEFT JOIN f ON keyed.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r"""


def op13_sql(documents: int, top: int) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {documents}),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(c) + 2) // (any_value(m) + 2 * any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(coalesce(n, 0)) AS m FROM n GROUP BY 1) USING (lang) GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
