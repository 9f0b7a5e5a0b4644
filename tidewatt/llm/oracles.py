"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

# Letters and the contract's word rules.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"

OP3 = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS win
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) r WHERE len(w) > 0),
dwin AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM dw, (SELECT DISTINCT n FROM win) s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) r WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dwin JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) x GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) x GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: The sketches hold groups of this table whole, so their quantiles are exact.
OP4 = rf"""WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
runs AS (SELECT doc_id, i, w[i:i + 4] AS run FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) r WHERE len(w) >= 5),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM runs JOIN (SELECT doc_id, run FROM runs GROUP BY 1, 2 HAVING count(*) > 1) x USING (doc_id, run)) y
  GROUP BY 1),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_rate, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_rate,
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_rate, coalesce(n_upper / nullif(n_letters, 0), 0.0) AS upper_rate,
    coalesce(word_chars / nullif(n_words, 0), 0.0) AS word_length, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m),
q AS (
  SELECT lang, source, grouping(source) AS whole, count(*) AS rows, {{quantiles}}
  FROM r WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang))),
f AS (
  SELECT a.lang, a.source, {{picked}}
  FROM q a JOIN q b ON a.lang IS NOT DISTINCT FROM b.lang AND a.whole = 0 AND b.whole = 1 WHERE greatest(a.rows, b.rows) >= 30)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({{inside}}, true) AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source"""


def op4(measures: dict[str, tuple[float, bool]], reach: float = 6.0) -> str:
    quantiles, picked, inside = [], [], []
    for name, (least, below) in measures.items():
        quantiles.append(f"quantile_disc({name}, [0.25, 0.5, 0.75]) AS {name}_q")
        picked.append(f"CASE WHEN a.rows >= 30 THEN a.{name}_q ELSE b.{name}_q END AS {name}_q")
        inside.append(f"{name} <= {name}_q[2] + {reach} * greatest({name}_q[3] - {name}_q[2], {least})")
        if below:
            inside.append(f"{name} >= {name}_q[2] - {reach} * greatest({name}_q[2] - {name}_q[1], {least})")
    return OP4.format(quantiles=", ".join(quantiles), picked=", ".join(picked), inside=" AND ".join(inside))


OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) r WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS root FROM both_ways UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

_BASE32 = " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 5 * k}, 5) AS BIGINT), 32), 4, '0')" for k in range(8))

OP9 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""

#: Fixed value: the contract's term rule.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def op11(least_docs: int, ranks: int) -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '{TERM}') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) x GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY 1, 2 HAVING sum(docs) >= {least_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS terms FROM v),
p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (total + 5 * terms) AS p, 1 + 1000000000 * (lang_n + 5) // (lang_total + 5 * terms) AS q FROM s),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY 1, 2, 3) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= {ranks}"""


# crc32 of a text of ASCII characters, byte by byte; its table from the fixed polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _more(way: str, cost: str, edit: str) -> str:
    """A way (nine digits of cost, then the edits) with one edit more."""
    return f"printf('%09d', CAST(substr({way}, 1, 9) AS INTEGER) + {cost}) || substr({way}, 10) || '{edit}'"


def _op13() -> str:
    # the cheapest way by the role that came last: n(one), s, u, a; rows and chances to insert in turn
    user_before, user = "least(t.n, t.s, t.a)", f"least(t.u, {_more('least(t.n, t.s, t.a)', '5', 'I')})"
    inserted = f"{{'n': t.n, 's': t.s, 'u': {user}, 'a': least(t.a, {_more(user, '5', 'I')})}}"
    stay = "CASE WHEN r.fault = 't' THEN 5 ELSE 0 END"

    def after(own: str, before: str, initial: str, rerole: bool) -> str:
        ways = [_more(own, "2", "D"), f"CASE WHEN r.fault IN ('', 't') AND r.x = '{initial}' THEN {_more(before, stay, 'K')} END"]
        if rerole:
            ways.append(f"CASE WHEN r.fault IN ('', 't') THEN {_more(before, f'1 + {stay}', 'R')} END")
        return f"least({', '.join(ways)})"

    row = f"{{'n': {_more('t.n', '2', 'D')}, 's': {after('t.s', 't.n', 's', False)}, 'u': {after('t.u', user_before, 'u', True)}, 'a': {after('t.a', 't.u', 'a', True)}}}"
    way = "struct_pack(x := '', fault := 'i', n := CAST(NULL AS VARCHAR), s := CAST(NULL AS VARCHAR), u := CAST(NULL AS VARCHAR), a := CAST(NULL AS VARCHAR))"
    whole = lambda ways, x="''", fault="''": f"{{'x': {x}, 'fault': {fault}, 'n': CAST({ways}.n AS VARCHAR), 's': CAST({ways}.s AS VARCHAR), 'u': CAST({ways}.u AS VARCHAR), 'a': CAST({ways}.a AS VARCHAR)}}"
    return rf"""WITH tab AS (SELECT {_CRC_TABLE} AS tab),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
dealt AS (SELECT src.*, {_CRC} % 20 AS deal FROM src, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
    CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, LATERAL (SELECT unnest(CASE WHEN deal = 3 THEN [0, 1] ELSE [0] END) AS copy) c WHERE deal <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again FROM placed),
f AS (
  SELECT *, role[1] AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pos > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, list({{'x': x, 'fault': fault}} ORDER BY pos) AS rows FROM f GROUP BY conv_id),
w AS (
  SELECT c.*, list_reduce(list_prepend({whole("{'n': '000000000', 's': NULL, 'u': NULL, 'a': NULL}")},
      list_append(flatten(list_transform(rows, lambda r: [{way}, {whole("{'n': NULL, 's': NULL, 'u': NULL, 'a': NULL}", 'r.x', 'r.fault')}])), {way})),
    lambda t, r: CASE WHEN r.fault = 'i' THEN {whole(inserted)} ELSE {whole(row)} END) AS ways FROM c),
e AS (SELECT *, least(ways.n, ways.a) AS best FROM w),
j AS (SELECT conv_id, substr(best, 10) AS audit, unnest(range(1, length(best) - 8)) AS k FROM e),
m AS (
  SELECT conv_id, k, audit[k] AS edit, count(*) FILTER (WHERE audit[k] <> 'I') OVER q AS pos, count(*) FILTER (WHERE audit[k] <> 'D') OVER q AS place
  FROM j WINDOW q AS (PARTITION BY conv_id ORDER BY k)),
g AS (
  SELECT m.*, f.role, f.text, f.x, max(CASE WHEN place = 1 AND edit = 'K' AND f.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS system
  FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos AND m.edit <> 'I'),
h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS repaired_sha256 FROM g WHERE edit <> 'D' GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM ids.conv_id"""


OP13 = _op13()
