"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from mailverdict.llm.divergence import (
    CHAR_GUARD,
    CHAR_LIMIT,
    CHAR_SLACK,
    CLASSES,
    COMMON,
    LANGUAGE_GUARD,
    MIN_WORDS,
    REPEAT_PERCENT,
    SLOTS,
    WORD_GUARD,
    WORD_LIMIT,
    WORD_SLACK,
)

_SECRET = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: Windows of ten item words looked up among the windows of the documents of the same length.
OP9 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT DISTINCT g.r, g.s, g.n, win.item
  FROM (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, size WHERE len(w) >= n)) g
  JOIN win ON win.n = g.n AND win.gram = g.gram),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""


def _places(pattern: str, group: int) -> str:
    """Places of all matches: gaps and matches alternate, so running sums of lengths locate them."""
    return f"""
  SELECT r, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(range(1, len(m) + 1),
      lambda i: list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))) AS a
  FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m,
          regexp_extract_all(t, '{pattern}', {group}) AS v FROM doc WHERE regexp_matches(t, '{pattern}'))"""


_ANY_CASE = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}


def _any_case(text: str) -> str:
    return "".join(_ANY_CASE.get(c, c) for c in text)


_IDENTIFIER = (
    "(" + _any_case("username|user_?id|login|account|client_?id|access_?key_?id") + ")"
    + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9_.@-]+)"""
)  # fmt: skip
_ENDPOINT = "(" + _any_case("https?|ftp|postgres|mysql|mongodb|redis|amqp") + r""")://[^ \t\n\v\f\r<>]+"""

OP4 = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
part AS (
  SELECT r, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, k FROM (
  SELECT *, CASE WHEN length(v) >= 12 THEN 0 ELSE 3 END AS k FROM ({_places(_SECRET, 2)}) WHERE length(v) >= 6
  UNION ALL SELECT *, 1 FROM ({_places('AKIA[A-Z0-9]{14,}', 0)})
  UNION ALL SELECT *, 2 FROM ({_places('[0-9a-f]{16,}', 0)})
  UNION ALL SELECT *, 4 FROM ({_places(_IDENTIFIER, 0)})
  UNION ALL SELECT *, 5 FROM ({_places(_ENDPOINT, 0)}))),
kept AS (
  SELECT p.* FROM part p WHERE k < 3
    OR (k = 3 AND EXISTS (SELECT 1 FROM part o WHERE o.r = p.r AND o.k IN (1, 4, 5) AND o.a <= p.b + 400 AND o.b >= p.a - 400))
    OR (k IN (4, 5) AND EXISTS (SELECT 1 FROM part o WHERE o.r = p.r AND o.k IN (0, 2, 3) AND o.a <= p.b + 400 AND o.b >= p.a - 400)
        AND (k = 4 OR EXISTS (SELECT 1 FROM part o WHERE o.r = p.r AND o.k IN (1, 4) AND o.a <= p.b + 400 AND o.b >= p.a - 400)))),
said AS (
  SELECT r, k, a, b, ['assign', 'access', 'hex', 'weak_secret', 'identifier', 'endpoint'][k + 1] || ':' || a || ':' || b AS s FROM kept),
listed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k, b) AS spans
  FROM said GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed USING (r)
"""

#: 40 bits at a time, as eight digits of five bits.
OP1 = """
WITH page AS (
  SELECT row_number() OVER () AS r, page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || h[CAST(k // 8 * 10 + 1 AS INT) : CAST(k // 8 * 10 + 10 AS INT)] AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INT)) & 31 AS INT) + 1]), '') AS d
  FROM page),
ranked AS (
  SELECT *, first_value(page_id) OVER w AS best, row_number() OVER w AS k FROM named
  WINDOW w AS (PARTITION BY d ORDER BY page_id DESC NULLS LAST, r))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN best END AS refers_to, true AS complete
FROM ranked
"""

OP10 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def _references(good: str) -> str:
    """Summed histograms of each language with enough texts, and of all texts as `*`."""
    chars, slots = len(CLASSES) + 1, SLOTS + 1
    sums = lambda of: ", ".join(  # noqa: E731
        f"[{', '.join(f'sum({name}[{k}])' for k in range(1, n + 1))}] AS {of}{name}" for name, n in (("chars", chars), ("common", slots))
    )
    return f"""(
  SELECT lang AS ref, count(*) AS docs, {sums('ref_')} FROM {good} GROUP BY lang HAVING count(*) >= {LANGUAGE_GUARD}
  UNION ALL SELECT '*', count(*), {sums('ref_')} FROM {good})"""


def _distance(a: str, b: str) -> str:
    """Square root of the Jensen-Shannon divergence of two lists of counts."""
    p, q = f"({a}[k] / list_sum({a})::double)", f"({b}[k] / list_sum({b})::double)"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END"  # noqa: E731
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda k: {part(p, q)} + {part(q, p)})), 0.0) / 2)"


def _compared(rows: str, refs: str) -> str:
    chars = _distance("chars", "coalesce(o.ref_chars, a.ref_chars)")
    common = _distance("common", "o.ref_common")
    return f"""(
  SELECT m.*, CASE WHEN word_chars >= {CHAR_GUARD} AND coalesce(o.ref_chars, a.ref_chars) IS NOT NULL THEN round({chars}, 6) END AS char_distance,
    CASE WHEN n_words >= {WORD_GUARD} AND o.ref_common[1] IS NOT NULL AND common IS NOT NULL THEN round({common}, 6) END AS word_distance
  FROM {rows} m LEFT JOIN {refs} o ON m.lang = o.ref LEFT JOIN (SELECT * FROM {refs} WHERE ref = '*' AND docs > 0) a ON true)"""


_NEAR = (
    f"(coalesce(char_distance <= {CHAR_LIMIT} + {CHAR_SLACK} / sqrt(word_chars), true)"
    f" AND coalesce(word_distance <= {WORD_LIMIT} + {WORD_SLACK} / sqrt(n_words), true))"
)
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LISTS = " ".join(f"WHEN '{lang}' THEN {_sql_list(listed.split())}" for lang, listed in COMMON.items())
_COUNTS = ", ".join("len(regexp_extract_all(t, '{}'))".format(c.replace("'", "''")) for c in CLASSES)
OP3 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lw,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l
  FROM documents),
gram AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM doc)),
twice AS (SELECT r, g FROM gram GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gram JOIN twice USING (r, g)) GROUP BY r),
raw AS (
  SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, [{_COUNTS}] AS classes,
    list_transform(CASE lang {_LISTS} END, lambda c: len(list_filter(lw, lambda x: x = c))) AS listed
  FROM doc LEFT JOIN rep USING (r)),
met AS MATERIALIZED (
  SELECT *, list_append(classes, word_chars - list_sum(classes)) AS chars, list_append(listed, n_words - list_sum(listed)) AS common,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM raw),
good AS MATERIALIZED (SELECT * FROM met WHERE NOT base_failed),
one AS MATERIALIZED (SELECT * FROM {_references('good')}),
close AS MATERIALIZED (SELECT * FROM {_compared('good', 'one')} WHERE {_NEAR}),
two AS MATERIALIZED (SELECT * FROM {_references('close')}),
last AS (SELECT * FROM {_compared('met', 'two')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
  NOT base_failed AND {_NEAR} AS kept
FROM last
"""

#: Edits by dynamic programming from the last row to the first; v0 to v3 are the cheapest ends (cost, audit, lines)
#: behind nothing, s, u and a. Structs compare by cost, then audit.
_NONE = "{'c': 1000000000, 'a': '~', 't': CAST([] AS VARCHAR[])}"


def _edit(letter: str, cost: str, line: str | None, after: str, only: str = "TRUE") -> str:
    lines = f"list_prepend({line}, {after}.t)" if line else f"{after}.t"
    return f"CASE WHEN {only} THEN {{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {lines}}} ELSE {_NONE} END"


def _least(*ends: str) -> str:
    return f"list_sort([{', '.join(ends)}])[1]"


def _row(state: str, after: str, initial: str, role: str) -> str:
    text, stays = "x.text", "NOT x.must"
    ends = [
        _edit("D", "3", None, state),
        _edit("K", "x.cut", f"x.role || ':' || {text}", after, f"{stays} AND substr(x.role, 1, 1) = '{initial}'"),
        _edit("R", "2 + x.cut", f"'{role}:' || {text}", after, stays),
    ]
    if state == "v0":
        ends.append(_edit("K", "x.cut", f"x.role || ':' || {text}", "v1", f"{stays} AND substr(x.role, 1, 1) = 's'"))
    return _least(*ends)


def _with_inserts(b0: str, b1: str, b2: str, b3: str) -> str:
    """The four states with up to two inserts before what follows; more are never cheapest."""
    to_a = _edit("I", "2", "'assistant:'", b3)
    to_u, twice = _edit("I", "2", "'user:'", b2), f"CASE WHEN TRUE THEN {{'c': {b3}.c + 4, 'a': 'II' || {b3}.a, 't': list_prepend('user:', list_prepend('assistant:', {b3}.t))}} END"
    return f"{_least(b0, to_u, twice)} AS v0, {_least(b1, to_u, twice)} AS v1, {_least(b2, to_a)} AS v2, {_least(b3, to_u)} AS v3"


_GOAL = "{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}"
OP13 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c // 256, steps[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) % 20 AS d
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM dealt, unnest(CASE WHEN d = 0 THEN [] WHEN d = 3 THEN [1, 2] ELSE [1] END) AS times(k) WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    NOT regexp_matches(text, '[^ 	-]') AS blank, NOT regexp_matches(text, '[.!?][ 	-]*\z') AS cut FROM damaged),
known AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || '>' || substr(role, 1, 1) AS pair FROM placed),
judged AS (
  SELECT *, blank OR again AS must, CAST(NOT blank AND NOT again AND cut AS BIGINT) AS ends FROM known),
conv AS (
  SELECT conv_id, count(*) AS n, list({{'role': role, 'text': text, 'must': must, 'cut': ends}} ORDER BY i) AS x,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count(*) FILTER (blank) AS BIGINT) AS blank,
    CAST(count(*) FILTER (again) AS BIGINT) AS duplicate, CAST(sum(ends) AS BIGINT) AS truncated,
    CAST(count(*) FILTER (pair NOT IN ('s>u', 'u>a', 'a>u')) AS BIGINT) AS illegal
  FROM judged GROUP BY conv_id),
step AS (
  SELECT conv_id, n AS i, x AS rows, {_with_inserts(_GOAL, _NONE, _NONE, _GOAL)} FROM conv
  UNION ALL
  SELECT conv_id, i - 1, rows, {_with_inserts('b0', 'b1', 'b2', 'b3')} FROM (
    SELECT conv_id, i, rows, {_row('v0', 'v2', 'u', 'user')} AS b0, {_row('v1', 'v2', 'u', 'user')} AS b1,
      {_row('v2', 'v3', 'a', 'assistant')} AS b2, {_row('v3', 'v2', 'u', 'user')} AS b3
    FROM (SELECT *, rows[i] AS x FROM step WHERE i > 0))),
names AS (SELECT DISTINCT conv_id FROM conversations)
SELECT names.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit,
  sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM names LEFT JOIN conv ON names.conv_id IS NOT DISTINCT FROM conv.conv_id
  LEFT JOIN (SELECT conv_id, v0 FROM step WHERE i = 0) done ON names.conv_id IS NOT DISTINCT FROM done.conv_id
"""


ORACLES: dict[str, str] = {"op1_warc": OP1, "op10_chat": OP10, "op13_repair": OP13, "op3_divergence": OP3, "op4_secrets": OP4, "op9_decontaminate": OP9}
