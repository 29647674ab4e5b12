"""DuckDB SQL for the registered queries, written from the definitions, not from the Spark code."""

from __future__ import annotations

from checks import params as P
from checks.queries import HOST, IP_FORMS, PROVIDER_HOST, RANGE_FORMS, RANGE_TEXTS
from fixtures.entries import DUCKDB, LOOKED_UP, entries_sql, event_entries_sql
from fixtures.lookups import SUFFIX_RULES
from fixtures.mails import BREAKAGES, ODD_COMMENT
from fixtures.notices import NOTICE_KEY, UNREADABLE
from mailverdict.functions.timerange import TimeRange, last_days
from mailverdict.schema import ARRAY_COLUMNS, DETAIL_KEYS, DETAIL_SEARCH_COLUMNS, ENTRY_COLUMNS

ORACLES: dict[str, str] = {}

_ENTRIES = f"e AS ({entries_sql(DUCKDB)})"
_LOOKED_UP = f"e AS ({entries_sql(DUCKDB, looked_up=True)})"
_EVENTS = f"e AS ({event_entries_sql(DUCKDB)})"
_LABELLED_EVENTS = (
    "e AS (SELECT * REPLACE (concat('h', end_date // 3600 % 977, '.example') AS domain)"
    f" FROM ({event_entries_sql(DUCKDB)}))"
)


def _flat(column: str) -> str:
    if column in ARRAY_COLUMNS:
        return f"coalesce(array_to_string({column}, '|'), '') AS {column}"
    return column


def _flat_list(columns: list[str]) -> str:
    return ", ".join(_flat(c) for c in columns)


def _between(span: TimeRange) -> str:
    return f"end_date >= {span.start} AND end_date <= {span.end}"


_PASS = "eval_dkim = 'pass' OR eval_spf = 'pass'"


def _count(condition: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN message_count ELSE 0 END) AS bigint) AS {name}"


_STATS = f"CAST(sum(message_count) AS bigint) AS total_count, {_count(_PASS, 'pass_count')}"
_ALIGNED = ", ".join(
    [
        _STATS,
        _count("eval_spf = 'pass'", "spf_aligned_count"),
        _count("eval_dkim = 'pass'", "dkim_aligned_count"),
        _count("eval_dkim = 'pass' AND eval_spf = 'pass'", "fully_aligned_count"),
    ]
)

ORACLES["entries_view"] = f"WITH {_ENTRIES} SELECT {_flat_list(ENTRY_COLUMNS)} FROM e"
ORACLES["domain_stats"] = (
    f"WITH {_ENTRIES} SELECT domain, {_STATS} FROM e WHERE {_between(P.MONTH)} GROUP BY domain"
)
ORACLES["domain_stats_rated"] = f"""
WITH {_ENTRIES}, s AS (
  SELECT source_host AS domain, {_STATS} FROM e WHERE {_between(P.ALL_TIME)} GROUP BY ALL),
p AS (SELECT *, CASE WHEN total_count = 0 THEN 0.0::double
    ELSE pass_count::double / total_count::double * 100 END AS passing_percentage FROM s)
SELECT *, CASE WHEN passing_percentage >= 99 THEN 'success' WHEN passing_percentage >= 90
  THEN 'warning' ELSE 'error' END AS band FROM p"""
ORACLES["domain_stats_normalised"] = f"""
WITH {_ENTRIES}, n AS (SELECT concat_ws('/', domain, source_ip) AS domain, message_count, end_date,
    eval_dkim, eval_spf FROM e),
s AS (SELECT domain, {_STATS} FROM n WHERE {_between(P.MONTH)} GROUP BY domain)
SELECT domain, coalesce(total_count, 0) AS total_count, coalesce(pass_count, 0) AS pass_count
FROM (SELECT DISTINCT domain FROM n) LEFT JOIN s USING (domain)"""
ORACLES["domain_search"] = f"""
WITH {_ENTRIES} SELECT domain, {_STATS} FROM e
WHERE {_between(P.ALL_TIME)} AND contains(lower(domain), lower('{P.SEARCH}')) GROUP BY domain"""


def _summary(
    rows: str = "SELECT * FROM e", where: str = "true", host: bool = False, tail: str = ""
) -> str:
    by_host = "WHEN source_host <> '' THEN source_host" if host else ""
    host_rank = "WHEN source_host <> '' THEN 2" if host else ""
    return f"""
WITH {_ENTRIES}, f AS ({rows}), l AS (
  SELECT *, CASE WHEN esp <> '' THEN esp WHEN source_domain <> '' THEN source_domain {by_host}
      ELSE coalesce(source_ip, '') END AS source,
    CASE WHEN esp <> '' THEN 0 WHEN source_domain <> '' THEN 1 {host_rank} ELSE 3 END AS rung
  FROM f WHERE {_between(P.ALL_TIME)} AND {where}),
g AS (SELECT domain, source, {_ALIGNED}, min(rung) AS rung FROM l GROUP BY domain, source),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY total_count DESC, source) AS rn,
    count(*) OVER (PARTITION BY domain) AS n FROM g)
SELECT domain, source, total_count, pass_count, spf_aligned_count, dkim_aligned_count,
  fully_aligned_count, CASE rung WHEN 0 THEN 'ESP' WHEN 1 THEN 'SourceDomain'
    WHEN 2 THEN 'SourceHost' ELSE 'SourceIP' END AS source_type
FROM r WHERE rn <= CASE WHEN n > 1000 THEN 999 ELSE 1000 END {tail}"""


_ONE_LABEL_PER_MAIL = (
    "SELECT * REPLACE ('all.example' AS domain, message_id AS esp) FROM e"
)
ORACLES["source_summary_one"] = _summary(where=f"domain = '{P.DOMAIN}'")
ORACLES["source_summary_all"] = _summary()
ORACLES["source_summary_host"] = _summary(host=True)
ORACLES["source_summary_capped"] = _summary(_ONE_LABEL_PER_MAIL)
ORACLES["source_summary_exact_1000"] = _summary(
    "SELECT * REPLACE ('all.example' AS domain,"
    " concat('esp-', CAST(substring(message_id, 5) AS bigint) % 1000) AS esp) FROM e"
)
ORACLES["label_collision"] = _summary(
    "SELECT * REPLACE (CASE esp WHEN 'MailChimp' THEN 'sd3.example.net' ELSE esp END AS esp) FROM e"
)
ORACLES["summary_page"] = _summary(
    _ONE_LABEL_PER_MAIL,
    tail=f"ORDER BY total_count DESC, source LIMIT {P.PAGE_SIZE} OFFSET {P.PAGE * P.PAGE_SIZE}",
)
ORACLES["summary_page_seek"] = _summary(
    tail=f"ORDER BY total_count DESC, source, domain LIMIT {P.PAGE_SIZE} OFFSET {P.PAGE_SIZE}"
)
ORACLES["domain_totals"] = f"""
WITH {_ENTRIES}, g AS (
  SELECT domain, source_ip, {_ALIGNED} FROM e WHERE {_between(P.ALL_TIME)}
  GROUP BY GROUPING SETS ((domain, source_ip), (domain)) HAVING grouping(source_ip) = 1)
SELECT * EXCLUDE (source_ip), total_count AS message_count FROM g"""

_COUNTS = "total_count, pass_count, spf_aligned_count, dkim_aligned_count, fully_aligned_count"
ORACLES["domain_report_parts"] = f"""
SELECT domain, source, source_type, {_COUNTS} FROM ({ORACLES["source_summary_all"]})
UNION ALL SELECT domain, NULL, NULL, {_COUNTS} FROM ({ORACLES["domain_totals"]})"""

_KEYS = ", ".join(DETAIL_KEYS)
_KEY_ORDER = ", ".join(f"{k} NULLS FIRST" for k in DETAIL_KEYS)
_KIND_COLUMN = {"ESP": "esp", "SourceDomain": "source_domain", "SourceHost": "source_host",
                "SourceIP": "source_ip"}


def _detail(where: str, rows: str = "e") -> str:
    return f"""SELECT {_KEYS}, CAST(sum(message_count) AS bigint) AS message_count FROM {rows}
  WHERE {_between(P.ALL_TIME)} AND {where}
  GROUP BY {_KEYS} ORDER BY message_count DESC, {_KEY_ORDER} LIMIT 2500"""


_DETAIL_OUT = _flat_list([*DETAIL_KEYS, "message_count"])
for _name, (_source, _kind) in P.SOURCES.items():
    _column = _KIND_COLUMN.get(_kind)
    _where = f"domain = '{P.DOMAIN}' AND {_column} = '{_source}'" if _column else "false"
    ORACLES[_name] = f"WITH {_ENTRIES}, d AS ({_detail(_where)}) SELECT {_DETAIL_OUT} FROM d"

_TOP = f"""t AS (SELECT * REPLACE ('all.example' AS domain, 'all' AS esp) FROM e),
d AS ({_detail("domain = 'all.example' AND esp = 'all'", "t")})"""
_EVERY_DOMAIN = f"""g AS (SELECT domain, {_KEYS}, CAST(sum(message_count) AS bigint) AS message_count
  FROM (SELECT * REPLACE ('all' AS esp) FROM e) WHERE {_between(P.ALL_TIME)} GROUP BY domain, {_KEYS}),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY message_count DESC, {_KEY_ORDER}) AS rn FROM g)"""
ORACLES["detail_all_domains"] = (
    f"WITH {_ENTRIES}, {_EVERY_DOMAIN} SELECT {_flat_list(['domain', *DETAIL_KEYS, 'message_count'])} FROM r WHERE rn <= 2500"
)
ORACLES["detail_top"] = f"WITH {_ENTRIES}, {_TOP} SELECT {_DETAIL_OUT} FROM d"


def _as_text(column: str) -> str:
    if column in ARRAY_COLUMNS:
        return f"coalesce(array_to_string({column}, ','), '')"
    return f"coalesce(CAST({column} AS varchar), '')"


_HIT = " OR ".join(
    f"contains(lower({_as_text(c)}), lower('{P.DETAIL_QUERY}'))" for c in DETAIL_SEARCH_COLUMNS
)
_ESP_DETAIL = _detail(f"domain = '{P.DOMAIN}' AND esp = '{P.SOURCES['detail_esp'][0]}'")
ORACLES["detail_search"] = (
    f"WITH {_ENTRIES}, d AS ({_ESP_DETAIL}) SELECT {_DETAIL_OUT} FROM d WHERE {_HIT}"
)
ORACLES["detail_page"] = f"""
WITH {_ENTRIES}, {_TOP}, o AS (SELECT * FROM d
  ORDER BY {_as_text("po_comment")} DESC, {_KEY_ORDER}
  LIMIT {P.PAGE_SIZE} OFFSET {P.PAGE * P.PAGE_SIZE})
SELECT {_DETAIL_OUT} FROM o"""
ORACLES["auth_result_class"] = """
WITH r AS (
  SELECT CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
    WHEN 3 THEN concat(' ', upper(l_returnflag), '-Pass ') WHEN 4 THEN 'SOFTFAIL'
    WHEN 5 THEN 'Neutral' WHEN 6 THEN concat('permWarn', l_linestatus)
    ELSE concat('temperror', CAST(l_linenumber AS varchar)) END AS result
  FROM lineitem)
SELECT result, CASE WHEN result IS NULL OR result = '' THEN 'grey'
    WHEN result ILIKE '%pass%' THEN 'success' WHEN result ILIKE '%fail%' THEN 'error'
    WHEN result ILIKE '%warn%' OR result ILIKE '%neutral%' THEN 'warning' ELSE 'info' END AS class,
  count(*) AS n FROM r GROUP BY ALL"""


def _buckets(span: TimeRange) -> str:
    return f"""b AS (SELECT domain, (end_date - {span.start}) // 86400 + 1 AS bucket,
    {_count(_PASS, 'passing')},
    {_count("eval_dkim <> 'pass' AND eval_spf <> 'pass'", 'failing')}
  FROM e WHERE end_date >= {span.start} AND end_date < {span.bucket_end} GROUP BY ALL)"""


def _chart(span: TimeRange, rows: str, where: str = "true", step: int = 86000) -> str:
    labels = max((span.end - span.start - 1) // step, 0)
    return f"""{rows}, {_buckets(span)},
m AS (SELECT domain, greatest(max(bucket), {labels}) AS n FROM b WHERE {where} GROUP BY domain),
k AS (SELECT domain, unnest(range(1, n + 1)) AS bucket FROM m),
c AS (SELECT k.domain, k.bucket, (k.bucket * {step} + {span.start}) * 1000 AS ts_ms,
    coalesce(passing, 0) AS pass, coalesce(failing, 0) AS fail
  FROM k LEFT JOIN b ON k.domain = b.domain AND k.bucket = b.bucket)"""


_LONG = ", ".join(
    [
        "domain",
        "'{0}' AS series",
        "ts_ms",
        "CAST(CAST(make_timestamp(ts_ms * 1000) AS date) AS varchar) AS label_date",
        "{0} AS value",
    ]
)
_BOTH = f"SELECT {_LONG.format('pass')} FROM c UNION ALL SELECT {_LONG.format('fail')} FROM c"

ORACLES["daily_buckets"] = f"WITH {_EVENTS}, {_buckets(P.EVENTS)} SELECT * FROM b"
ORACLES["daily_chart_one"] = (
    f"WITH {_chart(P.EVENTS, _EVENTS, f"domain = '{P.EVENT_DOMAIN}'")} SELECT * FROM c"
)
ORACLES["daily_chart_all"] = f"WITH {_chart(P.EVENTS, _EVENTS)} SELECT * FROM c"
ORACLES["daily_chart_default"] = f"WITH {_chart(last_days(P.NOW), _ENTRIES)} SELECT * FROM c"
ORACLES["daily_chart_sparse"] = f"WITH {_chart(P.EVENTS, _LABELLED_EVENTS)} SELECT * FROM c"
ORACLES["daily_chart_true_dates"] = (
    f"WITH {_chart(P.EVENTS, _LABELLED_EVENTS, step=86400)} SELECT * FROM c"
)
ORACLES["daily_chart_long"] = f"WITH {_chart(P.EVENTS, _EVENTS)} {_BOTH}"
ORACLES["daily_chart_long_range"] = f"WITH {_chart(P.ALL_TIME, _ENTRIES)} {_BOTH}"

ORACLES["range_presets"] = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS date) AS t FROM orders),
m AS (SELECT t, CAST(date_trunc('month', t) AS date) AS first FROM d)
SELECT CAST(t AS varchar) AS day, CAST(t - 7 AS varchar) AS last_7_start,
  CAST(t AS varchar) AS last_7_end, CAST(t - 30 AS varchar) AS last_30_start,
  CAST(t AS varchar) AS last_30_end, CAST(first AS varchar) AS this_month_start,
  CAST(t AS varchar) AS this_month_end,
  CAST(CAST(first - INTERVAL 1 MONTH AS date) AS varchar) AS last_month_start,
  CAST(first - 1 AS varchar) AS last_month_end,
  CAST(t - 7 <= first AS int) AS week_before_month
FROM m"""

# Seconds each text form means, relative to its day.
_SECONDS = "{form} WHEN 1 THEN day_s + {day} WHEN 2 THEN day_s + 18367 WHEN 3 THEN day_s + 11167"
_SECONDS += " WHEN 4 THEN day_s + 106199"
ORACLES["parse_ranges"] = f"""
WITH o AS ({RANGE_TEXTS.format(epoch='epoch', day="strftime(o_orderdate, '%Y-%m-%d')", div='//')}),
r AS (SELECT o_orderkey,
  CASE {_SECONDS.format(form='s_form', day=0)} ELSE now_s - now_s % 86400 - 2592000 END AS start_s,
  least(CASE {_SECONDS.format(form='e_form', day=86399)} ELSE now_s END, now_s) AS end_s FROM o)
SELECT *, CAST(CAST(make_timestamp(start_s * 1000000) AS date) AS varchar) AS start_date,
  CAST(CAST(make_timestamp(end_s * 1000000) AS date) AS varchar) AS end_date FROM r"""

_ADDRESS_COLUMNS = ["source_ip", "auth_dkim_domain", *LOOKED_UP]
_SEEN = f"""a AS (SELECT DISTINCT
    CASE WHEN contains(source_ip, '.') AND len(auth_dkim_domain) = 2
      THEN concat('::ffff:', source_ip) ELSE coalesce(source_ip, 'unknown') END AS raw_ip,
    source_ip, {_flat_list(list(LOOKED_UP))}
  FROM ({entries_sql(DUCKDB, True, _ADDRESS_COLUMNS)}))"""
ORACLES["ip_intel"] = f"WITH {_SEEN} SELECT * FROM a"
ORACLES["ptr_route"] = f"""
WITH {_SEEN} SELECT source_ip, source_host, source_domain, esp, reverse_lookup FROM a
WHERE contains(source_ip, ':')"""
ORACLES["ip_canonical"] = f"""
SELECT *, CASE
    WHEN form IN (0, 1) THEN concat('10.0.', k // 256 % 256, '.', k % 256)
    WHEN form = 2 THEN concat('2001:db8::', CASE WHEN k % 10000 = 0 THEN '' ELSE CAST(k % 10000 AS varchar) END)
    WHEN form = 6 AND k % 10000 = 0 THEN '2001:db8:0:0:1::'
    WHEN form = 6 THEN concat('2001:db8::1:0:0:', k % 10000) END AS source_ip
FROM ({IP_FORMS.format(div='//', s='varchar')})"""

_RULES = ", ".join(
    f"('{rule.removeprefix('*.').removeprefix('!')}', '{kind}', {str(icann).lower()})"
    for rule, kind, icann in SUFFIX_RULES
)


def _org_domains(host: str) -> str:
    """Rules by comparison of endings; the suffix itself is then counted in labels."""
    return f"""
h AS (SELECT DISTINCT {host} AS host FROM pages),
n AS (SELECT host, rtrim(host, '.') AS name, string_split(rtrim(host, '.'), '.') AS labels FROM h),
r(ending, kind, icann) AS (VALUES {_RULES}),
x AS (SELECT host, name, labels, kind, icann, len(string_split(ending, '.')) +
      CASE kind WHEN 'normal' THEN 0 WHEN 'wildcard' THEN 1 ELSE -1 END AS width
  FROM n LEFT JOIN r ON (name = ending AND kind <> 'wildcard') OR ends_with(name, '.' || ending)),
b AS (SELECT * FROM x QUALIFY row_number() OVER (
  PARTITION BY host ORDER BY kind = 'exception' DESC NULLS LAST, width DESC NULLS LAST) = 1),
o AS (SELECT host,
  CASE WHEN NOT coalesce(icann, false) THEN NULL WHEN len(labels) - width <= 1 THEN name
    ELSE array_to_string(labels[len(labels) - width:], '.') END AS org_domain,
  CASE WHEN NOT coalesce(icann, false) THEN concat('no public suffix rule for ', name) END AS error
  FROM b)"""


ORACLES["org_domain"] = f"WITH {_org_domains(HOST)} SELECT * FROM o"
ORACLES["org_domain_esp"] = f"""
WITH {_org_domains(PROVIDER_HOST)} SELECT host, org_domain,
  CASE WHEN org_domain = 'amazonses.com' THEN 'Amazon SES' WHEN org_domain = 'google.com'
    THEN 'Google Mail' WHEN org_domain IN ('rsgsv.net', 'mcsv.net', 'mcdlv.net') THEN 'MailChimp'
    ELSE '' END AS esp FROM o"""

_FROM_REPORT = [c for c in ENTRY_COLUMNS if c not in {"source_ip", *LOOKED_UP}]
ORACLES["flatten_all_reports"] = f"""
WITH {_ENTRIES} SELECT {_flat_list(_FROM_REPORT)}, coalesce(source_ip, 'unknown') AS raw_ip FROM e"""

_ODD = f"(SELECT * REPLACE (list_prepend('odd', po_reason) AS po_reason, list_prepend('{ODD_COMMENT}', po_comment) AS po_comment) FROM e)"
ORACLES["flatten_odd_reports"] = f"""
WITH {_ENTRIES} SELECT {_flat_list(_FROM_REPORT)}, coalesce(source_ip, 'unknown') AS raw_ip FROM {_ODD} AS e"""

_EMPTY = {
    "message_id": "concat('msg-', CAST(o_orderkey AS varchar))",
    "report_org_name": "o_orderpriority",
    "domain": "concat('d', CAST(o_custkey % 20 AS varchar), '.example.com')",
    "policy": "'none'",
    "align_dkim": "'r'",
    "record_number": "0::bigint",
    "pct": "0::bigint",
    "message_count": "0::bigint",
    "start_date": "CAST(epoch(o_orderdate) AS bigint)",
    "end_date": "CAST(epoch(o_orderdate) AS bigint) + 86399",
}
ORACLES["empty_report"] = "SELECT {} FROM orders".format(
    ", ".join(f"{_EMPTY.get(c, chr(39) * 2)} AS {c}" for c in [*_FROM_REPORT, "raw_ip"])
)

_STORED = f"WITH {_LOOKED_UP} SELECT {_flat_list(ENTRY_COLUMNS)} FROM e"
ORACLES["ingest_roundtrip"] = _STORED
ORACLES["ingest_incremental"] = _STORED
ORACLES["ingest_compacted"] = _STORED
ORACLES["ingest_known_addresses"] = _STORED
ORACLES["domain_stats_totalled"] = ORACLES["domain_stats"]
ORACLES["source_summary_totalled"] = ORACLES["source_summary_all"]
ORACLES["domain_totals_totalled"] = ORACLES["domain_totals"]
ORACLES["daily_chart_totalled"] = f"WITH {_chart(P.ALL_TIME, _ENTRIES)} SELECT * FROM c"
ORACLES["ingest_quarantine"] = """
SELECT DISTINCT concat('msg-', CAST(l_orderkey AS varchar)) AS message_id,
  CASE l_orderkey % 13 {} ELSE 'stored' END AS stage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey""".format(
    " ".join(f"WHEN {i} THEN '{stage}'" for i, stage in enumerate(BREAKAGES.values()))
)

_ANNOUNCED = f"""n AS (SELECT {NOTICE_KEY.format(S='varchar')} AS message_id FROM events
  WHERE event_type IN ('signup', 'click') AND NOT ({UNREADABLE}))"""
ORACLES["notice_filter"] = (
    f"WITH {_ANNOUNCED} SELECT message_id, count(*) AS n FROM n GROUP BY message_id"
)
ORACLES["notice_documents"] = ORACLES["notice_filter"]
ORACLES["stream_two_checkpoints"] = ORACLES["stream_ingest"] = f"""
WITH {_LOOKED_UP}, {_ANNOUNCED} SELECT {_flat_list(ENTRY_COLUMNS)} FROM e
WHERE message_id IN (SELECT message_id FROM n)"""
ORACLES["stream_first_seen"] = f"""
WITH {_LOOKED_UP}, {_ANNOUNCED},
bad AS (SELECT count(*) AS c FROM events WHERE {UNREADABLE})
SELECT message_id, count(*) AS stored, CAST(0 AS BIGINT) AS aside FROM e
WHERE end_date <= {P.FIRST_RUN_END} OR message_id IN (SELECT message_id FROM n) GROUP BY message_id
UNION ALL SELECT DISTINCT message_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM n WHERE message_id NOT IN (SELECT message_id FROM e)
UNION ALL SELECT NULL, CAST(0 AS BIGINT), c FROM bad WHERE c > 0"""
