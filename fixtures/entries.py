"""Fact rows derived from the test tables, as SQL text in Spark's and in DuckDB's dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mailverdict.schema import ENTRY_COLUMNS

SPARK = {
    "S": "string",
    "DIV": "div",
    "EPOCH": "unix_timestamp",
    "EPOCH_TS": "unix_timestamp(ts)",
    "ARR": "array",
    "ARR0": "CAST(array() AS array<string>)",
}
DUCKDB = {
    "S": "varchar",
    "DIV": "//",
    "EPOCH": "epoch",
    "EPOCH_TS": "floor(epoch(ts))",
    "ARR": "list_value",
    "ARR0": "CAST([] AS varchar[])",
}

# Every supplier has an address of its own, at any scale.
_IPV4 = (
    "concat('10.', CAST(l_suppkey {DIV} 65536 % 256 AS {S}), '.',"
    " CAST(l_suppkey {DIV} 256 % 256 AS {S}), '.', CAST(l_suppkey % 256 AS {S}))"
)
_IPV6 = (
    "concat('2001:db8::', CASE WHEN l_suppkey < 10000 THEN ''"
    " ELSE concat(CAST(l_suppkey {DIV} 10000 AS {S}), ':') END, CAST(l_suppkey % 10000 AS {S}))"
)

# What a report says about each of its records: one mail per order, one record per line item.
_REPORTED = {
    "message_id": "concat('msg-', CAST(l_orderkey AS {S}))",
    "record_number": "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,"
    " l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS bigint)",
    "report_org_name": "c_mktsegment",
    "domain": "concat('d', CAST(o_custkey % 20 AS {S}), '.example.com')",
    "policy": "CASE o_orderstatus WHEN 'F' THEN 'reject' WHEN 'P' THEN 'quarantine' ELSE 'none' END",
    "subdomain_policy": "CASE o_orderstatus WHEN 'F' THEN 'none' ELSE 'reject' END",
    "align_dkim": "'r'",
    "align_spf": "'s'",
    "pct": "CAST(100 AS bigint)",
    "source_ip": "CASE WHEN l_suppkey % 50 = 49 THEN CAST(NULL AS {S})"
    " WHEN l_suppkey % 10 = 9 THEN " + _IPV6 + " ELSE " + _IPV4 + " END",
    "message_count": "CAST(l_quantity AS bigint)",
    "disposition": "CASE WHEN l_discount > 0.05 THEN 'reject' WHEN l_discount > 0.02 THEN 'quarantine'"
    " ELSE 'none' END",
    "eval_dkim": "CASE l_returnflag WHEN 'R' THEN 'fail' ELSE 'pass' END",
    "eval_spf": "CASE l_linestatus WHEN 'O' THEN 'pass' ELSE 'fail' END",
    "header_from": "concat('d', CAST(o_custkey % 20 AS {S}), '.example.com')",
    "envelope_from": "concat('b', CAST(l_partkey % 3 AS {S}), '.example.com')",
    "envelope_to": "''",
    "auth_dkim_domain": "CASE WHEN l_linenumber = 1 THEN {ARR0} WHEN l_linenumber <= 4"
    " THEN {ARR}('a.example') ELSE {ARR}('a.example','b.example') END",
    "auth_dkim_selector": "CASE WHEN l_linenumber = 1 THEN {ARR0} WHEN l_linenumber <= 4"
    " THEN {ARR}('k1') ELSE {ARR}('k1','k2') END",
    "auth_dkim_result": "CASE WHEN l_linenumber = 1 THEN {ARR0} WHEN l_linenumber <= 4"
    " THEN {ARR}('pass') ELSE {ARR}('pass','fail') END",
    "auth_spf_domain": "{ARR}(concat('b', CAST(l_partkey % 3 AS {S}), '.example.com'))",
    "auth_spf_scope": "{ARR}('mfrom')",
    "auth_spf_result": "{ARR}(CASE l_linestatus WHEN 'O' THEN 'pass' ELSE 'softfail' END)",
    "po_reason": "CASE WHEN l_tax > 0.06 THEN {ARR}('forwarded') ELSE {ARR0} END",
    "po_comment": "CASE WHEN l_tax > 0.06 THEN {ARR}('known relay, ok') ELSE {ARR0} END",
    "start_date": "CAST({EPOCH}(o_orderdate) AS bigint)",
    "end_date": "CAST({EPOCH}(o_orderdate) AS bigint) + 86399",
    "last_update": "''",
}

# Sender fields as plain values, for the analytic queries.
_SENDER = {
    "esp": "CASE l_suppkey % 10 WHEN 0 THEN 'Google Mail' WHEN 1 THEN 'Amazon SES'"
    " WHEN 2 THEN 'MailChimp' ELSE '' END",
    "source_domain": "CASE WHEN l_suppkey % 10 <= 5"
    " THEN concat('sd', CAST(l_suppkey % 7 AS {S}), '.example.net') ELSE '' END",
    "source_host": "CASE WHEN l_suppkey % 10 <= 7"
    " THEN concat('mail', CAST(l_suppkey AS {S}), '.example.net') ELSE '' END",
    "country": "CASE s_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'CN' ELSE '' END",
    "org_name": "''",
    "org_id": "''",
    "city": "''",
    "state": "''",
    "longitude": "''",
    "latitude": "''",
    "reverse_lookup": "{ARR0}",
}

# Sender fields as the lookup tables of `fixtures.lookups` describe the same addresses. Suppliers
# ending in 9 send from IPv6 (or from no address at all), suppliers ending in 8 are not listed.
_K = "l_suppkey"
_LISTED = f"{_K} % 10 <= 7"
_V6 = f"({_K} % 10 = 9 AND {_K} % 50 <> 49)"
LOOKED_UP = {
    "esp": f"CASE WHEN {_K} % 10 = 0 THEN 'Google Mail' WHEN {_K} % 10 = 1 THEN 'Amazon SES'"
    f" WHEN {_K} % 10 = 2 THEN 'MailChimp' WHEN {_V6} AND {_K} % 3 = 0 THEN 'Outlook' ELSE '' END",
    "org_name": f"CASE WHEN NOT ({_LISTED}) THEN '' WHEN {_K} % 10 = 0 THEN 'Google LLC'"
    f" WHEN {_K} % 10 = 1 THEN 'AMAZON Technologies' WHEN {_K} % 10 = 2 THEN 'The MailChimp Group'"
    f" ELSE concat('Sender ', CAST({_K} AS {{S}})) END",
    "org_id": f"CASE WHEN {_LISTED} THEN concat('id', CAST({_K} AS {{S}})) ELSE '' END",
    "source_host": f"CASE WHEN {_LISTED} THEN concat('mail', CAST({_K} AS {{S}}), '.example.net')"
    f" WHEN {_V6} AND {_K} % 3 = 0 THEN concat('mx', CAST({_K} AS {{S}}), '.protection.outlook.com')"
    f" WHEN {_V6} AND {_K} % 3 = 1 THEN"
    f" concat('f', CAST({_K} AS {{S}}), '.unverified-forwarding.1e100.net') ELSE '' END",
    "source_domain": f"CASE WHEN {_LISTED} AND {_K} % 10 <= 5"
    f" THEN concat('sd', CAST({_K} % 7 AS {{S}}), '.example.net')"
    f" WHEN {_V6} AND {_K} % 3 = 0 THEN 'outlook.com'"
    f" WHEN {_V6} AND {_K} % 3 = 1 THEN 'unverified-forwarding.1e100.net' ELSE '' END",
    "city": f"CASE WHEN {_LISTED} THEN concat('City', CAST({_K} AS {{S}})) ELSE '' END",
    "state": f"CASE WHEN {_LISTED} THEN 'ST' ELSE '' END",
    "country": f"CASE WHEN NOT ({_LISTED}) THEN '' ELSE {_SENDER['country']} END",
    "longitude": f"CASE WHEN {_LISTED} THEN concat('-', CAST({_K} % 180 AS {{S}}), '.5') ELSE '' END",
    "latitude": f"CASE WHEN {_LISTED} THEN concat(CAST({_K} % 90 AS {{S}}), '.25') ELSE '' END",
    "reverse_lookup": f"CASE WHEN {_V6} AND {_K} % 3 = 0"
    f" THEN {{ARR}}(concat('mx', CAST({_K} AS {{S}}), '.protection.outlook.com.'), 'other.example.')"
    f" WHEN {_V6} AND {_K} % 3 = 1"
    f" THEN {{ARR}}(concat('f', CAST({_K} AS {{S}}), '.unverified-forwarding.1e100.net.'))"
    f" WHEN {_K} % 10 = 4 THEN {{ARR}}(concat('rev', CAST({_K} AS {{S}}), '.example.net.'))"
    f" ELSE {{ARR0}} END",
}

_TABLES = (
    "lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
)


# The same join for Spark, in an order that moves little: line items meet the suppliers, then, dealt by order, the orders
# with their customers, and records are numbered where they lie then. The fields are worked out from the numbered rows,
# so that shuffles carry the few columns of the tables.
_NUMBERED = f"""
(SELECT *, {_REPORTED["record_number"]} AS record_number
 FROM (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) AS sent
 JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) AS ordered ON l_orderkey = o_orderkey) AS numbered"""

#: The order a mail is about, as `entries` names it when asked for: rows are dealt by it already.
ORDER_KEY = "order_key"


def _listed(fields: dict[str, str], columns: list[str]) -> str:
    return ",\n  ".join(f"{fields[c]} AS {c}" for c in columns)


def entries_sql(dialect: dict, looked_up: bool = False, columns: list[str] | None = None) -> str:
    fields = _REPORTED | (LOOKED_UP if looked_up else _SENDER)
    return f"SELECT {_listed(fields, columns or ENTRY_COLUMNS)}\nFROM {_TABLES}".format(**dialect)


# One row per event, for the daily chart.
EVENT_ENTRIES = """
SELECT concat('ev-', CAST(event_id AS {S})) AS message_id, CAST(0 AS bigint) AS record_number,
  concat('u', CAST(user_id % 5 AS {S}), '.example.org') AS domain,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fail' ELSE 'pass' END AS eval_dkim,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'fail' ELSE 'pass' END AS eval_spf,
  CAST(1 + event_id % 10 AS bigint) AS message_count,
  CAST({EPOCH_TS} AS bigint) AS end_date
FROM events"""


def event_entries_sql(dialect: dict) -> str:
    return EVENT_ENTRIES.format(**dialect)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run Spark SQL over test tables, passed as arguments instead of session-wide views."""
    for name in names:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def entries(
    spark: SparkSession, sf_dir: str, looked_up: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """The rows of `entries_sql`; with `ORDER_KEY` among the columns also the order of each."""
    fields = _REPORTED | (LOOKED_UP if looked_up else _SENDER) | {"record_number": "record_number", ORDER_KEY: "l_orderkey"}
    text = f"SELECT {_listed(fields, columns or ENTRY_COLUMNS)}\nFROM {_NUMBERED}".format(**SPARK)
    return run_sql(spark, sf_dir, text, "lineitem", "orders", "customer", "supplier")


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`entries` with the order of each, for `fixtures.mails.report_xml`."""
    return entries(spark, sf_dir, columns=[*ENTRY_COLUMNS, ORDER_KEY])


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, event_entries_sql(SPARK), "events")
