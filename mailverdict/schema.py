"""Fixed schemas: the report tree as XML, the fact row, and the side tables."""

from pyspark.sql import types as T

# The report tree is read as text only. Integers are checked and cast afterwards, so that one bad
# number rejects the whole mail, and surrounding blanks of text survive. All elements are lists, as
# each may be repeated.
REPORT_XML_SCHEMA = """
report_metadata array<struct<org_name:array<string>, date_range:array<struct<begin:array<string>, `end`:array<string>>>>>,
policy_published array<struct<domain:array<string>, adkim:array<string>, aspf:array<string>, p:array<string>, sp:array<string>, pct:array<string>>>,
record array<struct<
  row:array<struct<source_ip:array<string>, count:array<string>,
    policy_evaluated:array<struct<disposition:array<string>, dkim:array<string>, spf:array<string>,
      reason:array<struct<type:array<string>, comment:array<string>>>>>>>,
  identifiers:array<struct<header_from:array<string>, envelope_from:array<string>, envelope_to:array<string>>>,
  auth_results:array<struct<
    dkim:array<struct<domain:array<string>, selector:array<string>, result:array<string>>>,
    spf:array<struct<domain:array<string>, scope:array<string>, result:array<string>>>>>>>,
_corrupt_record string
"""

_TEXT = T.StringType()
_LONG = T.LongType()
_LIST = T.ArrayType(T.StringType())

_ENTRY_FIELDS = [
    ("message_id", _TEXT),
    ("record_number", _LONG),
    ("report_org_name", _TEXT),
    ("domain", _TEXT),
    ("policy", _TEXT),
    ("subdomain_policy", _TEXT),
    ("align_dkim", _TEXT),
    ("align_spf", _TEXT),
    ("pct", _LONG),
    ("source_ip", _TEXT),
    ("esp", _TEXT),
    ("org_name", _TEXT),
    ("org_id", _TEXT),
    ("source_host", _TEXT),
    ("source_domain", _TEXT),
    ("city", _TEXT),
    ("state", _TEXT),
    ("country", _TEXT),
    ("longitude", _TEXT),
    ("latitude", _TEXT),
    ("reverse_lookup", _LIST),
    ("message_count", _LONG),
    ("disposition", _TEXT),
    ("eval_dkim", _TEXT),
    ("eval_spf", _TEXT),
    ("header_from", _TEXT),
    ("envelope_from", _TEXT),
    ("envelope_to", _TEXT),
    ("auth_dkim_domain", _LIST),
    ("auth_dkim_selector", _LIST),
    ("auth_dkim_result", _LIST),
    ("auth_spf_domain", _LIST),
    ("auth_spf_scope", _LIST),
    ("auth_spf_result", _LIST),
    ("po_reason", _LIST),
    ("po_comment", _LIST),
    ("start_date", _LONG),
    ("end_date", _LONG),
    ("last_update", _TEXT),
]

ENTRY_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _ENTRY_FIELDS])
ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()

# What the address lookups add to a flattened record.
ENRICHED_COLUMNS = [
    "source_ip",
    "esp",
    "org_name",
    "org_id",
    "source_host",
    "source_domain",
    "city",
    "state",
    "country",
    "longitude",
    "latitude",
    "reverse_lookup",
]

# Storage adds the writing batch and a calendar period of `end_date` (UTC) as partition columns.
PERIODS = ("end_day", "end_month")


def stored_schema(period: str) -> T.StructType:
    extra = [T.StructField("batch_id", T.StringType()), T.StructField(period, T.DateType())]
    return T.StructType(ENTRY_SCHEMA.fields + extra)


QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

DECODED_SCHEMA = "message_id string, xml string, stage string, error string"

NOTICE_SCHEMA = T.StructType(
    [
        T.StructField(
            "Records",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("eventName", T.StringType()),
                        T.StructField(
                            "s3",
                            T.StructType(
                                [
                                    T.StructField(
                                        "object",
                                        T.StructType([T.StructField("key", T.StringType())]),
                                    )
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# Group keys of the drill-down, in result order.
DETAIL_KEYS = [
    "report_org_name",
    "source_ip",
    "esp",
    "source_domain",
    "source_host",
    "country",
    "disposition",
    "eval_dkim",
    "eval_spf",
    "header_from",
    "envelope_from",
    "envelope_to",
    "auth_dkim_domain",
    "auth_dkim_selector",
    "auth_dkim_result",
    "auth_spf_domain",
    "auth_spf_scope",
    "auth_spf_result",
    "po_reason",
    "po_comment",
]

# Columns the drill-down table shows, which its free-text search looks through.
DETAIL_SEARCH_COLUMNS = [
    "source_ip",
    "message_count",
    "report_org_name",
    "country",
    "source_host",
    "disposition",
    "eval_spf",
    "auth_spf_result",
    "auth_spf_domain",
    "eval_dkim",
    "auth_dkim_result",
    "auth_dkim_selector",
    "auth_dkim_domain",
    "po_comment",
    "po_reason",
]

ARRAY_COLUMNS = [n for n, t in _ENTRY_FIELDS if t is _LIST]
