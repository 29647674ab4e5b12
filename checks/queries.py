"""The registered queries: each takes a session and a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import params as P
from fixtures import entries as fe
from fixtures import lookups as fl
from fixtures import mails as fm
from fixtures import notices as fn
from mailverdict.functions import timerange, verdicts
from mailverdict.functions.addresses import canonical_ip, lookup_name
from mailverdict.operators.domains import add_esp, org_domains
from mailverdict.operators.enrich import address_table
from mailverdict.operators.filters import Key, page, page_after, search_domains
from mailverdict.operators.flatten import flatten_reports
from mailverdict.operators.totals import Totalled
from mailverdict.plans import backfill, reports, totalled
from mailverdict.schema import ENRICHED_COLUMNS, ENTRY_COLUMNS, QUARANTINE_SCHEMA
from mailverdict.session import keep, passing_dir
from mailverdict.sources.notices import notified_keys, parse_notices, read_notices
from mailverdict.sources.reports import parse_reports
from mailverdict.sources.warehouse import Warehouse
from mailverdict.streaming.ingest import ingest_stream, stop_between_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that every column is a plain value."""
    return df.select(
        *(
            F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c)
            for c, t in df.dtypes
        )
    )


# ---- reports ------------------------------------------------------------------------------------


@register
def entries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(fe.entries(spark, sf_dir))


@register
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.domain_stats(fe.entries(spark, sf_dir), P.NOW)


@register
def domain_stats_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_sender = fe.entries(spark, sf_dir).withColumn("domain", F.col("source_host"))
    return reports.add_rating(reports.domain_stats_between(per_sender, P.ALL_TIME))


@register
def domain_stats_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reporter with its month: reporters that saw nothing get zeros, not gaps."""
    rows = fe.entries(spark, sf_dir).withColumn("domain", F.concat_ws("/", "domain", "source_ip"))
    stats = reports.domain_stats(rows, P.NOW)
    everyone = rows.select("domain").distinct()
    return verdicts.normalise(everyone.join(stats, "domain", "left"))


@register
def domain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.domain_stats_between(fe.entries(spark, sf_dir), P.ALL_TIME)
    return search_domains(stats, P.SEARCH)


@register
def source_summary_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_summary(fe.entries(spark, sf_dir), P.ALL_TIME, P.DOMAIN)


@register
def source_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_summary(fe.entries(spark, sf_dir), P.ALL_TIME)


@register
def source_summary_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_summary(fe.entries(spark, sf_dir), P.ALL_TIME, include_host=True)


@register
def source_summary_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fe.entries(spark, sf_dir).withColumns(
        {"domain": F.lit("all.example"), "esp": F.col("message_id")}
    )
    return reports.source_summary(rows, P.ALL_TIME)


@register
def source_summary_exact_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring_index("message_id", "-", -1).cast("bigint")
    rows = fe.entries(spark, sf_dir).withColumns(
        {"domain": F.lit("all.example"), "esp": F.concat(F.lit("esp-"), F.pmod(number, F.lit(1000)))}
    )
    return reports.source_summary(rows, P.ALL_TIME)


@register
def label_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers renamed to the text of a sender domain: equal labels of two kinds become one."""
    rows = fe.entries(spark, sf_dir).withColumn(
        "esp", F.when(F.col("esp") == "MailChimp", "sd3.example.net").otherwise(F.col("esp"))
    )
    return reports.source_summary(rows, P.ALL_TIME)


@register
def summary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fe.entries(spark, sf_dir).withColumns(
        {"domain": F.lit("all.example"), "esp": F.col("message_id")}
    )
    summary = reports.source_summary(rows, P.ALL_TIME)
    return page(summary, [F.desc("total_count"), F.asc("source")], P.PAGE, P.PAGE_SIZE)


@register
def summary_page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `summary_page`, found behind the last row of the page before."""
    summary = keep(reports.source_summary(fe.entries(spark, sf_dir), P.ALL_TIME), "summary")
    order = [Key("total_count", descending=True), Key("source"), Key("domain")]
    return page_after(summary, order, page_after(summary, order, None, P.PAGE_SIZE).collect()[-1], P.PAGE_SIZE)


@register
def domain_report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders and totals of every domain from one pass over the facts."""
    summary, totals = reports.report_parts(fe.entries(spark, sf_dir), P.ALL_TIME, stage=keep)
    columns = ["domain", "source", "source_type", *(c for c in totals.columns if c not in ("domain", "message_count"))]
    every = totals.withColumns({"source": F.lit(None).cast("string"), "source_type": F.lit(None).cast("string")})
    return summary.select(*columns).union(every.select(*columns))


@register
def domain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.domain_totals(fe.entries(spark, sf_dir), P.ALL_TIME)


def _detail(name: str) -> Query:
    source, kind = P.SOURCES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = fe.entries(spark, sf_dir)
        return flat(reports.source_detail(rows, P.ALL_TIME, P.DOMAIN, source, kind))

    query.__name__ = name
    return query


for _name in P.SOURCES:
    register(_detail(_name))


def _detail_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fe.entries(spark, sf_dir).withColumns(
        {"domain": F.lit("all.example"), "esp": F.lit("all")}
    )
    return reports.source_detail(rows, P.ALL_TIME, "all.example", "all", "ESP")


@register
def detail_all_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provider everywhere, so that the cap binds in every large domain."""
    rows = fe.entries(spark, sf_dir).withColumn("esp", F.lit("all"))
    return flat(reports.source_detail(rows, P.ALL_TIME, None, "all", "ESP"))


@register
def detail_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_detail_top(spark, sf_dir))


@register
def detail_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, kind = P.SOURCES["detail_esp"]
    rows = reports.source_detail(
        fe.entries(spark, sf_dir), P.ALL_TIME, P.DOMAIN, source, kind
    )
    return flat(reports.search_detail(rows, P.DETAIL_QUERY))


@register
def detail_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detail_top(spark, sf_dir)
    order = reports.detail_order_by_comment(descending=True)
    return flat(page(rows, order, P.PAGE, P.PAGE_SIZE))


@register
def auth_result_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """
      SELECT CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
        WHEN 3 THEN concat(' ', upper(l_returnflag), '-Pass ') WHEN 4 THEN 'SOFTFAIL'
        WHEN 5 THEN 'Neutral' WHEN 6 THEN concat('permWarn', l_linestatus)
        ELSE concat('temperror', CAST(l_linenumber AS string)) END AS result
      FROM lineitem"""
    rows = fe.run_sql(spark, sf_dir, text, "lineitem")
    classed = rows.withColumn("class", verdicts.result_class(F.col("result")))
    return classed.groupBy("result", "class").agg(F.count(F.lit(1)).alias("n"))


# ---- daily charts -------------------------------------------------------------------------------


@register
def daily_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_buckets(fe.event_entries(spark, sf_dir), P.EVENTS)


@register
def daily_chart_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_chart(fe.event_entries(spark, sf_dir), P.EVENTS, P.EVENT_DOMAIN)


@register
def daily_chart_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_chart(fe.event_entries(spark, sf_dir), P.EVENTS)


@register
def daily_chart_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range without bounds stands for the last 30 days."""
    rows = fe.entries(spark, sf_dir)
    return reports.daily_chart(rows, timerange.TimeRange(0, 0), now=P.NOW)


def _hourly_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many domains with few rows each, so that most days of a domain are empty."""
    name = F.concat(F.lit("h"), F.expr("end_date div 3600 % 977"), F.lit(".example"))
    return fe.event_entries(spark, sf_dir).withColumn("domain", name)


@register
def daily_chart_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_chart(_hourly_domains(spark, sf_dir), P.EVENTS)


@register
def daily_chart_true_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_chart(_hourly_domains(spark, sf_dir), P.EVENTS, label_step=86400)


@register
def daily_chart_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_chart_long(daily_chart_all(spark, sf_dir))


@register
def daily_chart_long_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = reports.daily_chart(fe.entries(spark, sf_dir), P.ALL_TIME)
    return reports.daily_chart_long(chart)


# ---- time ranges --------------------------------------------------------------------------------


@register
def range_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named ranges as seen from every order day, and whether a picked range is valid."""
    days = (
        fe.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    )
    columns: list[Column] = [F.col("day").cast("string").alias("day")]
    ranges = timerange.preset_columns(F.col("day"))
    for name, (start, end) in ranges.items():
        columns += [start.cast("string").alias(f"{name}_start"), end.cast("string").alias(f"{name}_end")]
    valid = timerange.valid_range_column(ranges["last_7"][0], ranges["this_month"][0])
    return days.select(*columns, valid.cast("int").alias("week_before_month"))


RANGE_TEXTS = """
SELECT o_orderkey, CAST({epoch}(o_orderdate) AS bigint) AS day_s,
  CAST({epoch}(o_orderdate) AS bigint) + (o_custkey % 20 - 5) * 86400 + 45296 AS now_s,
  {day} AS d, o_orderkey % 8 AS s_form, o_orderkey {div} 8 % 8 AS e_form
FROM orders"""

RANGE_FORMS = """CASE {form} WHEN 0 THEN NULL WHEN 1 THEN d WHEN 2 THEN concat(d, 'T05:06:07Z')
  WHEN 3 THEN concat(d, 'T05:06:07.25+02:00') WHEN 4 THEN concat(d, 'T23:59:59-05:30')
  WHEN 5 THEN 'yesterday' WHEN 6 THEN concat(substring(d, 1, 5), '02-30') ELSE '' END"""


@register
def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = RANGE_TEXTS.format(
        epoch="unix_timestamp", day="date_format(o_orderdate, 'yyyy-MM-dd')", div="div"
    )
    rows = fe.run_sql(spark, sf_dir, text, "orders").withColumns(
        {
            "start_text": F.expr(RANGE_FORMS.format(form="s_form")),
            "end_text": F.expr(RANGE_FORMS.format(form="e_form")),
        }
    )
    start, end = timerange.range_columns(F.col("start_text"), F.col("end_text"), F.col("now_s"))
    return rows.select(
        "o_orderkey",
        start.alias("start_s"),
        end.alias("end_s"),
        timerange.epoch_date_text(start).alias("start_date"),
        timerange.epoch_date_text(end).alias("end_date"),
    )


# ---- sender lookups -----------------------------------------------------------------------------


def _seen_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fe.entries(spark, sf_dir, columns=["source_ip", "auth_dkim_domain"])
    mapped = F.col("source_ip").contains(".") & (F.size("auth_dkim_domain") == 2)
    return rows.select(
        F.when(mapped, F.concat(F.lit("::ffff:"), "source_ip"))
        .otherwise(F.coalesce("source_ip", F.lit("unknown")))
        .alias("raw_ip")
    ).distinct()


@register
def ip_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = address_table(
        _seen_addresses(spark, sf_dir), fl.ip_txt(spark, sf_dir), fl.ptr(spark, sf_dir), keep
    )
    return flat(found.select("raw_ip", *ENRICHED_COLUMNS))


@register
def ptr_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _seen_addresses(spark, sf_dir)
    found = address_table(seen, fl.ip_txt(spark, sf_dir), fl.ptr(spark, sf_dir), keep)
    return flat(
        found.filter(F.col("source_ip").contains(":")).select("source_ip", "source_host", "source_domain", "esp", "reverse_lookup")
    )


IP_FORMS = """
SELECT DISTINCT k, form, CASE form
  WHEN 0 THEN concat('10.0.', k {div} 256 % 256, '.', k % 256)
  WHEN 1 THEN concat('::ffff:10.0.', k {div} 256 % 256, '.', k % 256)
  WHEN 2 THEN concat('2001:0DB8:0000:0000:0000:0000:0000:', lpad(CAST(k % 10000 AS {s}), 4, '0'))
  WHEN 3 THEN concat('10.0.', k {div} 256 % 256, '.0', k % 256)
  WHEN 4 THEN concat('2001:db8::', k % 10000, '%eth0')
  WHEN 5 THEN concat(k % 256, '.', k % 256)
  WHEN 6 THEN concat('2001:DB8:0:0:1:0:0:', k % 10000)
  ELSE concat(' 10.0.', k {div} 256 % 256, '.', k % 256) END AS raw_ip
FROM (SELECT l_suppkey AS k, l_partkey % 8 AS form FROM lineitem) AS spelled"""


@register
def ip_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fe.run_sql(spark, sf_dir, IP_FORMS.format(div="div", s="string"), "lineitem")
    return rows.select("k", "form", "raw_ip", canonical_ip("raw_ip").alias("source_ip"))


HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


@register
def org_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = fe.table(spark, sf_dir, "pages").select(F.expr(HOST).alias("host"))
    return org_domains(hosts, fl.suffix_rules(spark))


# Page hosts moved below the registrable domains of providers.
PROVIDER_HOST = f"""CASE page_id % 4 WHEN 0 THEN concat({HOST}, '.google.com')
  WHEN 1 THEN concat({HOST}, '.eu.amazonses.com.') WHEN 2 THEN concat({HOST}, '.mcsv.net')
  ELSE {HOST} END"""


@register
def org_domain_esp(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = fe.table(spark, sf_dir, "pages").select(F.expr(PROVIDER_HOST).alias("host"))
    found = add_esp(org_domains(hosts, fl.suffix_rules(spark)))
    return found.select("host", "org_domain", "esp")


# ---- ingest -------------------------------------------------------------------------------------


def _undecoded(report_xml: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return report_xml.withColumns({"stage": nothing, "error": nothing})


def _flattened(report_xml: DataFrame) -> DataFrame:
    records = flatten_reports(parse_reports(_undecoded(report_xml)))
    columns = [c for c in ENTRY_COLUMNS if c in records.columns]
    return flat(records.select(*columns, "raw_ip"))


@register
def flatten_odd_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with a repeated container, CDATA that looks like a tag, and decoys in the wrong case."""
    plain = fm.report_xml(fe.reported(spark, sf_dir))
    return _flattened(plain.withColumn("xml", fm.made_odd(F.col("xml"))))


@register
def flatten_all_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flattened(fm.report_xml(fe.reported(spark, sf_dir)))


@register
def empty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without records, one per order."""
    text = """
      SELECT concat('msg-', CAST(o_orderkey AS string)) AS message_id, o_orderpriority AS report_org_name,
        concat('d', CAST(o_custkey % 20 AS string), '.example.com') AS domain, 'none' AS policy,
        '' AS subdomain_policy, 'r' AS align_dkim, CAST(NULL AS string) AS align_spf, '' AS pct,
        unix_timestamp(o_orderdate) AS start_date, unix_timestamp(o_orderdate) + 86399 AS end_date
      FROM orders"""
    return _flattened(fm.empty_report_xml(fe.run_sql(spark, sf_dir, text, "orders")))


def new_warehouse(spark: SparkSession) -> Warehouse:
    """A fresh one. The derived rows spread over years, so they are stored by month."""
    return Warehouse(passing_dir(spark, "warehouse"), "end_month", key_buckets=8)


def _stored(spark: SparkSession, warehouse: Warehouse) -> DataFrame:
    return flat(warehouse.entries(spark).select(*ENTRY_COLUMNS))


@register
def ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails as files: listed, fetched, unpacked, parsed, flattened, looked up, stored.

    Some keys begin with a dot or an underscore, or lie in folders that do.
    """
    warehouse = new_warehouse(spark)
    root = fm.mail_folder(spark, sf_dir, odd=True)
    backfill.ingest_batch(spark, root, warehouse, fl.lookups(spark, sf_dir))
    stored = _stored(spark, warehouse)
    return stored.withColumn("message_id", F.regexp_replace("message_id", fm.ODD_KEYS, ""))


@register
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older mails first, then all mails with each older one repeated: every mail is stored once."""
    warehouse = new_warehouse(spark)
    lookups = fl.lookups(spark, sf_dir)
    rows = fe.reported(spark, sf_dir)
    older = fm.wrap_mails(fm.report_xml(rows.filter(F.col("end_date") <= P.FIRST_RUN_END)))
    backfill.ingest_mails(spark, older, warehouse, lookups)
    everything = fm.wrap_mails(fm.report_xml(rows)).unionByName(older)
    backfill.ingest_mails(spark, everything, warehouse, lookups)
    return _stored(spark, warehouse)


@register
def ingest_known_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older mails first; then all mails, with lookup tables that no longer hold what the first batch asked for."""
    warehouse = new_warehouse(spark)
    lookups = fl.lookups(spark, sf_dir)
    rows = fe.reported(spark, sf_dir)
    older = fm.wrap_mails(fm.report_xml(rows.filter(F.col("end_date") <= P.FIRST_RUN_END)))
    backfill.ingest_mails(spark, older, warehouse, lookups)
    answered = warehouse.addresses(spark).select("source_ip", lookup_name(F.col("source_ip")).alias("query_name"))
    rest = backfill.Lookups(
        lookups.ip_txt.join(answered, "query_name", "left_anti"),
        lookups.ptr.join(answered, F.col("ip") == F.col("source_ip"), "left_anti"),
    )
    backfill.ingest_mails(spark, fm.wrap_mails(fm.report_xml(rows)), warehouse, rest)
    return _stored(spark, warehouse)


def _totalled(spark: SparkSession, sf_dir: str) -> Totalled:
    """All rows as two batches, of which the first was stored before with other rows."""
    warehouse = new_warehouse(spark)
    rows = keep(fe.entries(spark, sf_dir), "entries")
    older = F.col("end_date") <= P.FIRST_RUN_END
    for part, name in ((rows, "a"), (rows.filter(~older), "b"), (rows.filter(older), "a")):
        warehouse.write_entries(part, name)
    return warehouse.totalled(spark)


@register
def domain_stats_totalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totalled.domain_stats(_totalled(spark, sf_dir), P.NOW)


@register
def source_summary_totalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totalled.source_summary(_totalled(spark, sf_dir), P.ALL_TIME)


@register
def domain_totals_totalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totalled.domain_totals(_totalled(spark, sf_dir), P.ALL_TIME)


@register
def daily_chart_totalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totalled.daily_chart(_totalled(spark, sf_dir), P.ALL_TIME)


DAMAGE_CYCLE = 13


def _damaged_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = list(fm.BREAKAGES)
    number = F.pmod(F.substring_index("message_id", "-", -1).cast("bigint"), F.lit(DAMAGE_CYCLE))
    kind = F.get(F.array(*(F.lit(k) for k in kinds)), number.cast("int"))
    return fm.wrap_mails(fm.report_xml(fe.reported(spark, sf_dir)), kind)


@register
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of which most are broken in one of ten ways; the rest is stored."""
    warehouse = new_warehouse(spark)
    backfill.ingest_mails(
        spark, _damaged_mails(spark, sf_dir), warehouse, fl.lookups(spark, sf_dir)
    )
    stored = warehouse.entries(spark).groupBy("message_id").agg(F.lit("stored").alias("stage"))
    set_aside = warehouse.quarantine(spark).select(*QUARANTINE_SCHEMA.fieldNames()[:2])
    return set_aside.unionByName(stored)


@register
def stream_two_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own, over different notices, into one warehouse."""
    warehouse = new_warehouse(spark)
    for part in (0, 1):
        query = ingest_stream(
            spark, fn.notice_folder(spark, sf_dir, part=part), fm.mail_folder(spark, sf_dir), warehouse,
            fl.lookups(spark, sf_dir), passing_dir(spark, "progress"), files_per_batch=4,
        )
        query.awaitTermination()
    return _stored(spark, warehouse)


@register
def ingest_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mails in many small batches, folded together as they come."""
    warehouse = new_warehouse(spark)
    lookups = fl.lookups(spark, sf_dir)
    reports_xml = fm.report_xml(fe.reported(spark, sf_dir))
    number = F.pmod(F.substring_index("message_id", "-", -1).cast("bigint"), F.lit(5))
    for k in range(5):
        backfill.ingest_mails(spark, fm.wrap_mails(reports_xml.filter(number == k)), warehouse, lookups)
        warehouse.compact(spark, fan_in=2)
    return _stored(spark, warehouse)


@register
def notice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices printed over several lines, one document per file."""
    root = fn.document_folder(spark, sf_dir)
    keys = notified_keys(read_notices(spark, root, whole_files=True))
    return keys.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))


@register
def notice_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = notified_keys(parse_notices(fn.notice_texts(spark, sf_dir)))
    return keys.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))


@register
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in several micro-batches, with keys repeated within and across them."""
    warehouse = new_warehouse(spark)
    query = ingest_stream(
        spark,
        fn.notice_folder(spark, sf_dir),
        fm.mail_folder(spark, sf_dir),
        warehouse,
        fl.lookups(spark, sf_dir),
        passing_dir(spark, "progress"),
        files_per_batch=2,
    )
    query.awaitTermination()
    return _stored(spark, warehouse)


@register
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older mails first; then notices to a stream that keeps the keys it met, stopped after two batches and started again.

    Per key the records stored, and how often it was set aside; notices that cannot be read have no key.
    """
    warehouse = new_warehouse(spark)
    lookups = fl.lookups(spark, sf_dir)
    older = fe.reported(spark, sf_dir).filter(F.col("end_date") <= P.FIRST_RUN_END)
    backfill.ingest_mails(spark, fm.wrap_mails(fm.report_xml(older)), warehouse, lookups)
    notices, mails, progress = fn.notice_folder(spark, sf_dir), fm.mail_folder(spark, sf_dir), passing_dir(spark, "progress")
    for batches in (2, None):
        query = ingest_stream(
            spark, notices, mails, warehouse, lookups, progress, files_per_batch=1, compact_every=3, keep_state=True
        )
        stop_between_batches(query, lambda p, n=batches: n is not None and p.batchId + 1 >= n)
    stored = warehouse.entries(spark).select("message_id", F.lit(1).alias("stored"), F.lit(0).alias("aside"))
    aside = warehouse.quarantine(spark).select("message_id", F.lit(0).alias("stored"), F.lit(1).alias("aside"))
    sums = [F.sum(name).cast("bigint").alias(name) for name in ("stored", "aside")]
    return stored.unionByName(aside).groupBy("message_id").agg(*sums)
