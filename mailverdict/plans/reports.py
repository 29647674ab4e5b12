"""The four analytic queries over the fact table.

All take `entries` as a DataFrame and a resolved range. With `domain=None` they answer for every
domain at once, grouped by domain. Counts are sums, so Spark combines them before each shuffle and
a hot domain or sender costs no more than its partial sums.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.functions import verdicts
from mailverdict.functions.timerange import TimeRange, chart_range, epoch_date_text, last_days
from mailverdict.operators.calendar import LABEL_STEP, fill_days
from mailverdict.operators.filters import for_domain, from_source, in_range, in_whole_days
from mailverdict.operators.skew import cap_per_group
from mailverdict.schema import ARRAY_COLUMNS, DETAIL_KEYS, DETAIL_SEARCH_COLUMNS
from mailverdict.session import Stage, keep

# A summary of more than SOURCES_CAP sources is cut to SOURCES_KEPT; a drill-down
# shows DETAIL_CAP rows.
SOURCES_CAP = 1000
SOURCES_KEPT = 999
DETAIL_CAP = 2500


def domain_stats(entries: DataFrame, now: datetime) -> DataFrame:
    """Messages and passing messages per domain over the last 30 days, in domain order."""
    return domain_stats_between(entries, last_days(now))


def domain_stats_between(entries: DataFrame, span: TimeRange) -> DataFrame:
    return (
        in_range(entries, span)
        .groupBy("domain")
        .agg(
            F.sum("message_count").alias("total_count"),
            verdicts.count_where(verdicts.passes()).alias("pass_count"),
        )
        .orderBy("domain")
    )


def add_rating(stats: DataFrame) -> DataFrame:
    """Add the passing percentage and its band."""
    share = verdicts.passing_percentage(F.col("pass_count"), F.col("total_count"))
    return stats.withColumn("passing_percentage", share).withColumn(
        "band", verdicts.pass_band(F.col("passing_percentage"))
    )


def source_totals(
    entries: DataFrame, span: TimeRange, domain: str | None = None, include_host: bool = False
) -> DataFrame:
    """Alignment counts per domain and sender label, uncut.

    Equal labels of different kinds are one sender; it takes the most preferred kind among them.
    """
    label, rank = verdicts.source_label(include_host)
    return (
        for_domain(in_range(entries, span), domain)
        .withColumns({"source": label, "_rank": rank})
        .groupBy("domain", "source")
        .agg(*verdicts.alignment_counts(), F.min("_rank").alias("_rank"))
        .withColumn("source_type", verdicts.source_kind(F.col("_rank")))
        .drop("_rank")
    )


def source_summary(
    entries: DataFrame, span: TimeRange, domain: str | None = None, include_host: bool = False
) -> DataFrame:
    """Senders by volume. More than 1000 senders of a domain are cut to its first 999."""
    return cap_senders(source_totals(entries, span, domain, include_host))


def cap_senders(senders: DataFrame) -> DataFrame:
    order = [F.desc("total_count"), F.asc("source")]
    kept = cap_per_group(senders, "domain", order, ["source"], SOURCES_CAP, SOURCES_KEPT)
    return kept.orderBy("domain", *order)


def domain_totals(entries: DataFrame, span: TimeRange, domain: str | None = None) -> DataFrame:
    """Alignment counts per domain over all senders, also those beyond the cap."""
    return (
        for_domain(in_range(entries, span), domain)
        .groupBy("domain")
        .agg(*verdicts.alignment_counts())
        .withColumn("message_count", F.col("total_count"))
        .orderBy("domain")
    )


def report_parts(
    entries: DataFrame, span: TimeRange, domain: str | None = None, include_host: bool = False, stage: Stage = keep
) -> tuple[DataFrame, DataFrame]:
    """What `source_summary` and `domain_totals` give, from one pass over the facts.

    Every row counts for its sender and for its domain (grouping sets); both are combined before the one
    shuffle. The sums, one row per sender and domain, are staged, and both parts read them.
    """
    label, rank = verdicts.source_label(include_host)
    rows = for_domain(in_range(entries, span), domain).withColumns({"source": label, "_rank": rank})
    sums = rows.groupingSets([["domain", "source"], ["domain"]], "domain", "source").agg(
        *verdicts.alignment_counts(), F.min("_rank").alias("_rank"), F.grouping("source").alias("_all")
    )
    sums = stage(sums, "report")
    senders = sums.filter("_all = 0").withColumn("source_type", verdicts.source_kind(F.col("_rank"))).drop("_rank", "_all")
    totals = sums.filter("_all = 1").drop("_rank", "_all", "source").withColumn("message_count", F.col("total_count"))
    return cap_senders(senders), totals.orderBy("domain")


class DomainReport(NamedTuple):
    domain: str
    summary: DataFrame
    totals: DataFrame
    start_date: str
    end_date: str


def domain_report(entries: DataFrame, span: TimeRange, domain: str, stage: Stage = keep) -> DomainReport:
    """Everything the report of one domain shows."""
    return DomainReport(domain, *report_parts(entries, span, domain, stage=stage), span.start_text, span.end_text)


def _key_order() -> list[Column]:
    return [F.asc_nulls_first(name) for name in DETAIL_KEYS]


def source_detail(
    entries: DataFrame,
    span: TimeRange,
    domain: str | None,
    source: str = "",
    source_type: str = "",
    stage: Stage = keep,
) -> DataFrame:
    """The 2500 heaviest record groups of one sender of a domain; without a domain, of each domain.

    The cap reads the groups of all domains twice, so these are staged.
    """
    rows = from_source(for_domain(in_range(entries, span), domain), source, source_type)
    keys = DETAIL_KEYS if domain is not None else ["domain", *DETAIL_KEYS]
    order = [F.desc("message_count"), *_key_order()]
    groups = rows.groupBy(*keys).agg(F.sum("message_count").alias("message_count"))
    if domain is not None:
        return groups.orderBy(*order).limit(DETAIL_CAP)
    kept = cap_per_group(stage(groups, "groups"), "domain", order, DETAIL_KEYS, DETAIL_CAP, DETAIL_CAP)
    return kept.orderBy("domain", *order)


def search_detail(detail: DataFrame, query: str) -> DataFrame:
    """Rows of a drill-down that contain the query in any shown column."""
    return detail.filter(
        verdicts.matches_text(query, DETAIL_SEARCH_COLUMNS, set(ARRAY_COLUMNS))
    )


def detail_order_by_comment(descending: bool = False) -> list[Column]:
    """Order of a drill-down by override comment, the one column that can be sorted."""
    comment = F.array_join("po_comment", ",")
    return [comment.desc() if descending else comment.asc(), *_key_order()]


def daily_buckets(entries: DataFrame, span: TimeRange, domain: str | None = None) -> DataFrame:
    """Passing and failing messages per domain and day, days counted from 1 at the start."""
    # A range that ends a whole day or more before it starts has no bucket and matches no row.
    bucket = F.width_bucket(
        F.col("end_date"), F.lit(span.start), F.lit(span.bucket_end), F.lit(max(span.days, 1))
    )
    return (
        for_domain(in_whole_days(entries, span), domain)
        .groupBy("domain", bucket.alias("bucket"))
        .agg(
            verdicts.count_where(verdicts.passes()).alias("passing"),
            verdicts.count_where(verdicts.fails()).alias("failing"),
        )
    )


def daily_chart(
    entries: DataFrame,
    span: TimeRange,
    domain: str | None = None,
    label_step: int = LABEL_STEP,
    now: datetime | None = None,
) -> DataFrame:
    """Chart points `(domain, bucket, ts_ms, pass, fail)` without gaps.

    With `now`, a range that starts or ends at 0 stands for the last 30 days.

    `label_step=86400` labels each bucket with its true start instead.
    """
    if now is not None:
        span = chart_range(span.start, span.end, now)
    return fill_days(daily_buckets(entries, span, domain), span, label_step).orderBy(
        "domain", "bucket"
    )


def daily_chart_long(chart: DataFrame) -> DataFrame:
    """Chart points as two named series with calendar labels."""
    names = F.array(
        F.struct(F.lit("pass").alias("name"), F.col("pass").alias("value")),
        F.struct(F.lit("fail").alias("name"), F.col("fail").alias("value")),
    )
    return chart.select(
        "domain", "bucket", "ts_ms", F.explode(names).alias("series")
    ).select(
        "domain",
        F.col("series.name").alias("series"),
        "ts_ms",
        epoch_date_text(F.col("ts_ms") / 1000).alias("label_date"),
        F.col("series.value").alias("value"),
    )
