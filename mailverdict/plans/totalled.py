"""The analytic queries over a warehouse that keeps day totals.

They take what `Warehouse.totalled` gives and return the rows their namesakes in `plans.reports` return. Of the
facts they read the two cut days of a range, however long it is.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailverdict.functions import verdicts
from mailverdict.functions.timerange import DAY, TimeRange, chart_range, last_days
from mailverdict.operators.calendar import LABEL_STEP, fill_days
from mailverdict.operators.totals import SUMS, Totalled, between, between_days, summed
from mailverdict.plans import reports


def domain_stats(facts: Totalled, now: datetime) -> DataFrame:
    return domain_stats_between(facts, last_days(now))


def domain_stats_between(facts: Totalled, span: TimeRange) -> DataFrame:
    sums = summed(between(facts, span), "domain")
    return sums.select("domain", "total_count", "pass_count").orderBy("domain")


def source_summary(facts: Totalled, span: TimeRange, domain: str | None = None) -> DataFrame:
    senders = (
        between(facts, span, domain)
        .groupBy("domain", "source")
        .agg(*(F.sum(name).alias(name) for name in SUMS if name != "fail_count"), F.min("source_rank").alias("_rank"))
        .withColumn("source_type", verdicts.source_kind(F.col("_rank")))
        .drop("_rank")
    )
    return reports.cap_senders(senders)


def domain_totals(facts: Totalled, span: TimeRange, domain: str | None = None) -> DataFrame:
    sums = summed(between(facts, span, domain), "domain").drop("fail_count")
    return sums.withColumn("message_count", F.col("total_count")).orderBy("domain")


def daily_buckets(facts: Totalled, span: TimeRange, domain: str | None = None) -> DataFrame:
    """Buckets are counted from the start of the range: where that is not midnight every bucket cuts two days,
    and all of them come from the rows."""
    if span.start % DAY or span.days < 1:
        return reports.daily_buckets(facts.entries, span, domain)
    first = span.start // DAY
    bucket = (F.unix_date("day") - first + 1).cast("bigint").alias("bucket")
    sums = summed(between_days(facts, first, first + span.days - 1, domain), "domain", bucket)
    return sums.select("domain", "bucket", F.col("pass_count").alias("passing"), F.col("fail_count").alias("failing"))


def daily_chart(
    facts: Totalled,
    span: TimeRange,
    domain: str | None = None,
    label_step: int = LABEL_STEP,
    now: datetime | None = None,
) -> DataFrame:
    if now is not None:
        span = chart_range(span.start, span.end, now)
    return fill_days(daily_buckets(facts, span, domain), span, label_step).orderBy("domain", "bucket")
