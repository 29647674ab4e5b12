"""Spark-native ingestion and analytics for DMARC aggregate reports."""

from mailverdict.functions.timerange import TimeRange, last_days, resolve_range
from mailverdict.plans.backfill import ingest_batch, ingest_keys, ingest_mails
from mailverdict.plans.reports import (
    daily_chart,
    daily_chart_long,
    domain_report,
    domain_stats,
    domain_totals,
    source_detail,
    source_summary,
)
from mailverdict.session import build_session, shared_dir
from mailverdict.sources.warehouse import Warehouse
from mailverdict.streaming.ingest import ingest_stream

__all__ = [
    "TimeRange",
    "Warehouse",
    "build_session",
    "daily_chart",
    "daily_chart_long",
    "domain_report",
    "domain_stats",
    "domain_totals",
    "ingest_batch",
    "ingest_keys",
    "ingest_mails",
    "ingest_stream",
    "last_days",
    "resolve_range",
    "shared_dir",
    "source_detail",
    "source_summary",
]
