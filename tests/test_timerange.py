from datetime import UTC, date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailverdict.functions import timerange as tr

NOW = datetime(2024, 3, 31, 10, 20, 30, tzinfo=UTC)
NOW_S = 1711880430

TEXTS = {
    "2024-03-01": (1709251200, 1709337599),
    "2024-02-29": (1709164800, 1709251199),
    "2023-02-29": (None, None),
    "2024-03-01T05:06:07Z": (1709269567, 1709269567),
    "2024-03-01T05:06:07.999999999Z": (1709269567, 1709269567),
    "2024-03-01T05:06:07+02:00": (1709262367, 1709262367),
    "2024-03-01T05:06:07-05:30": (1709289367, 1709289367),
    "1969-12-31T23:59:59.5Z": (-1, -1),
    "2024-03-01T24:00:00Z": (None, None),
    "2024-03-01T10:60:00Z": (None, None),
    "2024-03-01T05:06:07": (None, None),
    "2024-03-01T05:06:07z": (None, None),
    "2024-3-1": (None, None),
    "2024-03-01 05:06:07Z": (None, None),
    "yesterday": (None, None),
    "": (None, None),
}


@pytest.mark.parametrize("text", TEXTS)
def test_date_input(text):
    assert (tr.parse_date_input(text, False), tr.parse_date_input(text, True)) == TEXTS[text]


def test_date_input_column_agrees(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    rows = df.select(
        "t",
        tr.date_input_column(F.col("t"), False).alias("s"),
        tr.date_input_column(F.col("t"), True).alias("e"),
    ).collect()
    assert {r.t: (r.s, r.e) for r in rows if r.t is not None} == TEXTS
    assert [(r.s, r.e) for r in rows if r.t is None] == [(None, None)]


def test_range_defaults():
    midnight = NOW_S - NOW_S % 86400 - 30 * 86400
    assert tr.resolve_range(None, None, NOW) == tr.TimeRange(midnight, NOW_S)
    assert tr.resolve_range("", "nonsense", NOW) == tr.TimeRange(midnight, NOW_S)
    assert tr.last_days(NOW) == tr.TimeRange(NOW_S - 30 * 86400, NOW_S)


def test_end_is_capped_and_start_is_not():
    assert tr.resolve_range("2030-01-01", "2031-01-01", NOW) == tr.TimeRange(1893456000, NOW_S)
    assert tr.resolve_range("2024-03-01", "2024-03-31", NOW) == tr.TimeRange(1709251200, NOW_S)
    assert tr.resolve_range("2024-03-01", "2024-03-02", NOW) == tr.TimeRange(1709251200, 1709423999)


def test_chart_range_without_ends():
    assert tr.chart_range(0, 5, NOW) == tr.last_days(NOW)
    assert tr.chart_range(5, 0, NOW) == tr.last_days(NOW)
    assert tr.chart_range(5, 9, NOW) == tr.TimeRange(5, 9)


def test_bucket_geometry_cuts_toward_zero():
    assert tr.TimeRange(0, 86399).days == 1
    assert tr.TimeRange(0, 86400).days == 2
    assert tr.TimeRange(100, 50).days == 1
    assert tr.TimeRange(86400, 0).days == 0
    assert tr.TimeRange(10, 10 + 3 * 86400).bucket_end == 10 + 4 * 86400


def test_presets():
    assert tr.presets(date(2024, 3, 31)) == {
        "Last 7 days": (date(2024, 3, 24), date(2024, 3, 31)),
        "Last 30 days": (date(2024, 3, 1), date(2024, 3, 31)),
        "This month": (date(2024, 3, 1), date(2024, 3, 31)),
        "Last month": (date(2024, 2, 1), date(2024, 2, 29)),
    }
    assert tr.presets(date(2024, 1, 1))["Last month"] == (date(2023, 12, 1), date(2023, 12, 31))
    assert tr.is_valid_range(date(2024, 1, 1), date(2024, 1, 1))
    assert not tr.is_valid_range(date(2024, 1, 2), date(2024, 1, 1))
    assert not tr.is_valid_range(None, date(2024, 1, 1))


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**9), 4 * 10**9))
def test_epoch_text(seconds):
    moment = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)
    assert tr.epoch_text(seconds) == moment.date().isoformat()


def test_days_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(-1,), (0,), (86399,), (86400,), (1709251199,)], "s bigint")
        row = df.select(
            F.collect_list(tr.epoch_date_text(F.col("s"))).alias("d"),
            F.collect_list(tr.epoch_month(F.col("s")).cast("string")).alias("m"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(row.d) == ["1969-12-31", "1970-01-01", "1970-01-01", "1970-01-02", "2024-02-29"]
    assert sorted(row.m) == ["1969-12-01", "1970-01-01", "1970-01-01", "1970-01-01", "2024-02-01"]
