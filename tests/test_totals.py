"""Day totals and the stored answers about addresses."""

from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import entries as fe
from mailverdict import Warehouse
from mailverdict.functions.timerange import DAY, TimeRange
from mailverdict.operators.enrich import address_table, count_addresses
from mailverdict.plans import reports, totalled
from mailverdict.plans.backfill import Lookups, known_answers
from mailverdict.schema import ENRICHED_COLUMNS
from mailverdict.session import drop_dir, staging

FIRST = 9131  # the day the derived rows begin, counted from 1970


@pytest.fixture(scope="module")
def rows(spark, small, tmp_path_factory):
    """Rows of sixty days that end at any second, some without an end, a verdict, a sender or a count."""
    number = F.xxhash64("message_id", "record_number")
    moment = FIRST * DAY + F.pmod(number, F.lit(60 * DAY))
    base = fe.entries(spark, small).limit(800).withColumns({
        "end_date": F.when(F.pmod(number, F.lit(97)) != 0, moment),
        "message_count": F.when(F.pmod(number, F.lit(89)) != 0, F.col("message_count")),
        "eval_spf": F.when(F.pmod(number, F.lit(83)) != 0, F.col("eval_spf")),
        "esp": F.when(F.pmod(number, F.lit(79)) != 0, F.col("esp")),
        "domain": F.when(F.pmod(number, F.lit(73)) != 0, F.col("domain")),
    })
    path = str(tmp_path_factory.mktemp("rows") / "rows")
    base.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def facts(spark, rows, tmp_path_factory):
    """Three batches: one run again with other rows, one whose totals were lost, one plain."""
    store = Warehouse(str(tmp_path_factory.mktemp("totals")), "end_month", key_buckets=2)
    of = F.pmod(F.hash("message_id"), F.lit(3))
    store.write_entries(rows, "b0")
    for k in range(3):
        store.write_entries(rows.filter(of == k), f"b{k}")
    drop_dir(spark, f"{store.path('totals')}/batch_id=b1")
    found = store.totalled(spark)
    assert 0 < found.untotalled.count() < found.entries.count() == rows.count()
    assert 0 < found.totals.count() < rows.count()
    return found


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def same(got, want):
    assert set(got.columns) == set(want.columns)
    names = sorted(want.columns)
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))


SECONDS = st.integers((FIRST - 2) * DAY, (FIRST + 62) * DAY)
MIDNIGHTS = st.integers(FIRST - 2, FIRST + 62).map(lambda d: d * DAY)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(start=st.one_of(SECONDS, MIDNIGHTS), end=st.one_of(SECONDS, MIDNIGHTS, MIDNIGHTS.map(lambda s: s - 1)))
def test_any_range_gives_the_rows_of_the_facts(rows, facts, start, end):
    span = TimeRange(start, end)
    same(totalled.source_summary(facts, span), reports.source_summary(rows, span))
    same(totalled.domain_stats_between(facts, span), reports.domain_stats_between(rows, span))
    same(totalled.daily_chart(facts, span), reports.daily_chart(rows, span))


def test_one_domain_and_edges_of_days(rows, facts):
    domain = rows.filter("domain IS NOT NULL").first().domain
    day = (FIRST + 20) * DAY
    for span in (TimeRange(day, day + DAY - 1), TimeRange(day, day + DAY), TimeRange(day - 1, day + 3 * DAY - 2),
                 TimeRange(day + 5, day + 9), TimeRange(day, day - 1), TimeRange(day, day - 2 * DAY)):
        same(totalled.domain_totals(facts, span, domain), reports.domain_totals(rows, span, domain))
        same(totalled.source_summary(facts, span, domain), reports.source_summary(rows, span, domain))
        same(totalled.daily_chart(facts, span, domain), reports.daily_chart(rows, span, domain))
    now = datetime.fromtimestamp(day + 4321, UTC)
    same(totalled.domain_stats(facts, now), reports.domain_stats(rows, now))
    same(totalled.daily_chart(facts, TimeRange(0, 0), now=now), reports.daily_chart(rows, TimeRange(0, 0), now=now))


def test_whole_days_read_no_facts(spark, rows, tmp_path):
    store = Warehouse(str(tmp_path / "w"), "end_day", key_buckets=2)
    store.write_entries(rows.coalesce(1), "one")
    facts = store.totalled(spark)
    span = TimeRange((FIRST + 1) * DAY, (FIRST + 50) * DAY - 1)
    for query in (totalled.source_summary(facts, span), totalled.daily_chart(facts, span)):
        text = plan(query)
        assert "/totals]" in text and "/entries]" not in text
    cut = totalled.domain_stats_between(facts, TimeRange(span.start + 1, span.end))
    text = plan(cut)
    assert text.count("/entries]") == 1 and "end_day" in text.split("PartitionFilters: [")[-1].split("]")[0]


def test_totals_follow_a_batch_through_rerun_and_compaction(spark, rows, tmp_path):
    store = Warehouse(str(tmp_path / "w"), "end_month", key_buckets=2)
    of = F.pmod(F.hash("message_id"), F.lit(4))
    span = TimeRange(FIRST * DAY, (FIRST + 60) * DAY - 1)
    for k in range(4):
        store.write_entries(rows.filter(of == k), f"b{k}")
    store.write_entries(rows.filter(of == 9), "b3")
    assert store.batches(spark, "totals") == store.batches(spark) == ["b0", "b1", "b2"]
    left = rows.filter(of < 3)
    same(totalled.source_summary(store.totalled(spark), span), reports.source_summary(left, span))
    assert store.compact(spark, 3) == 3
    assert store.batches(spark, "totals") == store.batches(spark) and len(store.batches(spark)) == 1
    same(totalled.source_summary(store.totalled(spark), span), reports.source_summary(left, span))
    drop_dir(spark, store.path("totals"))
    same(totalled.source_summary(store.totalled(spark), span), reports.source_summary(left, span))
    store.mend(spark)
    assert store.totalled(spark).untotalled.isEmpty()


def test_an_empty_warehouse(spark, tmp_path):
    facts = Warehouse(str(tmp_path / "none")).totalled(spark)
    span = TimeRange(0, 10 * DAY)
    assert totalled.source_summary(facts, span).isEmpty() and totalled.daily_chart(facts, span).isEmpty()


# ---- addresses ----------------------------------------------------------------------------------


def lookups_of(spark, names, **more):
    txt = spark.createDataFrame([], "query_name string, txt array<string>")
    return Lookups(txt, spark.createDataFrame(names, "ip string, names array<string>"), **more)


def asked(spark, *ips):
    return count_addresses(spark.createDataFrame([(ip,) for ip in ips], "raw_ip string"))


def test_known_addresses_are_not_looked_up_again(spark, tmp_path, monkeypatch):
    store = Warehouse(str(tmp_path / "w"), key_buckets=3)
    first = lookups_of(spark, [("2001:db8::1", ["a.example."]), ("2001:db8::2", ["b.example."])])
    with staging(spark, str(tmp_path / "s")) as stage:
        counts = asked(spark, "2001:db8::1", "2001:db8::1", "192.0.2.7", "unknown", None)
        got = {r.raw_ip: r for r in known_answers(stage, counts, store, first, "one").collect()}
        want = address_table(counts.filter("raw_ip IS NOT NULL"), first.ip_txt, first.ptr).select("raw_ip", *ENRICHED_COLUMNS)
        assert {ip: tuple(r)[:-1] for ip, r in got.items()} == {r.raw_ip: tuple(r) for r in want.collect()}
        later = lookups_of(spark, [("2001:db8::1", ["moved.example."]), ("2001:db8::2", ["b.example."])])
        counts = asked(spark, "2001:db8::1", "2001:db8::2", "unknown")
        got = {r.raw_ip: r.source_host for r in known_answers(stage, counts, store, later, "two").collect()}
        assert got["2001:db8::1"] == "a.example" and got["2001:db8::2"] == "b.example"
        unread = Lookups(None, None)  # tables that cannot be read
        got = known_answers(stage, counts, store, unread, "three")
        assert got.count() == 3
        assert store.addresses(spark).count() == 4


def test_old_answers_are_asked_for_again(spark, tmp_path):
    store = Warehouse(str(tmp_path / "w"), key_buckets=3)
    today = datetime.now(UTC).date()
    for age, host in ((40, "oldest"), (20, "older")):
        old = lookups_of(spark, [("2001:db8::1", [f"{host}.example."])])
        answers = address_table(asked(spark, "2001:db8::1"), old.ip_txt, old.ptr)
        store.add_addresses(answers, f"b{age}", today - timedelta(days=age))
    new = [("2001:db8::1", ["new.example."])]
    with staging(spark, str(tmp_path / "s")) as stage:
        counts = asked(spark, "2001:db8::1")
        for days, host in ((30, "older.example"), (None, "older.example"), (10, "new.example"), (None, "new.example")):
            got = known_answers(stage, counts, store, lookups_of(spark, new, valid_days=days), "c").collect()
            assert [r.source_host for r in got] == [host]


def test_stored_answers_are_joined_where_they_lie(spark, tmp_path):
    store = Warehouse(str(tmp_path / "w"), key_buckets=3)
    names = lookups_of(spark, [])
    store.add_addresses(address_table(asked(spark, "192.0.2.1", "192.0.2.2"), names.ip_txt, names.ptr), "one")
    asked(spark, "192.0.2.2", "192.0.2.3", None).write.parquet(str(tmp_path / "counts"))
    unseen = store.unseen_addresses(spark, spark.read.parquet(str(tmp_path / "counts")))
    text = plan(unseen)
    stored = text[text.index("SortMergeJoin") :].rsplit("+- Sort", 1)[1]
    assert "spark_catalog" in stored and "Exchange" not in stored and "raw_ip" in stored
    assert [r.raw_ip for r in unseen.collect()] == ["192.0.2.3"]
