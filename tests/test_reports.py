"""The analytic queries on hand-made rows, and their plans."""

from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import entries as fe
from mailverdict.functions import verdicts
from mailverdict.functions.timerange import TimeRange
from mailverdict.operators.enrich import count_addresses
from mailverdict.operators.filters import Key, for_domain, in_range, in_whole_days, page, page_after, search_domains
from mailverdict.plans import reports
from mailverdict.schema import ENTRY_COLUMNS, ENTRY_SCHEMA
from mailverdict.sources.warehouse import Warehouse

SPAN = TimeRange(1000, 2000)
BASE = {
    "text": "", "bigint": 0, "message_id": "m", "domain": "d", "end_date": 1500, "eval_dkim": "pass",
    "eval_spf": "pass", "message_count": 1, "source_ip": "192.0.2.1",
}


def rows(spark, *changes):
    def value(row, name, kind):
        if name in row:
            return row[name]
        return [] if kind.startswith("array") else BASE.get(name, 0 if kind == "bigint" else "")

    data = [
        tuple(value(c, f.name, f.dataType.simpleString()) for f in ENTRY_SCHEMA) for c in changes
    ]
    return spark.createDataFrame(data, ENTRY_SCHEMA)


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_both_ends_of_a_range_count(spark):
    df = rows(spark, *({"end_date": e, "message_count": e} for e in (999, 1000, 2000, 2001)))
    assert reports.domain_stats_between(df, SPAN).first().total_count == 3000


def test_domain_stats_is_in_domain_order_and_counts_from_now(spark):
    now = datetime(2024, 3, 31, 10, 0, 0, tzinfo=UTC)
    at = int(now.timestamp())
    df = rows(
        spark,
        {"domain": "b", "end_date": at, "message_count": 5, "eval_spf": "fail"},
        {"domain": "a", "end_date": at - 30 * 86400, "eval_dkim": "fail", "eval_spf": "fail"},
        {"domain": "a", "end_date": at - 30 * 86400 - 1},
        {"domain": "c", "end_date": at + 1},
    )
    assert dicts(reports.domain_stats(df, now)) == [
        {"domain": "a", "total_count": 1, "pass_count": 0},
        {"domain": "b", "total_count": 5, "pass_count": 5},
    ]


def test_source_ladder_and_alignment(spark):
    df = rows(
        spark,
        {"esp": "P", "source_domain": "s.example", "message_count": 1},
        {"esp": "P", "eval_spf": "fail", "message_count": 2},
        {"source_domain": "P", "eval_dkim": "fail", "message_count": 4},
        {"source_host": "h.example", "eval_dkim": "none", "eval_spf": "none", "message_count": 8},
        {"source_ip": None, "message_count": 16},
    )
    got = {r["source"]: r for r in dicts(reports.source_summary(df, SPAN, "d"))}
    assert set(got) == {"P", "192.0.2.1", ""}
    p = got["P"]
    assert (p["total_count"], p["pass_count"], p["source_type"]) == (7, 7, "ESP")
    assert (p["spf_aligned_count"], p["dkim_aligned_count"], p["fully_aligned_count"]) == (5, 3, 1)
    assert got["192.0.2.1"]["pass_count"] == 0
    assert got[""]["source_type"] == "SourceIP"
    by_host = {r["source"]: r["source_type"] for r in dicts(reports.source_summary(df, SPAN, "d", include_host=True))}
    assert by_host == {"P": "ESP", "h.example": "SourceHost", "": "SourceIP"}


@pytest.mark.parametrize(("n", "kept"), [(999, 999), (1000, 1000), (1001, 999), (1500, 999)])
def test_summary_cap(spark, n, kept):
    df = spark.range(n).select(
        *(
            F.concat(F.lit("s"), F.format_string("%05d", "id")).alias(f.name)
            if f.name == "esp"
            else F.lit(BASE.get(f.name)).cast(f.dataType).alias(f.name)
            for f in ENTRY_SCHEMA
        )
    )
    summary = reports.source_summary(df, SPAN, "d").collect()
    assert [r.source for r in summary] == [f"s{i:05}" for i in range(kept)]
    assert reports.domain_totals(df, SPAN, "d").first().total_count == n


def test_domain_report(spark):
    report = reports.domain_report(rows(spark, {}), TimeRange(0, 86400), "d")
    assert (report.start_date, report.end_date) == ("1970-01-01", "1970-01-02")
    assert report.summary.count() == report.totals.count() == 1
    assert report.totals.first().message_count == 1


def test_sources_add_up_to_the_totals(spark, small):
    df = fe.entries(spark, small)
    span = TimeRange(0, 2 * 10**9)
    sums = ["total_count", "pass_count", "spf_aligned_count", "dkim_aligned_count", "fully_aligned_count"]
    by_source = reports.source_totals(df, span).groupBy("domain").agg(*(F.sum(c).alias(c) for c in sums))
    totals = reports.domain_totals(df, span)
    assert by_source.select("domain", *sums).exceptAll(totals.select("domain", *sums)).isEmpty()
    chart = reports.daily_chart(df, TimeRange(780000000, 1009843199))
    volume = chart.groupBy("domain").agg(F.sum(F.col("pass") + F.col("fail")).alias("total_count"))
    assert volume.exceptAll(totals.select("domain", "total_count")).isEmpty()


def test_empty_domain_is_refused(spark):
    with pytest.raises(ValueError, match="domain"):
        for_domain(rows(spark, {}), "")


@pytest.mark.parametrize(
    ("source", "kind", "n"),
    [
        ("P", "ESP", 1), ("s", "SourceDomain", 1), ("h", "SourceHost", 1),
        ("2001:DB8::1", "SourceIP", 1), ("", "SourceIP", 0), ("no ip", "SourceIP", 0),
        ("P", "", 0), ("P", "esp", 0), ("X", "ESP", 0),
    ],
)
def test_detail_by_kind_of_source(spark, source, kind, n):
    df = rows(
        spark,
        {"esp": "P", "source_domain": "s", "source_host": "h", "source_ip": "2001:db8::1"},
        {"esp": "P", "source_domain": "s", "source_host": "h", "source_ip": "2001:db8::1"},
        {"source_ip": None},
    )
    got = dicts(reports.source_detail(df, SPAN, "d", source, kind))
    assert [r["message_count"] for r in got] == [2] * n
    assert all(len(r) == 21 for r in got)


def test_detail_groups_by_whole_lists(spark):
    df = rows(
        spark,
        {"esp": "P", "po_comment": ["a", "b"]},
        {"esp": "P", "po_comment": ["a,b"]},
        {"esp": "P", "po_comment": []},
        {"esp": "P", "po_comment": ["a", "b"], "message_count": 4},
    )
    got = [(r.message_count, r.po_comment) for r in reports.source_detail(df, SPAN, "d", "P", "ESP").collect()]
    assert got == [(5, ["a", "b"]), (1, []), (1, ["a,b"])]


def test_detail_search_and_pages(spark):
    df = rows(
        spark,
        {"esp": "P", "report_org_name": "Org", "message_count": 123},
        {"esp": "P", "auth_dkim_domain": ["x.example", "Y.example"]},
        {"esp": "P", "header_from": "org"},
    )
    detail = reports.source_detail(df, SPAN, "d", "P", "ESP")
    assert reports.search_detail(detail, "ORG").count() == 1
    assert reports.search_detail(detail, "e,y").count() == 1
    assert reports.search_detail(detail, "23").count() == 1
    assert reports.search_detail(detail, "").count() == 3
    assert page(detail, reports.detail_order_by_comment(), 0, 200).count() == 3
    assert page(detail, reports.detail_order_by_comment(), 1, 200).count() == 0
    for wrong in ((0, 10), (-1, 100)):
        with pytest.raises(ValueError, match="pages"):
            page(detail, ["message_count"], *wrong)


def test_domain_search(spark):
    df = spark.createDataFrame([("Mail.Example",), ("other",)], "domain string")
    assert [r.domain for r in search_domains(df, "mAIL").collect()] == ["Mail.Example"]
    assert search_domains(df, "").count() == 2
    assert search_domains(df, "_ail").count() == 0


def test_rating(spark):
    cases = [(0, 0, 0.0, "error"), (100, 99, 99.0, "success"), (1000, 989, 98.9, "warning"),
             (10, 9, 90.0, "warning"), (1000, 899, 89.9, "error"), (7, 7, 100.0, "success")]
    df = spark.createDataFrame([c[:2] for c in cases], "total_count bigint, pass_count bigint")
    got = [(r.total_count, r.pass_count, r.passing_percentage, r.band) for r in reports.add_rating(df).collect()]
    assert [g[3] for g in got] == [c[3] for c in cases]
    assert [g[2] for g in got] == pytest.approx([c[2] for c in cases])


def test_result_class(spark):
    cases = {None: "grey", "": "grey", "  ": "info", " PASS ": "success", "softfail": "error",
             "passfail": "success", "Neutral": "warning", "warning": "warning", "none": "info"}
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    assert {r.r: r.c for r in df.select("r", verdicts.result_class(F.col("r")).alias("c")).collect()} == cases


def test_normalise(spark):
    df = spark.createDataFrame([(None, None), ("a", 2)], "source string, total_count bigint")
    assert [tuple(r) for r in verdicts.normalise(df).collect()] == [("", 0), ("a", 2)]


def test_rows_without_a_verdict_neither_pass_nor_fail(spark):
    df = rows(spark, {"eval_dkim": None, "eval_spf": "fail"}, {"eval_dkim": "fail", "eval_spf": "fail"})
    row = reports.daily_buckets(df, SPAN).first()
    assert (row.passing, row.failing) == (0, 1)


def walk_days(counts: dict[int, int], span: TimeRange, step: int) -> list[tuple[int, int]]:
    """Day by day: first up to the last counted bucket, then on while labels are before the end."""
    if not counts:
        return []
    points, k = [], 1
    while k <= max(counts) or k * step + span.start < span.end:
        points.append(((k * step + span.start) * 1000, counts.get(k, 0)))
        k += 1
    return points


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    start=st.integers(0, 2 * 10**9),
    length=st.integers(-100_000, 40 * 86400),
    days=st.lists(st.integers(1, 45), max_size=6, unique=True),
    step=st.sampled_from([86000, 86400]),
)
def test_chart_equals_a_walk_over_the_days(spark, start, length, days, step):
    span = TimeRange(start, start + length)
    buckets = {d: d for d in days if d <= max(span.days, 0)}
    moments = [{"end_date": start + (d - 1) * 86400, "message_count": d} for d in buckets]
    df = rows(spark, *moments, {"domain": "outside", "end_date": span.bucket_end})
    chart = reports.daily_chart(df, span, "d", label_step=step)
    assert [(r.ts_ms, r["pass"]) for r in chart.collect()] == walk_days(buckets, span, step)


def test_long_chart_has_two_aligned_series(spark):
    df = rows(spark, {"end_date": 90000}, {"end_date": 0, "eval_dkim": "fail", "eval_spf": "fail"})
    chart = reports.daily_chart_long(reports.daily_chart(df, TimeRange(0, 86400 * 2), "d"))
    got = sorted((r.series, r.ts_ms, r.label_date, r.value) for r in chart.collect())
    assert got == [
        ("fail", 86000000, "1970-01-01", 1), ("fail", 172000000, "1970-01-02", 0),
        ("pass", 86000000, "1970-01-01", 0), ("pass", 172000000, "1970-01-02", 1),
    ]


# ---- plans over the stored table ----------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    tables = {}
    for period in ("end_day", "end_month"):
        warehouse = Warehouse(str(tmp_path_factory.mktemp(period)), period)
        part = fe.entries(spark, small).filter(F.col("end_date") < 797000000)
        warehouse.write_entries(part, "one")
        tables[period] = warehouse
    return tables


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("period", ["end_day", "end_month"])
def test_time_filters_prune_partitions_and_give_the_same_rows(spark, stored, period):
    df = stored[period].entries(spark)
    span = TimeRange(790000000 + 5000, 793000000)
    kept = in_range(df, span)
    assert f"{period}#" in plan(kept).split("PartitionFilters: [")[1].split("]")[0]
    plain = df.filter(F.col("end_date").between(span.start, span.end))
    assert kept.count() == plain.count() > 0
    days = in_whole_days(df, span)
    plain = df.filter((F.col("end_date") >= span.start) & (F.col("end_date") < span.bucket_end))
    assert days.count() == plain.count() > 0


def test_queries_read_only_their_columns_and_push_filters(spark, stored):
    df = stored["end_month"].entries(spark)
    text = plan(reports.domain_stats_between(for_domain(df, "d3.example.com"), SPAN))
    scan = text.split("== Physical Plan ==")[1]
    assert "EqualTo(domain,d3.example.com)" in scan
    assert "GreaterThanOrEqual(end_date,1000)" in scan
    schema = scan.split("ReadSchema: ")[1].split(">")[0]
    assert set(c.split(":")[0] for c in schema.removeprefix("struct<").split(",")) == {
        "domain", "eval_dkim", "eval_spf", "message_count", "end_date"}


def test_no_query_joins_everything_with_everything(spark, stored):
    df = stored["end_month"].entries(spark)
    for query in (
        reports.source_summary(df, SPAN),
        reports.domain_totals(df, SPAN),
        reports.source_detail(df, SPAN, "d", "P", "ESP"),
        reports.daily_chart(df, SPAN),
    ):
        text = plan(query)
        assert "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
    assert "TakeOrderedAndProject" in plan(reports.source_detail(df, SPAN, "d", "P", "ESP"))
    assert "WindowGroupLimit" in plan(reports.source_summary(df, SPAN))


def test_counting_addresses_reads_only_addresses(spark, tmp_path):
    names = ["message_id", "raw_ip", "error", "header_from"]
    path = str(tmp_path / "records")
    spark.createDataFrame([("m", "a", None, "h")], ", ".join(f"{n} string" for n in names)).write.parquet(path)
    records = spark.read.parquet(path).filter("error IS NULL").drop("error")
    scan = plan(count_addresses(records)).split("ReadSchema: ")[-1]
    assert scan.startswith("struct<raw_ip:string,error:string>")


def test_stored_rows_equal_written_rows(spark, small, stored):
    want = fe.entries(spark, small).filter(F.col("end_date") < 797000000).select(*ENTRY_COLUMNS)
    for warehouse in stored.values():
        got = warehouse.entries(spark).select(*ENTRY_COLUMNS)
        assert got.exceptAll(want).isEmpty()
        assert want.exceptAll(got).isEmpty()


def test_report_parts_scan_the_facts_once(spark, stored):
    df = stored["end_month"].entries(spark)
    seen = []
    staged = lambda part, label: seen.append(plan(part).split("== Physical Plan ==")[1]) or part
    span = TimeRange(780000000, 797000000)
    summary, totals = reports.report_parts(df, span, stage=staged)
    assert len(seen) == 1 and seen[0].count("FileScan") == 1 and "Expand" in seen[0] and seen[0].count("Exchange") == 1
    assert summary.collect() == reports.source_summary(df, span).select(summary.columns).collect()
    assert totals.select(sorted(totals.columns)).collect() == reports.domain_totals(df, span).select(sorted(totals.columns)).collect()
    whole = reports.domain_report(df, span, "d3.example.com")
    assert whole.totals.count() == 1 and whole.summary.count() == reports.source_summary(df, span, "d3.example.com").count() > 1


@pytest.mark.parametrize("order", [
    [Key("a"), Key("b", descending=True), Key("c")],
    [Key("a", descending=True, nulls_first=True), Key("l", nulls_first=False), Key("c")],
    [Key("b", nulls_first=False), Key("a", descending=True), Key("l", descending=True), Key("c", descending=True)],
])
def test_pages_behind_a_row_are_the_pages_by_number(spark, order):
    rows = [(k % 5 if k % 7 else None, "xyz"[k * 5 % 3] if k % 4 else None, [str(k % 2)] * (k % 3) if k % 6 else None, k) for k in range(430)]
    df = spark.createDataFrame(rows, "a int, b string, l array<string>, c bigint")
    last, number = None, 0
    while True:
        got = page_after(df, order, last, 100).collect()
        assert got == page(df, [k.order() for k in order], number, 100).collect()
        if not got:
            break
        last, number = got[-1], number + 1
    assert number == 5
    assert "TakeOrderedAndProject(limit=100" in plan(page_after(df, order, rows and df.first(), 100))
    with pytest.raises(ValueError, match="pages"):
        page_after(df, order, None, 7)
