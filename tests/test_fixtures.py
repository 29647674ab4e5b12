"""Inputs of the registered queries: the same rows as their SQL, with little to shuffle."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from checks import params as P
from fixtures import entries as fe
from fixtures import mails as fm
from mailverdict import session
from mailverdict.operators.flatten import flatten_reports
from mailverdict.plans import reports
from mailverdict.plans.backfill import _pick_mails
from mailverdict.session import staging
from mailverdict.sources.reports import parse_reports

T = datetime.datetime(1997, 5, 4)

TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        [
            (o, p, s, n, 3.0, 10.5 * p, 0.04, 0.07 if p else None, flag, "O", T)
            for o in (1, 2, 3, None, 9) for p, s, n, flag in ((1, 9, 1, "R"), (1, 9, 1, "R"), (2, 49, 5, "A"), (3, None, 2, "N"), (4, 8, None, None), (5, 77, 1, "R"))
        ],
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        [(1, 21, "F", 1.0, T, "1"), (2, 22, "P", 1.0, T, "1"), (2, 22, None, 1.0, T, "1"), (3, None, "O", 1.0, T, "1"), (None, 21, "O", 1.0, T, "1"), (4, 21, "O", 1.0, T, "1")],
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(21, "a", 1, 1.0, "BUILDING"), (22, "b", 1, 1.0, None), (None, "c", 1, 1.0, "x")],
    ),
    "supplier": (
        "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        [(9, "a", 0, 1.0), (49, "b", 1, 1.0), (8, "c", None, 1.0), (8, "d", 2, 1.0), (None, "e", 3, 1.0)],
    ),
}


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Null keys, keys that come twice, keys without a partner."""
    root = str(tmp_path_factory.mktemp("odd"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture
def all_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("looked_up", [False, True])
def test_entries_are_those_of_their_sql(spark, odd_tables, looked_up):
    """Of rows that nothing but their supplier or order tells apart either may come first."""
    names = ("lineitem", "orders", "customer", "supplier")
    want = fe.run_sql(spark, odd_tables, fe.entries_sql(fe.SPARK, looked_up), *names)
    got = fe.entries(spark, odd_tables, looked_up)
    assert got.schema == want.schema
    for drop in ("record_number", "country policy subdomain_policy"):
        rows = (df.drop(*drop.split()).collect() for df in (got, want))
        found, wanted = (sorted(map(str, x)) for x in rows)
        assert found == wanted and len(found) > 5


def test_entries_are_worked_out_behind_the_shuffles(spark, odd_tables, all_shuffled):
    shuffled = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(fe.entries(spark, odd_tables)))
    assert sorted(shuffled) == ["c_custkey", "l_orderkey", "l_suppkey", "o_custkey", "o_orderkey", "s_suppkey"]


def test_reports_are_grouped_where_their_rows_lie(spark, odd_tables, all_shuffled):
    text = plan(fm.report_xml(fe.reported(spark, odd_tables)))
    assert "message_id" not in "".join(re.findall(r"Exchange hashpartitioning\(.*", text))
    assert len(re.findall("Exchange hashpartitioning", text)) == 6


def test_reports_grouped_by_order_are_those_grouped_by_key(spark, odd_tables):
    # numbers of rows that only their supplier or order tells apart are free, so that the least of each stands
    rows = fe.reported(spark, odd_tables).dropDuplicates(["message_id", "record_number"])
    rows = rows.localCheckpoint()
    by_order, by_key = (fm.report_xml(df).orderBy("message_id").collect() for df in (rows, rows.drop(fe.ORDER_KEY)))
    assert by_order == by_key and len(by_key) > 1


def test_contents_are_made_only_where_they_are_read(spark, odd_tables):
    mails = fm.wrap_mails(fm.report_xml(fe.reported(spark, odd_tables)))
    assert "_wrapped" in plan(mails)
    assert "_wrapped" not in plan(mails.groupBy("message_id").count()) and "InArrow" not in plan(mails.select("message_id"))


def test_nothing_is_picked_where_every_mail_is_wanted(spark, tmp_path):
    mails = spark.createDataFrame([("a", b"1"), ("b", b"2"), (None, b"3")], "message_id string, content binary")
    held = mails.groupBy("message_id").agg(F.count(F.lit(1)).alias("copies"))
    with staging(spark, str(tmp_path)) as stage:
        picked = _pick_mails(mails, held, held.filter("message_id IS NOT NULL"), stage)
        assert "Join" not in plan(picked)
        assert sorted(r.message_id for r in picked.collect()) == ["a", "b"]


def test_records_do_not_carry_all_records(spark):
    nothing = F.lit(None).cast("string")
    mails = spark.createDataFrame([("a", "<feedback/>")], "message_id string, xml string").withColumns({"stage": nothing, "error": nothing})
    (repeated,) = re.findall(r"Generate posexplode\(.*?\), \[(.*?)\]", plan(flatten_reports(parse_reports(mails))))
    assert "record" not in repeated and "report#" not in repeated


def test_shuffle_files_go_once_a_large_table_is_written(spark, tmp_path, monkeypatch):
    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))

    monkeypatch.setattr(session, "LARGE_BYTES", 1)
    with staging(spark, str(tmp_path)) as stage:
        before = shuffles()
        stage(spark.range(1000).repartition(40, "id").groupBy("id").count(), "numbers")
        for _ in range(50):
            if shuffles() <= before:
                return
            time.sleep(0.2)
    raise AssertionError("shuffle files stay")


def test_groups_of_all_domains_are_made_once(spark, odd_tables):
    made = []
    rows = fe.entries(spark, odd_tables).withColumn("esp", F.lit("all"))
    found = reports.source_detail(rows, P.ALL_TIME, None, "all", "ESP", stage=lambda df, label: made.append(label) or session.keep(df, label))
    assert made == ["groups"] and "lineitem" not in plan(found)
    want = sum(r.message_count for r in rows.collect())
    assert sum(r.message_count for r in found.collect()) == want > 0
