"""Mixing, the pipeline and the registered queries."""

import collections
import inspect
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from checks.compare import oracle_rows
from mailverdict.llm import common, decontaminate, mixing, quality, secrets, simhash
from mailverdict.llm.queries import ORACLES, QUERIES


def slow_targets(sizes):
    """Share by weight, cap, share the excess again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, left, total = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * sizes[s]}
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}
        left -= above


def test_mix_meets_its_targets(make):
    rng = random.Random(4)
    rows = []
    for name, docs, most in (("a", 80, 60), ("b", 2, 5), ("B", 30, 400), ("ü", 50, 90), (None, 40, 30), ("z", 3, 0)):
        rows += [(len(rows) + k, "w " * rng.randint(0, most), "en", name) for k in range(docs)]
    rows += [(5, rows[5][1], "en", "a"), (None, None, "en", "a"), (None, "x y", "en", None), (9999, "y " * 3_000, "en", "B")]
    docs = make(rows).withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, n = defaultdict(int), lambda t: len((t or "").split())
    for r in rows:
        sizes[r[3]] += n(r[1])
    want = slow_targets(sizes)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken, smallest = defaultdict(int), {}
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        if r.doc_id is not None:
            name = source[r.doc_id]
            assert (r.source_size, r.target) == (sizes[name], pytest.approx(want[name]))
            taken[name] += r.taken
            smallest[name] = min(smallest.get(name, 1 << 60), r.size or 1 << 60)
    for name in sizes:
        assert abs(taken[name] - want[name]) <= 10, name
    again = mixing.mix(docs).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    assert mixing.mix(make([])).count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None, "en", "a"), (2, "", "en", "b")])).collect()] == [0, 0]


def test_stages_do_what_their_operators_say(spark):
    """Each stage against the decisions of its operator on the stage's own input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.scratch(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        kept[name] = docs, {r.doc_id: r.text for r in out.collect()}, out
        docs = out
    before, after, _ = kept["quality"]
    judged = quality.judge(before, labels).collect()
    assert set(after) == {r.doc_id for r in judged if r.keep}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert good <= set(after)
    before, after, _ = kept["near_duplicates"]
    assert set(after) == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after, _ = kept["decontamination"]
    assert set(after) == {r.doc_id for r in decontaminate.decontaminate(before, bench).collect() if not r.contaminated}
    before, after, _ = kept["secrets"]
    for r in secrets.scan_secrets(before).collect():
        assert ("[secret]" in after[r.doc_id]) == bool(r.sure or r.added)
    assert not any(re.search(r"[0-9a-f]{16}", t) for t in after.values())
    before, _, out = kept["mixing"]
    copies = collections.Counter(r.doc_id for r in out.collect())
    want = mixing.mix(before).collect()
    taken = sum(copies[r.doc_id] * r.size for r in want)
    assert taken == sum(r.taken for r in want) and max(copies.values()) <= 3


def test_pipeline_on_odd_tables(spark, make, tmp_path):
    folder = str(tmp_path)
    rows = [(1, "text " * 30), (1, "text " * 30), (None, None), (2, ""), (3, "token = 0123456789abcdef0123 " + "text " * 40), (None, "w " * 20_000)]
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == make([]).columns
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.scratch(stage(spark, docs, folder), "stage")
        assert docs.count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    table = QUERIES[name](spark, folder).toArrow()
    names = sorted(table.column_names)
    got = collections.Counter(zip(*(table.column(n).to_pylist() for n in names), strict=True))
    assert (names, got) == oracle_rows(folder, ORACLES[name])


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in driver.queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 14))
    assert list(inspect.signature(driver.queries()["pipeline"]).parameters) == ["spark", "sf_dir"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_mixture_keeps_all_columns_and_does_not_follow_files(spark, make):
    rows = [(i, f"w{i} " * (1 + i % 7), "en", "abc"[i % 3 % 2]) for i in range(60)]
    docs = make(rows).withColumn("_copy", F.col("doc_id") * 2).withColumn("row", F.lit("r"))
    one, two = (mixing.mixture(d) for d in (docs.repartition(1), docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert one.columns == docs.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert all(r._copy == 2 * r.doc_id for r in one.collect())


def test_documents_meet_row_numbers_by_one_plan_at_any_size(spark, make):
    """A small run must not broadcast what a large one has to shuffle, or its disk says nothing about the large one."""
    docs = make([(i, f"w{i} common words " * 30, "en", "ab"[i % 2]) for i in range(40)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, "w3 common words w3 common words w3 common words w3")], "item_id bigint, text string")
    for out in (quality.keep_good(docs, labels), simhash.keep_one(docs), decontaminate.keep_clean(docs, bench), mixing.mixture(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
        assert out.columns == docs.columns and out.count() > 0
