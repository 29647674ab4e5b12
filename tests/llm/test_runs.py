"""Periodic runs of words."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailverdict.llm import queries, runs
from tests.llm.conftest import sha


def brute(words, shortest=6, repeats=4):
    """Runs by comparing all words with those a period on, for every period; multiples of a run's period drop out."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, found = np.array([names[w] for w in words], np.int64), {}
    for period in range(1, len(words) // repeats + 1):
        same = np.concatenate(([0], (ids[:-period] == ids[period:]).astype(np.int8), [0]))
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for start, end in zip(starts.tolist(), ends.tolist()):
            length = end - start + period
            if length >= max(shortest, repeats * period):
                found.setdefault((start, length), period)
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda run: (run[0], run[2]))


def expected(doc_id, text):
    """The row of the query, computed word by word."""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return doc_id, len(found), *row, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def key(row):
    return tuple(str(x) for x in row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(0, 60), st.integers(1, 7), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_trees_find_the_runs_of_brute_force(words, at, period, limits):
    words = words + [words[at + (i - at) % period] for i in range(len(words), len(words) + 20) if at + period <= len(words)]
    assert runs.runs_of(words, *limits) == brute(words, *limits)


def test_common_prefixes_of_suffixes():
    rng = random.Random(3)
    text = [rng.randrange(1, 4) for _ in range(200)] + [1] * 30
    tree = runs.SuffixTree(text)
    for a in range(0, len(text), 7):
        for b in range(0, len(text) + 1, 11):
            if a != b:
                want = next((k for k in range(len(text)) if max(a, b) + k == len(text) or text[a + k] != text[b + k]), 0)
                assert tree.common([a], [b])[0] == want
    assert [int(x) for x in tree.ranks[0].argsort()] == sorted(range(len(text) + 1), key=lambda i: text[i:])
    assert [int(x) for x in tree.ranks[1].argsort()] == sorted(range(len(text) + 1), key=lambda i: [-x for x in text[i:]])


def test_query_equals_brute_force_on_the_whole_small_table(spark, small_docs):
    got = queries.QUERIES["op11_runs"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=key) == sorted((expected(r.doc_id, r.text) for r in small_docs.collect()), key=key)
    assert sum(r[1] > 0 for r in rows) > 5


def test_odd_rows(spark, make):
    damaged = next(i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 10 == 0)
    said = "a b a b a b a b a b"
    rows = [
        (None, said), (None, said), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 5), (5, "x " * 6), (5, "x " * 6), (5, said),
        (6, "p p p p p p q q q q q q"), (7, " a b " * 9), (damaged, None), (damaged, "one"), (damaged, " ".join(f"w{i}" for i in range(40))),
        (8, "long " + "ab cd ef " * 30_000),
    ]
    docs = make(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "runs")
    got = [tuple(r) for r in runs.digest(runs.periodic_runs(runs.repeat_tails(docs))).collect()]
    small = [r for r in rows if r[0] != 8]
    assert sorted((r for r in got if r[0] != 8), key=key) == sorted((expected(*r) for r in small), key=key)
    assert [r[1:6] for r in got if r[0] == 8] == [(1, 1, 90_000, 3, 30_000_000)]
    assert runs.digest(runs.periodic_runs(runs.repeat_tails(docs.limit(0)))).count() == 0


@pytest.mark.parametrize("doc_id", [0, 17, 123456789])
def test_every_run_counts_and_ties_go_to_the_first(spark, make, doc_id):
    text = "u v " * 4 + "z " + "k l " * 4 + "end " + "m n o " * 5
    (row,) = runs.digest(runs.periodic_runs(make([(doc_id, text)]))).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 18, 15, 3, 5000)
    (row,) = runs.digest(runs.periodic_runs(make([(doc_id, text[: text.index("end")])]))).collect()
    assert (row.n_runs, row.start, row.exponent_milli) == (2, 0, 4000)
