"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from mailverdict.llm import components, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, distance=3):
    """Smallest key reachable, by comparing all pairs."""
    names = dict(enumerate(range(len(values))))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = names[i], names[j]
                names = {k: min(a, b) if v in (a, b) else v for k, v in names.items()}
    return [names[i] for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "É é x", "one two three", "a\x0bb\tc d e f", "x " * 70000, "Ünï \U0001f600 ok go"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_masks_leave_equal_bits_for_close_values():
    masks, rng = simhash.block_masks(list(range(64))), random.Random(1)
    assert len(masks) == 20
    for _ in range(300):
        x, flips = rng.getrandbits(64), rng.sample(range(64), 3)
        y = x ^ sum(1 << b for b in flips)
        assert any((x ^ y) & m == 0 for m in masks)


def test_forest_links_without_all_pairs():
    values = np.array([0, 1, 3, 7, 1 << 40, (1 << 40) + 1, -1], np.int64)
    links = simhash.forest(values)
    assert len(links) == 5 and all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in links)


@pytest.mark.parametrize("direct", [4096, 2])
def test_links_join_the_same_components_as_all_pairs(spark, direct):
    rng = random.Random(direct)
    values = {rng.getrandbits(64) for _ in range(40)}
    for x in list(values)[:8]:
        for _ in range(12):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(x)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    roots = {r.node: r.root for r in components.components(simhash.near_links(df, direct=direct)).collect()}
    want = slow_components([v % (1 << 64) for v in values])
    assert [roots.get(v, v) for v in values] == [values[k] for k in want]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (7, None), (101, 100)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(21)}, **{k: 100 for k in range(100, 140)}}
    assert len(found) == 61


def test_near_duplicates_of_whole_texts(spark, small_docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(small_docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect())
    marks = [slow_fingerprint(t) for _, t in rows]
    want = slow_components(marks)
    assert [got[d].fingerprint % (1 << 64) for d, _ in rows] == marks
    assert [got[d].component_id for d, _ in rows] == [rows[k][0] for k in want]


def test_odd_rows(make):
    text = "some words that are all the same in both rows"
    rows = [(3, text), (1, text), (1, text), (None, text), (7, None), (8, ""), (9, "x " * 30000), (None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make(rows)).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (None, 1), (7, 7), (8, 7), (None, 7), (9, 9)], key=str)
    kept = simhash.keep_one(make(rows).withColumnRenamed("n_chars", "fingerprint"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "fingerprint"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]
    assert simhash.near_duplicates(make([])).count() == simhash.keep_one(make([])).count() == 0


def test_one_row_of_each_group_stays(make):
    a, b, c = "one text of a few words", "quite another text with words", "and a third that is unlike both"
    rows = [(None, a), (None, a), (5, b), (None, b), (7, c), (7, "yet something else, under a used key")]
    kept = simhash.keep_one(make(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, a), (5, b), (7, c), rows[5]], key=str)
