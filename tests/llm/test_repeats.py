"""Repeated passages and suffix order against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from mailverdict.llm import repeats
from mailverdict.llm.suffixes import suffix_ranks


@pytest.mark.parametrize(("n", "symbols", "depth"), [(1, 2, 99), (2, 1, 99), (40, 2, 999), (400, 2, 20)])
def test_suffix_order(spark, n, symbols, depth):
    rng = random.Random(n)
    seq = [rng.randint(1, symbols) for _ in range(n)]
    ends = [i == n - 1 or rng.random() < 0.03 for i in range(n)]
    rows = [(i, seq[i], 1, ends[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "pos bigint, sym bigint, weight bigint, end boolean")

    def suffix(i):
        stop = next(j for j in range(i, n) if ends[j])
        return seq[i : min(stop + 1, i + depth)]

    order = [r.pos for r in suffix_ranks(df, depth).orderBy("rank", "pos").collect()]
    assert sorted(order) == list(range(n))
    assert [suffix(i) for i in order] == sorted(map(suffix, range(n)))


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(d, gone) if not x)).hexdigest()))
    return out


def check(df, direct=repeats.DIRECT):
    got = repeats.remove_repeats(df, direct=direct).collect()
    texts = [r.text for r in df.collect()]
    want = collections.Counter(zip([r.doc_id for r in df.collect()], brute(texts)))
    assert collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


@pytest.mark.parametrize("direct", [4096, 1])
def test_planted_repeats(make, direct):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd efgh") for _ in range(2400))
    texts = [base, base[100:900], base[:199], base[:200], "a" * 700, "ab" * 300, None, "", base[500:701] + "é" * 110]
    texts += [base[1000:1300] + base[2000:2300], "x" * 50 + base[1500:1650] + base[100:400]]
    for _ in range(10):
        near = list(base)
        for _ in range(rng.randint(1, 8)):
            near[rng.randrange(len(near))] = "#"
        texts.append("".join(near[rng.randrange(150) :]))
    rows = list(enumerate(texts)) + [(0, base), (None, base[300:800])]
    check(make(rows).withColumnRenamed("n_chars", "row"), direct)


def test_samples_stand_for_every_string():
    text = bytes(random.Random(1).choices(range(97, 101), k=3000))
    places, first, last = repeats.samples(text)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == list(range(len(text) - repeats.LENGTH + 1))
    assert all(0 <= p - b and p - a < repeats.WINDOW for p, a, b in zip(places, first, last))
    assert len(repeats.samples(b"x" * 199)[0]) == 0


def test_texts_longer_than_a_piece(monkeypatch):
    text = bytes(random.Random(2).choices(range(97, 123), k=5000))
    whole = repeats.samples(text)
    monkeypatch.setattr(repeats, "PIECE", 1024)
    cut = repeats.samples(text)
    assert set(whole[0]) == set(cut[0])
    assert sum(b - a + 1 for a, b in zip(cut[1], cut[2])) == len(text) - repeats.LENGTH + 1


def test_whole_table(small_docs):
    check(small_docs.limit(60))


def test_empty_table(make):
    assert repeats.remove_repeats(make([])).count() == 0


def test_equal_texts_enter_the_order_once(make, monkeypatch):
    rng = random.Random(5)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(2))
    asked = []
    monkeypatch.setattr(repeats, "suffix_ranks", lambda seq, depth: asked.append(seq.count()) or suffix_ranks(seq, depth))
    check(make([(k, t) for k, t in enumerate([one] * 6 + [two, "x" * 199, "x" * 199, None, None])]))
    assert asked == [0]
    check(make([(k, t) for k, t in enumerate([one] * 6 + [two + one[1000:2500], two[:700] * 2, two[:700] * 2])]))
    samples = len(repeats.samples(one.encode())[0])
    assert 0 < asked[1] < 2 * samples


def test_periodic_texts(make):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20)))
    plain = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3)]
    texts = []
    for unit in ["x", "the ", "reintion ", word(), "é", "abcab"]:
        for size in (150, 199, 200, 200 + len(unit) - 1, 200 + len(unit), 215, 400, 1500):
            text = (unit * size)[rng.randrange(len(unit)) :][:size]
            texts.append(rng.choice(plain)[: rng.choice([0, 90, 300])] + text + rng.choice(plain)[rng.choice([100, 399]) :])
    texts += [(word() + " ") * 30 + (word() + " ") * 30 + rng.choice(plain) for _ in range(10)]
    check(make(list(enumerate(texts))))


def test_periods_stay_out_of_the_order(make, monkeypatch):
    asked = []
    monkeypatch.setattr(repeats, "suffix_ranks", lambda seq, depth: asked.append(seq.count()) or suffix_ranks(seq, depth))
    texts = [f"{k} " + "the " * (300 + k) + "of " * (200 + k) + f"end {k}" for k in range(6)]
    check(make(list(enumerate(texts))))
    assert asked[0] < 300  # a sample every period would be 6 * 500


def test_samples_of_many_texts():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab c", k=rng.choice([0, 10, 199, 200, 700, 3000]))) + b"no " * rng.choice([0, 40, 200]) for _ in range(60)]
    for text, (places, firsts) in zip(texts, repeats.samples_of_many(texts)):
        assert [places.tolist(), firsts.tolist()] == [x.tolist() for x in repeats.samples(text)[:2]]


def test_a_sample_in_two_pieces_comes_once(monkeypatch):
    text = bytes(random.Random(2).choices(range(97, 123), k=5000))
    whole = [x.tolist() for x in repeats.samples(text)]
    monkeypatch.setattr(repeats, "PIECE", 500)
    assert [x.tolist() for x in repeats.samples(text)] == whole


def test_shared_offsets():
    rng = random.Random(9)
    sides = [(bytes(rng.choices(b"ab\0", k=140)), bytes(rng.choices(b"ab\0", k=200))) for _ in range(2)]
    rows = []
    for k in range(40):
        left, right = bytearray(rng.choice(sides)[0]), bytearray(rng.choice(sides)[1])
        left[rng.randrange(140)] = right[rng.randrange(200)] = 35
        low, high = sorted((rng.randint(0, 140), rng.randint(0, 140)))
        rows.append((k // 8, low, high, bytes(left[140 - high :] + right[: 200 - low])))
    strings = [{(c, a, x[high - a : high - a + 200]) for a in range(low, high + 1)} for c, low, high, x in rows]
    times = collections.Counter(s for held in strings for s in held)
    want = [sorted(a for c, a, x in held if times[c, a, x] > 1) for held in strings]
    got = repeats.shared_offsets(*(np.array(x) for x in list(zip(*rows))[:3]), [r[3] for r in rows])
    assert [np.flatnonzero(x).tolist() for x in got] == want
    assert any(want) and not all(want)
