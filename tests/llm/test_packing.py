"""Packing along a space-filling curve."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailverdict.llm import packing, queries
from tests.llm.conftest import words

PATH = public_tokenizers.path("byte_bpe_50k.json")
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(pieces, docs, plain, size=packing.SIZE):
    """`docs` as (key, text) with different keys; `pieces` as rows of the query."""
    by_doc = {k: sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start) for k, _ in docs}
    assert sum(map(len, by_doc.values())) == len(pieces)
    for k, text in docs:
        ids, at = plain(text), 0
        for piece in by_doc[k]:
            assert piece.start == at and piece.length > 0 and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(np.array(ids[at : at + piece.length], "<u4").tobytes())
            at += piece.length
        assert at == len(ids)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert sorted(filled) == list(range(len(filled)))
    sizes = [filled[k] for k in sorted(filled)]
    whole = sum(sizes) // size
    assert sizes[:whole] == [size] * whole and all(n.bit_count() == 1 for n in sizes)
    assert sizes[whole:] == sorted(set(sizes[whole:]), reverse=True)


def test_query_packs_the_whole_small_table(spark, small_docs, plain):
    got = queries.QUERIES["op12_packing"](spark, "/root/testdata/sf0.001")
    assert got.columns == FIELDS and {t for _, t in got.dtypes} == {"bigint"}
    check(got.collect(), [(r.doc_id, r.text) for r in small_docs.collect()], plain)


def test_odd_rows(spark, make, plain):
    odd = ["", None, " ", "  a  b ", "a\n b \nc", "x <|endoftext|> y", "<|endoftext|>", "é à  ñ b　c", "\x1c a \x85 b", "'s don't", "🙂 🙂🙂 x"]
    texts = [*odd, "same words here " * 30, "same words here " * 30, "long " + words(60_000, 1)]
    docs = make(list(enumerate(texts))).withColumnRenamed("lang", "n").withColumnRenamed("source", "key")
    rows = packing.digest(packing.pack(docs, PATH)).collect()
    check(rows, list(enumerate(texts)), plain)
    twice = make([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])
    got = sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in packing.pack(twice, PATH, size=4).collect())
    assert sum(g[2] for g in got) == 3 + 3 + 2 + 1 and [g[3] for g in got if g[0] == "None" and g[1] == 0] == [1, 2]
    assert packing.pack(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab,.'s\n\t\x1c\x85  é1 🙂  "), max_size=30), min_size=1, max_size=6))
def test_ids_are_those_of_the_tokenizer(plain, texts):
    state = test_ids_are_those_of_the_tokenizer.__dict__.setdefault("state", {"json": open(PATH, encoding="utf-8").read()})
    ids, sizes = packing.token_ids(state, pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t)[:-1] for t in texts]


def test_curve_goes_from_neighbour_to_neighbour():
    points = np.array(list(itertools.product(range(8), repeat=4)))
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(8**4))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=12), st.sampled_from([1, 8, 16]))
def test_cuts_leave_no_padding(lengths, size):
    filled, at, total = {}, 0, sum(lengths)
    for length in lengths:
        pieces = packing.cuts(at, length, total, size)
        assert sum(p[0] for p in pieces) == length
        for taken, sequence, offset in pieces:
            assert taken > 0 and offset == filled.get(sequence, 0)
            filled[sequence] = offset + taken
        at += length
    assert all(n.bit_count() == 1 and n <= size for n in filled.values()) and sorted(filled) == list(range(len(filled)))


def test_neighbours_share_sequences(spark, make):
    """Documents of two vocabularies: most neighbours in a sequence are of one kind."""
    rows = [(k, words(60, k, 40).replace("w", "xyz"[k % 2])) for k in range(200)]
    pieces = packing.pack(make(rows), PATH, size=256).orderBy("sequence_id", "offset").collect()
    kinds = [p.doc_id % 2 for p in pieces if p.start == 0]
    assert sum(a == b for a, b in itertools.pairwise(kinds)) > 150


def test_copies_are_dealt_over_ranges(spark, make):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = make([(k, "one and the same text") for k in range(400)])
        pieces = packing.pack(docs, PATH, size=64)
        assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 64").isEmpty()
        places = spark.range(400).select(F.col("id").alias("row"), F.lit(9).cast("bigint").alias("n"), F.array(*[F.lit(5).cast("bigint")] * 4).alias("place"))
        assert packing.scratch(packing._in_order(places), "test").select("part").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
