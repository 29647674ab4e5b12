"""Benchmark decontamination over a positional inverted index of the training tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import ascii_lower, bound, met, scratch

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SLOP = 3
MARKS = 1 << 17  # bytes of the table that tells which terms to index; a fixed size, whatever the data


def terms(text: Column) -> Column:
    """Words in lower case: runs of a-z, digits and anything beyond ASCII."""
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(MARKS)).cast("int")


def _marked(found: DataFrame):
    """A test on terms that holds for every term of `found`, and by chance for a few others.

    The table behind it has one byte per hash slot. It is gathered as one 64-bit group per slot range,
    so the driver never holds more than `MARKS` slots.
    """
    slots = found.select(_slot(F.col("term")).alias("s")).select(
        F.col("s").bitwiseAND(63).alias("bit"), F.shiftright("s", 6).alias("group")
    )
    rows = slots.groupBy("group").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
    table = bytearray(MARKS)
    for group, bits in rows.collect():
        for bit in range(64):
            if bits >> bit & 1:
                table[group * 64 + bit] = 1
    marks = F.lit(bytes(table))
    return lambda term: F.substring(marks, _slot(term) + 1, F.lit(1)) == F.lit(b"\x01")


def test_terms(benchmark: DataFrame) -> DataFrame:
    """Items as `(item, terms, n)`, without those that have no word. A null id counts as an empty one."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(item, terms(F.col("text")).alias("terms")).distinct()
    return rows.withColumn("n", F.size("terms")).filter("n > 0")


def rarest_pairs(items: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each window of an item the places of its rarest and second rarest term in the documents.

    `(anchor, item, terms, n, q1, t1, q2, t2)`, equal pairs once; `q2` and `t2` are null for windows of
    one word. The terms are counted over all documents, combined on the map side.
    """
    placed = items.select("item", "terms", "n", F.posexplode("terms").alias("q", "term"))
    known = _marked(placed.select("term").distinct())
    counted = (
        docs.select(F.explode(terms(F.col("text"))).alias("term")).filter(known(F.col("term")))
        .groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    )
    rated = placed.join(counted, "term", "left").select(
        "item", "terms", "n", F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "q", F.col("term").alias("t")).alias("r")
    )
    listed = rated.groupBy("item", "terms", "n").agg(F.array_sort(F.collect_list("r"), lambda a, b: a["q"] - b["q"]).alias("rs"))
    span = F.least("n", F.lit(window))
    starts = F.sequence(F.lit(1), F.col("n") - span + 1)
    picked = F.transform(starts, lambda s: F.slice(F.array_sort(F.slice("rs", s, span)), 1, 2))
    pair = F.col("pair")
    chosen = (
        listed.select("item", "terms", "n", F.explode(picked).alias("pair"))
        .select(
            "item", "terms", "n", F.get(pair, F.lit(0))["q"].alias("q1"), F.get(pair, F.lit(0))["t"].alias("t1"),
            F.get(pair, F.lit(1))["q"].alias("q2"), F.get(pair, F.lit(1))["t"].alias("t2"),
        ).distinct()
    )
    return scratch(chosen.withColumn("anchor", F.monotonically_increasing_id()), "anchors")


def positional_index(docs: DataFrame, key: str, anchors: DataFrame, window: int = WINDOW) -> DataFrame:
    """The stored index: per document row its key, word count and postings of the terms looked for.

    A posting is `(term, pos, around)`; `around`, the words up to `window - 1` to either side, is the
    payload against which whole phrases are compared. Postings lie with their document, so building the
    index moves nothing between machines; readers explode them and deal them out by term.
    """
    first = _marked(anchors.select(F.col("t1").alias("term")))
    second = _marked(anchors.select(F.col("t2").alias("term")).filter("term IS NOT NULL"))
    reach = window - 1

    def postings(w: Column) -> Column:
        seen = F.transform(w, lambda x, i: F.struct(x.alias("term"), i.alias("pos"), first(x).alias("lead")))
        return F.transform(
            F.filter(seen, lambda p: p["lead"] | second(p["term"])),
            lambda p: F.struct(
                p["term"].alias("term"), p["pos"].alias("pos"),
                F.when(p["lead"], F.slice(w, F.greatest(p["pos"] - reach, F.lit(0)) + 1, 2 * reach + 1)).alias("around"),
            ),
        )

    indexed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.inline(
            bound(terms(F.col("text")), lambda w: F.array(F.struct(F.size(w).cast("bigint").alias("n_words"), postings(w).alias("postings"))))
        ),
    )
    return scratch(indexed, "index")


def _reach(side: int, around: Column, pos: Column, items: Column, q: Column, window: int) -> Column:
    """How many words in a row agree to the left (-1) or right (1) of a posting, `window - 1` at most."""
    begin = F.greatest(pos - (window - 1), F.lit(0))
    same = F.transform(
        F.sequence(F.lit(1), F.lit(window)),
        lambda d: F.when(d < window, F.get(around, pos + d * side - begin) == F.get(items, q + d * side)),
    )
    return (F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False) - 1).cast("int")


def matches(index: DataFrame, anchors: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """`(row, item, kind, first, last)`: word ranges of documents that match benchmark items.

    The list of each window's rarest term, moved back by the term's place in the item, is intersected
    with that of the second rarest on document and start. What is left is compared word by word:
    `phrase` is a run of equal words that covers a whole window; `proximity` is a pair of the two
    rarest terms whose distance is off by 1 to `slop` words.
    """
    posts = index.select("row", F.inline("postings"))
    lead = anchors.join(posts.filter("around IS NOT NULL"), F.col("t1") == F.col("term"))
    lead = lead.select("anchor", "item", "terms", "n", "q1", "q2", "row", "pos", "around", (F.col("pos") - F.col("q1")).alias("start"))
    other = anchors.filter("q2 IS NOT NULL").join(posts, F.col("t2") == F.col("term"))
    other = other.select("anchor", "row", (F.col("pos") - F.col("q2")).alias("start"))
    both = lead.filter("q2 IS NOT NULL").join(other, ["anchor", "row", "start"], "left_semi")
    single = lead.filter("q2 IS NULL").select(*both.columns)
    span = F.least("n", F.lit(window))
    sides = [_reach(s, F.col("around"), F.col("pos"), F.col("terms"), F.col("q1"), window) for s in (-1, 1)]
    phrases = (
        both.union(single).withColumn("before", sides[0]).withColumn("after", sides[1])
        .filter(F.col("before") + F.col("after") + 1 >= span)
        .select("row", "item", F.lit("phrase").alias("kind"), (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("after")).alias("last"))
    )
    if not slop:
        return phrases
    # the other list once per shift, so that near pairs also meet in an equi-join
    shifts = F.explode(F.array(*(F.lit(k) for k in range(-slop, slop + 1) if k)))
    moved = other.select("anchor", "row", "start", shifts.alias("shift")).select(
        "anchor", "row", (F.col("start") + F.col("shift")).alias("start"), "shift"
    )
    second = F.col("pos") + F.col("q2") - F.col("q1") - F.col("shift")
    near = lead.filter("q2 IS NOT NULL").join(moved, ["anchor", "row", "start"]).filter(second != F.col("pos"))
    return phrases.union(
        near.select("row", "item", F.lit("proximity").alias("kind"), F.least("pos", second).alias("first"), F.greatest("pos", second).alias("last"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document row: `key, n_words, n_hit, n_items, items_sha256, contaminated`.

    `n_hit` counts the words inside any occurrence of a window of an item, `n_items` the items with such
    a window; `items_sha256` is the digest of their ids, sorted as text and joined by commas. Null and
    empty texts have no words; without any benchmark item nothing is hit. Rows that repeat, and null
    keys, are handled row by row. Item texts that repeat under one id count once.

    With `slop` two columns follow that never change those before: `n_proximity`, the proximity matches
    by item and word range, and `proximity_items`, the sorted ids of their items.
    """
    items = scratch(test_terms(benchmark), "items")
    anchors = rarest_pairs(items, docs, window)
    index = positional_index(docs, key, anchors, window)
    found = scratch(matches(index, anchors, window, slop).distinct(), "matches")
    by_row = found.filter("kind = 'phrase'").groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("to")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(r["last"] - F.greatest(r["first"] - 1, a["to"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], r["last"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    hits = scratch(by_row.select("row", covered.alias("n_hit"), "items"), "hits")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    rows, extra = index.select("row", "key", "n_words").join(hits, "row", "left"), []
    if slop:
        near = found.filter("kind = 'proximity'").groupBy("row").agg(
            F.count(F.lit(1)).alias("near"), F.array_sort(F.collect_set("item")).alias("near_items")
        )
        rows = rows.join(near, "row", "left")
        none = F.array().cast("array<string>")
        extra = [F.coalesce("near", F.lit(0)).cast("bigint").alias("n_proximity"), F.coalesce("near_items", none).alias("proximity_items")]
    return rows.select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *extra,
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows in which any benchmark window occurs; columns as they were.

    Rows are told apart by a number that is written down with them, so repeated rows and null keys need
    no care. Of the written rows only those to be dropped are named, and met in an anti-join.
    """
    own = docs.columns
    held = scratch(docs.select(F.struct(*own).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = held.select("row", F.col("doc")["text"].alias("text"))
    hit = scratch(decontaminate(texts, benchmark, "row", window).filter("contaminated").select("row"), "contaminated")
    return met(held, hit, "left_anti").select("doc.*")
