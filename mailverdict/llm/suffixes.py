"""Suffix order of a long sequence of numbers by the distributed difference-cover method (DC3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import bound, passing, release, scratch

BLOCK = 4096
FAR = 1 << 40  # weight of a triple in which its run ends: nothing behind it is compared


def placed(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """`rows` with `place`, 0 and up in the order of `by`, and `zeros`, the rows before with `kind` 0.

    A range-partitioned sort; each task counts along its own rows, and the driver sums one row per task.
    """
    of_kind = rows.columns.index("kind") if "kind" in rows.columns else None
    names = [*rows.columns, "_task", "place", "zeros"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, zeros = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            here = np.zeros(batch.num_rows, bool) if of_kind is None else batch.column(of_kind).to_numpy(zero_copy_only=False) == 0
            before = zeros + np.cumsum(here) - here
            places = np.arange(n, n + batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, task), pa.int64()), pa.array(places, pa.int64()), pa.array(before, pa.int64())],
                names=names,
            )
            n, zeros = n + batch.num_rows, zeros + int(here.sum())

    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "_task bigint", "place bigint", "zeros bigint"])
    sorted_ = scratch(rows.orderBy(*by).mapInArrow(count, schema), label)
    zero = (F.col("kind") == 0).cast("bigint") if of_kind is not None else F.lit(0)
    sums = sorted(sorted_.groupBy("_task").agg(F.count(F.lit(1)), F.sum(zero)).collect())
    starts, n, zeros = [], 0, 0
    for task, rows_here, zeros_here in sums:
        starts.append((task, n, zeros))
        n, zeros = n + rows_here, zeros + zeros_here
    offsets = rows.sparkSession.createDataFrame(starts, "_task bigint, _rows bigint, _zeros bigint")
    return (
        sorted_.join(F.broadcast(offsets), "_task")
        .withColumns({"place": F.col("_rows") + F.col("place"), "zeros": F.col("_zeros") + F.col("zeros")})
        .drop("_task", "_rows", "_zeros")
    )


def _triples(seq: DataFrame) -> DataFrame:
    """`(pos, s0, s1, s2, e0, e1, weight, end)`: each symbol with the two behind it, up to its run's end.

    Blocks of `BLOCK` symbols are gathered, each with the first two symbols of the next.
    """
    item = F.struct("pos", "sym", "weight", "end").alias("x")
    block = F.expr(f"pos div {BLOCK}")
    own = seq.select(block.alias("b"), item)
    lent = seq.filter(f"pos % {BLOCK} < 2 AND pos >= {BLOCK}").select((block - 1).alias("b"), item)
    blocks = own.union(lent).groupBy("b").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def triple(xs):
        def one(x, i):
            y, z = F.get(xs, i + 1), F.get(xs, i + 2)
            e0 = x["end"] | y.isNull()
            e1 = e0 | y["end"] | z.isNull()
            none = F.lit(0).cast("bigint")
            return F.struct(
                x["pos"].alias("pos"), x["sym"].alias("s0"), F.when(e0, none).otherwise(y["sym"]).alias("s1"),
                F.when(e1, none).otherwise(z["sym"]).alias("s2"), e0.alias("e0"), e1.alias("e1"),
                F.when(e1 | z["end"], F.lit(FAR)).otherwise(x["weight"] + y["weight"] + z["weight"]).alias("weight"),
                (e1 | z["end"]).alias("end"),
            )

        return F.transform(xs, one)

    rows = blocks.select("b", F.inline(bound(F.col("xs"), triple)))
    return scratch(rows.filter(F.col("b") == block).drop("b"), "triples")


def suffix_ranks(seq: DataFrame, depth: int) -> DataFrame:
    """`(pos, rank)` of every suffix of `seq(pos, sym, weight, end)`, for `pos` 0, 1, ... and `sym` > 0.

    A suffix reaches to the `end` of its run. Order is by symbols; suffixes that agree over a summed
    weight of `depth` or more, or altogether, count as equal and come in any order, next to each other.

    The triples at positions not divisible by 3 are sorted and named; if names repeat before `depth`, the
    sequence of names, two thirds as long, is sorted by the same method. The remaining suffixes are a
    symbol and a sorted suffix each; merging them is two more sorts, which count for every suffix how
    many of the other kind come before it. No step holds more than a block, or one row per task, at once.
    """
    with passing() as kept:
        ranks = _ranks(seq, depth)
        kept.append(ranks)
    release(seq)
    return ranks


def _ranks(seq: DataFrame, depth: int) -> DataFrame:
    n = seq.count()
    t = _triples(seq)
    sampled = t.filter("pos % 3 <> 0")
    distinct = sampled.groupBy("s0", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("w"))
    names = placed(distinct, ["s0", "s1", "s2"], "names").select("s0", "s1", "s2", "n", "w", (F.col("place") + 1).alias("name"))
    named = scratch(sampled.join(names.drop("n", "w"), ["s0", "s1", "s2"]).select("pos", "name", "weight", "end"), "named")
    if names.filter((F.col("n") > 1) & (F.col("w") < depth)).isEmpty():
        order = named.select("pos", F.col("name").alias("rank"))
    else:
        ones = (n + 1) // 3
        one = F.col("pos") % 3 == 1
        shorter = named.select(
            F.when(one, F.expr("(pos - 1) div 3")).otherwise(ones + F.expr("(pos - 2) div 3")).alias("pos"), F.col("name").alias("sym"), "weight",
            (F.col("end") | (one & (F.expr("(pos - 1) div 3") == ones - 1))).alias("end"),
        )
        first = F.col("pos") < ones
        order = suffix_ranks(shorter, depth).select(
            F.when(first, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2).alias("pos"), "rank"
        )
    ranks = placed(order, ["rank", "pos"], "sampled").select("pos", F.col("place").alias("r"))
    after = [ranks.select((F.col("pos") - k).alias("pos"), F.col("r").alias(f"r{k}")) for k in (1, 2)]
    none = F.lit(-1).cast("bigint")
    whole = scratch(
        t.join(after[0], "pos", "left").join(after[1], "pos", "left").select(
            "pos", (F.col("pos") % 3).alias("kind"), "s0", "s1", F.when(F.col("e0"), none).otherwise(F.coalesce("r1", none)).alias("a"),
            F.when(F.col("e1"), none).otherwise(F.coalesce("r2", none)).alias("b"),
        ), "whole",
    )
    with_ones = placed(whole.filter("kind < 2"), ["s0", "a", "pos"], "merge").select("pos", "kind", "place", "zeros")
    with_twos = placed(whole.filter("kind <> 1"), ["s0", "s1", "b", "pos"], "merge").select("pos", "kind", "place", "zeros")
    twos = with_twos.filter("kind = 0").select("pos", (F.col("place") - F.col("zeros")).alias("twos"))
    rest = with_ones.filter("kind = 0").join(twos, "pos").select("pos", (F.col("place") + F.col("twos")).alias("rank"))
    cover = with_ones.filter("kind = 1").union(with_twos.filter("kind = 2")).join(ranks, "pos")
    return scratch(rest.union(cover.select("pos", (F.col("r") + F.col("zeros")).alias("rank"))), "ranks")
