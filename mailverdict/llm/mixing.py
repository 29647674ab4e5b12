"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailverdict.llm.common import met, scratch, words

WEIGHTS = (1, 2, 3)
CAP = 3
SPREAD = 64  # parts into which documents of one source and size are dealt, so that none is one task
ROUNDS = 60
CLOSE = 1e-12
OPEN = 1e-6  # a gap that sums of doubles do not explain


def targets(sources: DataFrame) -> DataFrame:
    """`(sid, source, source_size, target)`: shares by weight, none above `CAP` times its source.

    Sources in code point order, null last, weigh 1, 2, 3 and so on in turn. Filling by weight until
    each source is full has a closed form: order the sources by `CAP * size / weight`; the level at
    which the rest still holds what the full ones leave is the first that is not above its own bound.
    The table has one row per source, so its single ordered pass is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    rated = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight)
    rated = rated.withColumn("bound", CAP * F.col("source_size") / F.col("weight"))
    by_bound = Window.orderBy("bound", "sid")
    everything = Window.partitionBy()
    level = (F.col("total") - F.col("full")) / F.col("open")
    levels = (
        rated.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(CAP * F.col("source_size")).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("reached", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "sid", "level"))).over(everything)["level"])
    )
    return levels.select(
        "sid", "source", "source_size",
        F.least(CAP * F.col("source_size").cast("double"), F.col("weight") * F.col("reached")).alias("target"),
    )


def balance(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """`(sid, rate)`: rates `exp(lambda)` that meet every source's token constraint.

    Among all rates that do, these have the least relative entropy to taking each word once. The dual,
    the sum over sources of `target * lambda - tokens * exp(lambda)`, is concave; each Newton step needs
    the taken tokens of each source, one grouped sum over the whole table, which are gradient and
    (diagonal) Hessian at once. Steps are held within 2, so that a far start cannot overshoot.
    """
    state = scratch(sources.filter("target > 0").select("sid", "target", F.lit(0.0).alias("lam")), "dual")
    for _ in range(ROUNDS):
        mass = classes.join(state, "sid").groupBy("sid").agg(F.sum(F.col("size") * F.col("n") * F.exp("lam")).alias("mass"))
        gap = F.col("target") - F.col("mass")
        step = F.greatest(F.least(gap / F.col("mass"), F.lit(2.0)), F.lit(-2.0))
        state = scratch(
            state.join(mass, "sid").select("sid", "target", (F.col("lam") + step).alias("lam"), F.abs(gap / F.col("target")).alias("gap")),
            "dual",
        )
        gap = state.agg(F.max("gap")).first()[0] or 0.0
        if gap <= CLOSE:
            break
    else:
        if not gap <= OPEN:
            raise RuntimeError(f"a target is missed by {gap:.3g} of it after {ROUNDS} rounds")
    return state.select("sid", F.least(F.exp("lam"), F.lit(float(CAP))).alias("rate"))


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of the documents of each class of one source: all get `each`, the first `more` one in addition.

    Large documents first; what rounding leaves over is carried to smaller ones, which may get up to `CAP`
    copies or none to make up for it. So a source misses its target by less than a small document, unless
    so few are left behind a large one that they cannot make up for it.
    """
    rows = rows.sort_values(["size", "part"], ascending=[False, True])
    left, each, more = 0.0, [], []
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
        want = left + n * rate * size
        k = min(max(round(want / size), 0), CAP * n) if size else 0
        left = want - k * size
        each.append(k // n)
        more.append(k % n)
    return rows[["sid", "size", "part"]].assign(each=each, more=more)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tick: Column | None = None) -> DataFrame:
    """Per document row: `key, size, source_size, target, rate, copies, taken`.

    `copies` is the rate rounded down or up, for as many documents of a size as meet the target; which
    ones is fixed by `tick`, by default a hash of key and text, so reruns agree. The rounding handles one row per source,
    size and part, however many documents there are. Null texts have no words and are not taken; a null
    source is a source of its own; equal rows may get different numbers of copies. An empty table, or
    one without words, gives targets of 0.
    """
    sized = scratch(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("bigint").alias("size"),
            (F.xxhash64(key, text) if tick is None else tick).alias("tick"),
        ).withColumn("part", F.pmod("tick", F.lit(SPREAD)).cast("int")),
        "sized",
    )
    counted = scratch(sized.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "counted")
    sources = scratch(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "sources")
    of = sources.select("sid", F.col("source").alias("s"))
    classes = scratch(counted.join(of, counted["source"].eqNullSafe(of["s"])).drop("source", "s"), "classes")
    rates = scratch(sources.join(balance(classes, sources), "sid", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))), "rates")
    rated = classes.join(rates.select("sid", "rate"), "sid")
    rounded = scratch(rated.groupBy("sid").applyInPandas(_rounded, "sid int, size bigint, part int, each bigint, more bigint"), "rounded")
    named = rates.select("sid", F.col("source").alias("s"), "source_size", "target", "rate")
    placed = sized.join(named, sized["source"].eqNullSafe(named["s"])).drop("source", "s")
    turn = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("tick", "key"))
    copies = (F.col("each") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)).cast("bigint")
    return placed.withColumn("turn", turn).join(rounded, ["sid", "size", "part"]).withColumn("copies", copies).select(
        F.col("key").alias(key), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """`docs` with each row as often as the mix takes it; columns as they were, whatever their names.

    Which of several rows of a size are taken more often follows from their values, not from the files they lie in.
    """
    own = docs.columns
    held = scratch(docs.select(F.struct(*own).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    tick = F.xxhash64(*(F.col("doc")[name] for name in plain)).alias("tick")
    texts = held.select("row", F.col("doc")["text"].alias("text"), F.col("doc")["source"].alias("source"), tick)
    taken = scratch(mix(texts, "row", tick=F.col("tick")).filter("copies > 0").select("row", "copies"), "taken")
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return met(held, taken).select("doc", each).select("doc.*")
