"""Joins and caps that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
NULL_SALTS = 1024


def heaviest_keys(counts: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """All keys of a `(key, n)` table with more rows than one task should take: `(_hot, _salts)`.

    There are at most as many as the table's rows, summed, hold `rows_per_salt`. Which keys are named
    never decides which rows are kept.
    """
    salts = F.ceil(F.col("n") / rows_per_salt).cast("int")
    return counts.filter((F.col("n") > rows_per_salt) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"), salts.alias("_salts"))


def left_join_salted(
    fact: DataFrame, dimension: DataFrame, key: str, hot: DataFrame, row_id: list[str]
) -> DataFrame:
    """Left join on `key`, with the rows of a hot key spread over as many tasks as they fill.

    The dimension holds one row per key and is repeated once per salt of a hot key. The salt is a
    hash of the row's own identity, so a task that is run again sends each row where it went before.
    Rows without a key match nothing and are spread as well. The list of hot keys is no larger than the
    rows divided by those of a salt; Spark sees its size and joins it as that allows.
    """
    identity = F.xxhash64(*row_id)
    salts = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(
        F.coalesce("_salts", F.lit(1))
    )
    salted = (
        fact.join(hot, fact[key] == hot["_hot"], "left")
        .withColumn("_salt", F.pmod(identity, salts).cast("int"))
        .drop("_hot", "_salts")
    )
    repeated = (
        dimension.join(hot, dimension[key] == hot["_hot"], "left")
        .withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        )
        .drop("_hot", "_salts")
    )
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def cap_per_group(
    df: DataFrame,
    group: str,
    order: list[Column],
    within: list[str],
    cap: int,
    keep: int,
    salts: int = 64,
) -> DataFrame:
    """All rows of groups up to `cap` rows; the first `keep` rows of larger groups.

    Each group is first cut to its leading rows within salts, so the task that ranks a whole group
    sees at most `salts * cap` rows. Whether a group is larger than the cap is known from a count per
    group, which is combined before its shuffle. Both ranks are cut at `cap`, so that Spark drops rows
    beyond it before they are shuffled; by default it does so up to 1000.
    """
    by_salt = Window.partitionBy(group, "_salt").orderBy(*order)
    by_group = Window.partitionBy(group).orderBy(*order)
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    leading = (
        df.withColumn("_salt", F.pmod(F.xxhash64(*within), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(by_salt))
        .filter(F.col("_rank") <= cap)
    )
    ranked = leading.withColumn("_rank", F.row_number().over(by_group)).filter(F.col("_rank") <= cap)
    sized = ranked.join(sizes, ranked[group].eqNullSafe(sizes["_group"]))
    return sized.filter((F.col("_rows") <= cap) | (F.col("_rank") <= keep)).drop("_salt", "_rank", "_rows", "_group")
