"""Column expressions over a record's verdicts and sender fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS = "pass"

# Source kinds from the most to the least preferred, with the column each one shows.
SOURCE_KINDS = {
    "ESP": "esp",
    "SourceDomain": "source_domain",
    "SourceHost": "source_host",
    "SourceIP": "source_ip",
}


def passes() -> Column:
    return (F.col("eval_dkim") == PASS) | (F.col("eval_spf") == PASS)


def fails() -> Column:
    return (F.col("eval_dkim") != PASS) & (F.col("eval_spf") != PASS)


def count_where(condition: Column) -> Column:
    """Messages of the records that meet a condition."""
    return F.sum(F.when(condition, F.col("message_count")).otherwise(F.lit(0)))


def alignment_counts() -> list[Column]:
    """Five sums of one pass. Records aligned on both sides count for DKIM, for SPF and as fully."""
    dkim = F.col("eval_dkim") == PASS
    spf = F.col("eval_spf") == PASS
    return [
        F.sum("message_count").alias("total_count"),
        count_where(dkim | spf).alias("pass_count"),
        count_where(spf).alias("spf_aligned_count"),
        count_where(dkim).alias("dkim_aligned_count"),
        count_where(dkim & spf).alias("fully_aligned_count"),
    ]


def _present(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def source_label(include_host: bool = False) -> tuple[Column, Column]:
    """`(label, rank)` of a record's sender; `rank` is a position in SOURCE_KINDS.

    The summary never reads the host, so host labels appear only on request.
    """
    kinds = list(SOURCE_KINDS.items())
    label, rank = F.coalesce(F.col("source_ip"), F.lit("")), F.lit(len(kinds) - 1)
    for position, (kind, name) in reversed(list(enumerate(kinds[:-1]))):
        if kind == "SourceHost" and not include_host:
            continue
        label = F.when(_present(name), F.col(name)).otherwise(label)
        rank = F.when(_present(name), F.lit(position)).otherwise(rank)
    return label, rank


def source_kind(rank: Column) -> Column:
    kinds = list(SOURCE_KINDS)
    return reduce(
        lambda rest, i: F.when(rank == i, F.lit(kinds[i])).otherwise(rest),
        range(len(kinds) - 1),
        F.lit(kinds[-1]),
    )


def passing_percentage(passed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(passed / F.nullif(total, F.lit(0)) * 100)


def pass_band(percentage: Column) -> Column:
    return (
        F.when(percentage >= 99, "success").when(percentage >= 90, "warning").otherwise("error")
    )


def result_class(result: Column) -> Column:
    """Class of an authentication result text; the first match wins."""
    text = F.lower(F.trim(result))
    return (
        F.when(F.coalesce(result, F.lit("")) == "", "grey")
        .when(text.contains("pass"), "success")
        .when(text.contains("fail"), "error")
        .when(text.contains("warn") | text.contains("neutral"), "warning")
        .otherwise("info")
    )


def normalise(df: DataFrame) -> DataFrame:
    """Missing counts become 0 and missing texts become ''."""
    return df.na.fill(0).na.fill("")


def matches_text(query: str, columns: list[str], arrays: set[str]) -> Column:
    """Case-insensitive substring over several columns; list columns are compared as `a,b`."""
    if not query:
        return F.lit(True)
    needle = query.lower()
    texts = [
        F.array_join(F.col(c), ",") if c in arrays else F.col(c).cast("string") for c in columns
    ]
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(F.lower(t).contains(needle), F.lit(False)) for t in texts],
    )
