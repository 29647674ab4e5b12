"""Row filters of the analytic queries."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mailverdict.functions.addresses import canonical_text
from mailverdict.functions.timerange import TimeRange, epoch_day, epoch_month
from mailverdict.functions.verdicts import SOURCE_KINDS

# Sizes a page of a summary or a drill-down can have.
PAGE_SIZES = (100, 200, 500)


def _period_bounds(df: DataFrame, first: int, last: int) -> DataFrame:
    """Repeat a time filter on the partition column, so that other periods are never read."""
    for period, of in (("end_day", epoch_day), ("end_month", epoch_month)):
        if period in df.columns:
            df = df.filter(F.col(period).between(of(F.lit(first)), of(F.lit(last))))
    return df


def in_range(df: DataFrame, span: TimeRange) -> DataFrame:
    """`end_date` within the range, both ends included."""
    kept = df.filter(F.col("end_date").between(span.start, span.end))
    return _period_bounds(kept, span.start, span.end)


def in_whole_days(df: DataFrame, span: TimeRange) -> DataFrame:
    """`end_date` from the start up to, not including, the end of the last whole day."""
    kept = df.filter((F.col("end_date") >= span.start) & (F.col("end_date") < span.bucket_end))
    return _period_bounds(kept, span.start, span.bucket_end)


def for_domain(df: DataFrame, domain: str | None) -> DataFrame:
    """Rows of one domain; None keeps all domains."""
    if domain == "":
        raise ValueError("domain is required")
    return df if domain is None else df.filter(F.col("domain") == domain)


def from_source(df: DataFrame, source: str, source_type: str) -> DataFrame:
    """Rows of one sender. An unknown kind of sender, or a text that is no address, has no rows."""
    name = SOURCE_KINDS.get(source_type)
    if name == "source_ip":
        source = canonical_text(source)
    if name is None or source is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(name) == source)


def search_domains(stats: DataFrame, query: str) -> DataFrame:
    """Domains that contain the query, upper and lower case alike; an empty query keeps all."""
    if not query:
        return stats
    return stats.filter(F.lower("domain").contains(query.lower()))


def page(df: DataFrame, order: list, number: int, size: int = PAGE_SIZES[0]) -> DataFrame:
    """Page `number`, counted from 0, of a result in the given order."""
    if size not in PAGE_SIZES or number < 0:
        raise ValueError(f"pages count from 0 and have one of the sizes {PAGE_SIZES}")
    return df.orderBy(*order).offset(number * size).limit(size)


@dataclass(frozen=True)
class Key:
    """One column of an order. Nulls come where Spark puts them unless told: first rising, last falling."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def leading_nulls(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def order(self) -> Column:
        column = F.col(self.name)
        if self.descending:
            return column.desc_nulls_first() if self.leading_nulls else column.desc_nulls_last()
        return column.asc_nulls_first() if self.leading_nulls else column.asc_nulls_last()

    def behind(self, value: Column, is_null: bool) -> Column:
        """Whether a row comes behind `value` by this column alone."""
        column = F.col(self.name)
        if is_null:
            return column.isNotNull() if self.leading_nulls else F.lit(False)
        further = column < value if self.descending else column > value
        return further if self.leading_nulls else F.coalesce(further, F.lit(True))


def seek(df: DataFrame, order: list[Key], last: Row | Mapping) -> DataFrame:
    """The rows that come behind the row `last` in an order: equal in its first keys, and further in the next."""
    held = last.asDict() if isinstance(last, Row) else last
    values = {k.name: F.lit(held[k.name]).cast(df.schema[k.name].dataType) for k in order}
    steps = []
    for at, key in enumerate(order):
        same = [F.col(k.name).eqNullSafe(values[k.name]) for k in order[:at]]
        steps.append(functools.reduce(Column.__and__, [*same, F.coalesce(key.behind(values[key.name], held[key.name] is None), F.lit(False))]))
    return df.filter(functools.reduce(Column.__or__, steps))


def page_after(df: DataFrame, order: list[Key], last: Row | Mapping | None, size: int = PAGE_SIZES[0]) -> DataFrame:
    """The page behind the row `last`; the first page where there is none.

    Pages come as `page` gives them, if `order` leaves no ties. But a page costs the same however far
    down it is: each task keeps its `size` leading rows behind `last`, and no rows before it are sorted.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"pages have one of the sizes {PAGE_SIZES}")
    rest = df if last is None else seek(df, order, last)
    return rest.orderBy(*(key.order() for key in order)).limit(size)
