"""Helpers that several operators share: words, lower case, and tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.session import drop_dir, shared_dir

SPACES = r"[\x20\x09-\x0D]+"
_scratch: list[tuple[object, str]] = []


def scratch(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` below the cluster's shared folder and read it back.

    This cuts the lineage: what comes later reads files that outlive any executor, and steps that use
    the table more than once do not repeat the work behind it. `clear_scratch` removes the tables; it
    runs by itself when the application ends, as results that are read lazily still need them before.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{label}")
    _scratch.append((spark, path))
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that `scratch` writes inside are removed at the end, but for those put into the list."""
    mark, kept = len(_scratch), []
    yield kept
    stay = {getattr(table, "_scratch_path", None) for table in kept}
    made, _scratch[mark:] = _scratch[mark:], []
    for spark, path in made:
        if path in stay:
            _scratch.append((spark, path))
        else:
            drop_dir(spark, path)


class Tables:
    """The tables that `scratch` writes while a block runs, to be removed once nothing reads them."""

    def __init__(self) -> None:
        self.made: list[tuple[object, str]] = []

    @contextlib.contextmanager
    def watch(self) -> Iterator[None]:
        mark = len(_scratch)
        try:
            yield
        finally:
            self.made += _scratch[mark:]

    def drop(self) -> None:
        while self.made:
            table = self.made.pop()
            if table in _scratch:  # else removed already
                _scratch.remove(table)
                with contextlib.suppress(Exception):  # its session may have ended, and the folder with it
                    drop_dir(*table)


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of steps that are over; it does so when the driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def clear_scratch() -> None:
    """Remove every table that `scratch` wrote; frames that read them must not be used afterwards."""
    while _scratch:
        spark, path = _scratch.pop()
        with contextlib.suppress(Exception):  # the session may have ended first
            drop_dir(spark, path)


atexit.register(clear_scratch)


def numbered(docs: DataFrame) -> DataFrame:
    """`(doc, row)`: the rows of `docs` as one column, with a number that is written down with them."""
    return scratch(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")


def met(held: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """`held` joined with `rows` on `row`, by a shuffle of both whatever their sizes.

    The numbers of rows grow with the corpus, so from some size on they cannot be broadcast. With one plan
    for all sizes, what a small run takes of disk and shuffle tells what a large one takes. Only numbers are
    hashed in memory; the documents need no sort.
    """
    return held.join(rows.hint("shuffle_hash"), "row", how)


def keep_first(held: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Of each group of `(row, group)` the row of `held` with the smallest key, and of those the first; null keys come last."""
    named = held.select("row", F.col("doc")[key].alias("key")).join(groups, "row")
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "row")
    kept = scratch(named.groupBy("group").agg(F.min(order).alias("first")).select("first.row"), "kept")
    return met(held, kept, "left_semi").select("doc.*")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row, however often `use` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]
