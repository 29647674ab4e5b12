"""From raw documents to a mixed training corpus, one operator of `mailverdict.llm` per stage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailverdict.llm import decontaminate, mixing, quality, secrets, simhash
from mailverdict.llm.common import Tables, release, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left = Tables()


def stage(work: Stage) -> Stage:
    """A stage that first removes what the stage before it has left in the shared folder.

    A stage's result is read lazily from such tables, so they can go only once it is written, which it is
    before the next stage begins. So the corpus lies there in one or two copies, however many stages run.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left.drop()
        release(docs)
        with _left.watch():
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Fingerprints and trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = scratch(work(spark, docs, sf_dir), name)
    _left.drop()
    return docs
