"""Quality classifier whose evidence is weighed against what its host and path are like."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import met, scratch, words

FEATURES = ("symbols", "capitals", "bars", "shouts", "digits", "distinct", "growth", "word_length", "log_words")
CAPITALS = string.ascii_uppercase + "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF))))
REGULARISATION = 1e-3
KEEP = 0.5
MAX_EVIDENCE = 12.0  # log odds; nothing a single text shows counts as more


@dataclass(frozen=True)
class Classifier:
    """Weights of a logistic regression over `FEATURES`, and the share of good rows it was fitted on."""

    weights: tuple[float, ...]
    intercept: float
    base: float

    def log_odds(self) -> Column:
        terms = (F.col(name) * weight for name, weight in zip(FEATURES, self.weights))
        return sum(terms, F.lit(self.intercept))


def _per(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def features(docs: DataFrame, key: str, text: str, host: Column, path: Column) -> DataFrame:
    """`(key, host, path)` and `FEATURES` per row; an empty or null text has zeros throughout."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), t.alias("_t"), words(t).alias("_w"))
    chars, n = F.length("_t"), F.size("_w")
    without = lambda drop: chars - F.length(F.translate("_t", drop, ""))
    kinds = F.size(F.array_distinct("_w"))
    return base.select(
        "key", "host", "path",
        _per(without("#*$%&<>"), chars).alias("symbols"),
        _per(without(CAPITALS), chars).alias("capitals"),
        _per(without("|"), n).alias("bars"),
        _per(without("!"), n).alias("shouts"),
        _per(without(string.digits), chars).alias("digits"),
        _per(kinds, n).alias("distinct"),
        F.when(n > 1, F.log(kinds) / F.log(n)).otherwise(1.0).alias("growth"),
        _per(chars - without(" \t\n\x0b\x0c\r"), n).alias("word_length"),
        F.log1p(n).alias("log_words"),
    )


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> Classifier:
    """Logistic regression on every labelled row; equal keys with several labels take the majority.

    Without labels of both kinds no text says anything: all weights are 0.
    """
    own = labels.filter(F.col("quality").isNotNull()).groupBy(key).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    train = scratch(rows.join(own.withColumnRenamed(key, "key"), "key").select(*FEATURES, "label"), "train")
    n, good = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        return Classifier((0.0,) * len(FEATURES), 0.0, 0.5)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    model = LogisticRegression(regParam=REGULARISATION, maxIter=100).fit(vectors)
    return Classifier(tuple(model.coefficients.toArray().tolist()), float(model.intercept), good / n)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _strength(groups: DataFrame, centre: Column, overall: float) -> float:
    """How many documents the level above is worth: the prior strength of a beta-binomial by moments.

    Groups `(n, good)` vary around `centre` more than chance explains; the less they do, the stronger
    the prior. The sums are grouped first, so one row of totals comes back.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - centre, 2)).alias("spread")
    n, k, spread = groups.agg(F.sum("n"), F.count(F.lit(1)), spread).first()
    chance = overall * (1 - overall)
    between = spread / n - chance * k / n
    return min(max(chance / between - 1, 1.0), 1e6) if between > 0 else 1e6


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    host: Column | None = None, path: Column | None = None,
) -> DataFrame:
    """Per row: `key, host, path, evidence, host_share, path_share, score, keep`.

    `evidence` is what the text alone says, as log odds against the share of good texts among the
    labels. Every document's own probability is summed by path and host; a path's share of good
    documents is drawn to its host's, the host's to the global one, the more the fewer documents it has.
    `score` is the probability from both, and `keep` holds for `KEEP` or more.

    By default the host is `source` and the path `lang`; `url_levels` gives both for web addresses.
    Null hosts or paths count as empty names. Null and empty texts are judged by their path and by what
    empty features say. Repeated rows are judged each; repeated labels take the majority.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = scratch(
        features(docs, key, text, name(F.col("source") if host is None else host), name(F.col("lang") if path is None else path)), "features"
    )
    model = fit(rows, labels, key)
    odds = F.greatest(F.least(model.log_odds() - _logit(model.base), F.lit(MAX_EVIDENCE)), F.lit(-MAX_EVIDENCE))
    seen = rows.select("key", "host", "path", odds.alias("evidence"))
    own = 1 / (1 + F.exp(-(F.col("evidence") + _logit(model.base))))
    paths = scratch(seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    overall = min(max(good / n, 1e-6), 1 - 1e-6) if n else 0.5
    k = _strength(hosts, F.lit(overall), overall) if n else 1.0
    shrunk = scratch(hosts.select("host", ((k * overall + F.col("good")) / (k + F.col("n"))).alias("host_share")), "hosts")
    placed = paths.join(shrunk, "host")
    k = _strength(placed, F.col("host_share"), overall) if n else 1.0
    shares = scratch(
        placed.select("host", "path", "host_share", ((k * F.col("host_share") + F.col("good")) / (k + F.col("n"))).alias("path_share")), "shares"
    )
    held = F.greatest(F.least("path_share", F.lit(1 - 1e-6)), F.lit(1e-6))
    score = F.round(1 / (1 + F.exp(-(F.col("evidence") + F.log(held / (1 - held))))), 6)
    return seen.join(shares, ["host", "path"]).select(
        F.col("key").alias(key), "host", "path", F.round("evidence", 6).alias("evidence"), F.round("host_share", 6).alias("host_share"),
        F.round("path_share", 6).alias("path_share"), score.alias("score"), (score >= KEEP).alias("keep"),
    )


def url_levels(url: Column) -> tuple[Column, Column]:
    """Host and first folder of a web address, for `judge`; both null where it is none."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    folder = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^/?#]*)", 1)
    return host, F.nullif(folder, F.lit(""))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that are rejected; columns as they were."""
    own = docs.columns
    held = scratch(docs.select(F.struct(*own).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    doc = held.select("row", "doc.doc_id", "doc.text", "doc.source", "doc.lang")
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    by_row = doc.select("row", "doc_id").join(marked, "doc_id").select("row", "quality")
    bad = scratch(judge(doc.drop("doc_id"), by_row, "row").filter("NOT keep").select("row"), "rejected")
    return met(held, bad, "left_anti").select("doc.*")
