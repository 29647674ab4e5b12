"""Daily series without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailverdict.functions.timerange import TimeRange

# Fixed value: seconds between two chart labels. Buckets are 86400 s wide all the same.
LABEL_STEP = 86000


def fill_days(buckets: DataFrame, span: TimeRange, label_step: int = LABEL_STEP) -> DataFrame:
    """One row per domain and bucket from 1 to the last one due, zeros where no bucket was counted.

    `buckets` is `(domain, bucket, passing, failing)`, already aggregated, so a domain has at most one
    row per day here. Every row fills the gap before it, and the last one also the tail up to the
    last label before the end of the range. Domains without any bucket stay out.
    """
    in_order = Window.partitionBy("domain").orderBy("bucket")
    tail = (span.end - span.start - 1) // label_step if span.end > span.start else 0
    label_of_bucket = F.col("bucket") * label_step + span.start
    last_due = F.when(label_of_bucket > 0, F.greatest("bucket", F.lit(tail))).otherwise(
        F.col("bucket")
    )
    filled = (
        buckets.withColumn("_before", F.lag("bucket", 1, 0).over(in_order))
        .withColumn("_last", F.lead("bucket").over(in_order).isNull())
        .withColumn("_until", F.when(F.col("_last"), last_due).otherwise(F.col("bucket")))
        .withColumn("k", F.explode(F.sequence(F.col("_before") + 1, F.col("_until"))))
    )
    own = F.col("k") == F.col("bucket")
    zero = F.lit(0).cast("bigint")
    return filled.select(
        "domain",
        F.col("k").alias("bucket"),
        ((F.col("k") * label_step + span.start) * 1000).alias("ts_ms"),
        F.when(own, F.col("passing")).otherwise(zero).alias("pass"),
        F.when(own, F.col("failing")).otherwise(zero).alias("fail"),
    )
