"""Timings of the headline queries; prints one JSON line.

`BENCH_SF_DIR` names the test tables, `BENCH_CPUS` the local threads. Inputs that a user would
already have (the stored fact table, mail files, notices) are made first and not timed, except the
write of the fact table, which is a query of its own. Analytic queries run on the stored table and
are timed `RUNS` times after one unmeasured run; the median counts. Ingest runs once on a fresh store.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import params as P
from checks.queries import QUERIES, new_warehouse
from fixtures import entries as fe
from fixtures import lookups as fl
from fixtures import mails as fm
from fixtures import notices as fn
from mailverdict import ingest_batch, ingest_stream
from mailverdict.operators.flatten import flatten_reports
from mailverdict.plans import reports
from mailverdict.session import build_session, passing_dir
from mailverdict.sources.reports import parse_reports

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def run(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def seconds(work: Callable[[], object]) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def report_queries(stored: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    constant = stored.withColumns({"domain": F.lit("all.example"), "esp": F.lit("all")})
    per_mail = stored.withColumns({"domain": F.lit("all.example"), "esp": F.col("message_id")})
    source, kind = P.SOURCES["detail_esp"]
    return {
        "domain_stats": lambda: reports.domain_stats(stored, P.NOW),
        "domain_totals": lambda: reports.domain_totals(stored, P.ALL_TIME),
        "source_summary_all": lambda: reports.source_summary(stored, P.ALL_TIME),
        "source_summary_capped": lambda: reports.source_summary(per_mail, P.ALL_TIME),
        "detail_esp": lambda: reports.source_detail(stored, P.ALL_TIME, P.DOMAIN, source, kind),
        "detail_top": lambda: reports.source_detail(constant, P.ALL_TIME, "all.example", "all", "ESP"),
        "daily_chart_all": lambda: reports.daily_chart(stored, P.ALL_TIME),
    }


def measure(spark: SparkSession) -> dict[str, float]:
    times: dict[str, float] = {}
    lookups = fl.lookups(spark, SF_DIR)

    warehouse = new_warehouse(spark)
    rows = fe.entries(spark, SF_DIR)
    for name in ("entries_write", "entries_write_warm"):
        times[name] = seconds(lambda: warehouse.write_entries(rows, "bench"))
    stored = warehouse.entries(spark)
    for name, query in report_queries(stored).items():
        run(query())
        times[name] = statistics.median(seconds(lambda q=query: run(q())) for _ in range(RUNS))
    for name in ("ip_intel", "org_domain", "flatten_all_reports"):
        run(QUERIES[name](spark, SF_DIR))
        times[name] = statistics.median(
            seconds(lambda n=name: run(QUERIES[n](spark, SF_DIR))) for _ in range(RUNS)
        )

    # parsing and flattening alone, over rendered reports that are stored first
    rendered = passing_dir(spark, "rendered")
    fm.report_xml(rows).write.parquet(rendered)
    nothing = F.lit(None).cast("string")
    texts = spark.read.parquet(rendered).withColumns({"stage": nothing, "error": nothing})
    run(flatten_reports(parse_reports(texts)))
    times["parse_reports"] = seconds(lambda: run(flatten_reports(parse_reports(texts))))

    root = fm.mail_folder(spark, SF_DIR)
    notices = fn.notice_folder(spark, SF_DIR)
    times["ingest_roundtrip"] = seconds(
        lambda: ingest_batch(spark, root, new_warehouse(spark), lookups)
    )

    def stream() -> None:
        query = ingest_stream(
            spark, notices, root, new_warehouse(spark), lookups,
            passing_dir(spark, "progress"), files_per_batch=3,
        )
        query.awaitTermination()

    times["stream_ingest"] = seconds(stream)
    return times


def main() -> None:
    # Spark's own notes go to stderr; stdout holds the result alone.
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(
            app="bench", master=f"local[{CPUS}]", spark__driver__memory="16g",
            spark__sql__shuffle__partitions=CPUS,
            # the data is small: smaller shuffle pieces keep all threads busy
            spark__sql__adaptive__advisoryPartitionSizeInBytes="8m", spark__ui__showConsoleProgress="false",
        )
        spark.sparkContext.setLogLevel("ERROR")
        times = {k: round(v, 3) for k, v in measure(spark).items()}
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
