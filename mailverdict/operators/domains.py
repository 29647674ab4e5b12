"""Registrable domains by public suffix rules, and providers by registrable domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Registrable domains of known e-mail service providers.
ESP_BY_DOMAIN = {
    "amazonses.com": "Amazon SES",
    "google.com": "Google Mail",
    "rsgsv.net": "MailChimp",
    "mcsv.net": "MailChimp",
    "mcdlv.net": "MailChimp",
}


def org_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """`(host, org_domain, error)` for each distinct host.

    `rules` is `(rule, kind, is_icann)` with kind normal, wildcard (`*.` in front) or exception. Every
    ending of a host is looked up by equality. The rule that prevails is an exception, else the one
    with most labels. Hosts without an ICANN rule get an error instead of a domain.
    """
    table = rules.select(
        F.regexp_replace("rule", r"^(\*\.|!)", "").alias("ending"), "kind", "is_icann"
    )

    names = (
        hosts.select(F.col(host).alias("host"))
        .distinct()
        .withColumn("name", F.regexp_replace("host", r"\.+$", ""))
        .withColumn("labels", F.split("name", r"\."))
        .withColumn("n", F.size("labels"))
    )
    endings = names.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn(
        "ending", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".")
    )
    width = (
        F.when(F.col("kind") == "exception", F.col("k") - 1)
        .when(F.col("kind") == "normal", F.col("k"))
        .when((F.col("kind") == "wildcard") & (F.col("k") < F.col("n")), F.col("k") + 1)
    )
    best = (
        endings.join(table, "ending", "left")
        .withColumn("width", width)
        .groupBy("host")
        .agg(
            F.first("name").alias("name"),
            F.first("labels").alias("labels"),
            F.first("n").alias("n"),
            F.max(
                F.when(
                    F.col("width").isNotNull(),
                    F.struct(
                        (F.col("kind") == "exception").alias("exception"), "width", "is_icann"
                    ),
                )
            ).alias("rule"),
        )
    )
    known = F.coalesce(F.col("rule.is_icann"), F.lit(False))
    extra = F.col("n") - F.col("rule.width")
    domain = F.when(extra <= 1, F.col("name")).otherwise(
        F.array_join(F.slice("labels", extra, F.col("rule.width") + 1), ".")
    )
    return best.select(
        "host",
        F.when(known, domain).alias("org_domain"),
        F.when(~known, F.concat(F.lit("no public suffix rule for "), "name")).alias("error"),
    )


def add_esp(domains: DataFrame, column: str = "org_domain") -> DataFrame:
    """Add `esp` by registrable domain, '' where none is known."""
    pairs = [F.lit(text) for pair in ESP_BY_DOMAIN.items() for text in pair]
    return domains.withColumn(
        "esp", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(""))
    )
