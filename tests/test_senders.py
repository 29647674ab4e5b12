"""Addresses, sender records, reverse names, registrable domains."""

import ipaddress

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailverdict.functions import txtrecord
from mailverdict.functions.addresses import canonical_ip, canonical_text, lookup_name
from mailverdict.operators.domains import add_esp, org_domains
from mailverdict.operators.enrich import address_table, count_addresses, enrich
from mailverdict.operators.skew import cap_per_group, heaviest_keys, left_join_salted

ADDRESSES = {
    "209.85.220.41": "209.85.220.41",
    "2a01:111:f403:38::204": "2a01:111:f403:38::204",
    "2600:1901:101::10": "2600:1901:101::10",
    "2600:1901:0101:0000:0000:0000:0000:0010": "2600:1901:101::10",
    "::FFFF:1.2.3.4": "1.2.3.4",
    "::ffff:102:304": "1.2.3.4",
    "::1.2.3.4": "::102:304",
    "2001:db8:0:1:1:1:1:1": "2001:db8:0:1:1:1:1:1",
    "::": "::",
    "1.1": None,
    "01.2.3.4": None,
    "1.2.3.256": None,
    " 1.2.3.4": None,
    "fe80::1%eth0": None,
    "1.2.3.4/24": None,
    "": None,
    "unknown": None,
}


def test_canonical_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES] + [(None,)], "a string")
    rows = df.select("a", canonical_ip("a").alias("c")).collect()
    assert {r.a: r.c for r in rows} == ADDRESSES | {None: None}


@given(st.ip_addresses(v=6))
def test_spelled_out_ipv6_is_shortened(address):
    mapped = address.ipv4_mapped
    assert canonical_text(address.exploded.upper()) == str(mapped or address)
    assert canonical_text(str(ipaddress.ip_address(address))) == str(mapped or address)


def test_lookup_name(spark):
    row = spark.createDataFrame([("1.2.3.44", "::1")], "a string, b string").select(
        lookup_name(F.col("a")).alias("a"), lookup_name(F.col("b")).alias("b")
    ).first()
    assert (row.a, row.b) == ("44.3.2.1.query.senderbase.org", None)


def test_txt_records(spark):
    cases = {
        "single keeps its first characters": (["0-1=A|4=x"], ("", "x")),
        "several are sorted, stripped and joined": (["1-gle|4=y", "0-1=Goo"], ("Google", "y")),
        "last of repeated keys": (["1=A|1=B"], ("B", "")),
        "value ends at the second sign": (["1=A=B|4=z"], ("A", "z")),
        "stray pieces are dropped": (["stray||1=A|=|4"], ("A", "")),
        "short chunks are empty": (["0", "1-1=A"], ("A", "")),
        "empty record": ([""], ("", "")),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, txt array<string>")
    rows = (
        df.withColumn("t", txtrecord.reassemble("txt"))
        .withColumn("p", txtrecord.key_values("t"))
        .select("k", txtrecord.field("p", "org_name").alias("o"), txtrecord.field("p", "org_id").alias("i"))
        .collect()
    )
    assert {r.k: (r.o, r.i) for r in rows} == {k: v[1] for k, v in cases.items()}


def test_esp_of_organisation(spark):
    names = {
        "GOOGLE llc": "Google Mail", "my gmail": "Google Mail", "Amazon google": "Google Mail",
        "Laws Office": "Amazon SES", "amazon": "Amazon SES", "MailChimp": "MailChimp", "x": "", "": "",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", txtrecord.esp_of_organisation(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == names


def lookup_tables(spark):
    txt = spark.createDataFrame(
        [
            ("44.3.2.1.query.senderbase.org", ["1=Google|4=7|20=H.X|21=X|50=C|51=S|53=US|54=1|55=2"]),
            ("44.3.2.1.query.senderbase.org", ["1=ZZZ, an answer given twice"]),
            (None, ["1=none"]),
        ],
        "query_name string, txt array<string>",
    )
    ptr = spark.createDataFrame(
        [
            ("1.2.3.44", ["a.example."]),
            ("2001:db8::1", ["a.notoutlook.com.", "b."]),
            ("2001:db8::2", ["x.unverified-forwarding.1e100.net."]),
            ("2001:db8::3", ["plain.example.."]),
            ("2001:db8::4", []),
            (None, ["none"]),
        ],
        "ip string, names array<string>",
    )
    return txt, ptr


def test_address_table(spark):
    raws = ["1.2.3.44", "::ffff:1.2.3.44", "5.6.7.8", "2001:DB8::1", "2001:db8::2", "2001:db8::3",
            "2001:db8::4", "2001:db8::5", "bad", ""]
    df = spark.createDataFrame([(r,) for r in raws], "raw_ip string")
    found = {r.raw_ip: r for r in address_table(df, *lookup_tables(spark)).collect()}
    assert set(found) == set(raws)
    for raw in raws[:2]:
        r = found[raw]
        assert (r.source_ip, r.esp, r.org_name, r.org_id) == ("1.2.3.44", "Google Mail", "Google", "7")
        assert (r.source_host, r.source_domain, r.city, r.state) == ("h.x", "x", "C", "S")
        assert (r.country, r.longitude, r.latitude) == ("US", "1", "2")
        assert r.reverse_lookup == ["a.example."]
    assert (found["5.6.7.8"].esp, found["5.6.7.8"].source_host) == ("", "")
    r = found["2001:DB8::1"]
    assert (r.source_ip, r.source_host, r.source_domain, r.esp) == (
        "2001:db8::1", "a.notoutlook.com", "outlook.com", "Outlook")
    r = found["2001:db8::2"]
    assert (r.source_domain, r.esp) == ("unverified-forwarding.1e100.net", "")
    assert (found["2001:db8::3"].source_host, found["2001:db8::3"].source_domain) == ("plain.example.", "")
    for raw in ("2001:db8::4", "2001:db8::5", "bad", ""):
        assert (found[raw].source_host, found[raw].esp, found[raw].reverse_lookup) == ("", "", [])
    assert (found["bad"].source_ip, found[""].source_ip) == (None, None)


def test_one_address_with_most_records_is_joined_whole(spark):
    n = 3000
    records = spark.range(n).select(
        F.col("id").cast("string").alias("message_id"),
        F.lit(0).cast("bigint").alias("record_number"),
        F.when(F.col("id") % 3 == 0, "1.2.3.44").otherwise(F.concat(F.lit("10.0.0."), F.col("id") % 200)).alias("raw_ip"),
        F.col("id").alias("message_count"),
    )
    from mailverdict.schema import ENRICHED_COLUMNS, ENTRY_COLUMNS, ENTRY_SCHEMA

    missing = [c for c in ENTRY_COLUMNS if c not in records.columns and c not in ENRICHED_COLUMNS]
    records = records.withColumns({c: F.lit(None).cast(ENTRY_SCHEMA[c].dataType) for c in missing})
    rows = enrich(records, count_addresses(records), *lookup_tables(spark), rows_per_salt=100)
    assert rows.count() == n
    hot = rows.filter("source_ip = '1.2.3.44'")
    assert (hot.count(), hot.filter("esp = 'Google Mail'").count()) == (1000, 1000)
    assert rows.agg(F.sum("message_count")).first()[0] == n * (n - 1) // 2


def test_salted_join_equals_the_plain_join(spark):
    fact = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("unused", 4)], "k string, v int")
    counts = fact.groupBy("k").agg(F.count("*").alias("n"))
    hot = heaviest_keys(counts, "k", rows_per_salt=10)
    assert {r["_hot"]: r["_salts"] for r in hot.collect()}["hot"] == 100
    got = left_join_salted(fact, dim, "k", hot, ["id"]).select("id", "k", "v")
    want = fact.join(dim, "k", "left").select("id", "k", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_cap_per_group(spark):
    sizes = {"a": 9, "b": 10, "c": 11, "d": 40}
    rows = [(g, f"s{i:03}", i % 7) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, s string, v int")
    kept = cap_per_group(df, "g", [F.desc("v"), F.asc("s")], ["s"], cap=10, keep=9, salts=4)
    for group, n in sizes.items():
        want = sorted((r[1:] for r in rows if r[0] == group), key=lambda r: (-r[1], r[0]))
        got = kept.filter(F.col("g") == group).select("s", "v").collect()
        assert sorted(map(tuple, got)) == sorted(want[: 9 if n > 10 else 10])


def test_registrable_domains(spark):
    rules = [
        ("com", "normal", True), ("uk", "normal", True), ("co.uk", "normal", True),
        ("*.ck", "wildcard", True), ("!www.ck", "exception", True),
        ("blogspot.com", "normal", False), ("*.kawasaki.jp", "wildcard", True), ("jp", "normal", True),
        ("!city.kawasaki.jp", "exception", True),
    ]
    cases = {
        "mail-oo1-f48.google.com.": "google.com", "google.com": "google.com", "com": "com",
        "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "b.co.uk..": "b.co.uk",
        "a.b.c.ck": "b.c.ck", "b.c.ck": "b.c.ck", "c.ck": "c.ck", "x.www.ck": "www.ck", "www.ck": "www.ck",
        "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "a.city.kawasaki.jp": "city.kawasaki.jp",
        "kawasaki.jp": "kawasaki.jp", "x.blogspot.com": None, "a.unlisted": None, "": None, "ck": None,
    }
    hosts = spark.createDataFrame([(h,) for h in cases] * 2, "host string")
    table = spark.createDataFrame(rules, "rule string, kind string, is_icann boolean")
    rows = org_domains(hosts, table).collect()
    assert {r.host: r.org_domain for r in rows} == cases
    assert len(rows) == len(cases)
    assert all((r.error is None) == (r.org_domain is not None) for r in rows)


def test_esp_by_domain(spark):
    names = {"amazonses.com": "Amazon SES", "google.com": "Google Mail", "mcsv.net": "MailChimp",
             "rsgsv.net": "MailChimp", "mcdlv.net": "MailChimp", "x.com": "", None: ""}
    df = spark.createDataFrame([(n,) for n in names], "org_domain string")
    assert {r.org_domain: r.esp for r in add_esp(df).collect()} == names
