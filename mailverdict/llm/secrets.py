"""Secrets in texts: sure patterns, and weak ones that count only beside their other parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import bound, scratch

VALUE = r"""["']?\x20*[:=]\x20*["']?"""
SECRET = r"(?i)(password|passwd|secret|token|api_?key)" + VALUE + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"(?i)(username|user_?id|login|account|client_?id|access_?key_?id)" + VALUE + r"([A-Za-z0-9_.@-]+)"
ENDPOINT = r"(?i)(https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s<>]+"
SURE_CHARS = 12
WEAK_CHARS = 6
SCOPE = 400  # code points between the parts of one credential, at most
#: Order of kinds that start at the same place; the first three are the sure ones.
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")
SPAN = "array<struct<at:bigint,kind:int,to:bigint>>"


def _located(text: Column, pattern: str, kind: Column) -> Column:
    """All leftmost non-overlapping matches as `(at, kind, to)`, in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so their lengths give the places.
    `kind(match number, match)` gives the kind, or null to drop the match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if "([" in pattern else whole

    def places(x: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(x["gaps"], x["whole"], x["value"]),
            F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(SPAN).alias("found")),
            lambda a, m: F.struct(
                (a["pos"] + F.length(m["gaps"]) + F.coalesce(F.length(m["whole"]), F.lit(0))).alias("pos"),
                F.when(
                    m["whole"].isNotNull() & kind(m["value"]).isNotNull(),
                    F.array_append(
                        a["found"],
                        F.struct(
                            (a["pos"] + F.length(m["gaps"])).alias("at"), kind(m["value"]).cast("int").alias("kind"),
                            (a["pos"] + F.length(m["gaps"]) + F.length(m["whole"])).alias("to"),
                        ),
                    ),
                ).otherwise(a["found"]).alias("found"),
            ),
            lambda a: a["found"],
        )

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value.alias("value"))
    return F.when(text.rlike(pattern), bound(parts, places)).otherwise(F.array().cast(SPAN))


def spans_of(text: Column) -> Column:
    """All spans that any pattern finds, sure or weak, in order."""
    t = F.coalesce(text, F.lit(""))

    def graded(value: Column) -> Column:
        return F.when(F.length(value) >= SURE_CHARS, F.lit(0)).when(F.length(value) >= WEAK_CHARS, F.lit(3))

    return F.array_sort(
        F.concat(
            _located(t, SECRET, graded),
            _located(t, ACCESS, lambda v: F.lit(1)),
            _located(t, HEX, lambda v: F.lit(2)),
            _located(t, IDENTIFIER, lambda v: F.lit(4)),
            _located(t, ENDPOINT, lambda v: F.lit(5)),
        )
    )


def _split(found: DataFrame) -> DataFrame:
    """`sure` and `weak` in place of `spans`."""
    return found.withColumns(
        {"sure": F.filter("spans", lambda s: s["kind"] < 3), "weak": F.filter("spans", lambda s: s["kind"] >= 3)}
    ).drop("spans")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`(row, span)` for weak candidates whose complementary parts lie within `scope`.

    A secret that is too short needs an identifier (a named one or an access key) or an endpoint; an
    identifier needs a secret of any kind; an endpoint needs an identifier and a secret. The parts meet
    in an interval join: both sides are cut into cells of `scope` code points, a candidate asks its own
    cell and its neighbours. It is a semi-join, so a candidate comes out once however many parts lie
    near, and a cell holds only what fits into `scope` code points.
    """
    parts = found.filter(F.size("weak") > 0).select("row", F.inline(F.concat("sure", "weak")))
    secret = F.col("kind").isin(0, 2, 3)
    identifier = F.col("kind").isin(1, 4)
    cells = F.explode(F.sequence(F.expr(f"at div {scope}"), F.expr(f"to div {scope}")))

    def side(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("row").alias("r"), F.col("at").alias("a"), F.col("to").alias("b"), cells.alias("c"))

    def beside(weak: DataFrame, other: DataFrame) -> DataFrame:
        near = F.explode(F.sequence(F.expr(f"at div {scope} - 1"), F.expr(f"to div {scope} + 1")))
        asked = weak.withColumn("cell", near)
        part = side(other)
        reach = (
            (F.col("row") == F.col("r")) & (F.col("cell") == F.col("c"))
            & (F.col("a") <= F.col("to") + scope) & (F.col("b") >= F.col("at") - scope)
        )
        return asked.join(part, reach, "left_semi").drop("cell").distinct()

    ids, secrets, ends = parts.filter(identifier), parts.filter(secret), parts.filter("kind = 5")
    short = beside(parts.filter("kind = 3"), ids.union(ends))
    named = beside(parts.filter("kind = 4"), secrets)
    places = beside(beside(ends, ids), secrets)
    return short.union(named).union(places)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document row: `key, sure, added`, both arrays of `(at, kind, to)` in order.

    Places are code points. Null and empty texts have no span. Repeated rows and null keys are handled
    row by row.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), spans_of(F.col(text)).alias("spans"))
    found = _split(scratch(rows, "secrets"))
    more = scratch(
        linked(found, scope).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "to"))).alias("added")), "linked"
    )
    return found.select("row", "key", "sure").join(more, "row", "left").select(
        F.col("key").alias(key), "sure", F.coalesce("added", F.array().cast(SPAN)).alias("added")
    )


def named_spans(spans: Column) -> Column:
    """`kind:start:end` of each span, by start and then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"].cast("string"), s["to"].cast("string")),
    )
    return F.array_join(text, ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the sure spans and all spans as text."""
    count = lambda k: F.size(F.filter("sure", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(named_spans(F.col("sure")), 256).alias("base_sha256"),
        named_spans(F.concat("sure", "added")).alias("spans"),
    )


def masked(docs: DataFrame, text: str = "text", scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """`docs` with every secret, sure or linked, replaced by `mask`; endpoints and identifiers stay.

    Rows without weak candidates, nearly all, are rewritten where they are; only the others meet what
    the interval join has linked. Overlapping spans become one mask. A null text stays null.
    """
    own = [c for c in docs.columns]
    rows = docs.select(
        F.struct(*own).alias("doc"), F.monotonically_increasing_id().alias("row"), spans_of(F.col(text)).alias("spans")
    )
    found = _split(scratch(rows, "masking"))
    none = F.array().cast(SPAN)
    more = scratch(
        linked(found.select("row", "sure", "weak"), scope).filter("kind = 3")
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "to"))).alias("added")),
        "linked",
    )
    alone = found.filter(F.size("weak") == 0).select("doc", "sure", none.alias("added"))
    asked = found.filter(F.size("weak") > 0).join(more, "row", "left").select("doc", "sure", F.coalesce("added", none).alias("added"))
    whole = F.col("doc")[text]

    def cut(x: Column) -> Column:
        return F.aggregate(
            F.array_sort(x["spans"]),
            F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out")),
            lambda a, s: F.struct(
                F.greatest(a["pos"], s["to"]).alias("pos"),
                F.when(s["at"] >= a["pos"], F.concat(a["out"], F.substring(x["text"], (a["pos"] + 1).cast("int"), (s["at"] - a["pos"]).cast("int")), F.lit(mask)))
                .otherwise(a["out"]).alias("out"),
            ),
            lambda a: F.concat(a["out"], F.substring(x["text"], (a["pos"] + 1).cast("int"), F.length(x["text"]))),
        )

    rewritten = F.when(
        F.size("sure") + F.size("added") > 0, bound(F.struct(whole.alias("text"), F.concat("sure", "added").alias("spans")), cut)
    ).otherwise(whole)
    return alone.union(asked).select(*(rewritten.alias(c) if c == text else F.col("doc")[c].alias(c) for c in own))
