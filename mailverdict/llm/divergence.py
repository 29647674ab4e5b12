"""Quality rules: base counts, and how far a text's histograms lie from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import SPACES, ascii_lower, bound, scratch, words

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Frequent words of each language; fixed values.
COMMON = {
    "en": "the of and to in a is that for it",
    "fr": "de la le et les des en un une du",
    "de": "der die und in den von zu das mit sich",
    "es": "de la que el en y a los se del",
}
#: Classes of characters, each as a regular expression; what is in none of them is the last class.
CLASSES = (r"[A-ZÀ-ÖØ-Þ]", r"[0-9]", r"[.,;:'\x22()-]", r"[!?]", r"[#*$%&|<>@^_~=+/\\{}\[\]]")
CHAR_GUARD = 200  # characters in words below which the character histogram says too little
WORD_GUARD = 100  # words below which the word histogram says too little
LANGUAGE_GUARD = 20  # documents below which a language has no reference of its own
#: A distance may be as large as its limit, and by `slack / sqrt(size)` larger for chance in short texts.
CHAR_LIMIT, CHAR_SLACK = 0.16, 1.5
WORD_LIMIT, WORD_SLACK = 0.2, 1.0
SLOTS = max(len(x.split()) for x in COMMON.values())


def repeated_words(w: Column) -> Column:
    """Words inside a window of three that the text holds twice or more, the first one included.

    Windows are told apart by 64-bit hashes within one text. Sorting them puts equal ones side by side,
    so the work is that of a sort however often a window occurs.
    """
    # slices start at 1; a text of fewer than three words has no window
    hashes = bound(
        w,
        lambda x: F.transform(
            F.slice(x, F.lit(1), F.greatest(F.size(x) - 2, F.lit(0))), lambda y, i: F.xxhash64(y, F.get(x, i + 1), F.get(x, i + 2))
        ),
    )

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["i"])), lambda i: i.isNotNull())

        spread = F.flatten(F.transform(bound(order, starts), lambda i: F.array(i, i + 1, i + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(spread)))

    return bound(hashes, covered).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`(key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common)` per row.

    `chars` counts the characters in words by class, `common` the language's frequent words in the order
    of `COMMON` and then all others; it is null for languages without a list.
    """
    base = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"),
        words(F.col(text)).alias("_w"),
    )
    t, w = F.col("_t"), F.col("_w")
    lower = F.filter(F.split(ascii_lower(t), SPACES), lambda x: x != "")

    def tally(x: Column) -> Column:
        by_lang = F.lit(None).cast("array<bigint>")
        for name, listed in COMMON.items():
            counts = [(F.size(x) - F.size(F.array_remove(x, c))).cast("bigint") for c in listed.split()]
            counts += [F.lit(0).cast("bigint")] * (SLOTS - len(counts))
            by_lang = F.when(F.col("lang") == name, F.array(*counts)).otherwise(by_lang)
        return by_lang

    found = base.select(
        "key", "lang", F.size(w).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("bigint").alias("word_chars"),
        _count(t, r"[#*$%&|<>]").alias("n_symbols"), duplicate_lines(t).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
        F.array(*(_count(t, c) for c in CLASSES)).alias("classes"), bound(lower, tally).alias("listed"),
    )
    rest = lambda total, part: F.concat(part, F.array(total - F.aggregate(part, F.lit(0).cast("bigint"), lambda a, b: a + b)))
    return scratch(
        found.withColumn("chars", rest(F.col("word_chars"), F.col("classes"))).withColumn("common", rest(F.col("n_words"), F.col("listed")))
        .drop("classes", "listed"),
        "measured",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def references(found: DataFrame) -> DataFrame:
    """`(ref, docs, ref_chars, ref_common)`: summed counts of each language's texts that pass the base rules.

    One row per language, combined on the map side; the row `*` holds all languages together and stands in
    for those that have too few texts.
    """
    good = found.filter(~base_failed())
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(SLOTS + 1)]
    by_lang = good.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *sums)
    all_of = good.agg(F.count(F.lit(1)).alias("docs"), *sums).select(F.lit("*").alias("lang"), "docs", *(s for s in by_lang.columns[2:]))
    return by_lang.filter(F.col("docs") >= LANGUAGE_GUARD).union(all_of).select(
        F.col("lang").alias("ref"), "docs", F.array(*(f"c{k}" for k in range(len(CLASSES) + 1))).alias("ref_chars"),
        F.array(*(f"w{k}" for k in range(SLOTS + 1))).alias("ref_common"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return bound(F.struct(counts.alias("c"), total.alias("n")), lambda x: F.transform(x["c"], lambda c: c / x["n"]))


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms of counts; 0 to 1."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(_shares(a), _shares(b), lambda p, q: part(p, q) + part(q, p))
    total = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / 2)


def _compared(found: DataFrame, refs: DataFrame) -> DataFrame:
    """`found` with `char_distance` and `word_distance`; null where a text is too short to tell."""
    own = refs.select(F.col("ref").alias("lang"), "ref_chars", "ref_common")
    whole = refs.filter("ref = '*' AND docs > 0").select(F.lit(1).alias("one"), F.col("ref_chars").alias("all_chars"))
    # the row of all languages is a single one, so this is a lookup rather than a product
    placed = found.withColumn("one", F.lit(1)).join(own, "lang", "left").join(F.broadcast(whole), "one", "left")
    chars = F.when(F.col("word_chars") >= CHAR_GUARD, js_distance(F.col("chars"), F.coalesce("ref_chars", "all_chars")))
    common = F.when((F.col("n_words") >= WORD_GUARD) & F.col("ref_common").isNotNull(), js_distance(F.col("common"), F.col("ref_common")))
    return placed.withColumn("char_distance", F.round(chars, 6)).withColumn("word_distance", F.round(common, 6)).drop(
        "one", "ref_chars", "ref_common", "all_chars"
    )


def _near() -> Column:
    chars = F.col("char_distance") <= CHAR_LIMIT + CHAR_SLACK / F.sqrt("word_chars")
    common = F.col("word_distance") <= WORD_LIMIT + WORD_SLACK / F.sqrt("n_words")
    return F.coalesce(chars, F.lit(True)) & F.coalesce(common, F.lit(True))


def grade(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document row: counts, `base_failed`, both distances and `kept`.

    A text is dropped if its characters in words, by class, or its frequent words lie farther from the
    language's reference than `CHAR_LIMIT` or `WORD_LIMIT`. References are summed twice, the second time
    over the texts that lie near the first ones, so that junk does not pull them to itself. Short texts
    are not measured (null distance), nor are words of languages without a list; such texts stay unless a
    base rule fails. Null texts have no words and fail; a null language counts as the empty name.
    Languages with few texts are compared to all texts, by characters only. Without any text that passes
    the base rules nothing is compared. Repeated rows are judged each.
    """
    found = measured(docs, key, text, lang)
    first = scratch(references(found), "references")
    refs = scratch(references(_compared(found, first).filter(_near()).drop("char_distance", "word_distance")), "references")
    return _compared(found, refs).select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        "char_distance", "word_distance", (~base_failed() & _near()).alias("kept"),
    )
