"""Removal of long repeated passages by a suffix order of the repeated parts of the corpus.

0. Equal texts go whole; one of them stands for all in what follows.
1. Sample. Of every window of `WINDOW` places the one with the least hash of `GRAM` bytes is a sample, so
   equal strings of `LENGTH` bytes have samples at equal offsets: a difference cover set by content rather
   than by residues. A string is repeated only if the `RIGHT` bytes at its sample occur elsewhere.
   Places within a short period come last in their window, and strings that their text holds a period
   earlier are known to be repeated: the earlier ones stand for them.
2. Sort. The text from one repeated sample to the next is a symbol, and samples without one that is not
   repeated between them form a run. DC3 (`suffixes.py`) puts the suffixes
   of the symbol sequence in order; adjacent prefixes are compared, and what agrees is removed.
3. Remaining suffixes. Strings at the edges of repeats start between samples and end inside a symbol.
   They meet by the bytes at their sample, one row per distinct context; their `LENGTH`-byte prefixes
   are sorted and adjacent ones compared, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailverdict.llm.common import passing, release, scratch
from mailverdict.llm.suffixes import placed, suffix_ranks

LENGTH = 200
GRAM = 16
WINDOW = 141
RIGHT = LENGTH - WINDOW + 1
PERIOD = 16  # places whose eight bytes follow again within so many are samples only where there are no others
SPAN = 500  # bytes that adjacent suffixes must share before they count as a repeat
DEPTH = SPAN + WINDOW + 1
PIECE = 1 << 15  # bytes that are sampled at once, of one text or of several: arrays of that size stay in the cache
SIEVE_LOG = 26  # the sieve in front of the exact join has 2 ** 26 bits, 8 MB
DIRECT = 4096  # contexts that are compared within one task; larger classes meet in a shuffle

RUNS = "array<struct<first:int,last:int>>"
PERIODS = "array<struct<first:int,later:int,last:int>>"
_I32, _I64 = pa.int32(), pa.int64()


def _eights(text: bytes) -> np.ndarray:
    """The eight bytes at every place as one number."""
    return np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)).copy()


def _hashes(eight: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `GRAM` bytes at every place."""
    h = (eight[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ ((eight[8:] + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, from minima of two, four, eight and more in a row."""
    n, wide = len(values), 1
    while wide * 2 <= width:
        values = np.minimum(values[:-wide], values[wide:])
        wide *= 2
    return np.minimum(values[: n - width + 1], values[width - wide :][: n - width + 1])


def _periodic(eight: np.ndarray, n: int) -> np.ndarray:
    """Which of the first `n` places have their eight bytes again at most `PERIOD` places on."""
    out = np.zeros(n, bool)
    for q in range(1, PERIOD + 1):
        out |= eight[:n] == eight[q : q + n]
    return out


def _windows(text: bytes, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`(place, first)`: the samples of the `valid` windows of a text of at most `2 ** 20` bytes, and the first window of each.

    Places within a short period come after all others, else the least hash counts, and the leftmost of
    equal ones.
    """
    n = len(text) - LENGTH + WINDOW
    eight, low = _eights(text), np.uint64((1 << 20) - 1)
    order = (_hashes(eight)[:n] >> np.uint64(1) & ~low) | np.arange(n, dtype=np.uint64)

    def chosen() -> tuple[np.ndarray, np.ndarray]:
        least = _least(order, WINDOW)
        begins = np.append(True, least[1:] != least[:-1])
        if valid is not None:
            begins[1:] |= ~valid[:-1]
            begins &= valid
        first = np.flatnonzero(begins)
        return (least[first] & low).astype(np.int64), first

    places, first = chosen()
    # where no sample is within a period, setting such places back changes nothing
    if (eight[places[:, None] + np.arange(1, PERIOD + 1)] == eight[places][:, None]).any():
        order |= _periodic(eight, n).astype(np.uint64) << np.uint64(63)
        places, first = chosen()
    return places, first


def samples(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(place, first, last)`: the samples, and the starts of strings of `LENGTH` bytes that each stands for.

    Long texts are handled in pieces.
    """
    found, end = [(np.zeros(0, np.int64),) * 2], -1
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        place, first = _windows(text[at : at + PIECE + LENGTH - 1])
        same = int(place[0] + at == end)  # its starts lie in both pieces
        found.append((place[same:] + at, first[same:] + at))
        end = place[-1] + at
    places, firsts = (np.concatenate(x) for x in zip(*found))
    return places, firsts, np.append(firsts[1:], len(text) - LENGTH + 1)[: len(firsts)] - 1


def samples_of_many(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """`(place, first)` as `samples` gives them for each text; short texts are handled some at a time."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= PIECE:
            size += len(texts[upto])
            upto += 1
        group, at = texts[at:upto], upto
        if len(group) == 1 or size < LENGTH:
            found += [samples(x)[:2] for x in group]
            continue
        ends = np.cumsum([len(x) for x in group])
        begins = np.append(0, ends[:-1])
        valid = np.ones(size - LENGTH + 1, bool)
        for begin, end in zip(begins.tolist(), ends.tolist()):
            valid[max(end - LENGTH + 1, begin) : end] = False
        places, firsts = _windows(b"".join(group), valid)
        cuts = np.append(np.searchsorted(firsts, begins), len(firsts)).tolist()
        found += [(places[a:b] - begin, firsts[a:b] - begin) for a, b, begin in zip(cuts, cuts[1:], begins.tolist())]
    return found


def recurring(text: bytes, places: np.ndarray) -> list[tuple[int, int, int]]:
    """`(first, later, last)`: stretches `first` to `last`, end exclusive, in which strings of `LENGTH` bytes come again a
    period on; the strings from `later` on are held a period earlier as well.

    Periods are read off samples at even distance; each is compared byte by byte. One that does not show
    there costs time only.
    """
    gaps = np.diff(places)
    even = gaps[:-2][(gaps[:-2] == gaps[1:-1]) & (gaps[1:-1] == gaps[2:]) & (gaps[:-2] <= WINDOW // 4)]
    if not len(even):
        return []
    found = []
    data = np.frombuffer(text, np.uint8)
    for q in np.unique(even).tolist():
        edges = np.flatnonzero(np.diff((data[:-q] == data[q:]).view(np.int8), prepend=0, append=0))
        found += [(a, a + q, b + q) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LENGTH]
    return found


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(row, key, text)` with the samples of the text, as `_samples_of` reads them, and its periodic stretches."""
    for batch in batches:
        steps, periods = [], []
        texts = [x or b"" for x in batch.column(2).to_pylist()]
        for text, (places, firsts) in zip(texts, samples_of_many(texts)):
            steps.append(np.concatenate((np.diff(places, prepend=0), np.diff(firsts, prepend=0))).astype(np.uint8).tobytes())
            periods.append([dict(zip(("first", "later", "last"), x)) for x in recurring(text, places)])
        kind = pa.list_(pa.struct([("first", _I32), ("later", _I32), ("last", _I32)]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(steps, pa.binary()), pa.array(periods, kind)], names=["row", "key", "text", "steps", "periods"]
        )


def _samples_of(text: bytes, steps: bytes, periods: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`samples` as written down, and whether any of a sample's starts has no equal string a period earlier."""
    places, firsts = np.cumsum(np.frombuffer(steps, np.uint8).reshape(2, -1), axis=1, dtype=np.int64)
    lasts = np.append(firsts[1:], len(text) - LENGTH + 1)[: len(firsts)] - 1
    stands = np.ones(len(places), bool)
    for x in periods:
        stands[np.searchsorted(firsts, x["later"]) : np.searchsorted(lasts, x["last"] - LENGTH, "right")] = False
    return places, firsts, lasts, stands


def _digests(data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """64-bit hashes of the given slices."""
    hashed = xxhash.xxh3_64_intdigest
    return np.array([hashed(data[a:b]) for a, b in zip(starts, ends)], np.uint64).view(np.int64)


def _mapped(df: DataFrame, one: Callable, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Rows that `one(*columns)` gives for each row, in batches of bounded size."""
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                held += one(*(column[k].as_py() for column in batch.columns))
                if len(held) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), out.types)], schema=out)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), out.types)], schema=out)

    return df.mapInArrow(run, schema)


def _columns(df: DataFrame, one: Callable, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Arrays that `one(*columns)` gives for each row, put together by column."""
    out = pa.schema(fields)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held), out.types)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                made = one(*(column[k].as_py() for column in batch.columns))
                if len(made[0]):
                    held.append(made)
                    n += len(made[0])
                if n >= 50_000:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)

    return df.mapInArrow(run, schema)


def _rights(text: bytes | None, steps: bytes, periods: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(g, whole, twice)`: the distinct hashes at samples, the hash of the whole text, and whether it has `g` at several samples."""
    data = text or b""
    places, _, _, stands = _samples_of(data, steps, periods)
    places = places[stands]
    found, times = np.unique(_digests(data, places.tolist(), (places + RIGHT).tolist()), return_counts=True)
    return found, np.full(len(found), xxhash.xxh3_64_intdigest(data), np.uint64).view(np.int64), times > 1


class Sieve:
    """Which hashes may be among those that occur again: one bit for each of `2 ** SIEVE_LOG` slots.

    A fixed size, whatever the data; it only spares rows the exact join behind it.
    """

    def __init__(self, again: DataFrame) -> None:
        slot = F.shiftrightunsigned("g", 64 - SIEVE_LOG)
        words_ = again.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(63).cast("int").alias("b"))
        bits = words_.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("bits")).toArrow()
        table = np.zeros(1 << (SIEVE_LOG - 6), np.int64)
        table[bits.column("w").to_numpy()] = bits.column("bits").to_numpy()
        self.table = again.sparkSession.sparkContext.broadcast(table)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes.view(np.uint64) >> np.uint64(64 - SIEVE_LOG)
        words_ = self.table.value[(slots >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return (words_ >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _lister(sieve: Sieve) -> Callable:
    """The samples of one text that may be repeated, with all that later steps compare instead of the text.

    Missing neighbours are -1.
    """

    def listed(key: int, text: bytes | None, steps: bytes, periods: list[dict]) -> tuple[np.ndarray, ...]:
        data = text or b""
        places, firsts, lasts, stands = _samples_of(data, steps, periods)
        behind = np.append(places[1:], -1)[: len(places)]
        far = np.append(places, -1)[np.searchsorted(places, places + SPAN)]
        places, firsts, lasts, behind, far = (x[stands] for x in (places, firsts, lasts, behind, far))
        rights = _digests(data, places.tolist(), (places + RIGHT).tolist())
        keep = sieve.passes(rights)
        places, firsts, lasts, rights, behind, far = (x[keep] for x in (places, firsts, lasts, rights, behind, far))
        ends = np.where(behind < 0, np.minimum(places + LENGTH, len(data)), behind)
        at, a, b = places.tolist(), firsts.tolist(), lasts.tolist()
        symbols = (_digests(data, at, ends.tolist()) >> 2 & (1 << 61) - 1) + 1
        spans = _digests(data, at, np.maximum(far, places).tolist())
        digest = xxhash.xxh3_64_intdigest
        contexts = [digest(data[x : y + LENGTH], p - x << 8 | p - y) for p, x, y in zip(at, a, b)]
        return (
            np.full(len(at), key, np.int64), places, firsts, lasts, behind, symbols, ends - places, far, spans, rights,
            np.array(contexts, np.uint64).view(np.int64),
        )

    return listed


_LISTED = [
    ("row", _I64), ("p", _I32), ("first", _I32), ("last", _I32), ("after", _I32), ("sym", _I64), ("weight", _I32), ("far", _I32),
    ("span", _I64), ("g", _I64), ("f", _I64),
]
_LISTED_SQL = "row bigint, p int, first int, last int, after int, sym bigint, weight int, far int, span bigint, g bigint, f bigint"


def _contexts(text: bytes | None, asked: list[dict]) -> list[tuple]:
    data = text or b""
    return [(x["g"], x["f"], x["n"], x["p"] - x["last"], x["p"] - x["first"], data[x["first"] : x["last"] + LENGTH]) for x in asked]


def _alike(keys: list[bytes], class_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per length and key a number that equals another's where class and the first bytes of that length agree.

    The keys are sorted once and adjacent ones compared byte by byte.
    """
    width = max(map(len, keys))
    order = np.array(sorted(range(len(keys)), key=[k.to_bytes(4, "big") + x for k, x in zip(class_.tolist(), keys)].__getitem__))
    rows = np.frombuffer(b"".join(keys[k].ljust(width, b"\0") for k in order), np.uint8).reshape(len(keys), width)
    differ = np.ones((len(keys) - 1, width + 1), bool)
    np.not_equal(rows[1:], rows[:-1], out=differ[:, :width])
    agree = np.where(class_[order[1:]] == class_[order[:-1]], differ.argmax(axis=1), -1)
    out = np.zeros((len(lengths), len(keys)), np.int64)
    out[:, order[1:]] = np.cumsum(agree < lengths[:, None], axis=1)
    return out


def shared_offsets(class_: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For each context and offset `a` from 0 whether its string there occurs in another of its class too.

    A context holds, for each offset `a` from `low` to `high`, the string that starts `a` bytes before the
    sample. Two strings are equal if `a` bytes left of the sample and the rest right of it are; either side
    is sorted by itself and adjacent ones are compared.
    """
    offsets = np.arange(high.max() + 1)
    left = _alike([x[h - 1 :: -1] if h else b"" for x, h in zip(contexts, high.tolist())], class_, offsets)
    right = _alike([x[h:] for x, h in zip(contexts, high.tolist())], class_, LENGTH - offsets)
    both = left * len(contexts) + right
    held = (low <= offsets[:, None]) & (offsets[:, None] <= high)
    both = np.where(held, both, -1 - np.arange(len(contexts)))
    order = np.argsort(both, axis=1)
    sorted_ = np.take_along_axis(both, order, axis=1)
    same = np.zeros((len(offsets), len(contexts) + 1), bool)
    same[:, 1:-1] = sorted_[:, 1:] == sorted_[:, :-1]
    shared = np.empty_like(held)
    np.put_along_axis(shared, order, same[:, 1:] | same[:, :-1], axis=1)
    return shared.T


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(g, f, runs)` of contexts that occur once, from classes `(g, members)`, some thousand contexts at a time."""
    for batch in batches:
        ends = np.cumsum(pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + DIRECT, "right")))
            classes = batch.slice(at, upto - at)
            at = upto
            members = classes.column(1).flatten()
            f, n, low, high = (members.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            sizes = pa.compute.list_value_length(classes.column(1)).to_numpy(zero_copy_only=False)
            class_ = np.repeat(np.arange(len(sizes)), sizes)
            shared = shared_offsets(class_, low, high, members.field(4).to_pylist())
            shared[n > 1] = False
            edges = np.diff(shared.view(np.int8), axis=1, prepend=0, append=0)
            who, first = np.nonzero(edges == 1)
            last = np.nonzero(edges == -1)[1] - 1
            chosen, begins = np.unique(who, return_index=True)
            runs = pa.StructArray.from_arrays([pa.array(first, _I32), pa.array(last, _I32)], names=["first", "last"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(who)), _I32), runs)
            g = classes.column(0).to_numpy()[class_[chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(g, _I64), pa.array(f[chosen], _I64), lists], names=["g", "f", "runs"])


def _strings(g: int, f: int, n: int, low: int, high: int, context: bytes) -> list[tuple]:
    return [(g, f, n, a, hashlib.md5(context[high - a : high - a + LENGTH]).digest()) for a in range(low, high + 1)]


def _edges(listed: DataFrame, texts: DataFrame, direct: int) -> DataFrame:
    """`(g, f, runs)`: for contexts `f` the runs of offsets whose strings occur elsewhere; null means all.

    `listed` holds every sample of the classes `g` that matter. Equal contexts are counted, not repeated.
    """
    place = F.struct("row", "p", "first", "last")
    kinds = scratch(listed.groupBy("g", "f").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "contexts")
    classes = scratch(
        kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
        .filter("kinds > 1 AND single > 0"), "classes",
    )
    asked = kinds.join(classes, "g").select("g", "f", "n", "at.*", "kinds")
    wanted = scratch(asked.groupBy("row").agg(F.collect_list(F.struct("g", "f", "n", "p", "first", "last")).alias("asked")), "asked")
    fields = [("g", _I64), ("f", _I64), ("n", _I64), ("low", _I32), ("high", _I32), ("context", pa.binary())]
    schema = "g bigint, f bigint, n bigint, low int, high int, context binary"
    release(texts)
    held = scratch(_mapped(texts.join(wanted, "row").select("text", "asked"), _contexts, fields, schema), "texts")
    release(texts)
    few = held.join(classes.filter(F.col("kinds") <= direct).select("g"), "g")
    grouped = few.groupBy("g").agg(F.collect_list(F.struct("f", "n", "low", "high", "context")).alias("members"))
    found = grouped.select("g", "members").mapInArrow(_resolve, f"g bigint, f bigint, runs {RUNS}")
    whole = kinds.filter("n > 1").select("g", "f", F.lit(None).cast(RUNS).alias("runs"))
    if classes.filter(F.col("kinds") > direct).isEmpty():
        return whole.union(found)
    many = held.join(classes.filter(F.col("kinds") > direct).select("g"), "g").dropDuplicates(["g", "f"])
    fields = [("g", _I64), ("f", _I64), ("n", _I64), ("a", _I32), ("d", pa.binary())]
    strings = scratch(_mapped(many.select("g", "f", "n", "low", "high", "context"), _strings, fields, "g bigint, f bigint, n bigint, a int, d binary"), "strings")
    twice = strings.groupBy("g", "a", "d").agg(F.sum("n").alias("times")).filter("times > 1").select("g", "a", "d")
    alike = strings.filter("n = 1").join(scratch(twice, "twice"), ["g", "a", "d"]).groupBy("g", "f").agg(
        F.transform(F.array_sort(F.collect_set("a")), lambda a: F.struct(a.alias("first"), a.alias("last"))).alias("runs")
    )
    return whole.union(found).union(alike)


def twins(texts: DataFrame) -> DataFrame:
    """`(row, spare, spans)` of the texts that equal another one: they go whole, and all but one of them are `spare`."""
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    marks = scratch(texts.select("row", sha, F.octet_length("text").alias("size")).filter(F.col("size") >= LENGTH), "marks")
    copied = marks.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")).filter("n > 1").select("sha", "least")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("size").alias("last"))).alias("spans")
    return scratch(marks.join(copied, "sha").select("row", (F.col("row") != F.col("least")).alias("spare"), whole), "twins")


def repeated_spans(texts: DataFrame, direct: int = DIRECT) -> DataFrame:
    """`(row, spans)` of `texts(row, text, steps, periods)`: sorted, possibly overlapping byte ranges `(first, last)`,
    end exclusive, that strings of `LENGTH` bytes cover which also start elsewhere; `periods` come on top of them.

    One of equal texts stands for all of them among the others; the texts themselves go whole."""
    copies = twins(texts)
    found = _different(texts, copies.filter("spare").select("row"), direct)
    return found.join(copies.select("row"), "row", "left_anti").union(copies.select("row", "spans"))


def _different(texts: DataFrame, spare: DataFrame, direct: int) -> DataFrame:
    """`(row, spans)` as `repeated_spans` gives them, of strings that start elsewhere in a text that is not `spare`."""
    hashed = _columns(texts.select("text", "steps", "periods"), _rights, [("g", _I64), ("whole", _I64), ("twice", pa.bool_())], "g bigint, whole bigint, twice boolean")
    met = hashed.groupBy("g").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.max("twice").alias("twice"))
    again = scratch(met.filter("a <> b OR twice").select("g"), "again")
    listed = _columns(texts.select("row", "text", "steps", "periods"), _lister(Sieve(again)), _LISTED, _LISTED_SQL).join(again, "g")
    listed = listed.join(spare, "row", "left_anti")
    in_text = Window.partitionBy("row").orderBy("p", "first")
    run = Window.partitionBy("row", "run")
    before = F.sum(F.col("end").cast("int")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    marked = listed.withColumn("end", F.coalesce(F.lead("p").over(in_text) != F.col("after"), F.lit(True)))
    marked = marked.withColumn("run", F.coalesce(before, F.lit(0)))
    # a repeat of SPAN bytes lies within one run of repeated samples, so shorter runs need no order
    length = F.max(F.col("p") + F.col("weight")).over(run) - F.min("p").over(run)
    kept = scratch(marked.withColumn("long", length >= SPAN).drop("run", "after"), "samples")
    fields = kept.filter("long").select("row", "p", "first", "far", "sym", "weight", "span", "end")
    sequence = placed(fields, ["row", "p", "first"], "sequence").withColumnRenamed("place", "pos")
    release(texts)
    ranks = suffix_ranks(sequence.select("pos", "sym", F.col("weight").cast("bigint").alias("weight"), "end"), DEPTH)
    order = placed(ranks, ["rank", "pos"], "order").select("pos", "place")
    suffixes = scratch(order.join(sequence.filter("far >= 0").select("pos", "row", "p", "first", "span"), "pos").drop("pos"), "suffixes")
    sides = [suffixes.select((F.col("place") + k).alias("place"), F.col("span").alias("other")) for k in (1, -1)]
    equal = sides[0].union(sides[1]).join(suffixes, "place").filter("other = span").select("row", "p", "first").distinct()
    equal = equal.withColumn("equal", F.lit(True))
    # starts that a repeat of SPAN bytes at an earlier sample covers need no further comparison
    reach = F.max(F.when(F.col("equal"), F.col("far") - LENGTH)).over(
        Window.partitionBy("row").orderBy("p").rangeBetween(Window.unboundedPreceding, -WINDOW)
    )
    state = scratch(
        kept.select("row", "p", "first", "last", "far", "g", "f").join(equal, ["row", "p", "first"], "left").withColumn("reach", reach)
        .withColumn("open", F.coalesce(F.col("reach") < F.col("last"), F.lit(True))).drop("reach"), "state",
    )
    release(texts)
    open_classes = scratch(state.filter("open").select("g").distinct(), "open")
    asked = scratch(state.join(open_classes, "g").select("row", "p", "first", "last", "g", "f", "open"), "members")
    edges = scratch(_edges(asked, texts, direct), "edges")
    spans = (
        state.filter("equal").select("row", F.col("p").alias("first"), F.col("far").alias("last"))
        .union(
            asked.filter("open").join(edges, ["g", "f"]).select(
                "row",
                F.inline(
                    F.coalesce(
                        F.transform("runs", lambda r: F.struct((F.col("p") - r["last"]).alias("first"), (F.col("p") - r["first"] + LENGTH).alias("last"))),
                        F.array(F.struct("first", (F.col("last") + LENGTH).alias("last"))),
                    )
                ),
            )
        )
    )
    return spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def _cut(key: object, text: bytes | None, spans: list[dict] | None, periods: list[dict]) -> list[tuple]:
    data, kept, at, removed, runs = text or b"", hashlib.sha256(), 0, 0, 0
    for span in sorted([*(spans or ()), *periods], key=lambda x: x["first"]) if periods else spans or ():
        if span["last"] <= at and runs:
            continue
        if span["first"] > at or not runs:
            kept.update(data[at : span["first"]])
            runs, at = runs + 1, span["first"]
        removed, at = removed + span["last"] - at, span["last"]
    kept.update(data[at:])
    return [(key, len(data), removed, runs, kept.hexdigest())]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", direct: int = DIRECT) -> DataFrame:
    """Per document row: `key, n_bytes, n_removed, n_spans, kept_sha256`.

    Every byte is removed that a string of `LENGTH` bytes covers which also starts at another place of the
    corpus, the same document included. Null and short texts lose nothing; rows that repeat are places of
    their own and lose what they share; null keys and empty tables need no care.
    """
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = dict(held.dtypes)["key"]
    held = scratch(held.mapInArrow(_sampled, f"row bigint, key {kind}, text binary, steps binary, periods {PERIODS}"), "docs")
    texts = held.select("row", "text", "steps", "periods")
    with passing() as kept:
        spans = scratch(repeated_spans(texts, direct), "spans")
        kept.append(spans)
    release(docs)
    fields = [("key", held.select("key").limit(0).toArrow().schema.field(0).type), ("n_bytes", _I64), ("n_removed", _I64), ("n_spans", _I64), ("kept_sha256", pa.string())]
    schema = f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    out = _mapped(held.join(spans, "row", "left").select("key", "text", "spans", "periods"), _cut, fields, schema)
    return out.withColumnRenamed("key", key)
