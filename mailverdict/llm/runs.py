"""Periodic runs of words: longest common extensions by suffix trees, candidates by Lyndon roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import bound, words

SHORTEST = 6  # words in a run, at least
REPEATS = 4  # times its period, at least
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers above 0, with constant-time longest common prefixes.

    An Euler tour writes down the depth of a node's parent before the node, and of each leaf at the leaf; the
    least depth between two leaves is that of their lowest common ancestor, which is what their suffixes
    share. A sparse table answers such a minimum in two reads. Memory is linear but for the table's logarithm.
    """

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols)
        self._grow([*symbols, 0])  # 0 stands behind the end and is less than any symbol
        self._walk()

    def _grow(self, text: list[int]) -> None:
        end = len(text)
        first, last, link, kids = [0], [0], [0], [{}]  # node 0 is the root; a leaf has no dictionary
        node, edge, length, rest = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            rest += 1
            before = 0  # the inner node that still waits for its suffix link
            while rest:
                if not length:
                    edge = i
                at = text[edge]
                below = kids[node].get(at)
                if below is None:
                    kids[node][at] = len(first)
                    first.append(i), last.append(end), link.append(0), kids.append(None)
                    if before:
                        link[before] = node
                        before = 0
                else:
                    start = first[below]
                    span = last[below] - start
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    if text[start + length] == symbol:
                        length += 1
                        if before:
                            link[before] = node
                        break
                    middle, leaf = len(first), len(first) + 1
                    first.append(start), last.append(start + length), link.append(0)
                    kids.append({symbol: leaf, text[start + length]: below})
                    first.append(i), last.append(end), link.append(0), kids.append(None)
                    kids[node][at] = middle
                    first[below] = start + length
                    if before:
                        link[before] = middle
                    before = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self._first, self._last, self._kids = first, last, kids

    def _walk(self) -> None:
        """The tour with children in rising order, and the order of leaves with children in falling order."""
        first, last, kids, total = self._first, self._last, self._kids, self.size + 1
        ordered = [sorted(k) if k and len(k) > 1 else k for k in kids]
        tour, place, rising, falling = [], [0] * total, [], []
        stack = [(0, 0, 0)]
        while stack:
            node, depth, above = stack.pop()
            tour.append(above)
            if kids[node] is None:
                suffix = total - depth
                place[suffix] = len(tour)
                rising.append(suffix)
                tour.append(depth)
            else:
                below = kids[node]
                for symbol in reversed(ordered[node]):
                    child = below[symbol]
                    stack.append((child, depth + last[child] - first[child], depth))
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if kids[node] is None:
                falling.append(total - depth)
            else:
                below, names = kids[node], ordered[node]
                for symbol in names:  # popped last to first: the greatest symbol first
                    if symbol:
                        child = below[symbol]
                        stack.append((child, depth + last[child] - first[child]))
                if 0 in below:  # what ends here is a prefix of all others, and less in either order
                    child = below[0]
                    stack.append((child, depth + last[child] - first[child]))
        del self._first, self._last, self._kids
        self._place = np.array(place, np.int64)
        self.ranks = []
        for order in (rising, falling):
            rank = np.empty(total, np.int64)
            rank[order] = np.arange(total)
            self.ranks.append(rank)
        self._table = [np.array(tour, np.int32)]
        while (step := 1 << (len(self._table) - 1)) * 2 <= len(tour):
            low = self._table[-1]
            self._table.append(np.minimum(low[:-step], low[step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of what the suffixes at places `a` and at other places `b` share from their start."""
        low, high = np.minimum(self._place[a], self._place[b]), np.maximum(self._place[a], self._place[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            these = level == k
            row = self._table[k]
            found[these] = np.minimum(row[low[these]], row[high[these] - (1 << int(k)) + 1])
        return found


def _next_less(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one to its right that is less: where its longest Lyndon word ends."""
    found, open_, values = np.empty(len(rank) - 1, np.int64), [], rank.tolist()
    for i, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            found[open_.pop()] = i
        open_.append(i)
    return found


def runs_within(symbols: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> set[tuple[int, int, int]]:
    """All runs `(start, length, period)` of a sequence of numbers above 0 that are long enough.

    Every run contains a Lyndon root that is the longest Lyndon word at its start, under the order of the
    symbols or its reverse (Bannai et al., 2017). So these words, one per place and order, are the
    candidates: the tree of the sequence extends each to the right, that of its reversal to the left.
    """
    n = len(symbols)
    ahead, back = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    at = np.arange(n)
    found: set[tuple[int, int, int]] = set()
    for rank in ahead.ranks:
        until = _next_less(rank)
        period = until - at
        right = ahead.common(at, until)
        # words before the candidate and before its end, read backwards; nothing stands before place 0
        left = np.where(at > 0, back.common(np.minimum(n - at, n), n - until), 0)
        start, length = at - left, period + right + left
        enough = length >= np.maximum(shortest, repeats * period)
        found |= set(zip(start[enough].tolist(), length[enough].tolist(), period[enough].tolist()))
    return found


def zones(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Stretches `[first, last)` outside of which, and across whose ends, there is no run.

    Every word of a run occurs `repeats` times in it, so no run holds a word that is rarer in the document.
    Such words cut it into stretches, within which the same holds again, until nothing more is cut.
    """
    place, part, often, span = np.arange(len(ids)), None, np.bincount(ids)[ids], int(ids.max()) + 1
    while len(place):
        if part is not None:
            _, same, count = np.unique(part * span + ids[place], return_inverse=True, return_counts=True)
            often = count[same]
        kept = place[often >= repeats]
        if not len(kept):
            return []
        fresh = np.concatenate(([0], np.cumsum(np.diff(kept) > 1)))
        size = np.bincount(fresh)
        long = size[fresh] >= max(shortest, repeats)
        if len(kept) == len(place) and long.all():
            break
        place, part = kept[long], fresh[long]
    if not len(place):
        return []
    cuts = np.flatnonzero(np.diff(place) > 1)
    firsts, lasts = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(place) - 1]))
    return list(zip(place[firsts].tolist(), (place[lasts] + 1).tolist()))


def runs_of(words: list, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """All runs `(start, length, period)` of a list of words, by start and then period."""
    if len(words) < max(shortest, repeats):
        return []
    numbers = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if np.bincount(ids).max() < repeats:
        return []
    found = []
    for first, last in zones(ids, shortest, repeats):
        inner = np.unique(ids[first:last], return_inverse=True)[1] + 1
        found += [(start + first, length, period) for start, length, period in runs_within(inner, shortest, repeats)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """Per row of `docs` `(key, n_words, runs, collapsed)`.

    `runs` are all stretches of words of smallest period `period` that are at least `shortest` words and
    `repeats` periods long and that no neighbouring word extends, by start and then period. `collapsed` holds
    the words that no run contains behind its first period, joined by one space. Words are runs of anything but
    space, tab, line feed, vertical tab, form feed and carriage return. Rows stay apart, so repeated
    rows and null keys come back as they went in; a null or empty text has no words, no runs and an empty
    `collapsed`; an empty table gives an empty table; other columns are not read.

    Nothing is shuffled. A document is cut at words that are too rare for a run (`zones`), which leaves little of
    ordinary prose; each stretch that is left goes through two suffix trees in time linear in its
    words. Memory is some 700 bytes a word of the longest stretch, besides the words of one document.
    """
    kind = docs.schema[key].dataType.simpleString()
    places = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                found = runs_of(words, shortest, repeats)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), x)) for x in found])
                collapsed.append(b" ".join(without_repeats(words, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, places), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["key", "n_words", "runs", "collapsed"],
            )

    found = docs.select(key, text).mapInArrow(run, f"key {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared as whole numbers; of equal ones the first. Null where there is none."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), strongest(F.col("runs")).alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return best.select(
        key, "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def repeat_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, text)` with one document in ten made periodic, so that there is something to find.

    With h the CRC-32 of the decimal key, g = h // 10 and n words: where h % 10 = 0 and n > 0, word i >= a becomes
    word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8); words are then joined by one
    space. All other rows, those with a null key among them, keep their text as it is.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)).cast("bigint") + 1
        from_ = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, from_(i).cast("int"))), " "))

    return docs.select(key, F.when(h % 10 == 0, bound(words(F.col(text)), repeated)).otherwise(F.col(text)).alias(text))
