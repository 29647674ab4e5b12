"""Near-duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import keep_first, numbered, scratch
from mailverdict.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
DIRECT = 4096  # values that share a key and are compared at once; more are first split by further bits


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles in their order; of all words where they are fewer, none where there is no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[shingle - 1 :].tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles as a signed 64-bit number; 0 where there is no word."""
    values = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 16):
        part = values[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, fingerprint)` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array((fingerprint(t.as_py()) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, fingerprint bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _spread(bits: list[int], parts: int) -> list[int]:
    """The given bit numbers as `parts` masks of about equal size."""
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def block_masks(bits: list[int], distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of which at least one covers only equal bits of any two values within `distance`.

    The bits are cut into `blocks` blocks; `distance` differing bits touch at most `distance` of them,
    so some choice of `blocks - distance` blocks is equal.
    """
    return [sum(chosen) for chosen in combinations(_spread(bits, blocks), blocks - distance)]


def _keys(value: Column, masks: list[int], first: int = 0) -> Column:
    """One `(mask number, masked value)` for each mask."""
    return F.array(
        *(F.struct(F.lit(first + k).alias("m"), value.bitwiseAND(F.lit(_signed(x))).alias("block")) for k, x in enumerate(masks))
    )


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect values within `distance` bits: a spanning forest, never all pairs."""
    values = np.asarray(values, np.int64)
    bits, links, unseen = values.view(np.uint64), [], np.arange(len(values))
    while len(unseen) > 1:
        front, unseen = [unseen[0]], unseen[1:]
        while front and len(unseen):
            x = front.pop()
            near = np.bitwise_count(bits[unseen] ^ bits[x]) <= distance
            if near.any():
                links += [(int(values[x]), int(values[y])) for y in unseen[near]]
                front += list(unseen[near])
                unseen = unseen[~near]
    return links


def _links(lists: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for v in batch.column(0) for x in forest(v.values.to_numpy(zero_copy_only=False), distance)]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return lists.select("members").mapInArrow(run, "a bigint, b bigint")


def near_links(values: DataFrame, distance: int = DISTANCE, direct: int = DIRECT) -> DataFrame:
    """Links `(a, b)` that join exactly the components of distinct `fingerprint` values.

    Values meet on their blocks. A key that more than `direct` values share is split once more: its
    free bits are cut into blocks again, so that at most a few hundred thousand values, as many as the
    bits left free can form, share a key. No key is dropped.
    """
    masks = block_masks(list(range(64)), distance)
    keyed = values.select("fingerprint", F.inline(_keys(F.col("fingerprint"), masks)))
    shared = scratch(keyed.groupBy("m", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "blocks")
    met = keyed.join(shared, ["m", "block"])
    few = met.filter(F.col("n") <= direct).groupBy("m", "block")
    found = _links(few.agg(F.collect_list("fingerprint").alias("members")), distance)
    if shared.filter(F.col("n") > direct).isEmpty():
        return found
    many = met.filter(F.col("n") > direct)
    for k, mask in enumerate(masks):
        finer = [mask | x for x in block_masks([b for b in range(64) if not mask >> b & 1], distance)]
        part = many.filter(F.col("m") == k).select("fingerprint", F.inline(_keys(F.col("fingerprint"), finer)))
        found = found.union(_links(part.groupBy("m", "block").agg(F.collect_set("fingerprint").alias("members")), distance))
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """`(key, fingerprint bigint, component_id)` for every row: rows whose fingerprints are linked by
    steps of at most `distance` bits share the smallest key as their component.

    Exact copies are one value from the start, so a group of copies costs one row per copy and no pair.
    Null or empty texts have the fingerprint 0, which is linked like any other. Repeated rows come
    back as often as they went in. A null key never names a component unless all keys of it are null.
    An empty table gives an empty table.
    """
    marked = scratch(fingerprints(docs, key, text), "fingerprints")
    values = scratch(marked.groupBy("fingerprint").agg(F.min("key").alias("first")), "values")
    linked = scratch(near_links(values, distance), "links")
    roots = scratch(components(linked), "roots")
    rooted = values.join(roots, values["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    firsts = scratch(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = scratch(rooted.join(firsts, "root").select("fingerprint", "component_id"), "named")
    return marked.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` of which each group of near-duplicates keeps the one with the smallest key.

    Rows are told apart by a number that is written down with them. Of rows with one key the first
    counts; a row with a null key stays only where its group has no key at all.
    """
    held = numbered(docs)
    found = near_duplicates(held.select("row", F.col("doc")[text].alias("text")), "row", "text", distance)
    return keep_first(held, found.select("row", F.col("component_id").alias("group")), key)
