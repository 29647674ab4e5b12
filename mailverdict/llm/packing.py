"""Packing of documents into sequences of tokens, neighbours along a space-filling curve."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailverdict.llm.common import scratch

SIZE = 1024
END = 0  # the id behind every document
FEATURES = 256  # hashed dimensions of a document's vector
AXES, BITS = 4, 15  # dimensions it is projected to, bits of each on the curve
SCALE = 1 << 20
SEED = 42
MEMO = 1_000_000  # pieces of text whose ids a worker keeps
#: A space at either end, or beside another white space of any kind.
_WIDE = r"^ | $|[\t-\r\x1c-\x1f\x{85}\pZ] | [\t-\r\x1c-\x1f\x{85}\pZ]"
BATCH = 24 << 20  # bytes of text that are tokenized at once


def token_ids(state: dict, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts behind each other, and how many of them are each text's.

    Byte-level pre-tokenizers split at a single space between two characters that are not white space, whatever
    stands around it. So a text's ids are those of its parts, each with the space before it; parts come
    back so often that tokenizing each different one once saves most of the work. Texts with other spaces are
    tokenized whole. `state` holds the tokenizer's file, and for the worker's next call the tokenizer
    and the ids of the parts it has met.
    """
    if "tokenizer" not in state:
        tokenizer = state["tokenizer"] = Tokenizer.from_str(state["json"])
        vocabulary = tokenizer.get_vocab()
        state["opens"] = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        state["opens"][[number for name, number in vocabulary.items() if name.startswith("Ġ")]] = True
        state["memo"] = {}
    encode = lambda many: [np.array(e.ids, "<u4").tobytes() for e in state["tokenizer"].encode_batch_fast(many, add_special_tokens=False)]
    wide = pc.match_substring_regex(texts, _WIDE)
    parts = pc.split_pattern(pc.if_else(wide, "", texts), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = offsets[:-1] - offsets[0]  # the first part of a text has no space before it
    which[heads] = len(coded.dictionary) + np.arange(len(heads))
    whole = zip(wide.to_pylist(), texts.to_pylist(), coded.dictionary.take(coded.indices.take(pa.array(heads))).to_pylist())
    values = _ids_of(state, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), encode) + encode([text if w else head for w, text, head in whole])
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    firsts, counts = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(counts)
    places = np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    totals = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(values), "<u4")[places], totals


def _ids_of(state: dict, parts: list[str], encode: Callable) -> list[bytes]:
    """The ids of different parts, each read with a space before it."""
    memo = state["memo"]
    if len(memo) > MEMO:
        memo.clear()
    values = list(map(memo.get, parts))
    fresh = [p for p, v in zip(parts, values) if v is None]
    for k in range(0, len(fresh), 1 << 16):
        some = fresh[k : k + (1 << 16)]
        (raw,) = encode([" " + " ".join(some)])
        starts = np.flatnonzero(state["opens"][np.frombuffer(raw, "<u4")]) * 4
        if len(starts) == len(some):  # one string, which falls into parts again where a token begins with the space
            memo.update((p, raw[a:b]) for p, a, b in zip(some, starts.tolist(), [*starts[1:].tolist(), len(raw)]))
        else:
            memo.update(zip(some, encode([" " + p for p in some])))
    return [memo[p] if v is None else v for p, v in zip(parts, values)]


def projection() -> np.ndarray:
    """Fixed random directions."""
    return np.random.default_rng(SEED).standard_normal((FEATURES, AXES))


def coordinates(ids: np.ndarray, axes: np.ndarray) -> list[int]:
    """The projected, hashed vector of a document: logarithms of token counts, of length one, times `SCALE`."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    vector = np.log1p(np.bincount(bucket.astype(np.int64), minlength=FEATURES))
    return np.rint(vector / max(np.linalg.norm(vector), 1.0) @ axes * SCALE).astype(np.int64).tolist()


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits, one row each (Skilling, 2004)."""
    x = points.T.astype(np.int64).copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(set_, x[i], x[i] ^ swap) if i else x[0]
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def _tokenized(docs: DataFrame, key: str, text: str, state: Broadcast, width: int) -> DataFrame:
    """`(key, row, n, place, ids)`; ids take `width` bytes each."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = projection()
        for whole in batches:
            texts = pc.fill_null(whole.column(1), "")
            bytes_ = np.cumsum(pc.binary_length(texts).to_numpy()) // BATCH
            edges = [0, *(np.flatnonzero(np.diff(bytes_)) + 1).tolist(), whole.num_rows]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                ids, sizes = token_ids(state.value, texts.slice(first, last - first))
                ends = np.cumsum(sizes)
                places = [coordinates(ids[b - n : b], axes) for n, b in zip(sizes.tolist(), ends.tolist())]
                ids = np.insert(ids, ends, END).astype(f"<u{width}")
                edge = width * np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edge), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(whole.column(c).slice(first, last - first) for c in (0, 2)), pa.array(sizes + 1),
                        pa.array(places, pa.list_(pa.int64())), raw.cast(pa.binary()),
                    ],
                    names=["key", "row", "n", "place", "ids"],
                )

    rows = docs.select(key, text, F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"key {kind}, row bigint, n bigint, place array<bigint>, ids binary")


def _on_curve(places: DataFrame) -> DataFrame:
    """`(row, n, curve)`: each document's place on the curve; axes are centred and scaled over all documents."""
    number = [f"cast(place[{k}] as decimal(20, 0))" for k in range(AXES)]  # whole numbers, so sums do not depend on their order
    sums = places.agg(F.count(F.lit(1)), *(F.expr(f"sum({x})") for x in number), *(F.expr(f"sum({x} * {x})") for x in number)).first()
    count, totals = max(sums[0], 1), [float(x or 0) for x in sums[1:]]
    middle = np.array(totals[:AXES]) / count
    spread = np.sqrt(np.maximum(np.array(totals[AXES:]) / count - middle**2, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(batch.column(2).to_pylist(), np.float64).reshape(-1, AXES)
            even = 0.5 + 0.5 * np.tanh(0.8 * (found - middle) / spread)  # about evenly spread where places are normal
            cells = np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_keys(cells), pa.int64())], names=["row", "n", "curve"])

    return places.select("row", "n", "place").mapInArrow(run, "row bigint, n bigint, curve bigint")


def _in_order(places: DataFrame) -> DataFrame:
    """`(row, part, before)`: the range along the curve a document lies in, and the tokens before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = before + np.cumsum(sizes)
            columns = [batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(ends - sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "part", "before"])
            before = int(ends[-1]) if batch.num_rows else before

    ordered = _on_curve(places).repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    return ordered.select("row", "n").mapInArrow(run, "row bigint, n bigint, part bigint, before bigint")


def cuts(first: int, length: int, total: int, size: int = SIZE) -> list[tuple[int, int, int]]:
    """Pieces `(length, sequence, offset)` of the tokens `[first, first + length)` of a stream of `total`.

    Sequences hold `size` tokens each; what is left at the end goes into sequences of falling powers of
    two, which need no padding either.
    """
    found, at, end = [], first, first + length
    full = total // size
    while at < end:
        if at < full * size:
            sequence, offset = divmod(at, size)
            room = size - offset
        else:
            sequence, offset, rest = full, at - full * size, total - full * size
            while offset >= (span := 1 << (rest.bit_length() - 1)):
                sequence, offset, rest = sequence + 1, offset - span, rest - span
            room = span - offset
        taken = min(room, end - at)
        found.append((taken, sequence, offset))
        at += taken
    return found


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces `(key, start, length, ids, doc_tokens, sequence_id, offset)` of all documents in sequences of `size` tokens.

    `vocabulary` is the driver's path of a byte-level `tokenizers` file. Each text's ids, without special tokens
    added, end with the id 0. `ids` are the piece's, as unsigned 32-bit little-endian numbers; `start`
    counts the document's ids before the piece. Sequences have no gap and no padding: all but the last hold `size`
    tokens, the last ones falling powers of two (`size` is itself one).

    Documents are hashed to vectors, projected to four dimensions, and sorted by ranges of their place
    on a Hilbert curve, so a sequence holds neighbours. Documents at one place, such as copies, are sorted by their
    row's number, so that a large group of copies takes many ranges. Only row numbers and counts are sorted;
    ids are shuffled once, to meet their document's place. What is sent to the
    driver or broadcast is the vocabulary and one number per range. Rows stay apart: repeated rows and null keys are
    packed like any others. A null or empty text is the id 0 alone; an empty table gives no piece.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        state = spark.sparkContext.broadcast({"json": file.read()})  # workers keep it, and what is added to it, between tasks
    width = 2 if max(Tokenizer.from_str(state.value["json"]).get_vocab().values(), default=0) < 1 << 16 else 4
    kind = docs.schema[key].dataType.simpleString()
    tokenized = scratch(_tokenized(docs, key, text, state, width), "tokens", compression="zstd")
    order = scratch(_in_order(tokenized.select("row", "n", "place")), "order")
    sums = sorted((r.part, r.n) for r in order.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per range
    total = sum(n for _, n in sums)
    starts = dict(zip((part for part, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, values = [], [], []
            for k, (part, before, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                ids, start = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes(), 0
                for piece in cuts(starts[part] + before, len(ids) // 4, total, size):
                    rows.append(k)
                    pieces.append((start, *piece, len(ids) // 4))
                    values.append(ids[4 * start : 4 * (start + piece[0])])
                    start += piece[0]
            start, length, sequence, offset, count = (pa.array(c, pa.int64()) for c in zip(*pieces)) if pieces else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), start, length, pa.array(values, pa.binary()), count, sequence, offset],
                names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    # a place is some bytes where a document's ids are thousands, so places are hashed and ids need no sort
    placed = tokenized.select("key", "row", "ids").join(order.drop("n").hint("shuffle_hash"), "row").select("key", "part", "before", "ids")
    schema = f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(run, schema).withColumnRenamed("key", key)


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
