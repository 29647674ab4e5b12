"""WARC archives: writing records in segments, reading them back, and putting the segments together."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailverdict.llm.common import Tables, release, scratch
from mailverdict.session import shared_dir

VERSION = "WARC/1.1"
SEGMENT_CHARS = 16_384  # text of one segment's block, at most
CHUNK_CHARS = 4_096
DATE = "2024-01-01T00:00:00Z"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: 160 bits are 32 digits of 5 bits."""
    digits = F.sha1(payload)
    parts = (F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4))
    return F.translate(F.upper(F.concat(*parts)), HEX32, BASE32)


def planned(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """`(page_id, url, html, row, payload_bytes, digest, record_type, refers_to)` per page row.

    Of the rows with equal payloads of `at_least` bytes the one with the largest page id is the response
    and the others revisit it. Shares of a digest are combined before they are shuffled, and what comes
    back per digest is a table, so Spark can split the rows of a payload that much of the web serves.
    """
    own = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row")
    )
    bytes_ = F.encode(F.col("html"), "UTF-8")
    held = scratch(own.withColumn("payload_bytes", F.octet_length("html").cast("bigint")).withColumn("digest", payload_digest(bytes_)), "pages")
    # rows without an id come last, and among equal ids the first row is the response
    rank = F.struct(F.col("page_id").isNotNull(), F.col("page_id"), -F.col("row"))
    shared = held.filter(F.col("payload_bytes") >= at_least).groupBy("digest").agg(F.max(F.struct(rank.alias("r"), "page_id", "row")).alias("best"))
    best = scratch(shared.select("digest", F.col("best.page_id").alias("first_page"), F.col("best.row").alias("first_row")), "responses")
    keyed = held.select("row", "digest").join(best, "digest").filter("row <> first_row").select("row", "first_page", "first_row")
    revisits = scratch(keyed, "revisits")
    return held.join(revisits, "row", "left").withColumn(
        "record_type", F.when(F.col("first_row").isNull(), "response").otherwise("revisit")
    )


def _record_id(row: Column) -> Column:
    return F.concat(F.lit("<urn:x-page-record:"), row.cast("string"), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """`Name: value` lines; a null value leaves its line out."""
    return F.concat_ws("", *(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in fields))


def _safe(url: Column) -> Column:
    return F.regexp_replace(url, r"[\r\n]", "%0A")


def _pieces(text: Column, size: int) -> Column:
    """A text cut into pieces of `size` characters in one pass; none of an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))


def records(plan: DataFrame, segment: int = SEGMENT_CHARS, chunk: int = CHUNK_CHARS) -> DataFrame:
    """`(value, later)`: every WARC record as text, without the two line ends that close it.

    A response holds an HTTP message whose body is framed in chunks. A message longer than `segment`
    characters is cut: the first part stays in the response, the others are continuation records that
    name it, and the last of them states the length of the whole. A revisit has the headers alone.
    """
    framed = F.array_join(
        F.transform(
            _pieces(F.col("html"), chunk),
            lambda c: F.concat(F.lower(F.conv(F.octet_length(c).cast("string"), 10, 16)), F.lit("\r\n"), c, F.lit("\r\n")),
        ), "",
    )
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    message = F.when(F.col("record_type") == "response", F.concat(F.lit(head), framed, F.lit("0\r\n\r\n"))).otherwise(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    )
    parts = plan.withColumn("message", message).withColumn("of", F.ceil(F.length("message") / segment).cast("int"))
    cut = parts.select(
        "row", "page_id", "url", "digest", "record_type", "first_page", "first_row", "of", F.octet_length("message").alias("total"),
        F.posexplode(_pieces(F.col("message"), segment)).alias("k", "block"),
    )
    many, later = F.col("of") > 1, F.col("k") > 0
    fields = _lines(
        ("WARC-Type", F.when(later, "continuation").otherwise(F.col("record_type"))),
        ("WARC-Record-ID", F.when(later, F.concat(F.lit("<urn:x-page-record:"), "row", F.lit(":"), F.col("k") + 1, F.lit(">"))).otherwise(_record_id(F.col("row")))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", _safe(F.col("url"))),
        ("WARC-Payload-Digest", F.when(~later, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Page-ID", F.when(~later, F.col("page_id"))),
        ("WARC-Refers-To", F.when(~later, _record_id(F.col("first_row")))),
        ("WARC-Refers-To-Page-ID", F.when(~later, F.col("first_page"))),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Segment-Number", F.when(many, F.col("k") + 1)),
        ("WARC-Segment-Origin-ID", F.when(later, _record_id(F.col("row")))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("k") == F.col("of") - 1), F.col("total"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block")),
    )
    return cut.select(F.concat(F.lit(f"{VERSION}\r\n"), fields, F.lit("\r\n"), "block").alias("value"), later.alias("later"))


def write_archives(pages: DataFrame, path: str, at_least: int = 0, archives: int | None = None) -> None:
    """Write one record per page row, in gzipped WARC files below `path`.

    First records are written where their pages lie. Continuations are dealt out by a hash, so that the
    segments of one page lie in several files; only these are shuffled. Every record ends in two line ends,
    which is how Spark's text writer separates lines here, and Spark commits each file once, whatever
    happens to its task.
    """
    texts = records(planned(pages, at_least))
    parts = [F.xxhash64("value")] if archives is None else [archives, F.xxhash64("value")]
    dealt = texts.filter("NOT later").union(texts.filter("later").repartition(*parts)).select("value")
    dealt.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class _Bytes:
    """Bytes of a gzipped or plain archive, unpacked piece by piece."""

    def __init__(self, packed: bytes) -> None:
        self.packed, self.at, self.buffer = packed, 0, bytearray()
        self.unpack = zlib.decompressobj(31) if packed[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        piece = self.packed[self.at : self.at + (1 << 16)]
        self.at += len(piece)
        if not piece:
            return False
        while piece:
            if self.unpack is None:
                self.buffer += piece
                break
            self.buffer += self.unpack.decompress(piece)
            piece = b""
            if self.unpack.eof:  # a further gzip member may follow
                piece, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return None
        found = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def parse_archive(packed: bytes) -> Iterator[dict]:
    """Records of one archive; blocks are cut by their stated length, so they may hold anything.

    A record whose length is missing or no number counts as empty; reading goes on at the next line that begins a record.
    """
    source = _Bytes(packed)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while line := source.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        number = lambda name: int(fields[name]) if re.fullmatch("-?[0-9]{1,18}", fields.get(name, "")) else None  # noqa: E731, B023
        length = max(number("content-length") or 0, 0)
        yield {
            "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "segment": number("warc-segment-number"),
            "origin": fields.get("warc-segment-origin-id"), "total": number("warc-segment-total-length"),
            "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "page_id": number("warc-page-id"),
            "refers_to": number("warc-refers-to-page-id"), "refers_to_record": fields.get("warc-refers-to"),
            "length": length, "block": source.take(length),
        }


READ = (
    "record_id string, type string, segment int, origin string, total bigint, uri string, digest string, "
    "page_id bigint, refers_to bigint, refers_to_record string, length bigint, block binary"
)
_READ = pa.schema(
    [
        ("record_id", pa.string()), ("type", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()),
        ("uri", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
        ("refers_to_record", pa.string()), ("length", pa.int64()), ("block", pa.binary()),
    ]
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record below `path`, as `READ`. A task holds one packed archive and a few records of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                held, weight = [], 0
                for record in parse_archive(packed.as_py()):
                    held.append(record)
                    weight += record["length"]
                    if len(held) >= 1000 or weight > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, _READ)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def unchunk(body: bytes) -> bytes | None:
    """The body without its chunk framing; null if the framing is broken or ends early."""
    found, at = bytearray(), 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return bytes(found)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        found += body[at : at + size]
        at += size + 2


def _payload(message: bytes) -> bytes | None:
    head, mark, body = message.partition(b"\r\n\r\n")
    if not mark:
        return None
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: `READ` without segments, with `complete`, `payload` and `payload_ok`.

    Continuations are grouped by the record they name, put in order of their number and joined to it;
    records in one piece are not shuffled. `complete` holds if the numbers run from 1 without gap or
    repeat and the lengths add up to the stated total. `payload` is the body of the HTTP message without
    chunk framing, null if that is broken; `payload_ok` compares it with the digest the record states.
    A record's segments make one record, so their group is as large as that record. A continuation
    whose first record is missing comes back by itself, incomplete.
    """
    whole = found.filter("segment IS NULL").withColumn("complete", F.lit(True))
    own = [c for c in found.columns if c not in ("block", "segment", "origin", "total", "length")]
    parts = found.filter("segment IS NOT NULL").withColumn("of", F.coalesce("origin", "record_id"))
    # rows of segment 1 carry the fields; of the others only number and block matter
    first = F.min(F.struct(F.col("segment"), *own)).alias("first")
    blocks = F.array_sort(F.collect_list(F.struct("segment", "length", "block"))).alias("blocks")
    joined = parts.groupBy("of").agg(first, blocks, F.max("total").alias("stated"))
    numbers = F.transform("blocks", lambda b: b["segment"])
    length = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + F.octet_length(b["block"]))
    block = F.aggregate("blocks", F.lit(b""), lambda a, b: F.concat(a, b["block"]))
    complete = (numbers == F.sequence(F.lit(1), F.size("blocks"))) & F.coalesce(length == F.col("stated"), F.lit(False))
    rebuilt = joined.select(
        *(F.col("first")[c].alias(c) for c in own), length.alias("length"), block.alias("block"), complete.alias("complete")
    )
    names = [*own, "length", "block", "complete"]
    together = whole.select(*names).unionByName(rebuilt.select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, digests, blocks = (batch.column(batch.schema.get_field_index(c)) for c in ("type", "digest", "block"))
            bodies = [_payload(b.as_py() or b"") if t.as_py() == "response" else None for t, b in zip(kinds, blocks)]
            sums = [None if b is None else "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies]
            right = [None if s is None else s == d.as_py() for s, d in zip(sums, digests)]
            yield batch.drop_columns(["block"]).append_column("payload", pa.array(bodies, pa.binary())).append_column(
                "payload_ok", pa.array(right, pa.bool_())
            )

    schema = ", ".join(f"{c} {t}" for c, t in together.dtypes if c != "block") + ", payload binary, payload_ok boolean"
    return together.mapInArrow(run, schema)


def archived_pages(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Write `pages` as archives, read these back, and say per record what was read.

    `page_id, payload_bytes, payload_digest, record_type, refers_to, complete`. A revisit has no payload
    of its own: its size is that of the response it names. Null html is an empty payload; null urls leave
    their line out; a null page id leaves its number out and can be no response if equal payloads have
    one. Repeated rows are records of their own.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "llm-warc")
    tables = Tables()
    with tables.watch():
        write_archives(pages, path, at_least)
    tables.drop()  # what the writer has planned with is of no use to the reader
    release(pages)
    found = reassemble(read_archives(spark, path)).select(
        "record_id", "page_id", "type", "digest", "refers_to", "refers_to_record", "complete", "payload_ok",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )
    read = scratch(found, "read")
    sizes = read.filter("type = 'response'").select(F.col("record_id").alias("named"), F.col("payload_bytes").alias("named_bytes"))
    responses = read.filter("type = 'response'").select("*", F.col("payload_bytes").alias("bytes"))
    revisits = read.filter("type = 'revisit'").join(sizes, F.col("refers_to_record") == F.col("named"), "left")
    revisits = revisits.drop("named").withColumnRenamed("named_bytes", "bytes")
    return responses.unionByName(revisits).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.substring("digest", 6, 32).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to", (F.col("complete") & F.coalesce("payload_ok", F.lit(True))).alias("complete"),
    )
