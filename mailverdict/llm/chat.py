"""Chat formatting through a template that is only ever called, never looked into."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Render = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>\n"
PROBES = ("\u0001", "\u0002")  # two one-character texts that differ everywhere
FORMATTED = "key {key}, n_turns bigint, formatted string, spans array<struct<first:bigint,last:bigint>>, loss array<struct<first:bigint,last:bigint>>, rewrites array<int>"


def escape(text: str) -> str:
    """Make control strings plain: one backslash more between `<` and `|` wherever these meet."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _one_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def chatml(turns: list[Turn]) -> str:
    """The default template: a start mark, the role, the escaped text, an end mark."""
    return "".join(f"{START}{_one_line(role)}\n{escape(text)}{END}" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a text that `chatml` made."""
    found = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        found.append((_role(role), unescape(text)))
    return found


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn
    loss: list[tuple[int, int]]  # of the texts to be learned
    rewrites: list[int]  # turns at which the template changed what it had written


def render_turns(turns: list[Turn], render: Render = chatml, learn: str = "assistant") -> Rendered:
    """Render every prefix of the conversation and find each turn where the output grew.

    What consecutive outputs share from the start is kept history, and the rest is the new turn. If the
    earlier output does not come back whole, the template rewrites history: the turn is reported, and
    spans are those of the last, full output from there on. The text of a turn to be learned lies where
    the outputs for two different probe texts differ.
    """
    whole = render(turns)
    spans, loss, rewrites, before = [], [], [], render([])
    for k, (role, text) in enumerate(turns):
        now = whole if k == len(turns) - 1 else render(turns[: k + 1])
        kept = len(before) if now.startswith(before) else _common(before, now)
        if kept < len(before):
            rewrites.append(k)
        spans.append((kept, len(now)))
        if role == learn:
            a, b = (render([*turns[:k], (role, probe)]) for probe in PROBES)
            first = _common(a, b)
            tail = len(a) - first - 1
            loss.append((first, len(now) - tail))
        before = now
    return Rendered(whole, spans, loss, rewrites)


def format_conversations(turns: DataFrame, key: str = "conv_id", render: Render = chatml) -> DataFrame:
    """Per conversation `key, n_turns, formatted, spans, loss, rewrites`; places are code points.

    Turns come in order of `turn`, null last; rows that share a turn number, and repeated rows, all stay
    and are ordered by role and text, so reruns agree. Null roles and texts are empty, the null key is
    one conversation. A conversation is one text in the end, so it is rendered by one task; rendering all
    its prefixes takes time in the square of its turns, and memory for two of them.
    """
    spoken = F.struct(
        F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = turns.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(spoken)).alias("turns"))
    kind = turns.schema[key].dataType.simpleString()
    schema = FORMATTED.format(key=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        ranges = lambda x: [{"first": a, "last": b} for a, b in x]
        for batch in batches:
            for k in range(batch.num_rows):
                said = [(t["role"], t["text"]) for t in batch.column(1)[k].as_py()]
                done = render_turns(said, render)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, 1), pa.array([len(said)], pa.int64()), pa.array([done.text], pa.string()),
                        pa.array([ranges(done.spans)], pair), pa.array([ranges(done.loss)], pair),
                        pa.array([done.rewrites], pa.list_(pa.int32())),
                    ],
                    names=["key", "n_turns", "formatted", "spans", "loss", "rewrites"],
                )

    return gathered.mapInArrow(run, schema).withColumnRenamed("key", key)


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted text says when it is read back: digests of its turns and of the learned text."""
    kind = formatted.schema[key].dataType.simpleString()
    hexed = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def one(text: str, loss: list[dict]) -> tuple:
        said = read_back(text)
        learned = "".join(unescape(text[x["first"] : x["last"]]) for x in loss)
        return len(said), hexed("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), hexed(learned), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py(), x.as_py()) for t, x in zip(batch.column(1), batch.column(2))]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                names=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(key, "formatted", "loss").mapInArrow(run, schema).withColumnRenamed("key", key)
