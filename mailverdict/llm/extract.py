"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
#: Words in class or id values that say what a block is for.
HINTS = (
    "ad ads advert banner sponsor promo nav menu header footer sidebar aside cookie notice consent popup modal comment comments reply form "
    "newsletter subscribe share social related breadcrumb pagination widget login search article content main post entry story body text"
).split()
HASHED = 1 << 13
EPOCHS, RATE, PENALTY = 12, 0.3, 1e-4
TRAINING_PAGES, SEED = 400, 7
LABELS = 2  # 0: surroundings, 1: main text

_CLOSED = re.compile(r"""(?:<svg|[\s"']|\s[^\s"'=]+)/>\Z""", re.I)  # not after a value without quotes, which the / belongs to
# quotes hold a value only right behind the =; one that is never closed is part of a value without quotes
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s>]*)*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S*)))?""")
_TELLING = frozenset(("class", "id", "role"))
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

Block = tuple[tuple[str, ...], str, int]  # path of tags and hints, text, characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text between block tags, with all tags open around it.

    Inline tags stay inside a block. Closing tags close what is open inside them; stray ones are ignored.
    Scripts, styles, comments and declarations hold no text.
    """
    found: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            found.append((tuple(x for name, hints in open_ for x in (name, *hints)), joined, linked))
        text.clear()
        linked = 0

    while True:
        tag = _TAG.search(page, at)
        piece = page[at : tag.start() if tag else len(page)]
        text.append(piece)
        linked += len(piece) if links else 0
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in RAW and not closing:
            flush()
            if name == "svg" and _CLOSED.search(tag[0]):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            links = max(links + (-1 if closing else 1), 0)
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if not closing:
            # a paragraph, list item or table cell ends where the next one begins
            if open_ and open_[-1][0] == name and name in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                open_.pop()
            values = " ".join(" ".join(m[1:]) for m in _ATTRIBUTE.findall(tag[3] or "") if m[0].lower() in _TELLING).lower()
            open_.append((name, tuple(f".{w}" for w in dict.fromkeys(_WORD.findall(values)) if w in HINTS)))
        else:
            places = [k for k, (x, _) in enumerate(open_) if x == name]
            if places:
                del open_[places[-1] :]
    flush()
    return found


def _slot(feature: str) -> int:
    value = 2166136261
    for byte in feature.encode("utf-8", "surrogatepass"):
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return value % HASHED


def features(page: list[Block]) -> list[list[int]]:
    """Active features of each block: ancestors, hints of class and id, and what the text looks like."""
    rows, slots = [], {}
    for k, (path, text, linked) in enumerate(page):
        n = len(text)
        share = min(linked / max(n, 1), 1.0)
        names = {f"in {x}" for x in path} | {f"leaf {path[-1] if path else ''}", "bias"}
        names |= {
            f"size {min(int(math.log2(n + 1)), 10)}", f"links {int(share * 4)}", f"ends {text[-1] in '.!?…»”'}",
            f"commas {min(text.count(','), 3)}", f"first {k == 0}", f"last {k == len(page) - 1}", f"mark {text[0] in '©|•'}",
        }
        for name in names:
            if name not in slots:
                slots[name] = _slot(name)
        rows.append([slots[x] for x in sorted(names)])
    return rows


def _scores(rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[row].sum(axis=0) for row in rows])


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best label sequence for block scores and transition scores."""
    best, back = scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    label = int(best.argmax())
    labels = [label]
    for step in reversed(back):
        label = int(step[label])
        labels.append(label)
    return labels[::-1]


def _expected(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probabilities of labels and of label pairs, by the forward-backward recursion."""
    n = len(scores)
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for k in range(1, n):
        ahead[k] = np.logaddexp.reduce(ahead[k - 1][:, None] + moves, axis=0) + scores[k]
    for k in range(n - 2, -1, -1):
        behind[k] = np.logaddexp.reduce(moves + (scores[k + 1] + behind[k + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(ahead[-1])
    pairs = np.zeros((LABELS, LABELS))
    for k in range(n - 1):
        pairs += np.exp(ahead[k][:, None] + moves + (scores[k + 1] + behind[k + 1])[None, :] - total)
    return np.exp(ahead + behind - total), pairs


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the field, by stochastic gradient ascent on the log likelihood of labelled pages."""
    weights, moves, order = np.zeros((HASHED, LABELS)), np.zeros((LABELS, LABELS)), random.Random(SEED)
    turns = list(range(len(pages)))
    for epoch in range(epochs):
        order.shuffle(turns)
        rate = RATE / (1 + epoch)
        for k in turns:
            rows, labels = pages[k]
            if not rows:
                continue
            single, pairs = _expected(_scores(rows, weights), moves)
            for row, label, p in zip(rows, labels, single):
                step = -p
                step[label] += 1
                weights[row] += rate * (step - PENALTY * weights[row])
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] -= 1
            moves -= rate * (pairs + PENALTY * moves)
    return weights, moves


def labelled_page(rng: random.Random) -> tuple[str, str]:
    """A page with known main text, put together from the ways in which sites mark their parts.

    Returns the page and the main text. Words are made up; the parts, their tags and class names vary.
    """

    def words(low: int, high: int) -> str:
        syllables = "the an of re con ti ver sch que la mo il ble ing der ai"
        said = ["".join(rng.choices(syllables.split(), k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(w.capitalize() if k == 0 or rng.random() < 0.05 else w for k, w in enumerate(said))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def sentence() -> str:
        return ", ".join(words(3, 12) for _ in range(rng.randint(1, 3))) + rng.choice("....!?")

    said: list[str] = []

    def main_block() -> str:
        kind = rng.random()
        body = " ".join(sentence() for _ in range(rng.randint(1, 6))) if kind < 0.75 else words(1, 9)
        inner = body.replace(" ", rng.choice([" ", " ", "\n  "]), 1)
        if rng.random() < 0.25:
            first, _, rest = inner.partition(" ")
            inner = f"<b>{first}</b> {rest}" if rest else f"<em>{first}</em>"
        said.append(_SPACE.sub(" ", body).strip())
        if rng.random() < 0.1:
            return f"<ul><li>{inner}</li></ul>"
        tag = rng.choice(["p", "p", "p", "p", "p", "h2", "blockquote", "div"])
        return f"<{tag}>{inner}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>")

    name = lambda *xs: rng.choice(xs)
    tops = [
        f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>", f'<div class="{name("menu", "nav main-menu", "navbar nav")}"><ul>{links(rng.randint(2, 8))}</ul></div>',
        f'<header><a href="/">{words(1, 3)}</a><p>{sentence()}</p></header>', f'<div id="header"><h2>{words(1, 4)}</h2></div>',
        f'<div class="{name("ad", "ads", "advert", "banner ad", "sponsor")}">{sentence()}</div>', f"<div class='{name('cookie notice', 'notice', 'consent')}'><p>{sentence()}</p></div>",
        f'<form action="/s"><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button></form>', f'<div class="breadcrumb"><a href="/">{words(1, 2)}</a> &gt; {words(1, 2)}</div>',
    ]
    sides = [
        f"<aside><h3>{words(1, 3)}</h3><p>{sentence()}</p></aside>", f'<div class="{name("sidebar", "sidebar widget", "related")}"><h3>{words(1, 3)}</h3><ul>{links(3)}</ul></div>',
        f'<div class="{name("ad", "promo", "advert", "sponsor")}"><p>{sentence()}</p></div>', f'<div class="{name("share social", "newsletter", "subscribe")}">{words(2, 6)}</div>',
    ]
    remarks = "".join(f'<div class="comment"><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.randint(1, 4)))
    ends = [
        f'<section class="{name("comments", "comment list")}"><h3>{words(1, 2)}</h3>{remarks}</section>', f'<div id="comments">{remarks}</div>',
        f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>", f'<div class="footer"><p>{sentence()}</p></div>', f"<form><p>{sentence()}</p><textarea>{words(1, 4)}</textarea></form>",
    ]
    pick = lambda parts, most: "".join(rng.sample(parts, rng.randint(0, most)))
    title = words(2, 10)
    said.append(title)
    inside = f"<h1>{title}</h1>" + "".join(main_block() + (rng.choice(sides) if rng.random() < 0.08 else "") for _ in range(rng.randint(1, 14)))
    opening, closing = rng.choice(
        [("<article>", "</article>")] * 4
        + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main" class="post entry">', "</div>"), ('<div class="article-body">', "</div>"), ("<div>", "</div>"), ("", "")]
    )
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{pick(tops, 4)}{opening}{inside}{closing}"
        f"{pick(sides, 2)}{pick(ends, 3)}<script>var x = '<p>{words(1, 2)}</p>';</script></body></html>"
    )
    return page, " ".join(said)


def labelled(pages: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of generated pages: a block is main text if it is one of the page's main parts."""
    rng, rows = random.Random(seed), []
    for _ in range(pages):
        page, main = labelled_page(rng)
        found, labels, at = blocks(page), [], 0
        for _, text, _ in found:
            here = main.startswith(text, at)
            labels.append(int(here))
            at += len(text) + 1 if here else 0
        rows.append((features(found), labels))
    return rows


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    """The field trained on the labelled pages, in a few seconds, once per process; always the same one."""
    return train(labelled())


def main_text(page: str | None, field: tuple[np.ndarray, np.ndarray]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    weights, moves = field
    labels = viterbi(_scores(features(found), weights), moves)
    return " ".join(text for (_, text, _), label in zip(found, labels) if label)


def extract(pages: DataFrame) -> DataFrame:
    """Per page row `page_id, url, text, n_chars`: the main text, its blocks in order and joined by spaces.

    Null and empty pages, and pages without main text, give an empty text. Repeated rows, null ids and
    null addresses come back as they are. Whole pages are read, however long; nothing is shuffled.
    """
    spark = pages.sparkSession
    field = spark.sparkContext.broadcast(model())  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), field.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
