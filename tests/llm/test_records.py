"""Archives, chat formatting and page extraction."""

import base64
import collections
import gzip
import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from mailverdict.llm import chat, extract, warc
from mailverdict.session import shared_dir
from tests.llm.conftest import sha

PAGES = "page_id bigint, url string, html string"


# ---- WARC ---------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é\U0001f600x" * 20_000
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (5, "http://b", "same"), (2, None, None), (3, "u\r\nWARC-Type: x", ""), (None, "http://n", "same"), (7, "http://c", big), (None, "http://m", "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("extra"))
    got = [tuple(r) for r in warc.archived_pages(pages).collect()]
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [
        (5, 4, digest("same"), "response", None, True), (5, 4, digest("same"), "revisit", 5, True), (1, 4, digest("same"), "revisit", 5, True),
        (None, 4, digest("same"), "revisit", 5, True), (3, 0, digest(""), "response", None, True), (2, 0, digest(""), "revisit", 3, True),
        (7, len(big.encode()), digest(big), "response", None, True), (None, 5, digest("alone"), "response", None, True),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(pages, at_least=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def segment(number, block, origin=None, total=None, kind="continuation", name="<r>"):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Segment-Number: {number}", f"Content-Length: {len(block)}"]
    lines += [f"WARC-Segment-Origin-ID: {origin}"] if origin else []
    lines += [f"WARC-Segment-Total-Length: {total}"] if total is not None else []
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_segments_from_several_files(spark, tmp_path):
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n4;x=y\r\ndefg\r\n0\r\n\r\n"
    parts = [message[:20], message[20:50], message[50:]]
    first = [segment(1, parts[0], kind="response", name=f"<{n}>") for n in ("whole", "short", "wrong")]
    rest = [segment(3, parts[2], "<whole>", len(message)), segment(3, parts[2], "<short>", len(message))]
    rest += [segment(2, parts[1], "<wrong>"), segment(3, parts[2], "<wrong>", 7), segment(2, parts[1], "<lost>")]
    (tmp_path / "a.warc").write_bytes(first[0] + first[1] + segment(2, parts[1], "<whole>"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(rest[0] + rest[2]) + gzip.compress(rest[1] + rest[3] + rest[4] + first[2]))
    rows = warc.reassemble(warc.read_archives(spark, str(tmp_path))).collect()
    got = {r.record_id: (r.complete, bytes(r.payload) if r.payload is not None else None) for r in rows}
    assert got["<whole>"] == (True, b"abcdefg")
    assert not got["<short>"][0] and not got["<wrong>"][0] and not got["<r>"][0]
    assert len(rows) == 4


@pytest.mark.parametrize(("body", "want"), [(b"0\r\n\r\n", b""), (b"2\r\nab\r\n0\r\n\r\n", b"ab"), (b"2\r\nab", None), (b"x\r\n", None), (b"", None), (b"3\r\nabXY0\r\n", None)])
def test_chunks(body, want):
    assert warc.unchunk(body) == want


def test_segments_lie_in_several_files(spark):
    path = shared_dir(spark, "segments")
    warc.write_archives(spark.createDataFrame([(1, "u", "ab" * 50_000)], PAGES), path, archives=4)
    found = warc.read_archives(spark, path)
    assert found.filter("type = 'continuation'").count() == 6
    assert found.filter("total IS NOT NULL").count() == 1


# ---- chat ---------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|x", "<\\\\|<|", "<", "|", "a<\\b", "<|im_start|>user\n<|im_end|>\n"])
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    turns = [("user", text), ("assi\nst\\nant", text), ("", text)]
    assert chat.read_back(chat.chatml(turns)) == turns


def rewriting(turns):
    """A template that keeps only the last user text, like those that drop old thoughts."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return "BOS" + "".join(f"[{r}]{t if r != 'user' or k == last else '...'};" for k, (r, t) in enumerate(turns))


def test_spans_loss_and_rewrites():
    turns = [("system", "s"), ("user", "aaa"), ("assistant", "a"), ("user", "b<|"), ("assistant", "]}")]
    done = chat.render_turns(turns)
    assert "".join(done.text[a:b] for a, b in done.spans) == done.text and done.rewrites == []
    assert [done.text[a:b] for a, b in done.loss] == ["a", "]}"]
    changed = chat.render_turns(turns, rewriting)
    assert changed.rewrites == [3]
    suffixed = chat.render_turns(turns, lambda x: chat.chatml(x) + "<eos>")
    assert [suffixed.text[a:b] for a, b in suffixed.loss][-1] == "]}"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "y<|im_end|>"), (1, 0, "user", "x"), (2, None, None, None), (2, 3, "assistant", ""), (None, 0, "assistant", "n"), (3, 0, "user", "d"), (3, 0, "user", "d")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"t{k}" * 40) for k in range(120)]
    df = spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].n_turns, got[1].turns_sha256) == (2, sha("user\nx\nassistant\ny<|im_end|>\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (11, sha("y<|im_end|>"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (2, sha("assistant\n\n\n\n"), 0)
    assert got[3].turns_sha256 == sha("user\nd\nuser\nd\n")
    assert got[4].loss_sha256 == sha("".join(t for _, k, _, t in rows[-120:] if k % 2))
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- pages --------------------------------------------------------------------------------------


def test_blocks():
    page = "<body><!-- <p>no</p> --><p>a <b>b</b>c<br>d&amp;&eacute;<p>e<ul><li><a href='x>y'>f</a><li>g</ul><script>'<p>'</script><title>t</title>h\n i</body> j"
    assert [text for _, text, _ in extract.blocks(page)] == ["a bc", "d&é", "e", "f", "g", "h i", "j"]
    assert [path for path, _, _ in extract.blocks(page)][3] == ("body", "p", "ul", "li")
    assert extract.blocks("") == [] and extract.blocks("<p") == []


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        scores, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(scores[k, y[k]] for k in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert tuple(extract.viterbi(scores, moves)) == max(itertools.product((0, 1), repeat=n), key=value)
        single, _ = extract._expected(scores, moves)
        weights = {y: np.exp(value(y)) for y in itertools.product((0, 1), repeat=n)}
        want = sum(w for y, w in weights.items() if y[0]) / sum(weights.values())
        assert single[0, 1] == pytest.approx(want)


def test_held_out_pages():
    field, rng = extract.model(), random.Random(123)
    right = total = 0
    for _ in range(150):
        page, main = extract.labelled_page(rng)
        got, want = (collections.Counter(t.split()) for t in (extract.main_text(page, field), main))
        right, total = right + 2 * (got & want).total(), total + got.total() + want.total()
    assert right / total > 0.98


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))
        want = re.sub(r"\s+", " ", html.unescape(plain)).strip()
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<nav>menu</nav>"), (2, "u", "<nav>menu</nav>"), (3, "u", "<article>" + "<p>A long sentence, with commas. " * 3000)]
    got = extract.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1))).collect()
    assert len(got) == 5
    assert {r.n_chars for r in got if r.page_id != 3} == {0}
    assert next(r for r in got if r.page_id == 3).n_chars == 30 * 3000 - 1
    assert extract.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("icon", "want"),
    [("<svg/>", ["a", "b"]), ('<svg class="x" />', ["a", "b"]), ('<SVG width="1"/>', ["a", "b"]), ("<svg hidden/>", ["a", "b"]),
     ("<svg width=1/>", ["a"]), ("<svg>x</svg>", ["a", "b"]), ("<script/>", ["a"])],
)
def test_svg_may_close_itself(icon, want):
    assert [text for _, text, _ in extract.blocks(f"<p>a</p>{icon}<p>b</p>")] == want


@pytest.mark.parametrize(
    ("tag", "want"),
    [("<p title=it's>", ["a", "b"]), ('<p title="x > y">', ["a", "b"]), ("<p title='x > y' id=c>", ["a", "b"]), ('<p title="abc>', ["a", "b"]),
     ("<p it's>", ["a", "b"]), ('<p title = "1>2" x=\'">\'>', ["a", "b"]), ("<p a==x>", ["a", "b"]), ("<p title=>", ["a", "b"]), ("<p '>", ["a", "b"])],
)
def test_quotes_count_only_behind_an_equals_sign(tag, want):
    assert [text for _, text, _ in extract.blocks(f"<h1>a</h1>{tag}b</p>")] == want


def test_hints_come_from_whole_attributes():
    def path(tag):
        return extract.blocks(f"{tag}x</div>")[0][0]

    assert path("<div class='main menu' id=nav ROLE=\"search\">") == ("div", ".main", ".menu", ".nav", ".search")
    assert path('<div title="class=menu" data-x=nav>') == ("div",)


def test_an_article_with_a_stray_quote_is_read_whole():
    page = "<article><h1>T</h1><p title=it's>Hello there, it's a fine long sentence for you.</p></article>"
    assert extract.main_text(page, extract.model()) == "T Hello there, it's a fine long sentence for you."


def test_damaged_record_lengths_end_no_task():
    sound = "WARC/1.1\r\nWARC-Record-ID: <s>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for wrong in ("Content-Length: five", "Content-Length: -3", "Content-Length: \u0665", "Content-Length:", "X: y", "Content-Length: " + "9" * 30):
        archive = f"WARC/1.1\r\nWARC-Record-ID: <d>\r\n{wrong}\r\n\r\nlost\r\n\r\n{sound}"
        got = [(r["record_id"], r["block"]) for r in warc.parse_archive(gzip.compress(archive.encode()))]
        assert got == [("<d>", b""), ("<s>", b"ok")], wrong


def test_a_very_long_page_comes_back_whole(spark):
    page = "\U0001f600é\n<p>x" * 1_500_000  # 15 MB
    got = warc.archived_pages(spark.createDataFrame([(1, "u", page), (2, "u", page[:-1])], PAGES)).collect()
    want = {i: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for i, t in ((1, page), (2, page[:-1]))}
    assert {r.page_id: r.payload_digest for r in got} == want and {r.payload_bytes for r in got} == {len(page.encode()), len(page.encode()) - 1}
