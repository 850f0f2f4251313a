import hashlib
import itertools
import random
import re
import string
from html.parser import HTMLParser

import public_tokenizers as P
import pytest

from lectern.llm import html, secrets
from lectern.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p>One <b>two<br>three   four<p>Caf&eacute;&nbsp;&#233; &lt;x&gt;<ul><li>i<li>j</ul>
<div id="ad-1">Buy</div><form><input></form><section class="comments"><p>No</p></section></article>
<aside>Side</aside><footer>&copy;</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (PAGE, "Title & more\nOne two three four\nCafé é <x>\ni\nj"),
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<!-- <p>no -->b</p>", "ab"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<p>a < b & c &notanentity; <", "a < b & c ¬anentity; <"),
        ("<main><p>in</main><p>out", "in"),
        ("<article></article><p>rest</p>", "rest"),
        ("<p>x<script>if (a<b) '</p>'</script>y", "xy"),
        ("<p title='a>b'>q</p><!-- open", "q"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<span hidden>h</span><i>k</i><p style='display: none'>z", "k"),
        ("<div>" * 5000 + "deep", "deep"),
        (
            '<article><h1>T</h1><h2 class="section-header">A</h2><p class="related-work">B</p><p id="search-results">D</p><p class="promotion-rules">E</p><h3 class="header">H</h3><p>C</p></article>',
            "T\nA\nB\nD\nE\nH\nC",
        ),
        ('<main><div class="ad-2">x</div><div class="CookieNotice">y</div><section id="comments">z</section><div class="wide shareButtons share">s</div><p>t</main>', "t"),
        ('<div class="post"><p class="menu-design">one</p><p class="notice">no</p><div class="related-links">no</div><h2 id="banner">two</h2></div>', "one\ntwo"),
    ],
)
def test_main_text(source, text):
    assert html.main_text(source) == text


def test_templates_go_and_articles_stay(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = say(12)
    pages, want = [], {}
    for i in range(30):
        host = "a.example" if i < 20 else f"h{i}.example"
        own = [say(20), say(15)] + ([shared] if i % 4 == 0 else [])
        body = "".join(f"<p>{p}</p>" for p in own)
        pages.append((i, f"http://{host}/{i}", f"<body><div><p>All of {host}</p><p>same</p></div><div>{body}</div></body>"))
        lead = [] if i < 20 else [f"All of {host}", "same"]
        want[i] = "\n".join(lead + own)
    pages += [(50 + i, "http://copy.example/", pages[0][2]) for i in range(20)]  # copies of one page are no template
    pages += [(90, None, None), (91, "odd url", "<p>x"), (91, "odd url", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html.extract(df).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.text for r in rows}
    assert {i: got[i] for i in want} == want
    assert got[90] == "" and got[91] == "x" and "All of a.example" in got[55]
    assert html.extract(df.where("false")).count() == 0
    joined = html.extract(df, broadcast_bytes=0)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert html.extract(df.where("false"), broadcast_bytes=0).count() == 0


def _boxed(rng, n):
    """Pages of one host with recurring boxes that neither element, role, class nor id gives away, and their texts."""
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    box, aside, inner, pages, want = say(9), say(7), say(8), [], {}
    for i in range(n):
        own = [say(20), say(15)]
        body = f"<p>{own[0]}</p>" + (f"<div><p>{inner}</p></div>" if i % 2 else "") + f"<p>{own[1]}</p><p>ok</p>"
        body = f"<article>{body}</article>" if i % 3 else f"<div>{body}</div>"
        pages.append((i, "http://big.example/", f"<body>{f'<div>{box}</div>' if i % 5 < 2 else ''}{body}<div><span>{aside}</span></div></body>"))
        want[i] = "\n".join([*own, "ok"])
    return pages, want


@pytest.mark.parametrize("bytes_", [None, 0])
def test_recurring_boxes_inside_and_without_an_article(spark, bytes_):
    pages, want = _boxed(random.Random(6), 120)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as k", "1 as host", "2 as gone", "3 as p1", "4 as text")
    got = {r.page_id: r.text for r in html.extract(df, broadcast_bytes=bytes_).collect()}
    # the box on two pages of five, the one on all and the one within go; `ok` is too short to tell
    assert got == want
    without = {i: html.main_text(source) for i, _, source in pages}
    assert sum(without[i] != got[i] for i in want) > 60


def test_templates_decide_in_the_registered_query(spark, tmp_path, monkeypatch):
    """Pages without telling names: only recurrence takes the boxes away, and without templates they would stay."""
    pages, want = _boxed(random.Random(8), 120)
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    read = lambda: {r.page_id: r.text for r in QUERIES["op1_main_text"](spark, str(tmp_path)).collect()}
    assert read() == want
    monkeypatch.setattr(html, "OUTSIDE", ((10**9, 2, 0),))
    monkeypatch.setattr(html, "INSIDE", ((10**9, 2, 0),))
    plain = read()
    assert sum(plain[i] != want[i] for i in want) > 60


def test_few_words_stay_unless_most_pages_have_them(spark):
    pages = [(i, "http://t.example/", f"<body><table><tr><td>{'yes' if i % 3 else 'no'}<td>number {i}</table></body>") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: f"{'yes' if i % 3 else 'no'}\nnumber {i}" for i, _, _ in pages}


class Plain(HTMLParser):
    """The article by another parser: enough for the pages of the tables, which are well formed there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.skip = [[]], 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "form", "aside", "nav")
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("b", "i", "a", "em", "span", "strong"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "form", "aside", "nav")
        if tag not in ("b", "i", "a", "em", "span", "strong"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1].append(data)


def test_registered_query_against_another_parser(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    rows = QUERIES["op1_main_text"](spark, folder).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    got = {(r.page_id, r.url): r.text for r in rows}
    for p in pages:
        plain = Plain()
        plain.feed(p.html or "")
        plain.close()
        assert got[p.page_id, p.url] == "\n".join(t for b in plain.blocks if (t := " ".join("".join(b).split())))


# -- secrets --------------------------------------------------------------------------------------

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
ENCODER = secrets._encoder(VOCABULARY, P.PATTERN)


def literal(text):
    """The known shapes as stated: match, then drop what is too short."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]


def test_known_shapes():
    rng = random.Random(1)
    parts = ["password", "API_KEY", "apikey", " = ", ":", '"', "AKIA", "AKIAAKIA", "abcdef0123456789", "x" * 12, "ABCDEFGHIJKLMNOP", " ", "ſecret", "toKen", "0" * 15, "-", "日"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert secrets.base_spans(text) == literal(text), text


def test_random_strings_and_exclusions():
    rng = random.Random(3)
    found = lambda r: bool(secrets.random_spans(f"a {r} b", [], ENCODER))
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters, string.ascii_uppercase + string.digits):
        for size in (16, 20, 32):
            assert sum(found("".join(rng.choice(alphabet) for _ in range(size))) for _ in range(100)) >= 97
    for alphabet, mark in itertools.product((string.ascii_letters + string.digits, string.ascii_lowercase), ".-"):
        assert sum(found(mark.join("".join(rng.choice(alphabet) for _ in range(12)) for _ in range(3))) for _ in range(100)) >= 97
    assert not found("".join(rng.choice(string.ascii_letters) for _ in range(15)))
    plain = ["192.168.100.200", "www.example.com/images/header.png", "com.example.project.module.ClassName", "MAX_BUFFER_SIZE_LIMIT", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "4111-1111-1111-1111-2222", "some_long_identifier_name_2020", "internationalization", "path/to/some/document/of/2021"]
    assert not any(secrets.random_spans(f"a {r} b", [], ENCODER) for r in plain)
    key = "x9Kq2LmZt7Vb4NcR8pWyE3uH"
    assert secrets.random_spans(key, [("assign", 0, 5)], ENCODER) == [("random", 5, 24)]
    assert secrets.random_spans(key, [("assign", 0, 9)], ENCODER) == []
    assert secrets.random_spans(key, [("assign", 6, 7), ("hex", 8, 10)], ENCODER) == []


def test_random_spans_of_texts_with_many_known_shapes():
    """All parts of runs outside the known shapes, against a walk over every character."""
    rng = random.Random(8)
    part = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(10, 40)))
    for _ in range(40):
        text = " ".join(rng.choice([f'token = "{part()}"', part(), f"{part()}deadbeefdeadbeef01{part()}", "word.", f"{part()}.{part()}"]) for _ in range(30))
        base = secrets.base_spans(text)
        free = "".join(" " if any(a <= i < b for _, a, b in base) else c for i, c in enumerate(text))
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*", free):
            n = len(ENCODER.encode_ordinary(m[0]))
            whole = re.search(r"[A-Za-z0-9+/_=.-]*$", text[: m.start()])[0] + re.match(r"[A-Za-z0-9+/_=.-]*", text[m.start() :])[0]
            if len(m[0]) >= 16 and len(whole) >= 16 and not secrets.is_known(m[0], ENCODER) and len(m[0]) < n * (2.0 if len(m[0]) >= 20 else 1.75):
                want.append(("random", m.start(), m.end()))
        assert secrets.random_spans(text, base, ENCODER) == want


def test_registered_query_against_the_stated_shapes(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_secrets"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        spans = literal(docs[r.doc_id])
        assert [sum(k == kind for k, _, _ in spans) for kind in secrets.BASE_KINDS] == [r.n_assign, r.n_access, r.n_hex]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if not s.startswith("random")] == base.split(",")


def test_report(spark, odd_docs, no_docs):
    text = "é token = 'x9Kq2LmZt7Vb4NcR' and x9Kq2LmZt7Vb4NcR8pWyE3uH deadbeefdeadbeef"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.report(secrets.scan(df, VOCABULARY, P.PATTERN)).collect()}
    base = "assign:2:27,hex:58:74"
    assert (rows[1].n_assign, rows[1].n_access, rows[1].n_hex) == (1, 0, 1)
    assert rows[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[1].spans == "assign:2:27,random:33:57,hex:58:74"
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(odd_docs, VOCABULARY, P.PATTERN).count() == odd_docs.count()
    assert secrets.scan(no_docs, VOCABULARY, P.PATTERN).count() == 0
