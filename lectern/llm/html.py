"""Main text of web pages, with site templates removed.

Pages of one host repeat what is not their article. Every block element's
subtree is hashed, the hashes are counted per host over distinct pages, and
subtrees that recur across many pages of their host are deleted, before any
other choice is made. What is left loses the elements that never hold the
article (navigation, forms, notices, reader comments and so on, by element,
role, class or id), and of the rest the article, else the main element, else
the body is written out block by block.

How often is often: a block of a few words may come again by chance, so it is a
template only if most pages of the host have it; a longer one needs a smaller
share, and a larger one within an article or main element than outside.

The templates are broadcast while their size is below a bound. Beyond it each
page meets only its own subtrees' templates, in joins whose keys are subtrees
and pages, never hosts.

Defined results: null html is the empty page and gives the empty text; a null
or odd url belongs to the host ''; pages of any length are parsed whole, broken
markup included; an empty table gives an empty table; repeated pages count once
for the templates and are extracted row by row; other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, rejoin

#: A subtree is a template from (distinct pages of its host, share of them, words) on, one of:
OUTSIDE = ((3, 0.8, 0), (8, 0.1, 3))
#: and inside an article or main element, one of:
INSIDE = ((8, 0.8, 0), (30, 0.3, 5))
#: Subtrees of an output batch; bounds the memory of a worker.
OUT_ROWS = 8192
#: Bytes of templates up to which they are broadcast, and bytes of one: its hash, its place in a set, its share of the host's name.
BROADCAST_BYTES, TEMPLATE_BYTES = 32 << 20, 160

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul caption head".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "html", "body", "head"}
#: Start tags that end an open element of the same kind, up to the element that bounds the search.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
    "body": (("head",), ("html",)),
}
_NEVER = frozenset(
    "nav header footer aside form script style noscript template iframe object embed svg canvas audio video select button "
    "textarea input datalist dialog menu head title search xmp noembed noframes map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside comment comments "
    "disqus respond reply replies menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar skip search hidden discussion".split()
)
_KEPT = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|--!>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0\s]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("name", "items", "drop", "inside")

    def __init__(self, name: str, drop: bool = False, inside: bool = False):
        self.name, self.items, self.drop, self.inside = name, [], drop, inside  # inside: an article or main element


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def _never(name: str, source: str, inside: bool) -> bool:
    """By element, role, class, id or hiddenness.

    Within an article or main element, and of a paragraph anywhere, a class or
    id tells only if all its words do (`ad-1`, `cookie-notice`, but not
    `related-work`); elsewhere one word is enough. A heading's never tells.
    What has other names is left to recurrence.
    """
    if name in _NEVER:
        return True
    if not source or name in _KEPT:
        return False
    a = _attributes(source)
    if a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if name in _HEADINGS:
        return False
    told = ([w for w in _SPLIT.split(n.lower() if n.isupper() else n) if w and not w.isdigit()] for n in [*a.get("class", "").split(), a.get("id", "")])
    enough = all if inside or name == "p" else any
    return any(words and enough(w.lower() in _NAMES for w in words) for words in told)


def parse(source: str) -> Node:
    """A tree of elements and texts; every document parses."""
    root = Node("html")
    stack = [root]
    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            stack[-1].items.append(source[at:])
            break
        if m.start() > at:
            stack[-1].items.append(source[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in ("article", "main", "body", "table") and name not in ("article", "main", "body", "html", "table", "div", "section"):
                    break
            if name == "p":
                stack[-1].items.append(Node("p"))
            continue
        if name == "html":
            continue
        if name in _CLOSES_P:
            _close(stack, ("p",), ("button", "td", "th", "table", "caption", "object"))
        if name in _ENDS:
            _close(stack, *_ENDS[name])
        inside = stack[-1].inside or stack[-1].name in ("article", "main")
        node = Node(name, _never(name, m[4], inside), inside)
        stack[-1].items.append(node)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
        elif name not in _VOID and not (m[4].endswith("/") and name in ("path", "circle", "rect")):
            stack.append(node)
    return root


def _close(stack: list[Node], names: tuple, bounds: tuple) -> None:
    """End the open elements of these names, outermost below a bound."""
    found = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in bounds:
            break
        if stack[i].name in names:
            found = i
    if found:
        del stack[found:]


def hashes(root: Node) -> dict[int, tuple[int, bool, int]]:
    """By id of each block element: the hash of its subtree, if it is in an article, and its words."""
    out: dict[int, tuple[int, bool, int]] = {}
    done: dict[int, tuple[str, int]] = {}
    work = [(root, False, False)]
    while work:  # no recursion: markup may be nested deeply
        node, inside, ready = work.pop()
        inside_own = inside or node.name in ("article", "main")
        if not ready:
            work.append((node, inside, True))
            work += [(x, inside_own, False) for x in node.items if isinstance(x, Node)]
            continue
        parts, words = [node.name], 0
        for x in node.items:
            if isinstance(x, Node):
                part, n = done.pop(id(x))
            else:
                own = x.split()
                part, n = " ".join(own), len(own)
            parts.append(part)
            words += n
        h = xxhash.xxh64_intdigest("\x00".join(parts))
        done[id(node)] = f"\x01{h:x}", words
        if node.name in _BLOCK:
            out[id(node)] = (h - (1 << 64) if h >= 1 << 63 else h, inside, words)
    return out


def _blocks(top: Node, gone: set[int]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush():
        if text := _SPACE.sub(" ", _html.unescape("".join(run))).strip():
            out.append(text)
        run.clear()

    work: list = [top]
    while work:
        x = work.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop or id(x) in gone:
            if x.name in _BLOCK:
                flush()
        elif x.name == "br":
            run.append(" ")
        else:
            if x.name in _BLOCK:
                flush()
                work.append(None)
            work += reversed(x.items)
    flush()
    return out


def _all(root: Node, name: str, gone: set[int]) -> list[Node]:
    """Outermost elements of this name that are not dropped."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if x.drop or id(x) in gone:
            continue
        if x.name == name:
            out.append(x)
        else:
            work += [y for y in reversed(x.items) if isinstance(y, Node)]
    return out


def main_text(source: str | None, templates: frozenset[tuple[int, bool]] | set = frozenset()) -> str:
    """Blocks of the article, joined by line feeds."""
    root = parse(source or "")
    gone = {k for k, v in hashes(root).items() if v[:2] in templates} if templates else set()
    for name in ("article", "main"):
        blocks = [b for top in _all(root, name, gone) for b in _blocks(top, gone)]
        if blocks:
            return "\n".join(blocks)
    return "\n".join(_blocks(root, gone))


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _subtrees(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, hash, inside, words, page, p1, p2) of the subtrees of each page, each once; hash 0 stands for the page.

    page is the hash of the parsed page, p1 and p2 name the source.
    """

    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def flushed(rows):
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, names=["host", "hash", "inside", "words", "page", "p1", "p2"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for u, source, p1, p2 in zip(*batch.columns, strict=True):
                root, same = parse(source.as_py() or ""), (p1.as_py(), p2.as_py())
                found, own = hashes(root), host(u.as_py())
                page = found.pop(id(root))[0]
                rows += [(own, *x, page, *same) for x in {(0, False, 0), *found.values()}]
                if len(rows) >= OUT_ROWS:  # a page's own subtrees and so many at most
                    yield flushed(rows)
        if rows:
            yield flushed(rows)

    kinds = "host string, hash long, inside boolean, words long, page long, p1 long, p2 long"
    return pages.select(url, html, *_source(html)).mapInArrow(run, kinds)


def _source(html: str):
    """128 bits that name the source of a page."""
    own = F.coalesce(F.col(html), F.lit(""))
    return F.xxhash64(own).alias("p1"), F.xxhash64(F.lit(1), own).alias("p2")


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Recurring subtrees: host, hash, inside (an article). Pages of the same content count once."""
    seen = _subtrees(pages, url, html).select("host", "hash", "inside", "words", "page")
    least = min(n for n, _, _ in OUTSIDE + INSIDE)
    counts = cut(seen.groupBy("host", "hash", "inside", "words").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least))
    every = counts.where("hash = 0").select("host", F.col("n").alias("pages"))

    def often(rules):
        n, share, words = F.col("n"), F.col("n") / F.col("pages"), F.col("words")
        found = F.lit(False)
        for least_n, least_share, least_words in rules:
            found = found | ((n >= least_n) & (share >= least_share) & (words >= least_words))
        return found

    rows = rejoin(counts.where("hash != 0"), every, ["host"])
    return rows.where(F.when(F.col("inside"), often(INSIDE)).otherwise(often(OUTSIDE))).select("host", "hash", "inside").distinct()


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int | None = None) -> DataFrame:
    """Per row: key, url and its main text."""
    bound = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    recurring = cut(templates(pages, url, html))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("k", "u")]
    if recurring.count() * TEMPLATE_BYTES <= bound:
        by_host: dict[str, set] = {}
        for r in recurring.collect():
            by_host.setdefault(r["host"], set()).add((r["hash"], r["inside"]))
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        gone_of = lambda u, _: shared.value.get(host(u.as_py()), ())
    else:
        own = rejoin(_subtrees(pages, url, html), recurring, ["host", "hash", "inside"])
        gone = own.groupBy("host", "p1", "p2").agg(F.collect_set(F.struct("hash", "inside")).alias("gone"))
        own_host = F.lower(F.regexp_extract(F.coalesce(F.col("u"), F.lit("")), _HOST.pattern, 1)).alias("host")
        rows = rejoin(rows.select("*", own_host, *_source("h")), gone, ["host", "p1", "p2"], "left").select("k", "u", "h", "gone")
        gone_of = lambda _, gone: {(g["hash"], g["inside"]) for g in gone.as_py() or ()}

    def run(batches):
        for batch in batches:
            last = batch.column(batch.num_columns - 1)  # the templates of the page, where they were joined
            texts = [main_text(source.as_py(), gone_of(u, g)) for u, source, g in zip(batch.column(1), batch.column(2), last, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k", "u", "t"])

    return rows.mapInArrow(run, f"k {kinds[0]}, u {kinds[1]}, t string").toDF(key, url, "text")
