"""Main text of web pages by equivalence-class template deduction.

Every page is read as a sequence of structural tokens: its elements by their path of tags and classes (or ids, digits
aside). Over the pages of one host, tokens with the same occurrence vector (equally many on every page) form an
equivalence class. In a class whose pages differ, the tokens that have the same text on all of them are the host's
template. So are blocks of words, told apart by path and text, whose vector is that of the element around them, while
that element's text differs: classes nest, and what stands in every instance of an element is not its content. Menus, adverts and the like are set aside by their tags and names. What remains of a page is its content: the
page's own article and main elements if they hold text, else the smallest element that holds all that remains; of both,
template is left out.

Vectors are compared by a sum of per-page hashes, so a host's statistics are added up map-side and no task ever holds
the pages or the tokens of a host, however many they are.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: A token is part of the template from this number of pages on, however large the host.
SUPPORT = 3
#: Templates of up to so many bytes in all are broadcast; beyond it they are joined, each host dealt SALTS ways.
MAX_BROADCAST_BYTES, SALTS = 16 << 20, 64

#: HTML's void, raw-text and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|object|canvas|audio|video|select"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and roles that are never part of an article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button head fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names or ids. The first set an element aside wherever they are part of a name; the next
#: only beside their like and beside what merely says where a box stands; a name with one of the last says how another
#: element is.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter "
    "breadcrumb breadcrumbs comment comments disqus pagination pager masthead topbar toolbar".split()
)
ASIDE_ALONE = frozenset("ad promo promotion notice subscribe subscription signup login share sharing social related recommended recommendations respond reply replies widget copyright skip banner".split())
PLACES = frozenset("area bar block blocks bottom box button buttons container content footer form group icons inner item items left link links list main media message outer page panel post posts right section site slot text top unit widget wrap wrapper".split())
STATES = frozenset("has is no not with without".split())
ASIDE_NAMES = frozenset("header site-header page-header global-header site-head site_header page_header".split())
#: What an opening element closes first.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
#: Elements that hold a whole article, and those whose links are content.
CONTAINERS = frozenset("article body center div html main section td".split())
PROSE = frozenset("blockquote figcaption h1 h2 h3 h4 h5 h6 p".split())
SCOPES = frozenset("article aside blockquote body div footer form header html main nav section table td th ul ol button".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@lru_cache(65536)
def _set_aside(name: str, whole: bool) -> bool:
    """Whether a class name or id sets its element aside; whole: only as a single word, or the name of a page's head."""
    if name in ASIDE_NAMES or name in ASIDE_WORDS or name in ASIDE_ALONE:
        return True
    parts = set(re.split(r"[-_]+", name)) - {""}
    if whole or parts & STATES:
        return False
    return bool(parts & ASIDE_WORDS) or bool(parts & ASIDE_ALONE) and parts <= ASIDE_ALONE | PLACES


def _attributes(raw: str, tag: str) -> tuple[str, bool, bool]:
    """The element's first class (or its id), whether its attributes set it aside, and whether its names do.

    Articles and prose are set aside by single words alone, not by parts of names.
    """
    if "=" not in raw and "hidden" not in raw.lower():
        return "", False, False
    name, aside, by_name, whole = "", False, False, tag in PROSE or tag in ("article", "main")
    for key, a, b, c in _NAME.findall(raw):
        key, value = key.lower(), html.unescape(a or b or c).lower()
        if key in ("class", "id"):
            names = value.split()
            if names and (key == "class" or not name):
                name = names[0]
            by_name |= any(_set_aside(n, whole) for n in names)
        elif key == "role":
            aside |= value.strip() in ASIDE_ROLES
        elif key == "style":
            aside |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        else:
            aside |= key == "hidden" or value.strip() == "true"
    return name, aside, by_name


@lru_cache(65536)
def _label(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _mix(a: int, b: int) -> int:
    """A hash below 2^63 of two numbers in order."""
    x = (a * 0x9E3779B97F4A7C15 + b + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return (x ^ (x >> 32)) & (1 << 63) - 1


class Element:
    """An element of a page. token stands for its path, block for it or the nearest element around it that is not inline;
    text and links in prose are counted, in it alone (own) and under it
    (size), and told apart by digest, unless set aside: by tag or attributes (apart), or by names (by_name), if it does not
    hold all articles of the page. stock tells template, inside what is part of the article."""

    __slots__ = ("apart", "articles", "aside", "block", "by_name", "digest", "inside", "link", "lists", "named", "own", "parent", "prose", "scope", "size", "stock", "tag", "token")

    def __init__(self, tag: str, name: str, own: bool, by_name: bool, parent: Element | None, depth: int):
        self.apart = self.by_name = False
        self.articles = 0
        self.tag, self.parent, self.own, self.size, self.digest, self.stock, self.inside = tag, parent, 0, 0, 0, False, False
        self.block = self if parent is None or tag not in INLINE else parent.block
        if parent is None:
            self.token, self.aside, self.link, self.prose, self.named, self.scope, self.lists = 0, False, False, False, False, -1, -1
            return
        self.named = parent.named or tag in ("article", "main")
        own |= tag in ASIDE_TAGS or tag == "header" and not parent.named
        self.aside = False
        self.apart, self.by_name = own and tag not in ("html", "body"), by_name and tag not in ("html", "body")
        self.link, self.prose = parent.link or tag == "a", parent.prose or tag in PROSE
        self.token = _mix(parent.token, _label(f"{tag}.{name}"))
        self.scope = depth if tag in SCOPES else parent.scope
        self.lists = depth if tag in ("ul", "ol") else parent.lists


def parse(page: str):
    """Yields, in page order, ("enter", element, "") where an element opens, ("break", element, "") where a block ends or
    is interrupted, and ("text", element, text). The first element entered is the page itself.

    Ends that close nothing are ignored, ends that close too much close what they cover, and open elements end with the
    page. Every element is kept, however deep, and each costs the same.
    """
    root = Element("", "", False, False, None, -1)
    stack: list[Element] = []
    where: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    at = 0
    yield "enter", root, ""

    def top():
        return stack[-1] if stack else root

    def close(depth: int):
        for e in reversed(stack[depth:]):
            where[e.tag].pop()
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", top(), page[at : m.start()]
        at = m.end()
        if m[1]:
            if m[1].lower() not in ("svg", "math", "script", "template"):
                yield "break", top(), ""
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if where.get(tag):
                close(where[tag][-1])
            if tag not in INLINE:
                yield "break", top(), ""
            continue
        last = max((where[t][-1] for t in CLOSES.get(tag, ()) if where.get(t)), default=-1)
        if last >= 0 and last >= (top().lists if tag == "li" else top().scope):
            close(last)
        if tag in VOID or m[4].rstrip().endswith("/") and tag in INLINE:
            if tag not in INLINE and tag != "img":
                yield "break", top(), ""
            continue
        name, own, by_name = _attributes(m[4], tag)
        stack.append(Element(tag, re.sub("[0-9]+", "#", name), own, by_name, top(), len(stack)))
        where[tag].append(len(stack) - 1)
        yield "enter", stack[-1], ""
    if at < len(page):
        yield "text", top(), page[at:]


def read(page: str) -> tuple[list[Element], list[tuple[str, Element, str]]]:
    """The elements of a page, each after the one around it, with its text's digest; and its events."""
    events = list(parse(page))
    elements = [e for kind, e, _ in events if kind == "enter"]
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.articles += e.articles + (e.named and not e.parent.named)
    articles = elements[0].articles
    for e in elements[1:]:
        e.aside = e.parent.aside or e.apart or e.by_name and not (articles and e.articles == articles)
    for kind, e, text in events:
        if kind == "text" and not e.aside and (e.prose or not e.link) and (text := text.strip()):
            e.own += len(text)
            e.digest = _mix(e.digest, zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for e in reversed(elements):
        if e.parent is not None and e.digest:
            e.parent.digest = _mix(e.parent.digest, e.digest)
    return elements, events


def page_tokens(elements: list[Element]) -> dict[int, list]:
    """Per structural token of a page (0 is the page itself) that is not set aside: how often it opens, the digest of its
    text, and the token around it. Inline elements are content, not structure."""
    out: dict[int, list] = {}
    for e in elements:
        if e.block is e and not e.aside:
            x = out.setdefault(e.token, [0, 0, e.parent.block.token if e.parent else -1])
            x[0] += 1
            x[1] = _mix(x[1], e.digest) if e.digest else x[1]
    return out


def word_token(e: Element) -> int:
    """The token of a block's words: below 0, which no structural token is."""
    return -1 - _mix(e.token ^ 0x5F356495, e.digest)


def word_tokens(elements: list[Element]) -> dict[int, list]:
    """Per block of words of a page (a block element without others in it): how often it occurs, digest, token around."""
    outer = {id(e.parent.block) for e in elements if e.block is e and e.parent}
    out: dict[int, list] = {}
    for e in elements:
        if e.block is e and not e.aside and e.digest and e.parent is not None and id(e) not in outer:
            x = out.setdefault(word_token(e), [0, e.digest, e.parent.block.token])
            x[0] += 1
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _token_rows(batches):
    """Sums by (host, token) of a batch of pages: token around it, vector hash, pages, least and greatest digest of it
    and of the page."""
    for b in batches:
        acc: dict[tuple[str, int], list] = {}
        for host, key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            elements = read(page or "")[0]
            tokens = page_tokens(elements)
            whole = tokens[0][1]
            for token, (count, digest, around) in (tokens | word_tokens(elements)).items():
                x = acc.setdefault((host, token), [around, 0, 0, digest, digest, whole, whole])
                # a hash of (page, count); its sum over pages stands for the occurrence vector
                h = ((key & (1 << 63) - 1) + count * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
                x[1] += (h ^ (h >> 32)) & 0x3FFFFFFFFFF
                x[2] += 1
                x[3], x[4] = min(x[3], digest), max(x[4], digest)
                x[5], x[6] = min(x[5], whole), max(x[6], whole)
        rows = [(*k, *v) for k, v in acc.items()]
        for a in range(0, len(rows), 5000):
            cols = list(zip(*rows[a : a + 5000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["host", "token", "around", "vector", "pages", "low", "high", "page_low", "page_high"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, template (tokens) for every host of pages that has one.

    A token's text is template if it is the same on all pages of its class while the pages are not, and a block of words
    is if it stands in every instance of the element around it while that element's text differs.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(url_col, html_col).alias("key"), F.col(html_col).cast("string").alias("html"))
    parts = rows.mapInArrow(_token_rows, "host string, token long, around long, vector long, pages long, low long, high long, page_low long, page_high long")
    sums = parts.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum(F.col("vector").cast("decimal(20,0)")).cast("string").alias("vector"), *[F.min(c).alias(c) for c in ("around", "low", "page_low")], *[F.max(c).alias(c) for c in ("high", "page_high")])
    frequent = durable(sums.filter(F.col("pages") >= SUPPORT))
    shape = frequent.filter("token >= 0")
    classes = shape.groupBy("host", "vector").agg(F.min("page_low").alias("low"), F.max("page_high").alias("high")).filter("low < high")
    same = shape.filter("low = high AND low <> 0").join(classes, ["host", "vector"], "left_semi").select("host", "token", "around")
    inner = same.select("host", F.col("token").alias("around"))
    whole = same.join(inner, ["host", "around"], "left_anti").select("host", "token")
    holders = shape.filter("low < high").select("host", F.col("token").alias("around"), "vector")
    words = frequent.filter("token < 0").join(holders, ["host", "around", "vector"], "left_semi").select("host", "token")
    return whole.union(words).groupBy("host").agg(F.collect_list("token").alias("template"))


def _choose(elements: list[Element], template: frozenset[int]) -> None:
    """Marks the elements of a page that are inside its article.

    Those are its article and main elements, if text that is neither set aside nor template stands in them; else the
    smallest container of all such text; else the whole page. If most text of the page is template, it is one of some
    that repeat an article, and has no template.
    """
    words = word_tokens(elements).keys() & template
    for e in elements:
        e.stock = e.parent is not None and e.parent.stock or e.block is e and (e.token in template or bool(words) and e.digest != 0 and not e.aside and word_token(e) in words)
    if 2 * sum(e.own for e in elements if e.stock) > sum(e.own for e in elements):
        for e in elements:
            e.stock = False
    for e in elements:
        e.size = 0 if e.stock else e.own
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.size += e.size
    root = elements[0]
    outermost = [e for e in elements if e.named and not e.parent.named]
    if any(e.size for e in outermost):
        chosen = {id(e) for e in outermost if not e.stock}
    elif root.size:
        chosen = {id(next((e for e in reversed(elements) if e.size == root.size and e.tag in CONTAINERS), root))}
    else:  # nothing but template, or nothing but links
        chosen = {id(root)}
        for e in elements:
            e.stock = False
    for e in elements:
        e.inside = e.parent is not None and e.parent.inside or id(e) in chosen


def article_blocks(page: str, template: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of a page's article in page order, without what is set aside."""
    elements, events = read(page)
    _choose(elements, template)
    out: list[list[str]] = [[]]
    for kind, e, text in events:
        if kind != "text":
            if kind == "break" or e.block is e:
                out.append([])
        elif e.inside and not e.aside and not e.stock:
            out[-1].append(text)
    blocks = (" ".join(html.unescape("".join(b)).split()) for b in out)
    return [b for b in blocks if b]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page: the article's blocks in page order, joined by one space.

    A page without markup is all text; null or empty html gives an empty text; a null url is a host of its own name.
    Repeated pages are extracted one by one, and other columns are never read.
    """
    known = durable(templates(pages, url_col, html_col))
    size = known.agg(F.sum(F.length("host") + 8 * F.size("template") + 32)).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= MAX_BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "template")

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.slice(a, 500)
                text = [" ".join(article_blocks(h or "", frozenset(t or ()))) for h, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(np.fromiter(map(len, text), np.int64, len(text)))], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
