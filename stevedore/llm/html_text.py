"""Main text of web pages by site template removal.

Each page is parsed once into blocks of text, each with the hashes of the element subtrees around it.
Spark counts, for each host, on how many of its pages a subtree occurs; subtrees found on many pages
of the host are its template, and their blocks go. Elements whose name says that they aren't the article (menus,
footers) go by that alone; those whose role, class or id says so, by whole words, go unless they hold the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import filter_bit, in_filter, key_filter, slices, staged

#: A subtree is template if it occurs on at least MANY pages of its host and on this share of them.
MANY, SHARE = 5, 0.3

# Element names of HTML and MathML.
_RAW = "script|style|textarea|title|noscript|template|iframe|svg|object|noembed|noframes|xmp|annotation|annotation-xml"
_DROPPED = frozenset("nav header footer aside menu dialog button select option fieldset label input head canvas audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br"
    " math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split()
)
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name what isn't the article. First what lies around it, ...
_LAYOUT = frozenset(
    "banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login register"
    " footer header masthead menu menus nav navbar navigation navigations pager pagination sidebar sidebars aside widget widgets share sharing social search searchform"
    " skip toolbar topbar tags contentinfo complementary dialog form hidden".split()
)
# ... then readers' comments, and what may itself be made of articles.
_COMMENTS = frozenset("comment comments commentlist respond disqus".split())
_OTHERS = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense promo promoted promotion sponsor sponsored sponsors related recommended recommendations".split()
)
#: Words before such a word: the element says whether there is one (no-sidebar), or is the article's own part (entry-header).
_ABOUT = frozenset("has have no not with without show hide hides is js can if".split())
_OWN = frozenset("entry article post story content section page main title chapter".split())
#: Words after such a word: the element is one (sidebar-left, related-posts; but not search-algorithms).
_KINDS = frozenset(
    "area bar block body box button buttons container content form group holder inner item items left link links list menu outer panel posts articles stories primary region reply right"
    " secondary section slot thread top bottom unit widget wrap wrapper zone".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_NAME_PART = re.compile(r"[a-z]+")

#: What an element's name and attributes say: nothing, that it goes, or that it goes unless it holds the article.
_STAYS, _GOES, _LAID_OUT, _LISTED = range(4)


def _named(token: str) -> int:
    """What one class, id or role says."""
    if token in _OTHERS:
        return _LISTED
    if token in _LAYOUT:
        return _LAID_OUT
    parts = _NAME_PART.findall(token)
    if len(parts) < 2 or parts[0] in _ABOUT:
        return _STAYS
    word = parts[-1] if parts[-1] in _OTHERS or parts[-1] in _LAYOUT else parts[0] if parts[1] in _KINDS else ""
    if word in _OTHERS:
        return _LISTED
    return _LAID_OUT if word in _LAYOUT and not (word == "header" and parts[0] in _OWN) else _STAYS


def _unwanted(name: str, rest: str, in_article: bool) -> int:
    if name in _DROPPED and not (name == "header" and in_article):
        return _GOES
    found = _LAID_OUT if name == "form" else _STAYS
    if not rest or name in ("body", "html"):
        return found
    for m in _ATTRIBUTE.finditer(rest):
        attribute, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if attribute == "hidden" or attribute == "aria-hidden" and value == "true":
            return _GOES
        if attribute == "style" and "display:none" in value.replace(" ", ""):
            return _GOES
        if attribute in ("class", "id", "role") and name not in _HEADINGS and name != "main":
            for token in value.split():
                said = _named(token)
                if attribute == "id" and in_article and token not in _COMMENTS or name == "article" and said == _LAID_OUT:
                    continue
                found = max(found, said)
    return found


class _Element:
    __slots__ = ("name", "said", "first", "last", "is_main", "is_article", "holds_main", "holds_article", "in_article")

    def __init__(self, name: str, said: int, first: int, is_main: bool, is_article: bool, in_article: bool):
        self.name, self.said, self.first, self.last = name, said, first, first
        self.is_main, self.is_article, self.in_article = is_main, is_article, in_article
        self.holds_main = self.holds_article = False


def _parse(page: str) -> tuple[list[tuple[str, bool, bool]], list[_Element]]:
    """The blocks that no element drops for certain, as (text, in main, in an article), and the elements that hold
    some, inner ones first."""
    stack: list[_Element] = []
    done: list[tuple[str, bool, bool]] = []
    closed: list[_Element] = []
    words: list[str] = []
    skipping = mains = articles = 0

    def flush() -> None:
        if words:
            text = "".join(words)
            words.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text and not skipping:
                done.append((text, mains > 0, articles > 0))

    def leave() -> None:
        nonlocal skipping, mains, articles
        flush()
        e = stack.pop()
        e.last = len(done)
        skipping -= e.said == _GOES
        mains -= e.is_main
        articles -= e.is_article
        if e.first < e.last:
            closed.append(e)
            if stack and e.said != _GOES:
                stack[-1].holds_main |= e.is_main or e.holds_main
                stack[-1].holds_article |= e.is_article and e.said == _STAYS or e.holds_article

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in _INLINE:
            if name == "br":
                words.append(" ")
            continue
        if m["close"]:
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    leave()
                leave()
            continue
        flush()
        if name in _CLOSES_P and stack and stack[-1].name == "p":
            leave()
        if name in _SIBLING and stack and stack[-1].name in _SIBLING[name]:
            leave()
        if name in _VOID:
            continue
        in_article = mains + articles > 0
        e = _Element(name, _unwanted(name, m["rest"], in_article), len(done), name == "main" or 'role="main"' in m["rest"], name == "article", in_article)
        stack.append(e)
        skipping += e.said == _GOES
        mains += e.is_main
        articles += e.is_article
    words.append(page[at:] if "<" not in page[at:] else page[at : page.index("<", at)])
    while stack:
        leave()
    flush()
    return done, closed


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """(text, hashes of the subtrees it is in, outermost last) of the wanted blocks, in page order.

    What a class, id or role drops stays if it holds the main element; or, unless it is readers' comments, adverts
    or other articles, an article or most of the page's text. Where there is a main element, only blocks inside one count;
    where articles hold at least half of the text, only blocks inside those.
    """
    done, closed = _parse(page)
    sums = [0]
    for text, _, _ in done:
        sums.append(sums[-1] + len(text))
    total = sums[-1]
    own = [0]  # text in an article or main element
    for text, in_main, in_article in done:
        own.append(own[-1] + (len(text) if in_main or in_article else 0))
    wanted = [True] * len(done)
    for e in closed:
        if e.said in (_LAID_OUT, _LISTED) and not e.holds_main and not e.is_main:
            size, inside = sums[e.last] - sums[e.first], own[e.last] - own[e.first]
            most = 2 * size > total and (e.in_article or inside == own[-1])
            if e.said == _LISTED or not (most or e.holds_article):
                wanted[e.first : e.last] = [False] * (e.last - e.first)
    kept = [x for x, w in zip(done, wanted, strict=True) if w]
    if any(in_main for _, in_main, _ in kept):
        wanted = [w and in_main for w, (_, in_main, _) in zip(wanted, done, strict=True)]
    elif 2 * sum(len(t) for t, _, a in kept if a) >= sum(len(t) for t, _, _ in kept):
        wanted = [w and in_article for w, (_, _, in_article) in zip(wanted, done, strict=True)]
    around: list[list[int]] = [[] for _ in done]
    for e in closed:
        within = [i for i in range(e.first, e.last) if wanted[i]]
        if within:
            key = xxhash.xxh64_intdigest("\n".join([e.name, *(done[i][0] for i in within)])) - (1 << 63)
            for i in within:
                around[i].append(key)
    return [(done[i][0], around[i]) for i in range(len(done)) if wanted[i]]


def subtrees(page: str) -> list[int]:
    """Hashes of the subtrees that hold a part of the page's text, not the whole: what can be template."""
    paths = [set(path) for _, path in blocks(page)]
    return sorted(set().union(*paths) - set.intersection(*paths)) if paths else []


def page_text(page: str, gone: frozenset[int] = frozenset()) -> str:
    """The wanted blocks outside the subtrees ``gone``, joined by one newline."""
    return "\n".join(text for text, path in blocks(page) if gone.isdisjoint(path))


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text of each page: its wanted blocks joined by one newline.

    Null and empty pages give an empty text. Pages without a host in their url share one unnamed host.
    Repeated rows count as pages each and give a row each. Subtrees that hold the whole of a page's text
    stay (a page isn't its own template). An empty table gives none. Other columns are ignored.

    Pages are read again for their texts; only those with a template subtree are joined with its hashes.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    key = F.xxhash64(F.col(page_id), F.col(url), F.col(source))
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), key.alias("key"), F.col(source).alias("html"))
    found = T.StructType([given.schema["key"], given.schema["page_id"], given.schema["host"], T.StructField("subtrees", T.ArrayType(T.LongType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            hashes = [subtrees(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in found.names[:-1]), pa.array(hashes, pa.list_(pa.int64()))], names=found.names)

    marks = staged(given.select(*found.names[:-1], "html").mapInArrow(parse, found), "subtrees")
    each = marks.select("key", "page_id", "host", F.explode("subtrees").alias("subtree"))
    sizes = marks.groupBy("host").agg(F.count("*").alias("n_pages"))
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= MANY)
    template = staged(counts.join(sizes, "host").filter(F.col("n") >= SHARE * F.col("n_pages")).select("host", "subtree"), "templates")
    gone = each.join(template, ["host", "subtree"]).groupBy(F.col("key").alias("_key"), F.col("page_id").alias("_id")).agg(F.collect_set("subtree").alias("gone"))
    gone = staged(gone, "template-pages")
    bits = pages.sparkSession.sparkContext.broadcast(key_filter(gone.select(filter_bit(F.col("_key")).alias("bit"))))
    texts = T.StructType([given.schema["page_id"], given.schema["url"], T.StructField("text", T.StringType())])
    sifted = given.select("page_id", "url", "key", "html", filter_bit(F.col("key")).alias("bit"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = batch.filter(pa.array(~in_filter(bits.value, batch.column("bit").to_numpy())))
            for part in slices(iter([free]), "html"):
                text = [page_text(page or "") for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], names=texts.names)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits.value, batch.column("bit").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            pairs = zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)
            text = [page_text(page or "", frozenset(g or ())) for page, g in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=texts.names)

    rest = sifted.mapInArrow(touched, sifted.schema).join(gone.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    return sifted.mapInArrow(plain, texts).unionByName(rest.select("page_id", "url", "html", "gone").mapInArrow(cut, texts))
