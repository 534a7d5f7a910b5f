"""Main text of web pages, with removal of site templates.

A page's markup is read into a tree.  Every block subtree of it, inside the article as outside, is hashed, the hashes are counted
per host in Spark, and subtrees that recur on many different articles of their host are deleted.  What counting can't
see, as a host has too few pages, goes by name: elements whose kind or class says that they aren't the article
(menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles), and what
stands outside the article where a page marks one.

Pages that repeat an article count once, so that a host full of copies doesn't make its article a template.  Near copies of an
article share most of their paragraphs: where a page marks its article and templates would take more than half of that article's text,
they aren't templates to it and nothing is deleted.  Counting moves one row for each distinct (host, subtree, article); the
HTML itself is shuffled only if the templates are too many to broadcast.  Reading a page is linear in its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import after_scheme, few_files, host_of, stash

#: A subtree is a template when on so many different articles of its host, and on that share of them.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Up to so many template hashes (20 MB or so) are broadcast; more are joined by host.
BROADCAST_TEMPLATES = 500_000

# Kinds of elements in HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
# never text
_DUMB = set("head script style noscript template iframe svg math select option textarea input title object embed video audio canvas map datalist noembed noframes xmp".split())
# not the article
_SKIP = set("nav header footer aside form button dialog menu".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Words in a class, id or role that say an element isn't the article.
_NOT_TEXT = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pagination "
    "paywall popup promo promoted promotion related respond share sharing sidebar sidebars signup social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)

# Words that say where such an element stands or how it is built, beside one of the words above.
_LAYOUT = set(
    "area aside bar bars block bottom box center col column container content footer group header inner item items left line link links list main message "
    "outer page panel primary right row secondary section site slot text top unit wrap wrapper zone".split()
)

# A tag ends at its first ">" outside quotes; quotes count after "=" only, and a "<" outside them means that this is no tag.  Repeats
# are possessive, so a tag that doesn't end costs its own length once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORDS = re.compile(r"[a-z]+")


def _named_out(value: str) -> bool:
    """Whether a class, id or role has a name that says so as a whole: of several words none may say anything else, so that ad-hoc is no
    advert and related-work no list of links."""
    for name in value.split():
        words = _WORDS.findall(name)
        if not _NOT_TEXT.isdisjoint(words) and all(w in _NOT_TEXT or w in _LAYOUT for w in words):
            return True
    return False


class Node:
    #: named_out is True for an element that is none of the article by its kind, 2 for one by its name.
    __slots__ = ("kind", "dumb", "named_out", "main", "children", "digest", "known", "lang")

    def __init__(self, kind: str, attributes: str = ""):
        self.kind, self.children, self.digest = kind, [], 0
        self.dumb, self.named_out, self.main = kind in _DUMB, kind in _SKIP, kind in ("article", "main")
        self.known, self.lang = "", None
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                self.known += name + "=" + value + ";"
                if name == "role" and value == "main":
                    self.main = True
                elif self.kind not in ("html", "body", "article", "main") and _named_out(value):
                    self.named_out = 2
                elif self.kind == "article" and {"comment", "comments"} & set(_WORDS.findall(value)) and _named_out(value):
                    self.named_out, self.main = 2, False
            elif name == "lang" or name == "xml:lang":
                self.lang = self.lang or value.strip()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                self.named_out = 2


class _Open:
    """The elements that are open, and where each kind stands among them, so that no search walks the whole depth."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.kind, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, kinds: Iterable[str]) -> int:
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=0)

    def cut(self, at: int) -> None:
        while len(self.nodes) > max(at, 1):
            self.places[self.nodes.pop().kind].pop()

    def close(self, kinds: Iterable[str], scope: Iterable[str] = ()) -> None:
        """Close the innermost element of these kinds, and all in it, unless one of scope stands further in."""
        at = self.last(kinds)
        if at > self.last(scope):
            self.cut(at)


_BARRIERS = {"article", "main", "td", "th"}
_P_SCOPE = ("article", "main", "section", "div", "td", "th", "button", "aside", "form", "header", "footer", "nav", "li")


def parse(page: str) -> Node:
    """The element tree of a page.  Text stands as strings between elements, references decoded."""
    root = Node("html")
    now = _Open(root)
    at, n = 0, len(page)

    def put(text: str) -> None:
        if text:
            now.nodes[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                now.nodes[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        kind = m[2].lower()
        if m[1]:
            if kind not in ("html", "body"):
                now.close((kind,), () if kind in ("article", "main") else _BARRIERS - {kind})
            elif kind == "body":
                now.cut(2)
            continue
        if kind in ("html", "body") and now.places.get(kind):
            continue
        if kind == "body":
            now.close(("head",))
        if kind in _CLOSES_P:
            now.close(("p",), _P_SCOPE)
        if kind in _CLOSED_BY:
            now.close(_CLOSED_BY[kind], _SCOPE[kind])
        node = Node(kind, m[3])
        now.nodes[-1].children.append(node)
        if (node.main or kind == "h1") and now.places.get("form"):
            for place in now.places["form"]:  # a form around an article or the page's heading frames the page
                if now.nodes[place].named_out is True:
                    now.nodes[place].named_out = False
        if kind in _RAW:
            end = re.compile(rf"</{re.escape(kind)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or n
        elif kind not in _VOID and not (m[3].endswith("/") and kind in ("svg", "math")):
            now.push(node)  # "<div/>" opens a div
    return root


def declared_language(root: Node) -> str | None:
    """What the page's html element (or its body) says that the language is, as written but in lower case."""
    for x in _below(root):
        if x.kind in ("html", "body") and x.lang:
            return x.lang
    return None


def _gather(node: Node, deleted: set[int], out: list[str], by_name: bool) -> None:
    """Text under node in page order; an element that isn't inline parts words."""
    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.dumb or by_name and x.named_out or x.digest in deleted:
            out.append(" ")
        elif x.kind in _INLINE:
            stack.extend(reversed(x.children))
        else:
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.children))


def _below(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend([c for c in reversed(x.children) if isinstance(c, Node)])


def _bodies(root: Node) -> list[Node]:
    """The outermost main or article elements that nothing passes over, or else the whole page."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.named_out or x.dumb:
            continue
        if x.main:
            found.append(x)
        else:
            stack.extend([c for c in reversed(x.children) if isinstance(c, Node)])
    return found or [root]


def main_text(root: Node, deleted: set[int] = frozenset(), by_name: bool = True) -> str:
    """The text of the page without subtrees of these digests (of the whole page, and by counts alone, if not by_name)."""

    def text(bodies: list[Node], gone: set[int]) -> str:
        out: list[str] = []
        for body in bodies:
            _gather(body, gone, out, by_name)
            out.append(" ")
        return " ".join("".join(out).split())

    bodies = _bodies(root) if by_name else [root]
    left = text(bodies, deleted)
    if deleted and bodies[0] is not root:
        whole = text(bodies, frozenset())
        if 2 * len(left) < len(whole):  # a near copy of other articles, not an article with strips
            return whole
    return left


def hash_subtrees(root: Node) -> set[int]:
    """Give every block element with text in it its digest; the digests given.  Inline elements have no life of their own."""
    given: set[int] = set()
    # children first, without recursion
    stack: list[tuple[Node, bool]] = [(root, False)]
    sums: dict[int, tuple[bytes, bool]] = {}
    while stack:
        x, done = stack.pop()
        if not done:
            stack.append((x, True))
            stack.extend([(c, False) for c in x.children if isinstance(c, Node) and not c.dumb])
            continue
        h = blake2b(f"<{x.kind} {x.known}>".encode("utf-8", "surrogatepass"), digest_size=8)
        worded = False
        for c in x.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                worded |= bool(words)
                h.update(words.encode("utf-8", "surrogatepass"))
            elif not c.dumb:
                digest, has = sums.pop(id(c))
                worded |= has
                h.update(digest)
        sums[id(x)] = (h.digest(), worded)
        if worded and x is not root and x.kind not in _INLINE and x.kind not in ("html", "body"):
            x.digest = int.from_bytes(h.digest(), "little", signed=True) or 1
            given.add(x.digest)
    return given


def _count(batches: Iterator[pa.RecordBatch], by_name: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, subtrees, articles = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(page.as_py())
            found = hash_subtrees(root)
            article = int.from_bytes(blake2b(main_text(root, by_name=by_name).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            for s in (0, *found):  # 0 stands for the page itself
                hosts.append(host)
                subtrees.append(s)
                articles.append(article)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(articles, pa.int64())], ["host", "subtree", "article"]
        )


def _extract(batches: Iterator[pa.RecordBatch], by_name: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs, deleted = [], [], []
        for page, templates in zip(batch.column(2), batch.column(3).to_pylist()):
            root = parse(page.as_py())
            hits = hash_subtrees(root) & set(templates) if templates else frozenset()
            texts.append(main_text(root, hits, by_name))
            langs.append(declared_language(root))
            deleted.append(len(hits))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(langs, pa.string()), pa.array(deleted, pa.int64())], ["page_id", "url", "text", "lang", "templates"]
        )


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, by_name: bool = True) -> DataFrame:
    """(host, subtree) of subtrees that recur on many different articles of their host."""
    seen = pages.select("host", "html").mapInArrow(lambda b: _count(b, by_name), "host string, subtree long, article long").distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("articles"))
    counts = stash(few_files(counts.where((F.col("subtree") == 0) | (F.col("articles") >= min_pages))), "subtrees")
    whole = counts.where("subtree = 0").select("host", F.col("articles").alias("all"))
    found = counts.where("subtree <> 0").join(whole, "host").where(F.col("articles") >= min_share * F.col("all"))
    return found.select("host", "subtree")


def extract(
    pages: DataFrame, page: str = "html", url: str = "url", page_id: str = "page_id", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, by_name: bool = True
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), lang (as the html element declares it, or null), templates (how many
    subtrees of the page recur on its host).

    Character references are decoded, white space inside a block becomes one space, blocks follow
    in page order with one space between.  A null, empty or text-free page gives the empty text.  A page
    without article or main is read whole, less templates and what its names give away.  Without by_name, kinds and classes and article
    elements mean nothing, and only counting removes.  Pages of a null url share the empty host.  Repeated pages give repeated
    rows; other columns are ignored.
    """
    given = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"),
        host_of(after_scheme(F.col(url))).alias("host"),
    )
    found = stash(few_files(templates(given, min_pages, min_share, by_name)), "templates")
    # at most 1 / min_share times the subtrees of a page for each host
    by_host = found.groupBy("host").agg(F.collect_list("subtree").alias("templates"))
    if found.count() <= BROADCAST_TEMPLATES:
        by_host = F.broadcast(by_host)
    else:
        by_host = stash(by_host, "hosts")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    rows = given.join(by_host, "host", "left").select("page_id", "url", "html", "templates")
    texts = rows.mapInArrow(lambda b: _extract(b, by_name), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, lang string, templates long")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "lang", "templates")
