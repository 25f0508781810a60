"""HTML extraction with a site style tree.

Pages of one host are merged into a style tree: elements with the same path of tags and classes are one style node.
A node's content importance is 1 minus the mean normalised entropy of its text blocks over the pages that have the
node (a block on every page alike has entropy 1, a block of one page 0); its presentation importance is the
normalised entropy of the child layouts it shows.  Their weighted sum is the node's importance, and branches under
``threshold`` are removed from each page, if ``least_pages`` pages or more have the node: two pages of a site say
nothing about what it repeats.  The sums behind both entropies add up over pages, so Spark keeps one row per host,
node and block, summed before it moves, however many pages a host has.

Entropy alone can't tell menus and adverts whose words change from page to page from an article, so what HTML itself
says goes first: scripts, styles, forms, menus, asides, page headers and footers, and elements whose class or id is
the whole name of an advert, comment, cookie notice or the like are removed; and where a page marks its article
(``article``, ``main``), only that is kept.  Inside an article names that may as well be a part of it (``discussion``,
``related``, ``search``) only raise the importance that their branch needs to ``named_threshold``; headings and links are
never judged by a name.  Plain elements of a marked article are not judged by entropy, as copies of one article on a
host would look like boilerplate; those with a class are.

Defined results: null, empty or text-free html gives ''; a page cut off in a tag, comment or script keeps what came
before; a null url belongs to host ''; repeated rows give repeated rows; columns other than page_id, url and html are
ignored.  All white space (Unicode's too) separates words; a line break tag counts as white space.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize, table

THRESHOLD, NAMED_THRESHOLD, LEAST_PAGES, CONTENT_WEIGHT = 0.2, 0.6, 5, 0.9

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+|[0-9]+")
# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# What a page's own marks say is not its main text.
_NEVER = frozenset("head nav aside form script style template noscript button select iframe svg math object canvas audio video dialog menu textarea title footer noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
# Names that are never a part of an article; names that may be one; and what joins either to a name that means the same.
_SURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors navbar navigation breadcrumb breadcrumbs masthead topbar sidebar sidenav cookie cookies consent gdpr popup modal paywall newsletter subscribe "
    "subscription signup login comment comments commentlist disqus respond share sharing pagination pager toolbar skiplink".split()
)
_DOUBTFUL = frozenset("promo promotion nav menu menus header footer foot aside widget widgets notice notices notification alert overlay reply replies discussion social related recommended recommendations skip copyright disclaimer banner form search".split())
_JOINED = frozenset("area bar block body bottom box btn button buttons center column container content frame group holder icon icons inner item items label left link links list main outer panel right row section slot strip text thread title top unit wrap wrapper".split())
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_ARTICLE = frozenset(["article", "main"])
_PLAIN = frozenset(["html", "body"])
_UNNAMED = _PLAIN | frozenset("a h1 h2 h3 h4 h5 h6".split())


class Element:
    """A node of the page's tree: text runs and child elements in order.

    ``marked``: 2 where its name, role or style says that it is no main text, 1 where its name may say so.
    """

    __slots__ = ("at", "key", "main", "marked", "named", "parts", "tag")

    def __init__(self, tag: str, key: int = 0, named: bool = False, marked: int = 0, main: bool = False, at: int = 0) -> None:
        self.tag, self.key, self.named, self.marked, self.main, self.at = tag, key, named, marked, main, at
        self.parts: list[str | Element] = []


def _mark_of(name: str) -> int:
    """2 for a name of what is no main text, 1 for a doubtful one, 0 for others: the whole of it has to be known."""
    mark = 0
    for piece in _NAME.findall(name):
        if piece in _SURE:
            mark = 2
        elif piece in _DOUBTFUL:
            mark = max(mark, 1)
        elif piece not in _JOINED and not piece.isdigit():
            cut = next((piece[:at] for at in range(2, len(piece) - 1) if piece[at:] in _JOINED and (piece[:at] in _SURE or piece[:at] in _DOUBTFUL)), None)
            if cut is None:
                return 0
            mark = max(mark, 2 if cut in _SURE else 1)
    return mark


def _marks(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(what tells the element from others of its tag, how far it is marked as no main text, whether it is an article's)."""
    name_, mark, article = "", 0, tag in _ARTICLE
    if attributes and tag not in _PLAIN:
        unquoted = re.sub(r"""=\s*("[^"]*"|'[^']*')""", "=", attributes)
        mark = 2 * bool(_UNSEEN.search(unquoted))
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "").lower()
            if name == "role":
                mark = max(mark, 2 * (value in _ROLES))
                article |= value in _ARTICLE
            elif name == "style":
                mark = max(mark, 2 * bool(_UNSEEN.search(value)))
            elif name in ("class", "id"):
                said = 0 if tag in _UNNAMED else max(map(_mark_of, value.split()), default=0)
                mark = max(mark, said)
                if name == "class":
                    name_ = ".".join(sorted(value.split())) + name_
                elif said:
                    name_ += f"#{value.strip()}"
    return name_, mark, article and not mark


def parse(page: str) -> Element:
    """The page's tree.  Never fails: unknown or misplaced tags are text-free or ignored, open elements end with the page."""
    root = Element("")
    stack, at, n, held = [root], 0, len(page), set()
    for tag in iter(lambda: _TAG.search(page, at), None):
        if tag.start() > at:
            stack[-1].parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth:]
                    break
                if name in _INLINE and stack[depth].tag not in _INLINE:
                    break
            continue
        if name in _CLOSES_P:
            _close(stack, {"p"}, {"td", "th", "li", "div", "article", "section", "main", "table", "body"})
        if name in _CLOSED_BY:
            _close(stack, _CLOSED_BY[name], _SCOPE[name])
        classes, mark, main = _marks(name, tag[3])
        parent = stack[-1]
        element = Element(name, xxhash.xxh64_intdigest(f"{parent.key} {name}.{classes}") >> 1, bool(classes), mark, main, tag.start())
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        parent.parts.append(element)
        if name not in _VOID and not tag[3].endswith("/"):
            stack.append(element)
        if (main or name == "h1" and not mark) and name not in held:
            held.add(name)
            for above in stack[1:-1]:
                above.marked = 0  # what holds the page's first article is not decided by its name
    if at < n and not (page[at] == "<" and page[at + 1 : at + 2].isalpha()):
        stack[-1].parts.append(page[at:])
    return root


def _close(stack: list[Element], tags: set[str], scope: set[str]) -> None:
    """Ends the innermost open element that is one of ``tags``, if no ``scope`` element stands between."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            if tags == {"p"}:
                return
            return _close(stack, tags, scope)
        if stack[depth].tag in scope:
            return


def _removed(element: Element, in_article: bool) -> bool:
    return element.tag in _NEVER or element.marked > in_article or element.tag == "header" and not in_article


def _end(run: list[str], out: list[str]) -> None:
    if run:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)


def _judged(element: Element, in_article: bool) -> bool:
    """Whether entropy may decide over this element."""
    return not element.main and element.tag not in _PLAIN and element.tag not in _INLINE and (not in_article or element.named)


@dataclass(frozen=True)
class Low:
    """The style nodes of a host that are removed: all of ``nodes``, and of ``named`` those whose name is doubtful."""

    nodes: frozenset[int] = frozenset()
    named: frozenset[int] = frozenset()

    def has(self, element: Element, in_article: bool) -> bool:
        return _judged(element, in_article) and (element.key in self.nodes or bool(element.marked) and element.key in self.named)


def blocks_of(element: Element, low: Low = Low(), in_article: bool = False) -> list[str]:
    """The texts of the element's blocks in order, without removed branches."""
    out: list[str] = []
    run: list[str] = []
    open_ = [(iter(element.parts), in_article, True)]
    while open_:
        parts, inside, block = open_[-1]
        for part in parts:
            if isinstance(part, str):
                run.append(part)
            elif part.tag in ("br", "hr"):
                run.append(" ")
            elif not _removed(part, inside) and not low.has(part, inside):
                if part.tag not in _INLINE:
                    _end(run, out)
                open_.append((iter(part.parts), inside or part.main, part.tag not in _INLINE))
                break
        else:
            open_.pop()
            if block:
                _end(run, out)
    return out


def _articles(element: Element) -> list[Element]:
    """The outermost marked articles that stand in no removed element, in order."""
    out, waiting = [], [element]
    while waiting:
        for part in reversed(own := waiting.pop().parts):
            if isinstance(part, Element) and not part.main and not _removed(part, False):
                waiting.append(part)
        out += [part for part in own if isinstance(part, Element) and part.main and not _removed(part, False)]
    return sorted(out, key=lambda e: e.at)


def main_text(page: str | None, low: Low = Low()) -> str:
    """The blocks of the page's main text, without the style nodes in ``low``, joined by one space."""
    if not page:
        return ""
    root = parse(page)
    found = [text for article in _articles(root) for text in blocks_of(article, low, True)]
    return " ".join(found or blocks_of(root, low))


def style_features(page: str) -> Iterator[tuple[int, str, int]]:
    """(style node, kind, hash): the child layout and each text block of the elements that entropy may decide over."""
    root = parse(page)
    articles = _articles(root)  # where a page marks its article, nothing else is kept, nor need be judged
    # with each element the nearest judged one around it, which knows the next
    waiting: list[tuple[Element, bool, tuple | None]] = [(element, element.main, None) for element in articles or [root]]
    while waiting:
        element, in_article, nodes = waiting.pop()
        if element.tag and _judged(element, in_article):
            nodes = (element.key, nodes)
            yield element.key, "layout", xxhash.xxh64_intdigest(" ".join(p.tag for p in element.parts if isinstance(p, Element))) >> 1
        text = " ".join(entities.unescape(" ".join(p for p in element.parts if isinstance(p, str))).split())
        if text:
            block, above = xxhash.xxh64_intdigest(text) >> 1, nodes
            while above:
                yield above[0], "block", block
                above = above[1]
        waiting += [(part, in_article or part.main, nodes) for part in element.parts if isinstance(part, Element) and not _removed(part, in_article)]


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^.*?://([^/?#]*)", 1)), F.lit(""))


def style_importance(pages: DataFrame, content_weight: float = CONTENT_WEIGHT) -> DataFrame:
    """(host, node, pages, importance) of the style tree of every host in ``pages`` (host, html)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, int, str, int], list[float]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for (node, kind, feature), n in Counter(style_features(page)).items():
                    row = rows.setdefault((host, node, kind, feature), [0, 0, 0.0])
                    row[0] += 1
                    row[1] += n
                    row[2] += n * math.log(n)
            keys, sums = list(rows), list(rows.values())
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))] + [pa.array([s[i] for s in sums], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "node", "kind", "feature", "pages", "n", "n_log_n"])

    features = pages.where("html IS NOT NULL").select("host", "html").mapInArrow(each, "host string, node long, kind string, feature long, pages long, n long, n_log_n double")
    summed = features.groupBy("host", "node", "kind", "feature").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "n_log_n")))
    entropy = F.ln("n") - F.col("n_log_n") / F.col("n")  # of how a block spreads over pages
    layout = F.col("kind") == "layout"
    nodes = summed.groupBy("host", "node").agg(
        F.sum(F.when(layout, F.col("n"))).alias("shown"), F.sum(F.when(layout, F.col("pages"))).alias("pages"), F.sum(F.when(layout, F.col("n") * F.ln("n"))).alias("layout_log"), F.avg(F.when(~layout, entropy)).alias("block_entropy")
    )
    normal = F.ln(F.greatest("pages", F.lit(2)))
    presentation = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ln("shown") - F.col("layout_log") / F.col("shown")) / normal))
    content = 1 - F.least(F.lit(1.0), F.coalesce("block_entropy", F.lit(0.0)) / normal)
    return nodes.select("host", "node", "pages", (content_weight * content + (1 - content_weight) * presentation).alias("importance"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, named_threshold: float = NAMED_THRESHOLD) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    below = style_importance(rows).where((F.col("importance") < max(threshold, named_threshold)) & (F.col("pages") >= least_pages))
    sets = [F.collect_set(F.when(F.col("importance") < most, F.col("node"))).alias(name) for name, most in (("low", threshold), ("named", named_threshold))]
    low = materialize(below.groupBy("host").agg(*sets), "low")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = (Low(frozenset(a or ()), frozenset(b or ())) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            texts = [main_text(page, low) for page, low in zip(batch.column(2).to_pylist(), nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])

    return join_small(rows, low, "host").select("page_id", "url", "html", "low", "named").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
