"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree. An element node is the chain of
tags (with their classes) from the root; repeated siblings count as one style, so
pages that differ in the number of paragraphs share their nodes. For each node
that m pages have, with entropies taken to the base m:

* presentation importance is the entropy of the layouts (sequences of child
  elements) below the node;
* content importance is one minus the mean entropy, over the distinct texts found
  at the node, of the text's spread over the pages: texts on one page only count
  as 1, a text on every page as 0;
* a node's importance mixes its own presentation importance with the content
  importance of the leaves below it.

Branches below the threshold are noise and are removed from each page. Nodes that
fewer than MIN_PAGES pages have say nothing and stay. Elements whose tag, role or
class names a non-content part (menu, header, footer, sidebar, notice, advert,
form, script, style, comments) are never content, and where a page marks its
article, text outside it is left out and paragraphs inside it are not judged by
the tree, so that copies of an article on one site do not erase each other.

Statistics are aggregated by (host, node, text) before anything is grouped by
host, so a host with a third of all pages is spread like any other. What pages
are joined with is one row per host that lists its noise branches.

Cases: a null page is empty; a null or odd url forms a host of its own name
(possibly empty); pages without text give an empty string; broken markup is read
as far as it goes (unclosed and crossed tags are closed where a container ends);
repeated rows count as pages and are extracted one by one; empty tables are
fine; only the key, url and html columns are read. Pages are read whole.
"""

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Share of a node's own presentation in its importance.
PRESENTATION = 0.1
THRESHOLD = 0.25
MIN_PAGES = 5

# Elements by their meaning in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_NOISE_TAGS = frozenset(
    "head nav footer aside form button select option label input textarea script style noscript iframe template svg "
    "math menu dialog object embed canvas title".split()
)
_NOISE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion nav navbar navigation "
    "menu topbar breadcrumb breadcrumbs header masthead footer sidebar aside related recommended widget share sharing "
    "social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notification alert popup "
    "modal overlay comment comments commentlist reply replies discussion disqus pagination pager toolbar copyright "
    "legal disclaimer skip announcement announcements feedback respond responses".split()
)
#: A class that begins with one of these says what is around or absent, not what the element is.
_ASIDE_WORDS = frozenset("with has no without show hide near".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_ARTICLE = frozenset(["article", "main"])
_CLOSES_P = _BLOCK - frozenset(["html", "body"])
#: What an opening tag of the same group ends, up to the nearest container.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SIBLING_STOPS = frozenset("ul ol dl table tbody thead tfoot select menu".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
#: A tag or comment that the page breaks off in.
_BROKEN_OFF = re.compile(r"<(?:!--|/?[a-zA-Z])[^>]*\Z")
#: One attribute: its name, then its value, taken whole so that nothing in it passes for an attribute.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
#: Text without any of these has no attribute that matters.
_MARKS = re.compile("class|id|role|hidden", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "path", "noise", "article", "children")

    def __init__(self, tag, path, noise, article):
        self.tag, self.path, self.noise, self.article, self.children = tag, path, noise, article, []


def _element(parent: Element | None, tag: str, attributes: str) -> Element:
    names, role, hidden = [], "", False
    if attributes and _MARKS.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            kind = (m[1] or "").lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if kind in ("class", "id"):
                names += value.split()
            elif kind == "role":
                role = value
            elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                hidden = True
    parts = [_NAME.findall(n) for n in names]
    words = {w for p in parts if p and p[0] not in _ASIDE_WORDS for w in p}
    inside = parent is not None and parent.article
    noise = (
        tag in _NOISE_TAGS
        or (tag == "header" and not inside)
        or role in _NOISE_ROLES
        or hidden
        or (not words.isdisjoint(_NOISE_NAMES) and tag not in ("html", "body", "main"))
    )
    # Numbers in class names belong to pages, not to the site's style.
    label = ".".join([tag, *sorted(re.sub(r"\d+", "9", n) for n in names)])
    noise = noise or (parent is not None and parent.noise)
    path = f"{parent.path}/{label}" if parent is not None else label
    return Element(tag, path, noise, not noise and (inside or tag in _ARTICLE or role in ("main", "article")))


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """(runs of text with the element they stand in, all elements), in page order.

    A run with an empty text marks the border of a block.
    """
    root = _element(None, "#", "")
    stack, runs, elements = [root], [], [root]
    at = 0

    def text(upto):
        if upto > at and not page[at:upto].isspace():
            runs.append((stack[-1], page[at:upto]))
        elif upto > at:
            runs.append((stack[-1], " "))

    position = 0
    # Behind the last > there are no tags; looking for them would cost a scan for each <.
    tags_end = page.rfind(">") + 1
    while m := _TOKEN.search(page, position, tags_end):
        text(m.start())
        at = position = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _BLOCK:
            runs.append((stack[-1], ""))
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # An inline end tag does not reach beyond the block it stands in.
                if tag not in _BLOCK and stack[k].tag in _BLOCK:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLINGS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in _SIBLING_STOPS:
                    break
        element = _element(stack[-1], tag, m[3])
        stack[-1].children.append(element)
        elements.append(element)
        if tag == "br":
            runs.append((stack[-1], " "))
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = position = end.end() if end else len(page)
            continue
        stack.append(element)
    broken = _BROKEN_OFF.search(page, max(at, tags_end))
    text(broken.start() if broken else len(page))
    return runs, elements


def blocks(runs) -> Iterator[tuple[Element, str]]:
    """Blocks of text with white space settled; each with its first run's element."""
    parts, first = [], None
    for element, run in [*runs, (None, "")]:
        if run == "":
            if parts:
                line = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
                if line:
                    yield first, line
            parts, first = [], None
        else:
            if first is None and not run.isspace():
                first = element
            if first is not None:
                parts.append(run)


def profile(page: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(distinct (node, layout), distinct (node, text)) of a page; layouts and texts as 63-bit hashes."""
    runs, elements = parse(page)
    layouts = set()
    for e in elements:
        if e.noise:
            continue
        labels = [c.path.rsplit("/", 1)[-1] for c in e.children]
        kept = [x for k, x in enumerate(labels) if k == 0 or x != labels[k - 1]]
        layouts.add((e.path, _hash(" ".join(kept))))
    texts = {(e.path, _hash(line)) for e, line in blocks(r for r in runs if r[1] == "" or not r[0].noise)}
    return sorted(layouts), sorted(texts)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


def main_text(page: str | None, noise_paths=()) -> str:
    """The page's main text: blocks that are neither noise by their marks nor in a noise branch."""
    runs, elements = parse(page or "")
    noise_paths = set(noise_paths)
    marked = any(e.article for e in elements)
    bad: dict[str, bool] = {}

    def branch(path: str) -> bool:
        if path not in bad:
            up = path.rpartition("/")[0]
            bad[path] = path in noise_paths or (bool(up) and branch(up))
        return bad[path]

    def keeps(e: Element) -> bool:
        if e.noise or (marked and not e.article):
            return False
        return marked and e.tag in _TEXT_TAGS or not branch(e.path)

    return "\n".join(line for _, line in blocks(r for r in runs if r[1] == "" or keeps(r[0])))


#: Text elements that the tree does not judge inside a marked article.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span li td th dd dt pre blockquote article main".split())


def host_column(url: Column) -> Column:
    """The url's host in lower case; without one, the url itself."""
    return F.lower(
        F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"://([^/?#]*)", 1)).otherwise(F.coalesce(url, F.lit("")))
    )


def tree_statistics(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, pages, presentation, content): one row per node of every host's tree.

    content is null where no text stands directly in the node.
    """

    @F.pandas_udf("array<struct<node: string, layout: boolean, value: long>>")
    def profiled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = []
            for page in part:
                layouts, texts = profile(page or "")
                rows.append(
                    [{"node": n, "layout": True, "value": v} for n, v in layouts]
                    + [{"node": n, "layout": False, "value": v} for n, v in texts]
                )
            yield pd.Series(rows, dtype=object)

    seen = pages.select(host_column(F.col(url)).alias("host"), F.explode(profiled(F.col(html))).alias("f"))
    counted = seen.groupBy("host", "f.node", "f.layout", "f.value").agg(F.count("*").cast("double").alias("c"))
    nodes = counted.groupBy("host", "node").agg(
        F.sum(F.when(F.col("layout"), F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("layout"), F.col("c") * F.log("c"))).alias("layout_clogc"),
        F.count(F.when(~F.col("layout"), 1)).alias("texts"),
        F.sum(F.when(~F.col("layout"), F.col("c"))).alias("text_pages"),
        F.sum(F.when(~F.col("layout"), F.log("c"))).alias("text_logc"),
    )
    base = F.log("pages")
    # The entropy of counts c with sum m is ln(m) - sum(c ln c) / m; a text on c pages has entropy ln(c).
    return nodes.select(
        "host",
        "node",
        "pages",
        F.when(F.col("pages") > 1, 1 - F.col("layout_clogc") / F.col("pages") / base).otherwise(1.0).alias("presentation"),
        F.when(F.col("texts") > 0, F.when(F.col("pages") > 1, 1 - F.col("text_logc") / F.col("texts") / base).otherwise(1.0)).alias("content"),
        F.col("texts").cast("double").alias("texts"),
    )


def noise_branches(statistics: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, branches): the topmost nodes of each host whose importance is below the threshold.

    Each leaf's content importance goes to itself and all its ancestors, weighted
    by its distinct texts; trees are as deep as pages nest, so this is a small
    multiple of the number of nodes.
    """
    parts = F.split("node", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    leaves = statistics.where("content IS NOT NULL").select("host", F.explode(chain).alias("node"), "content", "texts")
    below = leaves.groupBy("host", "node").agg(
        (F.sum(F.col("content") * F.col("texts")) / F.sum("texts")).alias("content_below")
    )
    importance = statistics.select("host", "node", "pages", "presentation").join(below, ["host", "node"])
    low = importance.where(
        (F.col("pages") >= min_pages)
        & (PRESENTATION * F.col("presentation") + (1 - PRESENTATION) * F.col("content_below") < threshold)
    )
    names = low.select("host", "node")
    upper = names.select("host", F.col("node").alias("up"))
    top = names.withColumn("up", F.regexp_extract("node", "^(.*)/[^/]*$", 1)).join(upper, ["host", "up"], "left_anti")
    return top.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("branches"))


def extract(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    threshold: float = THRESHOLD,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(key, url, text) of every page."""
    noise = stored(noise_branches(tree_statistics(pages, url, html), threshold, min_pages))

    @F.pandas_udf("string")
    def extracted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, branches in parts:
            yield pd.Series(
                [main_text(t, () if b is None else b) for t, b in zip(texts, branches)], dtype=object
            )

    rows = pages.select(
        F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html"), host_column(F.col(url)).alias("host")
    ).join(noise, "host", "left")
    return rows.select(
        F.col("__key").alias(key), F.col("__url").alias(url), extracted(F.col("__html"), F.col("branches")).alias("text")
    )
