"""Main text of web pages: flat text blocks, features of a block and its neighbours, and a decision tree.

A page is cut into blocks at block-level tags. A block has its text, words, link density (share of the words in links), the same
two figures of the blocks before and after it, and what surrounds it: heading, article or main element, and boilerplate by element (nav,
aside, footer, header outside an article, form) or by words of a class, id or role (menu, ad, cookie, comment and so on). A Spark ML
decision tree learns from these features of a small labelled table (``labelled_pages``); its rules are sent to the
tasks, and every page is one row of a scan. A page of any length is read whole, in one pass over its tags.

Character references are decoded. White space in a block becomes one space, ``br`` being white space. Scripts, styles, the head, hidden
elements, buttons, options and comments in the markup have no text. Unclosed and misplaced tags are tolerated: an end tag
closes up to its element if that is open, else it is ignored; an open paragraph or item ends where the next block of its kind begins.

Null or empty html, or a page without kept block: the empty text. Repeated rows give equal results. An empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled_pages import PAGES
from .shared import arrow_batches

TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template iframe svg math object textarea select button canvas audio video dialog".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "template"))
#: ASCII, or the long s and the Kelvin sign would match s and k.
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTENT = frozenset(("article", "main"))
BOILERPLATE = frozenset(("nav", "menu", "aside", "footer", "form", "fieldset"))
#: Words of class, id or role that name boilerplate.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                  "copyright disclaimer disqus footer gdpr header login masthead menu nav navbar navigation newsletter notice pagination popup "
                  "promo related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
#: Names that also stand on wrappers of the whole page or inside an article.
WRAPPERS = frozenset("article body container content has layout main no page post story with without wrapper".split())
TOPS = frozenset(("header", "masthead"))
#: A start of these ends an open element of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "in_content", "in_boilerplate")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    content: bool
    boilerplate: bool
    keep: bool


class Element(NamedTuple):
    tag: str
    silent: bool
    content: bool
    boilerplate: bool
    heading: bool
    link: bool
    keep: bool


def opened(tag: str, attributes: str, above: Element) -> Element:
    named, hidden, keep = False, False, above.keep
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                for part in value.split():
                    words = set(WORD.findall(part))
                    hit = (words & NAMES) - (TOPS if above.content else set())
                    named |= bool(hit) and not words & WRAPPERS and tag not in ("body", "html", "article", "main")
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
                hidden = True
            elif name == "data-keep":
                keep = True
    content = above.content or tag in CONTENT
    return Element(tag, above.silent or hidden or tag in SILENT, content,
                   above.boilerplate or named or tag in BOILERPLATE or (tag == "header" and not above.content),
                   above.heading or tag in HEADINGS, above.link or tag == "a", keep)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Element("", False, False, False, False, False, False)]
    texts: list[tuple[str, bool]] = []
    inside = stack[0]

    def flush():
        if texts:
            text = " ".join("".join(t for t, _ in texts).split())
            if text:
                linked = sum(len(t.split()) for t, link in texts if link)
                out.append(Block(text, len(text.split()), linked, inside.heading, inside.content, inside.boilerplate, inside.keep))
            texts.clear()

    def say(text):
        nonlocal inside
        top = stack[-1]
        if text and not top.silent:
            if not texts:
                inside = top
            texts.append((entities.unescape(text), top.link))

    at = 0
    for start, end, closing, name, attributes in iter_tags(page):
        say(page[at:start])
        at = end
        if name is None:
            continue
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        if name not in INLINE and name not in VOID:
            close = SIBLINGS.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                found = stack[i].tag
                if found in close or found == "p":
                    del stack[i:]
                    break
                if found not in INLINE and found not in HEADINGS:
                    break
        if name not in VOID:
            stack.append(opened(name, attributes, stack[-1]))
    say(page[at:])
    flush()
    return out


def iter_tags(page: str):
    """(start, end, closing, name, attributes) of tags; a comment or declaration has the name None. Raw elements' content is skipped."""
    at = 0
    while True:
        found = TAG.search(page, at)
        if not found:
            return
        at = found.end()
        name = found[2].lower() if found[2] else None
        yield found.start(), at, bool(found[1]), name, found[3]
        if name in RAW and not found[1]:
            stop = RAW_END[name].search(page, at)
            if not stop:
                return
            at = stop.start()


def features(found: list[Block]) -> list[tuple[float, ...]]:
    size = [(float(b.words), b.linked / b.words if b.words else 0.0) for b in found]
    edge = (0.0, 0.0)
    return [(*size[i], *(size[i - 1] if i else edge), *(size[i + 1] if i + 1 < len(size) else edge), float(b.heading), float(b.content), float(b.boilerplate))
            for i, b in enumerate(found)]


def train_tree(spark: SparkSession, pages=PAGES, depth: int = 6) -> tuple:
    """The decision tree as nested (feature, threshold, below or equal, above), leaves being 0 or 1."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = [(float(b.keep), Vectors.dense(x)) for page in pages for found in [blocks(page)] for b, x in zip(found, features(found))]
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, seed=7, minInfoGain=0.0).fit(table)

    def rule(node) -> tuple:
        if node.getClass().getSimpleName() == "LeafNode":
            return int(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), rule(node.leftChild()), rule(node.rightChild()))

    return rule(model._java_obj.rootNode())


def decide(tree, x) -> int:
    while not isinstance(tree, int):
        feature, threshold, below, above = tree
        tree = below if x[feature] <= threshold else above
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, x in zip(found, features(found)) if decide(tree, x))


def extract(pages: DataFrame, html: str = "html", ids: str = "page_id", url: str = "url", tree=None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    arrow_batches(spark)
    tree = train_tree(spark) if tree is None else tree

    def read(batches):
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                                              "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(ids).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
