"""HTML extraction by a site style tree.

1. Every page is parsed into elements.  An element's *style* is its path of tags (with
   the class and id words that are not numbers); pages of one host share a tree of
   styles.  For each style a page contributes one content fingerprint (all its text
   there) and one presentation fingerprint (the sequence of child tags).
2. Spark counts these by (host, style), pages of a host with the same article text (by
   markup alone) as one, so that copies do not make an article look like a menu: over the
   m distinct pages that show a style, its
   importance is the larger of the entropies (base m) of its contents and of its
   presentations, or 1 on a single page.  A style is *low* if it is on ``MIN_PAGES``
   distinct pages or more and its importance is under ``LEAST``.
3. Each page drops the branches of low styles, and those that markup itself names as
   not the article (navigation, footers, forms, adverts, comments, ...), and gives the
   text of what is left: inside ``article`` or ``main`` if the page has one, else of
   its body.  A style that holds the page's article, or most of the article's text, is
   never low.  Names count for elements that can hold a part (a ``div``, not a paragraph), if
   all their words are such names or fill; an article's own ``header`` is its headline.

Copies are merged map-side first, so a host whose pages are mostly copies sends one row
an article and block.  The table of low styles is broadcast
only if its measured size is under ``BROADCAST_BYTES``; else pages meet it by host.

null and empty html give an empty text; null URLs form one site; broken markup is read
as browsers do in the main (unclosed paragraphs and list items end at the next block);
rows that repeat are each extracted, ties alike; a very long page is parsed whole, however
deep; an empty table gives no rows; columns besides key, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import common, urls

LEAST = 0.2
MIN_PAGES = 8
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end when a like one begins, up to the elements that hold them.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_DROP = frozenset("nav footer header aside form menu button select option input dialog head".split()) | _RAW
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "related recommended respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget warning".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words that may stand beside these in a name; with any other word a name is one of its own ("related-work").
_FILL = frozenset("area bar block bottom box button buttons group item items left link links list module panel post posts right row section slot story stories tools top zone".split())
#: Elements that can hold such a part; a paragraph or heading is text, whatever its name.
_PARTS = frozenset("aside center dd details div dl fieldset figure iframe ins ol section table td ul".split())
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "low", "parent", "style", "tag")

    def __init__(self, tag: str, style: str, parent: Node | None, low: bool):
        self.tag, self.style, self.parent, self.low = tag, style, parent, low
        self.children: list[Node | str] = []


def _named(token: str) -> bool:
    """Whether a class or id names a part around the article, and nothing else."""
    own = set(_WORDS.findall(token))
    return not own.isdisjoint(_NAMES) and own <= _NAMES | _FILL


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's part of a style, and whether its markup names it as not the article."""
    if not attributes:
        return tag, tag in _DROP
    words, drop = [], tag in _DROP
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            drop |= value in _ROLES
        else:
            words += _WORDS.findall(value)
            drop |= tag in _PARTS and any(map(_named, value.split()))
    return f"{tag}.{'.'.join(words)}" if words else tag, drop


def _in_article(node: Node) -> bool:
    """Whether the node is in an article, whose header is its headline."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def parse(html: str) -> Node:
    """A tree of elements; text is kept as it stands."""
    root = at = Node("", "", None, False)
    end = 0
    lower = None
    while (m := _TOKEN.match(html, end)) is not None:
        end = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith(("<!", "<?")):
                at.children.append(m[0])
            continue
        tag = name.lower()
        if m[1]:
            seek = at
            while seek is not root and seek.tag != tag:
                seek = seek.parent
            if seek is not root:
                at = seek.parent
            continue
        if tag in _BLOCK:
            seek = at
            while seek is not root and seek.tag not in _BLOCK:
                seek = seek.parent
            if seek.tag == "p":
                at = seek.parent
        if tag in _ENDS:
            like, holders = _ENDS[tag]
            seek = at
            while seek is not root and seek.tag not in holders:
                if seek.tag in like.split():
                    at = seek.parent
                seek = seek.parent
        label, low = _label(tag, m[3])
        node = Node(tag, f"{at.style}/{label}", at, low and not (tag == "header" and _in_article(at)))
        at.children.append(node)
        if tag in _RAW:
            lower = lower if lower is not None else html.lower()
            close = lower.find(f"</{tag}", end)
            if close < 0:
                break
            end = html.find(">", close) + 1 or len(html)
        elif tag not in _VOID and not m[3].endswith("/"):
            at = node
    return root


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def styles(root: Node) -> dict[str, tuple[int, int]]:
    """(content, presentation) fingerprints of each style that a page shows and markup does not rule out."""
    contents: dict[str, list[str]] = {}
    shapes: dict[str, list[str]] = {}
    last, mark = None, ""  # a text alone in many levels is kept and marked once
    todo: list[tuple[Node, Iterator[Node | str], list[str]]] = [(root, iter(root.children), [])]
    while todo:
        node, rest, texts = todo[-1]
        for c in rest:
            if type(c) is str:
                texts.append(c)
            elif not c.low:
                todo.append((c, iter(c.children), []))
                break
        else:
            todo.pop()
            own = " ".join(texts)
            if todo:
                todo[-1][2].append(own)
            if node.tag in _BLOCK:
                if own is not last:
                    last, mark = own, str(_mark(own))
                contents.setdefault(node.style, []).append(mark)
                shapes.setdefault(node.style, []).append(" ".join(c.tag for c in node.children if type(c) is not str))
    return {s: (_mark("\n".join(t)), _mark("\n".join(shapes[s]))) for s, t in contents.items()}


def main_text(root: Node, low: frozenset[str] = frozenset()) -> str:
    """The page's article: its blocks in page order, one a line."""
    articles: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            articles.append(node)
            continue
        todo += [c for c in node.children[::-1] if type(c) is not str and (not c.low or c.tag == "form")]
    if len(articles) > 1:  # a main holds the page's articles
        mains = [a for a in articles if a.tag == "main"]
        articles = mains or articles
    tops = articles or [root]
    safe = set(_most(articles, low)) if low else set()
    for top in tops:
        while top is not None:
            safe.add(top.style)
            top = top.parent
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    for top in tops:
        way: list[tuple[Node, Iterator[Node | str]]] = [(top, iter(top.children))]
        while way:
            node, rest = way[-1]
            for c in rest:
                if type(c) is str:
                    line.append(c)
                elif c.low or (c.style in low and c.style not in safe):
                    if c.tag in _BLOCK:
                        flush()
                elif c.tag == "br":
                    line.append(" ")
                else:
                    if c.tag in _BLOCK:
                        flush()
                    way.append((c, iter(c.children)))
                    break
            else:
                way.pop()
                if node.tag in _BLOCK:
                    flush()
        flush()
    return "\n".join(out)


def _most(articles: list[Node], low: frozenset[str]) -> list[str]:
    """The low styles that hold most of the text of ``articles``."""
    whole, held = 0, Counter()
    for top in articles:
        todo: list[tuple[Node, tuple[str, ...]]] = [(top, ())]
        while todo:
            node, under = todo.pop()
            for c in node.children:
                if type(c) is str:
                    size = len("".join(c.split()))
                    whole += size
                    for style in under:
                        held[style] += size
                elif not c.low:
                    todo.append((c, (*under, c.style) if c.style in low and c.style not in under else under))
    return [style for style, size in held.items() if 2 * size > whole]


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, article, n, shown): a block's pages by the fingerprint of their article text, and the least (style, content, shape) list of each."""
    kind = pa.list_(pa.struct([("style", pa.string()), ("content", pa.int64()), ("shape", pa.int64())]))
    for block in common.blocks(batches, "html", 8 << 20):
        seen: dict[tuple[str | None, bytes], list] = {}
        for host, html in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
            if html:
                root = parse(html)
                shown = sorted((style, *marks) for style, marks in styles(root).items())
                article = hashlib.blake2b(main_text(root).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                held = seen.setdefault((host, article), [0, shown])
                held[0] += 1
                held[1] = min(held[1], shown)
        names = ("style", "content", "shape")
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in seen], pa.string()), pa.array([a for _, a in seen], pa.binary()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([[dict(zip(names, s, strict=True)) for s in shown] for _, shown in seen.values()], kind)],
            names=["host", "article", "n", "shown"],
        )


def importance(pages: DataFrame, copies: bool = True) -> DataFrame:
    """(host, style, pages, importance) of the styles of ``pages`` (host, html), each article counted as often as it is there, or once."""
    seen = pages.select("host", "html").mapInArrow(_shown, "host string, article binary, n bigint, shown array<struct<style:string,content:bigint,shape:bigint>>")
    seen = seen.groupBy("host", "article").agg((F.sum("n") if copies else F.lit(1).cast("bigint")).alias("n"), F.min("shown").alias("shown"))
    seen = seen.select("host", "n", F.explode("shown").alias("s")).select("host", "n", "s.style", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("s.content").alias("mark")), F.struct(F.lit(1).alias("kind"), F.col("s.shape").alias("mark")))).alias("k"))
    counts = seen.groupBy("host", "style", "k.kind", "k.mark").agg(F.sum("n").alias("n"))
    # entropy base m of p = n / m: log(m) - sum(n log n) / m, over log(m)
    by_kind = counts.groupBy("host", "style", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") < 2, F.lit(1.0)).otherwise((F.log("m") - F.col("s") / F.col("m")) / F.log("m"))
    return by_kind.groupBy("host", "style").agg(F.max("m").alias("pages"), F.max(entropy).alias("importance"))


def low_styles(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, low): each site's unimportant styles."""
    found = importance(pages, copies=False).filter((F.col("pages") >= min_pages) & (F.col("importance") < least))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("style")).alias("low"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[tuple, frozenset] = {}
    for block in common.blocks(batches, "html", 8 << 20):
        texts = []
        for html, low in zip(block.column(2).to_pylist(), block.column(3).to_pylist(), strict=True):
            if not html:
                texts.append("")
                continue
            low = tuple(low or ())
            if low not in made:
                made = made if len(made) < 1000 else {}
                made[low] = frozenset(low)
            texts.append(main_text(parse(html), made[low]))
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every row."""
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", urls.host_of(F.col("url")))
    low = common.cut(low_styles(own))
    size = low.agg(F.sum(F.length("host") + F.length(F.concat_ws(" ", "low")) + 64)).first()[0] or 0
    met = own.join(F.broadcast(low) if size <= BROADCAST_BYTES else low, "host", "left").select("key", "url", "html", "low")
    kind = own.schema["key"].dataType.simpleString()
    return met.mapInArrow(_extracted, f"key {kind}, url string, text string").withColumnsRenamed({"key": key, "url": url})


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
