"""Main text of web pages by tag-path ratios.

A page is scanned into blocks of text, each with its path of block tags from the root. Per path, text length and
punctuation are added up and divided by the number of blocks: running text has long, punctuated blocks, menus and notices
do not. The ratios of paths are fused with the density of link text, laid out in page order and smoothed, and the blocks
above a threshold are the seeds. The content is the container that the page itself marks as article, if seeds lie in one,
else the smallest container that holds the seeds; of its blocks, those whose path or place says boilerplate are left out. In
a marked article a lower threshold holds, which paths of mere links do not reach; headings stay. A word in a class or id
alone leaves out neither an outermost article nor an element with most of the text of a high ratio.

Decoding follows the contract: character references are decoded, white space in a block becomes one space, blocks are
joined by one line feed in page order. Nothing is cut or dropped by size.

Defined results: null or empty html gives the empty text; unclosed and stray tags are tolerated, a paragraph ends where the
next block starts, unclosed comments, scripts and styles run to the end; pages without any tag are one block; ties between
containers go to the first; repeated rows get equal results. Rows are independent of each other.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import pick

#: Tags that make blocks; all others are part of a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: it ends at their own closing tag.
RAW = frozenset("script style textarea noscript iframe template svg xmp noembed noframes title select object".split())
#: Containers that are never part of an article.
NEVER = frozenset("nav footer aside form header menu dialog button fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: Words in class, id or role that mark other things than the article.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|banner|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disqus|disclaimer|dropdown|footer|gdpr|header|legal|login|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pagination|pager|paywall|popup|popular|promo|promoted|recommended|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|tags|toolbar|trending|widget|complementary|contentinfo|alert)(?=$|[\s_-])"
)
#: What follows such a word says what an element is about or comes with, not what it is.
ABOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|category|tag)-\S*")
#: Words that mark the article.
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|main|content|body-text|text-body|post-body|hentry)(?=$|[\s_-])")
#: A tag, quoted values of any length. Of the scans that fail, no two are ever in the same state (outside, in one kind of
#: quotes, in the other) at the same place, and one outside ends at the next "<": so at most three pass over any character.
SCAN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>|<[!?/][^<>]*+>", re.S)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Attributes with their values; what hides an element is read off single attributes, not off the tag as a whole.
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
SPACE = re.compile(r"\s+")
MARKS = frozenset(".,;:!?…。，！？")
#: Elements nested deeper than this are read as siblings; no text is lost.
DEEPEST = 512
#: Weights of a block's neighbours in page order, and the share of the largest smoothed ratio that makes a seed.
SMOOTH = (0.06, 0.24, 0.4, 0.24, 0.06)
SEED = 0.25
#: Share of it that a path reaches inside the marked article: the mark lowers the bar, paths of mere links stay below it.
INSIDE = SEED**4


def hidden(attrs: str) -> bool:
    """Whether attributes hide their element: hidden, aria-hidden="true", or a style without display or visibility."""
    lower = attrs.lower()
    if "hidden" not in lower and "display" not in lower:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).strip().lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
            return True
    return False


class Node:
    """An open element: what it is, and whether it or one around it is boilerplate or article.

    named: numbers of the elements, itself or around it, that only a word of their class, id or role calls boilerplate.
    """

    __slots__ = ("article", "boiler", "name", "named", "number", "parent", "path")

    def __init__(self, name: str, number: int, parent: Node | None, attrs: str):
        self.name, self.number, self.parent = name, number, parent
        above = parent.path if parent else 0
        self.boiler = parent.boiler if parent else False
        self.article = parent.article if parent else None
        words = " ".join(a or b or c for a, b, c in NAMES.findall(attrs)).lower() if attrs else ""
        # a path is a chain of hashes: tag and first class of every element that makes a block
        self.path = hash((above, name, words.split()[0] if words else "")) if name in BLOCK or words else above
        self.named = parent.named if parent else ()
        if name in ARTICLE and self.article is None:
            self.boiler, self.named = False, ()
        whole = name in ("html", "body") or (name in ARTICLE and self.article is None)
        if name in NEVER or (attrs and name not in ("html", "body") and hidden(attrs)):
            self.boiler = True
        elif words and not whole and BOILER.search(words) and BOILER.search(ABOUT.sub("", words)):
            self.named = (*self.named, number)
        elif name in ARTICLE or (words and name in BLOCK and name not in ("html", "body", "p", "li") and MAIN.search(words)):
            if self.article is None and not self.boiler and not self.named:
                self.article = number


class Block:
    __slots__ = ("article", "keep", "links", "node", "path", "text")

    def __init__(self, text: str, links: int, node: Node, keep: bool):
        self.text, self.links, self.node, self.keep = text, links, node, keep
        self.path, self.article = node.path, node.article

    def chain(self) -> list[int]:
        """Numbers of the elements around the block, innermost first."""
        out, node = [], self.node
        while node:
            out.append(node.number)
            node = node.parent
        return out


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order."""
    out: list[Block] = []
    numbers = 0
    top = Node("", 0, None, "")
    stack = [top]
    parts: list[str] = []
    links = 0
    anchor = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                node = stack[-1]
                while node.name and node.name not in BLOCK:
                    node = node.parent
                heading = node.name in HEADINGS and node.article is not None and not node.named and only_header(node)
                out.append(Block(text, links, node, heading or not node.boiler))
            parts.clear()
        links = 0

    def only_header(node: Node) -> bool:
        """A heading in the head of an article belongs to it."""
        seen = node.parent
        while seen and seen.boiler:
            if seen.name != "header":
                return False
            seen = seen.parent
        return True

    def close(at: int) -> None:
        nonlocal anchor
        flush()
        anchor -= sum(n.name == "a" for n in stack[at:])
        del stack[at:]

    def add(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if anchor:
                links += len(text.strip())

    at = 0
    end = len(page)
    while at < end:
        m = SCAN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if name in BLOCK:
                        close(i)
                    else:
                        anchor -= sum(n.name == "a" for n in stack[i:])
                        del stack[i:]
                    break
                if name not in BLOCK and stack[i].name in BLOCK:  # a stray end of an inline tag closes no block
                    break
            continue
        if name in RAW:
            m = re.compile(rf"</{name}\s*>", re.I).search(page, at)  # a slash at the end of the tag closes no such element
            at = m.end() if m else end
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph; an item ends the item before it
                if stack[i].name == "p" or (stack[i].name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option") and i > 0):
                    close(i)
                    break
                if stack[i].name in BLOCK and stack[i].name not in HEADINGS:
                    break
        if len(stack) > DEEPEST or (attrs.rstrip().endswith("/") and name not in BLOCK):
            continue
        numbers += 1
        node = Node(name, numbers, stack[-1], attrs)
        if (node.boiler, node.named) != (stack[-1].boiler, stack[-1].named) and name not in BLOCK:
            flush()  # an inline part that is no text of the article stands alone
        stack.append(node)
        anchor += name == "a"
    flush()
    return out


def ratios(found: list[Block]) -> tuple[list[float], list[float]]:
    """Fused tag-path ratio of every block, as it is and smoothed in page order."""
    total: dict[int, list[float]] = {}
    for b in found:
        t = total.setdefault(b.path, [0, 0, 0, 0])
        t[0] += len(b.text)
        t[1] += sum(map(b.text.count, MARKS))
        t[2] += min(b.links, len(b.text))
        t[3] += 1
    fused = {p: math.log1p(chars / n) * (1 + math.log1p(marks / n)) * (1 - linked / chars) ** 2 for p, (chars, marks, linked, n) in total.items()}
    line = [fused[b.path] for b in found]
    half = len(SMOOTH) // 2
    return line, [sum(w * line[j] for j, w in zip(range(i - half, i + half + 1), SMOOTH, strict=True) if 0 <= j < len(line)) for i in range(len(line))]


def decide(found: list[Block], own: list[float]) -> None:
    """Elements that only a word calls boilerplate: those without most of the page's text of a high ratio are left out.

    The others are kept, and are the article of blocks that lie in no other. Where the page marks an article with text, none
    outside it is kept.
    """
    if not any(b.node.named for b in found):
        return
    if any(b.keep and b.article is not None and not b.node.named for b in found):
        for b in found:
            b.keep = b.keep and not (b.node.named and b.article is None)
    open_ = [(o, b) for o, b in zip(own, found, strict=True) if b.keep]
    bar = SEED * max((o for o, _ in open_), default=0.0)
    high = [b for o, b in open_ if o > 0 and o >= bar]
    inside: dict[int, int] = {}
    for b in high:
        for number in b.node.named:
            inside[number] = inside.get(number, 0) + len(b.text)
    total = sum(len(b.text) for b in high)
    for b in found:
        if any(2 * inside.get(number, 0) <= total for number in b.node.named):
            b.keep = False
        elif b.node.named and b.article is None:
            b.article = b.node.named[0]


def extract(page: str | None) -> str:
    """Main text of one page."""
    found = blocks(page) if page else []
    if not found:
        return ""
    own, smooth = ratios(found)
    decide(found, own)
    most = max((r for r, b in zip(smooth, found, strict=True) if b.keep), default=0.0)
    seeds = [b for r, o, b in zip(smooth, own, found, strict=True) if b.keep and r >= SEED * most and o >= SEED * SEED * most]
    if not seeds:
        return ""
    marked: dict[int, int] = {}
    for b in seeds:
        if b.article is not None:
            marked[b.article] = marked.get(b.article, 0) + len(b.text)
    if marked:  # the page says where its article is
        bar = INSIDE * most
        chosen = [b for r, o, b in zip(smooth, own, found, strict=True) if b.keep and b.article in marked and ((r >= bar and o >= bar) or b.node.name in HEADINGS)]
        return "\n".join(b.text for b in chosen)
    common = set(seeds[0].chain())
    for b in seeds[1:]:
        common.intersection_update(b.chain())
    root = max(common)  # numbers rise from the root down
    inside = [i for i, b in enumerate(found) if b.keep and root in b.chain()]
    paths = {b.path for b in seeds}
    at = {id(b) for b in seeds}
    places = [i for i, b in enumerate(found) if id(b) in at]
    first, last = places[0], places[-1]
    prose = [i for i in inside if 2 * found[i].links < len(found[i].text)]
    return "\n".join(found[i].text for i in prose if first <= i <= last or found[i].path in paths or found[i].node.name in HEADINGS)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: extract(p if isinstance(p, str) else None))

    return pick(pages, "page_id", "url", "html").select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
