"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text under one chain of open elements, inline elements left out of
the chain. Blocks with equal chains (tag names and classes, root to leaf) form a tag path. For each path:
its characters, punctuation marks and link characters a block. The two ratios are smoothed along the page
over neighbouring blocks, fused by their product and the share of text outside links, and compared with a
threshold (half their weighted mean). Blocks of paths above it vote, with their length, for the elements
around them; the innermost element that holds nearly all votes - or the article or main element that holds
most - is the content node. Its text is all blocks below it, short ones too, without those in menus,
headers, footers, sidebars, notices, adverts, forms, comments and the like and, where the node is no article
or main element, without paths that are mostly links.

What is a menu, a footer and so on is told by element and role, and by the words of class and id: words that mean
nothing else (sidebar, cookie, advert) or a name of such words alone (share-buttons, comment-list) decide by
themselves; a name that merely holds one (share-price, comment-on-law) marks clutter only if most text below
it is on paths that did not vote.

Character references are decoded; white space inside a block becomes one space; blocks are joined in page
order by one space. Elements that were never closed end where HTML ends them (a p at the next block, a li at
the next li). Quotes count in attributes after = only, and a quote that is not closed before the next attribute
ends with its tag. Time grows with the length of the page, also for deep nesting.

Null and empty pages, and pages without text, give an empty text; an empty table gives an empty one. Rows are kept as
they are, repeated ones too. Only the page's column is read; others, of any name but ``text``, are passed on.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, small_batches, table

#: Comments; tags whose attributes are well formed; other tags, up to the first > or, with an = or nothing in them, up to the next <; declarations.
MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<attributes>(?:[\s/]++(?:[^\s/><][^\s/>=<]*+(?:\s*+=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|(?!["'])[^\s><]++|(?=>)))?)?)*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/><]*+)(?P<attributes2>[^<>]*+(?=>)|\s*+(?=<)|[^<>=]*+=[^<>]*+(?=<))>?
    |<[!?/][^>]*>""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)""", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？؟]")

RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
#: These do not break the text around them.
SILENT = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text is never the article's.
NEVER = frozenset("nav footer aside form button select option menu dialog svg canvas object head script style noscript template iframe textarea title datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words of a class or id that mark clutter whatever stands beside them.
CLUTTER = frozenset(
    "ads advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs nav navbar sidebar aside footer masthead cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe signup login commentlist disqus pagination pager toolbar topbar".split()
)
#: Words that mark clutter in names made of these, of the words above and of layout words only.
AMBIGUOUS = frozenset("ad promotion banner menu navigation notice notices notification alert search share sharing social related recommended recommendations comment comments replies reply respond widget skip".split())
LAYOUT = frozenset(
    "area article articles bar block blog body bottom box btn button buttons cell center col column container content form frame grid group head header holder icon icons inner item items js layer left line link "
    "links list main mod module news outer page pane panel post posts reader right row section site slot story strip text thread title top unit user users view wrap wrapper zone".split()
)
HEADERS = frozenset(("header", "head", "topbar"))
#: Beside one of these a header is the article's own.
OF_ARTICLE = frozenset("article post entry story content title headline".split())
#: An opening tag closes an open element of the set, up to the nearest element that bars the way.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BARS = frozenset("table td th caption button object template html body article main section div".split())
SMOOTH = 2
NEARLY_ALL = 0.9


class Node:
    """An element; ``number`` counts elements in page order, so those below it are number + 1 to end."""

    __slots__ = ("tag", "parent", "block", "path", "clutter", "hint", "weak", "header", "article", "below_article", "holds_article", "votes", "total", "number", "end", "depth", "at")

    def __init__(self, tag: str, parent: Node | None, names: str, paths: dict, number: int, at: int):
        self.tag, self.parent, self.number, self.end, self.at = tag, parent, number, None, at
        inline = parent is not None and tag in INLINE
        self.block = parent.block if inline else self
        self.path = parent.path if inline else paths.setdefault((parent.path if parent else 0, tag, names), len(paths) + 1)
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.below_article = bool(parent and (parent.below_article or parent.tag == "article"))
        self.clutter = self.hint = self.weak = self.header = False
        self.holds_article = tag in ("article", "main")
        self.votes = self.total = 0

    def holds(self, other: Node) -> bool:
        return self.number <= other.number <= self.end


def classes(attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Names for the path, and whether the attributes mark clutter for sure, by a hint, by a weak one, or a header."""
    names, sure, hint, weak, header = "", False, False, False, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if key == "role":
            sure |= value.lower() in ROLES
            header |= value.lower() == "banner"
        elif key == "hidden":
            sure = True
        elif key == "aria-hidden":
            sure |= value.lower() == "true"
        elif key == "style":
            sure |= "display:none" in value.replace(" ", "").lower()
        elif value:
            for name in value.split():
                words = {w.lower() for w in WORD.findall(name)}
                unclear = words & AMBIGUOUS
                hint |= not CLUTTER.isdisjoint(words) or bool(unclear) and words <= AMBIGUOUS | LAYOUT
                weak |= bool(unclear)
                header |= not HEADERS.isdisjoint(words) and OF_ARTICLE.isdisjoint(words)
            names += f".{value}" if key == "class" else ""
    return names, sure, hint, weak and not hint, header


def blocks_of(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(innermost block element, text, link characters) of each block in page order, and all elements, the root first."""
    paths: dict = {}  # a number for each tag path
    root = Node("", None, "", paths, 0, 0)
    nodes, stack, blocks, parts = [root], [root], [], []
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a tag
    bars: list[int] = []  # and of those that bar the way to an open p
    links = open_links = 0
    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends later

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1].block, text, min(links, len(text))))
            parts.clear()
        links = 0

    def pop_to(index: int) -> None:
        nonlocal open_links
        while len(stack) > index:
            n = stack.pop()
            open_at[n.tag].pop()
            if n.tag in BARS:
                bars.pop()
            open_links -= n.tag == "a"
            n.end = len(nodes) - 1

    while at < end:
        m = MARKUP.search(page, at, last) if at < last else None
        start = m.start() if m else end
        if start > at:
            parts.append(page[at:start])
            links += (start - at) * (open_links > 0)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attributes = tag.lower(), m["attributes"] or m["attributes2"]
        places = open_at[tag]
        if m["end"] or m["end2"]:
            if tag == "br":
                flush()
            elif places and places[-1] > (stack[-1].block.at if tag in INLINE else bars[-1] if tag == "p" and bars else 0):
                if tag not in INLINE:
                    flush()
                pop_to(places[-1])
            continue
        if tag not in INLINE and tag not in SILENT:
            flush()
            wants, bar = (), 0
            if tag in P_ENDS:
                wants, bar = ("p",), bars[-1] if bars else 0
            elif tag in CLOSES:
                wants, bar = CLOSES[tag][0], max((open_at[b][-1] for b in CLOSES[tag][1] if open_at[b]), default=0)
            above = [open_at[w][k] for w in wants if (k := bisect_right(open_at[w], bar)) < len(open_at[w])]
            if above:
                pop_to(min(above))
            if tag[0] == "h" and tag[1:].isdigit() and len(stack) > 1 and re.fullmatch("h[1-6]", stack[-1].tag):
                pop_to(len(stack) - 1)
        if tag in VOID:
            continue
        names, sure, hint, weak, header = classes(attributes) if attributes else ("", False, False, False, False)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(page, at)
            at = page.find(">", close.end()) + 1 or end if close else end
            continue
        if attributes and attributes.endswith("/") and tag == "svg":
            continue
        if tag == "a" and places and places[-1] > stack[-1].block.at:  # an a ends an open a
            pop_to(places[-1])
        node = Node(tag, stack[-1], names, paths, len(nodes), len(stack))
        plain = tag not in ("html", "body", "article", "main")
        node.clutter, node.hint, node.weak, node.header = tag in NEVER or sure, hint and plain, weak and plain, tag == "header" or header and plain
        open_links += tag == "a"
        nodes.append(node)
        stack.append(node)
        places.append(node.at)
        if tag in BARS:
            bars.append(node.at)
        up = node.parent if node.holds_article else None
        while up and not up.holds_article:
            up.holds_article = True
            up = up.parent
    flush()
    pop_to(1)
    root.end = len(nodes) - 1
    return blocks, nodes


def cluttered(nodes: list[Node]) -> list[bool]:
    """Of each element, whether it or one around it is clutter; headers count outside article and main only."""
    found: list[bool] = []
    for n in nodes:
        own = n.clutter or (n.hint and not n.holds_article) or (n.header and not n.article and not n.holds_article)
        found.append(own or n.parent is not None and found[n.parent.number])
    return found


class Ratios:
    """Ratios of the tag paths of some blocks, and which paths vote."""

    def __init__(self, blocks: list[tuple[Node, str, int]]):
        chars, marks, self.linked, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
        for node, text, links in blocks:
            chars[node.path] += len(text)
            marks[node.path] += len(PUNCTUATION.findall(text))
            self.linked[node.path] += links
            count[node.path] += 1
        by_chars = [chars[n.path] / count[n.path] for n, _, _ in blocks]
        by_marks = [1 + marks[n.path] / count[n.path] for n, _, _ in blocks]
        smoothed = []
        for ratios in (by_chars, by_marks):
            total = [0.0]
            for r in ratios:
                total.append(total[-1] + r)
            n = len(ratios)
            smoothed.append([(total[min(n, i + SMOOTH + 1)] - total[max(0, i - SMOOTH)]) / (min(n, i + SMOOTH + 1) - max(0, i - SMOOTH)) for i in range(n)])
        fused = [a * b * (1 - self.linked[n.path] / max(1, chars[n.path])) for a, b, (n, _, _) in zip(*smoothed, blocks, strict=True)]
        # a path's fused ratio: the mean over its blocks, then the threshold
        self.by_path: dict[int, float] = defaultdict(float)
        for f, (n, _, _) in zip(fused, blocks, strict=True):
            self.by_path[n.path] += f / count[n.path]
        self.threshold = 0.5 * sum(f * len(t) for f, (_, t, _) in zip(fused, blocks, strict=True)) / sum(len(t) for _, t, _ in blocks)
        self.chars = chars

    def votes(self, path: int) -> bool:
        return self.by_path[path] >= self.threshold

    def mostly_links(self, path: int) -> bool:
        return 2 * self.linked[path] >= self.chars[path]


def count_votes(nodes: list[Node], blocks: list[tuple[Node, str, int]], ratios: Ratios) -> None:
    """Votes and characters of every element, those below it included."""
    for n in nodes:
        n.votes = n.total = 0
    for node, text, links in blocks:
        node.votes += (len(text) - links) * ratios.votes(node.path)
        node.total += len(text)
    for n in reversed(nodes[1:]):
        n.parent.votes += n.votes
        n.parent.total += n.total


def main_text(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    blocks, nodes = blocks_of(page)
    hidden = cluttered(nodes)
    blocks = [b for b in blocks if not hidden[b[0].number]]
    if not blocks:
        return ""
    ratios = Ratios(blocks)
    count_votes(nodes, blocks, ratios)
    if any(n.weak and 2 * n.votes < n.total for n in nodes):  # weak hints that the ratios bear out
        for n in nodes:
            n.hint |= n.weak and 2 * n.votes < n.total
        hidden = cluttered(nodes)
        blocks = [b for b in blocks if not hidden[b[0].number]]
        if not blocks:
            return ""
        ratios = Ratios(blocks)
        count_votes(nodes, blocks, ratios)
    root = nodes[0]
    content, inside = root, None
    for node in nodes:
        if not node.total:
            continue
        if node.tag in ("article", "main") and 2 * node.votes >= root.votes and not node.below_article:
            if inside is None or (node.votes, node.tag == "article") >= (inside.votes, inside.tag == "article"):
                inside = node
        if node.votes >= NEARLY_ALL * root.votes and node.tag not in INLINE and node.depth > content.depth and node.tag not in ("p", "li", "td", "tr", "h1", "h2", "h3"):
            content = node
    if inside is not None:
        return " ".join(t for n, t, _ in blocks if inside.holds(n))
    return " ".join(t for n, t, _ in blocks if content.holds(n) and not ratios.mostly_links(n.path))


def extract(df: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """``keep`` columns and ``text``, the main text of every whole page."""
    small_batches(df.sparkSession)
    return map_batches(df, keep, lambda b: {"text": [main_text(x) for x in b.column(page).to_pylist()]}, T.StructType([T.StructField("text", T.StringType())]), [page])


def op4_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))
