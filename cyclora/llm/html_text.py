"""Main text of web pages by composite text density.

A page becomes a tree of elements, without what no reader sees as text: scripts, styles, controls, hidden parts. For every
node the composite density is worked out: characters for each tag, adjusted by the characters and tags of links, and by
how linked the page is as a whole. A node's sum is the sum of its children's densities. The node of the largest sum holds the
page's text, and the least density on the path from the body to it is the threshold. The text widens by that threshold: a
part beside the path whose density and sum reach it belongs to the text, too; a footer or an advert of one bare line has a
sum of nothing.

Element, role and the words of class and id have no part in densities, sums and the threshold. They settle doubt, by a factor
that a named part has to make up for: `WORDS` where words of page layout name it, `PARTS` where its element or role does,
`STRANGER` where it is named for what is strange to an article wherever it stands. Its sum is lowered by that much among the
candidates for the text's node, and its density and sum are before the threshold, to come in from beside the path or to stay where
it lies within the chosen node. Elements `article` and `main` break ties between equal sums, and a
header within one is its own.

Text: character references are decoded, white space within a block becomes one blank, blocks come in page order, one a
line. Nulls: a null page is empty and has no text. A page cut off anywhere is read as far as it goes. Repeated rows give
equal rows. Nothing is dropped or cut for its length; depth is handled without recursion. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import pairwise
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import ship

#: Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noframes noembed".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = set(
    "head script style noscript iframe template textarea title fieldset button select option dialog svg canvas object embed audio video map label input".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | set("p pre blockquote ul ol dl table figure details address center".split())
LOWERED = set("nav footer aside menu".split())
ROLES = set("navigation banner contentinfo complementary menu menubar toolbar".split())
STRANGE_ROLES = set("search dialog alertdialog alert form".split())
#: Words of class and id that lower a density: of page layout, and of what is strange to an article wherever
#: it stands.
LAYOUT = set(
    "banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside header masthead topbar footer bottom copyright"
    " widget widgets toolbar pagination pager skip search searchform form".split()
)
STRANGE = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot adunit sponsor sponsored promo promotion taboola outbrain"
    " cookie cookies consent gdpr notice notices alert alerts announcement disclaimer toast comment comments commentlist reply replies"
    " share sharing social respond disqus discussion related recommended newsletter subscribe subscription signup login popup modal overlay".split()
)
#: With one of these words beside it, `header` is an article's own.
OWN = set("article content entry post story".split())
#: What a named part's density and sum are multiplied by where they are compared. A form, or a part that only words of layout
#: speak of, is not doubted if it holds most of the page.
WORDS, PARTS, STRANGER = 0.25, 0.2, 0.02
#: A class that says what a part has or lacks does not say what it is.
_ABOUT_OTHERS = re.compile(r"^(?:has|no|with|without|hide|show)[-_]|[-_](?:with|without|no|has)[-_]", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Which open element a new one ends, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "body", "html", "summary"}
_STOPS_P = {"td", "th", "table", "button", "article", "section", "div", "li", "body", "blockquote", "main", "aside", "nav", "footer", "header"}


class Node:
    __slots__ = ("article", "body", "chars", "density", "hint", "inner", "link_chars", "link_tags", "parent", "place", "sum", "tag", "tags", "weight")

    def __init__(self, tag: str, parent: Node | None, hint: float = 1.0):
        self.tag, self.parent, self.hint = tag, parent, hint  # the hint is 0 for what is not read at all
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.body: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.place = 0
        self.inner = 0  # characters outside links and parts of other kinds than the article's
        self.density = self.sum = 0.0
        self.weight = 1.0


def hint(tag: str, attributes: str, within_article: bool) -> float:
    """How far an element, its role and the words of its class and id put it in doubt; 0 if it is not read."""
    if tag in UNSEEN:
        return 0.0
    found = STRANGER if tag == "form" else PARTS if tag in LOWERED or tag == "header" and not within_article else 1.0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            words = {w.lower() for x in value.split() if not _ABOUT_OTHERS.search(x) for w in _PART.findall(x)}
            if within_article or words & OWN:
                words.discard("header")
            if words & STRANGE:
                found = STRANGER
            elif tag != "article" and words & LAYOUT:
                found = min(found, WORDS)
        elif name == "role" and value.strip().lower() in STRANGE_ROLES:
            found = STRANGER
        elif name == "role" and value.strip().lower() in ROLES:
            found = min(found, PARTS)
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return 0.0
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
    return found


def parse(html: str) -> Node:
    """The page's tree. Unclosed elements end where HTML lets them end."""
    top = Node("html", None)
    open_: list[Node] = [top]
    seen: set[str] = set()  # of elements that have begun: an end tag of another has nothing to end
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                open_[-1].body.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(0) if tag not in seen else range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in ("article", "main", "body") and tag not in ("body", "html", "div", "main", "section"):
                    break
            continue
        if tag in ("html", "body") and (tag == "html" or "body" in seen):
            continue
        if tag in _ENDS_P:
            _close(open_, {"p"}, _STOPS_P)
            if tag[0] == "h" and tag[1:].isdigit() and open_[-1].tag[0] == "h" and open_[-1].tag[1:].isdigit():
                open_.pop()
        elif tag in _ENDS:
            _close(open_, *_ENDS[tag])
        if tag == "body":
            _close(open_, {"head"}, set())
        node = Node(tag, open_[-1], hint(tag, m[3], open_[-1].article))
        seen.add(tag)
        open_[-1].body.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else n
            node.hint = 0.0
            continue
        open_.append(node)
    return top


def _close(open_: list[Node], tags: set[str], stops: set[str]) -> None:
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag in tags:
            del open_[i:]
            return
        if open_[i].tag in stops:
            return


def _ordered(top: Node) -> list[Node]:
    """The nodes that are read, parents before children, in page order."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        node.place = len(out)
        out.append(node)
        todo += [x for x in reversed(node.body) if isinstance(x, Node) and x.hint]
    return out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    """Characters for each tag, lowered by the share of links in both; link_share: of the page's characters."""
    if not chars:
        return 0.0
    unlinked = max(1, chars - link_chars)
    tags, link_chars, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = log(log(chars / unlinked * link_chars + link_share * chars + e))
    return chars / tags * log(max(1.0, chars / link_chars * tags / link_tags)) / base


def measure(top: Node) -> list[Node]:
    """Characters, tags, links, weights, composite densities and their sums, of all nodes that are read."""
    nodes = _ordered(top)
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.body if isinstance(x, str))
        node.inner += sum(len("".join(x.split())) for x in node.body if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags, node.inner = node.chars, node.link_tags + 1, 0
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.inner += node.inner if node.hint in (1.0, WORDS) else 0
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole = nodes[0]
    share = whole.link_chars / max(1, whole.chars)
    for node in nodes:
        most = 2 * node.inner > whole.inner if node.hint == WORDS else 2 * (node.chars - node.link_chars) > whole.chars - whole.link_chars
        own = 1.0 if most and (node.hint == WORDS or node.tag == "form") else node.hint
        node.weight = min(own, node.parent.weight) if node.parent else own
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.parent:
            node.parent.sum += node.density
    return nodes


def _holds(node: Node) -> set[str]:
    """The kinds of blocks with text that a node is built of."""
    return {x.tag for x in node.body if isinstance(x, Node) and x.hint and x.chars and x.tag in BLOCKS}


def _heading(node: Node) -> bool:
    """Whether all that a node has is a heading."""
    while node.tag not in HEADINGS:
        inner = [x for x in node.body if isinstance(x, Node) and x.hint and x.chars]
        if len(inner) != 1 or inner[0].chars != node.chars:
            return False
        node = inner[0]
    return True


def densest(nodes: list[Node]) -> Node:
    """The node of the largest sum among those built of blocks. The page's body holds whatever the page has, so it counts
    without the density of the part that the next best lies in, and without bare lines that are no paragraphs."""

    def largest(some: list[Node]) -> Node:
        return max(some, key=lambda x: (x.sum * x.weight, x.tag in ("article", "main"), -x.place))

    built = [x for x in nodes if _holds(x)] or [nodes[0]]
    best = largest(built)
    inner = [x for x in built if x.tag not in ("html", "body")]
    if best.tag in ("html", "body") and inner:
        other = largest(inner)
        part = next(x for x in [other, *_above(other)] if x.parent in (best, None))
        bare = sum(x.density for x in best.body if isinstance(x, Node) and x.hint and x is not part and x.tag not in PARAGRAPHS and not _holds(x))
        if other.sum * other.weight > best.sum - part.density - bare:
            return other
    return best


def _reaches(node: Node, least: float) -> bool:
    return min(node.density, node.sum) * node.weight >= least


def main_nodes(top: Node) -> tuple[list[Node], float]:
    """The nodes that make up the page's text, in page order, none within another; and the threshold."""
    nodes = [x for x in measure(top) if x.chars]
    if not nodes:
        return [], 0.0
    best = densest(nodes)
    if best.weight <= STRANGER:  # a page of menus alone
        return [], 0.0
    path = [best, *_above(best)]
    least = min(x.density for x in path)
    kinds = _holds(best)
    chosen = [best]
    for inner, outer in pairwise(path):
        for x in outer.body:
            if isinstance(x, Node) and x is not inner and x.hint and x.chars:
                if _reaches(x, least) or x.weight == 1 and (_heading(x) or x.tag in PARAGRAPHS and x.density >= least and x.tag in kinds):
                    chosen.append(x)
    return sorted(chosen, key=lambda x: x.place), least


def _above(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def text_of(roots: list[Node], least: float = 0.0) -> str:
    """The blocks of the nodes, one a line, without named parts that the threshold leaves in doubt."""
    lines, now = [], []

    def end() -> None:
        line = " ".join(unescape("".join(now)).split())
        if line:
            lines.append(line)
        now.clear()

    for root in roots:
        todo: list[Node | str | None] = [root]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif not x.hint or x.weight < root.weight and x.density * x.weight <= least:
                if x.tag in BLOCKS:
                    end()
            elif x.tag == "br":
                now.append(" ")
            else:
                block = x.tag in BLOCKS
                if block:
                    end()
                    todo.append(None)
                todo += reversed(x.body)
        end()
    return "\n".join(lines)


def extract(html: str | None) -> str:
    return text_of(*main_nodes(parse(html))) if html else ""


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    kind = pages.schema[page_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                found = [extract(x.as_py()) for x in batch.column(2)]
                sizes = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars bigint")


ship(__name__)
