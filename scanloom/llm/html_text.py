"""Main text of web pages by tree scoring.

Paragraphs pass points to their ancestors: one for being a paragraph, one for each comma, one for each hundred
characters up to three; all to the parent, half to the grandparent, a third and less further up. A container's points are
discounted by the share of its text that lies in links. The best container is the article; siblings that
score well beside it, or are plain paragraphs with few links, belong to it. Page furniture is cut out before: what its element,
role or style says is furniture, what its class calls an advert, a notice or comments, and what its class calls layout, unless it
holds most of the text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import batch_of, row_groups
from .shared import bounded_batches

#: Quotes count only where a value begins; a quote anywhere else, or one that isn't closed, is a character like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")

#: Elements without an end, whose text isn't markup, that are blocks, that never hold main text, and that points go to.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog fieldset footer form frame frameset head header iframe input label link map menu meta nav noscript object option optgroup script select style svg template textarea title video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of names in class and id: of layout, which may wrap an article; of adverts, notices and readers' comments, which don't,
#: though they may be longer than it; and of content.
LAYOUT = frozenset("banner breadcrumb breadcrumbs footer masthead menu nav navbar navigation pager pagination share sharing sidebar social toolbar widget".split())
OTHERS = frozenset("ad ads adbox adsense advert adverts advertisement advertising advertisment comment commentlist comments consent cookie cookies disqus modal newsletter notice notification popup promo promoted replies respond shoutbox sponsor sponsored sponsors subscribe".split())
CONTENT = frozenset("article body content entry main post story text".split())
#: Names that begin like this say something of an element's state or surroundings.
STATE = frozenset("has hide hides is no not show shows with without".split())
#: A header or something related is furniture alone or with these words; a section's or an article's isn't.
HEADERS = frozenset("app blog fixed global layout main mobile page site sticky top web".split())
RELATED = frozenset("articles content items links news posts reading stories".split())
#: What only its name calls layout stays if it holds so much of the page's text.
MOST = 0.5
#: Which open elements a start tag ends, up to what.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "doubtful", "good", "points", "size", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, doubtful: bool, good: bool):
        self.tag, self.parent, self.parts, self.dropped, self.doubtful, self.good = tag, parent, [], dropped, doubtful, good
        self.points = 0.0
        self.size = self.linked = self.commas = 0


@lru_cache(100_000)
def said_by(names: str) -> tuple[bool, bool, bool]:
    """What names of class and id say: layout, other furniture, content."""
    layout = others = content = False
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if not words or len(words) > 1 and words[0] in STATE:
            continue
        rest = set(words) - {"header", "related"}
        layout |= bool(LAYOUT.intersection(words))
        layout |= "header" in words and (not rest or rest <= HEADERS) or words[0] == "related" and (not rest or bool(rest & RELATED))
        others |= bool(OTHERS.intersection(words))
        content |= bool(CONTENT.intersection(words))
    return layout, others, content


def judged(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is furniture for sure, whether only its name says so, and whether the name says that it holds content."""
    if tag in DROPPED:
        return True, False, False
    sure = doubtful = good = False
    if attributes and "=" in attributes or "hidden" in attributes:
        names = []
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                sure |= value.strip().lower() in DROPPED_ROLES
            elif name == "style":
                sure |= "display:none" in value.replace(" ", "").lower()
            elif name == "hidden":
                sure = True
            else:
                sure |= value.lower() == "true"
        if names and tag not in ("html", "body", *HEADING):
            layout, others, good = said_by(" ".join(names))
            kept = good and tag in ("article", "main")
            sure |= others and not kept
            doubtful = layout and not kept
    return sure, doubtful, good


class Path:
    """The open elements, outer ones first, and the places of those of a name and of blocks: no step looks through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.blocks, self.named = [], [], {}
        self.enter(root)

    def enter(self, node: Node) -> None:
        self.named.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a name, -1 for none."""
        places = self.named.get(tag)
        return places[-1] if places else -1

    def leave(self, place: int) -> Node:
        """Ends the element at ``place`` and all in it; its parent is the innermost then."""
        while len(self.nodes) > place:
            self.named[self.nodes.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()
        return self.nodes[-1]


def parse(page: str) -> Node:
    """The tree of a page, however broken and deep: ends without a start are passed over, missing ends are made up."""
    root = Node("html", None, False, False, False)
    now, path, at, size = root, Path(root), 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if found is None:
            now.parts.append(page[at:])
            break
        if found.start() > at:
            now.parts.append(page[at : found.start()])
        at = found.end()
        if found.end() == found.start():
            break
        if found[1] is not None:
            now.parts.append(found[1].replace("&", "&amp;"))
        if not found[3]:
            continue
        tag = found[3].lower()
        if found[2]:
            place = path.last(tag)
            if place > 0:
                now = path.leave(place)
            elif tag == "p":
                now.parts.append(Node("p", now, False, False, False))
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            # a block ends an open paragraph
            place = path.blocks[-1]
            if path.nodes[place].tag == "p":
                now = path.leave(place)
        if tag in CLOSES:
            ended, limit = CLOSES[tag]
            place = max(map(path.last, ended))
            if place > 0 and place > max(map(path.last, limit)):
                now = path.leave(place)
        node = Node(tag, now, *judged(tag, found[4] or ""))
        now.parts.append(node)
        if tag in VOID or (found[4] or "").endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            held = page[at : end.start() if end else size]
            node.parts.append(held if tag in ("textarea", "title") else held.replace("&", "&amp;"))
            at = end.start() if end else size
            if end:
                close = page.find(">", at)
                at = size if close < 0 else close + 1
            continue
        path.enter(node)
        now = node
    return root


def in_order(root: Node):
    """All nodes that aren't furniture, parents first."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [p for p in reversed(node.parts) if type(p) is Node and not p.dropped]


def without_doubt(root: Node) -> None:
    """Of what only names call layout, all goes that doesn't hold most of the page's text; inside what stays, the same is asked."""
    nodes = list(in_order(root))
    if any(n.doubtful for n in nodes):
        whole = measure(root)[0].size
        for node in nodes:  # parents first; what lies in a dropped one goes with it
            if node.doubtful and node.size < MOST * whole:
                node.dropped = True


def measure(root: Node) -> list[Node]:
    nodes = list(in_order(root))
    for node in reversed(nodes):
        node.size = node.linked = node.commas = 0
        for p in node.parts:
            if type(p) is Node:
                if not p.dropped:
                    node.size += p.size
                    node.linked += p.size if p.tag == "a" else p.linked
                    node.commas += p.commas
            else:
                node.size += len(SPACE.sub(" ", p).strip())
                node.commas += p.count(",")
    return nodes


def link_share(node: Node) -> float:
    return (node.size if node.tag == "a" else node.linked) / node.size if node.size else 0.0


def article_of(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    without_doubt(root)
    nodes = measure(root)
    candidates = []
    for node in nodes:
        own_text = sum(len(p.strip()) for p in node.parts if type(p) is str)
        if not (node.tag in PARAGRAPH or own_text >= 25) or node.size < 1 or node.parent is None:
            continue
        if node.tag not in PARAGRAPH and any(type(p) is Node and p.tag in PARAGRAPH for p in node.parts):
            continue
        points = 1.0 + node.commas + min(3.0, node.size / 100)
        to, level = node.parent if node.tag in PARAGRAPH else node, 0
        while to is not None and level < 5:
            to.points += points / (1, 2, 6, 9, 12)[level]
            to, level = to.parent, level + 1
    for node in nodes:
        if node.points:
            extra = 25.0 if node.good or node.tag in ("article", "main") else 0.0
            node.points = (node.points + extra) * (1 - link_share(node))
            candidates.append(node)
    if not candidates:
        return [root] if root.size else []
    best = max(candidates, key=lambda n: n.points)  # of equals the first, which is the outer one
    # an article or main around the best container is the whole article
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.parent
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points)
    return [s for s in best.parent.parts if type(s) is Node and not s.dropped and (s is best or belongs(s, least))]


def belongs(node: Node, least: float) -> bool:
    if node.points >= least:
        return True
    if node.tag not in ("p", "pre", "blockquote", *HEADING):
        return False
    share = link_share(node)
    return node.size > 80 and share < 0.25 or 0 < node.size <= 80 and share == 0


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks in page order; inline elements run on, line breaks are white space."""
    out, line = [], []

    def end():
        if line:
            text = SPACE.sub(" ", "".join(line)).strip()
            if text:
                out.append(text)
            line.clear()

    for root in roots:
        waiting: list = [root]
        while waiting:
            p = waiting.pop()
            if p is None:
                end()
            elif type(p) is str:
                line.append(html.unescape(p))  # each by itself: a reference doesn't go on behind a tag
            elif p.tag == "br":
                line.append(" ")
            elif not p.dropped:
                if p.tag in BLOCK:
                    end()
                    waiting.append(None)
                waiting += reversed(p.parts)
        end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty for null, for no text, and for nothing but furniture."""
    return "\n".join(blocks(article_of(parse(page)))) if page else ""


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); columns of these names are replaced, ``page`` is kept.

    Each row is worked on by itself, whole, however long; repeated rows come out each.
    """
    bounded_batches(pages.sparkSession)
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    types = dict(pages.dtypes)

    def run(batches):
        for batch in row_groups(batches, page, 1 << 20):
            text = [main_text(x) for x in batch.column(page).to_pylist()]
            yield batch_of(**{c: batch.column(c) for c in own}, text=pa.array(text, pa.string()), n_chars=pa.array(map(len, text), pa.int64()))

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in own), "text string, n_chars long"])
    return pages.select(*own).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
