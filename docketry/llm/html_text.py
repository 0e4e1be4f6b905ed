"""Main text of web pages by tag-path ratios (operator 7).

A page is read as a sequence of text nodes, each with the path of all open elements
above it, from the root to the leaf. Per path the page's text length, punctuation, link text
and number of nodes are summed. Two ratios - text per node and punctuation per
node - are smoothed along the page, node by node, fused (the product of
their logarithms), damped by the path's share of link text and by what its markup says, and
held against a share of the page's largest value. The paths that pass are the content;
they, and nothing else, say where the article is:

* every text on a content path is content;
* the containers (div, section, article ...) of content paths are taken whole, with what
  stands inside or between them, so short paragraphs, headings, quotes and linked text of
  the article stay; containers that are mostly links, and lists of nothing but short
  links that no text leads to, go.

Markup damps a path's ratio and doesn't decide alone: elements whose tag, role or class
word is that of a menu, notice, advert, comment or form (``AGAINST``), and what stands outside
the page's article or main, where that holds more than a little of it (``OUTSIDE``). A path with
both kinds of elements counts as two. A class word counts
where it is what the name stands for ("site-footer", not "has-footer" or
"footer-design"). Names that say plainly what they hold (``PLAIN_WORDS``: comments, related,
sidebar ...) count whatever the size, unless the element holds the page's first heading or its main part.
The others (widget, notice ...), and forms, which some pages put around everything, count only for
elements that don't hold the bulk of the text that is left. Where the article's whole text is linked, it counts as plain text.

Work is page by page inside Arrow functions, so Spark deals pages out and
nothing is shuffled. Reading is one pass of a tokenising pattern; end tags
that are missing are supplied (a new block ends an open paragraph), and end
tags without a start are ignored. Paths and containers are numbers that know what is above
them, and open elements are found by their tag, so time and memory follow the page's length, however deep it nests.

Defined cases: null or empty html gives empty text. Pages are read whole, whatever their length or depth. A page whose paths all stay
below ``FLOOR`` gives empty text. Equal values pass alike. Repeated rows are handled each;
extra columns are ignored unless named in ``keep``. Empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import importable

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
UNSHOWN = frozenset("script style noscript template iframe head title svg math object canvas audio video select option datalist textarea button input nav header footer aside menu dialog".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr br details summary fieldset legend center header footer nav aside form".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Elements that hold the page; their classes speak of its layout.
WHOLE = frozenset("html body main".split())
# Words of class, id and role that mark what isn't the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets related recommended "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond discussion disqus "
    "responses reactions teaser teasers pagination pager copyright legal disclaimer search contentinfo complementary dialog skip hidden".split()
)
# Those of them that say plainly what an element holds, as a box of the layout isn't called so; among them what marks readers' text, which is often longer than the article.
PLAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar related recommended footer cookie cookies consent gdpr "
    "newsletter subscribe subscription signup login share sharing comment comments commentlist reply replies respond discussion disqus responses reactions teaser teasers pagination pager".split()
)
# Words at the end of a name that say what kind of box it is, not what it holds; and words before a feature that a layout has or lacks.
BOX_WORDS = frozenset("area author bar body block box button buttons col column container content form group head heading holder icons inner item items leaderboard left link links list main meta outer panel region right row section slot text thread title unit wrap wrapper x".split())
LAYOUT_WORDS = frozenset("has have no non not with without layout one two three enable enabled supports show shows".split())
#: A subtree with a larger share than this of the text that plain names leave isn't ruled out by another class word, or as a form.
SMALL = 0.5
#: Where all class words leave a smaller share of that text, only the plain ones count.
LEFT = 0.25
# Items and cells, what of their kind a new one ends, and what that doesn't reach out of.
ITEMS = {
    "li": (("li",), ("ul", "ol", "dl", "table", "select")),
    "dt": (("dt", "dd"), ("ul", "ol", "dl", "table", "select")),
    "dd": (("dt", "dd"), ("ul", "ol", "dl", "table", "select")),
    "tr": (("tr",), ("ul", "ol", "dl", "table", "select")),
    "td": (("td", "th"), ("ul", "ol", "dl", "table", "tr", "select")),
    "th": (("td", "th"), ("ul", "ol", "dl", "table", "tr", "select")),
    "option": (("option",), ("ul", "ol", "dl", "table", "select")),
}
# Of the elements that aren't read, those that may stand in each other.
NESTING = frozenset("svg math noframes".split())
_RAW_TAG = {tag: re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role|itemtype|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none)", re.I)
# Block elements that stand inside a container's flow of text.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td th tr tbody thead tfoot table figure figcaption caption".split())
#: A container with a larger share of its text in links is a menu, where the page doesn't mark its article.
MOSTLY = 0.6
#: A list of nothing but links of so many words at most is a menu, unless the text before it leads to it.
MENU_WORDS = 3
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Where articles and main hold a smaller share of the plain text, the page's containers are weighed as if there were none.
TOLD = 0.25
#: What a path's ratio is multiplied with if its markup speaks against it, and outside the page's own article.
AGAINST, OUTSIDE = 0.02, 0.02
#: A path of content has at least this share of the page's largest fused ratio, and at least this ratio.
SHARE, FLOOR = 0.4, 0.4
_ENDS = re.compile(r"[.!?…。！？][)\"'”’»]*\Z")
_PART_OF_WORD = re.compile(r"\w")
_BLANK = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、！？；：()\"“”«»¿¡]")


#: Path of elements, text, in a link, marked as not the article, block number, container above it, its list (0: none).
Node = tuple[object, str, bool, bool, int, int, int]


class Tree(NamedTuple):
    """A page: its text nodes in order, with numbers for paths and containers, so that depth costs nothing per node."""

    nodes: list[Node]
    #: Of each path: the path above it, its last tag, and whether it goes through an article and through main.
    paths: list[tuple[int, str, bool, bool]]
    #: Of each container: the container above it; -1 for those that hold the whole page.
    above: list[int]


class _Open(NamedTuple):
    """An open element: tag, path, in a link, marked, the named element and the container around its text, list."""

    tag: str
    path: int
    link: bool
    marked: bool
    name: int
    home: int
    of: int


def _role(name: str) -> str:
    """The word by which a class, id or role says that its element isn't the article: what the name ends in, without words of boxes; else ""."""
    parts = [w.lower() for w in _PART.findall(name)]
    if (whole := "".join(parts)) in ASIDE_WORDS:
        return whole
    if any(w in LAYOUT_WORDS for w in parts):
        return ""
    while parts:
        for word in (parts[-1], "".join(parts[-2:])):
            if word in ASIDE_WORDS:
                return word
        if not (parts[-1] in BOX_WORDS or parts[-1].isdigit()):
            return ""
        parts.pop()
    return ""


def _roles(attributes: str) -> set[str]:
    """The words by which an element's class, id or role says that it isn't the article."""
    if "=" not in attributes:
        return set()
    return {r for m in _NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split() if (r := _role(name))}


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where the content of an element that isn't read ends; drawings may stand in each other."""
    depth = 1
    for m in _RAW_TAG[tag].finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag in NESTING and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


class _Stack:
    """The open elements, and for each tag where its own stand, so that no search looks through all of them."""

    def __init__(self) -> None:
        self.open = [_Open("", 0, False, False, -1, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, x: _Open) -> None:
        self.places.setdefault(x.tag, []).append(len(self.open))
        if x.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(x)

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of ``tags``; 0 if there is none."""
        return max((of[-1] for tag in tags if (of := self.places.get(tag))), default=0)

    def close(self, k: int) -> None:
        """Close the element at ``k`` and all inside it."""
        while len(self.open) > k:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag closes its element; one of an inline element doesn't reach out of its block."""
        k = self.last((tag,))
        if k and (tag in BLOCK or not self.blocks or k > self.blocks[-1]):
            self.close(k)

    def make_room(self, tag: str) -> None:
        """Close what the start of ``tag`` ends: an open paragraph with what inline elements it left open, an item, a cell."""
        if tag in ENDS_PARAGRAPH and self.blocks and self.open[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in ITEMS:
            same, within = ITEMS[tag]
            if (k := self.last(same)) > self.last(within):
                self.close(k)


def page_tree(page: str) -> Tree:
    """The text nodes, in page order, with their paths and containers."""
    out: list[Node] = []
    paths: list[tuple[int, str, bool, bool]] = [(-1, "", False, False)]
    known: dict[tuple[int, str], int] = {}
    above = [-1]
    named = _Named()
    stack = _Stack()
    block, lists, at, n = 0, 0, 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        # The second form is for a tag whose last quote is never closed.
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        here = stack.open[-1]
        if tag is None:
            raw = m[0]
            if raw.startswith("<") and len(raw) > 1:
                continue
            out.append((here.path, entities.unescape(raw) if "&" in raw else raw, here.link, here.marked, block, here.home, here.of))
            named.of_node.append(here.name)
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if ends:
            stack.end(tag)
            continue
        stack.make_room(tag)
        if tag in RAW:
            at = _after_raw(page, tag, at)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        here = stack.open[-1]
        path = known.setdefault((here.path, tag), len(paths))
        if path == len(paths):
            _, _, article, main = paths[here.path]
            paths.append((here.path, tag, article or tag == "article", main or tag == "main"))
        marked = here.marked or tag in UNSHOWN or (tag not in WHOLE and _HIDDEN.search(attributes) is not None)
        name, home, of = here.name, here.home, here.of
        if tag in ("h1", "main"):
            named.holds_page(name)
        if not marked and tag not in WHOLE and (roles := _roles(attributes) | ({"form"} if tag == "form" else set())):
            name = named.add(name, not roles.isdisjoint(PLAIN_WORDS))
        if tag in BLOCK and tag not in INNER:
            # What stands in the whole page's own element isn't for that part of one text.
            above.append(-1 if tag in WHOLE else home)
            home = len(above) - 1
        if tag in ("ul", "ol", "dl"):
            lists += 1
            of = lists
        stack.push(_Open(tag, path, here.link or tag == "a", marked, name, home, of))
    return Tree(named.without(out), paths, above)


def text_nodes(page: str) -> list[Node]:
    """The text nodes, in page order, with their paths written out (which takes the depth's square; the operator reads numbers)."""
    tree = page_tree(page)
    names = [""]
    for parent, tag, *_ in tree.paths[1:]:
        names.append(f"{names[parent]}/{tag}")
    return [(names[x[0]], *x[1:]) for x in tree.nodes]


class _Named:
    """Elements whose name, or tag (a form), says that they aren't the article."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        #: Whether its name says plainly what it holds.
        self.plain: list[bool] = []
        #: Whether it holds the page's first heading or main part, so is a box of the layout.
        self.whole: list[bool] = []
        self.of_node: list[int] = []

    def add(self, parent: int, plain: bool) -> int:
        self.parent.append(parent)
        self.plain.append(plain)
        self.whole.append(False)
        return len(self.parent) - 1

    def holds_page(self, k: int) -> None:
        while k >= 0 and not self.whole[k]:
            self.whole[k] = True
            k = self.parent[k]

    def _inside(self, own: list[bool]) -> list[bool]:
        """Of each element, whether it or one above it is of ``own``; a parent stands before its children."""
        out: list[bool] = []
        for k, p in enumerate(self.parent):
            out.append(own[k] or (p >= 0 and out[p]))
        return [*out, False]

    def without(self, nodes: list[Node]) -> list[Node]:
        """``nodes``, where those of elements that go are marked.

        Plain names go whatever they hold. Other names, forms, and what holds the page's heading or main part go
        where they don't hold the bulk of what plain names leave of the page's text.
        """
        if not self.parent:
            return nodes
        plainly = [p and not w for p, w in zip(self.plain, self.whole, strict=True)]
        theirs = self._inside(plainly)
        size = [0 if link or marked or theirs[k] else len(text.strip()) for (_, text, link, marked, *_), k in zip(nodes, self.of_node, strict=True)]
        whole, held = sum(size), [0] * len(self.parent)
        for n, k in zip(size, self.of_node, strict=True):
            if k >= 0:
                held[k] += n
        for k in range(len(held) - 1, -1, -1):
            if (p := self.parent[k]) >= 0:
                held[p] += held[k]
        gone = self._inside([x or h <= SMALL * whole for x, h in zip(plainly, held, strict=True)])
        if sum(n for n, k in zip(size, self.of_node, strict=True) if not gone[k]) < LEFT * whole:
            gone = theirs
        return [(*x[:3], x[3] or gone[k], *x[4:]) for x, k in zip(nodes, self.of_node, strict=True)]


def _smooth(values: list[float]) -> list[float]:
    """Mean with both neighbours along the page, which weigh half of the value itself."""
    padded = [values[0], *values, values[-1]]
    return [(x + 2 * y + z) / 4 for x, y, z in zip(padded, values, padded[2:], strict=False)]


#: A path, and what its markup multiplies its ratio with.
Key = tuple[object, float]


def path_ratios(nodes: list[Node], keys: list[Key]) -> dict[Key, float]:
    """The fused ratio of each path: text and punctuation per node, smoothed along the page, times the path's own weights."""
    sums: dict[Key, list[float]] = {}
    sequence: list[Key] = []
    for (_, text, link, *_), key in zip(nodes, keys, strict=True):
        if not (size := len(text.strip())):
            continue
        s = sums.setdefault(key, [0.0, 0.0, 0.0, 0])
        s[0] += size
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += size if link else 0
        s[3] += 1
        sequence.append(key)
    if not sequence:
        return {}
    smoothed: dict[Key, list[float]] = {key: [0.0, 0.0] for key in sums}
    for which in (0, 1):
        for key, x in zip(sequence, _smooth([sums[k][which] / sums[k][3] for k in sequence]), strict=True):
            smoothed[key][which] += x / sums[key][3]
    return {
        key: math.log1p(smoothed[key][0]) * math.log(2 + smoothed[key][1]) * (1 - s[2] / s[0]) * key[1] for key, s in sums.items()
    }


def content_paths(nodes: list[Node], keys: list[Key]) -> set[Key]:
    """The paths whose fused ratio passes the page's threshold."""
    fused = path_ratios(nodes, keys)
    limit = max(FLOOR, SHARE * max(fused.values(), default=0.0))
    return {key for key, x in fused.items() if x >= limit}


def _told(shown: list[Node], paths: list[tuple[int, str, bool, bool]]) -> tuple[bool, bool]:
    """Whether article, and whether main, is where the page itself marks its article: main where it holds more than a little beside article; neither if both hold little of the page."""
    article = main = rest = 0
    for path, text, link, *_ in shown:
        n = 0 if link else len(text.strip())
        if paths[path][2]:
            article += n
        elif paths[path][3]:
            main += n
        else:
            rest += n
    if not article + main or article + main < TOLD * (article + main + rest):
        return False, False
    return True, main >= TOLD * (article + main)


def _linked_whole(tree: Tree) -> list[Node]:
    """The nodes; where all text of the page's article and main is linked, that text counts as plain."""
    inside = [not x[3] and (tree.paths[x[0]][2] or tree.paths[x[0]][3]) for x in tree.nodes]
    if any(i and not x[2] and x[1].strip() for i, x in zip(inside, tree.nodes, strict=True)):
        return tree.nodes
    return [(*x[:2], False, *x[3:]) if i else x for i, x in zip(inside, tree.nodes, strict=True)]


def content_homes(shown: list[Node], content: list[bool], above: list[int]) -> set[int]:
    """The containers of content paths that aren't mostly links, and those inside them or between them."""
    size: dict[int, list[int]] = {}
    found: set[int] = set()
    for (_, text, link, _, _, home, _), is_content in zip(shown, content, strict=True):
        n = len(text.strip())
        s = size.setdefault(home, [0, 0])
        s[0] += n
        s[1] += n if link else 0
        if n and not link and is_content:
            found.add(home)
    plain = {c for c, s in size.items() if s[1] <= MOSTLY * s[0]}
    found &= plain
    at = [k for k, x in enumerate(shown) if x[5] in found and x[1].strip()]
    if not at:
        return set()
    between = {x[5] for x in shown[at[0] : at[-1] + 1]}
    # A container's number is larger than that of the one above it; the outermost stands for the page.
    under: list[bool] = []
    for p in above:
        under.append(p >= 0 and (under[p] or (p in found and above[p] >= 0)))
    inside = {x[5] for x in shown if under[x[5]]}
    return found | (plain & (between | inside))


def menus(shown: list[Node]) -> set[int]:
    """The lists of nothing but short links that no text before them leads to: that text ends a sentence, or there is none."""
    other = {x[6] for x in shown if not x[2] and _PART_OF_WORD.search(x[1])}
    length: dict[tuple[int, int], int] = {}
    for _, text, _, _, block, _, of in shown:
        length[of, block] = length.get((of, block), 0) + len(text.split())
    other |= {of for (of, _), n in length.items() if n > MENU_WORDS}
    found: set[int] = set()
    seen: set[int] = set()
    before = ""
    for _, text, _, _, _, _, of in shown:
        if not (text := text.strip()):
            continue
        if of and of not in seen:
            seen.add(of)
            if of not in other and (not before or _ENDS.search(before)):
                found.add(of)
        if of not in found:
            before = text
    return found


def main_text(page: str) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    tree = page_tree(page)
    nodes = _linked_whole(tree)
    article, main = _told([x for x in nodes if not x[3]], tree.paths)
    told = article or main
    within = [not told or (article and tree.paths[x[0]][2]) or (main and tree.paths[x[0]][3]) for x in nodes]
    keys = [(x[0], (AGAINST if x[3] else 1.0) * (1.0 if here else OUTSIDE)) for x, here in zip(nodes, within, strict=True)]
    chosen = content_paths(nodes, keys)
    content = [key in chosen for key in keys]
    if not any(c and not x[2] and x[1].strip() for c, x in zip(content, nodes, strict=True)):
        return ""
    # What markup speaks against is there only by its own path's ratio; the rest may come with its container.
    at = [k for k, x in enumerate(nodes) if content[k] or (within[k] and not x[3])]
    shown = [nodes[k] for k in at]
    if not (told and any(content[k] and within[k] for k in at)):
        homes = content_homes(shown, [content[k] for k in at], tree.above)
        shown = [x for x in shown if x[5] in homes]
    out = menus(shown)
    blocks: list[tuple[int, list[str]]] = []
    for _, text, _, _, block, _, of in shown:
        if of in out:
            continue
        if not blocks or blocks[-1][0] != block:
            blocks.append((block, []))
        blocks[-1][1].append(text)
    return " ".join(x for x in (_BLANK.sub(" ", "".join(b)).strip() for _, b in blocks) if x)


def extract(pages: DataFrame, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns of ``keep`` and ``main_text`` of each page."""
    importable(pages.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([main_text(x) if x else "" for x in b.to_pylist()], pa.string())

    return pages.select(key, *keep, run.asNondeterministic()(F.col(html).cast("string")).alias("main_text"))
