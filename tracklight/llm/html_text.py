"""Main text of web pages by tree scoring.

A page is read into a tree with the end tags that HTML lets authors leave out. Paragraphs pass points
for their length and commas to their ancestors; an ancestor's score is discounted by its link density.
The best container and those of its siblings that look like it are kept, without the parts inside
that are marked as menus, notices, adverts, forms or comments.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tracklight.llm.common import long, map_columns, string

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas".split())
#: Raw elements whose content, if they aren't ended, is code up to the page's end.
CODE = frozenset("script style".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "body": ("head",),
}
#: Elements that bound the search for an open element to end.
SCOPES = frozenset("table ul ol dl article section main html body div td th nav aside header footer form".split())
#: Elements of a table, which end what is open in a cell; other end tags end nothing outside their cell.
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav aside footer form button dialog menu head".split())
#: Parts of class, id and role names that mark what isn't main text, as whole words of the name.
MARKED = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|foot|footer|gdpr|"
    r"header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo\w*|related|"
    r"repl(?:y|ies)|respond|share|sharing|shares|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget|"
    r"alert|complementary|contentinfo|search|login|overlay)(?:$|[_-])",
    re.I,
)
#: Names that mark main text. Of the marks above they outdo the header's alone: an entry's header holds its title.
MAIN = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|hentry)(?:$|[\s_-])", re.I)
TITLED = re.compile(r"(?:article|content|entry|post|story)[_-]?header", re.I)
#: Names that say what a container has or lacks, and not what it is.
ABOUT = re.compile(r"(?:has|with|no|without|hide|show|is|sticky|fixed)[_-]", re.I)
#: The end of a tag that ends itself; a slash that ends an unquoted value is part of the value.
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
#: A tag, whose quotes count after an equals sign only, as in HTML; and one of a page whose quotes don't close.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I | re.A) for name in RAW}
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
CLASSES = re.compile(r"""(?:^|\s)(?:class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A quick test for attributes that may hide an element; hides() decides.
HIDDEN = re.compile(r"hidden|display", re.I)
INVISIBLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Elements that marks can drop; headings, paragraphs and inline elements are content whatever their names.
PARTS = frozenset("address blockquote center dd details dir div dl dt fieldset figcaption figure header hgroup li ol section summary table tbody td tfoot th thead tr ul".split())
#: A part that is marked by its id alone is kept from this many characters on, if few are in links and it is a headed part or section of an article.
TEXT_CHARS, TEXT_LINKED = 80, 0.25

#: Characters of a paragraph for which it earns a point, and the most points for length.
CHARS_A_POINT, MOST_POINTS = 100, 3
#: Share of a container's characters in links from which a block of it counts as a menu.
LINKED = 0.5
#: Mean characters of a link from which a list of links in an article counts as references, and characters of loose text that stays.
REFERENCE_CHARS, LOOSE_CHARS = 20, 20


def hides(attributes: str) -> bool:
    """Whether an element is hidden by its attributes: by their names and values, not by words in other values."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and INVISIBLE.search(value)):
            return True
    return False


def marked(names: str) -> bool:
    """Whether any one of the names marks what isn't main text."""
    for name in names.split():
        if MARKED.search(CAMEL.sub("-", name)) and not ABOUT.match(name) and not TITLED.search(name):
            return True
    return False


class Node:
    __slots__ = ("block", "children", "commas", "doubtful", "dropped", "link", "name", "names", "own", "parent", "score", "size")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent = name, parent
        self.children: list[Node | str] = []
        self.names = " ".join(x.strip("\"'") for x in NAMES.findall(attributes)) if "=" in attributes else ""
        self.score = 0.0
        self.size = self.link = 0  # characters of text, and of text in links
        self.own = self.commas = 0  # characters and commas of a block outside the blocks in it
        self.block: Node = self
        mark = name in PARTS and marked(self.names)
        #: Marked by an id alone, as slugs of headings are: its text decides.
        self.doubtful = mark and not marked(" ".join(x.strip("\"'") for x in CLASSES.findall(attributes)))
        self.dropped = (
            name in DROPPED
            or bool(attributes and HIDDEN.search(attributes) and hides(attributes))
            or (mark and not self.doubtful)
            or (name == "header" and not inside(parent))
        )


def inside(node: Node | None) -> bool:
    """Whether an article or main element holds the node."""
    while node is not None:
        if node.name in ("article", "main"):
            return True
        node = node.parent
    return False


class Reader:
    """The open elements of a page as it is read; where the nearest of a name is open is known without a search."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}

    def nearest(self, names) -> int:
        """The place of the innermost open element of these names; -1 if there is none."""
        return max((at[-1] for x in names if (at := self.places.get(x))), default=-1)

    def cut(self, place: int) -> None:
        """Ends the element at a place and all in it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().name].pop()

    def say(self, text: str) -> None:
        if text:
            self.stack[-1].children.append(html.unescape(text))

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and (p := self.nearest(("p",))) > self.nearest(SCOPES):
            self.cut(p)
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.cut(len(self.stack) - 1)
        if ends := ENDS.get(name):
            bounds = SCOPES - set(ends)
            while (place := self.nearest(ends)) > self.nearest(bounds):
                self.cut(place)
                if name not in ("tr", "tbody", "tfoot"):
                    break
        if name == "html":
            return
        node = Node(name, self.stack[-1], attributes)
        self.stack[-1].children.append(node)
        if name in VOID or (CLOSED.search(attributes) and name not in BLOCKS):
            return
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.stack[-1].children.append(Node("br", self.stack[-1]))
        if name in ("html", "body"):
            return
        place = self.nearest(HEADINGS if name in HEADINGS else (name,))
        bound = -1 if name == "table" else self.nearest(("table",) if name in TABLE else ("td", "th", "caption", "table"))
        if place <= max(0, bound):
            return
        if name not in BLOCKS and name != "a" and place < self.nearest(BLOCKS):
            return  # an inline end tag ends no block
        self.cut(place)


def parse(page: str) -> Node:
    """The tree of a page's elements and texts, character references decoded. Takes time in proportion to the page."""
    reader = Reader()
    at, end, last = 0, len(page), page.rfind(">")
    tag = TAG
    unended: set[str] = set()  # raw elements that no end tag follows
    while at < end:
        place = page.find("<", at)
        if place < 0:
            reader.say(page[at:])
            break
        reader.say(page[at:place])
        if page.startswith("<!--", place):
            at = COMMENT.match(page, place).end()
            continue
        mark = page[place + 1 : place + 3]
        if place > last or not (mark[:1].isascii() and (mark[:1].isalpha() or mark[:1] in ("!", "?", "/") and mark[:1])):
            if place > last and mark[:1].isalpha():
                break  # a tag that the page's end cuts off
            reader.say("<")
            at = place + 1
            continue
        found = tag.match(page, place)
        if found is None and mark[0] not in "!?" and mark.lstrip("/")[:1].isalpha():
            tag = LOOSE_TAG  # quotes don't close from here on: they are no longer looked at
            found = tag.match(page, place)
        if found is None:  # a declaration, or an end tag without a name
            at = page.find(">", place) + 1
            continue
        at, name = found.end(), found[2].lower()
        if found[1]:
            reader.end(name)
        elif name in RAW:
            close = None if name in unended else RAW_ENDS[name].search(page, at)
            if found[3].endswith("/") and name in ("svg", "math"):
                continue
            if close:
                at = close.end()
            else:
                unended.add(name)
                if name in CODE and not found[3].endswith("/"):
                    break
        else:
            reader.start(name, found[3])
    return reader.root


def walk(root: Node):
    """Elements that aren't dropped, with their place in the order of the page; parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node) and not x.dropped)


def prose(node: Node) -> bool:
    """Whether a part looks like article text: one with a heading, or a section, within a main part, with enough text and few links."""
    size = link = 0
    heading = False
    todo = [(node, False)]
    while todo:
        x, linked = todo.pop()
        for y in x.children:
            if isinstance(y, str):
                n = len(y.strip())
                size, link = size + n, link + n * linked
            elif not y.dropped:
                heading |= y.name in ("h1", "h2", "h3", "h4", "h5", "h6")
                todo.append((y, linked or y.name == "a"))
    above = node.parent
    while above is not None and above.name not in ("article", "main") and not MAIN.search(above.names):
        above = above.parent
    return (heading or node.name == "section") and above is not None and size >= TEXT_CHARS and link < TEXT_LINKED * size


def measure(root: Node) -> list[Node]:
    """Sizes and scores of the kept elements; gives them all, parents first."""
    for node in reversed(list(walk(root))):
        if node.doubtful and not node.dropped:
            node.dropped = not prose(node)
    nodes = list(walk(root))
    for node in nodes:
        node.block = node if node.name in BLOCKS or node.parent is None else node.parent.block
        for x in node.children:
            if isinstance(x, str) and (x := x.strip()):
                node.size += len(x)
                node.block.own += len(x)
                node.block.commas += x.count(",") + x.count("、") + x.count("，")
    for node in reversed(nodes):
        if node.name == "a":
            node.link = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link += node.link
    for node in nodes:
        if not node.own:
            continue
        points = 1 + node.commas + min(node.own / CHARS_A_POINT, MOST_POINTS)
        above, share = node.parent if node.name not in ("body", "html") else node, 1.0
        while above is not None and share > 0.1:
            above.score += points * share
            above, share = above.parent, share / 2 if share == 1.0 else share / 3
    for node in nodes:
        if node.name in ("article", "main") or (node.names and node.name not in ("body", "html") and MAIN.search(node.names)):
            node.score = node.score * 1.5 + 25
        node.score *= 1 - (node.link / node.size if node.size else 0)
    return nodes


def blocks(tops: list[Node]) -> list[str]:
    """Texts of blocks in the order of the page, white space inside turned into one space and trimmed."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        block = " ".join("".join(parts).split())
        parts.clear()
        if block:
            out.append(block)

    for top in tops:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                parts.append(x)
            elif x.name == "br":
                parts.append(" ")
            elif not x.dropped and not (x.name in ("ul", "ol", "table", "div", "section") and menu(x)):
                if x.name in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return out


def menu(node: Node) -> bool:
    """Whether a part is mostly links: at least three, over half of its characters. In an article, a list of long links is references."""
    if node.link <= LINKED * node.size:
        return False
    links = [x.size for x in walk(node) if x.name == "a"]
    if len(links) < 3:
        return False
    return not (inside(node) and sum(links) >= REFERENCE_CHARS * len(links))


def loose(run: list[Node | str]) -> Node | None:
    """A block of the text and inline elements beside the best container, if they say something that isn't links."""
    node = Node("div", None)
    node.children = run
    size = sum(len(x.strip()) if isinstance(x, str) else x.size for x in run)
    link = sum(0 if isinstance(x, str) else x.link for x in run)
    return node if size >= LOOSE_CHARS and link < LINKED * size else None


def beside(best: Node) -> list[Node]:
    """The best container and those of its siblings that look like it, are text, or are headings of what is kept."""
    least = max(10.0, best.score * 0.2)
    kept: list[Node] = []
    headings: list[Node] = []
    run: list[Node | str] = []

    def flush() -> None:
        node = loose(list(run)) if run else None
        run.clear()
        if node is not None:
            kept.extend([*headings, node])
            headings.clear()

    for x in best.parent.children:
        if isinstance(x, str) or (x.name not in BLOCKS and not x.dropped):
            run.append(x)
            continue
        flush()
        if x.dropped or not x.size:
            continue
        density = x.link / x.size
        alike = x.names and x.names == best.names
        if x.name in HEADINGS:
            if x.name == "h1":
                kept.extend([*headings, x])
                headings.clear()
            else:
                headings.append(x)
            continue
        good = x is best or (x.score + (best.score * 0.2 if alike else 0) >= least and density < LINKED)
        good = good or (x.name == "p" and density < 0.25 and x.size > 80)
        good = good or (x.name in ("ul", "ol", "dl", "table", "pre", "blockquote", "p") and bool(headings) and density < 0.25)
        if good:
            kept.extend([*headings, x])
        headings.clear()
    flush()
    return kept


def extract(page: str | None) -> str:
    """The main text; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = [x for x in measure(root) if x.name in BLOCKS and x.size]
    if not nodes:
        return "\n\n".join(blocks([root]))
    best = max(nodes, key=lambda x: x.score)  # the first of equals
    if best.parent is None or best.score <= 0:
        return "\n\n".join(blocks([best if best.score > 0 else root]))
    above = best
    while above is not None and above.name != "article":
        above = above.parent
    if above is not None and above.link < LINKED * above.size:
        best = above  # all of an article that holds the best container
    return "\n\n".join(blocks(beside(best)))


def extract_text(df: DataFrame, page: str = "html", drop_page: bool = False) -> DataFrame:
    """`df` with text (string) and n_chars (long, its code points): the main text of the whole page.

    Null and empty pages have an empty text; a page without markup is one block. Repeated rows keep
    theirs; columns of `df` named text or n_chars are replaced, others stay.
    """

    def make():
        def run(column):
            out = [extract(x) for x in column.to_pylist()]
            return [pa.array(out, pa.string()), [len(x) for x in out]]

        return run

    return map_columns(df, make, [page], [string("text"), long("n_chars")], drop=[page] if drop_page else [])
