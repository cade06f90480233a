"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas on to their ancestors, less
with every level; a container's sum is discounted by its link density. The best
container and siblings that resemble it are kept, without the boilerplate
inside them.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_NAMES = re.compile(r"""\b(class|id|role|aria-hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b(?!\s*=)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no markup and none of the article
RAW = frozenset("script style template iframe textarea title select option".split())
#: elements that are never part of the article
CHROME = frozenset("nav footer aside form button dialog menu fieldset label head".split())
#: elements that leave an open head open; all others, and text, end it
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp br".split()
)
PARAGRAPHS = frozenset("p pre xmp blockquote td li dd h1 h2 h3 h4 h5 h6".split())
#: elements that a name in class, id or role can mark as unwanted; the names of headings, paragraphs and inline elements say nothing of the kind
CONTAINERS = frozenset("div section ul ol dl table tbody tr details figure header center iframe".split())
CLOSES_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"table", "ul", "ol", "dl"}
#: an opening tag ends the outermost open element of a kind, up to an element that bounds its scope: tags, kinds, bounds
SCOPES = (
    (CLOSES_P, frozenset({"p"}), frozenset("td th table div article section li button".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset("ul ol menu".split())),
    (frozenset({"dd", "dt"}), frozenset({"dd", "dt"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"tbody"}), frozenset({"tr", "td", "th", "thead", "tbody"}), frozenset({"table"})),
)
_TOUCHED = {tag: tuple(g for g, (_, kinds, bounds) in enumerate(SCOPES) if tag in kinds or tag in bounds) for tag in frozenset().union(*(k | b for _, k, b in SCOPES))}
_CLOSED_BY = {tag: tuple(g for g, (tags, _, _) in enumerate(SCOPES) if tag in tags) for tag in frozenset().union(*(t for t, _, _ in SCOPES))}
#: words in names (class, id, role) of what is not the article; in a name with words of other kinds they say little (``related-work``)
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar side rail menu nav navigation navbar breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended widget pagination pager login search hidden complementary contentinfo dialog alert".split()
)
#: those that no article's own parts are named by
STRONG = frozenset("ads advert adverts advertisement advertising sponsored promo disqus gdpr newsletter signup sidebar navbar breadcrumb breadcrumbs masthead topbar toolbar pagination pager".split())
#: words that may stand beside unwanted ones in a name without making it another thing's
NEUTRAL = frozenset(
    "article area bar bars block blocks body bottom box boxes btn button buttons card cards center col column container content desktop entry feed footer form global grid group head header holder icon icons inline inner item items js left link links list main mobile more new outer page pane panel part post posts primary reader readers right row secondary section site slot small stories story text the thread title top unit user users visitor wide wrap wrapper you".split()
)
#: beginnings of names that say what a page has, not what the element is
ABOUT = frozenset("has with without no".split())
WANTED = frozenset("article content main post entry story body text".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "kids", "wanted", "skip", "score", "chars", "linked", "order", "doubt", "hint", "held")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.kids = tag, parent, []
        self.score, self.order = 0.0, -1
        self.chars = self.linked = 0
        self.wanted, self.doubt, self.hint = 0, False, False
        #: whether an article or main holds it: a header in there is the article's own
        self.held = parent is not None and (parent.held or parent.tag in ("article", "main"))
        self.skip = tag in CHROME or tag == "header" and not self.held
        if attributes:
            for kind, a, b, c, bare in _NAMES.findall(attributes):
                value = a or b or c
                kind = kind.lower()
                if bare or kind == "aria-hidden" and value == "true" or kind == "style" and "display:none" in value.replace(" ", "").lower():
                    self.skip = True
                elif kind in ("class", "id", "role"):
                    names = [[x.lower() for x in _PARTS.findall(token)] for token in value.split()]
                    if tag in CONTAINERS:
                        for parts in names:
                            if parts and parts[0] not in ABOUT and not UNWANTED.isdisjoint(parts):
                                self.hint = True
                                self.doubt |= not STRONG.isdisjoint(parts) or all(x in UNWANTED or x in NEUTRAL or x.isdigit() for x in parts)
                    self.wanted += any(not WANTED.isdisjoint(parts) for parts in names)


class Builder:
    """The open elements, with what is needed to close them without walking up the tree: for each tag the places where it is open, places of blocks, and for each scope the outermost element it could end."""

    def __init__(self):
        self.stack = [Node("html", None)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]
        self.scopes: list[list[int | None]] = [[None] for _ in SCOPES]

    def open(self, name: str, attributes: str) -> None:
        node = Node(name, self.stack[-1], attributes)
        self.stack[-1].kids.append(node)
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(name, []).append(at)
        if name in BLOCKS:
            self.blocks.append(at)
        for g in _TOUCHED.get(name, ()):
            held = self.scopes[g]
            held.append(None if name in SCOPES[g][2] else at if held[-1] is None else held[-1])

    def cut(self, at: int) -> None:
        """Close the element at place ``at`` and all in it."""
        while len(self.stack) > max(at, 1):
            name = self.stack.pop().tag
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            for g in _TOUCHED.get(name, ()):
                self.scopes[g].pop()

    def close(self, name: str) -> None:
        places = self.places.get(name)
        if places and (name in BLOCKS or places[-1] > self.blocks[-1]):  # an inline end tag doesn't close blocks
            self.cut(places[-1])

    def end_before(self, name: str) -> None:
        for g in _CLOSED_BY.get(name, ()):
            if self.scopes[g][-1] is not None:
                self.cut(self.scopes[g][-1])


def parse(page: str) -> Node:
    """An element tree; strings are text with references decoded. Unclosed and stray tags are mended as browsers do. The time is linear in the page."""
    build = Builder()
    stack, at, n = build.stack, 0, len(page)
    ends: dict[str, int] = {}  # where a raw element's end tag is searched no more, since there is none

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                build.cut(len(stack) - 1)
            stack[-1].kids.append(entities.unescape(raw) if "&" in raw else raw)

    last = page.rfind(">")
    while at < n:
        here = page.find("<", at)
        if here < 0 or here > last and not page.startswith("<!--", here):  # nothing after the last > is markup
            text(page[at:])
            break
        m = _TAG.match(page, here) if page[here + 1 : here + 2] not in ("!", "?") else None
        if m is None:
            end = here + 1
            if page.startswith("<!--", here):
                end = page.find("-->", here + 4) + 3
                end = n if end < 3 else end
            elif page.startswith("<![CDATA[", here) and "]]>" not in ends and (close := page.find("]]>", here)) >= 0:
                text(page[at:here])
                text(page[here + 9 : close])
                at = close + 3
                continue
            elif page[end : end + 1] in ("!", "?"):
                ends.setdefault("]]>" if page.startswith("<![CDATA[", here) else "", n)
                end = page.find(">", here) + 1
            text(page[at:here] if end > here + 1 else page[at:end])
            at = end
            continue
        text(page[at:here])
        at = m.end()
        name = m.group(2) or m.group(5)
        name, attributes = name.lower(), m.group(3) or m.group(6) or ""
        if m.group(1) or m.group(4):
            build.close(name)
            continue
        if stack[-1].tag == "head" and name not in HEAD:
            build.cut(len(stack) - 1)
        if name in ("html", "body"):
            if name == "body" and attributes:
                build.open(name, attributes)
            continue
        if name == "xmp":  # shown as it stands
            close = re.compile(r"</xmp\s*>", re.I).search(page, at) if name not in ends else None
            if close is None:
                ends[name] = n
            build.end_before(name)
            build.open(name, attributes)
            stack[-1].kids.append(page[at : close.start() if close else n])
            build.cut(len(stack) - 1)
            at = close.end() if close else n
            continue
        if name in RAW:
            close = None
            if not attributes.endswith("/") and name not in ends:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if close is None:
                    ends[name] = n
            at = close.end() if close else (n if name in ("script", "style") else at)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            if name in BLOCKS:
                stack[-1].kids.append(" ")
            continue
        build.end_before(name)
        build.open(name, attributes)
    return stack[0]


def _walk(root: Node) -> list[Node]:
    """All elements in page order, without those inside skipped ones (no recursion: depth is not bounded)."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.skip:
            out.append(node)
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _cut_unwanted(root: Node) -> None:
    """Skip what an unwanted name marks, unless it also has wanted names or three quarters of the text: that only scores less."""
    nodes, size = _walk(root), {}
    for node in reversed(nodes):
        size[node] = sum(len(k) if isinstance(k, str) else size.get(k, 0) for k in node.kids)
    for node in nodes:
        if node.doubt and not node.wanted and 4 * size[node] < 3 * size[root]:
            node.skip = True


def _text(root: Node) -> str:
    out, todo = [], [root]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.skip:
            if k.tag in BLOCKS:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The main text; blocks and runs of white space give one space. Empty if the page has none."""
    root = parse(page or "")
    _cut_unwanted(root)
    nodes = _walk(root)
    for k, node in enumerate(nodes):
        node.order = k
    for node in reversed(nodes):  # children come after their parents
        own = sum(len(k) for k in node.kids if isinstance(k, str))
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    seen = []
    for node in reversed(nodes):  # an ancestor gets half of what the element below it got from its paragraphs
        direct = [k for k in node.kids if isinstance(k, str)]
        if node.tag in PARAGRAPHS or any(not s.isspace() for s in direct):
            long = node.chars if node.tag in PARAGRAPHS else sum(map(len, direct))
            commas = sum(s.count(",") + s.count("،") + s.count("、") + s.count("，") for s in direct)
            density = node.linked / node.chars if node.chars else 0.0
            points = (1 + commas + min(long / 100, 3.0)) * (1 - density)
            up = node.parent if node.tag in PARAGRAPHS or node.tag not in BLOCKS else node
            if up is not None:
                up.score += points
        if node.parent is not None:
            node.parent.score += node.score / 2
    for node in nodes:
        node.score = (node.score + 3 * node.wanted + 8 * (node.tag in ("article", "main"))) * (1 - (node.linked / node.chars if node.chars else 0.0)) / (1 + (node.doubt + node.hint) / 2)
        if node.chars and node.tag not in PARAGRAPHS and node.tag in BLOCKS:
            seen.append(node)
    best = max(seen or [root], key=lambda x: (x.score, -x.order) if x is not root else (x.score, -1))
    if best.parent is None or best is root:
        return _text(root)
    for node in nodes:  # beside or inside the best container, what names mark is none of the article if it has less than half its text; a mere hint counts for what is mostly links
        if node is not best and (node.doubt and 2 * node.chars < best.chars or node.hint and 2 * node.linked > node.chars):
            node.skip = True
    keep = []
    for k in best.parent.kids:
        if k is best:
            keep.append(k)
        elif isinstance(k, Node) and not k.skip and k.order >= 0:
            density = k.linked / k.chars if k.chars else 1.0
            alike = k.tag == best.tag and k.score >= 0.2 * best.score and density < 0.25 and k.tag in ("article", "div", "section", "main", "p")
            prose = k.tag in ("p", "pre", "blockquote") and (k.chars > 80 and density < 0.25 or k.chars and not k.linked)
            if alike or prose or k.tag in ("h1", "h2") and density == 0:
                keep.append(k)
    return " ".join(x for x in map(_text, keep) if x)


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` (code points) of every page.

    Whole pages are read and nothing of the article is capped. Null and empty
    pages give an empty text; a page without elements gives its text; repeated
    rows are returned as often as they occur; other columns are not read; of
    containers that tie, the first in the page is the best. Very long and very
    deep pages take time in proportion to their length; an empty table gives an
    empty result.
    """
    kinds = dict(df.dtypes)

    def rows(_, ids, urls, pages):
        for i, u, p in zip(ids, urls, pages, strict=True):
            t = main_text(p)
            yield i, u, t, len(t)

    return map_rows(df, [id_col, url_col, html_col], f"{id_col} {kinds[id_col]}, {url_col} string, text string, n_chars bigint", rows)
