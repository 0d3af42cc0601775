"""HTML extraction: tree scoring of paragraphs, the best container is kept."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

# Element and role names of HTML, and usual words in class and id.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption caption summary address".split())
CONTAINERS = frozenset("html body div article main section header footer nav aside form ul ol dl table thead tbody tfoot tr figure fieldset details center hgroup dialog search menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BREAKS = frozenset("hr".split())
RAW = frozenset("script style textarea title template iframe xmp noembed noframes noscript svg select button object canvas".split())
DROPPED = frozenset("nav footer aside dialog menu search head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Roles of notices, which in an article are part of it.
NOTES = frozenset("note status".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promoted promotion banner sidebar sidebars side rail "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments commentlist discussion disqus replies reply respond widget widgets form skip hidden outbrain taboola paywall".split()
)
#: What such words are joined with in one name; with any other word the name says
#: something else, as in "side-effects" or "related-work".
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content entry feed first group head heading icon icons inner item items label last layout left link links list "
    "main middle module open outer page panel placeholder post posts article articles primary region right row secondary section site slot small sticky story stories sub tab tabs text title top unit wrap wrapper zone on".split()
)
DROPPED_WHOLE = frozenset("comment comments commentlist reply replies ad ads advert advertisement sponsored promo related".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("chars", "doubt", "gone", "holds_main", "in_article", "links", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.score, self.chars, self.links = tag, parent, 0.0, 0, 0
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.gone = False
        # What class and id say, and whether there is an h1 or main inside.
        self.doubt, self.holds_main = 0, False


#: What an element's name and attributes say of its subtree.
KEPT, DOUBTED, DOUBTED_WHOLE, GONE = range(4)


def _verdict(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in DROPPED or tag == "header" and not inside_article:
        return GONE
    if tag in ("html", "body", "main"):
        return KEPT
    plain = DOUBTED if tag == "form" else KEPT  # a form may hold the page
    if not attributes:
        return plain
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    if role in NOTES and not inside_article:
        return DOUBTED
    if role in DROPPED_ROLES or found.get("aria-hidden", "").lower() == "true":
        return GONE
    if "hidden" in found or re.search(r"(^|\s)hidden(\s|/|$)", attributes) or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return GONE
    words: set[str] = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if parts <= DROPPED_WORDS | NEUTRAL:
            words |= parts & DROPPED_WORDS
    if not words.isdisjoint(DROPPED_WHOLE):
        return DOUBTED_WHOLE
    return plain if tag == "article" or not words else DOUBTED


def blocks(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """The page's text blocks outside subtrees dropped by element, role or as
    hidden, in page order: the element, its text and how many of the text's
    characters are in links. And all elements, each behind its parent."""
    root = Node("html", None)
    stack, out, nodes = [root], [], [root]
    # How many elements of a name are open, in all and since each article or body,
    # so that an end tag without a beginning looks at no element.
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]
    text: list[str] = []
    linked, links, skipping = 0, 0, 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((stack[-1], joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def push(tag: str) -> Node:
        stack.append(Node(tag, stack[-1]))
        nodes.append(stack[-1])
        opened[tag] += 1
        if tag in ("article", "body"):
            scopes.append(Counter())
        scopes[-1][tag] += 1
        return stack[-1]

    def pop() -> None:
        tag = stack.pop().tag
        opened[tag] -= 1
        if tag in ("article", "body"):
            scopes.pop()
        else:
            scopes[-1][tag] -= 1

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        text.append(piece)
        if links:
            linked += len(piece.strip())

    while at < size:
        m = TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at and not skipping:
            add(page[at:start])
        if not m:
            break
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if m[1]:
            if tag in RAW and not (tag == "button" and stack[-1].tag in PARAGRAPHS):
                if not m[2].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else size
                if not skipping and tag not in ("script", "style", "template"):
                    text.append(" ")
            elif tag == "br":
                text.append(" ")
            elif tag == "a":
                links = 1
            elif tag in BREAKS:
                flush()
            elif tag in PARAGRAPHS or tag in CONTAINERS or tag == "head":
                if not skipping:
                    flush()
                if tag == "body" and opened["head"]:
                    while len(stack) > 1:
                        pop()
                    skipping = 0
                links = 0
                # A paragraph ends where a block begins; a like item ends the one before it.
                while len(stack) > 1 and (stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1].tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt")):
                    if skipping and len(stack) == skipping:
                        break
                    pop()
                if m[2].endswith("/") and tag not in PARAGRAPHS:
                    continue
                push(tag)
                if not skipping:
                    stack[-1].doubt = _verdict(tag, m[2], stack[-1].in_article)
                    if stack[-1].doubt == GONE:
                        skipping = len(stack)
                    elif tag in ("h1", "main"):
                        stack[-1].holds_main = True
        elif m[3]:
            if tag == "a":
                links = 0
            elif tag in PARAGRAPHS or tag in CONTAINERS or tag == "head":
                if not skipping:
                    flush()
                if (opened if tag in ("body", "html") else scopes[-1])[tag]:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
                    if len(stack) < skipping:
                        skipping = 0
    if not skipping:
        flush()
    for x in reversed(nodes[1:]):
        x.parent.holds_main |= x.holds_main
    return out, nodes


def _chain(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _count(found: list[tuple[Node, str, int]], nodes: list[Node]) -> None:
    """Characters, and those in links, of all that is inside each element."""
    for x in nodes:
        x.chars = x.links = 0
    for node, text, linked in found:
        node.chars += len(text)
        node.links += linked
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.links += x.links


def _undoubted(found: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks outside the subtrees that class or id name as something else
    than main text, or all, where nothing else is. Such a subtree stays that
    isn't mostly links and holds half of the page's prose or more; with a word of
    comments or adverts it also has to hold an h1 or main element."""
    _count(found, nodes)
    prose = nodes[0].chars - nodes[0].links
    for x in nodes:
        plain = x.chars - x.links
        small = plain <= x.links or 2 * plain < prose or x.doubt == DOUBTED_WHOLE and not x.holds_main
        x.gone = x.parent is not None and x.parent.gone or bool(x.doubt) and small
    return [f for f in found if not f[0].gone] or found


#: A paragraph gives points to so many elements around it.
LEVELS = 64


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, joined by two line feeds.

    Subtrees that HTML or their role name as menus, headers, footers, sidebars or
    dialogs are left out, and forms, notices outside an article and what class or id
    name so unless they hold most of the page (see _undoubted). Every other
    paragraph gives points, one for itself, one for each comma and up to three
    for its length, to the element around it, half of them to the next and a
    third, a quarter and so on to LEVELS above; each element's points are
    discounted by the share of its characters in links. The best element, or the
    article or main element around it, is kept, with siblings that have a fifth
    of its points and, of those with few links, headings, long prose and what stands
    between kept blocks. Lists of links alone go, but those under a heading of the
    best element. No block is cut. Null and empty pages give an empty text, broken markup ends where its
    parent ends. Work grows with the page's length, however deep it is.
    """
    found, nodes = blocks(page or "")
    found = _undoubted(found, nodes)
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for node, text, _ in found:
        first = node.parent if node.tag in PARAGRAPHS and node.parent else node
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        for depth, x in enumerate(islice(_chain(first), LEVELS)):
            x.score += points / (depth + 1)
            scored[id(x)] = x
    _count(found, nodes)
    density = lambda x: x.links / x.chars if x.chars else 0.0
    value = lambda x: x.score * (1 - density(x))
    best = max(scored.values(), key=value)
    # The outermost article, else main, that the best element is in.
    top = next((x for x in reversed(list(_chain(best))) if x.tag == "article"), None) or next((x for x in _chain(best) if x.tag == "main"), best)
    least = value(top) / 5
    # For each element: the nearest list around it, and the top element or the
    # sibling of it that it is in.
    lists: dict[int, Node | None] = {}
    within: dict[int, Node | None] = {}
    for x in nodes:
        around = x.parent
        lists[id(x)] = x if x.tag in ("ul", "ol") else lists[id(around)] if around is not None else None
        own = x is top or around is not None and around is top.parent
        within[id(x)] = x if own else within[id(around)] if around is not None else None

    # Lists of links alone that a heading of the best element introduces.
    named: set[int] = set()
    for (before, _, _), (node, _, _) in zip(found, found[1:]):
        menu = lists[id(node)]
        if menu is not None and before.tag in HEADINGS and within[id(before)] is top and lists[id(before)] is not menu:
            named.add(id(menu))

    def kept(node: Node, text: str) -> bool:
        menu, x = lists[id(node)], within[id(node)]
        if menu is not None and menu.chars and density(menu) > 0.9 and menu is not top and id(menu) not in named:
            return False
        if x is None or x is top:
            return x is top
        return value(x) >= least > 0 or x.tag in HEADINGS or density(x) < 0.25 and (len(text) > 80 or node.tag in HEADINGS)

    stay = [kept(node, text) for node, text, _ in found]
    first, last = (stay.index(True), len(stay) - 1 - stay[::-1].index(True)) if True in stay else (0, -1)
    for n in range(first + 1, last):  # short siblings between what is kept
        x = within[id(found[n][0])]
        stay[n] |= x is not None and x is not top and density(x) < 0.25
    return "\n\n".join(text for (_, text, _), yes in zip(found, stay, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages, each page on its own
    and from its whole html. Columns besides page_id, url and html are ignored,
    repeated rows are repeated, an empty table gives no rows."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = [main_text(x.as_py()) for x in some["html"]]
                yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
