"""Main text of web pages by composite text density.

Every DOM node gets a density: characters per tag, lowered by the share of its characters and tags that are
links. The node whose children's densities have the largest sum holds the article. The smallest density on
the way from it up to the body is the threshold that other parts along that way must reach to belong to it.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""", re.S)
_UNCLOSED = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Starting one of these ends an open p.
_ENDS_P = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "legend", "figcaption", "summary"}
#: Starting the key ends an open element of the set, unless one of the others stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no new element closes from inside, and inline ones whose stray end tags stop at a larger part.
_BARRIERS = BLOCK - {"tr", "td", "th", "tbody", "thead"}
_WITHIN = frozenset("p b i em strong span a li".split())
#: Elements that are parts of a text, not places for one: none of them is taken for the article.
_LEAVES = HEADINGS | frozenset("p pre hr dt figcaption caption legend summary address".split()) | frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = frozenset("head script style noscript template svg math canvas iframe object audio video nav menu footer aside dialog button select input textarea label legend fieldset title xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of class names and ids that say that an element is no part of the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar comment comments disqus respond replies reply"
    " cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related"
    " recommended breadcrumb breadcrumbs menu nav navbar navigation footer header masthead topbar toolbar pagination pager widget skip search".split()
)
#: Those of them that are noise wherever they stand, inside an article, too.
_ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments disqus respond replies cookie cookies consent gdpr newsletter subscribe subscription signup".split()
)
#: What stands beside such a word in a name and tells nothing of the content.
_BESIDE = frozenset(
    "area bar block body bottom box btn button buttons center col column container content desktop fixed float form global group holder icons inline inner item items large left line link links list lists"
    " main mobile module mpu outer page panel placeholder post primary reader readers right row secondary section site slot small sticky text thread title top unit user users wrap wrapper zone".split()
)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
CONTENT, NOISE, MAYBE = 0, 1, 2


def _by_name(tag: str, values: dict[str, str], inside_article: bool) -> int:
    """What class names and ids say of an element.

    Ids of headings, paragraphs and other parts of a text come from what they say, and are not asked. A name is noise if each of its
    words is, or tells nothing; inside an article only if one of them always is. Other names with such a word
    at the beginning or end leave it to the element's content."""
    found = CONTENT
    names = values.get("class", "").split() + ([] if tag in _LEAVES else values.get("id", "").split())
    for name in names:
        words = [x for x in _NAME_PARTS.split(name) if x and not x.isdigit()]
        if not words or words[0] in ("has", "with", "no", "is") or not {words[0], words[-1]} & _NAMES:
            continue
        whole = all(x in _NAMES or x in _BESIDE or x[:1].isdigit() for x in words)
        if inside_article and "header" in (words[0], words[-1]):
            continue  # an article's own heading
        if whole and not (inside_article and (tag in _LEAVES or not _ALWAYS.intersection(words))):
            return NOISE
        if tag not in _LEAVES:
            found = MAYBE
    return found


def _is_noise(tag: str, attributes: str, inside_article: bool) -> int:
    """NOISE for what is never content; MAYBE for what is not if it is mostly links, or a form."""
    if tag in _DROPPED or tag == "header" and not inside_article:
        return NOISE
    if "=" not in attributes and "hidden" not in attributes or tag in ("html", "body", "main", "article"):
        return CONTENT
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:[\s/>]|$)", attributes) or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return NOISE
    if values.get("role") in _ROLES:
        return NOISE
    return _by_name(tag, values, inside_article)


class _Open:
    """The open elements, the innermost last, and for every name the places of those that are open.

    So an end tag finds its element without a walk, and a page takes time in proportion to its length."""

    def __init__(self):
        self.nodes, self.tags, self.places = [0], ["#root"], {}

    def push(self, node: int, tag: str) -> None:
        for name in (tag, "#barrier") if tag in _BARRIERS else (tag,):
            self.places.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, to: int) -> None:
        """Leaves the `to` outermost elements."""
        while len(self.nodes) > to:
            self.nodes.pop()
            tag = self.tags.pop()
            for name in (tag, "#barrier") if tag in _BARRIERS else (tag,):
                self.places[name].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of these names; 0 (the root's) if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


class _Tree:
    """Nodes in page order; parts: (node, text), the text runs in page order, with None where a block starts or ends."""

    def __init__(self, page: str):
        self.tag, self.parent, self.noise = ["#root"], [-1], [CONTENT]
        self.parts: list[tuple[int, str | None]] = []
        stack, at, last = _Open(), 0, page.rfind(">")
        in_article = [False]  # whether a node is inside an article or main element, or is one
        while at < len(page):
            # after the last ">" no tag ends: each "<" there would be looked at up to the page's end
            if not (m := _TOKEN.search(page, at, last + 1)):
                rest = _UNCLOSED.search(page, max(at, last + 1))
                self.parts.append((stack.nodes[-1], page[at : rest.start() if rest else len(page)]))
                break
            if m.start() > at:
                self.parts.append((stack.nodes[-1], page[at : m.start()]))
            at = m.end()
            if not m[2]:
                if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
                    break  # a comment without an end
                continue
            tag = m[2].lower()
            if tag in BLOCK:
                self.parts.append((stack.nodes[-1], None))
            elif tag == "br":
                self.parts.append((stack.nodes[-1], " "))
            if m[1]:
                place = stack.last((tag,))
                # an end tag without its start does not close what is around
                if place and not (tag in _WITHIN and stack.last(("article", "main", "body", "table")) > place):
                    stack.cut(place)
                continue
            if tag in _ENDS_P:
                self._close(stack, {"p"}, {"table", "td", "th", "button", "object"})
            if tag in _ENDS:
                self._close(stack, *_ENDS[tag])
            if tag == "body" and stack.last(("body",)) or tag == "html" and len(stack.nodes) > 1:
                continue
            if tag == "body":
                stack.cut(1 + (len(stack.nodes) > 1 and stack.tags[1] == "html"))
            node, up = len(self.tag), stack.nodes[-1]
            self.tag.append(tag)
            self.parent.append(up)
            self.noise.append(_is_noise(tag, m[3], in_article[up]))
            in_article.append(in_article[up] or tag in ("article", "main"))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif tag not in VOID and not m[3].endswith("/>") or tag in BLOCK and tag != "hr":
                stack.push(node, tag)

    @staticmethod
    def _close(stack: _Open, tags: set[str], until: set[str]) -> None:
        place = stack.last(tags)
        if place and place >= max(stack.last(until), stack.last(("#barrier",))):
            stack.cut(place)


def _dead(tree: _Tree) -> list[bool]:
    """Whether a node is noise or within some. An element whose name leaves it open is if half of its text or more is links, or it has a form."""
    n = len(tree.tag)
    chars, linked, forms, in_link = [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
        forms[i] = tree.tag[i] in ("form", "input", "select", "textarea")
    for node, text in tree.parts:
        if text:
            length = len(text.strip())
            chars[node] += length
            linked[node] += length * in_link[node]
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        forms[p] += forms[i]
    dead = [False] * n
    for i in range(1, n):
        dead[i] = dead[tree.parent[i]] or tree.noise[i] == NOISE or tree.noise[i] == MAYBE and (forms[i] > 0 or linked[i] * 2 >= chars[i])
    return dead


def _densities(tree: _Tree, dead: list[bool]):
    """Density of every node, and the sum of its children's; dead nodes have none."""
    n = len(tree.tag)
    chars, linked, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for node, text in tree.parts:
        if text and not dead[node]:
            length = len(text.strip())
            chars[node] += length
            linked[node] += length * in_link[node]
    for i in range(n - 1, 0, -1):
        if not dead[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    share = linked[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if dead[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), linked[i], max(link_tags[i], 1)
        lc = max(lc, 1)
        base = log(c * lc / max(c - lc, 1) + share * c + e)  # over 1, as e alone gives 1
        density[i] = max(c / t * log(c * t / (lc * lt), base), 0.0)
        if i:
            sums[tree.parent[i]] += density[i]
    return density, sums, chars, linked, body


def main_text(page: str | None) -> str:
    """The article of a page, a block a line; empty if there is none.

    Null, empty and text-free pages give an empty text. Markup that is not closed or closed twice is read as
    browsers do, roughly: a new block ends an open paragraph. Whole pages are read, whatever their length.
    """
    if not page:
        return ""
    tree = _Tree(page)
    n = len(tree.tag)
    if not any(text and not text.isspace() for _, text in tree.parts):
        return ""
    dead = _dead(tree)
    # a form is noise unless it wraps the page
    total = sum(len(x or "") for _, x in tree.parts)
    within = [0] * n
    for node, text in tree.parts:
        within[node] += len(text or "")
    for i in range(n - 1, 0, -1):
        within[tree.parent[i]] += within[i]
    for i in range(1, n):
        dead[i] = dead[i] or dead[tree.parent[i]] or tree.tag[i] == "form" and within[i] * 2 < total
    density, sums, chars, linked, body = _densities(tree, dead)
    best = max((i for i in range(n) if tree.tag[i] not in _LEAVES), key=lambda i: (sums[i], -i))
    if not sums[best]:
        best = body
    way = [best]
    while way[-1] not in (body, 0):
        way.append(tree.parent[way[-1]])
    threshold = min(density[i] for i in way)
    # the subtree of the largest sum, and what along the way up from it is as dense: its headings and parts of the article around it
    taken, on_way = {best}, set(way)
    for i in range(1, n):
        up = tree.parent[i]
        if i in on_way or dead[i] or up not in on_way or up == best or density[i] <= 0 or linked[i] * 2 > chars[i]:
            continue
        if tree.tag[i] in HEADINGS and up != body or tree.tag[i] in BLOCK and density[i] >= threshold:
            taken.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = not dead[i] and (i in taken or i > 0 and inside[tree.parent[i]])

    # blocks: text runs between two block boundaries
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        if text := " ".join(unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    for node, text in tree.parts:
        if text is None:
            flush()
        elif inside[node]:
            run.append(text)
    flush()
    return "\n".join(blocks)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in pages], dtype=object)


def extract_main_text(html: Column) -> Column:
    """main_text of a column, row by row; repeated rows are read alike and other columns are not touched."""
    return _main_text(html)
