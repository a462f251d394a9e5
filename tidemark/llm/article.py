"""Main text of HTML pages by tree scoring.

A page becomes a tree of its block elements; text between two block boundaries is a block. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are cut, by element, role, or words of class and id. Every
paragraph earns points for its length and its commas and passes them up: all of them to its container, half of them to the
next one, and so on. A container's score is its points, discounted by the share of its text that lies in links. The best container
is kept (the whole `article` where it lies in one), with those of its siblings that score near it or read like paragraphs,
and the headings before it.

Text is that of the page: character references decoded, white space inside a block (`br` included) as one space, trimmed, blocks in page order joined
by one line feed. Points only choose the container; inside it nothing is dropped but what is cut.

Defined cases: null or empty html, html without text, or with nothing but cut parts gives the empty text; unclosed, misnested and
unknown elements are read as browsers do (paragraphs end where a block starts; a closing tag without an opening one only ends a
block); depth and length of a page are not limited; a header inside an article keeps its headings; a form that holds
over half of the page's text is a wrapper and stays; equal scores go to the outer, then the first container; repeated rows give equal rows; an empty
table gives no rows; a null page_id or url stays null, and other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import map_rows

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
    tfoot th thead title tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their text is one paragraph, whose points go to the element around it.
PARAGRAPHS = frozenset("p pre dt dd figcaption caption summary address".split()) | HEADINGS
CUT = frozenset("""script style noscript template iframe object embed applet audio video canvas svg math head title nav aside footer form button
    select textarea datalist dialog menu search""".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: An opening tag closes an open one of the set, up to the given boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select", "datalist"})}
COMMAS = re.compile("[,،、，﹐]")
#: Words of class and id that name what is cut; a word after has-, with-, no- or without- only describes.
CUT_WORDS = re.compile(r"""(?:^|(?<!has)(?<!with)(?<!no)(?<!without)[^a-z])(?:ads?|adsbygoogle|advert\w*|sponsor\w*|promo|promos|promotions?|banners?|nav|navs|navbar\w*|
    navigation|menus?|menubar|breadcrumbs?|sidebars?|sidemenu|footers?|cookies?|cookiebar|consent|gdpr|notices?|popups?|modals?|overlays?|newsletters?|subscribe|
    subscription|signup|login|comments?|commentlist|commenters?|disqus\w*|respond|replies|related|share|sharing|sharebar|social|toolbar|pagination|pager)(?![a-z])""", re.X)
COMMENT_WORDS = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|comments?|replies|reply)(?![a-z])")
HEADER_WORDS = re.compile(r"(?:^|[^a-z])(?:headers?|masthead)(?![a-z])")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Share of the best score from which a sibling is kept; length from which a paragraph beside the best container is.
SIBLING, LONG = 0.2, 80
#: Open inline elements of a block among which a closing tag looks for its own, the innermost ones.
NESTED = 100


class Page(HTMLParser):
    """Blocks and tree of one page. A node has a tag, a parent and a kind: "cut", "header" (only headings stay), "form" or ""."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.kinds = ["#"], [-1], [""]
        self.stack, self.open = [("#", 0)], {"#": 1}  # open blocks with their nodes, and how many there are of each tag
        self.inline = [[]]  # for each open block, the open inline elements (tag, silent, link)
        self.blocks, self.pieces, self.linked = [], [], 0
        self.silent = self.links = 0

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def kind_of(self, tag: str, attrs: list) -> str:
        if tag == "form":
            return "form"
        if tag in CUT:
            return "cut"
        if attrs and tag not in ("html", "body", "main"):
            named = {k: v for k, v in attrs if v}
            words = HUMP.sub("-", f"{named.get('class', '')} {named.get('id', '')}").lower()
            if tag == "article":
                return "cut" if COMMENT_WORDS.search(words) else ""
            if named.get("role", "").lower() in CUT_ROLES or words != " " and CUT_WORDS.search(words):
                return "cut"
            if tag in BLOCK and tag not in HEADINGS and HEADER_WORDS.search(words):
                return "header"
        return "header" if tag == "header" else ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_block()
            top = self.stack[-1][0]
            if top == "p" or top in HEADINGS and tag in HEADINGS:
                self.pop()
            elif tag in CLOSES:
                closes, bounds = CLOSES[tag]
                k = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] in closes or self.stack[k][0] in bounds), 0)
                if self.stack[k][0] in closes:
                    self.pop(k)
            if tag not in VOID:
                self.tags.append(tag)
                self.parents.append(self.stack[-1][1])
                self.kinds.append(self.kind_of(tag, attrs))
                self.stack.append((tag, len(self.tags) - 1))
                self.inline.append([])
                self.open[tag] = self.open.get(tag, 0) + 1
        elif tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
        else:  # inline elements are no nodes; what is cut of them is only not heard
            if tag == "a" and self.links:
                self.handle_endtag("a")
            silent, link = self.kind_of(tag, attrs) in ("cut", "form"), tag == "a"
            self.inline[-1].append((tag, silent, link))
            self.silent += silent
            self.links += link

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
            if self.open.get(tag):
                self.pop(next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == tag))
        elif tag not in VOID:
            here = self.inline[-1]
            near = range(len(here) - 1, max(-1, len(here) - NESTED), -1)
            k = next((k for k in near if here[k][0] == tag), None)
            if k is not None:
                self.close_inline(here[k:])
                del here[k:]

    def pop(self, k: int = -1) -> None:
        """Close the open blocks from index k on."""
        for tag, _ in self.stack[k:]:
            self.open[tag] -= 1
        for left in self.inline[k:]:
            self.close_inline(left)
        del self.stack[k:], self.inline[k:]

    def close_inline(self, elements: list) -> None:
        self.silent -= sum(e[1] for e in elements)
        self.links -= sum(e[2] for e in elements)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())


def tree_of(html: str) -> Page:
    start = html.rfind("<!--")
    if start >= 0 and "-->" not in html[start:] and "</script" not in html[start:].lower():
        html = html[:start]  # a comment that nothing ends
    page = Page()
    page.feed(html)
    page.close()
    page.end_block()
    return page


def kept_blocks(page: Page) -> list[tuple[int, str, int]]:
    """The blocks that are not cut."""
    tags, parents, kinds = page.tags, page.parents, page.kinds
    n = len(tags)
    held = [0] * n  # text of a node and all below it that is cut by no element but a form
    for at, text, _ in page.blocks:
        held[at] += len(text)
    for k in range(n - 1, 0, -1):
        if kinds[k] != "cut":
            held[parents[k]] += held[k]
    state, in_article = [""] * n, [False] * n  # "cut", "header" or "" of a node, by it and those around it
    for k in range(1, n):
        up, kind = parents[k], kinds[k]
        in_article[k] = in_article[up] or tags[k] in ("article", "main")
        if kind == "form":
            kind = "" if 2 * held[k] > held[0] else "cut"
        if kind == "header":
            kind = "header" if in_article[up] else "cut"
        if state[up] == "cut" or kind == "cut":
            state[k] = "cut"
        elif tags[k] not in HEADINGS:
            state[k] = kind or state[up]
    return [b for b in page.blocks if state[b[0]] == ""]


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = tree_of(html)
    tags, parents = page.tags, page.parents
    blocks, n = kept_blocks(page), len(page.tags)
    points, own, length, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for at, text, in_links in blocks:
        length[at] += len(text)
        linked[at] += in_links
        if tags[at] not in HEADINGS:
            own[at] += (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - in_links / len(text))
    for k in range(n - 1, 0, -1):  # children have higher numbers
        up = parents[k]
        length[up] += length[k]
        linked[up] += linked[k]
        if tags[k] in PARAGRAPHS:
            points[up] += own[k] + points[k]
        else:
            points[k] += own[k]
            points[up] += points[k] / 2
    points[0] += own[0]
    score = [points[k] * (1 - linked[k] / length[k]) if length[k] and tags[k] not in PARAGRAPHS else 0.0 for k in range(n)]
    best = max(range(n), key=score.__getitem__)
    if not score[best]:  # nothing but headings, links or no text at all
        best = next((k for k in range(n) if tags[k] == "article" and length[k]), next((k for k in range(n) if tags[k] == "main" and length[k]), 0))
    up = best
    while up > 0:  # the whole of the outermost article around it
        best = up if tags[up] == "article" else best
        up = parents[up]

    beside, least = parents[best], SIBLING * score[best]
    reads = lambda size, links, end: links * 4 < size and size > LONG or size > 0 and not links and end in ".!?。！？…"
    last = {}
    for at, text, _ in blocks:
        last[at] = text[-1]
    inside = [False] * n
    inside[best] = True
    for k in range(1, n):
        if parents[k] == beside and k != best and length[k]:
            if tags[k] in HEADINGS:
                inside[k] = k < best
            elif tags[k] in PARAGRAPHS:
                inside[k] = reads(length[k], linked[k], last.get(k, ""))
            else:
                inside[k] = score[k] >= least > 0
        else:
            inside[k] = inside[k] or inside[parents[k]]
    return "\n".join(text for at, text, links in blocks if inside[at] or at == beside and reads(len(text), links, text[-1]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, a row for each page."""
    def make():
        def rows(ids, urls, htmls):
            for i, u, h in zip(ids, urls, htmls):
                text = main_text(h)
                yield i, u, text, len(text)
        return rows

    return map_rows(pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html"), make,
                    "page_id long, url string, text string, n_chars long")
