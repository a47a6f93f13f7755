"""Main text of web pages by composite text density.

For every node of a page: the characters and tags below it, and how many of either belong to links, give a composite
text density, characters per tag, made smaller by links. The density sum of a node adds the densities of its children.
The subtree with the largest density sum is the core of the page; the smallest density on its path to the body is the
threshold, and parts beside that path join in when they reach it; so do headings, and in containers of the core below
the body all parts that are not mostly links. If the core lies in an article or main element, that
element is the text as a whole.

Before that, what is never text goes: scripts, styles, comments in the markup, forms, menus, headers and footers of the
page, sidebars, adverts, notices and reader comments, told by element, role, class or id, and hidden elements. A class or
id is a mark if all of its words are marks or say where and what a part is ("sidebar-left", "ad-banner", but not
"has-sidebar" or "social-science"). A marked wrapper or form that holds the article, or the frame of the page, and more
text than all that lies outside marked parts, is taken for a wrapper of the page and stays; what is marked inside it goes.

The text: character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined
in page order by two line ends. A line break inside a block is white space. Nothing is capped.

Defined results: a null or empty page, or one without text, gives an empty text; markup without end tags, or cut off in
the middle, is read as far as it goes (only an open script, style, textarea or title hides the rest of the page); repeated
rows are extracted one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot"
    " thead tr ul".split()
)
SPACED = frozenset("br td th wbr img option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object select".split())
# Of these, the ones that hide the rest of the page if their end is missing.
RAW_TO_THE_END = frozenset("script style textarea title".split())
NEVER = frozenset("head nav footer aside form button dialog menu search input label fieldset canvas audio video".split())
WHOLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
LIST_ENDS = frozenset("ul ol dl table menu dir".split())
# Fixed words of class, id and role that mark what is not text.
MARKS = frozenset(
    "nav navbar navigation menu sidebar footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner ad ads"
    " advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies disqus share"
    " sharing social related newsletter subscribe subscription popup modal widget toolbar pagination pager skip signup login"
    " search complementary contentinfo alert dialog form".split()
)
# These mark page headers, but not the header of an article.
HEADER_MARKS = frozenset("header masthead topbar".split())
# These say where or what a part is, and are no marks by themselves.
COMPANIONS = frozenset(
    "a article area bar block body bottom box btn button buttons col column container content entry fixed global group id"
    " inner js item items left links list main middle mobile module outer page panel part post posts primary right row"
    " secondary section side site slot sticky text the to top unit user widgets wrap wrapper".split()
)
# Parts with these marks never wrap a page.
FIRM_MARKS = frozenset(
    "nav navbar navigation menu footer breadcrumb breadcrumbs cookie cookies consent gdpr comment comments reply replies"
    " disqus contentinfo".split()
)
# Elements that frame a page.
FRAME = frozenset("h1 article main nav header footer".split())
# What marks a node: nothing, a mark that a wrapper of the page may bear, or one that always holds.
CLEAR, MARKED, FIRM = 0, 1, 2
# A part that holds a frame but no article is a wrapper of the page if it holds this many times the text outside.
FRAMED_SHARE = 10

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>""", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The nodes of a page in page order, each with its parent; texts are leaves without a name."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.parents: list[int] = []
        self.texts: list[str] = []
        self.marks: list[int] = []
        self.dropped: list[bool] = []

    def add(self, name: str, parent: int, text: str = "", mark: int = CLEAR) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.texts.append(text)
        self.marks.append(mark)
        return len(self.names) - 1

    def drop_marked(self) -> None:
        """Drop all that is marked or inside a marked node, but keep the wrapper of the page."""
        size = len(self.names)
        if MARKED in self.marks:
            for node in self._wrapper():
                self.marks[node] = CLEAR
        self.dropped = [False] * size
        for node in range(size):
            parent = self.parents[node]
            self.dropped[node] = self.marks[node] != CLEAR or parent >= 0 and self.dropped[parent]

    def _wrapper(self) -> list[int]:
        """The marked nodes, from the inside out, that wrap the text of the page."""
        size = len(self.names)
        clear, whole, frame = [0] * size, [False] * size, [False] * size
        for node in range(size - 1, 0, -1):
            if not self.names[node]:
                clear[node] = len("".join(self.texts[node].split()))
            parent = self.parents[node]
            frame[parent] |= frame[node] or self.names[node] in FRAME
            if self.marks[node] == CLEAR:
                clear[parent] += clear[node]
                whole[parent] |= whole[node] or self.names[node] in WHOLE
        firm = [False] * size
        for node in range(1, size):
            firm[node] = self.marks[node] == FIRM or firm[self.parents[node]]
        found = [
            n
            for n in range(1, size)
            if self.marks[n] == MARKED
            and not firm[n]
            and (whole[n] and clear[n] > clear[0] or frame[n] and clear[n] > FRAMED_SHARE * clear[0])
        ]
        if not found:
            return []
        path = [max(found, key=lambda n: (clear[n], -n))]
        while self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        return [n for n in path if self.marks[n] == MARKED]


def _attributes(source: str) -> dict[str, str]:
    return {a.lower(): v.strip("\"'") for a, v in _ATTRIBUTE.findall(source)} if source else {}


def _marking(token: str, marks: frozenset[str]) -> set[str]:
    """The marks in a class, id or role, if it holds no words beside them but companions."""
    words = set(_WORD.findall(token))
    return words & marks if words <= marks | COMPANIONS | HEADER_MARKS else set()


def _mark(name: str, source: str, inside: bool) -> int:
    """Whether an element is never text; ``inside``: it is part of an article or main element."""
    if name in NEVER or name == "header" and not inside:
        return MARKED if name == "form" else FIRM
    if not source or name in ("body", "html"):
        return CLEAR
    found = _attributes(source)
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return FIRM
    tokens = " ".join(found.get(a, "") for a in ("class", "id", "role")).lower().split()
    marks = {m for t in tokens for m in _marking(t, MARKS)}
    if name == "article":
        return FIRM if marks & {"comment", "comments", "reply"} else CLEAR
    if name in WHOLE:
        return CLEAR
    if marks:
        return FIRM if marks & FIRM_MARKS else MARKED
    return MARKED if not inside and any(_marking(t, HEADER_MARKS) for t in tokens) else CLEAR


def parse(source: str) -> Page:
    """The nodes of a page; end tags may be missing."""
    page = Page()
    page.add("html", -1)
    stack = [0]
    whole = 0  # open article and main elements
    endless: set[str] = set()  # names whose end tag does not come any more
    at = 0

    def text(piece: str) -> None:
        if piece:
            page.add("", stack[-1], html.unescape(piece))

    def close(depth: int) -> None:
        nonlocal whole
        while len(stack) > depth:
            whole -= page.names[stack.pop()] in WHOLE

    def open_depth(names: tuple[str, ...], ends: frozenset[str]) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            name = page.names[stack[depth]]
            if name in names:
                return depth
            if name in ends:
                return 0
        return 0

    while at < len(source):
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        match = _TAG.match(source, start) or _LOOSE_TAG.match(source, start)
        if match is None:
            # A tag that the page ends in is dropped; any other "<" is text.
            if re.match(r"<[/!?a-zA-Z]", source[start : start + 2]) and ">" not in source[start:]:
                text(source[at:start])
                break
            text(source[at : start + 1])
            at = start + 1
            continue
        text(source[at:start])
        at = match.end()
        name = (match.lastindex and match.group(2) or "").lower()
        if not name:
            continue
        if match.group(1):
            depth = open_depth((name,), frozenset())
            if depth:
                close(depth)
            continue
        if name in RAW:
            if name in endless or match.group(3).rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            if end:
                at = end.end()
            elif name in RAW_TO_THE_END:
                at = len(source)
            else:
                endless.add(name)
            continue
        if name in BLOCKS and (depth := open_depth(("p",), BLOCKS - {"p"})):
            close(depth)
        if name in CLOSED_BY_SAME and (depth := open_depth(CLOSED_BY_SAME[name], LIST_ENDS)):
            close(depth)
        parent = stack[-1]
        node = page.add(name, parent, "", _mark(name, match.group(3), whole > 0))
        if name not in VOID and not (match.group(3).endswith("/") and name not in BLOCKS):
            stack.append(node)
            whole += name in WHOLE
    page.drop_marked()
    return page


def densities(page: Page, body: int) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite text density, density sum, characters and characters of links of every node."""
    size = len(page.names)
    chars, tags, link_chars, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):
        if page.dropped[node]:
            continue
        name, parent = page.names[node], page.parents[node]
        if not name:
            chars[node] = len(" ".join(page.texts[node].split()))
        if name == "a":
            link_chars[node], link_tags[node] = chars[node], tags[node] + 1
        if parent >= 0:
            chars[parent] += chars[node]
            tags[parent] += tags[node] + bool(name)
            link_chars[parent] += link_chars[node]
            link_tags[parent] += link_tags[node]
    share = link_chars[body] / max(chars[body], 1)
    density, sums = [0.0] * size, [0.0] * size
    for node in range(size - 1, -1, -1):
        if page.dropped[node] or not page.names[node] or not chars[node]:
            continue
        own, links = chars[node], link_chars[node]
        base = math.log(own / max(own - links, 1) * links + share * own + math.e)
        ratio = own / max(links, 1) * max(tags[node], 1) / max(link_tags[node], 1)
        # A base of one would divide by zero; base and ratio grow from there.
        density[node] = own / max(tags[node], 1) * math.log(ratio + 1e-9) / math.log(max(base, 1 + 1e-3))
        density[node] = max(density[node], 0.0)
        if page.parents[node] >= 0:
            sums[page.parents[node]] += density[node]
    return density, sums, chars, link_chars


def _chosen(page: Page) -> list[bool]:
    """Which nodes belong to the text."""
    size = len(page.names)
    body = next((n for n in range(size) if page.names[n] == "body"), 0)
    density, sums, chars, links = densities(page, body)
    # A node whose text is its own, without elements below, stands for itself.
    best = max(range(size), key=lambda n: (sums[n] if sums[n] else density[n] / 2, -n))
    path = [best]
    while page.parents[path[-1]] >= 0 and path[-1] != body:
        path.append(page.parents[path[-1]])
    threshold = min(density[n] for n in path)
    kept = [False] * size
    whole = [n for n in path if page.names[n] in WHOLE]
    if whole:
        roots = {whole[-1]}
    else:
        on_path = set(path)
        roots = {best}
        for node in range(size):
            parent = page.parents[node]
            if parent not in on_path or node in on_path or page.dropped[node]:
                continue
            # Beside the core, in its container: all but lists of links. Directly in the body: what is dense enough.
            beside = parent != body and links[node] <= chars[node] / 3
            if beside or density[node] >= threshold > 0 or page.names[node] in HEADINGS:
                roots.add(node)
    for node in range(size):
        kept[node] = (node in roots or page.parents[node] >= 0 and kept[page.parents[node]]) and not page.dropped[node]
    return kept


def main_text(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = parse(source)
    kept = _chosen(page)
    blocks: list[list[str]] = [[]]
    block_of: list[int] = [-1] * len(page.names)
    last = None
    for node, name in enumerate(page.names):
        parent = page.parents[node]
        block_of[node] = node if name in BLOCKS or parent < 0 else block_of[parent]
        if not kept[node]:
            continue
        if block_of[node] != last:
            blocks.append([])
            last = block_of[node]
        if name in SPACED:
            blocks[-1].append(" ")
        blocks[-1].append(page.texts[node])
        if name in ("td", "th"):
            blocks[-1].append(" ")
    texts = (" ".join("".join(block).split()) for block in blocks)
    return "\n\n".join(t for t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [main_text(page.as_py()) for page in part.column("html")]
            yield pa.record_batch(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (its code points)."""
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return plain.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
