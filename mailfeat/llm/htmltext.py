"""Main text of HTML pages from flat text blocks.

A page is cut into a flat list of blocks (text between block-level tags).  A
decision tree looks at a block's word count and link density, those of its
neighbours, and at the kind of region it stands in, and says whether it
belongs to the article.  The tree is grown here from BLOCK_TABLE, a small
table of labelled blocks.

Defined results: a null or empty page has an empty text; a page without a
block of the article class gives an empty text; unclosed and stray tags close
at the next block; markup cut off at the end of the page is no text; repeated
rows are repeated; the region of a block comes from its open tags, the
innermost that says anything deciding (of one tag boilerplate over article),
but a class name lifts nothing out of a boilerplate tag and nothing is lifted
out of a hidden one; a form that holds the bulk of the page's words says
nothing.  Blocks outside the marked region go only if it holds the bulk of the
article's words.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas video audio select head".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn del em font i img input ins kbd label mark meter nobr progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav header footer aside menu dialog button".split())
_FORM_TAGS = frozenset(("form", "fieldset"))
_FIELDS = frozenset("input label textarea select button".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
#: What boilerplate is called; a name of several words counts by its head, the last one that says more than where or in what frame.
_BOILER_WORD = re.compile(r"(?:ads?|adsby\w*|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|masthead|menus?|modal|nav\w*|newsletter|notices?|overlay|pagination|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?)$", re.I)
_FRAME_WORD = re.compile(r"(?:[0-9]+|area|bar|block|bottom|box|btns?|buttons?|column|container|content|desktop|form|global|group|holder|icons?|inner|items?|left|links?|list|mobile|modal|outer|panel|primary|right|row|secondary|section|slot|thread|top|unit|wrap|wrapper)$", re.I)
_RELATED = re.compile(r"related[_-]?(?:articles?|posts?|stories|news|reading|topics)$", re.I)
#: Names such as has-sidebar or no-comments say how a page is laid out, not what stands in the tag.
_STATE_NAME = re.compile(r"(?:^|[_-])(?:has|have|no|not|non|with|without|hide|show|is|layout)(?:$|[_-])", re.I)
_ARTICLE_NAME = re.compile(r"(?:article|content|entry|main|post|story|(?:article|entry|main|post|story)[_-]?(?:body|content|text))$", re.I)
_BOILER_ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|alertdialog|menu|menubar)$", re.I)

_OPENS = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)")
_TO_MARK = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""[\s/]*(?P<name>[^\s=/>]+)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?""")
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@dataclass
class Block:
    """One flat block: its text, the words of it that stand in links, and its region."""

    text: str
    linked: int
    region: int  # 1 article, -1 boilerplate, 0 neither says
    words: int = field(init=False)

    def __post_init__(self) -> None:
        self.words = len(self.text.split())

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


#: What a tag says about its contents; above 0 for an article, below for boilerplate.
_HIDDEN, _BOILER_TAG, _BOILER, _FORM, _ARTICLE, _ARTICLE_TAG = -4, -3, -2, -1, 1, 2


def _attributes(attrs: str) -> dict[str, str]:
    """Name (lower case) and value of each attribute, one after the other; the first of a name holds."""
    out: dict[str, str] = {}
    at = 0
    while m := _ATTR.match(attrs, at):
        out.setdefault(m["name"].lower(), m["a"] or m["b"] or m["c"] or "")
        at = m.end()
    return out


def _is_boilerplate(name: str) -> bool:
    """Whether a class or id names boilerplate: by the head of its words."""
    if _STATE_NAME.search(name):
        return False
    words = [w for w in re.split(r"[_-]+", name) if w]
    while len(words) > 1 and _FRAME_WORD.match(words[-1]) and not _BOILER_WORD.match(words[-1]):
        words.pop()
    return bool(words and _BOILER_WORD.match(words[-1])) or bool(_RELATED.match(name))


def _region(tag: str, attrs: str) -> int:
    """What a tag says about its contents, 0 for nothing."""
    names = _attributes(attrs) if attrs else {}
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", names.get("style", "")):
        return _HIDDEN
    if tag in _BOILER_TAGS or _BOILER_ROLES.match(names.get("role", "")):
        return _BOILER_TAG
    called = f"{names.get('class', '')} {names.get('id', '')}".split()
    if tag not in ("body", "html") and any(map(_is_boilerplate, called)):
        return _BOILER
    if tag in _ARTICLE_TAGS or names.get("role", "").lower() in ("main", "article"):
        return _ARTICLE_TAG
    if any(_ARTICLE_NAME.match(x) for x in called):
        return _ARTICLE
    return _FORM if tag in _FORM_TAGS else 0


def _inside(outer: int, says: int) -> int:
    """What holds within a tag: the innermost that decides, but hidden stays, and a class doesn't undo a boilerplate tag."""
    if not says or says == _FORM or outer == _HIDDEN or (outer == _BOILER_TAG and says == _ARTICLE):
        return outer
    return says


def _tag_end(page: str, at: int, lone: set[str]) -> int:
    """Where the tag whose name ends at `at` ends; a quote that never closes (it is put into lone) is a character like others."""
    while True:
        at = _TO_MARK.match(page, at).end()
        if at == len(page) or page[at] == ">":
            return at
        quote = page[at]
        close = -1 if quote in lone else page.find(quote, at + 1)
        if close < 0:
            lone.add(quote)
        at = max(at, close) + 1


def blocks_of(page: str | None) -> list[Block]:
    """The page's flat blocks in order, in time linear in the page.

    What an open tag says is summed up on the stack, so a block asks the
    innermost one only.  A form with a field is boilerplate with all it holds,
    unless it frames the page, that is has a header, navigation, footer or article
    in it.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, what holds in it, the form around (its number)
    opened: Counter[str] = Counter()
    around, frames, fields = [0], [True], [False]  # of each form: the one around it, whether it frames the page, whether it has a field
    in_form: list[int] = []  # of each block
    text: list[str] = []
    linked: list[str] = []
    links = 0
    lone: set[str] = set()

    def flush() -> None:
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            holds = stack[-1][1] if stack else 0
            out.append(Block(whole, len(html.unescape("".join(linked)).split()), (holds > 0) - (holds < 0)))
            in_form.append(stack[-1][2] if stack else 0)
        text.clear()
        linked.clear()

    def say(s: str) -> None:
        text.append(s)
        if links:
            linked.append(s)

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    while m := _OPENS.search(page, at):
        say(page[at : m.start()])
        if not m["tag"]:
            mark = m[0]
            ends = "-->" if mark == "<!--" else "]]>" if mark.startswith("<![") else ">"
            close = page.find(ends, m.end())
            if mark.startswith("<!["):
                say(html.escape(page[m.end() : close if close >= 0 else len(page)]))
            at = close + len(ends) if close >= 0 else len(page)
            continue
        end = _tag_end(page, m.end(), lone)
        attrs, at = page[m.end() : end], min(end + 1, len(page))
        tag = m["tag"].lower()
        if tag in _FIELDS and not m["end"] and not (tag == "input" and _attributes(attrs).get("type", "").lower() == "hidden"):
            fields[stack[-1][2] if stack else 0] = True
        if tag in _RAW and not m["end"]:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "head" and not close:
                close = re.compile(r"(?=<body)", re.I).search(page, at)
            at = close.end() if close else len(page) if tag != "head" else at
            say(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            elif tag in ("br", "wbr", "img", "input"):
                say(" " if tag != "wbr" else "")
            continue
        flush()
        if m["end"]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            links = 0
        elif tag not in _VOID:
            if stack and (stack[-1][0] == "p" and tag in _ENDS_P or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                pop()
            _, holds, form = stack[-1] if stack else ("", 0, 0)
            says = _region(tag, attrs)
            if says == _FORM:
                around.append(form)
                frames.append(False)
                fields.append(False)
                form = len(around) - 1
            elif says in (_ARTICLE_TAG, _ARTICLE) or tag in ("header", "nav", "footer"):
                up = form
                while not frames[up]:
                    frames[up] = True
                    up = around[up]
            opened[tag] += 1
            stack.append((tag, _inside(holds, says), form))
    rest = page[at:]
    cut = re.compile(r"<[A-Za-z/!?]").search(rest, rest.rfind(">") + 1)  # markup that the page's end cuts off
    say(rest[: cut.start()] if cut else rest)
    flush()
    dropped = [False]
    for i in range(1, len(around)):
        dropped.append(not frames[i] and (fields[i] or dropped[around[i]]))
    for b, form in zip(out, in_form):
        if dropped[form]:
            b.region = -1
    return out


#: Labelled blocks (fixed values): words, link density, words and density of the block before, of the block after, region, 1 for article text.
BLOCK_TABLE = (
    (6, 0.0, 6, 1.0, 80, 0.0, 1, 1), (9, 0.0, 3, 1.0, 120, 0.0, 1, 1), (85, 0.02, 6, 0.0, 95, 0.0, 1, 1), (140, 0.0, 85, 0.0, 60, 0.05, 1, 1),
    (22, 0.1, 140, 0.0, 90, 0.0, 1, 1), (2, 0.0, 90, 0.0, 70, 0.0, 1, 1), (1, 0.0, 40, 0.0, 0, 0.0, 1, 1), (3, 0.0, 0, 0.0, 0, 0.0, 1, 1),
    (12, 0.5, 60, 0.0, 75, 0.0, 1, 1), (4, 1.0, 80, 0.0, 90, 0.0, 1, 1), (30, 0.0, 12, 0.0, 1, 1.0, 1, 1), (300, 0.01, 20, 0.0, 9, 0.0, 1, 1),
    (18, 0.0, 2, 1.0, 25, 0.0, 1, 1), (45, 0.0, 1, 1.0, 6, 0.0, 1, 1), (5, 0.0, 7, 0.0, 8, 0.0, 1, 1), (60, 0.3, 50, 0.1, 40, 0.0, 1, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 0), (2, 1.0, 1, 1.0, 8, 0.0, -1, 0), (8, 0.0, 1, 1.0, 6, 0.0, -1, 0),
    (40, 0.0, 1, 1.0, 9, 0.0, -1, 0), (120, 0.0, 90, 0.0, 110, 0.0, -1, 0), (25, 0.0, 70, 0.0, 0, 0.0, -1, 0), (12, 0.0, 85, 0.0, 3, 1.0, -1, 0),
    (6, 0.0, 0, 0.0, 80, 0.0, -1, 0), (55, 0.1, 30, 0.0, 45, 0.0, -1, 0), (3, 0.3, 100, 0.0, 2, 1.0, -1, 0), (200, 0.0, 5, 0.0, 4, 0.5, -1, 0),
    (90, 0.01, 8, 0.0, 75, 0.0, 0, 1), (60, 0.05, 70, 0.0, 80, 0.02, 0, 1), (35, 0.0, 60, 0.0, 50, 0.0, 0, 1), (25, 0.1, 9, 0.0, 60, 0.0, 0, 1),
    (150, 0.1, 3, 1.0, 2, 1.0, 0, 1), (18, 0.0, 80, 0.0, 65, 0.0, 0, 1), (7, 0.0, 90, 0.0, 100, 0.0, 0, 1), (5, 0.0, 2, 1.0, 90, 0.0, 0, 1),
    (9, 0.0, 1, 1.0, 45, 0.0, 0, 1), (40, 0.2, 35, 0.0, 6, 0.0, 0, 1), (28, 0.0, 2, 1.0, 3, 1.0, 0, 1), (16, 0.0, 40, 0.0, 30, 0.0, 0, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0, 0), (4, 1.0, 2, 1.0, 90, 0.0, 0, 0), (3, 0.0, 2, 1.0, 70, 0.0, 0, 1), (1, 1.0, 40, 0.0, 1, 1.0, 0, 0), (6, 0.8, 5, 0.9, 7, 0.7, 0, 0), (20, 0.9, 3, 1.0, 25, 0.8, 0, 0),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0), (7, 0.0, 1, 1.0, 3, 0.5, 0, 0), (5, 0.2, 4, 0.6, 0, 0.0, 0, 0), (9, 0.0, 30, 0.0, 1, 1.0, 0, 1),
    (3, 0.0, 0, 0.0, 2, 1.0, 0, 0), (12, 0.6, 90, 0.0, 4, 1.0, 0, 0), (50, 0.7, 40, 0.8, 5, 0.6, 0, 0), (45, 0.9, 5, 1.0, 3, 1.0, 0, 0), (8, 0.4, 2, 0.0, 3, 0.0, 0, 0),
    # short blocks of unmarked pages, among blocks as free of links, and at the ends of the text
    (12, 0.0, 15, 0.0, 18, 0.0, 0, 1), (5, 0.0, 9, 0.0, 7, 0.0, 0, 1), (25, 0.0, 20, 0.0, 22, 0.0, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1), (8, 0.1, 12, 0.0, 10, 0.1, 0, 1),
    (3, 0.0, 0, 0.0, 12, 0.0, 0, 1), (14, 0.0, 0, 0.0, 6, 0.0, 0, 1), (6, 0.0, 11, 0.0, 0, 0.0, 0, 1), (17, 0.0, 80, 0.0, 0, 0.0, 0, 1), (1, 0.0, 4, 0.0, 0, 0.0, 0, 1),
    (10, 0.0, 0, 0.0, 0, 0.0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1), (13, 0.0, 2, 1.0, 15, 0.0, 0, 1), (5, 0.0, 1, 1.0, 9, 0.0, 0, 1), (16, 0.0, 14, 0.0, 2, 1.0, 0, 1),
    (4, 0.0, 8, 0.0, 1, 1.0, 0, 1), (6, 0.0, 20, 0.0, 3, 0.9, 0, 1), (15, 0.0, 2, 1.0, 3, 1.0, 0, 1), (21, 0.0, 1, 1.0, 1, 1.0, 0, 1), (20, 0.0, 0, 0.0, 1, 1.0, 0, 1),
    (2, 0.0, 0, 0.0, 1, 1.0, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 0), (1, 1.0, 12, 0.0, 15, 0.0, 0, 0), (4, 1.0, 10, 0.0, 0, 0.0, 0, 0), (6, 0.9, 0, 0.0, 14, 0.0, 0, 0),
    (60, 0.0, 40, 0.0, 3, 0.5, 0, 1), (20, 0.0, 15, 0.0, 5, 0.6, 0, 1), (9, 0.0, 12, 0.0, 4, 0.5, 0, 1), (30, 0.2, 4, 0.0, 20, 0.0, 0, 1), (25, 0.25, 0, 0.0, 30, 0.0, 0, 1), (50, 0.2, 3, 1.0, 10, 0.0, 0, 1), (10, 0.2, 3, 0.0, 6, 0.0, 0, 1),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 1), (5, 0.0, 4, 0.0, 3, 0.0, 0, 1), (7, 0.0, 3, 0.0, 2, 0.0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1), (7, 0.14, 5, 0.0, 3, 0.0, 0, 1), (3, 0.0, 2, 0.0, 1, 0.0, 0, 1),
    (12, 0.2, 20, 0.0, 0, 0.0, 0, 1), (30, 0.2, 0, 0.0, 0, 0.0, 0, 1), (60, 0.3, 40, 0.0, 0, 0.0, 0, 1), (8, 0.2, 9, 0.0, 0, 0.0, 0, 1), (7, 0.0, 12, 0.0, 1, 1.0, 0, 1), (8, 0.0, 20, 0.0, 2, 1.0, 0, 1), (7, 0.0, 6, 0.0, 3, 0.5, 0, 1),
    (80, 0.0, 6, 0.7, 40, 0.0, 0, 1), (15, 0.0, 5, 0.6, 9, 0.0, 0, 1), (7, 0.0, 4, 0.7, 12, 0.0, 0, 1), (20, 0.2, 4, 0.6, 0, 0.0, 0, 1),
    (6, 0.17, 12, 0.0, 10, 0.0, 0, 1), (7, 0.14, 9, 0.0, 20, 0.0, 0, 1), (5, 0.2, 10, 0.0, 8, 0.0, 0, 1), (4, 0.25, 6, 0.0, 9, 0.0, 0, 1),
    (4, 0.0, 3, 1.0, 2, 1.0, 1, 1), (3, 0.0, 0, 0.0, 2, 1.0, 1, 1), (6, 0.0, 4, 0.0, 1, 1.0, 1, 1), (5, 0.2, 4, 0.6, 0, 0.0, 1, 1), (7, 0.0, 1, 1.0, 3, 0.5, 1, 1), (2, 0.3, 5, 0.5, 2, 0.0, 1, 1),
    (6, 0.0, 9, 0.0, 8, 0.0, -1, 0), (12, 0.0, 15, 0.0, 18, 0.0, -1, 0), (3, 0.0, 20, 0.0, 0, 0.0, -1, 0), (40, 0.0, 35, 0.0, 30, 0.0, -1, 0), (9, 0.0, 0, 0.0, 0, 0.0, -1, 0),
)

Node = tuple  # (feature, limit, node at most, node above) or (class,)


def grow(rows: tuple, depth: int = 6, least: int = 1) -> Node:
    """A Gini decision tree; the first best split in order of feature and limit."""
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)) or depth == 0:
        return (int(2 * ones >= len(rows)),)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low = [r for r in rows if r[f] <= cut]
            if not least <= len(low) <= len(rows) - least:
                continue
            p = sum(r[-1] for r in low)
            q, n = ones - p, len(rows) - len(low)
            impure = p * (len(low) - p) / len(low) + q * (n - q) / n
            if best is None or impure < best[0] - 1e-12:
                best = (impure, f, cut)
    if best is None:
        return (int(2 * ones >= len(rows)),)
    _, f, cut = best
    return (f, cut, grow(tuple(r for r in rows if r[f] <= cut), depth - 1, least), grow(tuple(r for r in rows if r[f] > cut), depth - 1, least))


@lru_cache(maxsize=1)
def block_tree() -> Node:
    return grow(BLOCK_TABLE, depth=len(BLOCK_TABLE))  # as deep as every row of the table needs


def classify(blocks: list[Block]) -> list[bool]:
    """Article or not, for each block, by the tree; next to boilerplate is as at the page's edge."""
    none = Block("", 0, 0)
    near = [none, *(none if b.region == -1 else b for b in blocks), none]
    out = []
    for b, before, after in zip(blocks, near, near[2:]):
        row = (b.words, b.density, before.words, before.density, after.words, after.density, b.region)
        node = block_tree()
        while len(node) > 1:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        out.append(bool(node[0]))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by line ends.

    A page may mark more than its article, or only a teaser.  So blocks outside
    any region go only where those that the tree takes from marked regions have
    more words than they have; with as many or fewer, both stay.
    """
    blocks = blocks_of(page)
    found = [b for b, good in zip(blocks, classify(blocks)) if good]
    inside, outside = (sum(b.words for b in found if b.region == r) for r in (1, 0))
    return "\n".join(b.text for b in found if b.region == 1 or outside >= inside)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length, for every page."""

    def run(cols: dict) -> dict:
        text = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    pick = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_columns(pick, run, "page_id long, url string, text string, n_chars long")
