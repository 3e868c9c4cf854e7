"""HTML extraction (3): two-pass block rules.

The page is cut into blocks at block-level tags.  First pass: a block inside page furniture (menu, header, footer,
sidebar, form, advert, notice, reader comments, script, style) is decided bad; every other block is decided by
link density, length and stop-word density, or stays ambiguous when it is short or has few stop words.  Second
pass: an ambiguous block takes the label of its nearest decided neighbours in the same region.  Where the page
marks its article (``article`` or ``main``), blocks outside it are bad, and blocks inside are never bad for
lacking stop words, since the article's own structure speaks for them.

A class or id word, and ``form``, is a weaker sign than a tag or role.  A name that states a condition ("has-sidebar",
"no-comments") is no sign.  A name that mixes furniture words of the page's layout with others ("social-post"), or a
``form``, gives way where it holds ``main`` or a first-level heading with a long paragraph, a ``form`` to an ``article``
too.  Where what is left has no text that is long or decided good by itself, all names but those of reader comments
give way to an ``article``, ``main`` or first-level heading with a paragraph inside them, if that finds more.

Cases: null or empty html, or a page without main text, gives an empty text; unclosed tags, comments and scripts
run to the end of their parent or of the page; texts of any length are read whole; repeated rows give repeated
rows, and a null id or url stays null; of two neighbours as near, the good one counts; clashing extra columns are not
read; an empty table gives an empty one.
"""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from feedlake.llm.arrowtext import column, ship, strings

#: fixed values: frequent function words of four languages
STOP_WORDS = frozenset(
    "the of and to in is that it for was on with as are be this by at from or an not have but he they which you we "
    "le la les des une et est en que qui dans pour pas sur par du un au avec ce il sont plus se ne aux ou son "
    "der die das und ist von den mit zu ein eine nicht auf für sich im dem es auch als an werden bei oder nach "
    "el los las y de que en un una por con para es no se del al lo su como más o pero sus le ya".split())

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: block tags that stay open around other blocks
CONTAINERS = frozenset(
    "article aside body button details dialog div fieldset figure footer form head header html main menu nav "
    "section select table title ul ol dl".split())
#: containers whose text is never main text
FURNITURE_TAGS = frozenset("aside button dialog footer form head menu nav select title".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices alert overlay pager pagination popup promo promoted related reply replies "
    "respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "teaser toc toolbar widget widgets".split())
#: words of names that say what a page has or lacks
CONDITIONS = frozenset("has have no not with without enabled disabled open closed on off allowed active".split())
#: words that also name wrappers of whole pages
LAYOUT_NAMES = frozenset("banner header masthead menu nav navbar share sharing sidebar social tags toc toolbar widget widgets".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond response responses".split())
#: words that make an article or main element itself furniture
ASIDE_NAMES = COMMENT_NAMES | frozenset("ad ads advert advertisement promo promoted related sponsored teaser widget".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<svg\b(?:[^<>]*/>|.*?</svg\s*>)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^<>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME = re.compile(r"[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")

LONG, SHORT = 200, 70
STOP_HIGH, STOP_LOW = 0.32, 0.20
LINKS_HIGH = 0.5
GOOD, BAD, OPEN, LACKING = 1, -1, 0, 2      # LACKING: too few stop words, bad where another block is good


#: how surely an element is furniture: a form or a mixed layout name, any other name, reader comments, a tag or role
NONE, WEAK, NAMED, COMMENT, SURE = range(5)


def furniture(tag: str, attributes: str, in_article: bool) -> int:
    """How surely an element holds page furniture, by its tag, role, class and id."""
    if tag in FURNITURE_TAGS and tag != "form" or tag == "header" and not in_article:
        return SURE
    sure = WEAK if tag == "form" else NONE
    if not attributes or tag in ("html", "body"):
        return sure
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            return SURE
        if kind == "role" and value in FURNITURE_ROLES:
            if value != "form":
                return SURE
            sure = max(sure, WEAK)
        if kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if kind in ("class", "id"):
            for name in value.split():
                sure = max(sure, named(tag, NAME.findall(name), in_article))
    return sure


def named(tag: str, parts: list[str], in_article: bool) -> int:
    """How surely a class or id, cut into words, names furniture."""
    own = [p for p in parts if p in FURNITURE_NAMES or p == "header" and not in_article]
    if not own or CONDITIONS.intersection(parts):
        return NONE
    if tag in ("article", "main"):
        return COMMENT if len(own) == len(parts) and ASIDE_NAMES.intersection(own) else NONE
    if COMMENT_NAMES.intersection(own):
        return COMMENT
    return WEAK if len(own) < len(parts) and LAYOUT_NAMES.issuperset(own) else NAMED


class Blocks:
    """The blocks of a page: (text, characters in links, element, region).  Region 0 is outside the article."""

    def __init__(self, page: str):
        self.found: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]       # tag, element, region
        # by element: its parent, how surely it is furniture, is it a form, what it holds (main, article, h1), paragraph characters
        self.parent, self.sure, self.form, self.holds, self.prose = [0], [NONE], [False], [set()], [0]
        self.kinds = [""]
        self.block = ""
        in_link, at = False, 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self.text(page[at:m.start()], in_link)
            at = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            closing = bool(m[2])
            if tag == "a":
                in_link = not closing
            elif tag in ("br", "wbr", "img"):
                self.parts.append(" " if tag != "wbr" else "")
            elif tag in BLOCK_TAGS:
                self.end_block()
                in_link = False
                self.block = "" if closing else tag
                if tag in CONTAINERS:
                    self.close(tag) if closing else self.open(tag, m[4])
        if at < len(page):
            self.text(page[at:], in_link)
        self.end_block()

    def text(self, s: str, in_link: bool) -> None:
        self.parts.append(s)
        if in_link:
            self.linked.append(s)

    def open(self, tag: str, attributes: str) -> None:
        _, up, region = self.stack[-1]
        sure = max(furniture(tag, attributes, region > 0), SURE if self.sure[up] == SURE else NONE)
        if sure < COMMENT and tag in ("article", "main"):
            self.note(up, tag)
            if not region or self.kinds[region] == "main" and tag == "article":
                self.kinds.append(tag)
                region = len(self.kinds) - 1
        self.parent.append(up)
        self.sure.append(sure)
        self.form.append(tag == "form")
        self.holds.append(set())
        self.prose.append(0)
        self.stack.append((tag, len(self.parent) - 1, region))

    def note(self, element: int, what: str, prose: int = 0) -> None:
        """Tell an element and those around it what they hold, up to reader comments or sure furniture."""
        while element and self.sure[element] < COMMENT:
            if prose:
                self.prose[element] += prose
            elif what in self.holds[element]:
                return
            else:
                self.holds[element].add(what)
            element = self.parent[element]

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def end_block(self) -> None:
        if self.parts:
            text = clean("".join(self.parts))
            if text:
                _, element, region = self.stack[-1]
                self.found.append((text, len(clean("".join(self.linked))) if self.linked else 0, element, region))
                if self.block == "h1":
                    self.note(element, self.block)
                elif self.block == "p":
                    self.note(element, "", len(text))
            self.parts, self.linked = [], []

    def bad(self, giving_way: bool) -> list[bool]:
        """By element: whether it is furniture or inside some; ``giving_way``: names count less than what they hold."""
        out: list[bool] = []
        for up, sure, form, holds, prose in zip(self.parent, self.sure, self.form, self.holds, self.prose):
            own = sure > NONE
            if sure == WEAK:
                own = not ("main" in holds or form and "article" in holds or "h1" in holds and prose >= LONG)
            if own and giving_way and sure < COMMENT:
                own = not (holds & {"main", "article"} or "h1" in holds and prose >= SHORT)
            out.append(own or bool(out) and out[up])
        return out


def clean(s: str) -> str:
    return " ".join((htmllib.unescape(s) if "&" in s else s).split())


def stop_density(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_label(text: str, linked: int, inside: bool) -> int:
    """Decide a block by itself, or leave it open."""
    if linked > LINKS_HIGH * len(text):
        return BAD
    if len(text) < SHORT:
        return BAD if linked and not inside else OPEN
    if not inside and ("©" in text or linked > 0.2 * len(text)):
        return BAD
    density = stop_density(text)
    if density >= STOP_HIGH and len(text) >= LONG:
        return GOOD
    if density < STOP_LOW and not inside:
        return LACKING
    return OPEN


def second_labels(labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbour (of two as near, good); good where none is."""
    lacking = BAD if GOOD in labels else OPEN           # else the page's language has no list here
    labels = [lacking if label == LACKING else label for label in labels]
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        if labels[i] != OPEN:
            last = i
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] != OPEN:
            last = i
        after[i] = last
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            near = sorted((abs(i - j), -labels[j]) for j in (before[i], after[i]) if j is not None)
            label = -near[0][1] if near else GOOD
        out.append(label)
    return out


def kept_blocks(parsed: Blocks, giving_way: bool) -> tuple[list[int], bool]:
    """The numbers of the blocks of main text, and whether one of them is good by itself or all together are long."""
    blocks, furnished = parsed.found, parsed.bad(giving_way)
    articles = {r for r, kind in enumerate(parsed.kinds) if kind == "article"}
    mains = {r for r, kind in enumerate(parsed.kinds) if kind == "main"}
    used = {r for _, _, element, r in blocks if not furnished[element]}
    wanted = articles & used or mains & used or {0}
    regions: dict[int, list[int]] = {}
    for i, (_, _, element, region) in enumerate(blocks):
        if not furnished[element] and region in wanted:
            regions.setdefault(region, []).append(i)
    keep, sure = [], False
    for region, own in regions.items():
        labels = [first_label(blocks[i][0], blocks[i][1], region > 0) for i in own]
        sure = sure or region > 0 or GOOD in labels
        keep += [i for i, label in zip(own, second_labels(labels)) if label == GOOD]
    return sorted(keep), sure and bool(keep) or sum(len(blocks[i][0]) for i in keep) >= LONG


def main_text(page: str) -> str:
    if not page:
        return ""
    parsed = Blocks(page)
    keep, sure = kept_blocks(parsed, False)
    if not sure and any(NONE < s < COMMENT for s in parsed.sure):
        more = kept_blocks(parsed, True)[0]
        if sum(len(parsed.found[i][0]) for i in more) > sum(len(parsed.found[i][0]) for i in keep):
            keep = more
    return " ".join(parsed.found[i][0] for i in keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).  One pass, no shuffle."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in strings(b, "html")]
            yield pa.RecordBatch.from_arrays(
                [column(b, "id"), column(b, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [src.schema[c].dataType.simpleString() for c in ("id", "url")]
    return src.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
