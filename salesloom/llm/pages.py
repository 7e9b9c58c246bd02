"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements. The first pass decides blocks on their
own: by the elements around them, link density, length and stop-word density. Short and
unclear blocks stay open and in the second pass inherit the label of the nearest decided
neighbours. Where little of a page's long text has known stop words (another language,
tables, code), density tells nothing and length decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cached_property
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import extend

# Elements and names with a known role, and common function words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks of text, as opposed to the elements that group them.
TEXT_TAGS = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Their content is no text of the page.
SILENT_TAGS = frozenset(
    "script style noscript template head title textarea select option button iframe object "
    "canvas svg math audio video datalist".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar widget related recommended share sharing social comment "
    "comments commentlist reply replies respond disqus menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer copyright legal search pagination pager toolbar".split()
)
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog".split()
)
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on are this or from at not have an "
    "he his her they we you which but had were there "
    "der die das und ist von den zu mit sich des auf für im dem nicht ein eine als auch es an "
    "werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "le la les de des du et un une en est que qui dans pour par sur pas au aux ce se il elle "
    "plus ne avec sont son sa ses ou "
    "el los las y o del que se por con para una su al lo como más pero sus este ha no si "
    "entre es".split()
)
#: Blocks of at least this length and stop-word density are text on their own.
LONG, DENSE = 70, 0.2
#: More of a block in links than this makes it a list of links.
LINKS = 0.5
#: Density tells text from the rest if at least this part of the page's long text is dense;
#: article and main exclude the rest if they hold at least this part of the page's text.
SHARE = 0.25
#: In a boilerplate element of these that is closed, an article is a teaser. Forms wrap pages.
WRAPPERS = BOILERPLATE_TAGS - {"form"}

GOOD, BAD, OPEN = 1, -1, 0
_NAME = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Characters that say as much as two of an alphabet.
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    boilerplate: bool
    content: int  # number of the article or main element around, 0 for none
    parent: int  # number of the element that groups it with others
    wrappers: tuple[int, ...] = ()  # numbers of the elements that make it a teaser if closed

    @cached_property
    def linked(self) -> bool:
        return self.links > LINKS * len(self.text)

    @cached_property
    def long(self) -> bool:
        size = len(self.text)
        if size < LONG and not self.text.isascii():
            size += len(_WIDE.findall(self.text))
        return size >= LONG and _WORD.search(self.text) is not None

    @cached_property
    def dense(self) -> bool:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) >= DENSE * len(words)

    def first_label(self, telling: bool) -> int:
        """The label that a block has by itself, OPEN if it is short or unclear.

        ``telling`` says whether density tells text from the rest on this page.
        """
        if self.boilerplate:
            return BAD
        if not self.content and self.text.startswith("©"):
            return BAD
        if self.linked:
            return OPEN if self.content else BAD
        if self.long and (self.dense or not telling and not self.content):
            return GOOD
        return OPEN


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    plain = [b for b in blocks if not b.boilerplate and not b.linked]
    long = [b for b in plain if b.long]
    dense = sum(len(b.text) for b in long if b.dense)
    first = [b.first_label(dense >= SHARE * sum(len(b.text) for b in long)) for b in blocks]
    if any(b.content and not b.boilerplate for b in blocks):
        inside = sum(len(b.text) for b in plain if b.content)
        outside = sum(
            len(b.text) for b, n in zip(blocks, first, strict=True) if n == GOOD and not b.content
        )
        if inside >= SHARE * (inside + outside):
            first = [n if b.content else BAD for b, n in zip(blocks, first, strict=True)]
    # Long blocks of a table or of code go with the text next to them, whatever menu or
    # footer is nearer; then the others.
    unclear = [
        i for i, b in enumerate(blocks) if first[i] == OPEN and not b.content and b.long
    ]
    if unclear:
        by_text = [OPEN if b.boilerplate else n for b, n in zip(blocks, first, strict=True)]
        around = _nearest(blocks, by_text, range(len(blocks))), _nearest(
            blocks, by_text, range(len(blocks) - 1, -1, -1)
        )
        for i in unclear:
            found = {by_text[side[i]] for side in around if side[i] is not None}
            first[i] = BAD if found == {BAD} else GOOD
    before = _nearest(blocks, first, range(len(blocks)))
    after = _nearest(blocks, first, range(len(blocks) - 1, -1, -1))
    out = []
    for i, (block, label) in enumerate(zip(blocks, first, strict=True)):
        if label == OPEN:
            label = _inherited(i, block, first, blocks, before[i], after[i])
        out.append(label == GOOD)
    return out


def _nearest(blocks: list[Block], labels: list[int], order: range) -> list[int | None]:
    """For each block the last decided one on the way; inside an article only its own."""
    last: dict[int, int] = {}
    out: list[int | None] = [None] * len(blocks)
    for i in order:
        where = blocks[i].content
        out[i] = last.get(where)
        if labels[i] != OPEN and not (where and blocks[i].boilerplate):
            last[where] = i
    return out


def _inherited(i, block, labels, blocks, before, after) -> int:
    around = [j for j in (before, after) if j is not None]
    if not around:
        return GOOD  # nothing speaks against it
    found = {labels[j] for j in around}
    if len(found) == 1:
        return found.pop()
    if i - before != after - i:
        return labels[before] if i - before < after - i else labels[after]
    return GOOD if any(
        labels[j] == GOOD and blocks[j].parent == block.parent for j in around
    ) else BAD


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # Open elements: (tag, silent, boilerplate, content, in link, number).
        self.open = [("", False, False, 0, False, 0)]
        self.parts: list[str] = []
        self.links = self.count = 0
        self.comments: set[int] = set()  # numbers of the elements that hold comments
        self.wrappers: set[int] = set()  # and of those that make an article a teaser
        self.closed: set[int] = set()  # elements with an end tag of their own

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            blocks = [e for e in self.open if e[0] in BLOCK_TAGS or not e[0]]
            _, _, boilerplate, content, _, _ = blocks[-1]
            group = next(e[5] for e in reversed(blocks) if e[0] not in TEXT_TAGS)
            around = tuple(e[5] for e in self.open if e[5] in self.wrappers)
            self.blocks.append(Block(text, self.links, boilerplate, content, group, around))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            self._close_implied(tag)
        if tag in VOID_TAGS:
            return
        self.count += 1
        _, silent, boilerplate, content, link, _ = self.open[-1]
        values = {k: (v or "").lower() for k, v in attrs}
        names = set(_NAME.findall(f"{values.get('class', '')} {values.get('id', '')}"))
        inner = content and not boilerplate
        named = (
            bool(names & BOILERPLATE_NAMES - ({"header", "legal", "notice"} if inner else set()))
            or values.get("role") in BOILERPLATE_ROLES
            or tag in BOILERPLATE_TAGS or tag == "header" and not content
        )
        named = named and tag not in ("html", "body")  # their names tell a layout, not a role
        hidden = "hidden" in values or "display:none" in values.get("style", "").replace(" ", "")
        if tag in CONTENT_TAGS:
            if not self._in_comments():
                boilerplate = False  # a wrapper that was never closed ends here
            content = self.count
        self.open.append((
            tag, silent or hidden or tag in SILENT_TAGS, boilerplate or named, content,
            link or tag == "a", self.count,
        ))
        if tag in WRAPPERS:
            self.wrappers.add(self.count)
        if named and tag not in BOILERPLATE_TAGS and names & {"comment", "comments", "respond"}:
            self.comments.add(self.count)

    def _in_comments(self) -> bool:
        return any(e[5] in self.comments for e in self.open)

    def _close_implied(self, tag: str) -> None:
        """Elements that end where ``tag`` begins."""
        ends = {"p"} | ({"li"} if tag == "li" else set())
        if tag in ("dd", "dt"):
            ends |= {"dd", "dt"}
        if tag in ("td", "th", "tr"):
            ends |= {"td", "th"} | ({"tr"} if tag == "tr" else set())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in ends:
                del self.open[i:]
            elif self.open[i][0] in BLOCK_TAGS:
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.closed.add(self.open[i][5])
                del self.open[i:]
                return
            if self.open[i][0] in CONTENT_TAGS and tag not in ("body", "html"):
                return  # a stray end tag does not end the article

    def handle_data(self, data):
        _, silent, _, _, link, _ = self.open[-1]
        if not silent:
            self.parts.append(data)
            if link:
                self.links += len(data.strip())


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, one per line."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html.replace("<![", "<! ["))  # marked sections are not HTML
    parser.close()
    parser.flush()
    blocks = [
        replace(b, boilerplate=True) if not parser.closed.isdisjoint(b.wrappers) else b
        for b in parser.blocks
    ]
    labels = classify(blocks)
    if not any(labels):  # the page has nothing but what stands in such elements
        labels = classify(parser.blocks)
    return "\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars.

    A null or empty page has the empty text. Nothing of the page is capped; repeated rows
    are extracted each. Other columns are ignored.
    """

    def make():
        def extracted(html):
            text = main_text(html)
            return text, len(text)

        return extracted

    return extend(
        pages.select("page_id", "url", "html"), "html", make, "text string, n_chars long"
    )
