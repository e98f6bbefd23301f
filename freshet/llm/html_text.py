"""Main text of web pages by two passes over their blocks.

The page is cut into blocks at block-level tags. A block's context-free class comes
from its length, its share of link text and its density of stop words: long running
text is good, text that is mostly links or has no stop words is bad, and what is too
short or in between stays open. In the second pass an open block takes the class that
its nearest decided neighbours share; where they differ, a block near running text
counts as good only if it lies between the first and the last good block of its
container, and headings go with the text below them.

Blocks inside elements that name their role (navigation, header, footer, aside, form,
and classes or ids of adverts, notices, sidebars, menus and comments) are bad whatever
their words are. A class or id names a role as a whole: all its words are roles or say
where or what kind of box it is. An article or main element inside elements that only
a class or id names is not held to be of their role, unless it names one itself or they
lie in another article or main. A head ends where a tag or text begins that cannot stand
in it. Blocks inside an article or main element that are not take the open
class at worst, and scripts, styles and comments of the markup hold no text at all.

Defined cases: null or empty html gives empty text, and so does a page without good
blocks; character references are decoded; white space inside a block becomes one
space; blocks are joined by a line feed in page order; repeated rows are answered each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.llm.common import only, records, ship

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page.
SILENT_TAGS = frozenset("head script style noscript template svg math iframe object canvas audio video button select textarea".split())
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are not the article.
OUTER_TAGS = frozenset("nav header footer aside form menu dialog".split())
INNER_TAGS = frozenset("article main".split())
#: Words in a class or id that name the role of an element that is not the article.
OUTER_ROLES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo "
    "promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that go with a role in one class or id and leave it that role.
ROLE_BOXES = frozenset(
    "area bar block bottom box col column container global inner item left links list main outer page panel posts primary right "
    "secondary section site slot top unit wrap wrapper".split()
)
#: Elements that do not end a head.
HEAD_TAGS = frozenset("head html title base link meta style script noscript template".split())
OUTER_ARIA = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: An open element of these is closed by the next of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
        "als am auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und von vor war wie wird zu zum zur "
        "al como con del desde donde el ella entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por se sin sobre son su sus también una uno y ya"
    ).split()
)


@dataclass(frozen=True)
class Limits:
    """The first pass's thresholds."""

    short: int = 70
    long: int = 200
    links: float = 0.2
    stop_low: float = 0.08
    stop_high: float = 0.16


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    outer: bool
    inner: bool
    kind: str = ""


WHITE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")
ROLE_WORDS = re.compile(r"[a-z]+")


def names_role(name: str) -> bool:
    words = ROLE_WORDS.findall(name)
    return not OUTER_ROLES.isdisjoint(words) and all(w in OUTER_ROLES or w in ROLE_BOXES for w in words)


class Blocks(HTMLParser):
    """Cuts a page into blocks with what the rules need to know of each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: tag, whether its kind or role is outer, whether its name is, whether it is inner, and how many names it sets aside
        self.open: list[tuple[str, bool, bool, bool, int]] = []
        #: where in ``open`` each tag's elements are, and those of all block tags
        self.places: dict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.words: list[str] = []
        self.linked = self.silent = self.outer = self.named = self.inner = self.links = 0
        self.heading = False

    def end_block(self) -> None:
        text = WHITE.sub(" ", "".join(self.words)).strip()
        if text:
            self.blocks.append(Block(text, self.linked, self.heading, self.outer + self.named > 0, self.inner > 0))
        self.words, self.linked = [], 0

    def end_head(self, tag: str = "") -> None:
        """End an open head before a body, or before text or a tag that cannot stand in it."""
        if tag == "body":
            self.handle_endtag("head")
        elif self.open and self.open[-1][0] == "head" and tag not in HEAD_TAGS:
            self.close_from(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_head(tag)
        if tag in CLOSES:
            self.close_within(CLOSES[tag])
        if tag == "br":
            self.words.append(" ")
        if tag in BLOCK_TAGS:
            self.end_block()
            self.heading = bool(re.fullmatch("h[1-6]", tag))
        if tag in VOID_TAGS:
            return
        named = any(names_role(name) for k, v in attrs if k in ("class", "id") for name in (v or "").lower().split())
        outer = tag in OUTER_TAGS or any(k == "role" and (v or "").lower() in OUTER_ARIA for k, v in attrs)
        inner = tag in INNER_TAGS
        aside = 0 if named or not inner or self.inner else self.named
        if inner or tag in ("body", "html"):
            outer = named = False
        # an article's own header holds its headings
        if tag == "header" and self.inner and not self.outer + self.named:
            outer = named = False
        self.places[tag].append(len(self.open))
        if tag in BLOCK_TAGS:
            self.block_places.append(len(self.open))
        self.open.append((tag, outer, named, inner, aside))
        self.outer += outer
        self.named += named - aside
        self.inner += inner
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def close_within(self, tags: set[str]) -> None:
        """End an element of these tags that is open inside the innermost other block."""
        at = max((self.places[tag][-1] for tag in tags if self.places[tag]), default=-1)
        if at >= max(0, self.block_places[-1] if self.block_places else 0):
            self.close_from(at)

    def close_from(self, at: int) -> None:
        self.end_if_block(self.open[at:])
        for tag, outer, named, inner, aside in self.open[at:]:
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.block_places.pop()
            self.outer -= outer
            self.named -= named - aside
            self.inner -= inner
            self.silent -= tag in SILENT_TAGS
            self.links -= tag == "a"
        del self.open[at:]

    def end_if_block(self, closing: list) -> None:
        if any(tag in BLOCK_TAGS for tag, *_ in closing):
            self.end_block()
            self.heading = False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        if self.places[tag]:
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.silent:
            self.words.append(data)
            self.linked += self.links and len(data.strip())

    def finish(self) -> list[Block]:
        self.close()
        self.end_block()
        return self.blocks


def classify(block: Block, limits: Limits) -> str:
    """First pass: good, bad, or open (near: open but close to good)."""
    if block.outer:
        return "bad"
    size = len(block.text)
    if block.linked > limits.links * size and not block.heading:
        return "bad"
    words = WORDS.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if size < limits.short or block.heading:
        return "open"
    if density >= limits.stop_high:
        return "good" if size > limits.long else "near"
    if density >= limits.stop_low:
        return "near"
    return "open" if block.inner else "bad"


def revise(kinds: list[str], blocks: list[Block]) -> list[bool]:
    """Second pass: which blocks are text. A near block is decided unless both neighbours are bad;
    an open one takes what its nearest decided neighbours share, and stays out if they differ and
    it is outside the article."""

    def decided(kinds: Iterable[str]) -> list[str]:
        """For each block the decision nearest before it, in the order given."""
        last, found = "bad", []
        for kind in kinds:
            found.append(last)
            if kind in ("good", "bad"):
                last = kind
        return found

    sides = zip(decided(kinds), reversed(decided(reversed(kinds))), strict=True)
    out = []
    for kind, block, (before, after) in zip(kinds, blocks, sides, strict=True):
        if kind in ("good", "bad"):
            out.append(kind == "good")
        elif block.inner:
            out.append(True)
        elif kind == "near" or block.heading:
            out.append("good" in ((after,) if block.heading else (before, after)))
        else:
            out.append(before == after == "good")
    return out


def main_text(html: str | None, limits: Limits = Limits()) -> str:
    parser = Blocks()
    parser.feed(html or "")
    blocks = parser.finish()
    chosen = revise([classify(b, limits) for b in blocks], blocks)
    return "\n".join(b.text for b, good in zip(blocks, chosen, strict=True) if good)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text", "n_chars"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for page_id, url, html in records(batches, "page_id", "url", "html", step=16):
        text = main_text(html)
        held.append((page_id, url, text, len(text)))
        size += len(text)
        if len(held) >= 1024 or size > 1 << 22:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars, its code points."""
    ship(pages.sparkSession)
    return only(pages, "page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
