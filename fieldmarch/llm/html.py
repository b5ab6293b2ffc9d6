"""Main text of web pages by two passes over blocks: density rules first, then short blocks take their neighbours' label."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Frequent words of six languages.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for was on with as by at be this are from not it or an he his which you
    der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er hat aus bei
    le la les de des et un une du en est que qui dans pour sur au par pas ce il elle
    el los las y que se del por con su para al lo como
    di che per non il da sono si gli
    do da em um para os no se na uma dos
    """.split()
)
#: Elements that never hold running text of the article, elements whose content is no markup, elements that end a block.
BOILERPLATE = frozenset("nav footer aside form button select textarea option label fieldset dialog menu iframe object svg canvas audio video map noscript template".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noscript ol optgroup option p
    pre script section select style summary table tbody td textarea tfoot th thead title tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promos?|sidebars?|nav\w*|menus?|breadcrumbs?|footers?|cookies?|consent|notices?|alerts?|"
    r"popups?|modal|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|"
    r"pagination|pager|toolbar|masthead|topbar|skip|widget\w*|tags|copyright|legal)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names that say what a wrapper has or lacks, not what it is.
_MODIFIER = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|sticky)[_-]\S*", re.IGNORECASE)
#: A tag: quoted values may hold its end. No part of it is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

#: Elements that hold parts of a page; inside the article the name of any other element does not reject it.
CONTAINERS = frozenset("div section ul ol dl table aside".split())
#: So many blocks of links one after the other are a list of links, inside the article too.
LINK_LIST = 3
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.20
LINKS = 0.33


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: bool
    unwanted: bool
    section: int
    label: str = ""


def _unwanted(name: str, attributes: str, inside: bool) -> str:
    """Whether the element says of itself that it is no part of the article: "sure", or "named" if only its class or id does."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return "sure"
    said = ""
    for key, value in _ATTRIBUTE.findall(attributes):
        value, key = value.strip("\"'").lower(), key.lower()
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and (not inside or name in CONTAINERS) and _NAMED.search(_MODIFIER.sub("", value)):
            said = "named"
        if (key == "role" and value in _ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "sure"
    return said


class _Named:
    """Elements that only their class or id calls unwanted, and which of them hold the article all the same."""

    def __init__(self) -> None:
        self.outer: list[int] = []
        self.inside: list[bool] = []
        self.anchors: list[tuple[str, int]] = []

    def open(self, outer: int, inside: bool) -> int:
        self.outer.append(outer)
        self.inside.append(inside)
        return len(self.outer) - 1

    def rejected(self, sizes: list[tuple[int, int]]) -> list[bool]:
        """Which elements stay unwanted, from (innermost element or -1, length) of the blocks that nothing else rejects.

        An element is the article's if it encloses a ``main``, or else ``article``, or else ``h1``, and none of that kind stands free of
        such elements; or if it encloses most of the text and lies inside one, or no ``main`` or ``article`` stands free. Cards and comments that are
        articles of their own beside the free one do not count.
        """
        size, holds = [0] * len(self.outer), [False] * len(self.outer)
        for at, n in sizes:
            if at >= 0:
                size[at] += n
        best = next((k for k in ("main", "article", "h1") if any(kind == k for kind, _ in self.anchors)), "")
        free = {kind for kind, at in self.anchors if at < 0}
        for kind, at in self.anchors:
            if at >= 0 and kind == best and best not in free:
                holds[at] = True
        for i in range(len(self.outer) - 1, -1, -1):
            if self.outer[i] >= 0:
                size[self.outer[i]] += size[i]
                holds[self.outer[i]] |= holds[i]
        total, bad = sum(n for _, n in sizes), []
        for i, outer in enumerate(self.outer):
            most = 2 * size[i] > total and (self.inside[i] or not free & {"main", "article"})
            bad.append(not (holds[i] or most) or (outer >= 0 and bad[outer]))
        return bad


def _pieces(page: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """Text before each tag, the tag's name (empty at the end), whether it closes, its attributes, and where the page goes on.

    Goes forward only. Comments, declarations and unfinished CDATA are left out, CDATA is text. A ``<`` before no letter is text; so is
    the rest of a page that has no tag's end any more, but for a tag in which it breaks off. Where quotes hide every end of a tag, quotes are no longer heeded. The receiver may
    send a later place to go on from.
    """
    text: list[str] = []
    at = start = 0
    loose = whole = False
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            text.append(page[start:lt])
            end = page.find("-->", lt + 4)
            at = start = len(page) if end < 0 else end + 3
        elif not whole and page.startswith("<![CDATA[", lt):
            text.append(page[start:lt])
            end = page.find("]]>", lt + 9)
            whole = end < 0
            if not whole:
                text.append(page[lt + 9 : end])
                at = start = end + 3
            else:
                at = start = lt
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            text.append(page[start:lt])
            end = page.find(">", lt)
            at = start = len(page) if end < 0 else end + 1
        elif page[lt + 1 : lt + 2].isalpha() and page[lt + 1].isascii() or page[lt + 1 : lt + 2] == "/" and page[lt + 2 : lt + 3].isalpha() and page[lt + 2].isascii():
            m = None if loose else _TAG.match(page, lt)
            if m is None:
                loose, m = True, _LOOSE.match(page, lt)
                if m is None:
                    if page.find("<", lt + 1) < 0:  # the page breaks off inside a tag
                        page = page[:lt]
                    break
            text.append(page[start:lt])
            further = yield "".join(text), m[2].lower(), bool(m[1]), m[3], m.end()
            text, at = [], max(m.end(), further or 0)
            start = at
        else:
            at = lt + 1
    text.append(page[start:])
    yield "".join(text), "", False, "", len(page)


def blocks(page: str) -> list[Block]:
    """Runs of text between block elements, with the length of their links and what encloses them."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    heading = False
    inside = section = 0
    skip: list[tuple[str, str, int]] = []  # open elements from the outermost unwanted one inwards: name, why unwanted, innermost named one
    opened: dict[str, int] = {}  # how many of each name are in it
    sure = 0
    named, within = _Named(), []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(html.unescape("".join(linked)).split())), heading, inside > 0, sure > 0, section))
            within.append(skip[-1][2] if skip else -1)
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    pieces = _pieces(page)
    further = None
    while True:
        try:
            text, name, closing, attributes, at = pieces.send(further)
        except StopIteration:
            break
        further = None
        if text:
            say(text)
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            say(" ")
        if name in RAW and not closing:
            # text up to the element's own end tag is no markup and no content
            end = _ENDS[name].search(page, at)
            further = end.end() if end else len(page)
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif re.fullmatch("h[1-6]", name):
            heading = not closing
        if name in ("article", "main"):
            inside = max(0, inside - 1) if closing else inside + 1
            section += 1
        if closing:
            if opened.get(name):
                while True:
                    gone = skip.pop()
                    opened[gone[0]] -= 1
                    sure -= gone[1] == "sure"
                    if gone[0] == name:
                        break
        elif name not in VOID and not (skip and attributes.endswith("/")):
            # an unwanted paragraph ends where the next block begins
            if skip and skip[-1][0] == "p" and name in BLOCKS:
                opened["p"] -= 1
                sure -= skip.pop()[1] == "sure"
            why = "" if sure else _unwanted(name, attributes, inside > 0)
            if skip or why:
                outer = skip[-1][2] if skip else -1
                skip.append((name, why, named.open(outer, inside > 0) if why == "named" else outer))
                opened[name] = opened.get(name, 0) + 1
                sure += why == "sure"
        if not closing and not sure and name in ("main", "article", "h1"):
            named.anchors.append((name, skip[-1][2] if skip else -1))
    flush()
    bad = named.rejected([(i, len(b.text)) for i, b in zip(within, out, strict=True) if not b.unwanted])
    for i, b in zip(within, out, strict=True):
        b.unwanted = b.unwanted or (i >= 0 and bad[i])
    return out


def classify(found: list[Block]) -> None:
    """First pass: good, bad or unsure by links, length and stop words. Second pass: unsure blocks follow the nearest decided ones.

    Inside the article's own element what is unsure is good, and links are bad only in a list of them. Where nothing on a page is good,
    short texts with a letter or digit and no links are all there is, and good.
    """
    row = 0
    for i, b in enumerate(found):
        words = b.text.lower().split()
        density = sum(w.strip(".,;:!?()\"'«»") in STOP_WORDS for w in words) / len(words)
        size = len(b.text)
        links = not b.unwanted and b.linked > LINKS * size
        row = row + 1 if links else 0
        if b.unwanted:
            b.label = "bad"
        elif links:
            b.label = "unsure" if b.inside else "bad"
            if b.inside and row >= LINK_LIST:
                for other in found[i + 1 - row if row == LINK_LIST else i : i + 1]:
                    other.label = "bad"
        elif b.heading or size < SHORT:
            b.label = "bad" if b.linked and not b.inside else "unsure"
        elif density >= STOP_HIGH:
            b.label = "good" if size >= LONG or b.inside else "unsure"
        elif density >= STOP_LOW or b.inside or not b.linked:
            b.label = "unsure"
        else:
            b.label = "bad"
    if all(b.label != "good" for b in found):
        # stop words tell nothing of a page in a language without them
        for b in found:
            if b.label == "unsure" and not b.heading and not b.linked and len(b.text) >= LONG:
                b.label = "good"
    before, after = _decided(found), [None if j is None else len(found) - 1 - j for j in reversed(_decided(found[::-1]))]
    first = [b.label for b in found]
    any_good = "good" in first or any(b.inside and b.label == "unsure" for b in found)
    for i, b in enumerate(found):
        if b.label != "unsure":
            continue
        near = [(abs(j - i), first[j] != "good", first[j]) for j in (before[i], after[i]) if j is not None]
        if b.inside:
            b.label = "good"
        elif not any_good:
            b.label = "good" if not b.linked and any(ch.isalnum() for ch in b.text) else "bad"
        # a heading belongs to what follows it
        elif b.heading and after[i] is not None:
            b.label = first[after[i]]
        else:
            b.label = min(near)[2] if near else "bad"


def _decided(found: list[Block]) -> list[int | None]:
    """For each block the nearest earlier one of its section that the first pass decided by its text."""
    out: list[int | None] = []
    last: int | None = None
    for i, b in enumerate(found):
        if last is not None and found[last].section != b.section:
            last = None
        out.append(last)
        if b.label != "unsure" and not b.unwanted:
            last = i
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: good blocks of each page in order, two line feeds between; empty if there are none.

    Null and empty html give empty texts, an empty table gives no rows. A very long page takes time in proportion to its length. Character references are decoded, white space inside a block is one space. Null ids and urls
    are carried through, repeated rows give repeated rows, other columns are not read. Each page is judged alone and read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x or "") for x in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
