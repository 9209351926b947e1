"""Main text of web pages by two passes of block rules.

The first pass decides blocks by link density, length and stop-word density, so that menus and lists of links
go wherever they stand; short and doubtful blocks inherit in the second pass from the nearest blocks that are
decided, within an article or outside one. Elements and class names are asked only for what densities can't
see: prose that is no article, such as adverts, notices, forms, footers and readers' comments.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Frequent words of the languages that pages are written in.
STOP_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so what up said about",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber",
    "fr": "le de un et à il que ne je son pour qui dans ce des les la en du une au est pas sur se plus par avec tout mais nous ou leur si elle on sont cette aux ont été ces",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde",
}
#: Elements whose text, though it may read like prose, is no article's; elements that hold one; elements that end a block.
OUTSIDE = set("header footer aside form button select textarea noscript template iframe object svg canvas dialog head title".split())
INSIDE = {"article", "main"}
RAW = ("script", "style")
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select textarea button noscript template iframe object svg canvas".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Parts of class names, ids and roles of what surrounds an article and may read like prose.
AROUND = set(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social sidebar footer masthead header comment comments "
    "reply replies respond disqus related recommended recommendations widget search contentinfo complementary".split()
)
#: Words of class names with which `header` means an article's own head.
OWN_HEAD = set("article post entry story content section page".split())
#: Elements that end where the next of their group starts.
SIBLINGS = [set(group.split()) for group in ("li", "dt dd", "tr", "td th", "option", "thead tbody tfoot")]
#: First pass: share of linked characters above which a block is bad, characters below which it is short, from which it is long, share of stop words that makes a block good.
LINKED, SHORT, LONG, STOPS = 0.4, 60, 200, 0.15
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z|(?=<))|([^<]+|<)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
WORDS = frozenset(w for text in STOP_WORDS.values() for w in text.split())


class Block:
    __slots__ = ("chars", "inside", "linked", "outside", "text", "words")

    def __init__(self, text: str, linked: int, inside: bool, outside: bool):
        self.text, self.chars, self.linked, self.inside, self.outside = text, len(text), linked, inside, outside
        self.words = text.split(" ")


def _surrounds(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds what surrounds an article."""
    if name in OUTSIDE and not (name == "header" and inside):
        return True
    if not attributes or name in INSIDE | {"body", "html"}:
        return False
    parts = {p for m in NAMED.finditer(attributes) for p in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    around = parts & AROUND
    if inside or parts & OWN_HEAD:
        around = around - {"header"}
    return bool(around) or bool(HIDDEN.search(attributes))


class Frame:
    """An open element that ends blocks, with the inline elements open in it."""

    __slots__ = ("count", "inline", "inside", "link", "name", "outside")

    def __init__(self, name: str, outside: bool, inside: bool):
        self.name, self.outside, self.inside = name, outside, inside
        self.inline: list[tuple[str, bool]] = []  # name, whether its text is left out
        self.count: Counter[str] = Counter()

    def hides(self) -> bool:
        return bool(self.inline) and self.inline[-1][1]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order, with character references decoded and white space collapsed.

    Time is in proportion to the page, however deep or badly nested its elements are: an end tag looks for
    its element only if one is open.
    """
    out: list[Block] = []
    frames, opened = [Frame("", False, False)], Counter()
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            out.append(Block(text, linked, frames[-1].inside, frames[-1].outside))
        parts.clear()
        linked = 0

    def leave(name: str) -> None:
        while True:
            closed = frames.pop()
            opened[closed.name] -= 1
            if closed.name == name:
                return

    while at < end and (m := TOKEN.match(page, at)):
        at, top = m.end(), frames[-1]
        if m[5] is not None:
            if not top.hides() and not (m[5] == "<" and at == end):  # a page may be cut inside a tag
                parts.append(m[5])
                linked += len(m[5].strip()) if top.count["a"] else 0
            continue
        if m[2] is None:
            continue
        name, closes = m[2].lower(), bool(m[1])
        if name in RAW and not closes:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if closes:
                if opened[name]:
                    leave(name)
                continue
            if top.name == "p":
                leave("p")
            group = next((g for g in SIBLINGS if name in g and frames[-1].name in g), None)
            if group:
                leave(frames[-1].name)
            if name not in VOID and not m[3].endswith("/"):
                was = frames[-1]
                around = _surrounds(name, m[3], was.inside)
                frames.append(Frame(name, was.outside or was.hides() or around, (was.inside or name in INSIDE) and not around))
                opened[name] += 1
        elif name not in VOID and (closes or not m[3].endswith("/")):
            # an end tag ends inline elements of its own block only; a new link ends an open one
            if (closes or name == "a") and top.count[name]:
                while True:
                    ended = top.inline.pop()[0]
                    top.count[ended] -= 1
                    if ended == name:
                        break
            if not closes and (name != "a" or "href" in m[3].lower()):
                top.inline.append((name, top.hides() or _surrounds(name, m[3], top.inside)))
                top.count[name] += 1
    flush()
    return out


def first_pass(block: Block) -> str:
    """good or bad by densities; near or short if they don't decide."""
    links = block.linked / block.chars
    stops = sum(w.strip(".,;:!?").lower() in WORDS for w in block.words) / len(block.words)
    if links > LINKED:
        return "bad"
    if block.chars < SHORT:
        return "short"
    if stops >= STOPS or (block.inside and block.chars >= LONG):
        return "good"
    return "near" if block.inside or stops >= STOPS / 2 or block.chars >= LONG else "bad"


def second_pass(first: list[str], inside: bool) -> list[str]:
    """Undecided blocks with the class of the nearest decided one.

    Where both sides are as near and differ, a block of an article or of some length is good, a short one goes
    with what follows, as headings do. Where none is decided, all are good.
    """
    nearest: list[list[tuple[int, str]]] = [[], []]
    for found, order in zip(nearest, (first, first[::-1]), strict=True):
        last = (0, "")
        for kind in order:
            last = (0, kind) if kind in ("good", "bad") else (last[0] + 1, last[1])
            found.append(last)
    out = []
    for kind, a, b in zip(first, nearest[0], nearest[1][::-1], strict=True):
        if kind in ("near", "short"):
            (near, one), (far, other) = sorted((a, b), key=lambda x: (not x[1], x[0]))
            if not one:
                kind = "good"
            elif near == far and other and one != other:
                kind = "good" if inside or kind == "near" else b[1]
            else:
                kind = one
        out.append(kind)
    return out


def decided(blocks: list[Block]) -> tuple[list[str], list[str]]:
    """The kinds of blocks after the first pass and after the second.

    What elements or class names exclude is bad and nobody's neighbour. Blocks of an article inherit from
    that article's, others from others. Beside an article, what has no decided neighbour is bad; on a page
    without one, undecided blocks are good if no block is.
    """
    first = ["bad" if b.outside else first_pass(b) for b in blocks]
    kinds = list(first)
    article = any(b.inside and not b.outside for b in blocks)
    for inside in (True, False):
        here = [k for k, b in enumerate(blocks) if b.inside == inside and not b.outside]
        found = {first[k] for k in here}
        if article and not inside and not found & {"good", "bad"}:
            second = ["bad"] * len(here)
        elif not article and "good" not in found:
            second = ["bad" if first[k] == "bad" else "good" for k in here]
        else:
            second = second_pass([first[k] for k in here], inside)
        for k, kind in zip(here, second, strict=True):
            kinds[k] = kind
    return first, kinds


def main_blocks(page: str) -> list[str]:
    """The good blocks; beside an article that has some, prose that no element marks is not its text."""
    blocks = blocks_of(page)
    good = [b for b, kind in zip(blocks, decided(blocks)[1], strict=True) if kind == "good"]
    own = [b for b in good if b.inside]
    return [b.text for b in own or good]


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(page or ""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html, and a page without article text, gives an empty text. Whole pages are read,
    also such as end inside an element, a tag or a script. Repeated rows are extracted each; other columns
    are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                texts = [main_text(page) for page in batch.column(2).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    columns = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
