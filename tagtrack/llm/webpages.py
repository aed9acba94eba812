"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing and clustering.

``html.parser`` streams a page as events. Block tags end lines; a line has its text, its
tags, the part of the text inside links, the sectioning element and the declared
furniture it lies in. What is never read as text (scripts, styles, controls) gives no lines.

Declared furniture weighs a line down, by how sure the declaration and by how much
text the element holds. Navigation, headers and footers of the page, asides, and
elements whose class, id or role plainly says advert, notice, menu, sidebar,
comments and so on are *sure*; forms, and names in which such a word is one among
others ("comments-open", "notice-of-meeting"), are *unsure*. A sure element that
holds 19 of 20 characters of the page, or an unsure one that holds half of what
the sure ones leave, is not furniture, unless an article or main element outside
has a tenth of its text. Lines in any other declared element weigh nothing.

The ratio of characters to tags per line is smoothed with a Gaussian over the
lines that weigh. Lines above a threshold (the mean less half a deviation of the smoothed
ratios, at least 1) form clusters. The content region is every outermost article
or main element that holds a clustered line; without one it runs from the first
to the last clustered line, with the headings right before it. All lines of the region are kept, so short paragraphs
and headings inside it stay; only without such an element, lines that are
mostly links go.

Defined results: NULL, empty and textless pages give empty text; markup may be
broken, cut or nested at will; text outside any tag is a block; nothing is capped.
Unknown marked sections are skipped up to their ``>``. From a tag, comment or quote
that never ends on, the page is read again without quotes, every tag ending at
its first ``>`` or at the next ``<``. Work is linear in the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: never read as text, with everything inside
UNREAD = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map button select textarea "
    "datalist dialog".split()
)
#: elements that are furniture by their tag; a form is an unsure one
SURE, UNSURE = frozenset("nav aside menu footer".split()), frozenset(["form"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: parts of class, id and role values that declare furniture; split at anything but letters and digits
DECLARED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar complementary footer masthead header comment comments disqus respond reply replies "
    "share sharing social related recommended widget toolbar pagination pager search login contentinfo".split()
)
#: after these the next part belongs to something else: "with-sidebar" is no sidebar
LOOSE = frozenset("with has no without".split())
#: before "header" these make it a part of the article
CONTENT = frozenset("article content entry main news post section story".split())
#: parts that leave a declaration as sure as it is
PLAIN = frozenset(
    "area bar block body bottom box btn column container content global group inline inner item items left link links list main module "
    "outer page panel post posts primary reader right secondary section site slot sticky text thread top unit user wrap wrapper zone".split()
)
#: open elements of these end where an article or main begins
LEFT_OPEN = frozenset("head nav header menu form".split())
#: start tags that end an open paragraph
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: end tags that reach beyond the furniture or article they stand in
FAR = frozenset("body html article main nav footer aside form".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = frozenset("ul ol dl menu select".split())
SPACE, PARTS, TAG = re.compile(r"\s+"), re.compile(r"[^a-z0-9]+"), re.compile(r"<([!?/]?)([^<>]*)(>?)")
SURE_SHARE, UNSURE_SHARE, RIVAL = 0.95, 0.5, 0.1


def declared(value: str, in_region: bool) -> int:
    """What a class, id or role value says: 0 nothing, 1 furniture perhaps, 2 furniture."""
    sure, content = 0, False
    for name in value.lower().split():
        parts = [p for p in PARTS.split(name) if p]
        said, before = [], ""
        for part in parts:
            own = part == "header" and (in_region or before in CONTENT)
            if part in DECLARED and before not in LOOSE and not own:
                said.append(part)
            before = part
        if said:
            sure = max(sure, 2 if all(p in DECLARED or p in PLAIN or p.isdigit() for p in parts) else 1)
        content |= any(p in CONTENT for p in parts) and not said
    return min(sure, 1) if content else sure


class Lines(HTMLParser):
    """Collects (text, tags, link characters, region, owner, heading) per line.

    ``region`` numbers the outermost open article or main, ``owner`` the innermost open declared
    furniture in ``furniture`` (outer owner, sureness); -1 for none. Open elements are found by
    their tag's places in the stack, so no event walks over it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.furniture: list[tuple[int, int]] = []
        self.stack: list[str] = []
        self.at: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of blocks but p
        self.walls: list[int] = []  # places of furniture, articles and mains
        self.owned: list[tuple[int, int]] = []  # place and number of open furniture
        self.regions: list[int] = []
        self.n_regions = 0
        self.unread = 0
        self.parts: dict[int, list[str]] = {}  # text of the open line by owner
        self.links: dict[int, int] = {}
        self.tags = 0

    def flush(self) -> None:
        """End the line; what inline furniture says inside it is a line of its own."""
        region = self.regions[0] if self.regions else -1
        for owner, parts in self.parts.items():
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                heading = any(self.at.get(h) for h in HEADINGS)
                self.lines.append((text, self.tags, self.links.get(owner, 0), region, owner, heading))
                self.tags = 0
        self.parts, self.links = {}, {}

    def say(self, data: str) -> int:
        owner = self.owned[-1][1] if self.owned else -1
        self.parts.setdefault(owner, []).append(data)
        return owner

    def sureness(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in SURE or (tag == "header" and not self.regions):
            return 2
        sure = 1 if tag in UNSURE else 0
        if tag in ("html", "body", "main"):
            return sure
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                sure = max(sure, declared(value, bool(self.regions)))
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 2
        return sure

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and self.last("p") > (self.blocks[-1] if self.blocks else -1):
                self.pop_to(self.last("p"))
        if tag == "br":
            self.say(" ")
        if tag in VOID:
            return
        if (tag in BLOCKS or tag == "body") and self.stack and self.stack[-1] == "head":
            self.pop_to(len(self.stack) - 1)
        if tag in ("article", "main"):
            left = max(self.owned[-1][0] if self.owned else -1, self.last("head"))
            if left >= 0 and self.stack[left] in LEFT_OPEN:
                self.pop_to(left)
        if tag in ("li", "option", "dt", "dd") and self.last(tag) > max(self.last(x) for x in LISTS):
            self.pop_to(self.last(tag))
        place, sure = len(self.stack), self.sureness(tag, attrs)
        region = tag in ("article", "main")
        if sure:
            self.furniture.append((self.owned[-1][1] if self.owned else -1, sure))
            self.owned.append((place, len(self.furniture) - 1))
        if sure or region or tag in UNREAD:
            self.walls.append(place)
        if region:
            self.regions.append(self.n_regions)
            self.n_regions += 1
        if tag in BLOCKS and tag != "p":
            self.blocks.append(place)
        self.stack.append(tag)
        self.at.setdefault(tag, []).append(place)
        self.unread += tag in UNREAD

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.say(" ")

    def pop_to(self, i: int) -> None:
        for tag in self.stack[i:]:
            self.at[tag].pop()
            self.unread -= tag in UNREAD
            if tag in ("article", "main"):
                self.regions.pop()
        del self.stack[i:]
        for places in (self.blocks, self.walls):
            while places and places[-1] >= i:
                places.pop()
        while self.owned and self.owned[-1][0] >= i:
            self.owned.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        i = self.last(tag)
        # an end tag inside furniture or an article closes nothing outside it, unless the page's own
        if i >= 0 and (tag in FAR or not self.walls or self.walls[-1] <= i):
            self.pop_to(i)

    def handle_data(self, data: str) -> None:
        if not self.unread:
            owner = self.say(data)
            if self.at.get("a"):
                self.links[owner] = self.links.get(owner, 0) + len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![CDATA[`` up to ``]]>``, anything else up to its ``>``."""
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        j = self.rawdata.find(end, i)
        return -1 if j < 0 else j + len(end)


def _mended(m: re.Match) -> str:
    mark, inside = m[1], m[2]
    if mark and mark in "!?":
        return ""
    if inside[:1].isalpha() and inside[0].isascii():
        return f"<{mark}" + inside.replace('"', " ").replace("'", " ") + ">"
    return "&lt;" + m[0][1:]


def read_lines(html: str) -> Lines:
    """The events of a whole page. What follows a construct that never ends is mended once and read on."""
    parser = Lines()
    parser.feed(html)
    rest, parser.rawdata = parser.rawdata, ""
    if rest and not parser.cdata_elem:
        parser.feed(TAG.sub(_mended, rest))
        parser.close()
    parser.flush()
    return parser


def weights(parser: Lines) -> list[int]:
    """1 for every line that no furniture holds, else 0."""
    lines, furniture = parser.lines, parser.furniture
    all_text, open_text = [0] * len(furniture), [0] * len(furniture)
    under_sure = [False] * len(furniture)
    for e, (outer, sure) in enumerate(furniture):
        under_sure[e] = sure == 2 or (outer >= 0 and under_sure[outer])
    total = left = rival = 0
    for text, _, _, region, owner, _ in lines:
        total += len(text)
        if owner < 0:
            rival += len(text) if region >= 0 else 0
        else:
            all_text[owner] += len(text)
        if owner < 0 or not under_sure[owner]:
            left += len(text)
            if owner >= 0:
                open_text[owner] += len(text)
    for e in range(len(furniture) - 1, -1, -1):  # inner elements have higher numbers
        outer = furniture[e][0]
        if outer >= 0:
            all_text[outer] += all_text[e]
            open_text[outer] += open_text[e]
    free = [False] * len(furniture)
    for e, (outer, sure) in enumerate(furniture):
        if sure == 2:
            enough = all_text[e] >= SURE_SHARE * total
        elif under_sure[e]:  # the sure element round it was freed, or it does not matter
            enough = all_text[e] >= UNSURE_SHARE * total
        else:
            enough = open_text[e] >= UNSURE_SHARE * left
        free[e] = enough and rival < RIVAL * all_text[e] and (outer < 0 or free[outer])
    return [int(owner < 0 or free[owner]) for *_, owner, _ in lines]


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over 3 sigma; the kernel is cut and rescaled at the ends."""
    r = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        w = [kernel[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(x * y for x, y in zip(w, values[lo:hi])) / sum(w))
    return out


def main_text(html: str | None) -> str:
    """The blocks of the content region, joined by empty lines."""
    if not html:
        return ""
    parser = read_lines(html)
    lines = [line for line, weight in zip(parser.lines, weights(parser)) if weight]
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(tags, 1) for text, tags, *_ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    dense = [i for i, x in enumerate(ratios) if x >= max(1.0, mean - spread / 2 - 1e-9)] or list(range(len(lines)))
    regions = {lines[i][3] for i in dense} - {-1}
    if regions:
        kept = [line[0] for line in lines if line[3] in regions]
    else:
        first = dense[0]
        while first > 0 and lines[first - 1][5]:
            first -= 1
        kept = [text for text, _, links, *_ in lines[first : dense[-1] + 1] if 2 * links <= len(text)]
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("_html")
        text = pa.array([main_text(h) for h in batch.column(at).to_pylist()], pa.string())
        names = [n for n in batch.schema.names if n != "_html"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [text], [*names, "_text"])


def extracted(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``html`` replaced by ``out``, the main text."""
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), out.lower())]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(html).alias("_html"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "_text string"])
    done = rows.mapInArrow(_extract, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("_text").alias(out))
