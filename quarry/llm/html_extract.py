"""Main text of web pages: two passes of block rules.

A page is cut to blocks of text at block-level tags. Pass 1 decides blocks: text in
boilerplate containers (by tag, role or class), scripts and the like is out; of the
rest, length, link density and stop-word density decide, and leave short or middling
blocks open. Pass 2 gives an open block the label of the nearest decided one (equally
near ones must agree, else it is out; a heading goes with what follows it). An article or main element that holds half of the
unlinked text or more is a prior: there only link density puts a block out.

A class or id is boilerplate if it is a listed name, alone or with words of place or
form. It puts nothing out that holds the page's largest article, or most of its text where
no article or main element with text stands beside it.

Defined cases: a null or empty page has an empty text; unclosed, crossed and unknown
tags are tolerated; repeated rows give a row each; other columns are not read.

Scale: a map over pages, whole pages, no state.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(\bhidden\b)")
#: fixed values: element names
RAW = frozenset("script style noscript template textarea iframe svg math object xmp noembed noframes canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head nav footer aside form select button dialog menu datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that need no end tag, so they are not kept open
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot body html h1 h2 h3 h4 h5 h6 caption option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: fixed values: words of class and id names that mark boilerplate
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus related recommended widget search toolbar pagination pager copyright legal disclaimer form".split())
#: fixed values: words of place or form that may stand with these names
FORMS = frozenset("site page main primary secondary top bottom left right header inner outer wrapper wrap container area box list section bar block content".split())
#: fixed values: frequent words of the languages met
STOP_WORDS = frozenset(
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were all we there been one do if will so no what can out up about who them would when "
    "le la les de des du un une et à en que qui dans pour sur pas au avec par est il elle ce se ne plus ou son sa ses mais nous vous sont été "
    "der die das und in zu den nicht von mit ist des dem ein eine für auf im sich auch als an es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "el los las y que del se por con una su para es al lo como más pero sus o este sí porque esta entre cuando muy sin sobre".split()
)
MAX_LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.30, 0.32
GOOD, BAD, OPEN = 1, 0, None


class _Page:
    def __init__(self):
        self.blocks: list[tuple[str, int, bool, int, int]] = []  # text, characters of links, out, innermost article or main, innermost element out by name
        self.heads: list[bool] = []  # whether a block is a heading
        self.above: dict[int, int] = {}  # of an element out by name, the one around it
        self.names: dict[str, int] = {}  # how many elements of a name are open
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, int, int]] = []
        self.out, self.level, self.in_link, self.count = 0, 0, 0, 0
        self.heading = False
        self.named = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.linked, self.out > 0, self.level, self.named))
                self.heads.append(self.heading)
            self.parts = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.in_link:
                self.linked += len("".join(raw.split()))

    def start(self, name: str, attributes: str) -> None:
        out = name in OUT or (name == "header" and not self.level)
        named = False
        if not out and attributes:
            out, named = _boilerplate(attributes, name)
        if name in BLOCK:
            self.flush()
            self.heading = name in HEADINGS
        elif name == "br":
            self.parts.append("\n")
        if name == "a":
            self.in_link = 1
        level = name in ("article", "main")
        if name in VOID or attributes.endswith("/") and not name == "a":
            return
        if out or named or level or name in BLOCK and name not in LOOSE:
            if (out or named) and name not in BLOCK:
                self.flush()
            self.open.append((name, out, self.level, self.named))
            self.names[name] = self.names.get(name, 0) + 1
            self.out += out
            self.count += 1
            if level:
                self.level = self.count
            if named:
                self.above[self.count] = self.named
                self.named = self.count

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
            self.heading = False
        if name == "a":
            self.in_link = 0
        if not self.names.get(name):
            return
        self.flush()
        while self.open:
            other, out, self.level, self.named = self.open.pop()
            self.out -= out
            self.names[other] -= 1
            if other == name:
                return


def _is_name(token: str) -> bool:
    words = re.split(r"[^a-z]+", token)
    return not NAMES.isdisjoint(words) and all(w in NAMES or w in FORMS or not w for w in words)


def _boilerplate(attributes: str, name: str) -> tuple[bool, bool]:
    """Whether an element is out by its role or style, and whether by its class or id."""
    if name in ("html", "body", "article", "main"):
        names = ("hidden",)
    else:
        names = ("hidden", "class", "id", "role", "style", "aria-hidden")
    named = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key not in names:
            continue
        if key in ("class", "id"):
            named = named or any(map(_is_name, value.split()))
        elif key == "hidden" or (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True, False
    return False, named


def tag_end(page: str, at: int, unpaired: set[str]) -> int:
    """Where the tag whose attributes begin at ``at`` ends: at a sign outside quotes. A quote that no other closes is a sign as any;
    ``unpaired`` remembers which kinds have none left, so a page is read once."""
    while m := STOP.search(page, at):
        sign, at = m[0], m.end()
        if sign == ">":
            return at
        if sign not in unpaired:
            end = page.find(sign, at)
            if end < 0:
                unpaired.add(sign)
            else:
                at = end + 1
    return len(page)


def blocks(page: str) -> tuple[list[tuple[str, int, bool, int, int]], dict[int, int], list[bool]]:
    """The text blocks of a page, in order, which element out by name is in which other, and which blocks are headings."""
    p, at, low, unpaired = _Page(), 0, None, set()
    while m := START.search(page, at):
        p.text(page[at : m.start()])
        head, at = m[0], m.end()
        if head == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif head == "<![CDATA[":
            end = page.find("]]>", at)
            p.text(page[at : len(page) if end < 0 else end])
            at = len(page) if end < 0 else end + 3
        elif head in ("<!", "<?"):
            at = page.find(">", at) + 1 or len(page)
        else:
            begin, at = at, tag_end(page, at, unpaired)
            name = head.lstrip("</").lower()
            if head[1] == "/":
                p.end(name)
            elif name in RAW:
                low = low or page.lower()
                end = low.find(f"</{name}", at)
                at = len(page) if end < 0 else end
                if end >= 0:
                    at = page.find(">", end) + 1 or len(page)
            else:
                p.start(name, page[begin:at].removesuffix(">"))
    p.text(page[at:])
    p.flush()
    return p.blocks, p.above, p.heads


def labels(found: list[tuple[str, int, bool, int, int]], above: dict[int, int], heads: list[bool]) -> list[int]:
    """Both passes: whether each block is in."""
    sizes = [0 if b[2] else max(0, len(b[0].replace(" ", "")) - b[1]) for b in found]
    whole = sum(sizes)
    held: dict[int, int] = {}
    for b, size in zip(found, sizes, strict=True):
        held[b[3]] = held.get(b[3], 0) + size
    held.pop(0, None)
    most = max(held, key=held.get, default=0)
    # of each element out by name: unlinked text, blocks of articles with text, whether the largest article is in it
    share, inside_, holds = ({x: 0 for x in above} for _ in range(3))
    articles = 0
    for b, size in zip(found, sizes, strict=True):
        articles += bool(b[3] and size)
        if b[4]:
            share[b[4]] += size
            inside_[b[4]] += bool(b[3] and size)
            holds[b[4]] |= b[3] == most
    for x in sorted(above, reverse=True):  # inner ones come after those around them
        if above[x]:
            for table in (share, inside_):
                table[above[x]] += table[x]
            holds[above[x]] |= holds[x]
    large = most and held[most] > LONG
    kept = {0: True}
    for x in sorted(above):
        kept[x] = kept[above[x]] and (bool(large and holds[x]) or (2 * share[x] > whole and inside_[x] == articles))
    out = [b[2] or not kept[b[4]] for b in found]
    inside = sum(n for n, gone in zip(sizes, out, strict=True) if not gone)
    prior = [not gone and most > 0 and b[3] == most and 2 * held[most] >= inside for b, gone in zip(found, out, strict=True)]
    first = [BAD if gone else _label(b[0], b[1]) for b, gone in zip(found, out, strict=True)]
    # a container's text says nothing of blocks beside it
    rest = second_pass([BAD if p else x for x, p in zip(first, prior, strict=True)], heads)
    return [int(not _linked(b[0], b[1])) if p else x for b, p, x in zip(found, prior, rest, strict=True)]


def _linked(text: str, linked: int) -> bool:
    return linked / max(1, len(text.replace(" ", ""))) > MAX_LINK_DENSITY


def _label(text: str, linked: int) -> int | None:
    size = len(text)
    if _linked(text, linked):
        return BAD
    if size < SHORT:
        return BAD if linked else OPEN
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
    if stops >= STOP_HIGH:
        return GOOD if size > LONG else OPEN
    return OPEN if stops >= STOP_LOW else BAD


def second_pass(first: list[int | None], heads: list[bool] | None = None) -> list[int]:
    """Open blocks take the label of the nearest decided one; of two equally near ones a heading follows the one after it, others are in if both are."""
    n, out = len(first), []
    before: list[tuple[int, int]] = []
    last = (1 << 30, BAD)
    for x in first:
        last = (last[0] + 1, last[1]) if x is OPEN else (0, x)
        before.append(last)
    last = (1 << 30, BAD)
    after = [last] * n
    for i in range(n - 1, -1, -1):
        last = (last[0] + 1, last[1]) if first[i] is OPEN else (0, first[i])
        after[i] = last
    for x, (da, a), (db, b), head in zip(first, before, after, heads or [False] * n, strict=True):
        out.append(x if x is not OPEN else a if da < db else b if db < da or head else a & b)
    return out


def main_text(page: str | None) -> str:
    found, above, heads = blocks(page) if page else ([], {}, [])
    return "\n".join(b[0] for b, good in zip(found, labels(found, above, heads), strict=True) if good)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: page_id, url, text."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h) for h in batch["html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], text], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


#: SQL cannot express the two passes
SQL = None
