"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by the density of function words, by length
and by the share of linked text; the second gives ambiguous short blocks the label of the nearest decided neighbour.
Marked regions set what the rules expect: within an ``article`` or ``main`` element text needs no function words, within
navigation, adverts, forms, notices or reader comments every block is boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.runtime import ship

# Function words of the four languages that the rules know; pass others as ``stop_words``.
STOP_WORDS = frozenset("""
a about after all an and any are as at be been but by can do for from had has have he her his i if in into is it its more
no not of on one or our out said she so some than that the their them then there they this to up was we were what when
which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
ihr im in ist ja man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu
zum zur
au aux avec avait ce cette dans de des du elle en est et était il ils je la le les leur lui mais ne nous on ont ou par pas
plus pour qu que qui sa se ses son sont sur un une vous
al como con de del el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que
se ser si sin sobre su sus también te un una y ya yo
""".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
                 r"""(?P<rest>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
PARTS = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)
       for name in "script style title textarea iframe noembed noframes xmp".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section
select summary table tbody td template tfoot th thead tr ul""".split())
BOILERPLATE = frozenset("""aside button canvas datalist dialog footer form head header map menu nav noscript object select
svg math template audio video""".split())
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies
consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar widget nav navbar navigation menu
breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments reply replies respond disqus
share sharing social related recommended recommendations login signup search copyright""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())

LINKED = 0.33  # a block with a larger share of linked characters is boilerplate
SHORT = 70     # characters below which a block is not decided by itself
LONG = 200     # from here on a block without links is never boilerplate by itself
FEW, MANY = 0.10, 0.25  # share of function words: below FEW no prose, from MANY on prose


@dataclass(slots=True)
class Block:
    region: int  # blocks of one article or main element share a number; 0 is the rest of the page
    hidden: bool  # in a region that is marked as boilerplate
    heading: bool = False
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


def marked(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element's name or attributes mark it as boilerplate."""
    if name in BOILERPLATE and not (name == "header" and in_article):
        return True
    if not rest or name in ("html", "body", "main", "article") or name in VOID:
        return False
    for match in ATTRIBUTE.finditer(rest):
        key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if key in ("class", "id") and not MARKS.isdisjoint(x.lower() for x in PARTS.findall(value)):
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def page_blocks(page: str) -> list[Block]:
    """The blocks with text, in page order. One pass from left to right; unclosed tags, quotes and comments end the page."""
    found: list[Block] = []
    open_: list[tuple[str, int, bool]] = []  # elements around: name, region, hidden
    depth: Counter[str] = Counter()  # of every name among them
    now, links, at, regions = Block(0, False), 0, 0, 0

    def start(heading: bool) -> Block:
        if now.parts:
            found.append(now)
        region, hidden = open_[-1][1:] if open_ else (0, False)
        return Block(region, hidden, heading)

    def leave() -> str:
        name = open_.pop()[0]
        depth[name] -= 1
        return name

    def add(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())

    size = len(page)
    while at < size:
        tag = TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at:tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif depth[name]:
                while leave() != name:
                    pass
                now = start(False)
            elif name in BLOCKS:
                now = start(False)
            continue
        if name in RAW:
            closing = RAW[name].search(page, at)
            at = closing.start() if closing else size
            continue
        if name == "a":
            links = 1
        elif name == "br":
            now.parts.append(" ")
        if name in BLOCKS:
            links = 0
            if open_ and open_[-1][0] == "p":
                leave()
        if name in VOID:
            if name == "hr":
                now = start(False)
            continue
        region, hidden = open_[-1][1:] if open_ else (0, False)
        if name in ("article", "main") and not region:
            regions += 1
            region, hidden = regions, False
        elif name == "article" and depth["article"]:
            hidden = True  # an article within an article is a reader's comment
        inner = hidden or marked(name, tag["rest"], region > 0)
        if name in BLOCKS or inner and not hidden or depth[name]:
            open_.append((name, region, inner))
            depth[name] += 1
            now = start(name in ("h1", "h2", "h3", "h4", "h5", "h6"))
    if now.parts:
        found.append(now)
    for block in found:
        block.text = " ".join("".join(block.parts).split())
    return [block for block in found if block.text]


def decide(block: Block, stop_words: frozenset[str]) -> bool | None:
    """First pass: content, boilerplate, or None for a block that can't be told by itself."""
    if block.hidden:
        return False
    size = len(block.text)
    linked = block.linked / size
    if block.region:
        if linked > 2 * LINKED and not block.heading:
            return False
        return None if size < SHORT else True
    if linked > LINKED:
        return False
    if size < SHORT:
        return False if block.linked or "\xa9" in block.text else None
    words = block.text.lower().split()
    share = sum(word.strip(".,;:!?()\"'#$%&*|<>") in stop_words for word in words) / len(words)
    if share < FEW and (size < LONG or block.linked):
        return False
    return True if share >= MANY else None


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The content blocks of a page, joined by empty lines; white space within a block is one space."""
    blocks = page_blocks(page or "")
    labels = [decide(block, stop_words) for block in blocks]
    near: list[tuple[int, bool] | None] = [None] * len(blocks)  # second pass: distance to and label of a decided block
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            region = blocks[i].region
            if labels[i] is not None and not (region and blocks[i].hidden):
                last[region] = (i, labels[i])
            elif labels[i] is None and region in last:
                distance = abs(i - last[region][0])
                if near[i] is None or distance < near[i][0] or distance == near[i][0] and last[region][1]:
                    near[i] = (distance, last[region][1])
    some = any(label and block.region == 0 for label, block in zip(labels, blocks)) or any(b.region for b in blocks)
    for i, block in enumerate(blocks):
        if labels[i] is None:
            if near[i]:
                labels[i] = near[i][1] or bool(block.region) or not some
            else:  # nothing decided around: an article is content, and so is a page that has nothing else
                labels[i] = bool(block.region) or not some
    return "\n\n".join(block.text for block, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """One row per page: id, url, ``text`` (empty if none) and ``n_chars``, its code points.

    One narrow pass: no shuffle, and pages are worked on one at a time, whole, in time proportional to their length. A
    null page has the empty text; rows of equal id stay apart; further columns are left out, so their names can't clash.
    Character references are decoded once, by the rules for text; white space is what Unicode calls so.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))

    def run(batches):
        from telemill.llm.html_extract import main_text

        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = [main_text(page.as_py(), stop_words) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
