"""Main text of web pages by two-pass block rules.

The page is cut at block tags. Pass one labels each block from its length, link density and stop-word
density, and from the containers it lies in (menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are known by their tags, roles, classes and ids). An ``article`` or ``main`` element is one vote
for what it holds: it lifts a block one step (bad by its words, or by links up to twice the limit, becomes near;
near becomes good), and does not overrule many links in a long block or a row of short ones. An element of at most ``long`` characters of its own text (a card, a teaser) has no vote where other
text of the page is good. Pass two gives ambiguous and short blocks the label of their nearest decided neighbours;
under a vote these are the ones within the element, and the vote counts as one of them.

Defined cases: null or empty html, and pages without content, give an empty text; cut-off pages are read as
far as they go, a cut-off tag is dropped; blocks are joined in page order; repeated rows are treated alike;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Config:
    max_link_density: float = 0.33
    short: int = 70
    long: int = 200
    stop_low: float = 0.30
    stop_high: float = 0.32


# Common function words of the languages at hand.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei bin bis das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sein sich sie sind so und von war wie wir zu zum zur "
    "al con como del el ella ellos era es esta este ha hay las lo los más me mi muy no o para pero por qué se sin sobre su sus también te todo tu una uno y ya".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe svg math object canvas audio video textarea select title".split())
LEFT_OUT = frozenset("nav footer aside form head dialog menu button".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar "
    "header masthead footer copyright cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search form comment comments disqus reply "
    "replies respond share sharing social related recommended widget skip toolbar".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# What a compound class may hold besides hints and still be one, inside an article: "share-buttons", not "share-price".
PARTS = frozenset("area bar block body bottom box button buttons container content count group icon icons inner item items label left link links list main outer page panel post posts right section site slot text title top unit wrap wrapper".split())
_OPEN = re.compile(r"<(?:!--|[a-zA-Z]|/[a-zA-Z]|[!?])")
_NAME = re.compile(r"[^\s/>]*")
_UPTO = re.compile(r">|=\s*(?:\"[^\"]*\"|'[^']*')")  # quotes hide a > only as values
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9])", re.I) for tag in RAW_TAGS}
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


class Block:
    __slots__ = ("heading", "inside", "left_out", "linked", "text")

    def __init__(self, text: str, linked: int, left_out: bool, inside: int, heading: bool):
        self.text, self.linked, self.left_out, self.inside, self.heading = text, linked, left_out, inside, heading


APART = frozenset("comment comments reply replies ad ads advert sponsored promo".split())  # what an article element may be instead


def _hinted(tag: str, attributes: str, inside: bool) -> bool:
    if not attributes:
        return False
    for m in _ATTR.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in LEFT_OUT_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            parts = [re.split(r"[_-]+", token) for token in value.split()]
            known = APART if tag == "article" else HINTS
            if inside or tag == "article":
                if any(not known.isdisjoint(x) and all(w in HINTS or w in PARTS or w.isdigit() or not w for w in x) for x in parts):
                    return True
            elif any(not known.isdisjoint(x) for x in parts):
                return True
    return False


def tag_end(page: str, at: int) -> int:
    """Where the tag that is open at ``at`` ends (behind its >), -1 if it is cut off."""
    while m := _UPTO.search(page, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
    return -1


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, left out, number of the innermost content element
    text: list[str] = []
    linked, links, at, contents = 0, 0, 0, 0
    heading = False

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                _, left_out, inside = stack[-1]
                out.append(Block(joined, linked, left_out, inside, heading))
            text, linked = [], 0

    n = len(page)
    while at < n:
        m = _OPEN.search(page, at)
        raw = page[at : m.start() if m else n]
        if raw:
            text.append(raw)
            if links:
                linked += len(raw.strip())
        if not m:
            break
        kind = m[0]
        if kind == "<!--" or kind in ("<!", "<?"):
            end = page.find("-->" if kind == "<!--" else ">", m.end())
            if end < 0:
                break
            at = end + (3 if kind == "<!--" else 1)
            continue
        name = _NAME.match(page, m.end() - 1)
        end = page.find(">", name.end()) + 1 if kind[1] == "/" else tag_end(page, name.end())
        if end <= 0:
            break
        at, tag, attributes = end, name[0].lower(), page[name.end() : end - 1]
        if kind[1] != "/":
            if tag in RAW_TAGS and not attributes.rstrip().endswith("/"):
                closing = _RAW_END[tag].search(page, at)
                if tag == "title" or tag in BLOCK_TAGS:
                    close()
                if not closing:
                    break
                stop = page.find(">", closing.end())
                at = n if stop < 0 else stop + 1
            elif tag == "a":
                links = 1
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCK_TAGS:
                close()
                if tag in VOID_TAGS:
                    continue
                if stack[-1][0] == "p":
                    stack.pop()
                _, left_out, inside = stack[-1]
                hinted = tag in LEFT_OUT or tag == "header" and not inside or _hinted(tag, attributes, bool(inside))
                if tag in CONTENT_TAGS and not hinted and not any(t in LEFT_OUT and t != "form" for t, _, _ in stack):
                    contents += 1
                    left_out, inside = False, contents
                stack.append((tag, left_out or hinted, inside))
                heading = tag in HEADINGS
        else:
            if tag == "a":
                links = 0
            elif tag in BLOCK_TAGS:
                close()
                heading = False
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
    close()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block, config: Config, vouched: bool = False, menu: bool = False) -> str:
    """``vouched``: an element votes for the block; ``menu``: it stands in a row of short blocks that are links."""
    if block.left_out:
        return BAD
    n = len(block.text)
    density = block.linked / n
    if density > config.max_link_density or "©" in block.text:
        if not vouched:
            return BAD
        if n < config.short:
            return BAD if menu and not block.heading else SHORT
        return BAD if density > 2 * config.max_link_density else NEAR
    if n < config.short:
        return SHORT
    stops = stop_density(block.text)
    if stops >= config.stop_high:
        return GOOD if n > config.long or vouched else NEAR
    if stops >= config.stop_low:
        return GOOD if vouched else NEAR
    return NEAR if vouched else BAD


def votes(found: list[Block], first: list[str], config: Config) -> set[int]:
    """The content elements that vote for what they hold."""
    own: dict[int, int] = {}
    for b in found:
        if b.inside and not b.left_out:
            own[b.inside] = own.get(b.inside, 0) + (len(b.text) + 1) * (b.linked <= config.max_link_density * len(b.text))
    large = {k for k, size in own.items() if size > config.long}
    return large or (set() if GOOD in first else set(own))


def menus(found: list[Block], config: Config, row: int = 3) -> list[bool]:
    """Which blocks are among at least ``row`` short ones on end that are mostly links."""
    out, run = [False] * len(found), 0
    for i, b in enumerate(found):
        linked = len(b.text) < config.short and b.linked > config.max_link_density * len(b.text) and not b.left_out
        run = 0 if not linked else run + 1 if i and found[i - 1].inside == b.inside else 1
        if run >= row:
            out[i - row + 1 : i + 1] = [True] * row
    return out


def labels(found: list[Block], config: Config) -> list[bool]:
    first = [first_pass(b, config) for b in found]
    vote = votes(found, first, config)
    if vote:
        first = [first_pass(b, config, True, menu) if b.inside in vote else x for x, b, menu in zip(first, found, menus(found, config), strict=True)]
    n = len(first)
    before, after = [""] * n, [""] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, within = BAD, {}
        for i in order:
            b = found[i]
            near[i] = within.get(b.inside, "") if b.inside in vote else last
            if first[i] in (GOOD, BAD):
                last = first[i]
                if not b.left_out:
                    within[b.inside] = first[i]
    out = []
    for i, x in enumerate(first):
        if x in (NEAR, SHORT) and found[i].inside in vote:
            out.append(not before[i] == after[i] == BAD)
        elif x == NEAR:
            out.append(GOOD in (before[i], after[i]) or {before[i], after[i]} == {BAD} and GOOD not in first)
        elif x == SHORT:
            out.append(before[i] == after[i] == GOOD or found[i].heading and GOOD in (first[i + 1 : i + 2] or [after[i]]))
        else:
            out.append(x == GOOD)
    return out


def main_text(page: str | None, config: Config = Config()) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, labels(found, config), strict=True) if good)


def extract(pages: DataFrame, config: Config = Config()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h.as_py(), config) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
