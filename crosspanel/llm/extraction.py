"""Main text of web pages: a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_records, query, table

# Element names by what they mean for the text inside them.
RAW = frozenset("script style template textarea iframe title svg".split())
# of these, elements whose text holds no marks: only their own end tag ends them
PLAIN = frozenset("script style textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form button select menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# an open element that one of these starts also ends
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_AT = frozenset("ul ol dl table select".split())
# Words of class and id names.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disclaimer disqus feedback foot footer form gdpr head header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion rail recommended recommendations related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending widget widgets".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())

# costs: evidence for (above 0) or against a block
IN_CONTENT, NAMED_CONTENT, IN_BOILERPLATE, NAMED_BOILERPLATE, HIDDEN = 3.0, 1.0, -8.0, -7.0, -8.0
LINKS, SENTENCE, HEADED, BASE = -4.0, 0.8, 0.4, -1.6
# capacities between neighbours: of one parent, of one grandparent, further apart
SAME_PARENT, SAME_GRANDPARENT, APART = 1.2, 0.6, 0.2

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I | re.A) for x in PLAIN}
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
# name and value of an attribute, whatever it is called
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")


@dataclass
class Block:
    text: str
    links: int
    tag: str
    trail: tuple[int, ...]
    prior: float


def _prior_of(tag: str, attrs: str, inside_content: bool) -> tuple[float, bool]:
    """Evidence an element gives for all text in it, and whether it is boilerplate whatever stands around it."""
    value = 0.0
    if tag in CONTENT:
        value += IN_CONTENT
    bad = tag in BOILERPLATE or tag == "header" and not inside_content
    named_bad = False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, text = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                bad |= text.lower() in ROLES
                value += IN_CONTENT * (text.lower() in CONTENT)
            elif key == "hidden" or key == "aria-hidden" and text.lower() == "true" or key == "style" and "display:none" in text.replace(" ", "").lower():
                value += HIDDEN
            elif key in ("class", "id") and tag not in ("html", "body"):
                names = {x.lower() for x in _NAME.findall(text)}
                named_bad |= not names.isdisjoint(BAD_NAMES)
                value += NAMED_CONTENT * (not names.isdisjoint(GOOD_NAMES))
    return value + IN_BOILERPLATE * bad + NAMED_BOILERPLATE * (named_bad and not bad), bad or named_bad


def blocks_of(page: str) -> list[Block]:
    """Texts between the borders of block elements, in page order. Works on broken nesting and unclosed elements."""
    out: list[Block] = []
    # open elements: tag, number, evidence of it and all around it, inside content, inside a link
    stack: list[tuple[str, int, float, bool, bool]] = [("", 0, 0.0, False, False)]
    held: list[str] = []
    linked, number, at, skip_to = 0, 0, 0, ""
    # blocks opened inside what is skipped
    inner: list[str] = []

    def text_at(raw: str) -> None:
        nonlocal linked
        if raw:
            s = html.unescape(raw) if "&" in raw else raw
            held.append(s)
            if stack[-1][4]:
                linked += len(s)

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                trail = tuple(x[1] for x in stack if x[0] in BLOCK)
                tag = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "")
                out.append(Block(text, linked, tag, trail, stack[-1][2]))
            held.clear()
        linked = 0

    scan = 0
    while m := _MARK.search(page, scan):
        scan = m.end()
        opened = m[2].lower() if m[2] and not m[1] else ""
        if opened in PLAIN:
            # such an element has no form that closes itself
            end = _END[opened].search(page, scan)
            scan = end.end() if end else len(page)
        elif (m[3] or "").endswith("/"):
            opened = ""
        if skip_to:
            tag = m[2].lower() if m[2] else ""
            if m[1] and tag == skip_to:
                skip_to, at = "", scan
                continue
            if skip_to == "svg" and opened in BLOCK:
                # a block has no place in a drawing and ends it
                skip_to, at = "", m.start()
            elif opened in BLOCK:
                inner.append(opened)
                continue
            elif m[1] and tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                continue
            elif m[1] and tag in BLOCK and any(x[0] == tag for x in stack):
                # the end of the block around it ends it at the latest
                skip_to, at = "", m.start()
            else:
                continue
        text_at(page[at : m.start()])
        at = scan
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                close()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
        elif tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                close()
        elif tag in RAW:
            if opened and tag not in PLAIN:
                skip_to = tag
                inner.clear()
        else:
            if tag in BLOCK:
                close()
                # a new block ends an open paragraph and inline elements left open in it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
                if tag in ENDS:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in ENDS[tag]:
                            del stack[k:]
                            break
                        if stack[k][0] in ENDS_AT:
                            break
            number += 1
            value, bad = _prior_of(tag, m[3] or "", stack[-1][3])
            inside = (stack[-1][3] or tag in CONTENT) and not bad
            stack.append((tag, number, stack[-1][2] + value, inside, stack[-1][4] or tag == "a"))
    if not skip_to:
        text_at(page[at:])
    close()
    return out


def cost(block: Block) -> float:
    """Evidence for content (above 0) or boilerplate."""
    words = block.text.count(" ") + 1
    value = BASE + block.prior + 0.7 * log(words + 1) + LINKS * min(1.0, block.links / len(block.text))
    return value + SENTENCE * (block.text[-1] in ".!?…:\"”»") + HEADED * (block.tag in HEADING)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Each block and the next one, and the next one of its own parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            near = SAME_PARENT if a.trail[:-1] == b.trail[:-1] or a.trail == b.trail else SAME_GRANDPARENT if a.trail[:-2] == b.trail[:-2] else APART
            out.append((i - 1, i, near))
        parent = b.trail[:-1]
        if parent in last and last[parent] < i - 1:
            out.append((last[parent], i, SAME_PARENT / 2))
        last[parent] = i
    return out


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the source's side of a minimum cut.

    A block's evidence is the capacity of its edge from the source (content) or
    to the sink. Flow follows shortest paths level by level until none is left.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            add(source, i, c, 0.0)
        elif c < 0:
            add(i, sink, -c, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in at[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
            for k in range(tried[a], len(at[a])):
                e = at[a][k]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    tried[a] = k
                    path.append(e)
                    a = to[e]
                    break
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The content blocks joined by a space, the number of blocks and of content blocks."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return "", 0, 0
    keep = min_cut([cost(b) for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep) if k), len(blocks), sum(keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """`id_col`, the columns of `keep`, text, n_blocks, n_content of every page.

    A null or empty page has an empty text; repeated rows give repeated results,
    an empty table an empty one; other columns are not read. One pass, no shuffle.
    """
    names = [id_col, *keep]

    def run(rows):
        for *head, page in rows:
            yield (*head, *main_text(page))

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return map_records(pages.select(*names, html_col), run, f"{schema}, text string, n_blocks bigint, n_content bigint")


@query("op3_extraction")
def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_blocks", "n_content")
