"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text between block-level tags. A small linear classifier gives each block the cost of calling it
content and the cost of calling it boilerplate; these are the capacities from the source and to the sink. Neighbouring blocks in page order,
blocks under the same container, and a container's first block and the one before it in the container around, are joined by smoothness edges, so that labels
change seldom and rather between containers than inside one. The minimum cut, found by maximum flow, is the labelling of least total cost.

Scripts, styles, comments, head and forms' controls carry no text. Character references are decoded, white space inside a block
becomes one space, blocks that remain are joined by two newlines in page order; nothing is cut. A null or empty page, or
one without content, has an empty text. Tags are read as browsers do: `>` ends a tag unless a quote that follows `=` is open (a quote that
never closes is not one), and attributes are read one after another, so a value never passes for an attribute. Repeated rows are labelled one by one; a null id or url is kept. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trimmed

_NO_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.DOTALL)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
RAW = frozenset("script style template noscript textarea title svg math iframe object select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next of their kind, or what holds them, begins or ends; their blocks are of the container around them.
CLOSED_BY = {"p": BLOCK, "li": frozenset({"li"}), "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split())}
#: Containers whose nesting matters.
NESTED = frozenset("article aside blockquote body details dialog dl div fieldset figure footer form head header main menu nav ol section table ul button label".split())
BAD_TAG = frozenset("nav footer header aside form menu dialog head button fieldset".split())
GOOD_TAG = frozenset("article main".split())
#: Their classes describe the page or post; only a reader's comment is marked up as an article too.
UNNAMED = frozenset("html body article main".split())
#: What names a part of a page that is no content.
_BAD_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs foot footer head header masthead side sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "cookie cookies consent notice notices alert gdpr privacy popup modal overlay newsletter subscribe signup login search share sharing social related recommend recommended recommendations "
    "tag tags widget widgets comment comments comentarios commentaires kommentare kommentarer reply replies respond disqus feedback pagination pager toolbar copyright legal skip hidden "
    "notification notifications trending teaser teasers mostread".split()
)
_COMMENT_WORDS = frozenset("comment comments comentarios commentaires kommentare kommentarer reply replies".split())
#: Names of two parts that are such a word together.
_BAD_PAIRS = frozenset({("most", "read"), ("most", "popular"), ("most", "viewed"), ("read", "next"), ("read", "also"), ("up", "next"), ("sign", "up")})
#: A heading of the content itself may have these.
_HEADING_WORDS = frozenset("head header".split())
#: A named article inside such a container is content all the same.
_LAYOUT_WORDS = frozenset("head header masthead banner overlay modal popup widget widgets".split())
#: Last parts of names that say what kind of thing a container is, not what it holds.
_KINDS = frozenset("post posts article articles stories list lists links link buttons button box boxes area block bar wrapper wrap container inner outer section form items item icons icon media body content top bottom left right text title group panel row col slot unit zone".split())
#: Class names that tell what a page or post is about, or has, and name no container.
_ABOUT = re.compile(r"(?:has|no|not|with|without|is-not)[-_]|(?:.*[-_])?(?:with|without)[-_]|(?:tag|category|cat|topic|format|type|author)[-_](?!(?:list|links?|cloud|items?|box)$)", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|entry|post|story|body|text)(?:$|[\s_-]|\d)", re.IGNORECASE)
_STOP = re.compile(r"[.!?…。:;](?:[\s\"'”’)]|$)")


@dataclass
class Block:
    text: str
    container: int
    tag: str
    link: int = 0
    bad: bool = False
    good: bool = False
    #: the container around its container; none around the outermost
    around: int = -1


@dataclass
class _Open:
    tag: str
    number: int
    around: int
    #: why its content is none: the word, the tag, or empty
    bad: str
    good: bool


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _closing(page: str, tag: str, at: int) -> int:
    """Where the raw content of a tag ends; the page's end if nothing closes it."""
    found = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
    return found.end() if found else len(page)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """A tag's attributes (of equal names the first), read from behind its name, and where the tag ends."""
    named: dict[str, str] = {}
    while True:
        found = _ATTR.match(page, at)
        if not found:
            end = page.find(">", at)
            return named, len(page) if end < 0 else end + 1
        named.setdefault(found[1].lower(), html.unescape(found[2] or found[3] or found[4] or ""))
        at = found.end()


def bad_word(token: str) -> str:
    """The word by which one class name, id or role names a part that is no content; empty if it does not.

    The name counts as a whole: its last part, kinds of containers apart, has to be such a word ("share-buttons", "site-header",
    but not "search-engines", "sidebar-layout" or "article-with-sidebar").
    """
    if _ABOUT.match(token):
        return ""
    parts = [x.lower() for x in _PARTS.findall(token)]
    while len(parts) > 1 and parts[-1] in _KINDS and parts[-1] not in _BAD_WORDS:
        parts.pop()
    if tuple(parts[-2:]) in _BAD_PAIRS:
        return "".join(parts[-2:])
    return parts[-1] if parts and parts[-1] in _BAD_WORDS else ""


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with their containers and whether these are named as content or as boilerplate."""
    state, stack, tag, number, in_link, at = _Page(), [_Open("", 0, -1, "", False)], "", 0, False, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(state.parts)).split())
        if text:
            top = stack[-1]
            state.blocks.append(Block(text, top.number, tag, state.linked, bool(top.bad), top.good, top.around))
        state.parts.clear()
        state.linked = 0

    def add(text: str) -> None:
        if text:
            state.parts.append(text)
            if in_link:
                state.linked += len(text)

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        none = _NO_TAG.match(page, begin)
        if none:
            at = none.end()
            continue
        found = _TAG.match(page, begin)
        if not found:
            add("<")
            at = begin + 1
            continue
        name = found[2].lower()
        named, at = _attributes(page, found.end())
        if name == "br":
            add(" ")
        elif name == "a":
            in_link = not found[1]
        if not found[1] and name in RAW:
            at = _closing(page, name, at)
            continue
        if name not in BLOCK and name not in NESTED:
            continue
        if name in BLOCK:
            flush()
            tag = "" if found[1] else name
        while stack[-1].tag in CLOSED_BY and name in CLOSED_BY[stack[-1].tag]:
            stack.pop()
        if name not in NESTED and name not in CLOSED_BY:
            continue
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if depth:
                del stack[depth:]
        else:
            top = stack[-1]
            tokens = " ".join(named.get(k, "") for k in ("class", "id", "role")).split()
            unseen = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
            good = name in GOOD_TAG or (name not in ("html", "body", "head") and _GOOD.search(" ".join(tokens)) is not None)
            words = [w for w in map(bad_word, tokens) if w and not (w in _HEADING_WORDS and top.good)]
            if name in UNNAMED:
                words = [w for w in words if name == "article" and w in _COMMENT_WORDS]
            bad = "hidden" if unseen else next(iter(words), "")
            if not bad and name in BAD_TAG and not (name == "header" and top.good):
                bad = name
            inherited = "" if name in GOOD_TAG and not bad and top.bad in _LAYOUT_WORDS else top.bad
            place = (top.number, top.around)
            if name in NESTED:
                number += 1
                place = (number, top.number)
            stack.append(_Open(name, *place, bad or inherited, (top.good or good) and not bad))
    flush()
    return state.blocks


#: The classifier: a linear score in nats, positive for content. The values are set by hand, not fitted (the pages have no labels);
#: the tests state what they reach on pages of varied markup.
WEIGHTS = {
    "bias": -0.3, "letters": 2.5, "sentence": 0.6, "linked": -3.0, "paragraph": 0.5, "heading": 0.4, "linked cell": -0.6, "cell after prose": 0.5,
    "beside named content": -3.0, "notice": -2.5, "named content": 6.0, "named boilerplate": -9.0,
}
_CELLS = ("li", "td", "th", "dt", "dd")
#: What short lines of a page's frame say.
_NOTICE = re.compile(
    r"©|\(c\) \d{4}|copyright \d{4}|all rights (?:are )?reserved|(?:use|uses|using|accept) (?:of )?cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|sign up (?:for|to) |subscribe (?:to|now)|our newsletter|share this|follow us",
    re.IGNORECASE,
)


def surroundings(found: list[Block]) -> list[tuple[bool, bool]]:
    """For each block: whether it lies beside named content that holds at least half of the text which is not named boilerplate, and whether it is a cell
    without links of a list or table that goes on from prose."""
    named, rest = (sum(len(b.text) - b.link for b in found if not b.bad and b.good is side) for side in (True, False))
    out: list[tuple[bool, bool]] = []
    prose: int | None = None  # container of the last block that is no cell, if that is prose
    for b in found:
        cell = b.tag in _CELLS
        out.append((named >= rest and named > 0 and not b.good and b.tag != "h1", cell and not b.link and b.around == prose))
        if not cell:
            prose = b.container if not b.bad and not b.link and (b.tag == "p" or len(b.text) >= 40) else None
    return out


def terminal_costs(block: Block, beside: bool = False, after_prose: bool = False) -> tuple[float, float]:
    """Costs of losing the block as content and of keeping it: both sides of one linear score."""
    plain = not block.good and not block.bad
    features = {
        "bias": 1.0, "letters": min(len(block.text), 400) / 400, "sentence": _STOP.search(block.text) is not None, "linked": block.linked_share,
        "paragraph": block.tag == "p", "heading": block.tag in ("h1", "h2", "h3", "blockquote", "pre"), "linked cell": block.tag in _CELLS and block.link > 0,
        "cell after prose": after_prose and plain, "beside named content": beside and plain, "notice": plain and len(block.text) < 300 and _NOTICE.search(block.text) is not None,
        "named content": block.good and not block.bad, "named boilerplate": block.bad,
    }
    score = sum(WEIGHTS[k] * x for k, x in features.items())
    return max(score, 0.0), max(-score, 0.0)


Block.linked_share = property(lambda b: min(1.0, b.link / max(1, len(b.text))))


def max_flow(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; edges are symmetric.

    Levels from all nodes with flow left, then blocking flow along them, until no sink is reached (Dinic).
    """
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]  # what passes straight through a node needs no search
    room = [max(-x, 0.0) for x in excess]
    left = [max(x, 0.0) for x in excess]
    to, cap, out = [], [], [[] for _ in range(n)]
    for u, v, c in edges:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(c)
    tiny = 1e-9
    while True:
        level = [0 if x > tiny else -1 for x in left]
        queue = [u for u in range(n) if level[u] == 0]
        reached = False
        for u in queue:
            reached = reached or room[u] > tiny
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in [u for u in range(n) if level[u] == 0]:
            path: list[int] = []
            u = s
            while left[s] > tiny:
                if room[u] > tiny:
                    flow = min([left[s], room[u], *(cap[e] for e in path)])
                    left[s] -= flow
                    room[u] -= flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path, u = [], s
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if cap[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(out[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def main_text(page: str | None, adjacent: float = 0.4, together: float = 0.8, nested: float = 0.4) -> str:
    """The page's content blocks with an empty line between. Costs of cutting: neighbours (adjacent), blocks of one container (together), a container's
    first block and the one before it in the container around (nested)."""
    found = blocks(page or "")
    costs = [terminal_costs(b, *near) for b, near in zip(found, surroundings(found), strict=True)]
    edges = [(i, i + 1, adjacent) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if block.container in last:
            edges.append((last[block.container], i, together))
        elif block.around in last:
            edges.append((last[block.around], i, nested))
        last[block.container] = i
    keep = max_flow([c for c, _ in costs], [b for _, b in costs], edges)
    return "\n\n".join(b.text for b, kept in zip(found, keep, strict=True) if kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return chosen.mapInArrow(trimmed(texts), "page_id long, url string, text string, n_chars long")
