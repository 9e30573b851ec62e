"""Main text of web pages by minimum cut: every block of a page is labelled content or boilerplate.

A tolerant scan gives the page's blocks with the path of open elements above each. A classifier turns what is known of
a block into a cost, the capacity of its edge to a terminal: to the content side if it looks like the article, to the
other side if it looks like a menu. Neighbours in page order and in the tree are tied by smoothness edges, weaker
the farther apart they are in the tree. The minimum cut between the terminals is the cheapest labelling of all blocks.
Pages are independent of each other, so the work needs no shuffle; what a task holds is a batch of pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import only, prepare, table

#: A comment, a tag (closing?, name, attributes), or another declaration. A quote that is never closed is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What stands in these is no text of the page; their end tag alone ends them.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "select", "datalist", "canvas", "audio", "video")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag ends, if it is open above the nearest of the elements that hold it.
_ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "body": ("head", set())}
_HOLDERS = frozenset("article aside blockquote body button caption div dl fieldset figure footer form header html li main nav ol section table td th ul".split())

#: Parts of class, id and role that tell what an element is for.
_AWAY = frozenset(
    "ad ads adbox adslot advert advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion promoted banner masthead nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar widget widgets footer "
    "contentinfo complementary cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay dialog newsletter subscribe subscription signup login signin share sharing social socials related recommended "
    "recommendations trending search searchbox pagination pager paging toolbar skip copyright disclaimer".split()
)
_REPLIES = frozenset("comment comments commentlist disqus reply replies respondent discussion".split())
_TOWARDS = frozenset("article content main post entry story body text".split())
#: Of an inline element only these count, as "comment" or "notice" may be the look of a word.
_ADVERTS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo adsbygoogle".split())
_AWAY_TAGS = frozenset("nav aside footer form button menu dialog fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Costs, in units of about a nat: the zone of a block, its own looks, and the smoothness of neighbours.
ARTICLE, NEUTRAL, OUTSIDE, AWAY = 4.0, 1.0, -5.0, -9.0
LINKED, WORDS, SENTENCE, SHORT, TITLE, RIGHTS = -6.0, 2.5, 1.0, -1.5, 1.5, -4.0
ADJACENT, CLOSE, SIBLING = 0.5, 1.5, 0.75


@dataclass(slots=True)
class Element:
    """An open element: its name, the one above it, its depth, and the zone that it puts its blocks in: 1 article, 0 none, -1 away, -2 away for good."""

    name: str
    above: int
    depth: int
    zone: int


@dataclass(slots=True)
class Block:
    """A block's text, white space collapsed, how many of its characters are links, its element, and whether a heading or link list."""

    text: str
    linked: int
    element: int
    name: str


def _zone(name: str, attributes: str, zone: int, in_article: bool) -> int:
    """The zone of an element within one of `zone`."""
    if zone == -2:
        return -2
    role, marks, hidden = "", set(), False
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = values[0] or values[1] or values[2]
            key = key.lower()
            if key == "role":
                role = value.strip().lower()
            elif key == "style":
                hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key in ("hidden", "aria-hidden"):
                hidden |= key == "hidden" or value.lower() == "true"
            else:
                marks |= {tuple(p.lower() for p in _PART.findall(one)) for one in value.split()}
    if hidden:
        return -2
    parts = {p for mark in marks for p in mark}
    whole = name in ("html", "body", "article", "main") or role in ("main", "article")
    # of the page's frame and its articles only whole names count: an article may be "comments-open"
    said = {mark[0] for mark in marks if len(mark) == 1} if whole else parts
    if name in ("html", "body"):
        return zone
    if name in _INLINE:
        return -1 if parts & _ADVERTS else zone
    if said & _REPLIES:
        return -2
    if name in ("article", "main") or role in ("main", "article"):
        # an article ends what was left open before it
        return -1 if said & _AWAY else 1
    if name in _AWAY_TAGS or role in _AWAY or role in ("form", "search"):
        return -1
    if said & _AWAY and name not in _HEADING:
        return -1
    if (name == "header" or ("header",) in marks or {("site", "header"), ("page", "header"), ("top", "bar"), ("topbar",)} & marks) and not in_article:
        return -1
    if zone == 0 and said & _TOWARDS and name in ("div", "section", "td"):
        return 1
    return zone


def blocks(page: str) -> tuple[list[Block], list[Element], bool]:
    """The page's blocks in order, all elements, and whether it names its article. Markup that is broken or left open is read as far as it goes."""
    elements, open_, found = [Element("", -1, 0, 0)], [0], []
    text: list[str] = []
    linked, in_link, named, articles = 0, 0, False, 0

    def cut(k: int) -> bool:
        """Whether an inline element is put away, so that its text is a block of its own."""
        return elements[k].zone < 0 <= elements[elements[k].above].zone

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                at = next((k for k in reversed(open_) if elements[k].name not in _INLINE or cut(k)), 0)
                found.append(Block(said, min(linked, len(said)), at, elements[at].name))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal in_link, articles
        for k in open_[depth:]:
            in_link -= elements[k].name == "a"
            articles -= elements[k].name in ("article", "main")
        del open_[depth:]

    def close_to(names: tuple[str, ...], holders: frozenset | set) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            if elements[open_[depth]].name in names:
                close(depth)
                # a cell's row goes with it
                return close_to(names, holders) if len(names) > 1 else None
            if elements[open_[depth]].name in holders:
                return None
        return None

    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(page, at, end)
        if not m:
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += len(page[at : m.start()].strip())
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        block = name not in _INLINE
        if block:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if elements[open_[depth]].name == name:
                    if not block and cut(open_[depth]):
                        flush()
                    close(depth)
                    break
                # an inline end tag does not end the block that it stands in
                if not block and elements[open_[depth]].name not in _INLINE:
                    break
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            if not m[3].endswith("/") or name not in ("svg", "math"):
                stop = _RAW[name].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if block:
            if name in _ENDS:
                close_to(tuple(_ENDS[name][0].split()), _ENDS[name][1])
            close_to(("p",), _HOLDERS)
        elif name == "a":
            close_to(("a",), _HOLDERS)
        above = elements[open_[-1]]
        zone = _zone(name, m[3], above.zone, articles > 0) if block or m[3] else above.zone
        if not block and zone < 0 <= above.zone:
            flush()
        elements.append(Element(name, open_[-1], above.depth + 1, zone))
        named |= zone == 1 and name in ("article", "main")
        open_.append(len(elements) - 1)
        in_link += name == "a"
        articles += name in ("article", "main")
    if at < len(page):
        # a tag that never ends is no text
        rest = re.search(r"<[A-Za-z/!?]", page[at:])
        text.append(page[at:] if not rest else page[at : at + rest.start()])
    flush()
    return found, elements, named


def cost(block: Block, zone: int, named: bool) -> float:
    """How much dearer it is to call this block boilerplate than content; negative if content is the dearer label."""
    if zone < 0:
        return AWAY
    words = len(block.text.split())
    dense = block.linked / len(block.text)
    out = ARTICLE if zone else OUTSIDE if named else NEUTRAL
    out += LINKED * dense * (0.3 if zone else 1.0)
    out += WORDS * min(1.0, words / 30)
    if block.text[-1] in ".!?:;\"')»”…。":
        out += SENTENCE
    elif words < 5 and block.name != "p" and block.name not in _HEADING:
        out += SHORT
    if block.name == "h1":
        out += TITLE
    if words < 40 and re.match(r"(©|\(c\)|copyright\b|all rights reserved)", block.text, re.I):
        out += RIGHTS
    return out


def hops(elements: list[Element], a: int, b: int, most: int = 8) -> int:
    """Steps in the tree between two elements, at most `most`."""
    steps = 0
    while a != b and steps < most:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].above
        else:
            b = elements[b].above
        steps += 1
    return steps


def smoothness(found: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between each block and the next one beside it under one element of the tree."""
    edges, last = [], {}
    for k, block in enumerate(found):
        if k:
            edges.append((k - 1, k, ADJACENT + CLOSE / (1 + hops(elements, found[k - 1].element, block.element))))
        above = elements[block.element].above
        if above in last and last[above] < k - 1:
            edges.append((last[above], k, SIBLING))
        last[above] = k
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut: costs are capacities from the source (positive) or to the sink (negative).

    A node whose cost outweighs all its edges has its label in every minimum cut, so it is settled and its
    edges become costs of its neighbours; only what is left goes through augmenting paths, shortest first.
    """
    n, costs = len(costs), list(costs)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        beside[a][b] = beside[a].get(b, 0.0) + w
        beside[b][a] = beside[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(costs[k]) >= sum(beside[k].values()):
            label[k] = costs[k] > 0
            for other, w in beside[k].items():
                costs[other] += w if label[k] else -w
                del beside[other][k]
                todo.append(other)
            beside[k] = {}
    left = [k for k in range(n) if label[k] is None]
    if left:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {k: dict(beside[k]) for k in left} | {source: {}, sink: {}}
        for k in left:
            if costs[k] > 0:
                room[source][k], room[k][source] = costs[k], 0.0
            else:
                room[k][sink], room[sink][k] = -costs[k], 0.0
        while (reached := _augment(room, source, sink)) is None:
            pass
        for k in left:
            label[k] = k in reached
    return [bool(x) for x in label]


def _augment(room: dict[int, dict[int, float]], source: int, sink: int) -> set[int] | None:
    """Push flow along all shortest paths of the residual graph; the nodes that the source still reaches once there is no path."""
    level = {source: 0}
    queue = deque([source])
    while queue:
        k = queue.popleft()
        for other, w in room[k].items():
            if w > 1e-12 and other not in level:
                level[other] = level[k] + 1
                queue.append(other)
    if sink not in level:
        return set(level)
    onward = {k: [o for o in room[k] if level.get(o, 0) == level[k] + 1] for k in level}
    path = [source]
    while path:
        k = path[-1]
        if k == sink:
            flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
            for a, b in zip(path, path[1:], strict=False):
                room[a][b] -= flow
                room[b][a] += flow
            path = [source]
            continue
        while onward[k] and room[k][onward[k][-1]] <= 1e-12:
            onward[k].pop()
        if onward[k]:
            path.append(onward[k][-1])
        else:
            path.pop()
            if path:
                onward[path[-1]].pop()
    return None


def main_text(page: str | None) -> str:
    """The blocks labelled content, joined by one space; empty for a null or empty page and one without content."""
    if not page:
        return ""
    found, elements, named = blocks(page)
    kept = minimum_cut([cost(b, elements[b.element].zone, named) for b in found], smoothness(found, elements))
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (columns page_id, url, html).

    Null and empty pages and pages without content have an empty text; a page without markup is one block. Whole pages
    are read, however long. Rows that repeat and null ids stay; other columns are not looked at. No pages give no rows.
    """
    prepare(pages.sparkSession)
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all `pages`. See `extract`."""
    return extract(table(spark, sf_dir, "pages"))
