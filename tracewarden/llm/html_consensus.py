"""Main text of web pages by paths that the pages of a host agree on.

Each page is read once as a list of open and close tags. Its containers are scored by the running
text they hold, links counting little; the deepest container that still holds most of it, widened
as long as its parent adds headings or running text, gets the page's vote. Votes are counted per host and generalised path (tags with classes and ids, digits
folded), and each page is then read again with its host's winning paths, best first. A page that
has none of them, or no text there, is read by its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and the like are left
out by tag, role, class and id; a class or id counts by its whole tokens, and not on a container that
holds most of the page's running text. A paragraph of running text whose class names but a topic
(`_TOPICS`) stays where the container around it is chosen. Character references are decoded, white space inside a block
becomes one space, blocks are joined in page order by a blank line; nothing else is dropped.

Nulls: null html is an empty page with empty text; a null url belongs to the host "". Repeated rows
vote like any other and give equal rows. Further columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import join_ids, stored

#: Share of a page's text that its voted container holds at least.
MOST = 0.7
#: Winning paths kept for a host, the best first.
PATHS = 3

#: A comment, a declaration, or a tag with its attributes: a name, and behind "=" a value with or without quotes. Only
#: a quote right behind "=" opens a value; any other is a letter like the rest.
_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+)*+)>)""", re.S
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand inside a line.
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks that hold running text and are no containers.
_TEXT = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption hr address details summary".split())
_DROPPED = set("head nav header footer aside form script style noscript template iframe button select option svg math canvas object audio video dialog menu textarea title input datalist map".split())
_ROLES = set("navigation banner contentinfo complementary search menu menubar dialog alertdialog form toolbar".split())
#: Parts of a class or id that name clutter, and such as only say where it stands.
_CLUTTER_PART = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|aside|cookie\w*|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"comments?|respond|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*|signup|login|search|widget\w*|pagination|pager|skip|toolbar|hidden|sr-only)\d*"
)
_PLACE_PART = r"(?:site|main|page|top|bottom|left|right|upper|lower|primary|secondary|global|mobile|desktop|post|posts|article|wp|block|box|bar|area|list|item|items|links?|wrap|wrapper|inner|section|form|buttons?|icons?|text|\d+)"
#: A whole token of a class or id: such parts only, one of them clutter.
_CLUTTER = re.compile(rf"(?:{_PLACE_PART}[_-]+)*{_CLUTTER_PART}(?:[_-]+(?:{_CLUTTER_PART}|{_PLACE_PART}))*[_-]*", re.I)
#: Names of clutter that a paragraph of running text may bear as its topic, and elements that are such paragraphs.
_TOPICS = {"social", "related", "share", "sharing", "search", "recommended"}
_PARAGRAPHS = {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a block from which on it counts as running text beside a container.
RUNNING = 5
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that an implied end does not pass.
_FENCE = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body"}
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("parent", "tag", "name", "dropped", "link", "weight", "marks", "topic")

    def __init__(self, parent: "Node | None", tag: str, name: str, dropped: bool, marked: bool = False, topic: bool = False):
        #: whether its class or id may be the topic of a paragraph
        self.topic = topic
        self.parent, self.tag, self.name, self.dropped = parent, tag, name, dropped
        #: the elements around and including this one whose class or id names clutter
        self.marks = (() if parent is None else parent.marks) + ((self,) if marked else ())
        self.link = tag == "a" or (parent is not None and parent.link)
        self.weight = 0.0

    def path(self) -> str:
        names, at = [], self
        while at.parent is not None:
            names.append(at.name)
            at = at.parent
        return "/".join(reversed(names))


def _node(parent: Node, tag: str, raw: str) -> Node:
    if not raw or raw == "/":
        return Node(parent, tag, tag, parent.dropped or tag in _DROPPED)
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
    cls, ident = attrs.get("class", ""), attrs.get("id", "")
    dropped = parent.dropped or tag in _DROPPED or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
    marked = topic = False
    if not dropped and tag not in ("html", "body"):
        named = [x.lower() for x in (*cls.split(), *ident.split()) if _CLUTTER.fullmatch(x)]
        marked, topic = bool(named), tag in _PARAGRAPHS and _TOPICS.issuperset(named)
        dropped = (marked and tag in _INLINE) or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None
    name = tag + "".join(f".{_DIGITS.sub('0', c)}" for c in sorted(set(cls.split()))) + (f"#{_DIGITS.sub('0', ident)}" if ident else "")
    return Node(parent, tag, name, dropped, marked and not dropped, topic)


def blocks(page: str) -> list[tuple[Node, str, int, bool]]:
    """(container, text, characters in links, whether in a heading) of each block outside the clutter."""
    found = list(_blocks(page))
    total, marked = 0.0, {}
    for node, text, linked in found:
        w = _running(text, linked)
        total += w
        for x in node.marks:
            marked[x] = marked.get(x, 0.0) + w
    clutter = {x for x, w in marked.items() if w < MOST * total}
    out = []
    for node, text, linked in found:
        hit = clutter.intersection(node.marks)
        if not hit:
            out.append((_container(node), text, linked, _heading(node)))
        elif all(x.topic for x in hit) and _is_running(text, linked):
            # it stays if the container around it is chosen, and has no say in the choice: it counts as all links
            out.append((_container(node), text, len(text), False))
    return out


def _running(text: str, linked: int) -> float:
    return max(0.0, len(text) - 1.5 * linked) + 0.01


def _is_running(text: str, linked: int) -> bool:
    return 2 * linked < len(text) and len(text.split()) >= RUNNING


def _heading(node: Node) -> bool:
    while node.parent is not None and (node.tag in _INLINE or node.tag in _TEXT):
        if node.tag in _HEADINGS:
            return True
        node = node.parent
    return False


def _blocks(page: str) -> Iterator[tuple[Node, str, int]]:
    """(innermost element, text, characters in links) of each block that no tag, role or style drops."""
    root = Node(None, "", "", False)
    stack, parts, linked = [root], [], 0
    at, n = 0, len(page)

    def text(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and not top.dropped:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if top.link:
                linked += len(raw)

    def close(upto: int) -> None:
        del stack[upto:]

    while True:
        m = _TAG.search(page, at)
        text(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        block = tag not in _INLINE
        if block or tag == "br":
            if tag == "br":
                parts.append(" ")
            elif parts:
                joined = " ".join("".join(parts).split())
                if joined:
                    yield stack[-1], joined, linked
                parts, linked = [], 0
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            continue
        if tag in _VOID:
            continue
        if block:
            p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in _FENCE), 0)
            if p and stack[p].tag == "p":
                close(p)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSED_BY.get(tag, ()):
                    close(k)
                elif stack[k].tag in _FENCE:
                    break
        if tag in ("body", "html"):
            close(1 if tag == "html" else next((k + 1 for k, x in enumerate(stack) if x.tag == "html"), 1))
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if not m[3].endswith("/") or block:
            stack.append(_node(stack[-1], tag, m[3].strip()))
    joined = " ".join("".join(parts).split())
    if joined:
        yield stack[-1], joined, linked


def _container(node: Node) -> Node:
    while node.parent is not None and (node.tag in _INLINE or node.tag in _TEXT):
        node = node.parent
    return node


def best_container(found: list[tuple[Node, str, int, bool]]) -> Node | None:
    """The deepest container that holds most of the page's running text, and what stands around it."""
    total = 0.0
    for node, text, linked, _ in found:
        w = _running(text, linked)
        total += w
        while node is not None:
            node.weight += w
            node = node.parent
    best, depth = None, -1
    for node, *_ in found:
        while node is not None and node.weight < MOST * total:
            node = node.parent
        d, at = 0, node
        while at is not None:
            d, at = d + 1, at.parent
        if d > depth:
            best, depth = node, d
    # up to the nearest container around it that adds a heading or running text, and on from there
    inside = {id(best)}
    at = best
    while at is not None and at.parent is not None:
        at = at.parent
        inside.add(id(at))
    wide = [(node, text) for node, text, linked, heading in found if heading or _is_running(text, linked)]
    for node, _ in wide:
        up, chain = node, []
        while up is not None:
            chain.append(up)
            up = up.parent
        if not any(x is best for x in chain):
            best = next(x for x in chain if id(x) in inside)
    return best


def vote(page: str) -> tuple[str, float] | None:
    """Path and weight of a page's best container."""
    node = best_container(blocks(page))
    return None if node is None else (node.path(), node.weight)


def main_text(page: str, paths: list[str]) -> str:
    """Text under the first of the given paths that the page has, else under its own best container."""
    found = blocks(page)
    if not found:
        return ""
    lines: dict[int, list[Node]] = {}
    for k, (node, *_) in enumerate(found):
        lines[k] = []
        while node is not None:
            lines[k].append(node)
            node = node.parent
    named: dict[int, str] = {}
    for chain in lines.values():
        for node in chain:
            if id(node) not in named:
                named[id(node)] = node.path()
    for path in paths:
        kept = [text for k, (_, text, *_) in enumerate(found) if any(named[id(x)] == path for x in lines[k])]
        if kept:
            return "\n\n".join(kept)
    best = best_container(found)
    return "\n\n".join(text for k, (_, text, *_) in enumerate(found) if any(x is best for x in lines[k]))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def winners(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """host and its winning paths, best first: by votes, then by the text behind them."""

    def run(batches):
        for b in batches:
            got = [(h, *v) for h, page in zip(b.column("host").to_pylist(), b.column("html")) if (v := vote(page.as_py() or ""))]
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["host", "path", "weight"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, weight double")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("weight")).alias("weight"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("weight"), "path")
    ranked = votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths)
    listed = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("p"))
    return listed.select("host", F.col("p.path").alias("paths"))


def extract(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """page_id, url and text of every page.

    The table of winners is counted: while small it is sent to the executors, so that no html is
    shuffled; beyond that the pages are joined by host, where Spark splits hot hosts.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                texts = [main_text(page.as_py() or "", won or []) for page, won in zip(part.column("html"), part.column("paths").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    won = stored(winners(pages, paths), "html-paths")
    rows = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    rows = join_ids(rows, won, ["host"], "left").select("page_id", "url", "html", "paths")
    return rows.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string"))
