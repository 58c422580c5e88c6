"""HTML extraction by consensus of hosts.

Each page's containers are scored by the text they hold outside links and boilerplate;
the page votes for the tag-class path of its best one, with digits generalised.  Spark
counts the votes per host, and each page is extracted again from the containers with
its host's winning path; a page without that path uses its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.functions.spread import spread
from cinderglass.llm import words as W
from cinderglass.llm.shared import map_rows, stash, table, unused

#: Winning paths are broadcast up to this many bytes, else joined.
BROADCAST_BYTES = 32 << 20
#: Pages that are held as Python objects at a time, in bytes.
PIECE_BYTES = 1 << 20
#: Share of a page's own content that its host's path must hold to be used on it.
COVER = 0.95

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[-_]+")

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BOX = {"html", "body", "article", "main", "section", "div", "td", "table", "tr", "tbody", "center"}
_DROP_TAGS = set("head nav footer aside form menu svg math button select option canvas object audio video dialog label input script style".split())
_DROP_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
_DROP_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "form", "menu"}
#: Parts of a class name that say an element is beside, or lacks, what the rest names.
_MODIFIERS = set("has no not with without is show hide off free less".split())
#: A start tag on the left ends an open element on the right.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDS = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}


#: Between the steps of a path; no class name holds it.
_STEP = "\x1f"


class _Node:
    """An element.  ``path`` numbers its path within the page, ``box`` is the nearest container above."""

    __slots__ = ("tag", "path", "step", "drop", "up", "box", "above", "in_article", "in_heading", "text", "heavy", "held")

    def __init__(self, tag: str, step: str, path: int, drop: bool, up: _Node | None):
        self.tag, self.step, self.path, self.drop, self.up, self.box, self.text, self.heavy, self.held = tag, step, path, drop, up, tag in _BOX or up is None, 0, None, False
        self.above = None if up is None else up if up.box else up.above
        self.in_article = tag == "article" or up is not None and up.in_article
        self.in_heading = tag in _HEADING or up is not None and up.in_heading

    def shown(self) -> str:
        """The path in full: tags and generalised classes from the root down."""
        steps, node = [], self
        while node.up:
            steps.append(node.step)
            node = node.up
        return _STEP.join(reversed(steps))


def _names_boilerplate(value: str) -> bool:
    """Whether a class or id value has a name that begins or ends with a word for boilerplate."""
    for name in value.lower().split():
        words = _SPLIT.split(name)
        if _DROP_NAMES.intersection((words[0], words[-1])) and not _MODIFIERS.intersection((words[0], words[-1])):
            return True
    return False


class _Page:
    """Text blocks with their link characters and element, and all elements in page order.

    ``named`` are the elements dropped for their class or id alone, ``lost`` the text in
    them; elements whose number is in ``spared`` are not dropped for it.
    """

    def __init__(self, spared: set[int]):
        self.spared, self.named, self.lost, self.bodies, self.own_body = spared, {}, 0, [], False
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes = [_Node("", "", 0, False, None)]
        self.blocks: list[tuple[str, int, _Node]] = []

    def open(self, tag: str, attrs: str, up: _Node) -> _Node:
        step, drop, named = tag, up.drop or tag in _DROP_TAGS or tag == "header" and not up.in_article, False
        for m in _ATTR.finditer(attrs or ""):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                step += "." + ".".join(sorted(_DIGITS.sub("#", value.lower()).split()))
                named = named or tag not in ("body", "html", "article", "main") and _names_boilerplate(value)
            elif key == "hidden" or key == "role" and value.lower() in _DROP_ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
                drop = True
        named = named and not drop and len(self.nodes) not in self.spared
        node = _Node(tag, step, self.paths.setdefault((up.path, step), len(self.paths) + 1), drop or named, up)
        if named:
            self.named[node] = len(self.nodes)
        if tag in ("article", "main"):
            self.bodies.append(node)
            self.own_body |= not node.drop
        self.nodes.append(node)
        return node

    def number(self, path: str) -> int | None:
        """The number of a path given in full, or None if the page does not have it."""
        at = 0
        for step in path.split(_STEP):
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at


def blocks(page: str) -> _Page:
    """Read a page; again, where class names would drop its only article or all of its text."""
    read, spared = _read(page, set()), set()
    while read.named and (read.bodies and not read.own_body or not read.blocks and read.lost):
        tops = set()
        for node in read.bodies if read.bodies and not read.own_body else read.named:
            while node and node not in read.named:
                node = node.up
            tops.update([read.named[node]] if node else [])
        if not tops:
            break
        spared |= tops
        read = _read(page, spared)
    return read


def _read(page: str, spared: set[int]) -> _Page:
    read = _Page(spared)
    out, root = read.blocks, read.nodes[0]
    stack, held, linked = [root], [], 0
    count: dict[str, int] = {}

    def leave(k: int) -> None:
        for n in stack[k:]:
            count[n.tag] -= 1
        del stack[k:]

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1]))
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1].drop:
            read.lost += not raw.isspace()
        elif raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if any(n.tag == "a" for n in stack[-4:]):
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK:
                close()
            if count.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        leave(k)
                        break
                    if tag not in _BLOCK and stack[k].tag in _BLOCK:
                        break
            continue
        if tag == "br":
            if held:
                held.append(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _BLOCK:
            close()
            ends = _ENDS.get(tag, set()) | ({"p"} if tag in _P_ENDS else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    leave(i)
                    break
                if stack[i].box or stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        if tag in _VOID:
            continue
        if not (m[3] or "").rstrip().endswith("/") or tag in _BLOCK:
            stack.append(read.open(tag, m[3], stack[-1]))
            count[tag] = count.get(tag, 0) + 1
    close()
    return read


def _scored(page: str) -> _Page:
    """A page whose elements know how much text outside links, and of headings, they hold."""
    read = blocks(page)
    for text, linked, node in read.blocks:
        node.text += len(text) if node.in_heading else len(text) - linked
    for node in reversed(read.nodes[1:]):
        node.up.text += node.text
    return read


def best_path(page: str) -> str | None:
    """Path of the page's best container: the lowest one that holds all headings and text outside links."""
    return _lowest(_scored(page)).shown() or None


def _lowest(read: _Page) -> _Node:
    for node in read.nodes[1:]:
        if node.box and not node.drop and node.text > 0 and node.text >= node.above.text and node.above.heavy is None:
            node.above.heavy = node
    best = read.nodes[0]
    while best.heavy:
        best = best.heavy
    return best


def _hold(read: _Page, path: int) -> int:
    """Mark what is under a path; characters outside links, and of headings, there."""
    total = 0
    for node in read.nodes:
        inside = node.up is not None and node.up.held
        node.held = inside or node.path == path
        total += node.text if node.held and not inside else 0
    return total


def extract(page: str | None, path: str | None) -> str:
    """Text of the page's containers with a path, or of its best container."""
    if not page:
        return ""
    read = _scored(page)
    at = read.number(path) if path else None
    if at is None or _hold(read, at) < COVER * read.nodes[0].text:
        _hold(read, _lowest(read).path)
    return "\n\n".join(text for text, _, node in read.blocks if node.held)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.chunks(batch, "html", PIECE_BYTES):
            paths = [best_path(p) if p else None for p in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def _take(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.chunks(batch, "html", PIECE_BYTES):
                texts = [extract(p, w) for p, w in zip(piece.column("html").to_pylist(), piece.column(path).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*piece.schema.names, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` to ``pages(url, html)``.

    Input columns of these names are replaced.  Null and empty pages give an empty
    text; pages without a host share the empty host.  Of paths with equally many
    votes the longer one wins, then the last by name.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    votes = spread(pages.select(host.alias("host"), "html")).mapInArrow(_vote, "host string, path string")
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    best = counted.groupBy("host").agg(F.max(F.struct("votes", F.length("path").alias("long"), "path")).alias("best"))
    rest = pages.drop("text", "n_chars")
    key, path = unused(rest, "host"), unused(rest, "path")
    won = stash(best.select(F.col("host").alias(key), F.col("best.path").alias(path)), "paths")
    volume = won.agg(F.sum(F.octet_length(key) + F.octet_length(path) + 64)).first()[0] or 0
    joined = spread(rest).withColumn(key, host).join(F.broadcast(won) if volume <= BROADCAST_BYTES else won, key, "left").drop(key)
    return map_rows(joined, _take(path), "text string, n_chars long").drop(path)


def op7_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
