"""Main text of web pages: what a site repeats on its pages goes, the article stays.

Each page becomes a tree of block elements. Every subtree of the part that holds the article gets a
hash, Spark counts the hashes for each host, and subtrees that most of a host's pages share are
deleted as the site's template. What elements say of themselves (navigation, forms, adverts,
reader comments) needs no count.

A text that was published many times must not pass for a template. So only pages count whose
recurring text is the smaller part of them: on copies of one article nearly all of it recurs, on pages
that share a template little does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, lean, written

#: A template recurs on so many pages of a host at least, and on this part of those that count.
LEAST_PAGES, SHARE = 3, 0.5
#: Hashes on this part of a host's pages are looked at, so there are at most ten times a page's.
LOOK_SHARE = 0.1
#: A page counts if recurring blocks hold at most this part of its text.
MOST_RECURRING = 0.75

# Element names and role names of the HTML and ARIA standards.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What a start tag ends, by the standard's rules of omitted end tags, and the elements it looks within.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
DROPPED = frozenset("nav aside footer noscript template object svg canvas audio video select button dialog menu applet map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words within class and id that name what is not the article; those of the second set do so for article elements too.
NAMED = frozenset(
    "adv adbox adslot adunit adsense advertising banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer topbar toolbar pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall share sharing social recommended recommendations disqus respond replies widget widgets".split()
)
STRONG = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion comment comments related teaser".split())
#: Words within class and id that name the article, where no element does.
MAIN_NAMES = frozenset("article content post entry story main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<loose>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BESIDE = re.compile(r"\b(?:with|without|has|no)[-_]\w+", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_DIGEST_MASK = (1 << 63) - 1


class Node:
    """A block element. Children are nodes and runs of text; sums are made when it ends."""

    __slots__ = ("tag", "children", "dropped", "main", "size", "linked", "heading", "digest")

    def __init__(self, tag: str, dropped: bool = False, main: int = 0):
        self.tag, self.dropped, self.main = tag, dropped, main
        self.children: list[Node | str] = []
        self.size = self.linked = self.digest = 0
        self.heading = tag in HEADINGS

    def end(self) -> None:
        marks = [self.tag]
        for c in self.children:
            if isinstance(c, str):
                self.size += len(c)
                marks.append(c)
            else:
                marks.append(str(c.digest))
                self.heading = self.heading or c.heading
                if not c.dropped:
                    self.size += c.size
                    self.linked += c.linked
        self.digest = xxhash.xxh64_intdigest("\x00".join(marks).encode("utf-8", "replace"))


def _judge(tag: str, rest: str) -> tuple[str, bool, bool, int]:
    """What an element is taken for, whether it is dropped, surely or unless it holds the article, and
    how strongly it is called the article."""
    main = 3 if tag == "article" else 2 if tag == "main" else 0
    if tag in DROPPED:
        return tag, True, False, 0
    soft = tag == "form"
    if not rest or rest.isspace():
        return tag, False, soft, main
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id"):
            words.update(w.lower() for w in _WORDS.findall(_BESIDE.sub(" ", value)))
        elif name == "role":
            role = value.strip().lower()
            if role in ROLES:
                return tag, True, False, 0
            main = max(main, {"main": 2, "article": 3}.get(role, 0))
        elif name == "itemprop" and value == "articleBody":
            main = max(main, 3)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return tag, True, False, 0
    if words & STRONG or main < 2 and words & NAMED:
        return tag, False, True, 0
    if words & {"header", "masthead"} and tag in ("div", "section"):
        return "header", False, soft, 0
    return tag, False, soft, main or (1 if words & MAIN_NAMES and tag in ("div", "section") else 0)


def parse(source: str) -> Node:
    """The tree of a page's block elements. Broken markup ends what it must; nothing is an error."""
    root = Node("html")
    #: Open elements: name, the block they belong to, whether they hide their text, whether they are that block.
    stack: list[tuple[str, Node, bool, bool]] = [("html", root, False, True)]
    run: list[str] = []
    hiding = links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            stack[-1][1].children.append(text)
            stack[-1][1].linked += min(linked, len(text))
        linked = 0

    def close(depth: int) -> None:
        nonlocal hiding, links
        while len(stack) > depth:
            name, node, hides, own = stack[-1]
            if own:
                flush()
                node.end()
            stack.pop()
            hiding -= hides
            links -= name == "a"

    def close_nearest(names: set[str], within) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                return close(depth)
            if stack[depth][0] in within:
                return None
        return None

    def read(piece: str) -> None:
        nonlocal linked
        if piece and not hiding:
            run.append(piece)
            linked += len(piece) if links else 0

    at = 0
    while at < len(source):
        sign = source.find("<", at)
        read(html.unescape(source[at:] if sign < 0 else source[at:sign]))
        if sign < 0:
            break
        hit = _TOKEN.match(source, sign)
        if hit is None:
            read("<")
            at = sign + 1
            continue
        at = hit.end()
        if hit["cdata"]:
            read(hit["cdata"])
        if hit["end"]:
            name = hit["end"].lower()
            if name in BLOCKS:
                if not hiding:
                    flush()
                close_nearest({name}, ())
            elif name not in ("html", "body"):
                if name in ("td", "th"):
                    read(" ")
                close_nearest({name}, BLOCKS)
            continue
        name, rest = (hit["start"] or hit["loose"] or "").lower(), hit["rest"] or ""
        if name in RAW:
            end = _RAW_ENDS[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        if not name or name in ("html", "head", "body"):
            continue
        if name in ("br", "td", "th", "hr"):
            read(" ")
        if name in BLOCKS:
            close_nearest({"p"}, BLOCKS)
            if not hiding:
                flush()
        if name in CLOSES:
            close_nearest(*CLOSES[name])
        if name in VOID:
            continue
        kind, hides, soft, main = _judge(name, rest) if not hiding else (name, False, False, 0)
        own = not hiding and not hides and (name in BLOCKS or main > 1)
        if own:
            if name not in BLOCKS:
                flush()
            node = Node(kind, soft, main)
            stack[-1][1].children.append(node)
        else:
            # Inline elements can't hold the article: what names them as something else hides them.
            node, hides = stack[-1][1], hides or soft
        stack.append((name, node, hides, own))
        hiding += hides
        links += name == "a"
    close(0)
    return root


def _outermost(root: Node, level: int, within_dropped: bool) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.main >= level and node is not root:
            found.append(node)
            continue
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and (within_dropped or not c.dropped))
    return found


def article(root: Node) -> tuple[list[Node], str]:
    """The nodes that hold the article, in order, and "a" if the page marks them, else "o"."""
    for within_dropped in (False, True):
        for level in (3, 2):
            found = _outermost(root, level, within_dropped)
            if found:
                most = max(n.size for n in found)
                return [n for n in found if n.size * 4 >= most], "a"
    found = _outermost(root, 1, False)
    if found:
        return [max(found, key=lambda n: n.size)], "a"
    return [root], "o"


def _left(node: Node, zone: str) -> bool:
    if node.dropped:
        return False
    if node.tag == "header":
        return zone == "a" and node.heading
    return zone == "a" or node.heading or node.linked * 2 <= node.size


def _walk(nodes: list[Node], zone: str, gone: frozenset | set) -> Iterator[Node | str]:
    """Nodes and runs of text in page order, without what is dropped or has a digest in ``gone``."""
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if gone and mark(node, zone) in gone:
            continue
        yield node
        if isinstance(node, Node):
            stack.extend(c for c in reversed(node.children) if isinstance(c, str) or _left(c, zone))


def mark(node: Node | str, zone: str) -> int:
    """The digest of a subtree, told apart by zone, as a signed 64-bit number that is not negative."""
    digest = xxhash.xxh64_intdigest(node.encode("utf-8", "replace")) if isinstance(node, str) else node.digest
    return (digest ^ (0 if zone == "a" else 0x5A5A)) & _DIGEST_MASK


def subtrees(source: str) -> tuple[str, list[int], list[int]]:
    """The zone, digests and sizes of the subtrees that may be a template. Sizes are those of runs of
    text; elements have none, and those with a single child are told by that child."""
    nodes, zone = article(parse(source))
    found: dict[int, int] = {}
    for node in _walk(nodes, zone, frozenset()):
        if isinstance(node, str):
            found[mark(node, zone)] = found.get(mark(node, zone), 0) + len(node)
        elif len(node.children) > 1 and node not in nodes:
            found.setdefault(mark(node, zone), 0)
    return zone, list(found), list(found.values())


def main_text(source: str, templates: frozenset | set = frozenset()) -> str:
    """The article's blocks, one a line, without subtrees whose digests are in ``templates``."""
    nodes, zone = article(parse(source))
    return "\n".join(t for t in _walk(nodes, zone, templates) if isinstance(t, str))


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [subtrees(t.as_py() or "") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([z for z, _, _ in rows], pa.string()), pa.array([d for _, d, _ in rows], pa.list_(pa.int64())), pa.array([s for _, _, s in rows], pa.list_(pa.int64()))],
                ["host", "zone", "marks", "sizes"],
            )


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The recurring marks of pages that recur in their smaller part only."""
    for batch in batches:
        hosts, zones, found = [], [], []
        known: dict[bytes, np.ndarray] = {}
        for h, z, marks, sizes, again in zip(*batch.columns):
            raw = again.values.to_numpy()
            key = raw.tobytes()
            if key not in known:
                known[key] = np.sort(raw)
            look, mine, size = known[key], marks.values.to_numpy(), sizes.values.to_numpy()
            recurs = np.zeros(len(mine), bool)
            if len(look):
                recurs = look[np.minimum(np.searchsorted(look, mine), len(look) - 1)] == mine
            if size[recurs].sum() <= MOST_RECURRING * size.sum():
                hosts.append(h)
                zones.append(z)
                found.append(mine[recurs].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(zones, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["host", "zone", "marks"])


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, n_pages, marks): for every host its pages and the digests of its template.

    A subtree is looked at if ``LOOK_SHARE`` of a host's pages have it; pages count if such subtrees
    hold at most ``MOST_RECURRING`` of their text; of those, ``SHARE`` and at least ``LEAST_PAGES``
    must have the subtree. Pages that mark their article and pages that don't are counted apart.
    Pages without a host have no site and no template.
    """
    listed = written(pages.select(host(F.col("url")).alias("host"), F.col("html")).where(F.col("host") != "").mapInArrow(lean(_listed), "host string, zone string, marks array<long>, sizes array<long>"), "page-subtrees")

    def often(rows: DataFrame, share: float) -> DataFrame:
        """(host, marks) of subtrees on that share of a host's rows. Marks hold the zone, so one
        count for host and zone has those of all its pages, under the mark -1."""
        held = rows.select("host", "zone", F.explode(F.concat("marks", F.array(F.lit(-1).cast("long")))).alias("mark"))
        counted = held.groupBy("host", "zone", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
        every = counted.where(F.col("mark") == -1).select("host", "zone", F.col("n").alias("every"))
        kept = counted.where(F.col("mark") != -1).join(every, ["host", "zone"]).where(F.col("n") >= F.col("every") * share)
        return kept.groupBy("host").agg(F.collect_list("mark").alias("again"))

    sizes = listed.groupBy("host").agg(F.count("*").alias("n_pages"))
    looked = sizes.join(often(listed, LOOK_SHARE), "host", "left").select("host", "n_pages", F.coalesce("again", F.array().cast("array<long>")).alias("again"))
    looked = written(looked, "page-recurring")
    total = looked.agg(F.sum("n_pages")).first()[0] or 0
    weighed = hot_join(listed, looked, ["host"], "n_pages", total).select("host", "zone", "marks", "sizes", "again")
    counting = written(weighed.mapInArrow(lean(_weighed), "host string, zone string, marks array<long>"), "page-counting")
    found = sizes.join(often(counting, SHARE), "host", "left")
    return found.select("host", "n_pages", F.coalesce("again", F.array().cast("array<long>")).alias("marks"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[bytes, frozenset] = {}
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = []
            for source, marks in zip(part.column(2), part.column(3)):
                raw = marks.values.to_numpy() if marks.is_valid else np.zeros(0, np.int64)
                key = raw.tobytes()
                if key not in known:
                    known[key] = frozenset(raw.tolist())
                texts.append(main_text(source.as_py() or "", known[key]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; others don't matter).

    A block's white space is one space, blocks are lines in page order, character references are
    decoded. Null or empty html and pages without an article give an empty text. Rows without a
    usable url lose no template. Rows that repeat are rows of their own, and their text is no
    template. An empty table gives no rows. A page, however long, must fit a task.
    """
    templates = written(site_templates(pages), "page-templates")
    total = templates.agg(F.sum("n_pages")).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    sited = hot_join(rows.where(F.col("host") != ""), templates, ["host"], "n_pages", total)
    every = sited.select("page_id", "url", "html", "marks").unionByName(rows.where(F.col("host") == "").select("page_id", "url", "html", F.array().cast("array<long>").alias("marks")))
    return every.mapInArrow(lean(_extracted), "page_id long, url string, text string, n_chars long")
