"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree. Its nodes are block elements, told by
the tags and classes on their path (no ids, no digits, so that ``post-12`` and
``post-13`` meet). Spark counts, for each node of a host,

- how many pages have it and in which child sequences: with H the entropy of
  these sequences, its *presentation importance* is 1 - exp(-H), 0 if all pages
  agree and near 1 if each differs;
- its texts and on how many pages each stands: a text on k of m pages has
  entropy log k / log(m + ``UNSEEN``), and the *content importance* of the node
  is one less the mean of these over its texts. ``UNSEEN`` stands for pages not
  seen: it makes the evidence of small hosts weak instead of switching it off.

Copies of an article are no evidence of a template, so k counts the pages that
differ in the rest: with each text the longest other text of its page and the
one of least hash are noted, and pages with the same two count once.

On a page the importances are put together up the branches: the content of a
branch is the mean over the texts below it, weighted by their lengths, and its
composite importance 1 - (1 - content)(1 - presentation). What elements and
class names say weighs in as a factor for all that is below them: nav, form,
footer and names such as ``sidebar`` a fifth, ambiguous names such as
``related`` a half. A branch is removed if it and all branches in it are below
``LEAST_IMPORTANCE``; html, body, main and article stay unless they are inside
such a branch. If a page has an article (or main) only texts in it count.

A null page, or an empty one, has empty text; a null url is a host of its own.
Repeated pages and ids keep a row each. An empty table gives no rows. Long
pages and deep nesting take linear time and memory. Only the named columns are
read, whatever else the table has; those in ``keep`` may have any other name
but ``text``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, map_batches

LEAST_IMPORTANCE = 0.3
#: Pages that a host is taken to have beyond those seen.
UNSEEN = 3
#: What elements and names that mark noise, and names that may, leave of the importance.
NOISE_FACTOR, DOUBT_FACTOR = 0.2, 0.5
#: Nodes of all hosts that are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 50_000

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NEVER = frozenset("head script style template noscript iframe nav footer aside form menu button select textarea label dialog svg canvas object audio video search option title".split())
STAYS = frozenset("html body main article".split())
#: Elements that end when one of the same kind begins inside the same parent.
ENDS_ITSELF = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
HOLDS = frozenset("table ul ol dl select div article section body td th".split())
#: Words of class names and ids that mark noise, that may mark it, and that say nothing beside them.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets toolbar share sharing footer footnav masthead topbar comment comments disqus".split()
)
DOUBT = frozenset("related recommended header aside rail social alert search skip hidden copyright disclaimer reply replies respond discussion".split())
NEUTRAL = frozenset("area bar block bottom box container global group inner item items left link links list main outer page primary right row secondary section site sticky top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: A tag may hold quoted values after ``=``; at the end of the page it may be unfinished. Each start is scanned once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if _TELLING.search(text) else {}


def hashed(value: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), seed & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def name_factor(names: str) -> float:
    """What the names of an element leave of its importance; a name counts if noise is all that it speaks of."""
    factor = 1.0
    for name in names.lower().split():
        parts = set(_PART.findall(name)) - NEUTRAL
        if parts and parts <= NOISE | DOUBT:
            factor = min(factor, NOISE_FACTOR if parts & NOISE else DOUBT_FACTOR)
    return factor


class Element:
    """A block or inline element; blocks are nodes of the tree and hold the figures of their branch."""

    __slots__ = ("tag", "node", "block", "parent", "factor", "article", "sequence", "size", "weight", "low_below", "out")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.parent = tag, parent.block if parent else None
        in_article = parent is not None and parent.article
        self.article = in_article or tag in ("article", "main") or attributes.get("role") in ("main", "article")
        own = 1.0
        if tag not in STAYS:
            if "class" in attributes or "id" in attributes:
                own = name_factor(attributes.get("class", "") + " " + attributes.get("id", ""))
            hides = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            if tag in NEVER or (tag == "header" and not in_article) or attributes.get("role") in ROLES or hides:
                own = NOISE_FACTOR
        self.factor = min(own, parent.factor) if parent else own
        if tag in BLOCKS:
            self.block = self
            label = " ".join([tag, *sorted({re.sub("[0-9]+", "", c) for c in attributes.get("class", "").split()})])
            self.node = hashed(label, self.parent.node if self.parent else 0)
            self.sequence = 0
            if self.parent:
                self.parent.sequence = hashed(label, self.parent.sequence)
        else:
            self.block = parent.block if parent else None
        self.size, self.weight, self.low_below = 0, 0.0, True
        #: Elements and names alone remove it.
        self.out = self.factor < LEAST_IMPORTANCE


def parse(page: str) -> tuple[list[Element], list[tuple[Element | None, str]]]:
    """The block elements in order (parents first) and the texts in order, each with the block that holds it."""
    found: list[Element] = []
    texts: list[tuple[Element | None, str]] = []
    stack: list[Element] = []
    ending: list[int] = []  # places in the stack of elements that may end others or shield them
    opened: Counter[str] = Counter()
    parts: list[str] = []
    holder: Element | None = None

    def pop_to(depth: int) -> bool:
        gone = stack[depth:]
        del stack[depth:]
        while ending and ending[-1] >= depth:
            ending.pop()
        for e in gone:
            opened[e.tag] -= 1
        return any(e.block is e for e in gone)

    def settle() -> None:
        nonlocal holder
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            texts.append((holder, text))
        holder = stack[-1].block if stack else None

    def add(text: str) -> None:
        # Text of an inline element that is noise is left out of its block.
        if stack and stack[-1].out and stack[-1].block is not stack[-1] and not (stack[-1].block and stack[-1].block.out):
            return
        parts.append(html.unescape(text) if "&" in text else text)

    at, end = 0, len(page)
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                if pop_to(depth):
                    settle()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            for place in reversed(ending):
                held = stack[place].tag
                if tag in ENDS_ITSELF.get(held, ()):
                    pop_to(place)
                    break
                if held in HOLDS:
                    break
        if tag in VOID:
            if tag in BLOCKS:
                settle()
            continue
        element = Element(tag, _attributes(m[3]), stack[-1] if stack else None)
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in ENDS_ITSELF or tag in HOLDS:
            ending.append(len(stack))
        stack.append(element)
        opened[tag] += 1
        if tag in BLOCKS:
            found.append(element)
            settle()
        elif element.out and not (holder and holder.out):
            parts.append(" ")
    if at < end:
        add(page[at:])
    settle()
    return found, texts


#: Of a node: content importance, presentation importance.
Importance = dict[int, tuple[float, float]]


def main_text(page: str, importance: Importance | None = None) -> str:
    """The texts that are left, joined by spaces, given the importances of the host's nodes (1 and 1 where they are not given)."""
    found, texts = parse(page)
    importance = importance or {}
    for holder, text in texts:
        if holder:
            holder.size += len(text)
            holder.weight += len(text) * importance.get(holder.node, (1.0, 1.0))[0]
    for e in reversed(found):
        content = e.weight / e.size if e.size else 1.0
        score = (1 - (1 - content) * (1 - importance.get(e.node, (1.0, 0.0))[1])) * e.factor
        e.out = e.out or (score < LEAST_IMPORTANCE and e.low_below and e.tag not in STAYS)
        if e.parent:
            e.parent.size += e.size
            e.parent.weight += e.weight
            e.parent.low_below &= e.out or not e.size
    for e in found:
        e.out |= e.parent is not None and e.parent.out
    kept = [(holder, text) for holder, text in texts if not (holder and holder.out)]
    if any(holder and holder.article for holder, _ in kept):
        kept = [(holder, text) for holder, text in kept if holder and holder.article]
    return " ".join(text for _, text in kept)


def host_of(url: str):
    """The host of a URL in lower case, empty if there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(found)


#: Rows of evidence: of a page (0), the sequence of children of a node (1), a text of a node with the rest of its page (2).
_PAGE, _CHILDREN, _TEXT = range(3)


def page_evidence(page: str) -> set[tuple[int, int, int, int]]:
    """(kind, node, value, rest) of one page."""
    found, texts = parse(page)
    rows = {(_PAGE, 0, 0, 0)} | {(_CHILDREN, e.node, e.sequence, 0) for e in found}
    hashes = [(holder, hashed(text), len(text)) for holder, text in texts if holder]
    other = {h: size for holder, h, size in hashes if not holder.out}
    least = nsmallest(2, other)
    longest = nsmallest(2, other, key=lambda h: (-other[h], h))
    for holder, h, _ in hashes:
        rest = [next((x for x in two if x != h), h) for two in (longest, least)]
        rows.add((_TEXT, holder.node, h, hashed("", rest[0] ^ rest[1] * 3)))
    return rows


def style_tree(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """``host``, ``node`` (a hash of its path), ``pages`` of the host, ``node_pages``, ``content`` and ``presentation`` importance (content is null without texts)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple] = Counter()
        for host, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen.update((host, *row) for row in page_evidence(body.as_py()))
        columns = [*zip(*seen), list(seen.values())]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "kind", "node", "value", "rest", "n"])

    rows = map_batches(pages.select(host_of(url).alias("host"), F.coalesce(F.col(page), F.lit("")).alias("html")), run, "host string, kind int, node long, value long, rest long, n long")
    rests = rows.groupBy("host", "kind", "node", "value", "rest").agg(F.sum("n").alias("n"))
    values = rests.groupBy("host", "kind", "node", "value").agg(F.sum("n").alias("n"), F.count("*").alias("rests"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    log = F.when(F.col("kind") == _TEXT, F.log("rests")).otherwise(F.log("n"))
    nodes = values.groupBy("host", "node").agg(
        of(_PAGE, F.col("n")).alias("pages"), of(_CHILDREN, F.col("n")).alias("node_pages"), of(_CHILDREN, F.col("n") * log).alias("child_logs"), of(_TEXT, F.col("n")).alias("texts"), of(_TEXT, F.col("n") * log).alias("text_logs")
    )
    nodes = cut(nodes)
    sizes = nodes.where("pages is not null").select("host", "pages")
    joined = nodes.where("pages is null").drop("pages").join(sizes, "host")
    # On one page a node may have two sequences, so that n adds up to more than its pages; as weights they are right.
    diversity = F.log("node_pages") - F.col("child_logs") / F.col("node_pages")
    content = 1 - F.col("text_logs") / F.col("texts") / F.log(F.col("pages") + UNSEEN)
    return joined.select("host", "node", "pages", "node_pages", content.alias("content"), (1 - F.exp(-diversity)).alias("presentation"))


def telling_nodes(tree: DataFrame) -> DataFrame:
    """For each host with a node of doubtful content: an array of its frequent nodes.

    A node of low content has texts on (pages + UNSEEN)^(1 - importance) pages,
    so rarer nodes need not be known; with b nodes on a page and m pages, at
    most b * m^0.6 are left.
    """
    doubtful = LEAST_IMPORTANCE / DOUBT_FACTOR
    frequent = tree.where(F.col("node_pages") >= F.pow(F.col("pages") + UNSEEN, F.lit(1 - doubtful)))
    some = F.struct("node", F.coalesce("content", F.lit(1.0)).alias("content"), "presentation")
    hosts = frequent.groupBy(F.col("host").alias("low host")).agg(F.min("content").alias("least"), F.collect_list(some).alias("nodes"))
    return hosts.where(F.col("least") < doubtful).drop("least")


def extract_main_text(pages: DataFrame, page: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text``, the main text of each page."""
    low = cut(telling_nodes(style_tree(pages, page, url)))
    nodes = low.agg(F.sum(F.size("nodes"))).first()[0] or 0
    side = F.broadcast(low) if nodes <= BROADCAST_NODES else low
    rows = pages.select(*(F.col(f"`{c}`").alias(f"kept {k}") for k, c in enumerate(keep)), host_of(url).alias("host of page"), F.coalesce(F.col(page), F.lit("")).alias("page"))
    rows = rows.join(side, F.col("host of page") == F.col("low host"), "left").select(*(f"`kept {k}`" for k in range(len(keep))), "page", "nodes", "low host")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Importance] = {None: {}}
        texts = []
        for k, host in enumerate(batch.column(len(keep) + 2).to_pylist()):
            if host not in known:
                known = {None: {}, host: {x["node"]: (x["content"], x["presentation"]) for x in batch.column(len(keep) + 1)[k].as_py()}}
            texts.append(main_text(batch.column(len(keep))[k].as_py(), known[host]))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    ddl = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, run, f"{ddl}, text string")
