"""Main-text extraction by wrapper induction.

1. A host's pages are told apart by *layout* (the set of their container tags
   and classes).  Each layout of ``MIN_PAGES`` pages or more has a *pattern*, and
   so has each host's most frequent one, which the pages of rarer layouts use.
   It is the page of the smallest id among those with the layout's fullest list
   of containers that ``MIN_PAGES`` pages share (else the most frequent list);
   empty pages don't count.  Its DOM is kept as a skeleton (labels, shape, and
   a digest and length of each node's own text).
2. Every page is aligned with its pattern by simple tree matching
   (Yang): the children of two nodes with equal labels are matched in order so
   that the number of matched nodes is largest.  For each node of the pattern
   the matches, and those with the same text, are counted over all pages; the
   counts are added up inside a batch before the shuffle, so a host with a
   third of all pages sends a few numbers from each task.
3. Nodes whose text is the same on ``CONSTANT`` of at least ``MIN_PAGES`` pages
   are *template*, the others are *slots*.  The main slot is the node below
   which the slots' text lies; elements that never hold an article (menus,
   footers, forms, ...) are told by their tag, role and class, inside articles
   only by classes and ids that consist of such words ("comments", "ad-box"),
   so "related-work" and other slugs stay; headings always do.
4. A page's text is what it holds where the alignment puts the main slot,
   without template blocks and without such elements (a repeated word inside a
   varying block belongs to its text).  Pages that the pattern
   does not cover or is too bare for, and hosts where nothing varies (a page alone, or copies of
   one page), are read by the same rule from their own tree.

A block is the text between two block-level tags.  Character references are
decoded, white space becomes one space, blocks are joined by a line feed.

Skeletons are broadcast only when measured to fit ``BROADCAST_BYTES``, the list
of pattern pages only when counted to fit ``BROADCAST_HOSTS``; beyond, the joins
are Spark's choice and adaptive execution splits a hot host.

Defined results: null and empty html give the empty text; unclosed and
misplaced tags are repaired as browsers do for paragraphs and lists; elements
may be nested, and lists may be long, without bound (nothing recurses, and long
lists are aligned exactly); a quote belongs to a tag only after ``=``; null urls
form one host; repeated rows are read alike; an empty table gives no rows;
extra columns pass through.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, named, shared
from ledgerlake.llm.url_filter import host_of

CONSTANT = 0.9
MIN_PAGES = 10
MAIN_SHARE = 0.6
BROADCAST_BYTES = 32 << 20
# Layouts (a name and three numbers each) up to which the list of their pattern pages is broadcast.
BROADCAST_HOSTS = 200_000
# Products of child counts from which rows of the alignment are computed by numpy (the result is the same).
WIDE = 1_024

# As browsers read tags: a quote opens a value only after ``=``.
_VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)"
                    rf"((?:[^>=]++|{_VALUE})*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>=]+)\s*(?:{_VALUE.replace('(?:', '(', 1)})?")
_TELLING = re.compile("class|id|role|hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
# An opening tag of the key closes an open element of the value, up to the nearest scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article main section div table ul ol dl td th nav aside header footer form blockquote".split())
DROP_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea "
                      "title menu dialog object canvas audio video".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog".split())
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
                       "banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup menu nav "
                       "navbar navigation breadcrumb breadcrumbs sidebar widget footer masthead comment comments "
                       "reply replies disqus respond related recommended share sharing social toolbar pagination "
                       "pager login".split())
# Words that say where something stands; an id, or a class inside an article, tells only by words of these two kinds.
PLACE_WORDS = frozenset("area bar block bottom box col column container content footer global group head header holder "
                        "inner item items left links list main outer page panel primary right row secondary section "
                        "site slot top unit widget wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section center table tbody tr td span".split())
MAIN = frozenset(("article", "main"))
_CONTAINER = r"(?i)<(?:article|aside|div|footer|form|header|main|nav|section|table)\b[^>]*"
_CLASS = r"""(?i)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


class Node:
    """An element: label for the alignment, whether it is dropped, its texts and elements in order."""

    __slots__ = ("tag", "label", "dropped", "parent", "inside", "items", "number", "shape", "size", "mass", "digest")

    def __init__(self, tag: str, label: str, dropped: bool, parent: Node | None) -> None:
        self.tag, self.label, self.dropped, self.parent = tag, label, dropped, parent
        self.inside = tag in MAIN or (parent is not None and parent.inside)      # of an article
        self.items: list[str | Node] = []
        self.number = self.shape = self.size = self.mass = self.digest = 0

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if type(x) is Node]


@lru_cache(maxsize=20_000)
def _described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's label, and whether it is dropped: anywhere, or at least outside of articles."""
    label, anywhere, outside = tag, tag in DROP_TAGS, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            label = f"{tag}.{value}"
        if name == "role":
            anywhere |= value in DROP_ROLES
        elif name in ("hidden", "aria-hidden"):
            anywhere |= name == "hidden" or value == "true"
        elif name in ("class", "id") and tag not in HEADINGS:
            for token in value.split():
                words = set(re.findall("[a-z0-9]+", token))
                told = not DROP_WORDS.isdisjoint(words)
                anywhere |= told and words <= DROP_WORDS | PLACE_WORDS
                outside |= told and name == "class"
    return label, anywhere, outside


def _node(tag: str, attributes: str, parent: Node) -> Node:
    label, dropped, outside = _described(tag, attributes if _TELLING.search(attributes) else "")
    told = dropped
    if (outside or tag == "header") and not dropped:
        dropped = not parent.inside
    if tag in ("html", "body", "main") or (tag == "article" and not told):
        dropped = False
    return Node(tag, label, dropped, parent)


def parse(source: str) -> Node:
    """The tree of a page below one root, unclosed elements closed."""
    root = here = Node("#root", "#root", False, None)
    opened: Counter[str] = Counter()         # tags of the open elements: no search for what is not open
    at, end = 0, len(source)

    def up_to(node: Node) -> Node:
        """Closes the open elements below ``node``."""
        step = here
        while step is not node:
            opened[step.tag] -= 1
            step = step.parent
        return node

    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                here.items.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = up_to(up.parent)
            continue
        if tag in BLOCK and opened["p"]:
            here = up_to(_close(here, ("p",)))
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            here = up_to(_close(here, CLOSES[tag]))
        node = _node(tag, m[3], here)
        here.items.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            node.items.append(source[at:stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        opened[tag] += 1
        here = node
    return root


def _close(here: Node, tags: tuple[str, ...]) -> Node:
    """Where to go on after closing the nearest open element of these tags inside the present scope."""
    up = here
    while up.parent is not None and up.tag not in tags:
        if up.tag in SCOPE and up.tag not in ("td", "th"):
            return here
        up = up.parent
    return up.parent if up.parent is not None else here


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


_shapes: dict[tuple, int] = {}
_sizes: list[int] = []
_weights: dict[tuple[int, int], int] = {}
_kids: list[tuple[str, tuple[int, ...]]] = []


def _shape(label: str, kids: tuple[int, ...]) -> int:
    """A number for each different tree of labels; forgotten when too many are known."""
    key = (label, kids)
    if key not in _shapes:
        _shapes[key] = len(_sizes)
        _sizes.append(1 + sum(_sizes[k] for k in kids))
        _kids.append(key)
    return _shapes[key]


def forget() -> None:
    """Bounds the memory that shapes take; called between pages only."""
    if len(_sizes) > 50_000 or len(_weights) > 500_000:
        _shapes.clear(), _sizes.clear(), _weights.clear(), _kids.clear()
        _skeletons.clear()


def _ends(a: Sequence[int], b: Sequence[int]) -> tuple[int, int]:
    """How many entries agree from the front, and of the rest from the back."""
    least, lo, hi = min(len(a), len(b)), 0, 0
    while lo < least and a[lo] == b[lo]:
        lo += 1
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return lo, hi


def _pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions matched in order so that the matched trees' weights add up highest."""
    n, m = len(a), len(b)
    lo, hi = _ends(a, b)
    head = [(i, i) for i in range(lo)]
    tail = [(n - hi + i, m - hi + i) for i in range(hi)]
    a, b = a[lo:n - hi], b[lo:m - hi]
    if not a or not b:
        return head + tail
    inner = _few(a, b) if len(a) * len(b) < WIDE else _many(a, b)
    return head + [(i + lo, j + lo) for i, j in inner] + tail


def _few(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1)]
    for x in a:
        above, row = best[-1], [0]
        for j, y in enumerate(b, 1):
            row.append(max(above[j], row[-1], above[j - 1] + weight(x, y)))
        best.append(row)
    inner = []
    i, j = len(a), len(b)
    while i and j:
        w = weight(a[i - 1], b[j - 1])
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            inner.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return inner[::-1]


def _many(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The same for long lists: row by row, keeping every k-th row (k about the root of their number) and
    computing the rows between two kept ones again on the way back."""
    kinds = sorted(set(b))
    of = np.searchsorted(kinds, b)
    known: dict[int, np.ndarray] = {}

    def weights(x: int) -> np.ndarray:
        if x not in known:
            known[x] = np.array([weight(x, y) for y in kinds], dtype=np.int64)
        return known[x][of]

    def below(row: np.ndarray, x: int) -> np.ndarray:
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights(x)), out=out[1:])
        return out

    every = math.isqrt(len(a)) + 1
    row = np.zeros(len(b) + 1, dtype=np.int64)
    kept = [row]
    for i, x in enumerate(a, 1):
        row = below(row, x)
        if i % every == 0:
            kept.append(row)
    inner = []
    i, j = len(a), len(b)
    while i and j:
        start = (i - 1) // every * every
        rows = [kept[start // every]]
        for x in a[start:i]:
            rows.append(below(rows[-1], x))
        while i > start and j:
            here, above = rows[i - start], rows[i - start - 1]
            w = weight(a[i - 1], b[j - 1])
            if w and here[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                inner.append((i, j))
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return inner[::-1]


def weight(x: int, y: int) -> int:
    """Nodes matched by the simple tree matching of two shapes."""
    if x == y:
        return _sizes[x]
    (label, a), (other, b) = _kids[x], _kids[y]
    if label != other:
        return 0
    if not a or not b:
        return 1
    if (x, y) not in _weights:
        _weigh(x, y)
    return _weights[x, y]


def _weigh(x: int, y: int) -> None:
    """Weighs a pair of shapes after the pairs of their children, however deep: a stack instead of recursion."""
    stack = [(x, y)]
    while stack:
        x, y = stack[-1]
        if (x, y) in _weights:
            stack.pop()
            continue
        a, b = _kids[x][1], _kids[y][1]
        lo, hi = _ends(a, b)
        missing = [(p, q) for p in set(a[lo:len(a) - hi]) for q in set(b[lo:len(b) - hi]) if p != q and _kids[p][0] == _kids[q][0]
                   and _kids[p][1] and _kids[q][1] and (p, q) not in _weights]
        if missing:
            stack += missing
        else:
            _weights[x, y] = 1 + sum(weight(a[i], b[j]) for i, j in _pairs(list(a), list(b)))
            stack.pop()


def measure(root: Node) -> list[Node]:
    """Numbers the nodes in page order and sets shape, own text's length and digest; returns them."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(order)
        order.append(node)
        stack += reversed(node.children)
    for node in reversed(order):
        kids = node.children
        node.shape = _shape(node.label, tuple(k.shape for k in kids))
        own = clean(" ".join(x for x in node.items if type(x) is str)) if node.tag not in RAW else ""
        node.mass, node.digest = len(own), xxhash.xxh32_intdigest(own) if own else 0
    return order


def align(pattern: Node, page: Node) -> dict[int, Node]:
    """Nodes of the page by the number of the pattern's node that they match."""
    found, stack = {}, [(pattern, page)]
    while stack:
        a, b = stack.pop()
        found[a.number] = b
        ka, kb = a.children, b.children
        stack += [(ka[i], kb[j]) for i, j in _pairs([k.shape for k in ka], [k.shape for k in kb])]
    return found


def skeleton(source: str) -> str:
    """A page's tree as JSON: (parent, tag, label, dropped, mass, digest) of each node in page order."""
    return json.dumps([[n.parent.number if n.parent else -1, n.tag, n.label, int(n.dropped), n.mass, n.digest]
                       for n in measure(parse(source))], separators=(",", ":"))


_skeletons: dict[str, list[Node]] = {}


def from_skeleton(text: str) -> list[Node]:
    nodes = _skeletons.get(text)
    if nodes is None:
        nodes = []
        for parent, tag, label, dropped, mass, digest in json.loads(text):
            node = Node(tag, label, bool(dropped), nodes[parent] if parent >= 0 else None)
            node.number, node.mass, node.digest = len(nodes), mass, digest
            if node.parent is not None:
                node.parent.items.append(node)
            nodes.append(node)
        for node in reversed(nodes):
            node.shape = _shape(node.label, tuple(k.shape for k in node.children))
        if len(_skeletons) >= 256:
            _skeletons.clear()
        _skeletons[text] = nodes
    return nodes


def main_slot(nodes: list[Node], template: set[int]) -> Node:
    """The node that holds the slots' text: an article if there is one, else the deepest with most of it."""
    held = [0] * len(nodes)
    inside = [False] * len(nodes)
    for node in nodes:
        inside[node.number] = node.dropped or (node.parent is not None and inside[node.parent.number])
        if not inside[node.number] and node.number not in template:
            held[node.number] = node.mass
    for node in reversed(nodes):
        if node.parent is not None:
            held[node.parent.number] += held[node.number]
    here = nodes[0]
    while here.tag not in MAIN:
        kids = [k for k in here.children if not k.dropped and (k.tag in CONTAINERS or k.tag in MAIN)]
        best = max(kids, key=lambda k: (held[k.number], -k.number), default=None)
        if best is None or not held[best.number]:
            break
        alone = sum(1 for k in kids if k.tag == best.tag and held[k.number]) == 1
        if held[best.number] < MAIN_SHARE * held[here.number] and not (best.tag in MAIN and alone):
            break               # spread over several blocks, or over several articles
        here = best
    return here


def blocks(root: Node, without: set[int]) -> list[str]:
    """The texts of the blocks below a node in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = clean("".join(run))
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[str, Node | str | None]] = [("in", root)]
    while stack:
        step, x = stack.pop()
        if step == "out":
            flush()
        elif type(x) is str:
            run.append(x)
        elif x is not root and (x.dropped or x.number in without):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(("out", None))
            stack += [("in", y) for y in reversed(x.items)]
    flush()
    return out


def extract(source: str, pattern: str | None = None, counts: list[tuple[int, int, int]] = ()) -> str:
    """The main text of a page; ``counts`` has (node, pages, same) of its host's pattern."""
    root = parse(source)
    nodes = measure(root)
    slot, without = None, set()
    if pattern:
        model = from_skeleton(pattern)
        template = {n for n, pages, same in counts if pages >= MIN_PAGES and same >= CONSTANT * pages}
        main = main_slot(model, template)
        below = _below(model, main)
        fixed = sum(n.mass for n in below if n.number in template)
        if fixed * 2 > sum(n.mass for n in below):     # nothing to tell template from text by
            template, main = set(), main_slot(model, set())
        matched = align(model[0], root)
        slot = matched.get(main.number)
        if main.tag in ("#root", "html", "body") and len(nodes) > 2 * len(matched):      # too bare to tell
            slot = None
        without = {matched[n].number for n in template if n in matched and matched[n].digest == model[n].digest
                   and matched[n].mass and not matched[n].children and matched[n].tag in BLOCK}
    if slot is None or slot.dropped:
        slot = main_slot(nodes, set())
    return "\n".join(blocks(slot, without))


def _below(nodes: list[Node], top: Node) -> list[Node]:
    """``top`` and what is below it, of nodes in page order."""
    inside = {top.number}
    for node in nodes[top.number + 1:]:
        if node.parent.number in inside:
            inside.add(node.number)
    return [n for n in nodes if n.number in inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, node, pages, same) added up over each batch."""
    for batch in batches:
        pages, same = Counter(), Counter()
        for host, layout, source, pattern in zip(*(c.to_pylist() for c in batch.columns)):
            forget()
            model, root = from_skeleton(pattern), parse(source)
            measure(root)
            for number, node in align(model[0], root).items():
                if model[number].mass:
                    pages[host, layout, number] += 1
                    same[host, layout, number] += node.digest == model[number].digest
        keys = sorted(pages)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([k[2] for k in keys], pa.int32()),
             pa.array([pages[k] for k in keys], pa.int64()), pa.array([int(same[k]) for k in keys], pa.int64())],
            names=["host", "layout", "node", "pages", "same"])


def containers(source: Column) -> Column:
    """The container tags of a page with their classes, sorted; numbers in classes are taken as equal."""
    return F.array_sort(F.transform(
        F.regexp_extract_all(source, F.lit(_CONTAINER), F.lit(0)),
        lambda x: F.regexp_replace(F.lower(F.concat_ws(
            ".", F.regexp_extract(x, "[A-Za-z]+", 0), F.regexp_extract(x, _CLASS, 1))), "[0-9]+", "0")))


def pattern_pages(pages: DataFrame) -> DataFrame:
    """(host, layout, form, id, many, top) of the pages (host, layout, form, tags, id) that patterns are made of."""
    forms = pages.groupBy("host", "layout", "form").agg(F.count(F.lit(1)).alias("n"), F.max("tags").alias("tags"),
                                                        F.min("id").alias("id"))
    often = F.col("n") >= MIN_PAGES
    best = F.min(F.struct((~often).alias("rare"), F.when(often, -F.col("tags")).otherwise(-F.col("n")).alias("by"),
                          (-F.col("n")).alias("minus"), (-F.col("tags")).alias("less"), F.col("id").isNull().alias("none"),
                          "id", "form"))
    layouts = forms.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tags")).alias("tags"),
                                                  best.alias("best"))
    tops = layouts.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("minus"), (-F.col("tags")).alias("less"),
                                                      "layout")).alias("first"))
    return (layouts.join(tops.select("host", F.col("first.layout").alias("top")), "host")
            .select("host", "layout", "best.form", "best.id", (F.col("n") >= MIN_PAGES).alias("many"),
                    (F.col("layout") == F.col("top")).alias("top"))
            .filter("many OR top"))


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> tuple[DataFrame, str]:
    """``df`` with a column of its pages' main texts, and that column's name."""
    host, layout, name, skel, stats, top_skel, top_stats = fresh(
        df.columns, "he_host", "he_layout", "main_text", "he_skeleton", "he_counts", "he_top_skeleton", "he_top_counts")

    @F.arrow_udf("string")
    def skeletons(sources: pa.Array) -> pa.Array:
        forget()
        return pa.array([skeleton(s) for s in sources.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def texts(sources: pa.Array, patterns: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for source, pattern, found in zip(sources.to_pylist(), patterns.to_pylist(), counts.to_pylist()):
            forget()
            out.append(extract(source, pattern, [(c["node"], c["pages"], c["same"]) for c in found or ()]))
        return pa.array(out, pa.string())

    source = F.coalesce(named(html_col), F.lit(""))
    rows = df.withColumn(host, host_of(named(url_col))).withColumn(
        layout, F.xxhash64(F.array_distinct(containers(source))))
    pages = (rows.select(F.col(host).alias("host"), F.col(layout).alias("layout"), named(id_col).alias("id"),
                         source.alias("source")).filter(F.col("source").rlike(r"\S")))
    tags = containers(F.col("source"))
    formed = pages.withColumn("form", F.xxhash64(tags)).withColumn("tags", F.size(tags))
    first = shared(pattern_pages(formed.drop("source")))
    listed = first.select(*[F.col(c).alias(f"first_{c}") for c in first.columns])
    if first.count() <= BROADCAST_HOSTS:        # otherwise pages are exchanged by all four, which spreads a hot host
        listed = F.broadcast(listed)
    chosen = (formed.join(listed, (F.col("host") == F.col("first_host")) & (F.col("layout") == F.col("first_layout"))
                          & (F.col("form") == F.col("first_form")) & F.col("id").eqNullSafe(F.col("first_id")))
              .groupBy("host", "layout").agg(F.min("source").alias("source"), F.first("first_many").alias("many"),
                                             F.first("first_top").alias("top")))
    patterns = shared(chosen.select("host", "layout", "many", "top", skeletons("source").alias("pattern")))
    size = patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0

    def sized(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if size <= BROADCAST_BYTES else side

    own = patterns.filter("many").select("host", "layout", "pattern")
    tops = patterns.filter("top").select("host", F.col("layout").alias("top_layout"), F.col("pattern").alias("top_pattern"))
    tallies = (pages.join(sized(own), ["host", "layout"], "left").join(sized(tops), "host")
               .select("host", F.when(F.col("pattern").isNotNull(), F.col("layout")).otherwise(F.col("top_layout"))
                       .alias("layout"), "source", F.coalesce("pattern", "top_pattern").alias("pattern"))
               .mapInArrow(_counts, "host string, layout bigint, node int, pages bigint, same bigint")
               .groupBy("host", "layout", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
               .groupBy("host", "layout")
               .agg(F.sort_array(F.collect_list(F.struct("node", "pages", "same"))).alias("counts")))
    # A pattern's counts are as many as it has nodes.
    wrappers = shared(patterns.join(tallies, ["host", "layout"], "left"))
    own = wrappers.filter("many").select(F.col("host").alias(host), F.col("layout").alias(layout),
                                         F.col("pattern").alias(skel), F.col("counts").alias(stats))
    tops = wrappers.filter("top").select(F.col("host").alias(host), F.col("pattern").alias(top_skel),
                                         F.col("counts").alias(top_stats))
    read = rows.join(sized(own), [host, layout], "left").join(sized(tops), host, "left")
    alone = named(skel).isNull()
    return (read.withColumn(name, texts(source, F.when(alone, named(top_skel)).otherwise(named(skel)),
                                        F.when(alone, named(top_stats)).otherwise(named(stats))))
            .drop(host, layout, skel, stats, top_skel, top_stats), name)
