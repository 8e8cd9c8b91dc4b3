"""HTML extraction by wrapper induction.

Pages become trees of block elements (inline elements melt into their block; runs and repeated patterns of equal leaf
siblings become one node or one pattern). For each host a template tree is grown from seed pages (at most ``seeds``, by hash,
kept by a partial aggregate): every next seed is aligned by simple tree matching and its unmatched nodes join the template.
Then every page is aligned with its host's template, and Spark gathers for each template node over all pages how many pages
have it, whether its text ever varies, how many characters it holds and how many of them are links. A node of a page that
matches nothing counts as part of the nearest matched node around it.

That gives the host's wrapper. The main text is an <article> that holds most of the varying text, whole: its links and what
it says on every page stay. Without one, slots whose text is constant over several articles are template, slots of links are
menus, and the main text lies in the region that the aligned pages show to hold most of the varying text: from the root, the
wrapper goes down as long as one inner node has the greater part of it. Headings that vary and stand before the region on the
way belong to it, and so do paragraphs, lists and tables right beside it in the same part. Where the text stands in the page itself, between menus and
adverts, only such blocks are the article. What else varies, on a menu, in an advert or a footer, lies outside. Elements and whole class names and ids that
name other parts (forms, comments, sharing) count for no text. Articles are told apart by the longest text of their varying slots, so near
copies of an article count once, however many there are. Constancy never takes the body of a page's text: a page of which too
little would remain keeps it all.

A host with fewer than ``few`` articles shows no template; there, and on pages that lack the region, <article> and <main> and
telling names decide; the column decided_by says which.

Defined cases: null or empty html gives empty text; a page without a host is a host of its own; repeated pages are extracted
each; what is nested over 200 deep hangs on the element at that depth; a very long page is held by one worker, and so is the
template of a host; other columns are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, sliced, written

#: HTML elements by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
NEVER = frozenset("script style noscript template iframe head nav footer aside form button select option textarea input svg canvas object embed audio video dialog menu title".split())
OTHER_PARTS = frozenset("nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert gdpr comment comments respond reply discussion disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager subscribe newsletter signup login search widget popup modal skip toolbar copyright".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Words that say nothing of their own beside one of OTHER_PARTS in a class or id ("share-buttons", but not "social-history").
BESIDE = frozenset("area article bar block body bottom box button buttons container content entry form group header inner items item left link links list main outer page panel post primary right secondary section site slot story top unit wrap wrapper".split())
#: Blocks that text stands in; others hold blocks.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dd dt table figure figcaption hr".split())
TOKEN = re.compile(r"[A-Za-z]+")
#: Deeper elements hang on the one at this depth.
DEEPEST = 200
#: Pairs of children up to which their matches are held at once; beyond, the same match is found by rows.
MANY_PAIRS = 100_000
#: Sizes of matches that are kept at a time; others are found again.
KNOWN_SIZES = 1 << 18
HEADING = re.compile(r"h[1-6](?:\.|$)")


def telling(name: str) -> bool:
    """Whether a class or id names another part of a page, and nothing else."""
    words = set(TOKEN.findall(name))
    return not words.isdisjoint(OTHER_PARTS) and words <= OTHER_PARTS | BESIDE


@lru_cache(maxsize=20_000)
def kind_of(tag: str, attrs: str) -> tuple[str, bool]:
    """What nodes are compared by (the tag and its class), and whether class, id or role name another part of a page."""
    label, other = tag, False
    if attrs:
        for name, *values in ATTR.findall(attrs):
            value = next((v for v in values if v), "").lower()
            name = name.lower()
            if name == "hidden":
                other = True
            elif name == "role":
                other |= value in OTHER_ROLES
                label = "main" if value == "main" else label
            elif name == "class" or name == "id":
                if name == "class":
                    label += "." + value
                if tag not in ("body", "html", "article", "main"):
                    other |= any(map(telling, value.split()))
    return label, other


class Node:
    __slots__ = ("label", "other", "never", "children", "texts", "main", "article", "at", "linked")

    def __init__(self, label: str, other: bool, main: bool, article: bool = False):
        self.label, self.other, self.main, self.article, self.never = label, other, main, article, False
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []  # (place on the page, text of a block)
        self.at = -1  # number in the template
        self.linked = 0  # characters of the texts that are links


def parse(html: str) -> Node:
    """A tree of block elements. Tolerates what browsers do: unclosed, misnested and stray tags."""
    root = Node("#", False, False)
    stack: list[tuple[str, Node]] = [("#", root)]
    held: list[str] = []
    place, position, end = 0, 0, len(html)
    lower, in_link, linked = None, False, 0

    def flush() -> None:
        nonlocal place, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                stack[-1][1].texts.append((place, text))
                stack[-1][1].linked += min(linked, len(text))
                place += 1
            held.clear()
            linked = 0

    while position < end:
        m = TAG.search(html, position)
        if m is None:
            held.append(html[position:])
            break
        if m.start() > position:
            held.append(html[position : m.start()])
            linked += len(held[-1].strip()) if in_link else 0
        position = m.end()
        closing, tag, attrs = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br" or tag == "img":
                held.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        if closing:
            if tag == "p" and stack[-1][0] != "p":
                flush()
            if any(t == tag for t, _ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            elif tag not in RAW:
                flush()
            continue
        if tag in RAW:
            lower = lower or html.lower()
            close = lower.find("</" + tag, position)
            position = end if close < 0 else (lower.find(">", close) + 1 or end)
            continue
        flush()
        if tag in CLOSES_P and any(t == "p" for t, _ in stack):
            while stack.pop()[0] != "p":
                pass
        if tag in CLOSED_BY:
            shut = CLOSED_BY[tag]
            while stack[-1][0] in shut:
                stack.pop()
        around = stack[-1][1]
        parent = stack[min(len(stack) - 1, DEEPEST)][1]
        label, other = kind_of(tag, attrs)
        inside = around.main or label.split(".")[0] in ("article", "main")
        # a header of the article itself holds its title; any other header is the page's
        node = Node(label, other and not (tag in ("header", "h1") and around.main), inside, around.article or tag == "article")
        node.never = tag in NEVER or (tag == "header" and not around.main) or (parent is not around and (around.never or around.other))
        parent.children.append(node)
        if tag not in VOID:
            stack.append((tag, node))
    flush()
    settle(root)
    fold(root)
    return root


def settle(root: Node) -> None:
    """A part of the page passes on to what it holds, unless only its name tells and the article is in it ("has-sidebar")."""
    order = list(walk(root))
    holds = {id(n) for n in order if n.main}
    for n in reversed(order):
        if any(id(c) in holds for c in n.children):
            holds.add(id(n))
    for n in order:
        if n.other and not n.main and id(n) in holds:
            n.other = False
        n.other |= n.never
        for c in n.children:
            c.never |= n.other


def fold(root: Node, longest: int = 6) -> None:
    """Runs and repeated patterns of siblings of equal shape (h2 p ul, h2 p ul) become the first of them, with the texts of all."""
    shape: dict[int, int] = {}

    def merge(a: Node, b: Node) -> None:
        for x, y in zip(walk(a), walk(b), strict=True):
            x.texts += y.texts
            x.linked += y.linked

    for n in reversed(list(walk(root))):
        out: list[Node] = []
        i, c = 0, n.children
        while i < len(c):
            for k in range(1, min(longest, len(out), len(c) - i) + 1):
                if all(shape[id(out[len(out) - k + j])] == shape[id(c[i + j])] for j in range(k)):
                    for j in range(k):
                        merge(out[len(out) - k + j], c[i + j])
                    i += k
                    break
            else:
                out.append(c[i])
                i += 1
        n.children = out
        shape[id(n)] = hash((n.label, n.other, *(shape[id(x)] for x in out)))


class Sizes:
    """Sizes of the matches of what two trees hold. Nodes of equal shape (label and children's shapes) match alike, so shapes are matched."""

    def __init__(self, a: Node, b: Node):
        numbers: dict[tuple, int] = {}
        names: dict[str, int] = {}
        self.of: dict[int, int] = {}  # node -> number of its shape
        self.children: list[tuple[int, ...]] = []
        self.named: list[int] = []  # the label of each shape, by number
        for n in reversed([*walk(a), *walk(b)]):
            kind = (names.setdefault(n.label, len(names)), *(self.of[id(c)] for c in n.children))
            i = self.of[id(n)] = numbers.setdefault(kind, len(numbers))
            if i == len(self.named):
                self.named.append(kind[0])
                self.children.append(kind[1:])
        self.label = np.array(self.named)
        self.inner = np.array([bool(c) for c in self.children])
        self.known: dict[tuple[int, int], int] = {}

    def size(self, u: int, v: int) -> int:
        """Of two shapes of one label."""
        x, y = self.children[u], self.children[v]
        if not x or not y:
            return 1
        size = self.known.get((u, v))
        if size is None:
            if len(x) * len(y) <= 256:
                row = [0] * (len(y) + 1)
                for p in x:
                    above, row = row, [0]
                    for j, q in enumerate(y):
                        row.append(max(row[j], above[j + 1], above[j] + self.size(p, q) if self.named[p] == self.named[q] else 0))
            else:
                for row in self.rows(x, y):
                    pass
            size = 1 + int(row[-1])
            if len(self.known) >= KNOWN_SIZES:
                self.known.clear()  # sizes are found again
            self.known[u, v] = size
        return size

    def rows(self, x, y, row: np.ndarray | None = None):
        """For each of the shapes x a row of the table of largest matches: of what comes up to it with y[:0], y[:1], ... row: the one before."""
        distinct, at = np.unique(np.array(y), return_inverse=True)
        found: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, np.int32) if row is None else row
        for u in x:
            got = found.get(u)
            if got is None:
                got = (self.label[distinct] == self.label[u]).astype(np.int32)
                if self.inner[u]:
                    for i in np.flatnonzero((got > 0) & self.inner[distinct]).tolist():
                        got[i] = self.size(u, int(distinct[i]))
                if (len(found) + 1) * len(distinct) > KNOWN_SIZES:
                    found.clear()
                found[u] = got
            best = row.copy()
            np.maximum(row[1:], row[:-1] + got[at], out=best[1:])
            row = np.maximum.accumulate(best)
            yield row

    def matched(self, a: Node, b: Node):
        """matched() by rows, of which about the square root of their number are held at a time."""
        x, y = [self.of[id(c)] for c in a.children], [self.of[id(c)] for c in b.children]
        step = math.isqrt(len(x)) + 1
        kept = [row := np.zeros(len(y) + 1, np.int32)]
        for i, row in enumerate(self.rows(x, y), 1):
            if i % step == 0:
                kept.append(row)
        pairs, size, j = [(a, b)], 1 + int(row[-1]), len(y)
        for low in reversed(range(0, len(x), step)):
            part = x[low : low + step]
            best = [kept[low // step], *self.rows(part, y, kept[low // step])]
            i = len(part)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.extend(matched(a.children[low + i], b.children[j], self)[1])
        return size, pairs


def matched(a: Node, b: Node, sizes: Sizes | None = None):
    """Simple tree matching: the size of the largest order-preserving match of two trees, and its pairs of nodes.

    Where both have very many children, the same is found with less at a time (Sizes; sizes: those of trees around a and b).
    """
    if a.label != b.label:
        return 0, ()
    x, y = a.children, b.children
    if not x or not y:
        return 1, ((a, b),)
    if len(x) * len(y) > MANY_PAIRS:
        return (sizes or Sizes(a, b)).matched(a, b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    pair: dict[tuple[int, int], tuple] = {}
    for i, p in enumerate(x):
        row, above = best[i + 1], best[i]
        for j, q in enumerate(y):
            most = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if p.label == q.label:
                got = pair[i, j] = matched(p, q, sizes)
                if above[j] + got[0] > most:
                    most = above[j] + got[0]
            row[j + 1] = most
    pairs, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.extend(pair[i, j][1])
    return 1 + best[-1][-1], pairs


def grow(template: Node, page: Node) -> None:
    """Partial tree alignment: nodes of the page that match nothing join the template beside their left neighbour."""
    _, pairs = matched(template, page)
    twin = {id(b): a for a, b in pairs}
    todo = [page]
    while todo:
        n = todo.pop()
        parent, place = twin[id(n)], 0
        for c in n.children:
            if id(c) in twin:
                place = parent.children.index(twin[id(c)]) + 1
                todo.append(c)
            else:
                parent.children.insert(place, c)
                place += 1


def walk(node: Node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.children)


def induce(pages: list[str]) -> bytes:
    """The template of some pages as bytes; only kinds of nodes and their numbers are kept."""
    template = parse(pages[0])
    for p in pages[1:]:
        grow(template, parse(p))
    for i, n in enumerate(walk(template)):
        n.at, n.texts = i, []
    flat = lambda n: (n.label, n.at, n.other, n.article, [flat(c) for c in n.children])
    return pickle.dumps(flat(template))


@lru_cache(maxsize=512)
def template_of(data: bytes) -> Node:
    def build(x) -> Node:
        n = Node(x[0], x[2], False, x[3])
        n.at, n.children = x[1], [build(c) for c in x[4]]
        return n

    return build(pickle.loads(data))


def align(template: bytes | None, html: str) -> Node:
    """The page's tree, its nodes numbered as in the template (-1: not in it)."""
    page = parse(html)
    if template is not None:
        for a, b in matched(template_of(template), page)[1]:
            b.at = a.at
    return page


def content(page: Node) -> tuple[list[Node], bool]:
    """The nodes that can hold the page's text, and whether they are those of an <article> or <main>."""
    nodes = list(walk(page))
    inside = any(n.main and n.texts and not n.other for n in nodes)
    return [n for n in nodes if n.texts and not n.other and (n.main or not inside)], inside


def anchored(page: Node):
    """(node, number of the nearest template node: its own or of one around it)"""
    todo = [(page, max(page.at, 0))]
    while todo:
        n, anchor = todo.pop()
        yield n, anchor
        todo += [(c, c.at if c.at >= 0 else anchor) for c in reversed(n.children)]


@dataclass(frozen=True)
class Wrapper:
    """What a host's aligned pages show: template nodes by number."""

    region: int  # the node that holds the main text
    inside: frozenset[int]  # the region, what is in it, and blocks of text beside it
    links: frozenset[int]
    constant: frozenset[int]


def induced(template: Node, counts: dict[int, tuple[int, int]], constant: frozenset[int], most: float = 0.6) -> Wrapper | None:
    """counts: characters of each node over all pages, and those of them in links."""
    nodes = list(walk(template))
    articles = frozenset(n.at for n in nodes if n.article)
    links = frozenset(i for i, (chars, linked) in counts.items() if 2 * linked > chars and i not in articles)
    own = lambda n: 0 if n.at in constant or n.at in links or n.at not in counts else counts[n.at][0] - counts[n.at][1]
    named = {n.at for n in nodes if n.other}
    if not any(own(n) for n in nodes if n.at not in named):
        named = set()  # names say nothing where all is named
    mass: dict[int, int] = {}
    for n in reversed(nodes):
        mass[n.at] = (0 if n.at in named else own(n)) + sum(mass[c.at] for c in n.children)
    if not mass[template.at]:
        return None
    # an article's element holds all of it, if most of the text is there
    whole = max((n for n in nodes if n.label.split(".")[0] == "article"), key=lambda n: mass[n.at], default=None)
    if whole is not None and 2 * mass[whole.at] > mass[template.at]:
        return Wrapper(whole.at, frozenset(n.at for n in walk(whole)), links, constant)
    textual = lambda n: n.label.split(".")[0] in TEXTUAL
    region, beside = template, []
    while True:
        inner = max((c for c in region.children if c.children), key=lambda c: mass[c.at], default=None)
        if inner is None or textual(inner) or mass[inner.at] < most * mass[region.at]:
            break
        page_wide = region.label.split(".")[0] in ("#", "html", "body")
        if not page_wide:
            beside = []  # what stands beside an outer part isn't the article's
        place = region.children.index(inner)
        for i, c in enumerate(region.children):
            if own(c) and (HEADING.match(c.label) and i < place or textual(c) and not page_wide):
                beside += walk(c)
        region = inner
    inside = list(walk(region))
    if region.label.split(".")[0] in ("#", "html", "body") and sum(mass[c.at] for c in region.children if textual(c)) >= most * (mass[region.at] - (0 if region.at in named else own(region))) > 0:
        # text that stands right in the page: what holds blocks of its own beside it is another part
        inside = [region, *(n for c in region.children if textual(c) for n in walk(c))]
    return Wrapper(region.at, frozenset(n.at for n in [*beside, *inside]), links, constant)


def extract(page: Node, wrapper: Wrapper | None = None) -> str:
    return extracted(page, wrapper)[0]


def extracted(page: Node, wrapper: Wrapper | None = None, least: float = 0.5) -> tuple[str, str]:
    """The page's text, and what decided it: the wrapper, or names.

    Constant slots go, unless less than this share of the region's characters would remain.
    """
    if wrapper is not None:
        named = not any(n.at == wrapper.region and n.other for n in walk(page))  # the region's own name counts for nothing
        held = [n for n, anchor in anchored(page) if n.texts and anchor in wrapper.inside and n.at not in wrapper.links and not (named and n.other)]
        whole = [t for n in held for t in n.texts]
        texts = [t for n in held if n.at not in wrapper.constant for t in n.texts]
        size = lambda found: sum(len(t) for _, t in found)
        if size(texts) < least * size(whole):
            texts = whole
        if texts:
            return "\n".join(t for _, t in sorted(texts)), "wrapper"
    return "\n".join(t for _, t in sorted(t for n in content(page)[0] for t in n.texts)), "names"


def article_of(page: Node, constant: frozenset[int]) -> int:
    """What tells the page's article from others: a hash of the longest text outside of slots that never vary (0: none)."""
    import xxhash

    longest = max((t for n in content(page)[0] if n.at not in constant for _, t in n.texts), key=lambda t: (len(t), t), default=None)
    return 0 if longest is None else xxhash.xxh3_64_intdigest(longest) >> 1


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_templates(pages: DataFrame, seeds: int = 4) -> DataFrame:
    """(host, template) from at most ``seeds`` pages of each host."""

    def build(key, table):
        import pyarrow as pa

        found = sorted(t for t in table["html"].to_pylist() if t)
        return pa.table({"host": [key[0].as_py()], "template": pa.array([induce(found) if found else None], pa.binary())}, pa.schema([("host", pa.string()), ("template", pa.binary())]))

    h = F.xxhash64("html")
    one = pages.where(F.length("html") > 0).groupBy("host", F.pmod(h, F.lit(seeds)).alias("draw")).agg(F.min_by("html", h).alias("html"))
    return one.groupBy("host").applyInArrow(build, "host string, template binary")


def node_statistics(pages: DataFrame) -> DataFrame:
    """(host, node, n, least, most, article, chars, linked) over all pages(host, html, template); counted per task first.

    n, least, most and article tell of a node's own text; chars and linked also of what hangs on it without a match.
    """

    def count(record_batches):
        import pyarrow as pa
        import xxhash

        found: dict[tuple, list] = {}
        names = ["host", "node", "n", "least", "most", "article", "chars", "linked"]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64()]

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((*k, *v) for k, v in found.items()), strict=True), kinds, strict=True)], names=names)

        for rb in sliced(record_batches):
            for host, html, template in zip(*(rb.column(n).to_pylist() for n in ("host", "html", "template")), strict=True):
                for n, anchor in anchored(align(template, html or "")):
                    if not n.texts:
                        continue
                    s = found.setdefault((host, anchor), [0, None, None, False, 0, 0])
                    s[4] += sum(len(t) for _, t in n.texts)
                    s[5] += n.linked
                    if n.at >= 0:
                        h = xxhash.xxh3_64_intdigest("\n".join(t for _, t in n.texts)) >> 1
                        s[:4] = s[0] + 1, h if s[1] is None else min(s[1], h), h if s[2] is None else max(s[2], h), s[3] or n.article
                if len(found) > 100_000:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    schema = "host string, node long, n long, least long, most long, article boolean, chars long, linked long"
    total = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("article").alias("article"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    return pages.select("host", "html", "template").mapInArrow(count, schema).groupBy("host", "node").agg(*total)


def node_articles(pages: DataFrame) -> DataFrame:
    """(host, node, articles): on how many articles each constant node is; node -1 is on all.

    From pages(host, html, template, constant); distinct per task first.
    """

    def mark(record_batches):
        import pyarrow as pa

        found: set[tuple] = set()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found, strict=True)], names=["host", "node", "article"])

        for rb in sliced(record_batches):
            for host, html, template, constant in zip(*(rb.column(n).to_pylist() for n in ("host", "html", "template", "constant")), strict=True):
                page, fixed = align(template, html or ""), frozenset(constant or ())
                article = article_of(page, fixed)
                found.add((host, -1, article))
                found.update((host, n.at, article) for n in walk(page) if n.at in fixed and n.texts)
                if len(found) > 100_000:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    marks = pages.select("host", "html", "template", "constant").mapInArrow(mark, "host string, node long, article long")
    return marks.distinct().groupBy("host", "node").agg(F.count("*").alias("articles"))


def host_wrappers(templates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(host, wrapper) from templates(host, template) and nodes(host, node, chars, linked, constant) of the hosts that show one."""

    def build(key, left, right):
        import pyarrow as pa

        found = next((t for t in left["template"].to_pylist() if t), None)
        counts = {n: (c, k) for n, c, k in zip(*(right[x].to_pylist() for x in ("node", "chars", "linked")), strict=True)}
        constant = frozenset(n for n, x in zip(right["node"].to_pylist(), right["constant"].to_pylist(), strict=True) if x)
        wrapper = induced(template_of(found), counts, constant) if found and counts else None
        return pa.table({"host": [key[0].as_py()], "wrapper": pa.array([wrapper and pickle.dumps(wrapper)], pa.binary())}, pa.schema([("host", pa.string()), ("wrapper", pa.binary())]))

    return templates.groupBy("host").cogroup(nodes.groupBy("host")).applyInArrow(build, "host string, wrapper binary")


@lru_cache(maxsize=512)
def wrapper_of(data: bytes | None) -> Wrapper | None:
    return data and pickle.loads(data)


def main_text(pages: DataFrame, seeds: int = 4, few: int = 3, broadcast_bytes: int = 32 << 20, share: float = 0.5) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, decided_by.

    few: over how many articles a constant text is template, if it isn't in an <article>; it must be on more than this share of
    the host's articles besides. A host of fewer than few articles has no wrapper.
    Templates are broadcast if their written table is below broadcast_bytes; else they are joined by host.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    templates = written(host_templates(pages, seeds), "wrapper-templates")
    bound = templates.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0

    def joined(table: DataFrame, how: str = "left") -> DataFrame:
        return pages.join(F.broadcast(table) if bound < broadcast_bytes else table, "host", how)

    nodes = written(node_statistics(joined(templates)), "wrapper-nodes")
    same = nodes.where((F.col("least") == F.col("most")) & ~F.col("article") & (F.col("n") >= few))
    constant = same.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("constant"))  # bounded by the template's nodes
    candidates = written(templates.join(constant, "host", "left"), "wrapper-candidates")
    on = written(node_articles(joined(candidates)), "wrapper-articles")
    total = on.where("node = -1").select("host", F.col("articles").alias("total")).where(F.col("total") >= few)
    fixed = same.join(on, ["host", "node"]).join(total, "host").where((F.col("articles") >= few) & (F.col("articles") > share * F.col("total")))
    shown = nodes.join(total.select("host"), "host", "left_semi").join(fixed.select("host", "node", F.lit(True).alias("constant")), ["host", "node"], "left")
    wrappers = written(templates.join(host_wrappers(templates, shown), "host", "left"), "wrappers")

    def run(record_batches):
        import pyarrow as pa

        for rb in sliced(record_batches):
            found = [extracted(align(t, html or ""), wrapper_of(w)) for html, t, w in zip(*(rb.column(n).to_pylist() for n in ("html", "template", "wrapper")), strict=True)]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([by for _, by in found], pa.string())], names=["page_id", "url", "text", "n_chars", "decided_by"])

    out = joined(wrappers).select("page_id", "url", "html", "template", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long, decided_by string")
    for table in (templates, nodes, candidates, on):
        forget(table)
    return out


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
