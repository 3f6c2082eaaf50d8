"""HTML extraction by wrapper induction over the pages of a host.

A page is a tree of containers with text blocks as leaves. The pages of a host that share a layout (the containers
below body) are aligned with the smallest of them, the layout's wrapper, by simple tree matching: the largest top-down
matching that keeps the order of siblings. A block whose text is the same on all aligned pages is template; one whose
text varies is a slot. Where the slots' text lies decides which container holds a layout's main text: from the root
down, the child that holds most of what varies and is no link. Tags and class words only cut forms, asides, comments
and the like from it, and decide alone on pages whose layout too few pages share.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches, written

#: Nodes of all wrappers up to which these are broadcast (some 30 bytes each); beyond that they are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Distinct pages that make a layout, and on which a block must be the same before it counts as template.
LEAST_PAGES = 3
#: Distinct pages on which a block inside the main container must be the same to be cut from it.
LEAST_INSIDE = 10
#: Above this share of link text, a slot outside the main container is a menu.
LINK_SHARE = 0.5
#: The share of a layout's text that the next container down must hold to be where the main text lies.
MAIN_SHARE = 0.7
#: What constant text, and text of containers with one block, count for in that share.
MINOR = 0.25
#: Where less than this share of the main container's text varies, all pages tell one story, which is kept.
VARIES = 0.05

#: Element names of HTML, by what they do here: fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
CONTAINERS = set("body div section article main nav header footer aside form ul ol table dl figure details fieldset dialog menu center".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address figcaption summary hr html head legend option select hgroup search".split())
#: Elements that never hold main text.
OUT = set("nav footer aside form button select dialog menu head input label option datalist object audio video canvas".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert".split())
MAIN = {"article", "main"}
HEADINGS = {"#h1", "#h2", "#h3", "#h4", "#h5", "#h6"}
#: Words in class or id that mark boilerplate.
MARKED = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification|alert|comments?|commentlist|disqus|repl(?:y|ies)|respond|sidebar|side-?bar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|sign-?in|login|popup|modal|overlay|pagination|pager|skip-?link|site-?header|page-?header|header|hidden|sr-only)(?:$|[\s_-])", re.I)
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: The rest of a tag; greater-than signs inside quotes do not end it.
REST = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>")
ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\S*\d\S*")
#: What an opening tag closes of the elements that are open, as far as the nearest container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


@dataclass
class Page:
    """A page's nodes, parents before children and siblings in order: containers, and blocks (those with text).

    signs: tag and class of a container, # and tag of a block; links: a block's characters in links; out, main: whether
    a container's tag or class marks it as no main text, or as the main text.
    """

    signs: list[str] = field(default_factory=lambda: ["root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    out: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    text: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])

    def add(self, sign: str, parent: int, out: bool, main: bool, text: str = "", links: int = 0) -> int:
        for held, x in zip((self.signs, self.parents, self.out, self.main, self.text, self.links), (sign, parent, out, main, text, links), strict=True):
            held.append(x)
        return len(self.signs) - 1

    def under(self, marks: list[bool]) -> list[bool]:
        """Whether each node or one above it is marked."""
        found: list[bool] = []
        for k, p in enumerate(self.parents):
            found.append(marks[k] or (p >= 0 and found[p]))
        return found

    def layout(self) -> int:
        """A checksum of which containers stand at the top of the page and below body."""
        depth = [0]
        for p in self.parents[1:]:
            depth.append(depth[p] + 1)
        tops = {(self.signs[p], s) for s, p, d, t in zip(self.signs, self.parents, depth, self.text, strict=True) if 0 < d <= 2 and not t}
        return zlib.crc32("\n".join(sorted(f"{a}>{b}" for a, b in tops)).encode())

    def sums(self) -> list[int]:
        """A checksum of each block's text; 0 for containers."""
        return [zlib.crc32(t.encode()) + 1 if t else 0 for t in self.text]


@dataclass
class Frame:
    """An open container: its node, and the other elements that are open in it (tag, whether it is no main text)."""

    tag: str
    node: int
    out: bool
    main: bool
    inner: list[tuple[str, bool]] = field(default_factory=list)
    held: Counter = field(default_factory=Counter)


class Reader:
    """Reads whole HTML in one pass, each character and open element a bounded number of times.

    Unclosed and stray tags are taken as browsers take them, nearly. After a quote in a tag that is never closed, tags
    end at the next greater-than sign.
    """

    def __init__(self) -> None:
        self.page = Page()
        self.frames = [Frame("root", 0, False, False)]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.in_link, self.links = False, 0

    def flush(self) -> None:
        """The text since the last flush becomes a block of the innermost container."""
        if self.parts:
            f = self.frames[-1]
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text and not (f.inner[-1][1] if f.inner else f.out):
                tag = next((t for t, _ in reversed(f.inner[-4:]) if t in BLOCKS), "text")
                self.page.add(f"#{tag}", f.node, False, False, text, min(self.links, len(text)))
            self.parts.clear()
        self.links = 0

    def say(self, raw: str) -> None:
        if raw:
            decoded = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(decoded)
            if self.in_link:
                self.links += len(decoded.strip())

    def drop_inner(self) -> None:
        """Close the innermost element that is no container."""
        f = self.frames[-1]
        tag, _ = f.inner[-1]
        if tag in BLOCKS:
            self.flush()
        f.inner.pop()
        f.held[tag] -= 1

    def drop_frame(self) -> None:
        self.flush()
        self.in_link = False
        self.open[self.frames.pop().tag] -= 1

    def end(self, tag: str) -> None:
        """An end tag does not close a container around it other than its own kind."""
        f = self.frames[-1]
        if tag == "a":
            self.in_link = False
        elif tag in CONTAINERS:
            if self.open[tag]:
                while self.frames[-1].tag != tag:
                    self.drop_frame()
                self.drop_frame()
            else:
                self.flush()
        elif f.held[tag]:
            while f.inner[-1][0] != tag:
                self.drop_inner()
            self.drop_inner()
        elif tag in BLOCKS:
            self.flush()

    def start(self, tag: str, rest: str) -> None:
        f = self.frames[-1]
        if tag in ("body", "article", "main", "div", "header", "nav") and f.held["head"]:
            while f.held["head"]:
                self.drop_inner()
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else ())
        while any(f.held[t] for t in closes):
            self.drop_inner()
        if tag in BLOCKS:
            self.flush()
        if tag in VOID or rest.endswith("/"):
            return
        given = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)} if rest.strip() else {}
        named = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".strip()
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        mark = MARKED.search(named) if named and tag != "body" else None
        # an article's own header holds its title
        marked = mark is not None and not (f.main and (tag in ("h1", "h2") or "header" in mark[0].lower()))
        gone = tag in OUT or hidden or marked or (tag == "header" and not f.main) or given.get("role") in ROLES
        outside = f.inner[-1][1] if f.inner else f.out
        if tag == "a":
            self.in_link = True
        elif tag in CONTAINERS:
            whole = tag in MAIN or given.get("role") == "main"
            kind = " ".join(DIGITS.sub("", given.get("class", "")).split())
            node = self.page.add(f"{tag}.{kind}" if kind else tag, f.node, gone, whole)
            self.frames.append(Frame(tag, node, outside or gone, f.main or whole))
            self.open[tag] += 1
        elif gone or tag in BLOCKS:
            f.inner.append((tag, outside or gone))
            f.held[tag] += 1

    def read(self, source: str) -> Page:
        at, last, unclosed, plain, n = 0, source.rfind(">"), set(), False, len(source)
        low = source.lower() if "<" in source else ""
        if len(low) != n:  # a letter whose lower case is longer
            low = "".join(c.lower() if c < "\x80" else c for c in source)
        while 0 <= (k := source.find("<", at)):
            if k > last:
                break
            if source.startswith("<!", k) or source.startswith("<?", k):
                self.say(source[at:k])
                if source.startswith("<!--", k):
                    e = source.find("-->", k + 4)
                    at = n if e < 0 else e + 3
                elif source.startswith("<![CDATA[", k) and (e := source.find("]]>", k)) >= 0:
                    self.say(source[k + 9 : e])
                    at = e + 3
                else:
                    at = source.find(">", k) + 1
                continue
            m = NAME.match(source, k + 1)
            if not m:
                self.say(source[at : k + 1])
                at = k + 1
                continue
            self.say(source[at:k])
            r = None if plain else REST.match(source, m.end())
            if r is None:
                plain = True
                at = source.find(">", m.end()) + 1
            else:
                at = r.end()
            tag, rest = m.group().lower(), source[m.end() : at - 1]
            if tag[0] == "/":
                self.end(tag[1:])
            elif tag in RAW:
                if rest.endswith("/"):
                    continue
                e = -1 if tag in unclosed else low.find(f"</{tag}", at)
                if e < 0:
                    unclosed.add(tag)
                    at = n if tag in ("script", "style", "textarea", "title") else at
                else:
                    g = source.find(">", e)
                    at = n if g < 0 else g + 1
            elif tag == "br":
                self.parts.append(" ")
            elif tag == "head":
                self.flush()
                self.frames[-1].inner.append((tag, True))
                self.frames[-1].held[tag] += 1
            elif tag != "html":
                self.start(tag, rest)
        self.say(source[at:])
        self.flush()
        return self.page


def read(source: str) -> Page:
    """The nodes of whole HTML."""
    return Reader().read(source)


def children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for k, p in enumerate(parents):
        if p >= 0:
            out[p].append(k)
    return out


def shapes(signs: list[str], kids: list[list[int]]) -> list[int]:
    """A hash of each node's whole subtree of signs, within this process."""
    out = [0] * len(signs)
    for k in range(len(signs) - 1, -1, -1):
        out[k] = hash((signs[k], *(out[c] for c in kids[k])))
    return out


def in_order(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), both ascending, of the largest sum of weights. Memory is linear: halves are solved alone."""

    def rows(w: np.ndarray) -> np.ndarray:
        best = np.zeros(w.shape[1] + 1, dtype=np.int64)
        for line in w:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + line))
        return best

    pairs, todo = [], [(0, weights.shape[0], 0, weights.shape[1])]
    while todo:
        a, b, c, d = todo.pop()
        w = weights[a:b, c:d]
        if not w.size or not w.any():
            continue
        if b - a == 1:
            pairs.append((a, c + int(w[0].argmax())))
            continue
        mid = (b - a) // 2
        cut = int((rows(w[:mid]) + rows(w[mid:, ::-1][::-1])[::-1]).argmax())
        todo += [(a, a + mid, c, c + cut), (a + mid, b, c + cut, d)]
    return sorted(pairs)


def align(a_signs: list[str], a_parents: list[int], b_signs: list[str], b_parents: list[int]) -> dict[int, int]:
    """Simple tree matching of two trees: which node of b each matched one of a stands for.

    Siblings of the same shape at the ends of two lists are in some largest matching, so they are paired at once; what
    is left between them is solved by the table of all pairs. No recursion, so any depth will do.
    """
    if not a_signs or not b_signs or a_signs[0] != b_signs[0]:
        return {}
    ka, kb = children(a_parents), children(b_parents)
    sa, sb = shapes(a_signs, ka), shapes(b_signs, kb)
    plans: dict[tuple[int, int], tuple[list[tuple[int, int]], list[int], list[int]]] = {}
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    size = [1] * len(a_signs)
    for k in range(len(a_signs) - 1, 0, -1):
        size[a_parents[k]] += size[k]
    todo = [(0, 0)]
    while todo:
        x, y = todo[-1]
        if (x, y) in done:
            todo.pop()
            continue
        if (x, y) not in plans:
            xs, ys = ka[x], kb[y]
            lo, top = 0, min(len(xs), len(ys))
            while lo < top and sa[xs[lo]] == sb[ys[lo]]:
                lo += 1
            hi = 0
            while hi < top - lo and sa[xs[-1 - hi]] == sb[ys[-1 - hi]]:
                hi += 1
            ends = [(xs[k], ys[k]) for k in range(lo)] + [(xs[-1 - k], ys[-1 - k]) for k in range(hi)]
            xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
            plans[x, y] = ends, xs, ys
            by_sign: dict[str, list[int]] = {}
            for d in ys:
                if kb[d]:
                    by_sign.setdefault(b_signs[d], []).append(d)
            todo += [(c, d) for c in xs if ka[c] for d in by_sign.get(a_signs[c], ()) if sa[c] != sb[d]]
            continue
        todo.pop()
        ends, xs, ys = plans.pop((x, y))
        pairs, total = list(ends), 1 + sum(size[c] for c, _ in ends)
        if xs and ys:
            number: dict[str, int] = {}
            own = np.array([number.setdefault(a_signs[c], len(number)) for c in xs])
            other = np.array([number.get(b_signs[d], -1) for d in ys])
            w = (own[:, None] == other[None, :]).astype(np.int64)
            for i, j in zip(*np.nonzero(w), strict=True):
                c, d = xs[i], ys[j]
                if ka[c] and kb[d]:
                    w[i, j] = size[c] if sa[c] == sb[d] else done[c, d][0]
            for i, j in in_order(w):
                pairs.append((xs[i], ys[j]))
                total += int(w[i, j])
        done[x, y] = total, pairs
    found, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x] = y
        if (x, y) in done:
            todo += done[x, y][1]
        else:  # the same shape
            todo += zip(ka[x], kb[y], strict=bool(sa[x] == sb[y]))
    return found


@dataclass
class Slots:
    """What the pages of a layout say of its wrapper's nodes: pages, least and greatest checksum, characters, links.

    A block that stands for no node of the wrapper adds its characters to the container it lies in.
    """

    pages: list[int]
    low: list[int]
    high: list[int]
    chars: list[int]
    links: list[int]


def template(slots: Slots) -> set[int]:
    """Blocks of a wrapper whose text is the same on all aligned pages, LEAST_PAGES at least."""
    return {k for k, n in enumerate(slots.pages) if n >= LEAST_PAGES and slots.low[k] and slots.low[k] == slots.high[k]}


def main_container(signs: list[str], parents: list[int], slots: Slots) -> tuple[int, set[int]]:
    """The container of a wrapper that holds its layout's main text, and which blocks are cut from it as template.

    From the root, as long as one child holds MAIN_SHARE of the text there, which is no link text; article, main and
    containers with a heading of their own end the way. Text that is constant or alone in its container counts less:
    what a layout has one short text of (an advert, a date, a line of rights) is no main text.
    """
    same, n = template(slots), len(signs)
    blocks, most = [0] * n, max(slots.pages, default=0)
    for k, s in enumerate(signs):
        if s[0] == "#":
            blocks[parents[k]] += 1
        elif slots.chars[k]:
            blocks[k] += 2  # blocks beyond the wrapper's: a list
    weight, varies, whole = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        text = max(0, slots.chars[k] - slots.links[k])
        home = parents[k] if signs[k][0] == "#" else k
        weight[k] += text * (MINOR if k in same or (blocks[home] < 2) else 1.0)
        whole[k] += text
        varies[k] += 0 if k in same else text
        if parents[k] >= 0:
            for held in (weight, varies, whole):
                held[parents[k]] += held[k]
    kids, at = children(parents), 0
    while most:
        tag = signs[at].split(".")[0]
        heads = any(signs[c] in HEADINGS and c not in same and slots.links[c] * 2 <= slots.chars[c] for c in kids[at])
        best = max((c for c in kids[at] if signs[c][0] != "#"), key=lambda c: weight[c], default=None)
        if tag in MAIN or heads or best is None or weight[best] < MAIN_SHARE * weight[at] or not weight[best]:
            break
        at = best
    return at, {k for k in same if slots.pages[k] >= LEAST_INSIDE} if varies[at] >= VARIES * whole[at] else set()


def main_text(page: Page, fit: dict[int, int] | None = None, main: int = 0, same: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text. fit: the wrapper's node for each of the page's nodes; main, same: what main_container gives.

    Without a wrapper, an article or main element bounds the text, or else link shares drop menus.
    """
    gone = page.under(page.out)
    if fit:
        inside = page.under([fit.get(k) == main for k in range(len(page.signs))])
        if any(t and i for t, i in zip(page.text, inside, strict=True)):
            return "\n\n".join(t for k, t in enumerate(page.text) if t and inside[k] and not gone[k] and not (k in fit and fit[k] in same))
    kept = [k for k, t in enumerate(page.text) if t and not gone[k]]
    inside = page.under(page.main)
    if any(inside[k] for k in kept):
        return "\n\n".join(page.text[k] for k in kept if inside[k])
    length: dict[int, list[int]] = {}
    for k in kept:
        s = length.setdefault(page.parents[k], [0, 0])
        s[0] += len(page.text[k])
        s[1] += page.links[k]
    return "\n\n".join(page.text[k] for k in kept if length[page.parents[k]][1] <= LINK_SHARE * length[page.parents[k]][0])


def with_host(pages: DataFrame, url_col: str) -> F.Column:
    """The host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))


def joined(df: DataFrame, by_layout: DataFrame, nodes: int, how: str) -> DataFrame:
    """df with its layout's columns; broadcast up to a checked size."""
    return df.join(F.broadcast(by_layout) if nodes <= BROADCAST_NODES else by_layout, ["host", "layout"], how)


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Every page, read once: (id, url, host, layout, story, key) and its nodes. story: a checksum of the whole page's text."""
    rows = small_batches(pages).select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), with_host(pages, url_col).alias("host"), F.xxhash64(id_col, url_col).alias("key"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    whole, text, long_ = pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())
    types = {"layout": pa.int64(), "story": pa.int64(), "signs": text, "parents": whole, "sums": long_, "chars": whole, "links": whole, "out": whole, "main": whole, "text": text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for page in map(read, b.column(4).to_pylist()):
                sums = page.sums()
                marked = ([k for k, m in enumerate(marks) if m] for marks in (page.out, page.main))
                found.append((page.layout(), zlib.crc32(np.array(sums, "<i8").tobytes()), page.signs, page.parents, sums, list(map(len, page.text)), page.links, *marked, page.text))
            cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types.values(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *cols], names=["id", "url", "host", "key", *types])

    kinds = "layout long, story long, signs array<string>, parents array<int>, sums array<long>, chars array<int>, links array<int>, out array<int>, main array<int>, text array<string>"
    given = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "url"))
    return written(rows.mapInArrow(run, f"{given}, host string, key long, {kinds}"))


def wrappers(trees: DataFrame) -> tuple[DataFrame, int]:
    """(host, layout, w_signs, w_parents, w_main, w_same) of each layout of LEAST_PAGES distinct pages; all their nodes' number.

    Only signs, checksums and lengths of the parsed pages are read, not their text. Equal pages of a host count once.
    Votes are counted in tasks, then by layout and node, so a host with any share of the pages loads no single task.
    """
    tree = F.struct("key", "signs", "parents", "sums", "chars", "links").alias("t")
    apart = written(trees.groupBy("host", "layout", "story").agg(F.min_by(tree, "key").alias("t")).select("host", "layout", "t.*"))
    pivot = F.min_by(F.struct("signs", "parents"), F.struct(F.size("signs").alias("n"), "key")).alias("x")
    first = apart.groupBy("host", "layout").agg(pivot, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES)
    first = written(first.select("host", "layout", F.col("x.signs").alias("w_signs"), F.col("x.parents").alias("w_parents")))
    nodes = first.agg(F.sum(F.size("w_signs"))).first()[0] or 0
    types = (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 5)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[str, int, int], list[int]] = {}
            for r in b.to_pylist():
                fit, above = align(r["signs"], r["parents"], r["w_signs"], r["w_parents"]), []
                for x, s in enumerate(r["sums"]):
                    # the node of the wrapper that x, or the nearest above it, stands for
                    y = fit.get(x)
                    above.append(above[r["parents"][x]] if y is None else y)
                    if y is None and not s:
                        continue
                    v = count.setdefault((r["host"], r["layout"], above[x]), [0, 1 << 62, 0, 0, 0])
                    if y is not None:
                        v[0], v[1], v[2] = v[0] + 1, min(v[1], s), max(v[2], s)
                    v[3] += r["chars"][x]
                    v[4] += r["links"][x]
            cols = [*zip(*count, strict=True), *zip(*count.values(), strict=True)] or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "layout", "node", "pages", "low", "high", "chars", "links"])

    cast = joined(apart, first, nodes, "inner").select("host", "layout", "signs", "parents", "sums", "chars", "links", "w_signs", "w_parents")
    cast = cast.mapInArrow(votes, "host string, layout long, node int, pages long, low long, high long, chars long, links long")
    each = cast.groupBy("host", "layout", "node").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    slots = each.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "pages", "low", "high", "chars", "links")).alias("slots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mains, sames = [], []
            for r in b.select(["w_signs", "w_parents", "slots"]).to_pylist():
                told = Slots(*([0] * len(r["w_signs"]) for _ in range(5)))
                for s in r["slots"] or ():
                    for name, held in vars(told).items():
                        held[s["node"]] = s[name]
                main, same = main_container(r["w_signs"], r["w_parents"], told)
                mains.append(main)
                sames.append(sorted(same))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(mains, pa.int32()), pa.array(sames, pa.list_(pa.int32()))], names=["host", "layout", "w_signs", "w_parents", "w_main", "w_same"])

    decided = first.join(slots, ["host", "layout"], "left").select("host", "layout", "w_signs", "w_parents", "slots")
    return written(decided.mapInArrow(decide, "host string, layout long, w_signs array<string>, w_parents array<int>, w_main int, w_same array<int>")), nodes


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string): each page's main text, blocks joined by blank lines.

    Null or empty html gives an empty text; a page without a usable URL belongs to a host of its own kind (the empty
    one); repeated pages give repeated rows and count once for the wrapper. Other columns are left out.
    """
    trees = parsed(pages, id_col, url_col, html_col)
    found, nodes = wrappers(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for r in b.to_pylist():
                size = len(r["signs"])
                page = Page(r["signs"], r["parents"], [False] * size, [False] * size, r["text"], r["links"])
                for marks, held in ((page.out, r["out"]), (page.main, r["main"])):
                    for k in held:
                        marks[k] = True
                fit = align(page.signs, page.parents, r["w_signs"], r["w_parents"]) if r["w_signs"] else None
                texts.append(main_text(page, fit, r["w_main"] or 0, frozenset(r["w_same"] or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = joined(trees, found, nodes, "left").select("id", "url", "signs", "parents", "links", "out", "main", "text", "w_signs", "w_parents", "w_main", "w_same")
    given = ", ".join(f"{c} {trees.schema[c].dataType.simpleString()}" for c in ("id", "url"))
    return out.mapInArrow(run, f"{given}, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
