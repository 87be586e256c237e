"""Main text of web pages by wrappers inferred for each host.

A page becomes a tree of block elements with text slots; in a run of equal siblings one stands for
all, repeated. Trees of a host are aligned one after the other into its wrapper, a regular
expression without unions: what one lacks becomes optional, what comes more often repeated, text that differs a slot.
The wrapper says which slots are the article, and the pages are then read slot by slot.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, arrow, join_small, stored, texts_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title|select|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[A-Za-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Element names of the HTML standard, and words that class and id attributes commonly use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAK = frozenset(("br", "hr"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input link meta".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("article main nav header footer aside form section table body html".split())
ASIDE = frozenset("nav footer aside form head dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login search form widget share sharing social related recommended comment comments reply replies disqus discussion pagination pager toc".split()
)
#: Words that with the above make up one class, as in site-header or menu-list; of others, as in entry-header or has-sidebar, it is not beside the article.
LAYOUT_WORDS = frozenset("site main top bottom left right primary secondary global wrapper wrap container box bar area block inner list links link item items button buttons icons text section widget widgets posts".split())
ARTICLE_WORDS = frozenset("article content post entry story main body".split())
#: Different trees of a host that one task aligns; of more, so many at a time become one first.
FOLD = 64
#: Copies of its wrappers over which a host's pages are spread where the wrappers are too many to broadcast.
SALTS = 16
#: Pages from which a text that is the same on every page of a host counts as its boilerplate.
SAME_PAGES = 3
#: Pairs of children up to which an alignment keeps the whole table.
CELLS = 4 << 20
SKELETON = "host string, shape string, skeleton string, texts array<struct<path: long, hash: long, chars: long>>"
READ = "host string, shape string, slots array<struct<path: long, text: string, own: boolean>>"


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def _sign(name: str, attrs: str) -> str:
    """An element's name with what marks its role: ``div!`` is beside the article, ``div*`` may hold it; ``div!!`` is beside it by its role, not its class."""
    if name in ASIDE:
        return name + "!"
    mark = ""
    for key, a, b, c in ATTRIBUTE.findall(attrs) if attrs else ():
        tokens = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", t).lower()) for t in (a or b or c).split()]
        words = {w for t in tokens for w in t}
        if key.lower() == "role":
            if ASIDE_ROLES & words:
                mark = "!!"
        elif name not in ("body", "html", "article", "main"):
            if any(ASIDE_WORDS.intersection(t) and ASIDE_WORDS.union(LAYOUT_WORDS).issuperset(t) for t in tokens):
                mark = "!!" if mark == "!!" else "*!" if "*" in mark or ARTICLE_WORDS & words else "!"
            elif ARTICLE_WORDS & words and mark in ("", "!"):
                mark = "*" + mark
    return name + mark


class Page:
    """A page's elements in order, each after the one it is in, and its runs of text between block boundaries.

    ``sign`` and ``up`` tell of each element its sign and the number of its parent; element 0 is the page. ``texts`` holds pairs (element,
    text), not blank, references decoded, white space as it was. Everything takes time in proportion to the page, however deep it is.
    """

    def __init__(self, html: str):
        self.sign, self.up, self.texts = [""], [0], []
        self._parse(html)
        self._pardon()

    def _parse(self, html: str) -> None:
        sign, up = self.sign, self.up
        path = [0]
        names = [""]  # of the elements in path
        places: dict[str, list[int]] = {}  # of each name in path
        scopes: list[int] = []  # places of elements that end tags inside do not close
        held: list[str] = []
        at = 0
        aside = 0  # inline elements beside the article, as a notice in a span

        def flush() -> None:
            if held and (text := unescape("".join(held))).strip():
                self.texts.append((path[-1], text))
            held.clear()

        def close(to: int) -> None:
            while len(path) > to:
                path.pop()
                places[names.pop()].pop()
                if scopes and scopes[-1] == len(path):
                    scopes.pop()

        for m in MARKUP.finditer(html):
            if m.start() > at and not aside:
                held.append(html[at : m.start()])
            at = m.end()
            name = (m.group("name") or "").lower()
            if not name:
                continue
            end = html[m.start() + 1] == "/"
            if name in INLINE and name not in VOID:
                attrs = m.group("attrs")
                if aside:
                    aside += -1 if end else 1 if not attrs.rstrip().endswith("/") else 0
                elif not end and attrs and _sign(name, attrs).endswith("!"):
                    aside = 1
                continue
            if name in INLINE:
                continue
            aside = 0
            flush()
            if name in VOID:
                continue
            if end:
                if mine := places.get(name):
                    if name in SCOPE or not scopes or scopes[-1] <= mine[-1]:
                        close(mine[-1])
                continue
            while len(path) > 1 and (names[-1] in CLOSES.get(name, ()) or (names[-1] == "p" and name in ENDS_P)):
                close(len(path) - 1)
            attrs = m.group("attrs")
            if not attrs.rstrip().endswith("/") or name not in ("svg", "path"):
                mark = _sign(name, attrs)
                if name == "header" and not (places.get("article") or places.get("main")):
                    mark = "header!"
                if name in SCOPE:
                    scopes.append(len(path))
                places.setdefault(name, []).append(len(path))
                up.append(path[-1])
                path.append(len(sign))
                names.append(name)
                sign.append(mark)
        if html[at:] and not aside:
            held.append(html[at:])
        flush()

    def _inherited(self, test) -> list[bool]:
        """Whether an element, or one that it is in, passes."""
        out = [False]
        for s, u in zip(self.sign[1:], self.up[1:], strict=True):
            out.append(out[u] or test(s))
        return out

    def _pardon(self) -> None:
        """A class marks no element beside the article that holds the article or most of the text, unless the article is elsewhere."""
        sign, up = self.sign, self.up
        if not any(map(_soft, sign)):
            return
        hard = self._inherited(lambda s: s.endswith("!") and not _soft(s))
        soft, inside, star = self._inherited(_soft), self._inherited(lambda s: s in ROOTS), self._inherited(lambda s: s.endswith("*"))
        many, told_in = [0] * len(sign), [0] * len(sign)  # code points of an element, and those of article and main in it
        total = free = told = 0
        for e, text in self.texts:
            if not hard[e]:
                many[e] += len(text)
                total += len(text)
                if not soft[e]:
                    free += len(text)
                    told += len(text) if inside[e] or star[e] else 0
        for e in range(len(sign) - 1, 0, -1):
            many[up[e]] += many[e]
            told_in[up[e]] += many[e] if sign[e] in ROOTS else told_in[e]
        for e, s in enumerate(sign):
            if _soft(s) and (2 * many[e] > total or told_in[e] > free) and 10 * told < many[e]:
                sign[e] = s[:-1]

    def slots(self) -> list[tuple[int, str, bool, str, int]]:
        """Of each element: its path as a number, the element of the standard that holds the article if it is in one ("article" before "main"),
        whether it is beside the article, and the path down to the first place that class words mark, or 0."""
        from xxhash import xxh64_intdigest

        out = [(1, "", False, 0)]
        for s, u in zip(self.sign[1:], self.up[1:], strict=True):
            key, root, beside, star = out[u]
            key = xxh64_intdigest(f"{key}/{s}") >> 1
            root = "article" if s == "article" else root or ("main" if s == "main" else "")
            out.append((key, root, beside or s.endswith("!"), star or (key if s.endswith("*") else 0)))
        return out


#: Elements of the standard that hold the article, the one that decides first.
ROOTS = ("article", "main")


def _soft(sign: str) -> bool:
    """Whether only class words say that the element is beside the article."""
    return sign.endswith("!") and not sign.endswith("!!") and sign.rstrip("!*") not in ASIDE and sign != "header!"


def tree(html: str) -> list:
    return tree_of(Page(html))


def tree_of(page: Page) -> list:
    """The page as nested [sign, how often, children]; a text slot is ["#", how often, []]. Equal neighbours are one, repeated."""
    inner: list[list] = [[] for _ in page.sign]  # of each element: (number of its first block, child)
    first: list[int | None] = [None] * len(page.sign)
    for k, (e, _) in enumerate(page.texts):
        inner[e].append((k, ["#", 1, []]))
        while first[e] is None:
            first[e] = k
            if not e:
                break
            e = page.up[e]
    for e in range(len(page.sign) - 1, 0, -1):
        if first[e] is not None:
            inner[page.up[e]].append((first[e], [page.sign[e], 1, folded([c for _, c in sorted(inner[e], key=lambda x: x[0])])]))
        inner[e] = []
    return ["", 1, folded([c for _, c in sorted(inner[0], key=lambda x: x[0])])]


def _times(a: str | int, b: str | int, beside: bool) -> str | int:
    """beside: of neighbours; else of the same place in two pages."""
    if beside:
        return "+" if "?" not in (a, b) and "*" not in (a, b) else "*"
    if a == b:
        return a
    often, less = "+" in (a, b) or "*" in (a, b), "?" in (a, b) or "*" in (a, b)
    return "*" if often and less else "+" if often else "?"


def folded(children: list) -> list:
    """Neighbours of one sign become one repeated child that matches them all."""
    groups: list = []
    for c in children:
        _add(groups, c[0], c[1], [c])
    return [sources[0] if len(sources) == 1 else [sign, times, merged(sources)] for sign, times, sources in groups]


def _add(groups: list, sign: str, times: str | int, sources: list) -> None:
    if groups and groups[-1][0] == sign:
        groups[-1] = [sign, _times(groups[-1][1], times, True), groups[-1][2] + sources]
    else:
        groups.append([sign, times, sources])


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence. Ends that agree are trimmed first; large middles are halved, so that memory stays linear."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    code: dict[str, int] = {}
    p, q = (np.array([code.setdefault(s, len(code)) for s in z], np.int64) for z in (x, y))

    def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        row = np.zeros(len(b) + 1, np.int32)
        for s in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == s)))
        return row

    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and p[a] == q[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and p[b - 1] == q[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            middle = (a + b) // 2
            best = lengths(p[a:middle], q[c:d]) + lengths(p[middle:b][::-1], q[c:d][::-1])[::-1]
            cut = c + int(best.argmax())
            todo += [(a, middle, c, cut), (middle, b, cut, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), np.int32)
        for i in range(b - a - 1, -1, -1):
            best[i, :-1] = np.maximum.accumulate(np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (q[c:d] == p[a + i]))[::-1])[::-1]
        i = j = 0
        while i < b - a and j < d - c:
            if p[a + i] == q[c + j]:
                out.append((a + i, c + j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
    return sorted(out)


def merged(trees: list) -> list:
    """The children of the wrapper that matches what any of the trees matches: a longest common sequence of children pairs up, others become optional."""
    top: list = ["", 1, []]
    todo = [(top, trees)]
    while todo:
        node, sources = todo.pop()
        if len(sources) == 1 or all(t is sources[0] for t in sources):
            node[2] = sources[0][2]
            continue
        groups = [[c[0], c[1], [c]] for c in sources[0][2]]
        for t in sources[1:]:
            pairs = common([g[0] for g in groups], [c[0] for c in t[2]])
            out: list = []
            i = j = 0
            for a, b in [*pairs, (len(groups), len(t[2]))]:
                for sign, times, mine in groups[i:a]:
                    _add(out, sign, _times(times, "?", False), mine)
                for c in t[2][j:b]:
                    _add(out, c[0], _times(c[1], "?", False), [c])
                if a < len(groups):
                    _add(out, groups[a][0], _times(groups[a][1], t[2][b][1], False), [*groups[a][2], t[2][b]])
                i, j = a + 1, b + 1
            groups = out
        for sign, times, mine in groups:
            child = [sign, times, []]
            node[2].append(child)
            todo.append((child, mine))
    return top[2]


def aligned(a: list, b: list) -> list:
    """The wrapper of two trees of one page or host."""
    return [a[0], a[1], merged([a, b])]


def expression(node: list) -> str:
    """A wrapper as text: ``html(body(nav!(...)article(h1(#)p(#)+)))``."""
    out: list[str] = []
    todo: list = list(reversed(node[2])) if not node[0] else [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        times = "" if n[1] == 1 else n[1]
        out.append(n[0])
        if n[2]:
            out.append("(")
            todo.append(f"){times}")
            todo.extend(reversed(n[2]))
        else:
            out.append(times)
    return "".join(out)


def dumped(node: list) -> str:
    """A tree as one flat list: sign, how often, number of children of each node, each before its children."""
    flat: list = []
    todo = [node]
    while todo:
        sign, times, children = todo.pop()
        flat += (sign, times, len(children))
        todo.extend(reversed(children))
    return json.dumps(flat)


def loaded(text: str) -> list:
    flat = json.loads(text)
    top: list = ["", 1, []]
    path = [(top, 1)]
    for k in range(0, len(flat), 3):
        while not path[-1][1]:
            path.pop()
        parent, left = path.pop()
        path.append((parent, left - 1))
        node = [flat[k], flat[k + 1], []]
        parent[2].append(node)
        if flat[k + 2]:
            path.append((node, flat[k + 2]))
    return top[2][0]


def slots(node: list) -> Iterator[tuple[int, str, bool, int]]:
    """Of a wrapper's text slots what Page.slots() says of an element."""
    from xxhash import xxh64_intdigest

    todo = [(c, 1, "", False, 0) for c in node[2]]
    while todo:
        (s, _, children), key, root, beside, star = todo.pop()
        if s == "#":
            yield key, root, beside, star
            continue
        key = xxh64_intdigest(f"{key}/{s}") >> 1
        root = "article" if s == "article" else root or ("main" if s == "main" else "")
        todo += [(c, key, root, beside or s.endswith("!"), star or (key if s.endswith("*") else 0)) for c in children]


def _rooted(found: Iterable[tuple[int, str, bool, int]]) -> tuple[str, list[tuple[int, str, bool, int]]]:
    """The element of the standard that holds the article, and the slots in it."""
    kept = [f for f in dict.fromkeys(found) if not f[2]]
    for root in ROOTS:
        if inside := [f for f in kept if f[1] == root]:
            return root, inside
    return "", kept


def shape_of(found: Iterable[tuple[int, str, bool, int]]) -> str:
    """What pages of one template share: the element that holds the article, or else the places that class words mark as such."""
    root, kept = _rooted(found)
    return root or " ".join(f"{k:x}" for k in sorted({f[3] for f in kept if f[3]}))


def own_slots(found: Iterable[tuple[int, str, bool, int]]) -> set[int]:
    """The slots of the article as a page alone tells them."""
    root, kept = _rooted(found)
    return {f[0] for f in (kept if root else [f for f in kept if f[3]] or kept)}


def article_slots(wrapper: list, chars: dict[int, int], same: set[int]) -> list[int]:
    """The slots of the article in a wrapper of pages of one shape. chars: of each slot's text over all pages; same: slots with one text on every page."""
    root, kept = _rooted(slots(wrapper))
    if root:
        return [f[0] for f in kept]
    kept = [f for f in kept if f[0] not in same] or kept
    starred = [f for f in kept if f[3]]
    if sum(chars.get(f[0], 0) for f in starred) * 2 >= sum(chars.get(f[0], 0) for f in kept) > 0:
        kept = starred
    return [f[0] for f in kept]


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, shape, wrapper, paths``: a row per host and shape of its pages. pages: columns host and html, both without nulls."""
    path_kind = pa.list_(pa.struct([("path", pa.int64()), ("hash", pa.int64()), ("chars", pa.int64())]))

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            shapes, out, texts = [], [], []
            for html in texts_of(batch.column(1)):
                page = Page(html)
                places = page.slots()
                shapes.append(shape_of(places[e] for e, _ in page.texts))
                out.append(dumped(tree_of(page)))
                mine: dict[int, list] = {}
                for e, text in page.texts:
                    mine.setdefault(places[e][0], []).append(" ".join(text.split()))
                texts.append([{"path": p, "hash": xxhash.xxh64_intdigest("\n".join(t)) >> 1, "chars": sum(map(len, t))} for p, t in mine.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string()), pa.array(out, pa.string()), pa.array(texts, path_kind)], names=["host", "shape", "skeleton", "texts"])

    found = stored(arrow(pages.select("host", "html"), skeletons, SKELETON))
    whole = _folded(found.select("host", "shape", "skeleton").distinct())
    seen = found.select("host", "shape", F.explode("texts").alias("t")).groupBy("host", "shape", "t.path").agg(F.sum("t.chars").alias("chars"), F.count("*").alias("n"), (F.min("t.hash") == F.max("t.hash")).alias("one"))
    stats = seen.groupBy("host", "shape").agg(F.to_json(F.collect_list(F.struct("path", "chars", "n", "one"))).alias("stats"))
    pages_of = found.groupBy("host", "shape").agg(F.count("*").alias("pages"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, paths = [], []
            for w, st, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                rows, wrapper = json.loads(st or "[]"), loaded(w)
                same = {r["path"] for r in rows if r["one"] and r["n"] == n >= SAME_PAGES}
                shown.append(expression(wrapper))
                paths.append(article_slots(wrapper, {r["path"]: r["chars"] for r in rows}, same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string()), pa.array(paths, pa.list_(pa.int64()))], names=["host", "shape", "wrapper", "paths"])

    return arrow(whole.join(stats, ["host", "shape"], "left").join(pages_of, ["host", "shape"]).select("host", "shape", "skeleton", "stats", "pages"), decide, "host string, shape string, wrapper string, paths array<bigint>")


def _folded(shapes: DataFrame) -> DataFrame:
    """One tree per host and shape, of all its different trees: FOLD at a time become one, until a task can take the rest."""
    while True:
        sizes = stored(shapes.groupBy("host", "shape").agg(F.count("*").alias("n")))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= FOLD:
            return _fold(shapes, ["host", "shape"])
        salted = join_small(shapes, sizes, ["host", "shape"], row_bytes=256).withColumn("salt", F.pmod(F.xxhash64("skeleton"), F.ceil(F.col("n") / FOLD)))
        shapes = stored(_fold(salted, ["host", "shape", "salt"]).distinct())


def _fold(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """One tree per key, of all its trees aligned; one tree at a time is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.string()), pa.array([dumped(held)], pa.string())], names=["host", "shape", "skeleton"])

        for batch in batches:
            for key, shape in zip(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True), batch.column(len(keys)).to_pylist(), strict=True):
                if key != now:
                    if held is not None:
                        yield out()
                    now, held = key, loaded(shape)
                else:
                    held = aligned(held, loaded(shape))
        if held is not None:
            yield out()

    return arrow(shapes.repartition(*keys).sortWithinPartitions(*keys, "skeleton").select(*keys, "skeleton"), fold, "host string, shape string, skeleton string")


def extract(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null page is empty; pages without a host in their url share wrappers. Pages of a host with other shapes have another wrapper; a page with
    nothing in its wrapper's article slots is read by its own. Equal rows, and rows with one id or none, are pages of their own; elements may be nested and
    pages long without bound, and other columns are left out.
    """
    named = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # as host_of()
    named = named.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    known = stored(wrappers(named))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, out = [], []
            for html in texts_of(batch.column(3)):
                page = Page(html)
                places = page.slots()
                mine = [places[e] for e, _ in page.texts]
                shapes.append(shape_of(mine))
                own = own_slots(mine)
                out.append([{"path": f[0], "text": " ".join(t.split()), "own": f[0] in own} for f, (_, t) in zip(mine, page.texts, strict=True) if not f[2]])
            kind = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string()), ("own", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(shapes, pa.string()), pa.array(out, kind)], names=["page_id", "url", "host", "shape", "slots"])

    each = arrow(named.select("page_id", "url", "host", "html"), read, f"page_id {named.schema['page_id'].dataType.simpleString()}, url string, {READ}")
    if known.count() <= BROADCAST_ROWS // 64:
        both = each.join(F.broadcast(known.select("host", "shape", "paths")), ["host", "shape"], "left")
    else:  # the pages of a host are spread over as many copies of its wrappers
        both = each.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(known.select("host", "shape", "paths", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long").alias("salt")), ["host", "shape", "salt"], "left")
    texts = lambda test: F.array_join(F.transform(F.filter("slots", test), lambda s: s["text"]), " ")
    both = both.withColumn("text", texts(lambda s: F.array_contains("paths", s["path"])))
    both = both.withColumn("text", F.when(F.coalesce("text", F.lit("")) == "", texts(lambda s: s["own"])).otherwise(F.col("text")))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
