"""Main text of web pages by site style trees.

The pages of a host are merged: a node of the merged tree is a path of block elements with their classes and ids. A node's
presentations are the sequences of block children that pages have there, its contents the texts below it. With l presentations
its importance is (1 - GAMMA**l) times their entropy (varied layout is content) plus GAMMA**l times one minus the mean
normalised entropy of its contents over pages (text that most pages repeat is furniture).

On a page the importance of a branch is that of its node, times what the page itself says of it: elements for menus, forms and the like
have none; class and id words of furniture weigh it down, and so does standing beside the article (or main) element that
holds the page's story. Branches of low importance are cut, inside article and main as well; one with most of a page's
text is cut only if its name says so and the story stands elsewhere. Nodes that fewer than LEAST_PAGES pages show have importance 1.

Counts are additive over pages, so a host of any size is only ever summed.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace

#: Importance below which a branch is cut, pages that must show a node first, and the weight of contents by presentation.
LOW, LEAST_PAGES, GAMMA = 0.3, 4, 0.9
#: Weights of a branch: beside the story; named with a word that other things may bear, too; named as furniture.
BESIDE, HINTED, NAMED = 0.5, 0.5, 0.25
#: Deeper elements belong to the node above them.
DEPTH = 256
#: Low branches over all hosts up to which they are sent to all executors.
BROADCAST_BRANCHES = 200_000

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|svg)\b(?P<rawattrs>[^>]*)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>?|<(?=[a-zA-Z])[^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# fixed values: elements
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset("head title nav footer aside form menu dialog button select option object embed canvas".split())
_CONTENT = frozenset("article main".split())
_CLOSES_P = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table section article main header footer nav aside form blockquote pre figure hr address".split())
_SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# fixed values: words in classes, ids and roles
_NAMED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar cookie cookies consent gdpr newsletter subscribe signup "
    "login search share sharing social related recommended recommendations comment comments commentlist disqus respond pagination pager copyright contentinfo complementary".split()
)
_HINT_WORDS = frozenset("banner side notice notices alert popup modal overlay reply replies widget widgets toolbar legal dialog teaser header footer masthead".split())
_FRAME_WORDS = frozenset("header footer masthead side banner".split())  # a story has its own
_NEGATIONS = frozenset("no not has with without hide".split())
_NAME_SPLIT = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
# fixed values: text-bearing raw elements end at their own closing tag
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe textarea svg".split()}


def host_of(url: str | None) -> str:
    """Lower-case host of a URL, without user and port; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=1 << 14)
def _name_weight(names: str, inside: bool) -> float:
    """The weight of an element by its class, id and role words; inside: it stands in an article or main element."""
    weight = 1.0
    for name in names.split():
        words = [w.lower() for w in _NAME_SPLIT.split(name) if w]
        if not words or words[0] in _NEGATIONS:
            continue
        if _NAMED_WORDS.intersection(words):
            return NAMED
        if _HINT_WORDS.intersection(words).difference(_FRAME_WORDS if inside else ()):
            weight = HINTED
    return weight


class _Element:
    __slots__ = ("children", "depth", "path", "story", "tag", "weight")

    def __init__(self, tag: str, path: int, weight: float, story: int, depth: int):
        self.tag, self.path, self.weight, self.story, self.depth = tag, path, weight, story, depth
        self.children: list[int] = []


#: Elements that hold stories: an element is in none, in main, or in an article.
_MAIN, _ARTICLE = 1, 2


class Page:
    """Blocks and elements of one page. blocks: (text, paths of its element and of those above it, story); a path has one weight."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, tuple[int, ...], int]] = []
        self.styles: list[tuple[int, int]] = []
        self.weight: dict[int, float] = {0: 1.0}
        self._holding: dict[int, set[int]] = {_MAIN: set(), _ARTICLE: set()}  # paths of story elements, and of those inside and above them
        self._words: list[str] = []
        self._mute = ("", 0, 0)  # an inline element that is furniture, how often it is nested in itself, and the elements open around it
        self._open: Counter[str] = Counter()
        self._stack = [_Element("", 0, 1.0, 0, 0)]
        at = 0
        while m := _TOKEN.match(source, at):
            at = m.end()
            if m["raw"]:
                end = _RAW_END[m["raw"].lower()].search(source, at)
                at = end.end() if end else len(source)
            elif m["text"]:
                if not self._mute[1]:
                    self._words.append(m["text"])
            elif m["tag"]:
                self._tag(m["tag"].lower(), bool(m["close"]), m["attrs"] or "")
            if at >= len(source):
                break
        while len(self._stack) > 1:
            self._pop()
        self._flush()
        self.story = self._choose()

    def _choose(self) -> int:
        """The kind of element that holds the story: at least half of the text that no name weighs down; 0 if none does."""
        size = Counter()
        for text, path, story in self.blocks:
            if self.weight[path[-1] if path else 0] == 1:
                size[story] += len(text)
        whole = size.total()
        if size[_ARTICLE] and 2 * size[_ARTICLE] >= whole:
            return _ARTICLE
        return _MAIN if size[_MAIN] and 2 * (size[_ARTICLE] + size[_MAIN]) >= whole else 0

    def _flush(self) -> None:
        if self._words:
            text = " ".join(html.unescape("".join(self._words)).split())
            self._words = []
            if text:
                self.blocks.append((text, tuple(e.path for e in self._stack[1 : DEPTH + 1]), self._stack[-1].story))

    def _pop(self) -> None:
        self._flush()
        e = self._stack.pop()
        self._open[e.tag] -= 1
        if len(self._stack) < self._mute[2]:
            self._mute = ("", 0, 0)
        if e.depth <= DEPTH:
            shape = [c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]]
            self.styles.append((e.path, _hash(",".join(map(str, shape)))))

    def beside(self, path: int) -> bool:
        """No element with the story is at, above or below the path."""
        return self.story > 0 and path not in self._holding[self.story]

    @staticmethod
    def _names(attrs: str) -> str:
        return " ".join(x for a in _ATTR.findall(attrs) for x in a[1:] if x)

    def _tag(self, tag: str, close: bool, attrs: str) -> None:
        if tag in _INLINE:
            muted, nested, depth = self._mute
            if nested:
                self._mute = (muted, nested + (tag == muted) * (-1 if close else 1), depth)
            elif not close and attrs and _name_weight(self._names(attrs), True) <= NAMED:
                self._mute = (tag, 1, len(self._stack))
            return
        if tag == "br" or tag == "wbr":
            self._words.append(" ")
            return
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            return
        if close:
            if self._open[tag]:
                while self._stack[-1].tag != tag:
                    self._pop()
                self._pop()
            elif tag == "p":
                self._flush()
            return
        self._flush()
        if tag in _CLOSES_P and self._stack[-1].tag == "p":
            self._pop()
        if tag in _SELF_CLOSING:
            stop = _SELF_CLOSING[tag]
            alike = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            if any(self._open[x] for x in alike):
                for k in range(len(self._stack) - 1, 0, -1):
                    if self._stack[k].tag in stop:
                        break
                    if self._stack[k].tag in alike:
                        while len(self._stack) > k:
                            self._pop()
                        break
        top = self._stack[-1]
        names = self._names(attrs) if attrs else ""
        own = 0.0 if tag in _DROPPED or (tag == "header" and not top.story) else 1.0
        if own and names and tag not in ("html", "body", "main"):
            own = _name_weight(names, top.story > 0 or tag == "article")
            own = 1.0 if tag == "article" and own > NAMED else own
        story, weight = top.story, top.weight * own
        if weight == 1:
            story = _ARTICLE if tag == "article" else max(story, _MAIN) if tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I) else story
        deep = top.depth >= DEPTH
        e = _Element(tag, top.path if deep else _hash(f"{top.path} {tag} {names}"), weight, story, top.depth + 1)
        if deep and weight < top.weight:  # a branch of its own for what its weight cuts
            e.path = _hash(f"{top.path} {weight}")
        for kind in (_MAIN, _ARTICLE):
            if kind <= story:
                self._holding[kind].add(e.path)
                if top.story < kind:
                    self._holding[kind].update(x.path for x in self._stack)
        self.weight[e.path] = weight
        top.children.append(_hash(f"{tag} {names}"))
        self._stack.append(e)
        self._open[tag] += 1


def main_text(page: Page, importance: dict[int, float] | None = None) -> str:
    """The blocks that no cut branch holds. importance: of nodes; others have 1."""
    importance = importance or {}
    kept = [(text, path, page.weight[path[-1]] if path else 1.0) for text, path, _ in page.blocks]
    kept = [(text, path) for text, path, weight in kept if weight]
    size = Counter()
    for text, path in kept:
        for p in set(path):
            size[p] += len(text)
    whole = sum(len(t) for t, _ in kept)

    def cut(p: int) -> bool:
        beside = page.beside(p)
        if page.weight[p] * importance.get(p, 1.0) * (BESIDE if beside else 1.0) >= LOW:
            return False
        return 2 * size[p] <= whole or (beside and page.weight[p] <= NAMED)

    gone = {p for p in size if cut(p)}
    return "\n".join(t for t, path in kept if gone.isdisjoint(path))


def page_counts(page: Page) -> Iterator[tuple[int, int, int, int]]:
    """(kind, path, feature, times): 0 the page shows the path, 1 a presentation, 2 a text below the path."""
    for path in {p for p, _ in page.styles}:
        yield 0, path, 0, 1
    for (path, shape), n in Counter(page.styles).items():
        yield 1, path, shape, n
    texts = Counter()
    for text, path, _ in page.blocks:
        h = _hash(text)
        for p in set(path):
            texts[p, h] += 1
    for (path, h), n in texts.items():
        yield 2, path, h, n


def _count(batches):
    for batch in batches:
        found: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            if host:
                for kind, path, feature, n in page_counts(Page(source or "")):
                    x = found[host, kind, path, feature]
                    x[0] += n
                    x[1] += n * math.log(n)
        keys = list(zip(*found, strict=True)) if found else [[]] * 4
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        values = [pa.array([x[i] for x in found.values()], pa.float64()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip(keys, types, strict=True)] + values, names=["host", "kind", "path", "feature", "c", "cl"])


def site_style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of every node of every host's merged tree."""
    workspace.ship(pages.sparkSession)
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    counts = rows.mapInArrow(_count, "host string, kind int, path long, feature long, c double, cl double")
    counts = counts.groupBy("host", "kind", "path", "feature").agg(F.sum("c").alias("c"), F.sum("cl").alias("cl"))
    # a text's spread over pages is log(C) - L / C of its counts; a presentation's part in the node's entropy needs C and C log C
    spread = F.log("c") - F.col("cl") / F.col("c")
    is_kind = lambda k: F.col("kind") == k
    node = counts.groupBy("host", "path").agg(
        F.sum(F.when(is_kind(0), F.col("c"))).alias("pages"),
        F.sum(F.when(is_kind(1), F.col("c"))).alias("shown"),
        F.sum(F.when(is_kind(1), F.col("c") * F.log("c"))).alias("shown_log"),
        F.count_if(is_kind(1)).alias("styles"),
        F.sum(F.when(is_kind(2), spread)).alias("spread"),
        F.count_if(is_kind(2)).alias("texts"),
    )
    one = F.col("pages") < 2
    layout = F.when(one, 1.0).otherwise(F.least(F.lit(1.0), (F.log("shown") - F.col("shown_log") / F.col("shown")) / F.log("pages")))
    content = F.when(one | (F.col("texts") == 0), 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("spread") / F.col("texts") / F.log("pages")))
    by_content = F.pow(F.lit(GAMMA), F.col("styles"))
    return node.select("host", "path", F.col("pages").cast("long").alias("pages"), F.round((1 - by_content) * layout + by_content * content, 12).alias("importance"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html, ...)``.

    Null html is empty, and so is its text. A page without a host (null or relative url) is judged by its own elements and names alone.
    Equal rows give equal results; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    workspace.ship(spark)
    tree = site_style_tree(pages).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW / min(BESIDE, HINTED)))
    low = workspace.materialize(tree.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("low")), "branches")
    total = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]
    # host_of, as an expression
    authority = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", 1)
    host = F.lower(F.regexp_extract(F.substring_index(authority, "@", -1), r"^[^:]*", 0))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host).join(F.broadcast(low) if total <= BROADCAST_BRANCHES else low, "host", "left").select("page_id", "url", "html", "host", "low")

    def run(batches):
        for batch in batches:
            lists = batch.column("low")
            lows: dict[str, dict[int, float]] = {}
            texts = []
            for i in range(batch.num_rows):
                host = batch.column("host")[i].as_py()
                if host not in lows:
                    lows[host] = {x["path"]: x["importance"] for x in lists[i].as_py() or ()}
                texts.append(main_text(Page(batch.column("html")[i].as_py() or ""), lows[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
