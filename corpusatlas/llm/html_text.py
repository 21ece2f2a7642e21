"""Main text of web pages by site style trees.

Pages of a host are merged by the tag paths of their DOMs, furniture and all. A path's presentation importance is the
entropy (base: the pages that have it) of its children's styles; its content importance is one minus the mean entropy of
the texts under it across pages, so texts that every page repeats weigh nothing. Their weighted sum is the path's
composite importance. From each page go first the branches that are below `threshold` (on hosts with `min_pages` different
pages or more: fewer are no evidence), then those that are furniture by element, role or class: menus, adverts and reader
comments whose words differ from page to page have a high importance. On a page with an article or main element, branches
outside it have no importance; inside it importance removes branches but not paragraphs and the like, so that a passage
that several articles quote stays, and class words that articles use for their own parts do not count.

Statistics are sums over (host, path, text) and (host, path, style), folded to one row a path before anything is joined:
nothing of a host is gathered in one task. Pages equal in html count once.

The table may hold: null or empty html (empty text), null urls (one host of their own), unclosed and crossing elements
(closed as browsers do, approximately; an unread element without an end tag hides nothing but a script's or style's text up
to the next block), pages of any length and depth (a path is a hash; the work for ancestors is paid once a path with
text), repeated rows, nothing, any other columns (kept by `extract`; one named `text` is replaced).
"""

from __future__ import annotations

import functools
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm.common import free_name, materialise, portions

#: Fixed values of HTML: elements without an end tag, elements without text to read, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe object svg canvas head title select option textarea datalist audio video annotation".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot li dd dt".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What marks furniture: elements, roles, and words of class and id attributes.
FURNITURE = frozenset("nav aside footer form button input dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion reader related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Of these, words that articles use for their own parts: none counts inside the core on a text block, these not at all.
OWN_TEXT = frozenset("header masthead reader notice notices note share sharing related social popup widget promotion".split())
OWN_PART = frozenset("header masthead reader".split())
CORE = frozenset(("article", "main"))
#: Elements that are text blocks: inside a core, importance does not remove these themselves, only branches around them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table thead tbody tfoot tr td th caption dl dt dd li".split())
P, NOT_P, NOTHING = frozenset("p"), BLOCK - frozenset("p"), frozenset()
LISTS = frozenset("ul ol dl table menu".split())
INLINE_STOPS = frozenset("article body div main nav aside section table".split())


@functools.lru_cache(1 << 16)
def path_id(parent: int, name: str) -> int:
    """A path's hash: of its parent's and its last step."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(name.encode("utf-8", "replace"), parent & (1 << 64) - 1) - (1 << 63)


ROOT = 0


class Node:
    __slots__ = ("children", "furniture", "parent", "path", "tag", "unread")

    def __init__(self, tag: str, parent: Node | None, path: int, furniture: bool = False, unread: bool = False):
        self.tag, self.parent, self.path, self.furniture, self.unread, self.children = tag, parent, path, furniture, unread, []


def is_furniture(tag: str, attrs: dict, in_core: bool) -> bool:
    if not attrs:
        return tag in FURNITURE or tag == "header" and not in_core
    if tag in FURNITURE or tag == "header" and not in_core or "hidden" in attrs:
        return True
    if (attrs.get("role") or "").lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    words = MARKS.intersection(re.split(r"[^a-z0-9]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
    return bool(words - (OWN_TEXT if tag in TEXT else OWN_PART) if in_core else words)


#: A quotation mark opens a value only behind an equals sign; elsewhere it is a character like others.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)?+)*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTR = re.compile(r"""([^\s=/>\"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK | {'body'}))})(?=[\s/>])", re.I)


@functools.lru_cache(4096)
def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(ATTR.findall(raw))}


class Tree:
    """A lenient DOM. Texts are children of kind str, line breaks are spaces."""

    def __init__(self, source: str):
        self.root = Node("#", None, ROOT)
        self.stack, self.core, self.source, self.ends = [self.root], 0, source, {}
        # behind the last > no tag ends, so one that begins there is dropped as at the end of a file
        last = source.rfind(">") + 1
        rest = re.match(r"(?:[^<]|<(?![A-Za-z/!?]))*+", source[last:])[0]
        source, at = source[:last] + rest, 0
        while m := TOKEN.match(source, at):
            at = m.end()
            if text := m["text"]:
                self.stack[-1].children.append(html.unescape(text) if "&" in text else text)
            elif tag := m["tag"]:
                tag = tag.lower()
                if m["end"]:
                    self._close(tag)
                elif tag not in UNREAD or self._ends(tag, at):
                    if tag in RAW:
                        at = at if m["attrs"].endswith("/") else self.ends[tag][1]
                    else:
                        self._open(tag, m["attrs"])
                elif tag in ("script", "style") and not m["attrs"].endswith("/"):
                    block = BLOCK_TAG.search(source, at)
                    at = block.start() if block else len(source)

    def _ends(self, tag: str, at: int) -> bool:
        """Whether an end tag follows. Its place is kept, so that a page is searched once for each tag."""
        if (found := self.ends.get(tag, (-1, -1)))[0] < at and found[0] is not None:
            m = re.compile(rf"</{tag}\s*>", re.I).search(self.source, at)
            found = self.ends[tag] = (m.start(), m.end()) if m else (float("inf"), None)
        return found[1] is not None

    def _open(self, tag: str, raw: str) -> None:
        stack = self.stack
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(" " if tag == "br" else Node(tag, stack[-1], path_id(stack[-1].path, tag)))
            return
        if tag in CLOSES_P:
            self._end(P, NOT_P)
            if stack[-1].tag in ("select", "option", "head"):
                self._end(frozenset(("select", "head")), NOTHING)
        elif tag in SIBLINGS:
            self._end(SIBLINGS[tag], LISTS)
        if tag == "body":
            self._end(frozenset(("head",)), NOTHING)
        if tag == "body" and any(n.tag == "body" for n in stack) or tag == "html" and len(stack) > 1:
            return
        if raw.endswith("/") and tag not in BLOCK and tag not in ("html", "body"):
            return
        given = attributes(raw) if raw.strip(" /") else {}
        name = f"{tag}.{'.'.join(given['class'].split())}" if given.get("class") else tag
        node = Node(tag, stack[-1], path_id(stack[-1].path, name), is_furniture(tag, given, self.core > 0), tag in UNREAD)
        self.core += tag in CORE
        stack[-1].children.append(node)
        stack.append(node)

    def _close(self, tag: str) -> None:
        if tag not in VOID:
            self._end({tag}, INLINE_STOPS if tag not in BLOCK else NOTHING)

    def _end(self, tags, barrier) -> None:
        """Closes the innermost open element of these tags, and all inside it, unless a barrier is met first."""
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                self.core -= sum(n.tag in CORE for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return


def walk(root: Node):
    """(node, inside core) of all elements, without recursion: pages may nest deeply."""
    stack = [(root, False)]
    while stack:
        node, core = stack.pop()
        yield node, core
        inside = core or node.tag in CORE
        stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))


def blocks(root: Node, noise: frozenset[int] = frozenset()) -> list[str]:
    """The texts of blocks in page order, without furniture and the branches of noise."""
    out, held = [], []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    stack: list = [(root, root.tag in CORE)]
    while stack:
        node, core = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            held.append(node)
        elif not (node.unread or node.path in noise and not (core and node.tag in TEXT) or node.furniture):
            inside = core or node.tag in CORE
            block = node.tag in BLOCK
            if block:
                flush()
                stack.append((None, False))
            stack.extend((c, inside) for c in reversed(node.children))
    flush()
    return out


def main_text(source: str | None, noise: frozenset[int] = frozenset()) -> str:
    """What noise and furniture leave. On a page that marks its core, branches outside it have no importance."""
    if not source:
        return ""
    tree = Tree(source).root
    cores = [n for n, inside in walk(tree) if n.tag in CORE and not inside and not n.furniture and not n.unread]
    found = [b for n in cores for b in blocks(n, noise - {n.path})]
    return "\n\n".join(found or blocks(tree, noise))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, kind, path, value, page, up) of each page's nodes: kind `s` with the children's tags, kind `t` with the text.
    `up`, the path and its ancestors, stands once for a path with text in a portion."""

    def step(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def key(s: str) -> int:
            return xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for b in batches:
            for part in portions(b, "html", 256):
                rows, told = [], set()
                for host, page, source in zip(*(part.column(k).to_pylist() for k in ("host", "page", "html")), strict=True):
                    seen = set()
                    for node, _ in walk(Tree(source or "").root):
                        if node.unread:
                            continue
                        tags, texts = [], []
                        for c in node.children:
                            if isinstance(c, str):
                                texts.append(c)
                            elif not tags or tags[-1] != c.tag:
                                tags.append(c.tag)
                        seen.add(("s", node.path, key(",".join(tags))))
                        if text := " ".join("".join(texts).split()):
                            seen.add(("t", node.path, key(text)))
                            if (host, node.path) not in told:
                                told.add((host, node.path))
                                up, n = [], node
                                while n.parent:
                                    up.append(n.path)
                                    n = n.parent
                                rows.append((host, "u", node.path, 0, page, up))
                    rows += [(host, *x, page, None) for x in seen]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["host", "kind", "path", "value", "page", "up"])

    return pages.mapInArrow(step, "host string, kind string, path long, value long, page long, up array<long>")


def importance(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(host, path, pages, presentation, content, composite) of the site style trees; pages: host, page (a hash), html."""
    rows = materialise(style_rows(pages), "styles")
    counts = rows.filter("kind <> 'u'").groupBy("host", "kind", "path", "value").agg(F.count_distinct("page").alias("c"))
    sizes = rows.filter("kind = 's'").groupBy("host", "path").agg(F.count_distinct("page").alias("pages"))
    # sums of c log c give the entropies, so a path is one row before it meets its number of pages
    sums = counts.groupBy("host", "kind", "path").agg(F.sum("c").cast("double").alias("w"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.count("*").alias("n")).join(sizes, ["host", "path"])
    m, many = F.col("pages"), F.col("pages") > 1
    shown = sums.filter("kind = 's'").select("host", "path", "pages", F.col("n").alias("styles"), F.when(many, (F.col("w") * F.log(m) - F.col("cl")) / (m * F.log(m))).otherwise(1.0).alias("presentation"))
    # each text's entropy over the pages of its path, weighted by how often it stands there, handed to all ancestors
    texts = sums.filter("kind = 't'").select("host", "path", "w", F.when(many, F.col("cl") / F.log(m)).otherwise(0.0).alias("h"))
    up = rows.filter("kind = 'u'").groupBy("host", "path").agg(F.max("up").alias("up"))
    told = texts.join(up, ["host", "path"]).select("host", F.explode("up").alias("path"), "h", "w").groupBy("host", "path").agg((1 - F.sum("h") / F.sum("w")).alias("content"))
    out = shown.join(told, ["host", "path"], "left").withColumn("content", F.coalesce("content", "presentation"))
    share = F.pow(F.lit(gamma), F.col("styles"))
    return out.withColumn("composite", (1 - share) * F.col("presentation") + share * F.col("content"))


def noise_paths(pages: DataFrame, threshold: float = 0.2, min_pages: int = 8, gamma: float = 0.9) -> DataFrame:
    """(host, noise): the paths of low importance of each host that has enough different pages."""
    html_ = path_id(ROOT, "html")
    low = importance(pages, gamma).filter((F.col("pages") >= min_pages) & (F.col("composite") < threshold) & ~F.col("path").isin(ROOT, html_, path_id(html_, "body")))
    return low.groupBy("host").agg(F.collect_set("path").alias("noise"))  # a template's paths


def extract(pages: DataFrame, threshold: float = 0.2, min_pages: int = 8, gamma: float = 0.9, broadcast_paths: int = 1_000_000, name: str = "text") -> DataFrame:
    """pages with the main text of each in column `name`."""
    host = free_name(pages, "host")
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    noise = materialise(noise_paths(keyed, threshold, min_pages, gamma).withColumnsRenamed({"host": host, "noise": f"{host}n"}), "noise")
    # 8 bytes a path: broadcast while they are few, else joined by host (the engine splits a hot one)
    few = (noise.agg(F.sum(F.size(f"{host}n") + 8)).first()[0] or 0) <= broadcast_paths
    side = F.broadcast(noise) if few else noise
    joined = pages.withColumn(host, host_of(F.col("url"))).join(side, host, "left")

    @F.pandas_udf("string")
    def text_of(sources, noise):
        import pandas as pd

        return pd.Series([main_text(h, frozenset(n) if n is not None else NOTHING) for h, n in zip(sources, noise, strict=True)], dtype=object)

    out = joined.withColumn(f"{host}t", text_of(F.col("html"), F.col(f"{host}n"))).drop(host, f"{host}n")
    return out.withColumn(name, F.col(f"{host}t")).drop(f"{host}t")
