"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching and merged into one tree, the host's wrapper. Text that most pages
of a host show at the same node is template; what varies there is content, unless the node says what it is: menus,
headers, footers, sidebars, adverts, notices, forms and readers' comments are named by their elements and classes, or are
links and nothing else on most pages.

Trees of elements are small (siblings of one label are instances of one repeating node), so wrappers are merged in groups
of bounded size, round by round, until each host has one; texts never travel for that, only their hashes are counted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.llm.common import batches, scalar, stored

# Elements by their role in HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr".split())
#: Never part of an article, whatever their class.
_SILENT = set("head script style title noscript template textarea iframe object embed canvas svg math audio video map "
              "select option datalist button input form fieldset nav footer aside menu dialog xmp noembed noframes".split())
_REGION = {"article", "main"}
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd td th tr tbody thead tfoot".split())
#: What an opening element ends, and where the search for it stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
         "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
         "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
         "body": ({"head"}, {"html"})}
#: Words of classes, ids and roles that say what an element is.
_CUES = set("nav navbar navigation menu menubar submenu header masthead footer sidebar aside complementary contentinfo banner ad ads "
            "adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
            "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin search "
            "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager paging comment comments "
            "commentlist discussion disqus respond replies reply widget toolbar copyright disclaimer skip form topnav sidenav "
            "subnav mainnav topbar mainmenu".split())
#: With these names a header is that of the article.
_OWN = set("article entry post story content body text title".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
                  re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements nest no deeper in the tree; what is deeper belongs to the last level. Nor are more open at once.
DEEPEST, OPEN = 100, 500


class Node:
    """An element. ``cue`` is what its names say: "" nothing, "header" a header, "other" anything else outside articles."""

    __slots__ = ("tag", "label", "cue", "children", "parent", "depth")

    def __init__(self, tag: str, label: str, cue: str, parent: Node | None):
        self.tag, self.label, self.cue, self.parent = tag, label, cue, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        if parent:
            parent.children.append(self)


def _said(attributes: str) -> tuple[list[str], str]:
    """The classes and ids of an element, and what its names say."""
    names: list[str] = []
    said: set[str] = set()
    if not attributes:
        return names, ""
    for name, *value in _ATTR.findall(attributes):
        name, value = name.lower(), value[0] or value[1] or value[2]
        if name in ("class", "id"):
            names += value.split()
        if name in ("class", "id", "role", "itemtype"):
            said |= {x.lower() for x in _NAMES.findall(value)}
    cues = said & _CUES
    if cues == {"header"}:
        return names, "" if said & _OWN else "header"
    return names, "other" if cues or _HIDDEN.search(attributes) else ""


class Page:
    """A parsed page: the tree of its block elements, and its blocks in page order with the part that is links."""

    def __init__(self, source: str):
        self.root = Node("#", "#", "", None)
        self.texts: list[str] = []
        self.links: list[int] = []
        self.owners: list[Node] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        node, at, anchors, words, linked = self.root, 0, 0, [], 0
        open_tags: list[str] = []                      # with inline elements, to find what an end tag ends
        nodes: list[Node | None] = []                  # the node of each open block element, None for inline ones

        def close() -> None:
            nonlocal words, linked
            text = " ".join("".join(words).split())
            if text:
                self.texts.append(text)
                self.links.append(min(linked, len(text)))
                self.owners.append(node)
            words, linked = [], 0

        def pop(count: int) -> None:
            nonlocal node, anchors
            outermost = next((known for known in nodes[-count:] if known is not None), None)
            if outermost is not None:
                close()
                node = outermost.parent
            del open_tags[-count:], nodes[-count:]
            anchors = open_tags.count("a") if anchors else 0

        def ended(tags: set, stops: set) -> None:
            for back, tag in enumerate(reversed(open_tags), 1):
                if tag in stops:
                    return
                if tag in tags:
                    # the outermost one of these below the stop
                    most = back
                    for more, outer in enumerate(reversed(open_tags[:-back]), back + 1):
                        if outer in stops:
                            break
                        if outer in tags:
                            most = more
                    return pop(most)

        while True:
            found = _TAG.search(source, at)
            text = source[at:found.start() if found else len(source)]
            if text:
                text = html.unescape(text)
                words.append(text)
                if anchors:
                    linked += len(text)
            if not found:
                break
            at = found.end()
            tag = found[2]
            if not tag:
                continue
            tag = tag.lower()
            if found[1]:
                if tag in open_tags:
                    # inline elements end inside their block only
                    for back, open_tag in enumerate(reversed(open_tags), 1):
                        if open_tag == tag:
                            pop(back)
                            break
                        if tag in _INLINE and nodes[-back] is not None:
                            break
                continue
            if tag == "br" or tag == "hr":
                words.append(" ")
                continue
            if tag in _VOID:
                continue
            if tag in _CLOSES_P and "p" in open_tags:
                ended({"p"}, {"table", "button", "object", "td", "th", "caption"})
            if tag in _ENDS:
                ended(*_ENDS[tag])
            if tag == "a":
                anchors += 1
            if len(open_tags) >= OPEN and tag not in _RAW:
                continue
            names, cue = _said(found[3][:-1])
            if tag in _INLINE and not cue:
                open_tags.append(tag)
                nodes.append(None)
                continue
            close()
            label = ".".join([tag, *sorted({re.sub(r"\d+", "0", x) for x in names})])
            node = Node(tag, label, cue, node if node.depth < DEEPEST else node.parent)
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(source, at)
                node, at = node.parent, end.end()
                continue
            open_tags.append(tag)
            nodes.append(node)
        close()


# ---- trees and wrappers ------------------------------------------------------------------------------
# A tree is [label, number of pages, children]; a wrapper is one, a page's tree has the number 1.

def shape(node: Node) -> tuple[list, dict[Node, list]]:
    """The tree of a page, siblings of one label merged, and the tree node of each element."""
    tree, place = [node.label, 1, []], {node: None}
    place[node] = tree
    waiting = [node]
    while waiting:
        parent = waiting.pop()
        into = place[parent]
        known = {child[0]: child for child in into[2]}
        for child in parent.children:
            if child.label not in known:
                known[child.label] = [child.label, 1, []]
                into[2].append(known[child.label])
            place[child] = known[child.label]
        waiting += reversed(parent.children)
    return tree, place


def _fits(a: str, b: str) -> bool:
    """The same element: equal labels, or one tag with a name in common; unique elements need no name."""
    if a == b:
        return True
    x, y = a.split("."), b.split(".")
    return x[0] == y[0] and (x[0] in ("html", "body", "main", "article") or bool(set(x[1:]) & set(y[1:])))


def match(a: list, b: list, pairs: list | None = None) -> int:
    """Simple tree matching: the largest mapping that keeps parents and the order of siblings; roots are taken to fit.

    The result is twice the number of mapped nodes, and one for each two with equal labels. ``pairs`` receives the nodes.
    """
    left, right = a[2], b[2]
    if pairs is not None:
        pairs.append((a, b))
    own = 2 + (a[0] == b[0])
    if not left or not right:
        return own
    rows, weight = [[0] * (len(right) + 1)], {}
    for i, x in enumerate(left):
        row = [0]
        for j, y in enumerate(right):
            best = max(rows[-1][j + 1], row[j])
            if _fits(x[0], y[0]):
                weight[i, j] = match(x, y)
                best = max(best, rows[-1][j] + weight[i, j])
            row.append(best)
        rows.append(row)
    if pairs is not None:
        i, j = len(left), len(right)
        mapped = []
        while i and j:
            if (i - 1, j - 1) in weight and rows[i][j] == rows[i - 1][j - 1] + weight[i - 1, j - 1]:
                i, j = i - 1, j - 1
                mapped.append((left[i], right[j]))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        for x, y in reversed(mapped):
            match(x, y, pairs)
    return own + rows[-1][-1]


def merge(wrapper: list, tree: list) -> list:
    """``wrapper`` with ``tree`` merged into it: mapped nodes add their pages, others are put in where they stand."""
    pairs: list = []
    match(wrapper, tree, pairs)
    twin = {id(y): x for x, y in pairs}
    for x, y in pairs:
        x[1] += y[1]
        merged, rest = [], list(x[2])
        for child in y[2]:
            known = twin.get(id(child))
            if known is None:
                merged.append(child)
                continue
            at = next(i for i, c in enumerate(rest) if c is known)
            merged += rest[:at + 1]
            del rest[:at + 1]
        x[2] = merged + rest
    return wrapper


def pruned(wrapper: list, share: float) -> list:
    """Without nodes on fewer than ``share`` of the pages: no text there can be on most of them, and the size is bounded."""
    least = share * wrapper[1]
    waiting = [wrapper]
    while waiting:
        node = waiting.pop()
        node[2] = [child for child in node[2] if child[1] >= least]
        waiting += node[2]
    return wrapper


def encoded(tree: list) -> str:
    """A tree as text: label, pages and children, depth first."""
    out, waiting = [], [tree]
    while waiting:
        label, pages, children = waiting.pop()
        out.append(f"{label} {pages} {len(children)}")
        waiting += reversed(children)
    return "\n".join(out)


def decoded(text: str) -> list:
    lines = iter(text.split("\n"))

    def node() -> tuple[list, int]:
        label, pages, children = next(lines).rsplit(" ", 2)
        return [label, int(pages), []], int(children)
    root, count = node()
    waiting = [(root, count)]
    while waiting:
        parent, count = waiting.pop()
        if not count:
            continue
        child, below = node()
        parent[2].append(child)
        waiting += [(parent, count - 1), (child, below)]
    return root


def slots(wrapper: list) -> dict[int, int]:
    """The number of each node of a wrapper, by its identity."""
    out, waiting = {}, [wrapper]
    while waiting:
        node = waiting.pop()
        out[id(node)] = len(out)
        waiting += reversed(node[2])
    return out


# ---- the article of a page ---------------------------------------------------------------------------

def _silent(node: Node, holds: set[Node], whole: int, size: dict[Node, int]) -> bool:
    if node in holds or node.tag in ("html", "body", "#", "h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    if node.tag in _SILENT and node.tag != "form":
        return True
    if node.tag == "form" or node.cue == "other":
        # what holds the title and most of the page is a layout, whatever its name
        return not (2 * size.get(node, 0) > whole and any(n.tag == "h1" for n in _below(node)))
    if node.tag == "header" or node.cue:
        return not any(n.tag in _REGION for n in _above(node))
    return False


def _below(node: Node) -> Iterator[Node]:
    waiting = [node]
    while waiting:
        waiting += (node := waiting.pop()).children
        yield node


def _above(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def judged(page: Page) -> tuple[list[bool], bool]:
    """Whether each block may belong to the article by what its elements say, and whether the page has marked its article."""
    size: dict[Node, int] = {}
    whole = sum(map(len, page.texts))
    for owner, text in zip(page.owners, page.texts):
        for node in (owner, *_above(owner)):
            size[node] = size.get(node, 0) + len(text)
    regions, waiting, quiet = [], [page.root], []
    while waiting:
        node = waiting.pop()
        if node.tag in _SILENT and node.tag != "form" or node.cue == "other" and node.tag != "body":
            quiet.append(node)
            continue
        if node.tag in _REGION and size.get(node):
            regions.append(node)
            if node.tag == "article":
                continue
        waiting += reversed(node.children)
    if not regions:
        # an article inside an element whose name misleads is an article still, if it has no such name itself
        waiting = quiet
        while waiting:
            node = waiting.pop()
            if node.tag in _SILENT and node.tag != "form":
                continue
            if node.tag in _REGION and node.cue != "other":
                regions += [node] if size.get(node) else []
                continue
            waiting += reversed(node.children)
    articles = [n for n in regions if n.tag == "article"]
    mains = [n for n in regions if n.tag == "main"]
    region = None
    if articles and not (mains and len(articles) == 1 and mains[0] in _above(articles[0])):
        region = max(articles, key=lambda n: size[n])
    elif mains:
        region = max(mains, key=lambda n: size[n])
    holds = {region, *_above(region)} if region else set()
    verdict: dict[Node, bool] = {}

    def speaks(node: Node) -> bool:
        chain = []
        while node is not None and node not in verdict:
            chain.append(node)
            node = node.parent
        good = verdict[node] if node is not None else True
        for node in reversed(chain):
            good = verdict[node] = good and not _silent(node, holds, whole, size)
        return good
    inside: dict[Node, bool] = {}
    keep = []
    for owner in page.owners:
        if owner not in inside:
            inside[owner] = speaks(owner) and (region is None or owner is region or region in _above(owner))
        keep.append(inside[owner])
    return keep, region is not None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def extracted(page: Page, place: dict[Node, list], numbers: dict[int, int], template: set[tuple[int, int]], menus: set[int]) -> str:
    """The article: blocks that may belong to it, without the template's texts and lists of links.

    Texts that are template make up less than half of an article; where they are more, the pages are copies of each other
    and nothing in them is template.
    """
    keep, marked = judged(page)
    kept, fixed = [], 0
    for at, (owner, text) in enumerate(zip(page.owners, page.texts)):
        if not keep[at]:
            continue
        slot = numbers.get(id(place[owner]), -1)
        if not marked and (slot in menus or slot < 0 and 10 * page.links[at] >= 6 * len(text)):
            continue
        known = bool(template) and (slot, _hash(text)) in template
        fixed += known * len(text)
        kept.append((text, known))
    copies = 2 * fixed >= sum(len(text) for text, _ in kept)
    return " ".join(text for text, known in kept if copies or not known)


# ---- Spark -------------------------------------------------------------------------------------------

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _hosts(pages: DataFrame) -> DataFrame:
    """``html, _host`` first; pages without a readable address are one host."""
    return pages.withColumn("_host", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))))


def _sources(part: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in part.column(name).to_pylist()]


_SEEN = "_host string, tree string, shape long, print long, nodes array<int>, hashes array<long>, sizes array<int>, links array<int>"


def _seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, tree, a hash of the tree and of all its text, and its different texts by node of the tree."""
    for batch in rows:
        for part in batches([batch]):
            out: list[list] = [[] for _ in range(7)]
            for source in _sources(part, "html"):
                page = Page(source)
                tree, place = shape(page.root)
                order = slots(tree)
                texts: dict[tuple[int, int], list] = {}
                for owner, text, links in zip(page.owners, page.texts, page.links):
                    one = texts.setdefault((order[id(place[owner])], _hash(text)), [0, 0])
                    one[0] += len(text)
                    one[1] += links
                coded = encoded(tree)
                values = (coded, _hash(coded), _hash("\n".join(page.texts)), [k[0] for k in texts], [k[1] for k in texts],
                          [v[0] for v in texts.values()], [v[1] for v in texts.values()])
                for column, value in zip(out, values):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([part.column("_host"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                  names=["_host", "tree", "shape", "print", "nodes", "hashes", "sizes", "links"])


def seen_pages(hosts: DataFrame) -> DataFrame:
    """What wrappers and templates need of each page of ``hosts`` (_host, html), written once: a tree and hashes, no text."""
    return stored(hosts.select("_host", "html").mapInArrow(_seen, _SEEN), "seen")


def induced(seen: DataFrame, *, group: int = 50, share: float = 0.02) -> DataFrame:
    """``_host, tree``: one wrapper per host of ``seen`` (see ``seen_pages``).

    Equal trees are counted first. Then trees of a host are merged in groups of about ``group``, dealt by their hash, and
    the merged ones again, until each host has one; a round never holds more than a group in a task.
    """
    # copies of a page say nothing about the template
    distinct = seen.select("_host", "tree", "print").distinct().groupBy("_host", "tree").agg(F.count(F.lit(1)).alias("pages"))
    level = stored(distinct, "trees")

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table.column("pages").to_pylist(), table.column("tree").to_pylist()), key=lambda x: (-x[0], x[1]))
        wrapper = None
        for pages, text in ordered:
            tree = decoded(text)
            if tree[1] == 1 and pages > 1:
                waiting = [tree]
                while waiting:
                    node = waiting.pop()
                    node[1] *= pages
                    waiting += node[2]
            wrapper = tree if wrapper is None else merge(wrapper, tree)
        return pa.table({"_host": [key[0].as_py()], "tree": [encoded(pruned(wrapper, share))], "pages": pa.array([1], pa.int64())})
    while True:
        sizes = level.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
        most = scalar(sizes.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("most"))).most
        dealt = level.join(sizes, "_host").withColumn(
            "_group", F.pmod(F.xxhash64("tree"), F.ceil(F.col("_n") / group)))
        level = stored(dealt.select("_host", "tree", "pages", "_group").groupBy("_host", "_group").applyInArrow(
            merged, "_host string, tree string, pages long"), "wrappers")
        if most <= group:
            return level.select("_host", "tree")


def _aligned(text: str, wrapper: str, cache: dict) -> dict[int, int]:
    """The wrapper's number of each node of a page's tree that has one."""
    found = cache.get((text, wrapper))
    if found is None:
        if len(cache) >= 512:
            cache.clear()
        whole, tree = decoded(wrapper), decoded(text)
        pairs: list = []
        match(whole, tree, pairs)
        numbers = slots(whole)
        order = slots(tree)
        found = cache[text, wrapper] = {order[id(y)]: numbers[id(x)] for x, y in pairs}
    return found


def _numbers(page: Page, wrapper: str, cache: dict) -> tuple[dict[Node, list], dict[int, int]]:
    tree, place = shape(page.root)
    found = _aligned(encoded(tree), wrapper, cache)
    order = slots(tree)
    return place, {at: found[number] for at, number in order.items() if number in found}


def _slots_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper's number of each node of a tree, -1 for none."""
    for batch in rows:
        found = []
        for text, wrapper in zip(_sources(batch, "tree"), _sources(batch, "wrapper")):
            known = _aligned(text, wrapper, {})
            found.append([known.get(at, -1) for at in range(text.count("\n") + 1)])
        yield pa.record_batch([batch.column("_host"), batch.column("shape"), pa.array(found, pa.list_(pa.int32()))], names=["_host", "shape", "slots"])


def templates(seen: DataFrame, wrappers: DataFrame, *, most: float = 0.5, least: int = 3, links: float = 0.6) -> DataFrame:
    """``_host, tree, fixed, menus``: each host's wrapper, the texts that are template (node and hash) and the nodes of links.

    Every different tree is aligned with the wrapper once. A text is template at a node if ``least`` different pages of the
    host, and ``most`` of those that have the node, show it there. Counts are aggregates with map-side combining.
    """
    trees = seen.select("_host", "shape", "tree").distinct().join(wrappers.withColumnRenamed("tree", "wrapper"), "_host")
    aligned = stored(trees.select("_host", "shape", "tree", "wrapper").mapInArrow(_slots_of, "_host string, shape long, slots array<int>"), "aligned")
    texts = (seen.select("_host", "shape", "print", F.explode(F.arrays_zip("nodes", "hashes", "sizes", "links")).alias("text"))
             .join(aligned, ["_host", "shape"])
             .select("_host", "print", F.element_at("slots", F.col("text.nodes") + 1).alias("slot"), "text.hashes", "text.sizes", "text.links")
             .filter("slot >= 0"))
    texts = stored(texts, "slots")
    shown = texts.select("_host", "slot", "hashes", "print").distinct().groupBy("_host", "slot", "hashes").agg(F.count(F.lit(1)).alias("n"))
    present = texts.select("_host", "slot", "print").distinct().groupBy("_host", "slot").agg(F.count(F.lit(1)).alias("pages"))
    often = shown.filter(F.col("n") >= least).join(present, ["_host", "slot"]).filter(F.col("n") >= most * F.col("pages"))
    fixed = often.groupBy("_host").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("hashes").alias("hash")))).alias("fixed"))
    linked = (texts.groupBy("_host", "slot").agg(F.sum("sizes").alias("size"), F.sum("links").alias("links"))
              .filter(F.col("links") >= links * F.col("size")))
    menus = linked.groupBy("_host").agg(F.array_sort(F.collect_list("slot")).alias("menus"))
    return wrappers.join(fixed, "_host", "left").join(menus, "_host", "left")


def _texts(keys: list[str]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        hosts: dict[str, tuple[set, set]] = {}
        for batch in rows:
            for part in batches([batch]):
                texts, fixed, menus = [], part.column("fixed"), part.column("menus")
                for at, (host, source, wrapper) in enumerate(zip(_sources(part, "_host"), _sources(part, "html"), _sources(part, "tree"))):
                    if host not in hosts:
                        if len(hosts) >= 512:
                            hosts.clear()
                        hosts[host] = ({(x["slot"], x["hash"]) for x in fixed[at].as_py() or ()}, set(menus[at].as_py() or ()))
                    page = Page(source)
                    texts.append(extracted(page, *_numbers(page, wrapper, cache), *hosts[host]))
                yield pa.record_batch([*[part.column(k) for k in keys], pa.array(texts, pa.string())], names=[*keys, "text"])
    return run


def main_text(pages: DataFrame, **how) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    NULL or empty html, and pages without an article, have the empty text. Pages without a readable address are one host.
    Repeated rows and ids are rows of their own; rows with equal text count once where templates are looked for. Text is
    never shortened; elements more than ``DEEPEST`` deep count as children of that depth. An empty table gives no rows.
    Other columns are not looked at.
    """
    hosts = _hosts(pages.select("page_id", "url", "html"))
    seen = seen_pages(hosts)
    known = stored(templates(seen, induced(seen), **how), "templates")
    shape_of = pages.select("page_id", "url").schema.add("text", "string")
    out = hosts.join(known, "_host").select("page_id", "url", "_host", "html", "tree", "fixed", "menus").mapInArrow(_texts(["page_id", "url"]), shape_of)
    return out.withColumn("n_chars", F.length("text").cast("long"))
