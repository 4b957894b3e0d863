"""Main text of web pages by wrapper induction.

Each page is read into a tree of its block elements, in which adjacent siblings of one tag and class are one node (an iteration). The
trees of a host are folded into its wrapper by simple tree matching: matched nodes share a slot, others are inserted. A slot that holds the same text on all
its pages, of which at least MIN_PAGES differ in their text, is template; all others vary and are content. What remains of a page, inside its
article or main element if it has one, is its text: elements that are boilerplate by name (navigation, footers, asides, forms, scripts and the
like), by role, or by a class or id that says nothing else (adverts, notices, comments, sidebars; ``comment-list``, but not ``comment-theory``)
are left out, whatever the wrapper says, as their texts may differ from page to page. First-level headings are never template.

Pages are parsed once; their blocks go to a Parquet table in the shared folder. Wrappers are folded in each task first, then over salted parts
of a host (as many as the root of the number of tasks), then per host, so that no task gathers a host's pages: what is shuffled is one tree
per task and host. Slots are then decided for each (host, tree shape), and only those with template slots are joined to the pages by a digest
of both: broadcast if they have BROADCAST_BYTES at most, else shuffled with SALTS salts, so that a hot host is spread.

Cases: a null or empty html, or one without content, gives an empty text; a null url, or one without ``://``, belongs to no host and has no wrapper;
markup that is cut off or misnested is read as far as it goes, and nested however deeply; pages of any length are read in whole; copies of a page count once for MIN_PAGES;
repeated rows give equal rows; an empty table gives an empty result; columns other than page_id, url and html are not read. A <br> is white space.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_runs, stored
from .urls import host_of

MIN_PAGES = 5
PARTS = 32  # least number of salted parts of a host's partial wrappers
BROADCAST_BYTES = 32 << 20
SALTS = 32

BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption header footer nav aside form fieldset address details summary hr center dialog hgroup search menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head title nav footer aside form button select option textarea dialog noscript template svg iframe object canvas menu search label".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored sidebar cookie cookies consent notice notices gdpr newsletter subscribe subscription comment comments disqus reply replies breadcrumb breadcrumbs menu nav navbar navigation navi footer share sharing social related recommended popup modal overlay widget pagination pager skip toolbar masthead topbar alert".split()
)
#: words that say only what sort of box a marked element is
BOXES = frozenset(
    "area bar block body box btn button buttons card container content count feed form group head header heading holder icon icons inner item items left link links list message msg new outer panel post posts right row section side signup slot small space text thread title top unit wrap wrapper left bottom large main sticky".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
KEEPS = frozenset("html body main article".split())
ENDS_P = BLOCK - {"html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>?)|<[!?/][^>]*>?", re.S)
BESIDE = frozenset("no not non has have with without".split())  # a class that says what is beside the element, or is not
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("key", "kids", "place")

    def __init__(self, key: str):
        self.key, self.kids, self.place = key, [], -1


def _marked(words: list[str]) -> bool:
    """Does a class say that its element is boilerplate, and nothing else?"""
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in BOXES for w in words) and BESIDE.isdisjoint(words)


def _left_out(tag: str, attributes: str) -> tuple[bool, str]:
    """(is the element boilerplate by its name or attributes, its first class)."""
    out, first = tag in LEFT_OUT, ""
    if attributes and tag not in KEEPS:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                out |= value in ROLES
            elif name == "hidden":
                out = True
            elif name == "aria-hidden":
                out |= value == "true"
            elif name in ("class", "id"):
                out |= any(_marked(words) for words in map(_PARTS.findall, value.split()))
                if name == "class" and value:
                    first = value.split()[0] if value.split() else ""
    return out, first


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool]], bool]:
    """(tree of block elements, blocks as (node, text, inside an article), is there an article), boilerplate left out."""
    root = Node("")
    # open elements: tag, node of the block, left out, inside an article
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    blocks: list[tuple[Node, str, bool]] = []
    text: list[str] = []
    article = False
    opened: Counter[str] = Counter()

    def flush() -> None:
        if text:
            t = " ".join("".join(text).split())
            text.clear()
            if t:
                blocks.append((stack[-1][1], t, stack[-1][3]))

    def close(depth: int) -> None:
        if any(e[0] in BLOCK or e[2] != stack[depth - 1][2] for e in stack[depth:]):
            flush()
        opened.subtract(e[0] for e in stack[depth:])
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if not stack[-1][2]:
                text.append(html_lib.unescape(page[at:]))
            break
        if m.start() > at and not stack[-1][2]:
            text.append(html_lib.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # a quote that is left open, or a tag that is cut off
            at = page.find(">", at) + 1
            if not at:
                break
        tag = m[2].lower()
        if m[1]:
            block = tag in BLOCK
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if not block and stack[depth][0] in BLOCK:
                    break
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in ENDS_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in HOLDS[tag]:
                    break
                if stack[depth][0] in CLOSES[tag]:
                    close(depth)
                    break
        if tag in ("script", "style") or tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        _, node, out, inside = stack[-1]
        gone, name = _left_out(tag, m[3])
        gone |= tag == "header" and not inside
        if (gone and not out) or tag in BLOCK:
            flush()
        if not (out or gone) and tag in BLOCK:
            key = f"{tag}.{name}" if name else tag
            if not node.kids or node.kids[-1].key != key:
                node.kids.append(Node(key))
            node = node.kids[-1]
            if tag in ("article", "main"):
                article = inside = True
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append((tag, node, out or gone, inside))
            opened[tag] += 1
    flush()
    return root, blocks, article


def shape_of(root: Node) -> str:
    """The tree as nested brackets; numbers the nodes in that order."""
    out, n, todo = [], 0, [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        x.place = n
        n += 1
        out.append(x.key)
        if x.kids:
            out.append("(")
            todo.append(")")
            for i, k in enumerate(reversed(x.kids)):
                todo += [" ", k] if i else [k]
    return "".join(out)


_SIGN = re.compile(r"[() ]|[^() ]+")


def tree_of(shape: str) -> list:
    """[key, children, place] of a shape."""
    root: list = ["", [], 0]
    path, last, n = [], root, 1
    for s in _SIGN.findall(shape):
        if s == "(":
            path.append(last)
        elif s == ")":
            last = path.pop()
        elif s != " ":
            last = [s, [], n]
            n += 1
            path[-1][1].append(last)
    return root


def matching(a: list, b: list) -> list[tuple[list, list]]:
    """Simple tree matching: the largest order-keeping match of equal keys, as pairs of nodes; the roots match."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    todo: list[tuple[list, list, bool]] = [(a, b, False)]
    while todo:
        x, y, kids_done = todo.pop()
        if (id(x), id(y)) in memo:
            continue
        p, q = x[1], y[1]
        if not kids_done:
            todo.append((x, y, True))
            todo += [(i, j, False) for i in p for j in q if i[0] == j[0]]
            continue
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        w = [[memo[id(i), id(j)][0] if i[0] == j[0] else 0 for j in q] for i in p]
        for i in range(len(p)):
            for j in range(len(q)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
        pairs, i, j = [], len(p), len(q)
        while i and j:
            if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        memo[id(x), id(y)] = 1 + best[-1][-1], pairs[::-1]
    out, both = [], [(a, b)]
    while both:
        x, y = both.pop()
        out.append((x, y))
        both += [(x[1][i], y[1][j]) for i, j in memo[id(x), id(y)][1]]
    return out


# ---------------------------------------------------------------- wrappers
#
# A wrapper is a tree of [key, children, hash, pages], where hash is None before any text was seen, a text's hash while
# that is the only one, and VARIES after; pages are up to MIN_PAGES different hashes of pages that have the only text.
# With the tree goes a sorted list of up to MIN_PAGES different page hashes.

VARIES = "*"


def _join(a: str | None, b: str | None) -> str | None:
    return b if a is None else a if b is None or a == b else VARIES


def _see(slot: list, hash_: str | None, pages: list[str]) -> None:
    """Adds to a slot a text and pages that have it."""
    slot[2] = _join(slot[2], hash_)
    if slot[2] == VARIES:
        slot[3] = []
    elif hash_ is not None and len(slot[3]) < MIN_PAGES:
        slot[3] = sorted({*slot[3], *pages})[:MIN_PAGES]


def fold(wrapper: list, tree: list) -> dict[int, list]:
    """Folds a tree into a wrapper, both of [key, children, hash, pages]; gives the slot of each node of the tree by id."""
    slots = {id(y): x for x, y in matching(wrapper, tree)}

    todo = [(wrapper, tree)]
    while todo:
        x, y = todo.pop()
        _see(x, y[2], y[3])
        at = 0
        for k in y[1]:
            if id(k) in slots:
                at = next(i for i, c in enumerate(x[1]) if c is slots[id(k)]) + 1
            else:
                slots[id(k)] = fresh = [k[0], [], None, []]
                x[1].insert(at, fresh)
                at += 1
            todo.append((slots[id(k)], k))
    return slots


def packed(wrapper: list) -> str:
    """A wrapper as JSON: (key, depth, hash, pages) of its nodes, parents before their children."""
    out, todo = [], [(wrapper, 0)]
    while todo:
        x, depth = todo.pop()
        out.append([x[0], depth, x[2], x[3]])
        todo += [(k, depth + 1) for k in reversed(x[1])]
    return json.dumps(out)


def unpacked(text: str) -> list:
    path: list[list] = []
    for key, depth, hash_, pages in json.loads(text):
        x = [key, [], hash_, pages]
        del path[depth:]
        if path:
            path[-1][1].append(x)
        path.append(x)
    return path[0]


def merged(parts: list[tuple[str, list[str]]]) -> tuple[list, list[str]]:
    """One wrapper of packed ones and of their pages."""
    wrapper, pages = ["", [], None, []], set()
    for tree, some in sorted(parts):
        fold(wrapper, unpacked(tree))
        pages |= set(some)
    return wrapper, sorted(pages)[:MIN_PAGES]


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _nodes(tree: list):
    todo = [tree]
    while todo:
        x = todo.pop()
        yield x
        todo += x[1][::-1]


SCHEMA_BLOCKS = "page_id long, url string, host string, shape string, blocks array<struct<node:int,text:string>>"


def _read(batches):
    """(page_id, url, host, html) -> SCHEMA_BLOCKS."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            shapes, found = [], []
            for page in part.column("html").to_pylist():
                root, blocks, article = parse(page or "")
                shapes.append(shape_of(root))
                found.append([{"node": x.place, "text": t} for x, t, inside in blocks if inside or not article])
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(shapes, pa.string()), pa.array(found, kind)], names=["page_id", "url", "host", "shape", "blocks"])


def _partial(batches, parts: int):
    """(host, shape, hashes of texts by node, hash of all) -> (host, part, tree, pages): a wrapper per host of what the task saw."""
    hosts: dict[str, tuple[list, set, dict]] = {}
    for b in batches:
        for host, shape, nodes, page in zip(*(b.column(c).to_pylist() for c in ("host", "shape", "nodes", "page"))):
            wrapper, pages, known = hosts.setdefault(host, (["", [], None, []], set(), {}))
            if shape not in known:
                tree = tree_of(shape)
                flat = list(_nodes(tree))
                for x in flat:
                    x[2:] = None, []
                slots = fold(wrapper, tree)
                known[shape] = [slots[id(x)] for x in flat]
            slots = known[shape]
            for r in nodes:
                _see(slots[r["node"]], r["hash"], [page])
            pages.add(page)
            if len(pages) > 4 * MIN_PAGES:
                hosts[host] = (wrapper, set(sorted(pages)[:MIN_PAGES]), known)
    rows = [(h, int(_digest(packed(w)), 16) % parts, packed(w), sorted(p)[:MIN_PAGES]) for h, (w, p, _) in hosts.items()]
    for i in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())))], names=["host", "part", "tree", "pages"])


def _merge(t: pa.Table) -> pa.RecordBatch:
    tree, pages = merged(list(zip(t.column("tree").to_pylist(), t.column("pages").to_pylist())))
    return pa.RecordBatch.from_arrays([pa.array([t.column("host")[0].as_py()]), pa.array([packed(tree)]), pa.array([pages], pa.list_(pa.string()))], names=["host", "tree", "pages"])


def template_nodes(wrapper: list, shape: str) -> list[int]:
    """Nodes of the shape whose slot holds one text only, on MIN_PAGES differing pages."""
    return sorted(y[2] for x, y in matching(wrapper, tree_of(shape)) if x[2] not in (None, VARIES) and len(x[3]) >= MIN_PAGES and x[0].partition(".")[0] != "h1")


def _decide(batches):
    """(layout, shape, tree) -> (layout, template): only layouts with template nodes."""
    last, wrapper = None, None
    for b in batches:
        rows = []
        for layout, shape, tree in zip(*(b.column(c).to_pylist() for c in ("layout", "shape", "tree"))):
            if tree != last:
                last, wrapper = tree, unpacked(tree)
            if found := template_nodes(wrapper, shape):
                rows.append((layout, found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.list_(pa.int32())))], names=["layout", "template"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    read = stored(p.mapInArrow(_read, SCHEMA_BLOCKS).withColumn("layout", F.when(F.col("host") != "", F.md5(F.encode(F.concat("host", F.lit(" "), "shape"), "utf-8")))))
    seen = read.where("host <> '' AND size(blocks) > 0")
    # a node's texts on a page are one: hashes of them, and of the whole page
    hashes = F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.hex(F.xxhash64(b["text"])).alias("hash")))
    nodes = F.transform(F.array_distinct(F.transform("h", lambda x: x["node"])), lambda n: F.struct(n.alias("node"), F.array_join(F.transform(F.filter("h", lambda x: x["node"] == n), lambda x: x["hash"]), "").alias("all")))
    joined = seen.select("host", "shape", hashes.alias("h")).select("host", "shape", nodes.alias("n"), F.hex(F.xxhash64(F.array_join(F.transform("h", lambda x: x["hash"]), ""))).alias("page"))
    slim = joined.select("host", "shape", F.transform("n", lambda x: F.struct(x["node"].alias("node"), F.hex(F.xxhash64(x["all"])).alias("hash"))).alias("nodes"), "page")
    split = max(PARTS, math.isqrt(read.rdd.getNumPartitions()))
    partial = slim.mapInArrow(lambda batches: _partial(batches, split), "host string, part int, tree string, pages array<string>")
    parts = in_runs(partial, ["host", "part"], _merge, "host string, tree string, pages array<string>")
    wrappers = in_runs(parts, ["host"], _merge, "host string, tree string, pages array<string>").where(F.size("pages") >= MIN_PAGES)
    shapes = seen.select("host", "shape", "layout").distinct()
    decided = stored(shapes.join(wrappers.select("host", "tree"), "host").mapInArrow(_decide, "layout string, template array<int>"))
    n_bytes = decided.agg(F.sum(64 + 4 * F.size("template"))).first()[0] or 0
    pages_ = read.select("page_id", "url", "layout", "blocks")
    if n_bytes <= BROADCAST_BYTES:
        out = pages_.join(F.broadcast(decided), "layout", "left")
    else:
        salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = pages_.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["layout", "salt"], "left")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", b["node"]), F.lit(False)))
    out = out.withColumn("text", F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"), F.lit("")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
