"""Main text of web pages by wrapper induction: pages of a host are aligned into one template, which tells furniture from content."""

from __future__ import annotations

import html
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.llm.held import held
from borelight.llm.urls import host_and_path
from borelight.operators.materialise import materialised

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article main section div table td th body html aside nav footer header form blockquote".split())
NEVER = frozenset("head script style noscript template textarea title iframe object svg math canvas audio video button select option input".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar aside widget widgets related recommended share sharing social menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer copyright comment comments commentlist respond disqus "
    "login search toolbar skip".split()
)
TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z))",
    re.DOTALL,
)
ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
CONSTANT_PAGES = 4
HOSTS_HELD = 2000
DEEPEST = 200  # levels of the tree; what is nested deeper keeps its place and its text on the last one


class Node:
    """An element: tag, label (tag and class, digits as 0) and children, which are nodes or decoded text."""

    __slots__ = ("tag", "label", "words", "role", "children", "deep")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.children, self.words, self.role, self.deep = tag, [], frozenset(), "", False
        cls = ""
        if attrs and "=" in attrs:
            names: set[str] = set()
            for m in ATTR.finditer(attrs):
                value = (m[2] or m[3] or m[4] or "").lower()
                key = m[1].lower()
                if key == "role":
                    self.role = value
                elif key == "itemprop":
                    cls += "@" + value if value == "articlebody" else ""
                else:
                    names.update(x for x in re.split(r"[\W_]+", value) if x)
                    cls += value if key == "class" else ""
            self.words = frozenset(names)
        self.label = tag + "." + re.sub(r"\d+", "0", cls) if cls else tag


def parse(text: str) -> Node:
    """The element tree, with the end tags that HTML implies; what a cut page leaves open is closed at its end."""
    root = Node("html", "")
    stack = [root]
    pos = 0

    def close(upto: int) -> None:
        for node in stack[upto:]:
            if node.deep:
                node.children.append(Node(node.tag, ""))
        del stack[upto:]

    def say(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    find = TAG.search
    while m := find(text, pos):
        say(text[pos : m.start()])
        pos = m.end()
        if m[1]:
            name = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    close(k)
                    break
                if stack[k].tag in SCOPE and name not in SCOPE:
                    break
        elif m[2]:
            name = m[2].lower()
            if name == "html":
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
            if name in SIBLINGS:
                ends, stops = SIBLINGS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ends:
                        close(k)
                        if name != "tr":
                            break
            node = Node(name, m[3] or "")
            if len(stack) < DEEPEST:
                stack[-1].children.append(node)
            elif name in RAW or name in VOID:
                stack[-1].children.append(Node(name, ""))
            else:  # nested deeper: opened and closed like any other, but its content goes to the last level, between empty elements; menus and the like go nowhere
                node.deep = True
                stack[-1].children.append(Node(name, ""))
                node.children = [] if furniture(node, True) else stack[-1].children
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(text, pos)
                pos = end.end() if end else len(text)
            elif name not in VOID:
                stack.append(node)
    say(text[pos:])
    return root


def has_core(node: Node) -> bool:
    return any(not isinstance(c, str) and (is_core(c) or has_core(c)) for c in node.children)


def is_core(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("article", "main") or "@articlebody" in node.label


def has_title(node: Node) -> bool:
    return any(not isinstance(c, str) and (c.tag in ("h1", "h2") or has_title(c)) for c in node.children)


def furniture(node: Node, inside: bool) -> bool:
    """What a page's own markup says is not the article."""
    if node.tag in NEVER:
        return True
    if node.tag in ("html", "body") or is_core(node) and not node.words & {"comment", "comments", "related", "recommended"}:
        return False
    if node.tag in FURNITURE or node.role in ROLES or node.words & WORDS:
        return not has_core(node) or inside
    if node.tag == "header" or "header" in node.words:
        return not (inside and has_title(node)) and not has_core(node)
    return False


# A template is [label, pages, text length, link text length, constant text, its count, children, core].

def skeleton(node: Node, link: bool = False) -> list:
    """A page's template: own text as a checksum, and runs of equal siblings folded into one."""
    own = " ".join(x for c in node.children if isinstance(c, str) for x in c.split())
    link = link or node.tag == "a"
    out = [node.label, 1, len(own), len(own) if link else 0, zlib.crc32(own.encode("utf-8", "replace")) if own else 0, 1, [], is_core(node)]
    for c in node.children:
        if not isinstance(c, str) and c.tag not in NEVER:
            child = skeleton(c, link)
            if out[6] and out[6][-1][0] == child[0]:
                out[6][-1] = merged(out[6][-1], child, same_page=True)
            else:
                out[6].append(child)
    return out


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with equal labels: matched nodes below, and the pairs of children that match."""
    x, y = a[6], b[6]
    if [c[0] for c in x] == [c[0] for c in y] and len({c[0] for c in x}) == len(x):
        return 1 + len(x), [(i, i) for i in range(len(x))]
    w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            here = w[i - 1][j - 1] + matching(x[i - 1], y[j - 1])[0] if x[i - 1][0] == y[j - 1][0] else 0
            w[i][j] = max(w[i - 1][j], w[i][j - 1], here)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + w[-1][-1], pairs[::-1]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """Both templates in one: matched nodes add up, others are put in between. The constant text is a running majority."""
    if a[4] == b[4]:
        text, count = a[4], a[5] if same_page else a[5] + b[5]
    elif same_page:
        text, count = 0, 0
    else:
        (text, count), less = ((a[4], a[5]), b[5]) if (a[5], a[4]) >= (b[5], b[4]) else ((b[4], b[5]), a[5])
        count -= less
    pages = max(a[1], b[1]) if same_page else a[1] + b[1]
    children, i, j = [], 0, 0
    for x, y in [*matching(a, b)[1], (len(a[6]), len(b[6]))]:
        children += a[6][i:x] + b[6][j:y]
        if x < len(a[6]):
            children.append(merged(a[6][x], b[6][y], same_page))
        i, j = x + 1, y + 1
    return [a[0], pages, a[2] + b[2], a[3] + b[3], text, count, children, a[7] or b[7]]


def weight(t: list) -> tuple[int, int]:
    sums = [weight(c) for c in t[6]]
    return t[2] + sum(x for x, _ in sums), t[3] + sum(x for _, x in sums)


def varies(t: list) -> bool:
    return t[5] < 0.8 * t[1] or any(varies(c) for c in t[6])


def constant(t: list) -> bool:
    """A slot with the same text on nine of ten pages or more, all the way down."""
    return t[1] >= CONSTANT_PAGES and t[5] >= 0.8 * t[1] and all(constant(c) for c in t[6]) and weight(t)[0] > 0


def content_path(t: list) -> list[int]:
    """Child numbers from the root to the slot that holds the article: the core element with most text, else down to where the
    text that is no link and no constant parts."""

    def cores(node: list, path: list[int]):
        if node[7]:
            yield weight(node)[0], path
        for k, c in enumerate(node[6]):
            yield from cores(c, [*path, k])

    best = max(cores(t, []), key=lambda x: (x[0], -len(x[1])), default=None)
    if best:
        return best[1]
    worth = lambda n: 0 if constant(n) else weight(n)[0] - 2 * weight(n)[1]
    path, node = [], t
    while node[6]:
        k = max(range(len(node[6])), key=lambda i: worth(node[6][i]))
        if worth(node[6][k]) < 0.75 * sum(max(0, worth(c)) for c in node[6]) + node[2] or node[6][k][0].split(".")[0] in ("p", "li", "h1", "h2", "h3", "span", "a", "b"):
            break
        path, node = [*path, k], node[6][k]
    return path


def folded(node: Node) -> list[tuple[list, list[Node]]]:
    """Children of a page node as template children: (template, the nodes folded into it)."""
    out: list[tuple[list, list[Node]]] = []
    for c in node.children:
        if not isinstance(c, str) and c.tag not in NEVER:
            s = skeleton(c)
            if out and out[-1][0][0] == s[0]:
                out[-1] = (merged(out[-1][0], s, True), [*out[-1][1], c])
            else:
                out.append((s, [c]))
    return out


def align(node: Node, t: list, found: dict[int, list]) -> None:
    """Which template node each page node falls on."""
    found[id(node)] = t
    parts = folded(node)
    for i, j in matching([node.label, 1, 0, 0, 0, 0, [p for p, _ in parts], False], t)[1]:
        for c in parts[i][1]:
            align(c, t[6][j], found)


def blocks_of(node: Node, drop) -> list[str]:
    """Texts of the blocks below a node, in page order, without what `drop` names."""
    out, now = [], []

    def flush() -> None:
        s = " ".join("".join(now).split())
        if s:
            out.append(s)
        now.clear()

    def walk(n: Node) -> None:
        run: list[str] = []
        for c in n.children:
            if isinstance(c, str):
                run.append(c)
                continue
            if run:
                glue(run)
            if c.tag == "br":
                glue([" "])
            elif not drop(c):
                if c.tag in BLOCK:
                    flush()
                    walk(c)
                    flush()
                else:
                    walk(c)
        if run:
            glue(run)

    def glue(run: list[str]) -> None:
        s = "".join(run)
        run.clear()
        now.append(s)

    walk(node)
    flush()
    return out


def main_text(page: str, template: list) -> str:
    """The article of a page of the host whose template is given."""
    root = parse(page)
    found: dict[int, list] = {}
    align(root, template, found)
    path = content_path(template)
    target = template
    for k in path:
        target = target[6][k]
    home = place(root, found, target)
    if home is None or not path:
        own = skeleton(root)
        target = own
        for k in content_path(own):
            target = target[6][k]
        mine: dict[int, list] = {}
        align(root, own, mine)
        home = place(root, mine, target) or [root]
    # a host of copies has no varying slot: then nothing tells its article from its furniture but the markup
    judged = template[1] >= CONSTANT_PAGES and varies(target)
    inside = any(is_core(n) for n in home)

    def drop(n: Node) -> bool:
        return furniture(n, inside) or judged and n.tag in BLOCK and id(n) in found and constant(found[id(n)])

    return "\n".join(b for n in home for b in blocks_of(n, drop))


def place(root: Node, found: dict[int, list], target: list) -> list[Node] | None:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if found.get(id(n)) is target and not furniture(n, False):
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out or None


def templates(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(host, template) of all hosts. Every task merges the pages it reads into one template per host; these are merged over salted
    shares of the host, then per host. A template grows with the different structures of a host, not with its pages."""

    def induce(batches):
        now: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                t = skeleton(parse(page or ""))
                now[host] = merged(now[host], t) if host in now else t
                if len(now) >= HOSTS_HELD:
                    yield out(now)
                    now = {}
        yield out(now)

    def out(now: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(now), pa.string()), pa.array([json.dumps(t) for t in now.values()], pa.string())], names=["host", "template"])

    def join(batches):
        host, t = None, None
        for batch in batches:
            done: dict[str, list] = {}
            for h, s in zip(batch.column("host").to_pylist(), batch.column("template").to_pylist(), strict=True):
                if t is not None and h != host:
                    done[host] = t
                    t = None
                host, t = h, merged(t, json.loads(s)) if t is not None else json.loads(s)
            yield out(done)
        yield out({host: t} if t is not None else {})

    schema = "host string, template string"
    parts = pages.select("host", "html").mapInArrow(induce, schema)
    for salt in (F.pmod(F.xxhash64("template"), F.lit(salts)), F.lit(0).cast("long")):
        parts = parts.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "template")
        parts = parts.select("host", "template").mapInArrow(join, schema)
    return parts.groupBy("host").agg(F.max("template").alias("template"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", key: str = "page_id", broadcast_mb: int = 64) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (code points) of every row of `pages`.

    The text is what the host's template calls content, without elements that their markup names as furniture (menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) and without blocks that hold the same text on
    nine of ten pages (from four pages on). Blocks stand in page order, one line each; white space inside is one blank.

    Null html: empty text. A null url, or one without a host, belongs to the host ''. Cut pages are closed at their end. Rows repeat
    and null ids pass on. No rows: no rows. Other columns are ignored. Templates are broadcast if all together take at most
    `broadcast_mb`; beyond that pages and templates are joined by host and a salt, which spreads a host with a third of all pages.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_and_path(url)[0].alias("host"), F.col(page).alias("html"))
    known = materialised(templates(rows))
    size = known.agg(F.sum(F.length("template"))).first()[0] or 0
    if size <= broadcast_mb << 20:
        both = rows.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(32))).join(salted, ["host", "salt"], "left")
    kind = pages.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            texts = []
            for page, t in zip(*(batch.column(c).to_pylist() for c in ("html", "template")), strict=True):
                ready = held(("templates",), dict)
                if t not in ready:
                    if len(ready) >= HOSTS_HELD:
                        ready.clear()
                    ready[t] = json.loads(t) if t else skeleton(parse(""))
                texts.append(main_text(page or "", ready[t]))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "template").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
