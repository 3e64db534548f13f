"""Main text of web pages by wrapper induction.

Pages of one host share a few layouts. One page of the host is the pivot; simple tree
matching aligns the other pages with it. Pages that do not align with it have another
layout: one of them is the next pivot, and so on. Aligned nodes whose text is the same on
nearly all different pages of a layout are template, the others are slots that vary. A
page's main text is what stands in its varying slots, less the elements
that by tag, role or class are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments.

Rules for odd input: a NULL html is empty and gives an empty text; a NULL or odd
url belongs to the host ``""``. Every row gives one row, repeated identifiers
included; ties for the pivot go to the least hash, then html. Pages without text in any
block are of no layout. Nesting of any depth is aligned. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperic.llm.common import map_batches, staged

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
# An element of the second kind cannot be open inside one of the first when that one starts.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table menu".split())

# Elements that hold no main text, by tag, role, and words of class or id.
ASIDE_TAGS = frozenset(
    "head script style noscript template iframe svg nav footer aside form button select input textarea dialog menu object canvas title".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"menu|nav|navbar|navigation|breadcrumbs?|toolbar|pagination|pager|sidebar|side|widget|footer|header|masthead|topbar|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|newsletter|subscribe|"
    r"subscription|signup|login|search|copyright|hidden)(?:$|[\s_-])",
    re.I,
)
MAIN_TAGS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
BLANK = re.compile(r"\s+")


class Node:
    """An element: tag, whether it is aside from the text, children (nodes and strings)."""

    __slots__ = ("tag", "aside", "main", "kids", "shape", "size")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.shape, self.size = tag, [], 0, 1
        self.aside = tag in ASIDE_TAGS
        self.main = tag in MAIN_TAGS
        if attributes and not self.aside:
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                self.aside |= value in ASIDE_ROLES
                self.main |= value in ("main", "article")
            elif name == "style":
                self.aside |= "display:none" in value.replace(" ", "")
            elif name == "hidden":
                self.aside = True
            elif name == "aria-hidden":
                self.aside |= value == "true"
            elif self.tag not in ("html", "body"):
                self.aside |= bool(ASIDE_WORDS.search(value))

    def elements(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]


def parse(text: str) -> Node:
    """The element tree, with the end tags that authors leave out."""
    root = Node("#root")
    path = [root]
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                path[-1].kids.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag == tag:
                    del path[k:]
                    break
            continue
        _open(path, tag)
        node = Node(tag, m[3])
        path[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            node.kids.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            path.append(node)
    return root


def _open(path: list[Node], tag: str) -> None:
    """Closes what cannot stay open when ``tag`` starts."""
    shut = CLOSES.get(tag)
    if shut:
        for k in range(len(path) - 1, 0, -1):
            if path[k].tag in shut:
                del path[k:]
                return
            if path[k].tag in CONTAINERS:
                return
    elif tag in BLOCK:
        for k in range(len(path) - 1, 0, -1):
            if path[k].tag == "p":
                del path[k:]
                return
            if path[k].tag in BLOCK:
                return


def shape(node: Node) -> int:
    """A fingerprint of the element structure and the number of elements, kept at each node."""
    todo = [(node, False)]
    while todo:
        x, done = todo.pop()
        if done:
            inside = x.elements()
            x.shape = hash((x.tag, *[k.shape for k in inside]))
            x.size = 1 + sum(k.size for k in inside)
        else:
            todo.append((x, True))
            todo += [(k, False) for k in x.elements()]
    return node.shape


def align(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """Matched nodes of two trees by simple tree matching.

    Roots match by tag; children are matched in order so that the number of
    matched nodes is greatest. Equal structures match as they are, and at both
    ends of two child lists equal children match each other, so the table over
    child pairs is only filled in between.
    """
    memo: dict[tuple[int, int], int] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.tag != y.tag:
            continue
        yield x, y
        todo += _child_pairs(x, y, memo)


def _middle(x: Node, y: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Pairs of equal children at both ends, and the children in between."""
    p, q = x.elements(), y.elements()
    if x.shape == y.shape:
        return list(zip(p, q)), [], []
    pairs = []
    i = 0
    while i < min(len(p), len(q)) and p[i].shape == q[i].shape:
        pairs.append((p[i], q[i]))
        i += 1
    j = 0
    while j < min(len(p), len(q)) - i and p[-1 - j].shape == q[-1 - j].shape:
        pairs.append((p[-1 - j], q[-1 - j]))
        j += 1
    return pairs, p[i : len(p) - j], q[i : len(q) - j]


def _child_pairs(x: Node, y: Node, memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    pairs, p, q = _middle(x, y)
    if not p or not q:
        return pairs
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for r in range(1, len(p) + 1):
        for c in range(1, len(q) + 1):
            best[r][c] = max(best[r - 1][c], best[r][c - 1], best[r - 1][c - 1] + _matches(p[r - 1], q[c - 1], memo))
    r, c = len(p), len(q)
    while r and c:
        if best[r][c] == best[r - 1][c]:
            r -= 1
        elif best[r][c] == best[r][c - 1]:
            c -= 1
        else:
            r, c = r - 1, c - 1
            pairs.append((p[r], q[c]))
    return pairs


def _matches(x: Node, y: Node, memo: dict[tuple[int, int], int]) -> int:
    """Nodes matched by two trees. What it needs of their children is worked out first,
    from the leaves up, so depth is no matter."""
    if x.tag != y.tag:
        return 0
    if x.shape == y.shape:
        return x.size
    if (x.shape, y.shape) in memo:
        return memo[x.shape, y.shape]
    todo = [(x, y)]
    while todo:
        a, b = todo[-1]
        if (a.shape, b.shape) not in memo:
            _, p, q = _middle(a, b)
            open_ = [
                (c, d) for c in p for d in q if c.tag == d.tag and c.shape != d.shape and (c.shape, d.shape) not in memo
            ]
            if open_:
                todo += open_
                continue
            memo[a.shape, b.shape] = 1 + sum(_matches(c, d, memo) for c, d in _child_pairs(a, b, memo))
        todo.pop()
    return memo[x.shape, y.shape]


def plain(parts: list[str]) -> str:
    return BLANK.sub(" ", markup.unescape("".join(parts))).strip()


def own_text(x: Node) -> str:
    """The text of a block, without that of blocks inside it; empty for other elements."""
    if x.tag not in BLOCK:
        return ""
    parts: list[str] = []
    todo = list(reversed(x.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            parts.append(k)
        elif k.tag == "br":
            parts.append(" ")
        elif k.tag not in BLOCK and not k.aside:
            todo += reversed(k.kids)
    return plain(parts)


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.elements())
    return out


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the page less aside elements and ``template`` (ids of nodes).

    Inside ``article`` or ``main`` elements if there are any with text, else in
    the whole page, where blocks that are mostly links are menus too.
    """
    kept = _blocks(root, template, True)
    return "\n".join(kept or _blocks(root, template, False))


def _blocks(root: Node, template: frozenset[int], inside_only: bool) -> list[str]:
    out: list[str] = []
    parts: list[str] = []
    linked: list[int] = [0]

    def flush() -> None:
        block = plain(parts)
        if block and (inside_only or linked[0] <= len(block) // 2):
            out.append(block)
        parts.clear()
        linked[0] = 0

    # entries: node or text, whether inside main, whether inside a link; None ends a block
    todo: list[tuple] = [(root, False, False)]
    while todo:
        x, inside, link = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if inside or not inside_only:
                parts.append(x)
                linked[0] += len(x.strip()) if link else 0
        elif x.tag == "br" or x.tag in ("td", "th"):
            parts.append(" ")
            todo += [(k, inside, link) for k in reversed(x.kids)]
        elif not x.aside and id(x) not in template and not (x.tag == "header" and not inside):
            inside = inside or x.main
            if x.tag in BLOCK:
                flush()
                todo.append((None, inside, link))
            todo += [(k, inside, link or x.tag == "a") for k in reversed(x.kids)]
    flush()
    return out


def tree(text: str) -> Node:
    """The shaped tree."""
    root = parse(text)
    shape(root)
    return root


class _Pivots:
    """Parsed pivots of the hosts met in a task, the latest few: tree, number of each
    node, and whether any block holds text."""

    def __init__(self, most: int = 500):
        self.most, self.held = most, {}

    def get(self, text: str) -> tuple[Node, dict[int, int], bool]:
        if text not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            root = tree(text)
            nodes = preorder(root)
            self.held[text] = (root, {id(x): k for k, x in enumerate(nodes)}, any(not x.aside and own_text(x) for x in nodes))
        return self.held[text]


def alike(base: Node, root: Node, matched: int, share: float) -> bool:
    """Whether two pages have one layout: most of the smaller one is matched, and the
    pivot is not half of the page or less."""
    return matched >= share * min(base.size, root.size) and 2 * base.size > root.size


def _with_pivot(pages: DataFrame, pivots: DataFrame, size: Column, small: int, how: str) -> DataFrame:
    """Pages with their host's row of ``pivots``. It is broadcast where its whole
    size is below ``small`` bytes; else the join shuffles, and a large host is
    split at run time."""
    whole = pivots.agg(F.sum(size + 100)).first()[0] or 0
    return pages.join(F.broadcast(pivots) if whole <= small else pivots, "host", how)


def extract_text(
    pages: DataFrame,
    *,
    same_share: float = 0.9,
    least_pages: int = 5,
    pivot_chars: int = 65536,
    small: int = 64 << 20,
    layout_share: float = 0.6,
    layouts: int = 8,
) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_template`` (template nodes left out).

    A node of a pivot is template if it is aligned on at least ``least_pages``
    pages of its layout with different main texts and has its text on ``same_share`` of
    them. Pages of up to ``pivot_chars`` characters are preferred as pivots. A host has
    up to ``layouts`` layouts, found as long as ``least_pages`` pages are like none yet;
    pages of any further one are left with what tags, roles and classes tell.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    order = F.struct(F.length("html") > pivot_chars, F.xxhash64("page_id"), "html")

    def compare(batch: pa.RecordBatch) -> dict:
        known = _Pivots()
        out: dict[str, list] = {"host": [], "page_id": [], "other": [], "digest": [], "seen": [], "same": []}
        for name, number, page, pivot in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "html", "pivot"))):
            base, ids, told = known.get(pivot)
            root = tree(page)
            pairs = list(align(base, root))
            # a page of another layout is handed on as it is
            seen, same, other, digest = [], [], None, 0
            if told and alike(base, root, len(pairs), layout_share):
                for x, y in pairs:
                    text = own_text(x)
                    if text and not x.aside:
                        seen.append(ids[id(x)])
                        if text == own_text(y):
                            same.append(seen[-1])
                digest = xxhash.xxh3_64(main_text(root)).intdigest() - (1 << 63)
            elif any(not x.aside and own_text(x) for x in preorder(root)):
                other = page
            for c, v in zip(out, (name, number, other, digest, seen, same)):
                out[c].append(v)
        return out

    left = rows.select("host", F.col("page_id").cast("long").alias("page_id"), "html")
    kinds = "host string, page_id long, other string, digest long, seen array<int>, same array<int>"
    wrappers = None
    for layout in range(layouts):
        pivots = left.groupBy("host").agg(F.min_by("html", order).alias("pivot"), F.count("*").alias("n"))
        pivots = staged(pivots.filter(F.col("n") >= least_pages).drop("n"))
        found = staged(map_batches(_with_pivot(left, pivots, F.length("pivot"), small, "inner"), compare, kinds))
        # copies of a page must not make its text a template
        once = found.filter(F.size("seen") > 0).groupBy("host", "digest").agg(
            F.max("seen").alias("seen"), F.max_by("same", F.struct("seen", "same")).alias("same")
        )
        votes = once.select("host", F.inline(F.transform("seen", lambda k: F.struct(k.alias("node"), F.array_contains("same", k).cast("int").alias("k")))))
        votes = votes.groupBy("host", "node").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
        constant = votes.filter((F.col("n") >= least_pages) & (F.col("k") >= same_share * F.col("n")))
        templates = constant.groupBy("host").agg(F.array_sort(F.collect_list(F.col("node").cast("int"))).alias("constant"))
        made = pivots.join(templates, "host", "left").withColumn("layout", F.lit(layout))
        wrappers = made if wrappers is None else wrappers.unionByName(made)
        left = found.filter("other is not null").select("host", "page_id", F.col("other").alias("html"))
        if left.groupBy("host").count().filter(F.col("count") >= least_pages).isEmpty():
            break

    each = F.struct("layout", "pivot", "constant")
    wrappers = staged(wrappers.groupBy("host").agg(F.array_sort(F.collect_list(each)).alias("layouts")))

    def extract(batch: pa.RecordBatch) -> dict:
        known = _Pivots()
        out: dict[str, list] = {"text": [], "n_template": []}
        for page, tried in zip(batch.column("html").to_pylist(), batch.column("layouts").to_pylist()):
            root, drop = parse(page), frozenset()
            if tried and any(x["constant"] for x in tried):
                shape(root)
                for x in tried:
                    base, ids, told = known.get(x["pivot"])
                    pairs = list(align(base, root)) if told else []
                    if told and alike(base, root, len(pairs), layout_share):
                        fixed = set(x["constant"] or ())
                        drop = frozenset(id(b) for a, b in pairs if ids[id(a)] in fixed and own_text(a) == own_text(b))
                        break
            out["text"].append(main_text(root, drop))
            out["n_template"].append(len(drop))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), **out}

    size = F.aggregate("layouts", F.lit(0), lambda n, x: n + F.length(x["pivot"]))
    done = map_batches(
        _with_pivot(rows, wrappers, size, small, "left").select(F.col("page_id").cast("long"), "url", "html", "layouts"),
        extract, "page_id long, url string, text string, n_template int",
    )
    return done.withColumn("n_chars", F.length("text").cast("long"))
