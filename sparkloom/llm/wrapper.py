"""Main text of web pages by wrapper induction.

Pages of one host are parsed to DOM trees and aligned by simple tree matching (Yang 1991). Runs of like siblings collapse to
one repeated node first, so trees stay small. The wrapper is the merged tree: a node whose text varies over the aligned pages is
a slot; a node, or one of a run, whose text stands on every aligned page is template. Wrappers are folded inside each input partition, merged over (host, salt)
and then over hosts, so every page counts and a host with a third of all pages is never gathered in one task.

Extraction aligns every page with its host's wrapper (alignments are memoised by page skeleton). Blocks are kept in page order
when they stand in the content region, are not template and are not in a part that its tag or its class marks as a menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment. The region is the container in which the wrapper's slots
hold most text, or the article and main elements inside it; an article that is the region is kept whole, so with its heading.
A host needs `ENOUGH` pages of different text, for its wrapper and for each template node; pages of other hosts, and pages
on which nothing stands where the region does, are extracted from their article or main elements by tags and class words alone.
Where all pages of a host share a paragraph of the article, it counts as template.

Wrappers are broadcast only when their measured total is below `broadcast_bytes`; beyond it they are joined by host.

Defined results: null or text-less html gives the empty string; a null or odd url is a host of its own (""); repeated pages
are each reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns, materialise

#: Pages of different text that a host's wrapper and a template node need.
ENOUGH = 3

# HTML's elements by kind, and the words that mark parts which are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt option optgroup summary legend".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
DROP_TAGS = frozenset("head script style noscript template iframe svg nav header footer aside form button select textarea input dialog menu object embed canvas audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus discussion reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search form pagination pager widget skip toolbar tags copyright".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Node:
    __slots__ = ("tag", "marks", "kids", "drop")

    def __init__(self, tag: str, marks: str = "", drop: bool = False):
        self.tag, self.marks, self.kids, self.drop = tag, marks, [], drop


def _marked(tag: str, attrs: str) -> tuple[str, bool]:
    """Class and id words of a tag, and whether they mark a part that is no article text."""
    drop = tag in DROP_TAGS
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return "", drop
    if tag in ("html", "body", "article", "main"):
        return "", drop
    kept = []
    for name, value in _MARKS.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names = value.split()
            kept += names
            drop = drop or any(set(re.split(r"[-_]|\d+", x)) & DROP_WORDS for x in names)
        elif name == "role":
            drop = drop or value in DROP_ROLES
        elif name == "aria-hidden":
            drop = drop or value == "true"
        elif name == "style":
            drop = drop or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
    return " ".join(kept), drop or re.search(r"(?:^|\s)hidden(?:\s|$)", attrs, re.I) is not None


#: Levels of the tree; what stands deeper is flattened into siblings on the last level, in order.
DEPTH = 200


def parse(text: str) -> Node:
    """A DOM tree: Nodes with Nodes and strings (decoded) as kids, of at most DEPTH levels.

    A deeper block becomes a sibling on the last level, and what follows it in its parent goes on in a sibling like the
    parent; inline elements there are part of what they stand in; parts of a dropped element stay dropped.
    """
    root = Node("#root")
    stack = [root]
    at, end = 0, len(text)

    def inner() -> Node:
        """Where text and elements go now."""
        if len(stack) <= DEPTH:
            return stack[-1]
        last, node = stack[DEPTH - 1], stack[-1]
        if not last.kids or isinstance(last.kids[-1], str) or last.kids[-1].kids is not node.kids:
            more = Node(next(x.tag for x in reversed(stack[DEPTH:]) if x.tag in BLOCK or x is stack[DEPTH]), node.marks, node.drop)
            last.kids.append(more)  # a sibling goes on
            stack[-1] = node = Node(node.tag, node.marks, node.drop)
            node.kids = more.kids
        return node

    while at < end:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                inner().kids.append(entities.unescape(piece))
            elif piece.startswith("<![CDATA["):
                inner().kids.append(piece[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        elif tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        marks, drop = _marked(tag, m[3])
        node = Node(tag, marks + "!" if drop else marks, drop)
        if len(stack) < DEPTH or tag in RAW or tag in VOID:
            inner().kids.append(node)
        elif tag not in BLOCK and not drop and len(stack) > DEPTH:
            node.marks, node.kids, node.drop = stack[-1].marks, inner().kids, stack[-1].drop
        else:
            node.drop = drop or any(x.drop for x in stack[DEPTH:])
            node.marks = marks + "!" if node.drop else marks
            stack[DEPTH - 1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            if tag == "title" or tag == "textarea":
                node.kids.append(entities.unescape(text[at : close.start() if close else end]))
            at = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def words_of(node: Node) -> str:
    out: list[str] = []

    def walk(n):
        for k in n.kids:
            if isinstance(k, str):
                out.append(k)
            else:
                walk(k)

    walk(node)
    return " ".join(" ".join(out).split())


# Wrapper nodes are lists: [tag, marks (ending in ! where dropped), kids, hashes of at most ENOUGH different pages, text hash or
# None where it varies, characters of varying text, hashes of the texts (of a run: of each member) that all pages have]
TAG, MARKS, KIDS, PAGES, SAME, VARIES, CONSTANT = range(7)


def text_hash(text: str) -> int:
    return zlib.crc32(text.encode())


def skeleton(node: Node, page: int | None = None, texts: bool = True) -> list:
    """The tree of block elements with runs of like siblings collapsed; SAME is a hash of the text of all of the run.

    page: hash of the page, by default of the node's text; without texts only the shape counts.
    """
    text = words_of(node) if texts else ""
    own = text_hash(text)
    page = own if page is None else page
    kids: list[list] = []
    for k in node.kids:
        if isinstance(k, str) or k.tag not in BLOCK and k.tag not in RAW:
            continue
        s = skeleton(k, page, texts)
        if kids and kids[-1][TAG] == s[TAG] and kids[-1][MARKS] == s[MARKS] and s[TAG] not in ("article", "main"):
            _join(kids[-1], s)
        else:
            kids.append(s)
    return [node.tag, node.marks, kids, [page], own, len(text), [own]]


def _join(a: list, b: list) -> None:
    """Sibling b into the run a: one node, all text."""
    a[SAME] = zlib.crc32(b[SAME].to_bytes(4, "little"), a[SAME])
    a[VARIES] += b[VARIES]
    a[CONSTANT] += b[CONSTANT]
    pairs, extra = match(a[KIDS], b[KIDS])
    for x, y in pairs:
        _join(a[KIDS][x], b[KIDS][y])
    a[KIDS] += [b[KIDS][y] for y in extra]


def same_kind(a: list, b: list) -> bool:
    return a[TAG] == b[TAG] and a[MARKS] == b[MARKS]


def matching(a: list, b: list) -> int:
    """Simple tree matching: nodes in the largest order-preserving, root-to-root matching of the two trees."""
    if not same_kind(a, b):
        return 0
    return 1 + _table(a[KIDS], b[KIDS])[-1][-1]


def _table(x: list, y: list) -> list[list[int]]:
    m = [[0] * (len(y) + 1)]
    for i in range(len(x)):
        row = [0]
        for j in range(len(y)):
            row.append(max(row[j], m[i][j + 1], m[i][j] + matching(x[i], y[j])))
        m.append(row)
    return m


def match(x: list, y: list) -> tuple[list[tuple[int, int]], list[int]]:
    """Aligned pairs of the two child lists, and the places in y that match nothing."""
    if len(x) == len(y) and all(map(same_kind, x, y)):
        return [(i, i) for i in range(len(x))], []
    m, i, j, pairs = _table(x, y), len(x), len(y), []
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    used = {b for _, b in pairs}
    return pairs[::-1], [b for b in range(len(y)) if b not in used]


def merge(w: list, t: list) -> list:
    """Tree t aligned with the wrapper w and folded into it."""
    w[SAME] = w[SAME] if w[SAME] == t[SAME] else None
    w[PAGES] = sorted({*w[PAGES], *t[PAGES]})[:ENOUGH]
    w[VARIES] += t[VARIES]
    w[CONSTANT] = sorted(set(w[CONSTANT]).intersection(t[CONSTANT])) if w[CONSTANT] else []
    pairs, extra = match(w[KIDS], t[KIDS])
    for a, b in pairs:
        merge(w[KIDS][a], t[KIDS][b])
    w[KIDS] += [t[KIDS][b] for b in extra]
    return w


def align(w: list, page: list, out: dict, path: tuple = ()) -> dict:
    """Path in the page's skeleton -> wrapper node."""
    out[path] = w
    for a, b in match(w[KIDS], page[KIDS])[0]:
        align(w[KIDS][a], page[KIDS][b], out, (*path, b))
    return out


def region(w: list, path: tuple = ()) -> list:
    """The wrapper's container in which most of the varying text lies: descends while one child holds two thirds of it."""
    if w[TAG] in ("article", "main"):
        return w
    kids = [k for k in w[KIDS] if k[MARKS][-1:] != "!" and k[SAME] is None and k[TAG] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "dl")]
    best = max(kids, key=lambda k: k[VARIES], default=None)
    whole = sum(k[VARIES] for k in w[KIDS] if k[MARKS][-1:] != "!" and k[SAME] is None)
    return region(best) if best and best[VARIES] * 3 >= whole * 2 else w


def _shape(s: list):
    return (s[TAG], s[MARKS], tuple(map(_shape, s[KIDS])))


def extract(text: str | None, wrapper: list | None, memo: dict | None = None) -> str:
    """The article's blocks, joined by two newlines."""
    root = parse(text or "")
    articles: list[Node] = []

    def find(n):
        for k in n.kids:
            if not isinstance(k, str) and not k.drop:
                articles.append(k) if k.tag in ("article", "main") else find(k)

    find(root)
    template: set[int] = set()
    tops: list[Node] = []
    if wrapper is not None and len(wrapper[PAGES]) >= ENOUGH:
        tops, template = _by_wrapper(root, wrapper, {} if memo is None else memo)
    tops = tops or articles or [root]
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if t := " ".join("".join(held).split()):
            blocks.append(t)
        held.clear()

    def walk(n):
        for k in n.kids:
            if isinstance(k, str):
                held.append(k)
            elif k.tag == "br":
                held.append(" ")
            elif k.drop or k.tag == "title" or id(k) in template:
                if k.tag in BLOCK:
                    flush()
            elif k.tag in BLOCK:
                flush()
                walk(k)
                flush()
            else:
                walk(k)

    for top in tops:
        walk(top)
        flush()
    return "\n\n".join(blocks)


def _by_wrapper(root: Node, wrapper: list, memo: dict) -> tuple[list[Node], set[int]]:
    """The nodes where the content region stands on the page (or the articles in it), and the template nodes."""
    s = skeleton(root, 0, False)
    key = _shape(s)
    if None not in memo or key not in memo:
        if len(memo) > 5_000:
            memo.clear()
        memo[None] = region(wrapper)
        memo[key] = align(wrapper, s, {})
    aligned, at = memo[key], memo[None]
    tops: list[Node] = []
    template: set[int] = set()

    def walk(node: Node, path: tuple):
        w = aligned.get(path)
        if w is at and not node.drop:
            tops.append(node)
        if w is not None and w[CONSTANT] and len(w[PAGES]) >= ENOUGH and text_hash(words_of(node)) in w[CONSTANT]:
            template.add(id(node))
        i, before = -1, None
        for k in node.kids:
            if isinstance(k, str) or k.tag not in BLOCK and k.tag not in RAW:
                continue
            if before is None or (before.tag, before.marks) != (k.tag, k.marks) or k.tag in ("article", "main"):
                i += 1
            before = k
            walk(k, (*path, i))

    def inside(node: Node) -> list[Node]:
        if node.tag in ("article", "main"):
            return [node]
        return [x for k in node.kids if not isinstance(k, str) and not k.drop and id(k) not in template for x in inside(k)]

    walk(root, ())
    return [x for top in tops for x in inside(top) or [top]], template


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def induce(pages: DataFrame, salts: int = 32) -> DataFrame:
    """One wrapper per host: host, wrapper (JSON)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])

    def fold(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        seen: set[int] = set()
        for b in batches:
            for url, text in zip(*columns(b, "url", "html")):
                h = host_of(url)
                if (twin := hash((h, text))) in seen or not text:
                    continue
                if len(seen) < 100_000:
                    seen.add(twin)
                s = skeleton(parse(text))
                held[h] = merge(held[h], s) if h in held else s
        yield from batched(((h, part % salts, json.dumps(w)) for h, w in held.items()), schema)

    def combine(keys, out):
        def run(t: pa.Table) -> pa.Table:
            w = None
            for x in t.column("wrapper").to_pylist():
                w = merge(w, json.loads(x)) if w else json.loads(x)
            return pa.table({**{k: [t.column(k)[0].as_py()] for k in keys}, "wrapper": [json.dumps(w)]}, schema=out)

        return run

    first = arrow(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), fold, "host string, salt int, wrapper string")
    salted = first.groupBy("host", "salt").applyInArrow(combine(["host", "salt"], schema), "host string, salt int, wrapper string")
    return salted.groupBy("host").applyInArrow(combine(["host"], pa.schema([("host", pa.string()), ("wrapper", pa.string())])), "host string, wrapper string")


def main_text(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    wrappers = materialise(induce(pages), "wrappers")
    total = wrappers.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    kind = "page_id long, url string, text string, n_chars long"
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bounded_batches(spark)
    if total <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})

        def run(batches):
            known, memos = {}, {}

            def out():
                for b in batches:
                    for page_id, url, text in zip(*columns(b, "page_id", "url", "html")):
                        h = host_of(url)
                        if h not in known:
                            known[h] = json.loads(held.value[h]) if h in held.value else None
                        t = extract(text, known[h], memos.setdefault(h, {}))
                        yield page_id, url, t, len(t)

            yield from batched(out(), schema, 500)

        return arrow(source, run, kind)

    def run_joined(batches):
        memos: dict[str, tuple] = {}

        def out():
            for b in batches:
                for page_id, url, text, w in zip(*columns(b, "page_id", "url", "html", "wrapper")):
                    h = host_of(url)
                    if h not in memos:
                        if len(memos) > 2_000:
                            memos.clear()
                        memos[h] = (json.loads(w) if w else None, {})
                    t = extract(text, *memos[h])
                    yield page_id, url, t, len(t)

        yield from batched(out(), schema, 500)

    host = F.udf(host_of, "string", useArrow=True)("url")
    return arrow(source.withColumn("host", host).join(wrappers, "host", "left"), run_joined, kind)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
