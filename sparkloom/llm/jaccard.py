"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct 5-word shingles, hashed to 64 bits. Equal sets collapse to one class before any work on
pairs. Shingles have one global order, commonest last: (times seen, by a sketch of fixed size summed over all documents; then
the hash). Two sets with 100 |x & y| >= 75 |x | y| share at least one of the first |x| - ceil(0.75 |x|) + 1 shingles of each
in that order, and neither is smaller than three quarters of the other.

1. Every class sends its prefix; the classes that send a shingle are chained in order of size (each to the last smaller one
   that has it in its shorter index prefix, when the sizes allow a link): a linear number of edges, never all pairs.
   Connected components of the chains are blocks: every link lies inside one block.
2. Each block's sets meet in one task, stored as a compressed trie in the block's order (commonest first, so that near copies
   share long beginnings). A set walks the trie depth first, sharing partial overlaps, and leaves a subtree when even a full
   match of the remaining lengths could not reach the bound. Subtrees whose members all are in the walker's component already
   are passed over, so a block of thousands of near copies is not expanded into pairs.
3. Blocks over `BLOCK` classes or `WEIGHT` shingles are sets that chance strings together, or large groups of near copies. Each is
   first dealt to pieces once, with some members (pivots) in every piece: that links groups of near copies, and what is linked
   need not be compared again. The chains of the rest are dealt by the hash of the shingle to `HUES` hues, and the components of
   each hue are blocks of their own where that costs less, up to `LEVELS` times over: a linked pair shares a shingle, and all of
   that shingle's chain has one hue. Blocks of several hues with the same members are one. What is still too large is cut by size
   class (base 4/3; a link never spans more than two neighbours) and then into pieces by hash: a component that holds much of it
   meets the others only, and of these every pair of pieces is a task, so no task holds more than two pieces, by classes and by
   shingles, whatever a block's size.
4. Links (a spanning subset in each task) give components, which go back to classes and documents.

The sketch has a cell for each 32 shingles of the corpus or so, within bounds, or counts would tell rare ones from common ones
no longer.

Defined results: null, empty and word-less texts have an empty set, no links and their own id as component; texts of fewer
than five words have one shingle, the whole sequence; repeated rows of a doc_id are reported each; an empty table gives no
rows; other columns are ignored. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns, connected_components, materialise, release

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Cells of the sketch that orders shingles, at least and at most; classes and shingles in one task's piece of a block.
SKETCH_BITS, SKETCH_MOST, BLOCK, WEIGHT = 22, 26, 4_000, 1_000_000
#: Hues that the chains of a large block are dealt to, and how often.
HUES, LEVELS = 4, 3
#: Members of a large block that all its pieces get, about.
PIVOTS = 64
#: Digests of sets that a task remembers having sent; others are sent again, which changes nothing.
SENT = 100_000
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0d


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    with np.errstate(over="ignore"):
        k = min(n, len(a))
        h = np.full(len(a) - k + 1, k, np.uint64)
        for j in range(k):
            h = _mix(h * _MULT[j % 5] + a[j : j + len(h)])
    return np.unique(h)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection of sets of these sizes with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def row_key():
    """Identity of a row: equal rows have equal ids (or none) and equal texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketch_bits(n_bytes: int) -> int:
    """Bits of a cell's number for texts of so many bytes, at about 7 bytes a shingle."""
    return min(max((n_bytes // (7 * 32)).bit_length(), SKETCH_BITS), SKETCH_MOST)


def summaries(docs: DataFrame, n: int, bits: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(rid, doc_id, n_shingles, cls) of every document, and the sketch of shingle counts over all documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = bits or sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch = np.zeros(1 << bits, np.uint16)

        def rows():
            for b in batches:
                held = []
                for rid, d, t in zip(*columns(b, "rid", "doc_id", "text")):
                    s = shingles(t, n)
                    held.append(s)
                    yield rid, d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, None, None
                if held:
                    cells, times = np.unique((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                    sketch[cells] = np.minimum(sketch[cells] + times, 65535)
            import zlib

            for i, part in enumerate(sketch.reshape(-1, 1 << 16)):
                if part.any():
                    yield None, None, None, None, i, zlib.compress(part.tobytes(), 1)

        yield from batched(rows(), schema, 2_000)

    def add(t: pa.Table) -> pa.Table:
        import zlib

        total = np.zeros(1 << 16, np.uint64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint16)
        # Steps of a quarter: neighbours in count need no order of their own, and a byte is enough.
        step = np.minimum(255, np.round(4 * np.log2(np.maximum(total, 1).astype(np.float64)))).astype(np.uint8)
        return pa.table({"block": [t.column("block")[0].as_py()], "steps": [step.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("steps", pa.binary())]))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(row_key().alias("rid"), "doc_id", "text")
    both = materialise(arrow(source, run, "rid long, doc_id long, n_shingles long, digest binary, block int, counts binary"), "shingle-sets")
    steps = np.zeros((1 << bits - 16, 1 << 16), np.uint8)
    # 64 to 1,024 rows of 64 KB.
    for r in both.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, steps binary").collect():
        steps[r.block] = np.frombuffer(r.steps, np.uint8)
    texts = both.where("block is null").select("rid", "doc_id", "n_shingles", _long_of("digest").alias("cls"))
    every = materialise(texts, "every", rows=texts.count())
    release(both)
    return every, steps.ravel()


def ordered(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order: times seen, then hash."""
    return s[np.lexsort((s, sketch[(s >> np.uint64(65 - len(sketch).bit_length())).astype(np.int64)]))]


def index_length(size: int, percent: int) -> int:
    """Prefix of the smaller set of a pair: it shares 2t/(1+t) of itself at least."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def prefixes(docs: DataFrame, sketch, percent: int, n: int) -> DataFrame:
    """token, size, cls, indexed for the prefix of every document's set (once per class in each task)."""
    schema = pa.schema([("token", pa.int64()), ("size", pa.int32()), ("cls", pa.int64()), ("indexed", pa.bool_())])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            tokens, sizes, ids, flags = [], [], [], []
            for (t,) in zip(*columns(b, "text")):
                s = shingles(t, n)
                if not len(s) or (c := class_id(s)) in seen:
                    continue
                if len(seen) < SENT:
                    seen.add(c)
                k = prefix_length(len(s), percent)
                tokens.append(ordered(s, sketch.value)[:k].view(np.int64))
                sizes.append(np.full(k, len(s), np.int32))
                ids.append(np.full(k, c, np.int64))
                flags.append(np.arange(k) < index_length(len(s), percent))
            if tokens:
                t, z, i, f = map(np.concatenate, (tokens, sizes, ids, flags))
                for at in range(0, len(t), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (t, z, i, f)], schema=schema)

    return arrow(docs.select(F.col("text").cast("string").alias("text")), run, "token long, size int, cls long, indexed boolean")


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True)


def chains(rows: DataFrame, percent: int) -> DataFrame:
    """Edges src, dst between classes that share a prefix shingle, linear in the rows; hue: some bits of the shingle's hash."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = rows.repartition(n, "token").sortWithinPartitions("token", "size", "cls", F.desc("indexed"))
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("hue", pa.int64())])

    def run(batches):
        last = (None, 0, 0)  # token, size and class of the last indexed row
        for b in batches:
            t, z, c, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            # For every row the last indexed row before it, in this batch or the one before.
            at = np.where(f, np.arange(len(t)), -1)
            before = np.concatenate(([-1], np.maximum.accumulate(at)[:-1]))
            inside = before >= 0
            pt = np.where(inside, t[before], last[0] if last[0] is not None else 0)
            pz = np.where(inside, z[before], last[1])
            pc = np.where(inside, c[before], last[2])
            ok = (pt == t) & (pc != c) & (100 * pz.astype(np.int64) >= percent * z.astype(np.int64)) & (inside | (last[0] is not None))
            if ok.any():
                hue = (_mix(t[ok].view(np.uint64)) % np.uint64(HUES**LEVELS)).astype(np.int64)
                pairs = np.unique(np.stack([np.minimum(pc[ok], c[ok]), np.maximum(pc[ok], c[ok]), hue], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], schema=schema)
            if (k := int(at.max())) >= 0:
                last = (t[k], z[k], c[k])

    return arrow(rows, run, "src long, dst long, hue long")


class _Node:
    __slots__ = ("path", "kids", "member", "low", "high", "below", "comp")

    def __init__(self, path: np.ndarray, member: int, size: int):
        self.path, self.kids, self.member, self.low, self.high, self.comp = path, {}, [member], size, size, member


def join_block(sets: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning subset of the links among the sets, as index pairs; left: only links between sets[:left] and the rest."""
    m = len(sets)
    sizes = [len(s) for s in sets]
    root = list(range(m))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []
    if m <= 8:
        for i in range(m):
            for j in range(i):
                if (left is None or (j < left) != (i < left)) and find(i) != find(j) and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least_overlap(sizes[i], sizes[j], percent):
                        links.append((j, i))
                        root[find(i)] = find(j)
        return links
    uniq, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(uniq), np.int64)
    rank[np.lexsort((uniq, -df))] = np.arange(len(uniq))
    shared = int((df > 1).sum())  # ranks from here on belong to one set each and can match nothing
    ends = np.cumsum(sizes)
    paths = []
    for e, n in zip(ends.tolist(), sizes):
        p = np.sort(rank[inv[e - n : e]])
        paths.append(p[: np.searchsorted(p, shared)])
    inside = np.zeros(shared + 1, bool)
    # One trie, or one for each side.
    tries = [_Node(paths[0][:0], -1, 0), _Node(paths[0][:0], -1, 0)]
    for t in tries:
        t.member, t.low, t.high, t.comp = [], 1 << 60, 0, None

    def insert(top: _Node, i: int) -> None:
        p, at, node, n, c = paths[i], 0, top, sizes[i], find(i)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node is not top and (node.comp is None or find(node.comp) != c):
                node.comp = None
            if at == len(p):
                node.member.append(i)
                return
            kid = node.kids.get(int(p[at]))
            if kid is None:
                new = _Node(p[at:], i, n)
                node.kids[int(p[at])] = new
                return
            k = min(len(kid.path), len(p) - at)
            differ = np.flatnonzero(kid.path[:k] != p[at : at + k])
            common = int(differ[0]) if len(differ) else k
            if common < len(kid.path):
                mid = _Node(kid.path[:common], i, n)
                mid.member, mid.low, mid.high, mid.comp = [], kid.low, kid.high, kid.comp
                kid.path = kid.path[common:]
                mid.kids[int(kid.path[0])] = kid
                node.kids[int(p[at])] = mid
                kid = mid
            node, at = kid, at + common

    def walk(top: _Node, i: int) -> None:
        """Links of i into the trie, one for each component at most."""
        p, n = paths[i], sizes[i]
        inside[p] = True
        left_of = len(p)  # shingles of the walker that others can have
        stack = [(top, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node.comp is not None and find(node.comp) == find(i):
                continue
            if 100 * node.high < percent * n or 100 * n < percent * node.low:
                continue
            if len(node.path):
                overlap += int(inside[node.path].sum())
                depth += len(node.path)
            # The bound of a member of size s: overlap + what remains of it, and of the walker, must reach the least overlap.
            high = min(node.high, 100 * n // percent)
            if overlap + high - depth < least_overlap(n, high, percent):
                continue
            if node.kids or not node.member:
                beyond = left_of - int(np.searchsorted(p, node.path[-1] + 1)) if len(node.path) else left_of
                if overlap + beyond < least_overlap(n, max(node.low, -(-percent * n // 100)), percent):
                    continue
            for j in node.member:
                if find(j) != find(i) and overlap >= least_overlap(n, sizes[j], percent):
                    links.append((j, i))
                    root[find(i)] = find(j)
            kids = list(node.kids.values())
            if len(kids) > 1:
                kids.sort(key=lambda k: bool(inside[k.path[0]]))  # likely ones are popped first
            stack += [(k, depth, overlap) for k in kids]
        inside[p] = False

    for i in sorted(range(m), key=lambda i: (sizes[i], i)):
        side = 0 if left is None or i < left else 1
        walk(tries[0 if left is None else 1 - side], i)
        insert(tries[side], i)
    return links


def _pieces(block_size: int, weight: int, classes="count", shingles="weight"):
    """Pieces of a group of members, by classes and by shingles."""
    return F.greatest(F.ceil(F.col(classes) / block_size), F.ceil(F.col(shingles) / weight)).cast("int")


def _told(members: DataFrame, keys: list[str], block_size: int, weight: int) -> DataFrame:
    """For each group by `keys`: count and weight of its members, most (those of its largest component), n (pieces) and cost.

    The cost is about how many texts its tasks get: none where all members are linked already, else as tasks_of deals them.
    """
    per = members.groupBy(*keys, "comp").agg(F.count("*").alias("c"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    told = per.groupBy(*keys).agg(F.sum("c").alias("count"), F.sum("w").alias("weight"), F.max(F.struct("c", "w", "comp")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    told = told.withColumn("n", _pieces(block_size, weight)).withColumn("rest", F.col("count") - F.col("most.c")).withColumn("rest_weight", F.col("weight") - F.col("most.w"))
    left, right = _pieces(block_size, weight, "most.c", "most.w"), _pieces(block_size, weight, "rest", "rest_weight")
    apart = 2 * (F.col("most.c") * right + F.col("rest") * (left + right))
    return told.withColumn("cost", F.when(F.col("rest") == 0, 0).when(F.col("n") <= 1, F.col("count")).otherwise(F.least(apart, 2 * F.col("count") * F.col("n"))))


def _with_comp(members: DataFrame) -> DataFrame:
    """comp: the component of a member as far as it is known, else its own class."""
    return members if "comp" in members.columns else members.withColumn("comp", F.col("cls"))


def first_tasks(members: DataFrame, block_size: int, weight: int) -> DataFrame:
    """doc_id, cls, task, side (null): the members of blocks over the bounds, each in one piece, some of them (pivots) in all.

    Links found so join most of a group of near copies, however large, and what is linked need not be compared again.
    """
    sized = members.join(members.groupBy("block").agg(F.count("*").alias("count"), F.sum("size").alias("weight")).withColumn("n", _pieces(block_size, weight)).where("n > 1"), "block")
    pivot = F.pmod(F.xxhash64("cls", F.lit(5)), F.greatest(F.floor(F.col("count") / PIVOTS), 4 * F.col("n"))) == 0
    piece = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))))
    return sized.withColumn("piece", piece).select("doc_id", "cls", F.concat_ws("/", "block", "piece").alias("task"), F.lit(None).cast("int").alias("side"))


def smaller_blocks(members: DataFrame, edges: DataFrame, block_size: int, weight: int) -> DataFrame:
    """The members (doc_id, cls, size, block, comp) with the blocks of its hues in place of each block over the bounds that costs
    more than they do.

    A class may be in several blocks then; classes that share a shingle of their chains still meet in one, unless they have the
    same comp. Ids of blocks are hashes: two that collide make one block, which loses nothing.
    """
    members = _with_comp(members)
    names = ("doc_id", "cls", "size", "block", "comp")
    told = _told(members, ["block"], block_size, weight)
    over = told.where("n > 1").select("block")
    large = materialise(members.join(over, "block", "left_semi").select(*names), "large")
    if not large.limit(1).count():
        return members
    out = [members.join(over, "block", "left_anti").select(*names)]
    costs = materialise(told.where("n > 1 and cost > 0").select("block", "cost"), "costs")
    inside = materialise(edges.join(large.join(costs, "block", "left_semi").select(F.col("cls").alias("src"), "block"), "src").select("src", "dst", "hue", "block"), "inside")
    for level in range(LEVELS):
        shade = F.pmod(F.floor(F.col("hue") / HUES**level), F.lit(HUES))
        ends = inside.select("src", "dst", "hue", "block", *(F.xxhash64(x, F.col("block"), shade).alias(f"{x}_node") for x in ("src", "dst")))
        found = materialise(connected_components(ends.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))), "hued")
        nodes = ends.select(F.col("src_node").alias("node"), F.col("src").alias("cls"), F.col("block").alias("parent")).union(ends.select("dst_node", "dst", "block")).distinct()
        known = members.select("doc_id", "cls", "size", "comp").distinct()
        parted = materialise(nodes.join(found, "node").join(known, "cls").select("doc_id", "cls", "size", F.col("component").alias("block"), "comp", "parent").distinct(), "parted")
        told = materialise(_told(parted, ["block", "parent"], block_size, weight).select("block", "parent", "count", "x", "y", "n", "cost"), "told")
        better = materialise(told.groupBy(F.col("parent").alias("block")).agg(F.sum("cost").alias("parts")).join(costs, "block").where("parts < cost").select("block"), "better")
        # What the hues do not make cheaper, as a group of near copies that share all their shingles, is dealt as it is.
        out.append(materialise(large.join(costs.join(better, "block", "left_anti"), "block", "left_semi").select(*names), "kept-blocks"))
        told_better = told.where("cost > 0").join(better.withColumnRenamed("block", "parent"), "parent", "left_semi")
        # Blocks with the same members become one, and keep the chains of all of them.
        same = told_better.groupBy("count", "x", "y").agg(F.min("block").alias("into"), F.max("n").alias("n"), F.max("cost").alias("cost"), F.collect_set("block").alias("blocks"))
        chosen = materialise(same.select("into", "n", "cost", F.explode("blocks").alias("block")), "chosen")
        once = chosen.where("block = into")
        out.append(materialise(parted.join(once.where("n <= 1"), "block", "left_semi").select(*names).distinct(), "parts"))
        release(large, costs)
        large = materialise(parted.join(once.where("n > 1"), "block", "left_semi").select(*names).distinct(), "large")
        costs = materialise(once.where("n > 1").select("block", "cost"), "costs")
        below = ends.join(found, F.col("src_node") == F.col("node")).select("src", "dst", "hue", F.col("component").alias("block"))
        below = materialise(below.join(chosen.where("n > 1"), "block").select("src", "dst", "hue", F.col("into").alias("block")), "inside")
        release(inside, found, parted, told, better, chosen)
        inside = below
        if not large.limit(1).count():
            break
    release(inside, costs)
    return functools.reduce(DataFrame.union, [*out, large])


def tasks_of(members: DataFrame, block_size: int, weight: int) -> DataFrame:
    """doc_id, cls, task, side (null, 0 or 1) for the members (doc_id, cls, size, block, comp) of the blocks.

    Blocks and groups whose members all have one comp need no task. Where one comp holds a quarter of a group, its members meet
    only the others, and so go out once for each piece of these.
    """
    members = _with_comp(members)
    told = _told(members, ["block"], block_size, weight).where("rest > 0").select("block", "n")
    sized = members.join(told, "block")
    small = sized.where(F.col("n") <= 1).select("doc_id", "cls", F.concat_ws("/", "block").alias("task"), F.lit(None).cast("int").alias("side"))
    step = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(4.0 / 3.0)) + 1e-9).cast("int")
    # A little slack at the edges of size classes: a member goes to its class's group and the next one.
    large = sized.where(F.col("n") > 1).drop("n").withColumn("group", F.explode(F.array(step, step + 1)))
    most = 4 * F.col("most.c") >= F.col("count")
    groups = _told(large, ["block", "group"], block_size, weight).where("rest > 0").withColumn("top", F.when(most, F.col("most.comp")))
    groups = groups.withColumn("lefts", F.when(most, _pieces(block_size, weight, "most.c", "most.w")).otherwise(0)).withColumn("pieces", F.when(most, _pieces(block_size, weight, "rest", "rest_weight")).otherwise(F.col("n")))
    large = large.join(groups.select("block", "group", "top", "lefts", "pieces"), ["block", "group"]).withColumn("in_top", F.col("comp").eqNullSafe(F.col("top")))
    piece = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = large.where("not in_top").withColumn("piece", piece(F.col("pieces")))
    pairs = others.withColumn("other", upto("pieces")).select("doc_id", "cls", F.concat_ws("/", "block", "group", F.least("piece", "other"), F.greatest("piece", "other")).alias("task"), F.when(F.col("piece") == F.col("other"), F.lit(None)).otherwise((F.col("piece") > F.col("other")).cast("int")).cast("int").alias("side"))
    task = F.concat_ws("/", "block", "group", F.lit("top"), "left", "piece").alias("task")
    ours = large.where("in_top").withColumn("left", piece(F.col("lefts"))).withColumn("piece", upto("pieces")).select("doc_id", "cls", task, F.lit(0).alias("side"))
    theirs = others.where("lefts > 0").withColumn("left", upto("lefts")).select("doc_id", "cls", task, F.lit(1).alias("side"))
    return small.union(pairs).union(ours).union(theirs)


def links_in(texts: DataFrame, percent: int, n: int) -> DataFrame:
    """src, dst between classes: the links found in each task. texts: task, side, cls, text."""
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = texts.select("task", "side", "cls", "text").repartition(parts, "task").sortWithinPartitions("task", "side", "cls")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):

        def rows():
            task, held = None, []

            def solve():
                sides = [x[0] for x in held]
                if len(held) > 1 and (sides[0] is None or len(set(sides)) > 1):
                    left = None if sides[0] is None else sides.index(1)
                    for a, b in join_block([x[2] for x in held], percent, left):
                        yield held[a][1], held[b][1]

            for b in batches:
                for t, side, c, text in zip(*columns(b, "task", "side", "cls", "text")):
                    if t != task:
                        yield from solve()
                        task, held = t, []
                    held.append((side, c, shingles(text, n)))
            yield from solve()

        yield from batched(rows(), schema)

    return arrow(dealt, run, "src long, dst long")


def _grouped(docs: DataFrame, percent: int, n: int, block_size: int, weight: int = WEIGHT) -> DataFrame:
    """rid, doc_id, n_shingles, root (class that stands for the group; null without shingles), component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every, steps = summaries(docs, n)
    sketch = spark.sparkContext.broadcast(steps)
    classes = materialise(every.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.first("n_shingles").alias("size")), "classes", rows=(n_rows := every.count()))
    edges = materialise(chains(prefixes(docs, sketch, percent, n), percent), "edges")
    blocks = connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("block"))
    members = materialise(blocks.join(classes.select("cls", F.col("rid").alias("doc_id"), "size"), "cls").select("doc_id", "cls", "size", "block"), "members", rows=n_rows)
    # By the row's key: rows of one doc_id, or of none, may have several texts.
    texts = lambda tasks: docs.withColumn("rid", row_key()).join(tasks.withColumnRenamed("doc_id", "rep").hint("merge"), F.col("rid") == F.col("rep"))
    first = materialise(first_tasks(members, block_size, weight), "first-tasks")
    linked = None
    if first.limit(1).count():
        linked = materialise(connected_components(links_in(texts(first), percent, n)), "linked", rows=n_rows)
        known = members.join(linked.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left")
        alone, members = members, materialise(known.select("doc_id", "cls", "size", "block", F.coalesce("comp", "cls").alias("comp")), "members", rows=n_rows)
        release(alone)
    tasks = materialise(tasks_of(smaller_blocks(members, edges, block_size, weight), block_size, weight), "tasks")
    release(first, edges)
    links = links_in(texts(tasks), percent, n)
    if linked is not None:
        links = links.union(linked.select("node", "component"))
    found = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    release(tasks, members, *([linked] if linked is not None else []))
    sketch.unpersist()
    rooted = classes.join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = rooted.join(least, "root").select("cls", "root", "component_id")
    return every.join(labels, "cls", "left").select("rid", "doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def similar(docs: DataFrame, percent: int = 75, n: int = 5, block_size: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return _grouped(docs, percent, n, block_size, weight).select("doc_id", "n_shingles", "component_id")


def _long_of(digest: str):
    """The first eight bytes of a digest, little-endian, as a signed long."""
    swapped = " || ".join(f"substr(hex({digest}), {15 - 2 * i}, 2)" for i in range(8))
    return F.expr(f"cast(conv({swapped}, 16, -10) as long)")


def one_of_each(docs: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """One row (all columns) for each group: of its smallest doc_id (null only where no row has one), and of equal rows the least.

    Rows without shingles are a group for each doc_id.
    """
    found = _grouped(docs, percent, n, BLOCK).groupBy("rid", "doc_id", "root").agg(F.count("*").alias("times"))
    alone = F.when(F.col("root").isNull(), F.struct("doc_id"))
    best = found.groupBy("root", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "times")).alias("best"))
    kept = materialise(best.select(F.col("best.rid").alias("_kept"), F.col("best.times").alias("_times")), "kept", rows=docs.count())
    keyed = docs.withColumn("_rid", row_key())
    chosen = lambda which: keyed.join(kept.where(which).hint("merge"), F.col("_rid") == F.col("_kept"), "left_semi")
    if not kept.where("_times > 1").limit(1).count():
        return chosen("_times = 1").drop("_rid")
    again = chosen("_times > 1").groupBy("_rid").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return chosen("_times = 1").drop("_rid").unionByName(again)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple], percent: int = 75, n: int = 5) -> list[tuple]:
    """The contract by plain loops, for tests."""
    sets = []
    for d, t in docs:
        w = words(t)
        sets.append((d, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    comp = {d: d for d, _ in sets}
    changed = True
    near = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in near:
            m = min(comp[a], comp[b])
            changed = changed or comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return [(d, len(s), comp[d]) for d, s in sets]


ORACLE_SQL = r"""
with recursive d as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), n as (
    select doc_id, count(*) as n from s group by doc_id
), met as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)
), edges as (
    select a, b from links union all select b, a from links
), reach as (
    select doc_id as node, doc_id as other from d union select reach.node, edges.b from reach join edges on edges.a = reach.other
), least as (
    select node, min(other) as component_id from reach group by node
)
select doc_id, coalesce(n, 0) as n_shingles, component_id from d left join n using (doc_id) join least on node = doc_id
"""
