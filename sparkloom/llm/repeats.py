"""Exact repeats of at least `length` bytes by common-prefix interval trees over distributed, sampled suffix arrays.

1. Anchors. In every window of `length` bytes the least hash of its K-grams is an anchor, so two equal windows have equal
   anchors at equal places. An anchor is known by its K-gram (key) and its context, the bytes that any window through it can
   hold: up to length - K before it and `length` from it on. Long documents only give more anchors.
2. Equal contexts are one class: anchors are ordered by key and context in one range shuffle, which splits a hot key over
   tasks. A class met twice is a repeat over its whole context. Keys that occur once, and keys with one class, are done.
3. For each key with several classes, one text of every class goes to an enhanced suffix array: the suffixes from the anchor
   are sorted, and a stack scan over the lengths of their common prefixes walks the interval tree bottom-up. At an interval of
   common length r, members are kept in the order of what stands before the anchor; neighbours there with l common bytes on
   the left form a repeat of l + r bytes. Smaller member lists merge into larger ones, n log^2 n for n classes.
   Left extensions that differ make the repeat maximal; each occurrence is given with the longest extents it has.
4. A key with more than `GROUP` classes is never gathered in one task: its windows are hashed one by one and counted by an
   aggregation (exact as well, costlier).
5. Each document takes the union of its occurrences' extents. All are found on the input, not on what is left of it.

Repeats of so many words, whatever white space stands between them, are found in the same way over texts that have eight bytes of
a hash for each word (words=... of removed and without_repeats).

Matches never cross documents; a repeat inside one document counts, overlapping or not. Every returned extent is checked byte
by byte in step 3; classes and step 4 compare 64-bit hashes within one key.

Defined results: null is the empty text; repeated rows are copies of each other; texts shorter than `length` have nothing
removed; an empty table gives no rows; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns, materialise, release

#: Classes of one key that one task sorts.
GROUP = 20_000
#: Words of a repeated passage, at least: over 50.
WORDS = 51
_CODE = 8
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2^64."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, 1 << 16)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, inverse))
    if size <= 1 << 18:  # a worker keeps those of ordinary texts only
        _powers[:] = [up, down]
    return up, down


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hash of every k-gram, from prefix sums of a polynomial."""
    up, down = _power_tables(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
        h = (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(32))


def sliding(a: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every w neighbours, by block prefixes and suffixes."""
    f, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    m = -(-len(a) // w) * w
    p = np.concatenate((a, np.full(m - len(a), fill, a.dtype))).reshape(-1, w)
    ahead = f.accumulate(p, 1).ravel()
    back = f.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    n = len(a) - w + 1
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, K-gram hashes) of the least K-grams of all windows of `length` bytes."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(np.frombuffer(raw, np.uint8), k)
    w = length - k + 1
    low = sliding(h, w, True)
    edge = np.zeros(w - 1, np.uint64)
    best = sliding(np.concatenate((edge, low, edge)), w, False)
    at = np.flatnonzero(best == h)
    return at, h[at]


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int] | None]:
    """For each context (reversed left part, right part): the longest (left, right) extents of repeats of at least `length`
    bytes through the anchor that also occur in another context; None without any."""
    n = len(rights)
    best: list[list[int] | None] = [None] * n

    def meet(x: int, y: int, r: int) -> None:
        left = common(lefts[x], lefts[y])
        if left + r >= length:
            for i in (x, y):
                e = best[i]
                if e is None:
                    best[i] = [left, r]
                else:
                    e[0], e[1] = max(e[0], left), max(e[1], r)

    if n <= 4:
        for x in range(n):
            for y in range(x):
                meet(x, y, common(rights[x], rights[y]))
        return [None if e is None else (e[0], e[1]) for e in best]
    suffixes = sorted(range(n), key=rights.__getitem__)
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for i, x in enumerate(by_left):
        rank[x] = i
    lcp = [common(rights[a], rights[b]) for a, b in zip(suffixes, suffixes[1:])] + [-1]

    def merged(a: list[int], b: list[int], r: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        found = [bisect_left(a, x) for x in b]
        for x, at in zip(b, found):
            if at:
                meet(by_left[x], by_left[a[at - 1]], r)
            if at < len(a):
                meet(by_left[x], by_left[a[at]], r)
        if len(b) == 1:
            insort(a, b[0])
        else:
            a += b
            a.sort()
        return a

    stack: list[list] = []
    for i, r in enumerate(lcp):
        mine = [rank[suffixes[i]]]
        while stack and stack[-1][0] > r:
            level, other = stack.pop()
            mine = merged(other, mine, level)
        if stack and stack[-1][0] == r:
            stack[-1][1] = merged(stack[-1][1], mine, r)
        else:
            stack.append([r, mine])
    return [None if e is None else (e[0], e[1]) for e in best]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left without the (merged) spans."""
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def word_codes(text: str) -> bytes:
    """_CODE bytes for each word of the text."""
    return b"".join(map(xxhash.xxh3_64_digest, text.encode().split()))


def word_extents(raw: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Bytes of the text from the first to the last word of each span of its word_codes."""
    if not spans:
        return []
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    # Codes at either end may have some bytes in common by chance: only whole words count.
    whole = [(-(-a // _CODE), z // _CODE) for a, z in spans]
    return [(at[a][0], at[z - 1][1]) for a, z in whole if z - a >= words]


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Identity of a row: equal rows have equal texts and so equal results."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))


def repeats(docs: DataFrame, length: int = 400, k: int = 128, group: int = GROUP, code: Callable[[str], bytes] = str.encode) -> DataFrame:
    """Occurrences of maximal repeats: rid (see row_key), start, last (exclusive). docs: rid, text. code: the bytes of a text.

    Every table is deleted as soon as its last reader has been written; texts are shuffled once here, to the places whose
    contexts are wanted.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    before = length - k
    fields = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()), ("ahead", pa.int32())])

    def find(batches):
        for b in batches:
            held = []
            for rid, t in zip(*columns(b, "rid", "text")):
                raw = code(t or "")
                at, h = anchors(raw, length, k)
                if len(at):
                    first, last = np.maximum(at - before, 0), np.minimum(at + length, len(raw))
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z], p - a) for a, z, p in zip(first.tolist(), last.tolist(), at.tolist())), np.uint64, len(at))
                    held.append((h.view(np.int64), ctx.view(np.int64), np.full(len(at), rid, np.int64), at.astype(np.int32), (last - at).astype(np.int32)))
            if held:
                arrays = [np.concatenate(x) for x in zip(*held)]
                for i in range(0, len(arrays[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in arrays], schema=fields)

    found = materialise(arrow(docs, find, "key long, ctx long, rid long, pos int, ahead int"), "anchors")
    met = materialise(_judged(found).where("keep"), "met")
    release(found)
    whole = materialise(met.where("copied").select("rid", (F.col("pos") - F.least("pos", F.lit(before))).cast("long").alias("start"), (F.col("pos") + F.col("ahead")).cast("long").alias("last")).distinct(), "whole")
    reps = met.where("rep").select("key", "rid", "pos")
    many = materialise(reps.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "many")
    wanted = materialise(reps.join(many.hint("merge"), "key").select(F.col("rid").alias("wid"), "key", "pos", "m"), "wanted")
    release(met)
    told = materialise(_contexts(docs, wanted, length, before, code), "contexts", "zstd")
    release(many, wanted)
    partial = materialise(_scanned(told.where(F.col("m") <= group), length), "partial")
    windows = materialise(_by_windows(told.where(F.col("m") > group), length), "by-windows")
    release(told)
    return whole.unionByName(partial).unionByName(windows)


def _judged(found: DataFrame) -> DataFrame:
    """The anchors with keep (the key may occur again), copied (the class occurs again) and rep (the first of its class).

    One range shuffle orders all anchors by key and context, so a key with a third of all rows is spread over many tasks. Only
    rows of one task are compared: a class that is cut between two tasks has a rep in both, which meet in the interval tree;
    the first and the last key of a task are always kept.
    """
    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ("key", "ctx", "rid", "pos")
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "ctx", "rid", "pos", "ahead")
    return arrow(dealt, judge, "rid long, pos int, ahead int, key long, keep boolean, copied boolean, rep boolean")


def judge(batches):
    """The rows of one task, in order: see _judged."""
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int32()), ("ahead", pa.int32()), ("key", pa.int64()), ("keep", pa.bool_()), ("copied", pa.bool_()), ("rep", pa.bool_())])
    held, first = None, None  # rows from the last one on whose neighbour is not known yet, with the row before them
    for b in itertools.chain(batches, [None]):
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else None
        if new is not None and not len(new[0]):
            continue
        if held is None:
            if new is None:
                return
            held, before, first = new, (None, None), new[0][0]
            continue
        after = (None, None) if new is None else (new[0][0], new[1][0])
        key, ctx, rid, pos, ahead = held
        keys = np.concatenate(([key[0] == before[0]], key[1:] == key[:-1], [key[-1] == after[0]]))
        both = keys & np.concatenate(([ctx[0] == before[1]], ctx[1:] == ctx[:-1], [ctx[-1] == after[1]]))
        keep = keys[:-1] | keys[1:] | (key == first)
        if new is None:
            keep |= key == key[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid, pos, ahead, key, keep, both[:-1] | both[1:], ~both[:-1])], schema=schema)
        held, before = new, (key[-1], ctx[-1])


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, before: int, code: Callable[[str], bytes]) -> DataFrame:
    """key, m, rid, pos, before (reversed), after of the wanted places (wid, key, pos, m)."""
    schema = pa.schema([("key", pa.int64()), ("m", pa.int64()), ("rid", pa.int64()), ("pos", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])

    def run(batches):
        def rows():
            last = None
            for b in batches:
                for rid, t, at in zip(*columns(b, "rid", "text", "at")):
                    if rid == last:  # a repeated row: its copy stands for it
                        continue
                    last, raw = rid, code(t)
                    for x in at:
                        p = x["pos"]
                        yield x["key"], x["m"], rid, p, raw[max(0, p - before) : p][::-1], raw[p : p + length]

        yield from batched(rows(), schema, 2_000)

    at = wanted.groupBy("wid").agg(F.collect_list(F.struct("key", "pos", "m")).alias("at"))
    return arrow(docs.join(at.hint("merge"), F.col("rid") == F.col("wid")).select("rid", "text", "at"), run, "key long, m long, rid long, pos long, before binary, after binary")


def _scanned(told: DataFrame, length: int) -> DataFrame:
    """rid, start, last by the interval trees of the contexts of each key."""
    parts = max(1, int(told.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    spans = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("last", pa.int64())])

    def run(batches):
        def rows():
            key, held = None, []

            def solve():
                for (_, rid, p, _, _), e in zip(held, extents([x[3] for x in held], [x[4] for x in held], length) if len(held) > 1 else [None]):
                    if e:
                        yield rid, p - e[0], p + e[1]

            for b in batches:
                for row in zip(*columns(b, "key", "rid", "pos", "before", "after")):
                    if row[0] != key:
                        yield from solve()
                        key, held = row[0], []
                    if not held or held[-1][1:3] != row[1:3]:
                        held.append(row)
            yield from solve()

        yield from batched(rows(), spans)

    return arrow(told.drop("m").repartition(parts, "key").sortWithinPartitions("key", "rid", "pos"), run, "rid long, start long, last long")


def _by_windows(told: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many classes: every window through the anchor by its hash."""
    schema = pa.schema([("key", pa.int64()), ("back", pa.int64()), ("hash", pa.int64()), ("rid", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        def rows():
            for b in batches:
                for key, rid, p, left, right in zip(*columns(b, "key", "rid", "pos", "before", "after")):
                    whole = left[::-1] + right
                    for s in range(len(whole) - length + 1):
                        yield key, len(left) - s, xxhash.xxh3_64_intdigest(whole[s : s + length]) - (1 << 63), rid, p

        yield from batched(rows(), schema)

    windows = arrow(told, run, "key long, back long, hash long, rid long, pos long")
    again = windows.groupBy("key", "back", "hash").agg(F.count("*").alias("n")).where("n > 1")
    return windows.join(again, ["key", "back", "hash"], "left_semi").groupBy("rid", "pos").agg(F.max("back").alias("most"), F.min("back").alias("least")).select("rid", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + length).alias("last"))


def with_spans(docs: DataFrame, length: int, k: int, group: int, words: int | None = None) -> DataFrame:
    """docs (all columns) with rid and spans, the extents to remove (unmerged; null: none); words: and word_spans, of word_codes."""
    keyed = docs.withColumn("rid", row_key())
    texts = keyed.select("rid", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    per = lambda found, name: found.groupBy(F.col("rid").alias("sid")).agg(F.collect_set(F.struct("start", "last")).alias(name))
    spans = per(repeats(texts, length, k, group), "spans")
    if words:
        spans = spans.join(per(repeats(texts, _CODE * words, k, group, word_codes), "word_spans"), "sid", "full")
    return keyed.join(spans.hint("merge"), F.col("rid") == F.col("sid"), "left").drop("sid")


def removed(docs: DataFrame, length: int = 400, k: int = 128, group: int = GROUP, words: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    words: and n_passage_bytes, n_passages, the bytes and maximal runs of repeats of at least so many words, shorter than `length`
    or not; they change none of the other columns.
    """
    bounded_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("n_passage_bytes", pa.int64()), ("n_passages", pa.int64())] if words else []))
    names = ["doc_id", "text", "spans"] + (["word_spans"] if words else [])

    def run(batches):
        def rows():
            for b in batches:
                for d, t, *found in zip(*columns(b, *names)):
                    raw = (t or "").encode()
                    u, *w = ([(x["start"], x["last"]) for x in s or ()] for s in found)
                    u = union(u)
                    out = d, len(raw), sum(z - a for a, z in u), len(u), hashlib.sha256(cut(raw, u)).hexdigest()
                    for v in w:
                        v = union(word_extents(raw, v, words))
                        out += sum(z - a for a, z in v), len(v)
                    yield out

        yield from batched(rows(), schema)

    source = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length, k, group, words)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_passage_bytes long, n_passages long" if words else "")
    return arrow(source.select(*names), run, result)


def without_repeats(docs: DataFrame, length: int = 400, k: int = 128, group: int = GROUP, words: int | None = None) -> DataFrame:
    """The documents (all columns) with repeated bytes removed from text; bytes of characters cut in two go as well.

    words: repeats of at least so many words go too, if they are shorter or differ in white space.
    """
    names = docs.columns

    def kept(t, s, w):
        raw, pairs = (t or "").encode(), lambda x: [(y["start"], y["last"]) for y in x or ()]
        spans = pairs(s) + (word_extents(raw, pairs(w), words) if w else [])
        return cut(raw, union(spans)).decode("utf-8", "ignore") if spans else t

    @F.udf("string", useArrow=True)
    def without(t, s, w):
        return kept(t, s, w)

    found = with_spans(docs, length, k, group, words)
    found = found if words else found.withColumn("word_spans", F.lit(None).cast("array<struct<start:long,last:long>>"))
    none = F.col("spans").isNull() & F.col("word_spans").isNull()
    return found.withColumn("text", F.when(none, F.col("text")).otherwise(without("text", "spans", "word_spans"))).select(*names)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS)


def brute_force(docs: list[tuple], length: int = 400) -> list[tuple]:
    """The contract by a table of all windows, for tests."""
    seen: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for d, r in raws:
        u = union([(i, i + length) for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1])
        out.append((d, len(r), sum(b - a for a, b in u), len(u), hashlib.sha256(cut(r, u)).hexdigest()))
    return out
