"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

A word is a maximal run of ASCII letters and digits (A-Z folded) and non-ASCII characters. Every benchmark item gives the
set of its windows of `n` words, or itself as one window when it is shorter. The windows go to the executors as a hash
set; each document is scanned once, hash hits are verified word by word, and every word inside an occurrence is hit.

Bound of the broadcast: the benchmark is cut into blocks of at most `BLOCK_WINDOWS` windows (a longer item is cut between
windows), some 60 bytes each with their words; one block is broadcast at a time, scanned against and taken back, so no process
holds more than one, whatever the benchmark's size. With several blocks the rows are numbered and written first; the passes
meet again by that number, so the result is the same.

Defined results: null or word-less text has no words and no hits; repeated items or documents are each reported; an empty
benchmark leaves everything clean; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns, materialise, release

_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Windows in one broadcast.
BLOCK_WINDOWS = 400_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Index:
    """Windows of one block of items: hashes in order, with the word ids and the item of each window beside them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        by_len: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for at, (_, w) in enumerate(items):
            if not w:
                continue
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.uint32)
            k = min(n, len(ids))
            windows = np.lib.stride_tricks.sliding_window_view(ids, k)
            by_len.setdefault(k, []).append((_hashes(ids, k), windows, np.full(len(windows), at, np.int32)))
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, parts in by_len.items():
            hashes, windows, owners = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.by_len[k] = hashes[order], windows[order], owners[order]


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(ids) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _MULT + ids[j : j + len(h)]
    return h


def scan(text: str | None, index: Index) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, word spans hit (from, to), items that occur). Every hit of a hash is verified word by word."""
    w = words(text)
    get = index.vocab.get
    ids = np.array([get(x, 0) for x in w], np.uint32)
    spans, items = [], set()
    for k, (known, windows, owners) in index.by_len.items():
        if len(ids) < k:
            continue
        miss = np.concatenate(([0], np.cumsum(ids == 0)))
        full = np.flatnonzero(miss[k:] == miss[:-k])
        if not len(full):
            continue
        h = _hashes(ids, k)[full]
        low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        for x in np.flatnonzero(high > low).tolist():
            i, a, z = int(full[x]), int(low[x]), int(high[x])
            if (same := (windows[a:z] == ids[i : i + k]).all(1)).any():
                spans.append((i, i + k))
                items.update(index.names[o] for o in owners[a:z][same].tolist())
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return len(w), merged, items


def blocks(items: Iterator, n: int, size: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most `size` windows; a longer item is cut so that each of its windows lies in one part."""
    held, many = [], 0
    for item, text in items:
        w = words(text)
        total = max(len(w) - n + 1, min(1, len(w)))
        for at in range(0, total, size):
            part = w[at : at + size + n - 1] if total > size else w
            more = min(size, total - at)
            if held and many + more > size:
                yield held
                held, many = [], 0
            held.append((item, part))
            many += more
    if held:
        yield held


def _broadcasts(benchmark: DataFrame, n: int, size: int, item_id: str, item_text: str):
    """One block's index after another, on the executors while the caller's pass runs."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).toLocalIterator()
    for block in blocks(((r.i, r.t) for r in rows), n, size):
        yield spark.sparkContext.broadcast(Index(block, n))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, spans (array of word ranges hit), items (sorted ids of items that occur)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])
    kind = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def scanned(block):
        def run(batches):
            index = block.value if block else Index([], n)

            def out():
                for b in batches:
                    for r, d, t in zip(*columns(b, "row", "doc_id", "text")):
                        m, spans, items = scan(t, index)
                        yield r, d, m, [{"first": a, "last": z} for a, z in spans], sorted(x for x in items if x is not None)

            yield from batched(out(), schema)

        return arrow(source, run, kind)

    each = _broadcasts(benchmark, n, block_windows, item_id, item_text)
    first, second = next(each, None), next(each, None)
    if second is None:
        return scanned(first).drop("row")
    source = materialise(source, "rows")  # so that every pass sees the same rows under the same numbers
    tagged = materialise(scanned(first), "hits")
    for block in itertools.chain([second], each):
        tagged = tagged.unionByName(materialise(scanned(block).where((F.size("spans") > 0) | (F.size("items") > 0)), "hits"))
        block.unpersist()
    first.unpersist()
    release(source)
    per_row = tagged.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return per_row.select("doc_id", "n_words", merged(F.col("spans")).alias("spans"), "items")


def merged(spans) -> F.Column:
    """The union of `spans` as disjoint ranges in order; ranges that touch are one, as in scan()."""
    start = F.slice(F.array_sort(spans), 1, 0)

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last.first.alias("first"), F.greatest(last.last, x.last).alias("last"))
        return F.when((F.size(done) > 0) & (x.first <= last.last), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, add)


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without those that contain a benchmark window (rows, columns and nulls otherwise as they came).

    Each row is judged where it is read, without a shuffle; with several blocks, what one pass keeps goes to the next.
    """
    bounded_batches(docs.sparkSession)
    kept = docs
    each = _broadcasts(benchmark, n, block_windows, item_id, item_text)
    first, second = next(each, None), next(each, None)
    for block in itertools.chain([first, second], each):
        if block is None:
            continue
        last, kept = kept, _clean(kept, block, text)
        if second is not None:
            kept = materialise(kept, "clean")
            block.unpersist()
            if last is not docs:
                release(last)
    return kept


def _clean(docs: DataFrame, block, text: str) -> DataFrame:
    names = docs.columns
    flagged = docs.select("*", F.col(text).cast("string").alias("_judged"))

    def run(batches):
        index = block.value
        for b in batches:
            (texts,) = columns(b, "_judged")
            clean = pa.array([not scan(t, index)[1] for t in texts], pa.bool_())
            yield b.select(names).filter(clean)

    return arrow(flagged, run, docs.schema)


def merged_length(spans) -> F.Column:
    """Words in the union of `spans`, which may overlap when they come from several blocks."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), start, lambda s, x: F.struct((s.n + F.greatest(F.lit(0).cast("long"), x.last - F.greatest(s.end, x.first))).alias("n"), F.greatest(s.end, x.last).alias("end")), lambda s: s.n)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = merged_length(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The contract of op7 by plain loops, for tests."""
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            k = min(n, len(q))
            for i in range(len(q) - k + 1) if q else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == q[i : i + k]:
                        hit |= set(range(j, j + k))
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (
    select row_number() over () as row, doc_id, coalesce({_WORDS_SQL}, []) as w from documents
), b as (
    select item_id, coalesce({_WORDS_SQL}, []) as w from benchmark
), q as (
    select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win
    from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), lengths as (
    select distinct k from q
), v as (
    select row, k, i, array_to_string(w[i:i + k - 1], ' ') as win
    from (select row, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lengths where len(w) >= k)
), hit as (
    select v.row, v.k, v.i, q.item_id from v join q using (k, win)
), covered as (
    select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + k)) as p from hit) group by row
), items as (
    select row, count(*) as n_items, string_agg(item, ',' order by item) as names
    from (select distinct row, cast(item_id as varchar) as item from hit) group by row
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (row) left join items using (row)
"""
