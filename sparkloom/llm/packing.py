"""Lexical retrieval packing.

Documents become token ids (with a closing id) and are dealt, where they are read, to shards of at most `shard_tokens` ids; a
shard has a BM25 inverted index over its documents' token ids. Packing a shard: the document that begins a window is its seed;
the index returns the seed's best unused neighbours, which fill the window in order of score; the last one is cut at the
window's end, and its rest seeds the next window. When nothing unused scores, the next unused document is taken. So windows of
`window` ids are always full, and only a shard's end is short: it is cut into sequences whose lengths are powers of two, which
need no padding.

One pass without a shuffle: no key decides where a document goes, so no source or group of copies can fill a task, and a lost
task is packed again from the same split into the same sequences. Memory is bounded by the shard (or one longer document).

Defined results: null counts as empty; an empty text is one piece of the closing id; texts of any length and with runs of any
length are encoded whole; repeated rows are packed each, and a null doc_id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.common import arrow, batched, bounded_batches, columns

K1, B = 1.2, 0.75


class Index:
    """BM25 over the shard's documents, as postings sorted by term; terms of one document, which score no other, are left out."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        each = [np.unique(d, return_counts=True) for d in docs]
        lens = np.array([len(t) for t, _ in each])
        terms, tf, doc = np.concatenate([t for t, _ in each]), np.concatenate([c for _, c in each]), np.repeat(np.arange(n), lens)
        df = np.bincount(terms)
        keep = df[terms] > 1
        terms, tf, doc = terms[keep], tf[keep], doc[keep]
        size = np.array([len(d) for d in docs], np.float64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / size.mean()))).astype(np.float32)
        ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        self.own = (terms, ends)
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(df)))))
        self.n = n

    def neighbours(self, seed: int) -> np.ndarray:
        """Scores of all documents for all of the seed's terms."""
        terms, ends = self.own
        t = terms[ends[seed] : ends[seed + 1]]
        if not len(t):
            return np.zeros(self.n, np.float32)
        lists = list(map(slice, self.at[t].tolist(), self.at[t + 1].tolist()))
        docs, weights = (np.concatenate([x[s] for s in lists]) for x in (self.docs, self.weights))
        return np.bincount(docs, weights, self.n).astype(np.float32)


def best_first(scores: np.ndarray) -> Iterator[int]:
    """All documents that score, best first, then in reading order; sorted a few at a time."""
    left, k = np.flatnonzero(scores > 0), 64
    while len(left):
        least = np.partition(scores[left], len(left) - k)[len(left) - k] if len(left) > k else 0
        now = left[scores[left] >= least]
        yield from now[np.lexsort((now, -scores[now]))].tolist()
        left, k = left[scores[left] < least], k * 8


def order_of(docs: list[np.ndarray], window: int) -> Iterator[int]:
    """The documents' order: seeds followed by the neighbours that fill their windows."""
    n = len(docs)
    index = Index(docs)
    used = np.zeros(n, bool)
    following = 0
    filled = 0
    seed = None
    while True:
        if seed is None:
            while following < n and used[following]:
                following += 1
            if following == n:
                return
            seed = following
            used[seed] = True
            yield seed
            filled += len(docs[seed])
        room = window - filled % window
        scores = index.neighbours(seed)
        scores[used] = 0
        seed = None
        for j in best_first(scores):
            used[j] = True
            yield j
            filled += len(docs[j])
            room -= len(docs[j])
            if room <= 0:
                # Its rest begins the next window; with none left the next window begins with a seed of its own.
                seed = j if room < 0 else None
                break


def pieces(ids: list[object], docs: list[np.ndarray], window: int, first_sequence: int) -> Iterator[tuple]:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of the shard, and so all of its ids."""
    total = sum(map(len, docs))
    full, rest = divmod(total, window)
    ends = [window * (i + 1) for i in range(full)]
    at = full * window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    where, sequence, begin = 0, 0, 0
    for i in order_of(docs, window):
        start = 0
        while start < len(docs[i]):
            take = min(len(docs[i]) - start, ends[sequence] - where)
            yield ids[i], start, take, zlib.crc32(docs[i][start : start + take].astype("<u4").tobytes()), len(docs[i]), first_sequence + sequence, where - begin
            start += take
            where += take
            if where == ends[sequence]:
                sequence, begin = sequence + 1, where


def pack(docs: DataFrame, window: int = 2048, shard_tokens: int = 1_500_000, closing: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        enc = bpe.encoder(tokenizer)

        def rows():
            nonlocal base
            ids, held, size = [], [], 0
            for b in batches:
                for d, t in zip(*columns(b, "doc_id", "text")):
                    a = np.array([*(enc.ids(t) if t else ()), closing], np.int64)
                    if held and size + len(a) > shard_tokens:
                        yield from pieces(ids, held, window, base)
                        base += size // window + window.bit_length()
                        ids, held, size = [], [], 0
                    ids.append(d)
                    held.append(a)
                    size += len(a)
            if held:
                yield from pieces(ids, held, window, base)

        yield from batched(rows(), schema)

    return arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
