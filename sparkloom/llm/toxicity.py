"""Toxicity by class-conditional Kneser-Ney models over characters.

Text is folded to lower-case words. For each class a Kneser-Ney model predicts a byte from the four before it:

    p_class(x | h4) = max(C_class(h4 x) - D, 0) / C_class(h4) + D * N_class(h4 .) / C_class(h4) * p_shared(x | h3)

so an expression that a class has hardly seen is smoothed by the shared backoff p_shared, built from continuation counts
(distinct predecessors) over all documents, labelled or not. A word's evidence is the difference of its log-likelihoods under
the two models; a document is described by length-normalised differences: the mean per byte of the whole text, and of its
strongest words. Those few numbers go through a logistic link.

Counts are a table of the corpus's distinct 5-grams, keyed by the five bytes themselves, so nothing collides and the model
grows with the corpus: tasks count what they read, one aggregation sums it, and contexts, continuations and log-ratios are
aggregations and joins of that table. The link is fitted on at most about `LINK_ROWS` labelled rows with each row's own counts
taken out of the models first, so that it sees them as it would see a new text.

The ratios that are not zero are broadcast `BLOCK` at a time (12 bytes each, in a hash table at most half full), and for the
link the counts behind them `BLOCK` / 4 at a time: one pass over the texts for each block, which adds to the evidence of every
word; with one block the only pass scores at once.

Defined results: null, empty and word-less texts get the score of a text with no evidence; without labelled rows of both
classes every score is 0; repeated rows are each scored; other columns are ignored. lang, source and doc_id are not inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns, materialise, release

DISCOUNT, LOW_DISCOUNT = 0.75, 0.75
#: At most about so many labelled rows fit the logistic link (the counts use them all).
LINK_ROWS = 20_000
#: Ratios in one broadcast; distinct 5-grams that a counting task holds before it hands them on; bytes worked on at a time.
BLOCK, DISTINCT, CHUNK = 4_000_000, 2_000_000, 500_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
FEATURES = ("mean", "top1", "top2", "top4", "strong", "share")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(5-grams as numbers, begin of each word); a word begins at its space, and the text after four spaces."""
    folded = b" ".join((text or "").encode().translate(_FOLD).split())
    if not folded:
        e = np.zeros(0, np.int64)
        return e, e
    raw = np.frombuffer(b"    " + folded + b" ", np.uint8)
    b = raw.astype(np.int64)
    n = len(b) - 4
    g = b[:n] << 32 | b[1 : 1 + n] << 24 | b[2 : 2 + n] << 16 | b[3 : 3 + n] << 8 | b[4:]
    return g, np.concatenate(([0], np.flatnonzero(raw[4:-1] == 32)))


def summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they occur (or the sum of their times)."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first) if len(keys) else times
    return keys[first], total


KINDS = ("toxic", "ordinary")


def counted(rows: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: every distinct 5-gram of rows (text, kind) with its counts.

    kind: place in KINDS, from 1, or 0 without a label. A task holds at most about DISTINCT pairs of gram and kind.
    """
    schema = pa.schema([("gram", pa.int64()), *((k, pa.int64()) for k in KINDS)])

    def emitted(keys, times):
        gram, kind = keys >> 2, keys & 3
        own, at = np.unique(gram, return_inverse=True)
        out = np.zeros((len(KINDS), len(own)), np.int64)
        labelled = kind > 0
        out[kind[labelled] - 1, at[labelled]] = times[labelled]
        for i in range(0, len(own), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (own, *out)], schema=schema)

    def run(batches):
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            held, size = [], 0
            for text, kind in [*zip(*columns(b, "text", "kind")), (None, None)]:
                if kind is not None:
                    held.append(grams(text)[0] << 2 | kind)
                    size += len(held[-1])
                if held and (kind is None or size > CHUNK):
                    k, n = summed(np.concatenate(held))
                    keys, times = summed(np.concatenate((keys, k)), np.concatenate((times, n)))
                    held, size = [], 0
            if len(keys) > DISTINCT:
                yield from emitted(keys, times)
                keys, times = keys[:0], times[:0]
        if len(keys):
            yield from emitted(keys, times)

    found = arrow(rows.select("text", "kind"), run, "gram long, " + ", ".join(f"{k} long" for k in KINDS))
    return found.groupBy("gram").agg(*[F.sum(k).alias(k) for k in KINDS])


#: What a ratio is made of: counts, totals and distinct followers of the context in both classes, and the shared backoff.
STATS = ("toxic", "toxic_n", "toxic_t", "ordinary", "ordinary_n", "ordinary_t", "low")


def _probability(k: str, low: Column) -> Column:
    c, n, t = F.col(k), F.col(f"{k}_n"), F.col(f"{k}_t")
    return F.when(n > 0, F.greatest(c - DISCOUNT, F.lit(0.0)) / n + DISCOUNT * t / n * low).otherwise(low)


def ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio (log p_toxic - log p_ordinary) and STATS of the 5-grams whose context a labelled row has.

    A context that no labelled row has gives the same probabilities in both classes, so a ratio of zero.
    """
    context = F.shiftright("gram", 8)
    contexts = counts.groupBy(context.alias("context")).agg(*[F.sum(k).alias(f"{k}_n") for k in KINDS], *[F.count_if(F.col(k) > 0).alias(f"{k}_t") for k in KINDS]).where("toxic_n + ordinary_n > 0")
    four = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF))
    shared = counts.groupBy(four.alias("four")).agg(F.count("*").alias("before"))
    threes = shared.groupBy(F.shiftright("four", 8).alias("three")).agg(F.sum("before").alias("total"), F.count("*").alias("types"))
    low = shared.withColumn("three", F.shiftright("four", 8)).join(threes, "three").select("four", ((F.greatest(F.col("before") - LOW_DISCOUNT, F.lit(0.0)) + LOW_DISCOUNT * F.col("types") / 256) / F.col("total")).alias("low"))
    joined = counts.withColumn("context", context).join(contexts, "context").withColumn("four", four).join(low, "four")
    ratio = F.log(_probability("toxic", F.col("low"))) - F.log(_probability("ordinary", F.col("low")))
    return joined.select("gram", ratio.cast("float").alias("ratio"), *[F.col(k).cast("float").alias(k) for k in STATS])


class Table:
    """5-gram -> row of numbers, zeros where it is not known: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros((1 << self.bits, *values.shape[1:]), np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(keys), *self.values.shape[1:]), np.float32), self._slot(keys)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero(~hit & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def evidence(text: str | None, table: Table) -> tuple[np.ndarray, int]:
    """(sum of the ratios of each word, bytes)."""
    g, starts = grams(text)
    if not len(g):
        return np.zeros(0, np.float32), 0
    r = np.concatenate([table.get(g[i : i + CHUNK]) for i in range(0, len(g), CHUNK)])
    return np.add.reduceat(r, starts), len(g)


def unseen_evidence(text: str | None, table: Table, own: int) -> tuple[np.ndarray, int]:
    """The same from a table of STATS, as if the models had not counted this text (own: its class, 0 toxic, 1 ordinary)."""
    g, starts = grams(text)
    if not len(g):
        return np.zeros(0, np.float32), 0
    keys, at, times = np.unique(g, return_inverse=True, return_counts=True)
    stats = table.get(keys).astype(np.float64)
    known, low, logs = stats[:, 6] > 0, np.maximum(stats[:, 6], 1e-30), []
    for k in (0, 1):
        c, n, t = (stats[:, 3 * k + i] for i in range(3))
        if k == own:
            _, context = np.unique(keys >> 8, return_inverse=True)
            n = np.maximum(n - np.bincount(context, times)[context], 0)
            t = np.maximum(t - np.bincount(context, c <= times)[context], 0)
            c = np.maximum(c - times, 0)
        some = n > 0
        n = np.where(some, n, 1)
        logs.append(np.log(np.where(some, np.maximum(c - DISCOUNT, 0) / n + DISCOUNT * np.maximum(t, 1) / n * low, low)))
    r = np.where(known, logs[0] - logs[1], 0)
    return np.add.reduceat(r[at], starts).astype(np.float32), len(g)


def features(words: np.ndarray, size: int) -> list[float]:
    if not len(words):
        return [0.0] * len(FEATURES)
    top = np.sort(words)[::-1][:4]
    strong = int((words > 4).sum())
    top = np.clip(np.pad(top, (0, 4 - len(top))), -10, 20)
    return [float(np.clip(words.sum() / size, -1, 1)) * 10, float(top[0]), float(top[:2].mean()), float(top.mean()), float(np.log1p(strong)), float(strong / len(words)) * 10]


def _tables(found: DataFrame, values: tuple[str, ...], block: int):
    """Columns of the model in broadcast tables, one after another, a context's 5-grams together; none of an empty model."""
    spark, n = found.sparkSession, found.count()
    blocks = max(1, -(-n // block))
    for i in range(blocks if n else 0):
        part = found if blocks == 1 else found.where(F.pmod(F.xxhash64(F.shiftright("gram", 8)), F.lit(blocks)) == i)
        t = part.select("gram", *values).toArrow()  # about `block` small rows
        columns_of = [t.column(v).to_numpy() for v in values]
        yield spark.sparkContext.broadcast(Table(t.column("gram").to_numpy(), columns_of[0] if len(values) == 1 else np.stack(columns_of, 1)))


def described(texts: DataFrame, model: DataFrame, block: int, unseen: bool = False) -> DataFrame | None:
    """texts (all columns; one is text) with `words` (evidence of each word) and `size`: a pass for each table.

    unseen: as if the models had not counted the texts, whose classes are in `label`.
    """
    out = None
    names = texts.columns
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), "words array<float>", "size long"])
    for table in _tables(model, STATS if unseen else ("ratio",), block):
        first = out is None

        def run(batches, table=table, first=first):
            t = table.value
            for b in batches:
                if unseen:
                    got = [unseen_evidence(x, t, 0 if y else 1) for x, y in zip(*columns(b, "text", "label"))]
                else:
                    got = [evidence(x, t) for x in columns(b, "text")[0]]
                words = [w for w, _ in got]
                if not first:
                    words = [w + np.array(old, np.float32) for w, old in zip(words, columns(b, "words")[0])]
                lens = np.cumsum([0, *map(len, words)])
                lists = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(words) if words else [], pa.float32()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), lists, pa.array([n for _, n in got], pa.int64())], names=[*names, "words", "size"])

        last, out = out, arrow(texts if first else out, run, kind)
        if not first:
            out = materialise(out, "evidence")
            table.unpersist()
            if hasattr(last, "scratch"):
                release(last)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(key, modulus: int):
    """crc32 of the id as text, modulo: the folds that the queries fix."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def toxicity(docs: DataFrame, labelled: DataFrame, threshold: float = 0.3, block: int = BLOCK) -> DataFrame:
    """Scores of docs (doc_id, text): doc_id, score, predicted. labelled: doc_id, toxic; only these labels are learnt."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labelled.where("toxic is not null").groupBy(F.col("doc_id").alias("lid")).agg((F.max("toxic") > 0).alias("label"))
    known = texts.join(F.broadcast(labels) if _small(labels) else labels, F.col("doc_id") == F.col("lid"), "left")
    kind = F.when(F.col("label").isNull(), 0).when(F.col("label"), 1).otherwise(2)
    counts = materialise(counted(known.select("text", kind.alias("kind"))), "grams")
    model = materialise(ratios(counts), "ratios")
    release(counts)
    n = labels.count()
    sample = labels if n <= LINK_ROWS else labels.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 20)) < int((1 << 20) * LINK_ROWS / n))
    few = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("lid")).select("text", "label")
    seen = described(few, model, max(1, block // 4), unseen=True)
    out = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def learn(batches):
        yield from batched(((int(y), features(np.array(w, np.float32), n)) for b in batches for y, w, n in zip(*columns(b, "label", "words", "size"))), out)

    got = None if seen is None else arrow(seen, learn, "label int, x array<double>").toArrow()
    y = np.zeros(0) if got is None else got.column("label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    x = np.array(got.column("x").to_pylist())
    scale = np.maximum(x.std(0), 1e-6)
    w = logistic((x - x.mean(0)) / scale, y)
    bias = w[-1] - (w[:-1] * x.mean(0) / scale).sum()
    link = [*(w[:-1] / scale), bias]
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def one(words, size):
        z = sum(a * b for a, b in zip(link, [*features(words, size), 1.0]))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    if model.count() <= block:
        (table,) = _tables(model, ("ratio",), block)

        def score(batches):
            t = table.value
            yield from batched(((d, one(*evidence(text, t))) for b in batches for d, text in zip(*columns(b, "doc_id", "text"))), schema)

        scored = arrow(texts, score, "doc_id long, score double")
    else:

        def score_words(batches):
            yield from batched(((d, one(np.array(words, np.float32), n)) for b in batches for d, words, n in zip(*columns(b, "doc_id", "words", "size"))), schema)

        scored = arrow(described(texts, model, block), score_words, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: Labels are broadcast to the texts up to so many rows (16 bytes each); beyond that they are joined by id.
BROADCAST_ROWS = 1_000_000


def _small(labels: DataFrame) -> bool:
    return labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold("doc_id", 4) != 2)
    return toxicity(docs, labels, 0.3).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
