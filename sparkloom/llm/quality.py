"""Quality by a factorisation machine (Rendle 2010).

A document's features are its words, hashed to `WORDS` cells and weighted by the root of their share of the text; statistics
of its structure (upper case, symbols, digits, repeated words and lines, word length, ...), each cut into `BINS` steps; and
its length as metadata. The score is a logistic link over

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2),

all pairwise interactions of rank `RANK` in time linear in the features present.

The machine is fitted on the driver on a bounded sample of labelled rows (`SAMPLE`, chosen by a hash of the id), as sparse
features and not texts; its size is fixed, so it is broadcast. Scoring is one pass without a shuffle over whole texts.

Defined results: null and empty texts have only their length's feature and still get a score; with no labelled rows of both
classes every score is the share of label 1 (0.5 without any); repeated rows are each scored; other columns are ignored.
lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns

WORDS, BINS, RANK = 1 << 14, 16, 6
#: Labelled rows that the machine is fitted on, at most about.
SAMPLE = 8_000
#: Words whose cells a worker remembers.
MEMO = 50_000

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_DIGITS = bytes(range(0x30, 0x3A))
_PLAIN = b" \n.,;:'\"-()?"
STATS = ("length", "upper", "symbols", "digits", "space", "distinct", "top word", "word length", "repeats", "repeated lines", "odd ends", "pipes", "line length")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Each in [0, 1]."""
    raw = text.encode()
    n, m = max(len(raw), 1), max(len(words), 1)
    letters = max(len(raw) - len(raw.translate(None, _LETTERS)), 1)
    lines = text.split("\n")
    return [
        min(1.0, np.log1p(len(raw)) / 14),
        (len(raw) - len(raw.translate(None, _UPPER))) / letters,
        len(raw.translate(None, _LETTERS + _DIGITS + _PLAIN)) / n * 2,
        (len(raw) - len(raw.translate(None, _DIGITS))) / n * 4,
        raw.count(b" ") / n * 3,
        len(counts) / m,
        max(counts.values(), default=0) / m * 2,
        min(1.0, len(raw) / m / 20),
        sum(map(str.__eq__, words, words[1:])) / m * 4,
        1 - len(set(lines)) / len(lines),
        sum(not w[-1].isalnum() for w in words) / m,
        raw.count(b"|") / m,
        min(1.0, len(raw) / len(lines) / 1000),
    ]


def featurise(text: str | None, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, weights): the statistics' cells come before the words'."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = [k * BINS + min(BINS - 1, max(0, int(v * BINS))) for k, v in enumerate(statistics(text, words, counts))]
    base = len(STATS) * BINS
    if len(memo) > MEMO:
        memo.clear()
    cells = []
    for w in counts:
        c = memo.get(w)
        if c is None:
            c = memo[w] = base + zlib.crc32(w.lower().encode()) % WORDS
        cells.append(c)
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(len(words), 1))
    return np.array(stats + cells, np.int64), np.concatenate((np.ones(len(stats)), weights))


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, cells: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[cells] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[cells] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, text: str | None, memo: dict[str, int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*featurise(text, memo)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 25, rate: float = 0.08, ridge: float = 2e-4, batch: int = 128, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; deterministic."""
    rng = np.random.default_rng(seed)
    size = len(STATS) * BINS + WORDS
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    if 0 < y.mean() < 1:
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                cells, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                lens = np.array([len(rows[i][0]) for i in pick])
                starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
                vx = v[cells] * x[:, None]
                s = np.add.reduceat(vx, starts)
                z = w0 + np.add.reduceat(w[cells] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                each = np.repeat(d, lens) * x
                used, inv = np.unique(cells, return_inverse=True)
                dw = np.bincount(inv, each, len(used)) + ridge * w[used] / len(pick)
                up = each[:, None] * (np.repeat(s, lens, 0) - vx)
                dv = np.stack([np.bincount(inv, up[:, f], len(used)) for f in range(RANK)], 1) + ridge * v[used] / len(pick)
                g0 += d.sum() ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                w0 -= rate * d.sum() / np.sqrt(g0)
                w[used] -= rate * dw / np.sqrt(gw[used])
                v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(w0, w.astype(np.float32), v.astype(np.float32))


def untrained() -> Machine:
    """Every score is 0.5."""
    size = len(STATS) * BINS + WORDS
    return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """docs: doc_id, text; labelled: doc_id, quality (only these labels are learnt)."""
    bounded_batches(docs.sparkSession)
    labels = labelled.where("quality is not null").groupBy(F.col("doc_id").alias("lid")).agg(F.max("quality").alias("label"))
    n = labels.count()
    if not n:
        return untrained()
    few = labels if n <= sample else labels.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    out = pa.schema([("label", pa.int32()), ("id", pa.int64()), ("cells", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])

    def run(batches):
        memo: dict[str, int] = {}

        def rows():
            for b in batches:
                for i, t, y in zip(*columns(b, "doc_id", "text", "label")):
                    cells, x = featurise(t, memo)
                    yield int(y), i, cells.tolist(), x.tolist()

        yield from batched(rows(), out, 500)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("lid"))
    got = arrow(chosen, run, "label int, id long, cells array<int>, weights array<float>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    cells, weights = (got.column(n).combine_chunks() for n in ("cells", "weights"))
    cells, weights = (c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in (cells, weights))
    rows = []
    if len(got):
        ends, c, x = cells.offsets.to_numpy(), cells.values.to_numpy(), weights.values.to_numpy()
        rows = [(c[a:z], x[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]  # views, no Python numbers
    return fit(rows, got.column("label").to_numpy().astype(float)) if rows else untrained()


def quality(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, score, predicted, and the columns in `keep`."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs, labelled, sample))
    kept = [f for f in docs.select(*keep).schema] if keep else []
    names = [f.name for f in kept]
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *names)
    kind = ", ".join(["_id long", "score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])

    def run(batches):
        m, memo = held.value, {}
        for b in batches:
            ids, texts = columns(b, "_id", "_text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m.score(t, memo) for t in texts], pa.float64()), *(b.column(2 + i) for i in range(len(names)))], names=["_id", "score", *names])

    scored = arrow(source, run, kind)
    return scored.select(*([] if "doc_id" in names else [F.col("_id").alias("doc_id")]), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *names)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.toxicity import fold

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(fold("doc_id", 3) != 1)
    return quality(docs, labels).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
