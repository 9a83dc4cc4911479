"""Kneser-Ney ratios against plain dictionaries, counted with and without a text; blocks of the model; its growth."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import toxicity

D = 0.75
r = random.Random(21)
WORDS = ["lamp", "lark", "larch", "tree", "trek", "stone", "stow", "été", "zorg", "zork"]
DOCS = [(i, " ".join(r.choice(WORDS[: 8 + 2 * (i % 3 == 0)]) for _ in range(r.randrange(0, 30))), None if i % 5 == 4 else int(i % 3 == 0)) for i in range(40)]


def five(text):
    folded = b" ".join(text.encode().translate(toxicity._FOLD).split())
    raw = b"    " + folded + b" "
    return [raw[i : i + 5] for i in range(len(raw) - 4)] if folded else []


def plain(docs):
    """gram -> log ratio, by the formulas of the module's docstring."""
    every = {g for _, t, _ in docs for g in five(t)}
    counts = [Counter(g for _, t, y in docs if y is not None and bool(y) == toxic for g in five(t)) for toxic in (True, False)]
    before = Counter(g[1:] for g in every)
    total, types = Counter(), Counter()
    for four, n in before.items():
        total[four[:3]] += n
        types[four[:3]] += 1
    out = {}
    for g in every:
        low = (max(before[g[1:]] - D, 0) + D * types[g[1:4]] / 256) / total[g[1:4]]
        logs = []
        for c in counts:
            n, t = sum(v for k, v in c.items() if k[:4] == g[:4]), sum(k[:4] == g[:4] for k in c)
            logs.append(math.log(max(c[g] - D, 0) / n + D * t / n * low if n else low))
        out[g] = logs[0] - logs[1]
    return out


@pytest.fixture(scope="module")
def model(spark):
    kind = F.when(F.col("y").isNull(), 0).when(F.col("y") == 1, 1).otherwise(2)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, y int")
    return toxicity.ratios(toxicity.counted(docs.select("text", kind.alias("kind")))).collect()


def test_ratios_are_those_of_the_formulas(model):
    want, got = plain(DOCS), {x.gram.to_bytes(5, "big"): x.ratio for x in model}
    assert {g for g, v in want.items() if abs(v) > 1e-9} <= set(got)
    for g, v in got.items():
        assert v == pytest.approx(want[g], abs=1e-5)


def test_a_text_can_be_taken_out(model):
    table = toxicity.Table(np.array([x.gram for x in model]), np.array([[x[k] for k in toxicity.STATS] for x in model], np.float32))
    low = {x.gram.to_bytes(5, "big"): x.low for x in model}
    for at in (0, 3, 7):
        i, text, y = DOCS[at]
        words, size = toxicity.unseen_evidence(text, table, 0 if y else 1)
        without = [d for d in DOCS if d[0] != i]
        counts = [Counter(g for _, t, k in without if k is not None and bool(k) == toxic for g in five(t)) for toxic in (True, False)]
        by_context = [defaultdict(Counter) for _ in counts]
        for c, b in zip(counts, by_context):
            for g, n in c.items():
                b[g[:4]][g] = n
        total = 0.0
        for g in five(text):
            logs = []
            for b in by_context:
                n, t = sum(b[g[:4]].values()), len(b[g[:4]])
                logs.append(math.log(max(b[g[:4]][g] - D, 0) / n + D * max(t, 1) / n * low[g] if n else low[g]))
            total += logs[0] - logs[1]
        assert size == len(five(text)) and words.sum() == pytest.approx(total, abs=1e-3)


def test_blocks_of_the_model_change_nothing(spark):
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in DOCS], (98, None), (99, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in DOCS], "doc_id long, toxic int")
    one, many = ({x.doc_id: x.score for x in toxicity.toxicity(docs, labels, block=b).collect()} for b in (1 << 20, 40))
    assert len(one) == 42 and one == pytest.approx(many, abs=1e-4)
    assert np.mean([one[i] for i, _, y in DOCS if y]) > np.mean([one[i] for i, _, y in DOCS if y == 0]) + 0.2


def test_the_model_grows_with_the_corpus(spark):
    docs = spark.range(400).select(F.concat_ws(" ", *[F.translate(F.sha2((F.col("id") * 7 + k).cast("string"), 256), "0123456789", "qrstuvwxyz") for k in range(3)]).alias("text"), F.lit(1).alias("kind"))
    sizes = [toxicity.counted(docs.limit(n)).count() for n in (40, 160, 400)]
    assert sizes[1] > 2.5 * sizes[0] and sizes[2] > 1.8 * sizes[1]


def test_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 40, 5000))
    t = toxicity.Table(keys, np.arange(1, len(keys) + 1, dtype=np.float32))
    assert (t.get(keys) == np.arange(1, len(keys) + 1)).all() and not t.get(keys + 1)[~np.isin(keys + 1, keys)].any()
    assert not toxicity.Table(keys[:0], np.zeros(0, np.float32)).get(keys).any()
