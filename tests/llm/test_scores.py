"""Model and retrieval scores against plain formulas: BM25, likeness and peeling, host wrappers on the driver's pages."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import fingerprints, packing, wrapper


def test_bm25_scores():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 25, n) for n in (3, 10, 7, 1, 20, 9)]
    index = packing.Index(docs)
    mean, n = sum(map(len, docs)) / len(docs), len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))
    for i, seed in enumerate(docs):
        for j, d in enumerate(docs):
            want = 0.0
            for t in set(seed.tolist()):
                tf = d.tolist().count(t)
                if tf and df[t] > 1:
                    want += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            assert index.neighbours(i)[j] == pytest.approx(want, rel=1e-4)


def test_likeness_is_that_of_the_sets(spark):
    r = random.Random(6)
    lines = [f"line {i} of the text" for i in range(400)]
    texts = ["\n".join(r.sample(lines, r.choice((0, 1, 5, 12, 60, 350)))) for _ in range(24)]
    for i in range(0, 24, 4):  # nearly the same as the one before
        texts[i] = texts[i + 1] + "\nand one more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprints.fingerprint(docs).collect()}

    def like(a, b):
        a, b = (set(t.split("\n")) - {""} for t in (a, b))
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for i, t in enumerate(texts):
        y = texts[i - 1]
        half = len(t) // 2
        assert got[i].near_next == pytest.approx(like(t, y)), i
        assert got[i].near_edited == pytest.approx(like(t, t[: len(t) - half] + y[:half])), i
        a = [tuple(int(v, 16) for v in c.split(":")) for c in got[i].fingerprint.split(";")]
        assert len(a) == 24 and sum(n for n, _, _ in a) == 3 * len(set(t.split("\n")) - {""})


def test_fingerprints_alone_tell_small_differences(spark):
    """Peeling the returned sketches in plain Python gives the likeness, however large the documents are."""
    a = "\n".join(f"line {i} here" for i in range(300))
    docs = spark.createDataFrame([(1, a + "\nlast one"), (2, a + "\nother end\nand more")], "doc_id long, text string")
    one, two = (x.fingerprint for x in fingerprints.fingerprint(docs).orderBy("doc_id").collect())
    cells = [[int(v, 16) for v in c.split(":")] for c in one.split(";")], [[int(v, 16) for v in c.split(":")] for c in two.split(";")]
    left = [[(p[0] - q[0] + (1 << 64)) % (1 << 64), p[1] ^ q[1], p[2] ^ q[2]] for p, q in zip(*cells)]
    found = set()
    for _ in range(10):
        for c in left:
            if c[0] in (1, (1 << 64) - 1) and c[1] not in found:
                n, x, h = c
                at = [t * 8 + (x >> 16 * t) % 8 for t in range(3)]
                if left[at[0]] is not c and left[at[1]] is not c and left[at[2]] is not c:
                    continue
                found.add(x)
                for i in at:
                    left[i] = [(left[i][0] - n) % (1 << 64), left[i][1] ^ x, left[i][2] ^ h]
                break
    assert len(found) == 3 and not any(any(c) for c in left)


def test_wrappers_decide_all_pages_of_the_tables(spark):
    """On the driver's pages every page is decided by its host's wrapper, and says the same on both join paths."""
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no driver tables")
    pages = spark.read.parquet(path)
    rows = pages.collect()
    hosts = {}
    for x in rows:
        s = wrapper.skeleton(wrapper.parse(x.html or ""))
        h = wrapper.host_of(x.url)
        hosts[h] = wrapper.merge(hosts[h], s) if h in hosts else s
    ready = [x for x in rows if len(hosts[wrapper.host_of(x.url)][wrapper.PAGES]) >= wrapper.ENOUGH]
    decided = [x for x in ready if wrapper._by_wrapper(wrapper.parse(x.html), hosts[wrapper.host_of(x.url)], {})[0]]
    assert len(decided) == len(ready)
    both = [sorted((x.page_id, x.text) for x in wrapper.main_text(pages, broadcast_bytes=b).collect()) for b in (0, 32 << 20)]
    assert both[0] == both[1] and len(both[0]) == len(rows)
