"""Blocks of sets that only chance strings together: cut by hue, no link lost, no text sent to many tasks."""

import random

import numpy as np

from sparkloom.llm import jaccard

DOCS = "doc_id long, text string"


def sent(spark, members, edges, **bounds):
    """(doc_id, task, side) of what the tasks get."""
    blocks = jaccard.smaller_blocks(members, edges, **bounds)
    return [tuple(r) for r in jaccard.tasks_of(blocks, **bounds).select("doc_id", "task", "side").collect()]


def test_a_strung_block_is_not_sent_in_all_pairs_of_pieces(spark):
    r = random.Random(3)
    n = 1_000
    pairs = [(i, i + 1, r.randrange(64)) for i in range(n - 1)] + [(0, 1, h) for h in range(64)]
    members = spark.createDataFrame([(i, i, 100, 0) for i in range(n)], "doc_id long, cls long, size int, block long")
    edges = spark.createDataFrame(pairs, "src long, dst long, hue long")
    got = sent(spark, members, edges, block_size=50, weight=1_000_000)
    assert len(got) < 4 * n  # 40 for each before
    tasks = {}
    for d, t, _ in got:
        tasks.setdefault(d, set()).add(t)
    assert all(tasks[a] & tasks[b] for a, b, _ in pairs)


def test_one_hue_in_a_large_block_falls_back_to_pieces(spark):
    n = 60
    members = spark.createDataFrame([(i, i, 100, 0) for i in range(n)], "doc_id long, cls long, size int, block long")
    edges = spark.createDataFrame([(i, i + 1, 5) for i in range(n - 1)], "src long, dst long, hue long")
    tasks = {}
    for d, t, side in sent(spark, members, edges, block_size=20, weight=1_000_000):
        tasks.setdefault(t, []).append((d, side))
    met = {(a, b) for held in tasks.values() for a, x in held for b, y in held if a < b and (x is None or x != y)}
    assert len(met) == n * (n - 1) // 2


def strung(r, n):
    """Texts that share two phrases of three with the next one; the rarest shingles, across two phrases, make them one block."""
    phrases = [" ".join(f"w{r.randrange(10**9)}" for _ in range(10)) for _ in range(n + 2)]
    return [" ".join(phrases[i : i + 3]) for i in range(n)]


def counted(monkeypatch):
    """How many rows go to tasks, and the members of the largest block, for each call that follows."""
    held, deal, cut = [], jaccard.tasks_of, jaccard.smaller_blocks

    def blocks(members, *args):
        held.append(max([0, *(x["count"] for x in members.groupBy("block").count().collect())]))
        return cut(members, *args)

    def tasks_of(*args):
        tasks = deal(*args)
        held.append(tasks.count())
        return tasks

    monkeypatch.setattr(jaccard, "smaller_blocks", blocks)
    monkeypatch.setattr(jaccard, "tasks_of", tasks_of)
    return held


def test_links_of_strung_texts(spark, monkeypatch):
    r = random.Random(5)
    texts = strung(r, 60)
    texts += [t + " tail" for t in texts[::4]] + [texts[3], None, ""]
    docs = list(enumerate(texts))
    want = sorted(jaccard.brute_force(docs))
    assert len({c for _, _, c in want}) == 62
    held = counted(monkeypatch)
    assert sorted(map(tuple, jaccard.similar(spark.createDataFrame(docs, DOCS), block_size=8).collect())) == want
    assert held[0] > 8


def test_the_sketch_grows_with_the_corpus(spark):
    assert [jaccard.sketch_bits(x) for x in (0, 850_000_000, 10 * 10**9, 10**15)] == [22, 22, 26, 26]
    docs = spark.createDataFrame([(i, f"a b c d e f{i} g h i j k") for i in range(40)], DOCS).withColumn("rid", jaccard.row_key())
    s = jaccard.shingles("a b c d e f0 g h i j k")
    for bits in (22, 24):
        every, steps = jaccard.summaries(docs, 5, bits)
        assert len(steps) == 1 << bits and every.count() == 40
        at = jaccard.ordered(s, steps)
        times = steps[(at >> np.uint64(64 - bits)).astype(np.int64)]
        assert times.tolist() == sorted(times.tolist()) and times[-1] == round(4 * np.log2(40)) and times[0] == 0


def test_the_near_duplicates_stage_sends_strung_texts_few_times(spark, monkeypatch):
    import corpus_pipeline

    texts = strung(random.Random(7), 80)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[20] + " end"])), DOCS)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    held = counted(monkeypatch)
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == list(range(80))
    assert held[0] > 40 and held[1] < 10 * 80


def test_a_large_group_of_near_copies_is_sent_few_times(spark, monkeypatch):
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{i}" if j == at else w for j, w in enumerate(base)) for i in range(200) for at in [r.randrange(120)]]
    texts += [" ".join([*base[:60], *(f"y{i}" for i in range(60))]), " ".join([*base[:100], *["z"] * 12]), " ".join(base[:80]), *strung(r, 40)]
    docs = list(enumerate(texts))
    first, held = jaccard.first_tasks, counted(monkeypatch)
    monkeypatch.setattr(jaccard, "first_tasks", lambda *a: held.append((t := first(*a)).count()) or t)
    got = sorted(map(tuple, jaccard.similar(spark.createDataFrame(docs, DOCS), block_size=20).collect()))
    assert got == sorted(jaccard.brute_force(docs))
    assert held[1] >= 200 and held[0] + held[2] < 10 * len(docs)


def test_what_is_linked_is_not_compared_again_and_the_rest_is(spark):
    r = random.Random(9)
    n, tops = 90, 40  # the first of them are one component
    comp = {i: 0 if i < tops else i for i in range(n)}
    rows = [(i, i, 100, 0, comp[i]) for i in range(n)]
    pairs = [(a, b, h) for h in range(64) for line in [sorted(r.sample(range(n), 60))] for a, b in zip(line, line[1:])]
    lines = {}
    for a, b, h in pairs:
        lines.setdefault(h, set()).update((a, b))
    members = spark.createDataFrame(rows, "doc_id long, cls long, size int, block long, comp long")
    tasks = {}
    for d, t, side in sent(spark, members, spark.createDataFrame(pairs, "src long, dst long, hue long"), block_size=20, weight=1_000_000):
        tasks.setdefault(t, []).append((d, side))
    assert all(len(held) < 60 for held in tasks.values())
    met = {(a, b) for held in tasks.values() for a, x in held for b, y in held if a < b and (x is None or x != y)}
    assert met >= {(a, b) for line in lines.values() for a in line for b in line if a < b and comp[a] != comp[b]}
