"""The pipeline, stage by stage and as a whole, against plain Python."""

import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import bpe, decontaminate, jaccard, quality, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(11)
VOCABULARY = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "te") for b in ("n", "st", "v", "rk") for c in ("a", "o", "ing", "er")]


def prose(n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


def junk(n):
    return " | ".join(f"{r.randint(0, 99999)}#${i}" for i in range(n))


PASSAGE, ITEM = prose(90), prose(14)
GOOD = [prose(120) for _ in range(14)]
TEXTS = [*GOOD, GOOD[0] + " tail", GOOD[1], GOOD[1], prose(60) + PASSAGE + prose(50), prose(70) + PASSAGE + prose(40), prose(50) + ITEM + prose(50), ITEM, *[junk(60) for _ in range(14)], None, "", "é" * 300]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "en", "s", len(TEXTS[2]))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not (t or "x|").count("|")), 0) for i, t in enumerate(TEXTS) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def table(df):
    return sorted(((x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in df.collect()), key=repr)


def explicit(machine, text):
    """The machine's polynomial with every pair written out."""
    cells, x = quality.featurise(text, {})
    z = machine.w0 + sum(float(machine.w[c]) * a for c, a in zip(cells, x))
    for i in range(len(cells)):
        for j in range(i):
            z += float(machine.v[cells[i]] @ machine.v[cells[j]]) * x[i] * x[j]
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_stages_and_run(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    stages = dict(p.STAGES)
    assert list(stages) == ["quality", "near duplicates", "repeated passages", "decontamination", "packing"]
    rows = table(docs)

    machine = quality.train(docs, labels)
    scores = {x[1]: explicit(machine, x[1]) for x in rows}
    for t, s in scores.items():
        assert machine.score(t, {}) == pytest.approx(s, abs=1e-5)
    got = stages["quality"](spark, docs, sf)
    want = [x for x in rows if scores[x[1]] >= 0.5]
    assert table(got) == want and got.columns == docs.columns
    assert len([x for x in want if "|" in (x[1] or "")]) <= 1 and len(want) >= 18

    groups = {d: c for d, _, c in jaccard.brute_force([(x[0], x[1]) for x in want])}
    kept = spark.createDataFrame(want, SCHEMA)
    got = stages["near duplicates"](spark, kept, sf)
    want = sorted({x for x in want if groups[x[0]] == x[0]}, key=repr)
    assert table(got) == want and got.columns == docs.columns

    raws = [(x, (x[1] or "").encode()) for x in want]
    seen = {}
    for _, b in raws:
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    left = []
    for x, b in raws:
        text = repeats.cut(b, repeats.union([(i, i + 400) for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1])).decode("utf-8", "ignore")
        if text or x[1] is None:
            left.append((x[0], None if x[1] is None else text, x[2], x[3], None if x[1] is None else len(text)))
    got = stages["repeated passages"](spark, spark.createDataFrame(want, SCHEMA), sf)
    emptied = [x for x in want if x[1] == "é" * 300]  # it repeats itself
    assert table(got) == sorted(left, key=repr) and got.columns == docs.columns
    assert sum(len(x[1] or "") for x in left) < sum(len(x[1] or "") for x in want) - 800 and len(left) == len(want) - len(emptied)

    found = {x[0]: x[5] for x in decontaminate.brute_force([(x[0], x[1]) for x in left], [(1, ITEM)])}
    got = stages["decontamination"](spark, spark.createDataFrame(left, SCHEMA), sf)
    clean = sorted((x for x in left if not found[x[0]]), key=repr)
    assert table(got) == clean and got.columns == docs.columns and len(clean) <= len(left) - 2

    e = bpe.encoder()
    ids = {x[0]: [*(e.ids(x[1]) if x[1] else ()), 1] for x in clean}

    def whole(pieces):
        at, room = {}, {}
        for x in sorted(pieces.collect(), key=lambda x: (x.doc_id, x.start)):
            assert x.start == at.get(x.doc_id, 0) and x.doc_tokens == len(ids[x.doc_id])
            part = ids[x.doc_id][x.start : x.start + x.length]
            assert x.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at[x.doc_id] = x.start + x.length
            room.setdefault(x.sequence_id, []).append((x.offset, x.length))
        assert at == {d: len(i) for d, i in ids.items()}
        for spans in room.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 2048

    whole(stages["packing"](spark, spark.createDataFrame(clean, SCHEMA), sf))
    whole(p.run(spark, sf))
