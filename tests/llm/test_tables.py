"""Operators on small tables: nulls, empty and repeated rows, clashing columns, empty tables, and brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, fingerprints, jaccard, packing, quality, repeats, token_counts, toxicity, warc, wrapper
from sparkloom.llm.common import scratch_path

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", " ", "a b", "a b", LONG, LONG + " tail", "x " + LONG, "Q " * 300, "é\n\n" * 40 + LONG.upper(), "<|endoftext|> hi"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "k", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, rid long, key string, cls long")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, "a b"), (3, None)], "item_id long, text string")
    got = decontaminate.contamination(docs, bench).select("doc_id", "n_words", F.size("spans").alias("s"))
    want = decontaminate.brute_force(list(enumerate(TEXTS)), [(r.item_id, r.text) for r in bench.collect()])
    assert rows(got.where("s > 0"), "doc_id") == sorted((w[0],) for w in want if w[5])
    one_by_one = decontaminate.contamination(docs, bench, block_windows=1)
    assert rows(one_by_one.where(F.size("spans") > 0), "doc_id") == rows(got.where("s > 0"), "doc_id")
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_similar(spark, docs):
    assert rows(jaccard.similar(docs), "doc_id", "n_shingles", "component_id") == sorted(jaccard.brute_force(list(enumerate(TEXTS))))
    assert rows(jaccard.similar(docs, block_size=1), "doc_id", "component_id") == sorted((d, c) for d, _, c in jaccard.brute_force(list(enumerate(TEXTS))))


def test_repeats(spark, docs):
    want = sorted(repeats.brute_force(list(enumerate(TEXTS)), 60))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(repeats.removed(docs, 60, 20), *cols) == want
    assert rows(repeats.removed(docs, 60, 20, group=1), *cols) == want
    assert repeats.without_repeats(docs, 60, 20).columns == docs.columns


def test_token_counts(spark, docs):
    from sparkloom.llm import bpe

    cache = scratch_path(spark, "cache")
    want = sorted((i, len((t or "").encode()), len(bpe.encoder().library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    for _ in range(2):
        assert rows(token_counts.token_counts(docs, cache), "doc_id", "n_bytes", "n_tokens") == want


def test_packing(spark, docs):
    assert rows(packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m"), "doc_id") == []
    assert packing.pack(docs.limit(0)).count() == 0


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    for i, t in enumerate(TEXTS):
        t, y = t or "", TEXTS[i - 1] or ""
        h = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + y[:h]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[4].fingerprint and got[4].near_next == 1.0


def test_warc_and_wrapper(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "<p>hi</p>", 1), (2, None, "<p>hi</p>", 1), (3, "::", None, 1), (4, "http://a.b/x", "", 1)], "page_id long, url string, html string, key int")
    folder = scratch_path(spark, "warc")
    runs = warc.write_archives(pages, folder)
    merged = [(r.key, r.ts, r.page_id) for r in warc.merge_runs(runs).orderBy("part", "pos").collect()]
    assert merged == sorted(merged) and len(merged) == 4
    assert rows(warc.read_archives(spark, folder), "page_id", "kind", "refers_to") == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3)]
    assert rows(wrapper.main_text(pages), "page_id", "text") == [(1, "hi"), (2, "hi"), (3, ""), (4, "")]
    assert rows(wrapper.main_text(pages, broadcast_bytes=0), "page_id", "text") == [(1, "hi"), (2, "hi"), (3, ""), (4, "")]


def test_models(spark, docs):
    train = spark.createDataFrame([(100 + i, ("plain words go on here " * 5 + f"v{i} ") + ("zorgh filth " if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = train.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    both = train.unionByName(docs.select("doc_id", "text"))
    for found in (toxicity.toxicity(both, labels), quality.quality(both, labels)):
        got = {r.doc_id: r for r in found.collect()}
        assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got.values())
        assert sum(got[100 + i].predicted == i % 2 for i in range(60)) >= 57
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert quality.quality(docs, labels.limit(0)).count() == len(TEXTS)
