"""Runs of a million characters, empty tables, null ids, repeated rows and clashing columns, for all ten operators."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, fingerprints, jaccard, packing, quality, repeats, token_counts, toxicity, warc, wrapper
from sparkloom.llm.common import scratch_path

DOCS = "doc_id long, text string, key int, rid string, row int, task string, digest string"
PAGES = "page_id long, url string, html string, sha1 string, host int, part int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, "t", "d") for i, t in rows], DOCS)


@pytest.mark.parametrize("run", [" " * 1_000_000 + "x", "\n" * 1_000_000 + "x", "a" * 300_000, "　" * 100_000])
def test_long_runs_are_encoded_as_by_the_library(run):
    e = bpe.encoder()
    assert e.ids("one " + run) == e.library.encode("one " + run, add_special_tokens=False).ids


def test_long_runs_through_the_queries(spark):
    e = bpe.encoder()
    rows = [(1, " " * 1_000_000 + "x"), (None, "\n" * 1_000_000), (3, "b" * 100_000)]
    docs = docs_of(spark, rows)
    want = sorted((i or 0, len(t), len(e.library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts.token_counts(docs, scratch_path(spark, "cache")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n - 1) for r in pieces) == [(i, n) for i, _, n in want]


def test_empty_tables(spark):
    docs, pages = docs_of(spark, []), spark.createDataFrame([], PAGES)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = warc.write_archives(pages, folder := scratch_path(spark, "warc"))
    found = [toxicity.toxicity(docs, labels), packing.pack(docs), token_counts.token_counts(docs, scratch_path(spark, "cache")), wrapper.main_text(pages), runs, warc.numbered(warc.merge_runs(runs)), warc.read_archives(spark, folder), fingerprints.fingerprint(docs), decontaminate.contamination(docs, bench), decontaminate.decontaminated(docs, bench), repeats.removed(docs), repeats.without_repeats(docs), quality.quality(docs, labels), jaccard.similar(docs), jaccard.one_of_each(docs)]
    for df in found:
        assert df.count() == 0


LONG = " ".join(f"w{i}" for i in range(120))


def test_null_ids_and_repeated_rows_are_each_reported(spark):
    rows = [(None, LONG), (None, None), (1, "a b"), (1, "a b"), (2, LONG), (None, LONG)]
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame([(7, "a b", 1)], "item_id long, text string, row int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    ids = sorted(i or 0 for i, _ in rows)
    found = [toxicity.toxicity(docs, labels), token_counts.token_counts(docs, scratch_path(spark, "cache")), fingerprints.fingerprint(docs), decontaminate.contamination(docs, bench), repeats.removed(docs), quality.quality(docs, labels), jaccard.similar(docs)]
    for df in found:
        assert sorted(r.doc_id or 0 for r in df.collect()) == ids
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminated(docs, bench).collect()) == [0, 0, 0, 2]
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns
    counted = {(r.doc_id, r.n_bytes) for r in found[1].collect()}
    assert counted == {(i, len(t or "")) for i, t in rows}
    gone = {(r.doc_id, r.n_bytes, r.n_removed) for r in found[4].collect()}
    assert gone == {(i, len(t or ""), len(t or "") if t == LONG else 0) for i, t in rows}
    near = {r.n_chars: r for r in found[2].collect() if r.doc_id is None}
    assert set(near) == {0, len(LONG)} and near[len(LONG)].near_edited <= 1


def test_pages_with_odd_rows(spark):
    rows = [(None, "http://a.b/x", "same"), (2, None, "same"), (3, "::", "same"), (3, "http://a.b/x", "other"), (3, "http://a.b/x", "other"), (4, "http://a.b/x", None), (5, "http://a.b/x", "")]
    pages = spark.createDataFrame([(i, u, h, "s", 1, 2) for i, u, h in rows], PAGES)
    runs = warc.write_archives(pages, folder := scratch_path(spark, "warc"))
    history = warc.numbered(warc.merge_runs(runs)).orderBy("history_pos").collect()
    assert [r.history_pos for r in history] == list(range(len(rows)))
    assert [(r.key, r.ts) for r in history] == sorted((r.key, r.ts) for r in history)
    got = sorted((r.page_id or 0, r.kind, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, folder).collect())
    sha = lambda t: warc.base32(hashlib.sha1(t.encode()).digest())
    assert got == [(0, "response", None, 4, sha("same")), (2, "response", None, 4, sha("same")), (3, "response", None, 5, sha("other")), (3, "response", None, 5, sha("other")), (3, "revisit", 2, 4, sha("same")), (4, "response", None, 0, sha("")), (5, "revisit", 4, 0, sha(""))]
    assert wrapper.main_text(pages).count() == len(rows)


def test_pieces_of_a_block_are_bounded_by_shingles(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 100 + i])) for i in range(40)]
    want = sorted((i, 0) for i, _ in rows)
    for weight in (300, 1_000, 1_000_000):
        assert sorted((r.doc_id, r.component_id) for r in jaccard.similar(docs_of(spark, rows), weight=weight).collect()) == want


def test_no_label_is_half(spark):
    got = quality.quality(docs_of(spark, [(1, "x"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in got.collect()] == [0.5, 0.5]


def test_packing_crcs(spark):
    e = bpe.encoder()
    rows = [(i, f"text {i} " * (1 + 97 * i % 300)) for i in range(30)]
    ids = {i: [*e.ids(t), 1] for i, t in rows}
    for r in packing.pack(docs_of(spark, rows), window=256).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r.doc_tokens == len(ids[r.doc_id])
