"""Rows that must not be lost or met twice: repeated rows, rows of one doc_id with several texts, rows without doc_id."""

from sparkloom.llm import jaccard, repeats

LONG = " ".join(f"w{i}" for i in range(120))
OTHER = " ".join(f"v{i}" for i in range(120))
DOCS = "doc_id long, text string, lang string"


def test_one_row_for_each_group(spark):
    rows = [(1, LONG, "en"), (1, LONG, "en"), (1, LONG, "de"), (2, LONG + " tail", "en"), (3, OTHER, "en"), (3, "a b", "en"), (None, "c d e", "en"), (None, OTHER + " end", "en"), (7, None, "en"), (7, "", "en"), (8, "", "en")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, DOCS))
    want = [(1, LONG, "de"), (3, OTHER, "en"), (3, "a b", "en"), (None, "c d e", "en"), (7, None, "en"), (8, "", "en")]
    key = lambda r: tuple((x is not None, x or "") if i else (x is not None, x or 0) for i, x in enumerate(r))
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)


def test_repeated_row_survives_the_repeats_stage(spark):
    docs = spark.createDataFrame([(1, LONG, "en"), (1, LONG, "en"), (2, "a b", "en"), (2, "a b", "en")], DOCS)
    out = repeats.without_repeats(jaccard.one_of_each(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, LONG), (2, "a b")]
