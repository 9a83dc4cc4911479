"""Benchmark text in one block or in many: the same rows."""

from sparkloom.llm import decontaminate

LONG = " ".join(f"w{i}" for i in range(120))
OTHER = " ".join(f"v{i}" for i in range(120))


def test_blocks_of_a_benchmark_change_nothing(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (1, "a b x"), (None, "a b"), (None, OTHER), (4, "x y a b y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, "a b"), (3, "b y z"), (4, "w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19"), (5, None)], "item_id long, text string")

    def told(block_windows):
        rows = decontaminate.contamination(docs, bench, block_windows=block_windows).collect()
        return sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.spans], r["items"])) for r in rows)

    assert len(told(1)) == 6 and told(1) == told(3) == told(16 << 20)
    want = [r for r in decontaminate.decontaminated(docs, bench).collect()]
    for size in (1, 2):
        assert decontaminate.decontaminated(docs, bench, block_windows=size).collect() == want
    assert sorted((r.doc_id or 0, r.text) for r in want) == sorted([(0, OTHER)])


def test_a_long_item_is_cut_between_windows():
    words = " ".join(f"w{i % 17}" for i in range(100))
    for size in (1, 7, 91, 1000):
        got = [" ".join(x.decode() for x in w[i : i + 10]) for b in decontaminate.blocks(iter([(1, words), (2, "a b"), (3, "")]), 10, size) for _, w in b for i in range(max(1, len(w) - 9))]
        assert sorted(got) == sorted([" ".join(f"w{j % 17}" for j in range(i, i + 10)) for i in range(91)] + ["a b"])
        assert all(sum(max(len(w) - 9, 1) for _, w in b) <= size for b in decontaminate.blocks(iter([(1, words), (2, "a b")]), 10, size))
