"""Repeated passages of over 50 words that are shorter than 400 bytes, or differ in white space."""

import random

from sparkloom.llm import repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(texts, length=400, words=51):
    """The texts without repeated windows of bytes and of words, by tables of all windows."""
    cuts = [[] for _ in texts]
    raws = [t.encode() for t in texts]
    spans = [repeats.re.finditer(rb"[^\x20\x09-\x0D]+", b) for b in raws]
    spans = [[m.span() for m in x] for x in spans]
    for unit in ("bytes", "words"):
        seen = {}
        for i, b in enumerate(raws):
            w = b.split()
            n = len(b) - length + 1 if unit == "bytes" else len(w) - words + 1
            for at in range(n):
                key, span = (b[at : at + length], (at, at + length)) if unit == "bytes" else (tuple(w[at : at + words]), (spans[i][at][0], spans[i][at + words - 1][1]))
                seen.setdefault(key, []).append((i, span))
        for held in seen.values():
            if len(held) > 1:
                for i, span in held:
                    cuts[i].append(span)
    return [repeats.cut(b, repeats.union(c)).decode("utf-8", "ignore") for b, c in zip(raws, cuts)]


def test_passages_of_over_50_words(spark):
    import corpus_pipeline

    r = random.Random(13)
    prose = lambda n, size=4: [f"{r.randrange(10**size):0{size}d}é" for _ in range(n)]
    short, fifty, spaced, inside, long = prose(51, 2), prose(50, 2), prose(70), prose(55, 2), prose(120)
    texts = [
        " ".join(prose(30) + short + prose(20)),
        " ".join(prose(5) + short),
        " ".join(prose(30) + fifty + prose(20)),
        " ".join(fifty + prose(9)),
        " ".join(prose(8) + spaced + prose(8)),
        " ".join(prose(3)) + "\n" + "\n ".join(spaced) + "\t" + " ".join(prose(6)),
        " ".join(inside + prose(4) + inside),
        " ".join(prose(7) + long + prose(7)),
        " ".join(prose(9) + long),
        " ".join(prose(80)),
        "",
    ]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    want = {i: t for i, t in enumerate(plain(texts)) if t}
    got = {x.doc_id: x for x in corpus_pipeline.unrepeated(spark, spark.createDataFrame([*rows, (99, None, "en", "s", None)], DOCS), "").collect()}
    assert got.pop(99).text is None
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())
    assert [len(texts[i].split()) - len(want[i].split()) for i in (0, 1, 2, 3, 4, 5, 9)] == [51, 51, 0, 0, 70, 70, 0]


def test_many_texts_of_one_passage_window_by_window(spark):
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"{i}a{j}" for j in range(6)] + passage[a : a + 54] + [f"{i}b{j}" for j in range(6)]) for i in range(12) for a in [r.randrange(7)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (3, 100):
        got = repeats.without_repeats(docs, group=group, words=51)
        assert [x.text for x in sorted(got.collect())] == plain(texts)


def test_op8_tells_passages_of_over_50_words(spark, tmp_path):
    r = random.Random(21)
    prose = lambda n: [f"{r.randrange(10**4):04d}" for _ in range(n)]
    short, fifty, spaced, long = prose(51), prose(50), prose(60), prose(120)
    texts = [
        " ".join(prose(30) + short + prose(20)),
        " ".join(prose(5) + short),
        " ".join(prose(30) + fifty + prose(20)),
        " ".join(fifty + prose(9)),
        " ".join(prose(8) + spaced + prose(8)),
        " ".join(prose(3)) + "\n" + "\n ".join(spaced) + "\t" + " ".join(prose(6)),
        " ".join(short + prose(4) + spaced),
        " ".join(prose(7) + long),
        " ".join(prose(9) + long),
        " ".join(prose(80)),
        "",
        None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, repeats.op8_suffix_array_dedup(spark, str(tmp_path)).collect()))
    assert [x[:5] for x in got] == sorted(repeats.brute_force(list(enumerate(texts))))
    assert [x[2] > 0 for x in got] == [i in (7, 8) for i in range(12)]
    left = plain([t or "" for t in texts], length=10**6)
    assert [x[5] for x in got] == [len((t or "").encode()) - len(k.encode()) for t, k in zip(texts, left)]
    assert [x[6] for x in got] == [1, 1, 0, 0, 1, 1, 2, 1, 1, 0, 0, 0]
