"""Plain-Python parts against brute force."""

import random
import struct
import zlib

import numpy as np
import pytest

from sparkloom.llm import bpe, decontaminate, jaccard, packing, quality, repeats, toxicity, warc, wrapper


def test_bpe_equals_library():
    e, r = bpe.encoder(), random.Random(1)
    bits = ["a", "b ", "  ", " ", "\n", "\x1c", " ", "'s", "é", "1", ".", "\t", "\r\n", "漢", "\U0001f600", "the", "<|endoftext|>", "\x85", "​"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert e.ids(t) == e.library.encode(t, add_special_tokens=False).ids


def test_decontamination():
    r = random.Random(2)
    items = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 7)))) for i in range(6)] + [(9, None), (10, "")]
    docs = [(i, " ".join(r.choice("abC.") for _ in range(r.randint(0, 40)))) for i in range(60)] + [(99, None)]
    index = decontaminate.Index([(i, decontaminate.words(t)) for i, t in items], 4)
    for d, words, hit, n, _, _ in decontaminate.brute_force(docs, items, 4):
        got = decontaminate.scan(dict(docs)[d], index)
        assert (got[0], sum(z - a for a, z in got[1]), len(got[2])) == (words, hit, n)


def test_join_block():
    r = random.Random(3)
    for _ in range(40):
        m = r.randint(2, 40)
        base = [r.sample(range(300), r.randint(5, 60)) for _ in range(3)]
        sets = [np.array(sorted(set(r.choice(base)) ^ set(r.sample(range(300), r.randint(0, 6)))), np.uint64) for _ in range(m)]
        near = [(i, j) for i in range(m) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        got = jaccard.join_block(sets, 75)

        def groups(links):
            c = list(range(m))
            for _ in range(m):
                for a, b in links:
                    c[a] = c[b] = min(c[a], c[b])
            return c

        assert groups(got) == groups(near) and {frozenset(x) for x in got} <= {frozenset(x) for x in near}


def test_extents():
    r = random.Random(5)
    for _ in range(200):
        n, length = r.randint(2, 25), r.randint(6, 13)
        left = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(n)]
        right = [b"zz" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(n)]
        for x, got in enumerate(repeats.extents(left, right, length)):
            e = [(repeats.common(left[x], left[y]), repeats.common(right[x], right[y])) for y in range(n) if y != x]
            e = [q for q in e if sum(q) >= length]
            assert got == ((max(q[0] for q in e), max(q[1] for q in e)) if e else None)


def test_loser_tree():
    r = random.Random(4)
    for k in range(7):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(sum(runs, []))


def test_warc_record_round_trip():
    raw = warc.record("response", "http://a.b/\r\nx", 5, 7, "D", b"\r\n\r\nbody", None)
    headers, payload = warc.parse(raw)
    assert payload == b"\r\n\r\nbody" and headers["WARC-Record-ID"] == "<urn:page:7>"
    assert warc.url_key("https://WWW.Ex.org:443/A?b#c") == "org,ex)/a?b"


def test_wrapper():
    page = "<html><head><title>T</title></head><body><nav><a>M</a></nav><div class='{c}'>{b}</div><article><h1>H &amp; x</h1><p>one<br>two <b>three<p>four</article><div id=comments><p>c</p></div><script>var a='</p>'</script><footer>f</footer></body>"
    assert wrapper.extract(page.format(c="cookie-notice", b="n"), None) == "H & x\n\none two three\n\nfour"
    assert wrapper.extract(None, None) == "" and wrapper.extract("<p", None) == "<p"
    pages = [f"<body><div><p>always here</p></div><div><p>text {i}</p><p>more {i * i}</p></div></body>" for i in range(5)]
    w = None
    for p in pages:
        s = wrapper.skeleton(wrapper.parse(p))
        w = wrapper.merge(w, s) if w else s
    assert wrapper.extract(pages[3], w) == "text 3\n\nmore 9"


def test_packing_round_trip():
    r = np.random.default_rng(0)
    docs = [r.integers(0, 60, n) for n in (1, 5, 40, 33, 1, 17, 90, 3, 8)]
    got, seq = {}, {}
    for d, start, length, crc, n, s, offset in packing.pieces(list(range(9)), docs, 16, 100):
        assert crc == zlib.crc32(struct.pack(f"<{length}I", *docs[d][start : start + length])) and n == len(docs[d])
        got.setdefault(d, []).append((start, length))
        seq.setdefault(s, []).append((offset, length))
    for parts, sizes in ((got, {i: len(d) for i, d in enumerate(docs)}), (seq, None)):
        for k, v in parts.items():
            at = 0
            for start, length in sorted(v):
                assert start == at
                at += length
            assert at == sizes[k] if sizes else at == 16 or at & (at - 1) == 0


def test_models_take_odd_texts():
    for t in (None, "", " ", "\n", "a", "é" * 10_000, "x " * 100_000):
        cells, x = quality.featurise(t, {})
        assert len(cells) == len(x)
        assert len(toxicity.grams(t)[0]) >= 0


@pytest.mark.parametrize("text", [None, "", "one two", "A  b\tc d e f", "a b c d e f g"])
def test_shingles(text):
    assert len(jaccard.shingles(text)) == jaccard.brute_force([(1, text)])[0][1]


def test_judged_rows_do_not_depend_on_batches():
    import pyarrow as pa

    r = random.Random(8)
    rows = sorted((r.randint(0, 12), r.randint(0, 2), r.randint(0, 3), i, 5) for i in range(60))
    names = ("key", "ctx", "rid", "pos", "ahead")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)
    want = []
    for i, (key, ctx, rid, pos, _) in enumerate(rows):
        same = [x for x in rows if x[:2] == (key, ctx)]
        want.append((rid, pos, key, sum(x[0] == key for x in rows) > 1 or key in (rows[0][0], rows[-1][0]), len(same) > 1, same[0] == rows[i]))
    for size in (1, 2, 7, 60):
        got = [tuple(x[n] for n in ("rid", "pos", "key", "keep", "copied", "rep")) for b in repeats.judge(batch(rows[at : at + size]) for at in range(0, 60, size)) for x in b.to_pylist()]
        assert got == want
    assert list(repeats.judge(iter([]))) == []


def test_long_runs_are_seen():
    n = bpe.RUN
    for gap in (" ", "\n", "\t \r"):
        run = (gap * n)[:n]
        for text, want in ((run, False), (run + gap[0], True), ("a" + run + "b", False), ("a " * n + run + gap[0] + "b", True), ("x" * n, False), ("x" * (n + 1), True), ("a " * n + "x" * (n + 1), True), ("a  " * n, False), ("a " * n, False)):
            assert bpe.has_long_run(text) is want
