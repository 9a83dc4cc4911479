"""Globs, complexity, hunks, the query language and imports."""

import itertools

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import analysis as A
from sparkloom.operators import search as S
from sparkloom.operators.imports import normal, resolve_imports
from sparkloom.sources.crawl import ignore_regex


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("pattern", "text", "want"), [("lib/*", "lib/a/b.ts", True), ("*_spec.ts", "a_spec.ts", True), ("*_spec.ts", "a_spec.tsx", False), ("*", "", True), ("a.c", "abc", False), ("a*b*c", "a-b-b-c", True), ("a*b", "xab", False)])
def test_globs(spark, pattern, text, want):
    assert one(spark, C.glob(F.lit(text), pattern)) is want


@pytest.mark.parametrize(("text", "want"), [("", 1), ("while (x) { if (y) { z(); } }", 3), ("for (;;) {} for (;;) {}", 3), ("a && b && c", 3), ("x ?? y", 2), ("p?.q", 2), ("try { } catch (e) { }", 2), ("iffy formula", 1)])
def test_complexity(spark, text, want):
    assert one(spark, C.complexity(F.lit(text))) == want


def test_source_slice(spark):
    text = "\n".join(f"line {i}" for i in range(1, 41))
    assert one(spark, C.source_slice(F.lit(text), F.lit(5), F.lit(7))) == "line 5\nline 6\nline 7"
    for a, z in ((0, 3), (9, 4), (1, 40), (2, 39)):
        assert one(spark, C.source_slice(F.lit(text), F.lit(a), F.lit(z))) == text


def test_packages_and_labels(spark):
    assert one(spark, C.java_package_of(F.lit("app/src/main/java/org/shop/Till.java"))) == "org.shop"
    assert one(spark, C.package_of(F.lit("net/include/src/x.h"), ("src", "include"))) == "net"
    assert [one(spark, C.call_tag(F.lit(x))) for x in ("Virtual", "Odd")] == ["virtual", "unknown"]
    assert one(spark, C.parse_id(F.lit("a::b::c"))) is None


def test_hunks(spark):
    text = "--- a/one\n+++ b/one\n@@ -3,4 +7,2 @@ fn x\n+y\n@@ -20 +30 @@\n--- a/two\n+++ /dev/null\n@@ -1,3 +0,0 @@\n--- /dev/null\n+++ b/three\n@@ -0,0 +1,9 @@"
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(text.split("\n"))], "diff_id int, line_no int, value string")
    hunks = A.parse_hunks(d)
    assert rows(hunks, "file_path", "start", "end") == [("one", 7, 8), ("one", 30, 30), ("three", 1, 9)]
    s = spark.createDataFrame([("p", "one", 8, 30), ("q", "three", 5, 6), ("r", "one", 9, 29)], "symbol_id string, file_path string, line long, end_line long")
    assert [(x.symbol_id, x.overlap_ratio) for x in A.affected(hunks, s).collect()] == [("q", 1.0), ("p", pytest.approx(2 / 23))]


NAMES = ["red door", "red window", "blue door", "blue red sky", "door red", "green"]


def holds(text, words):
    return all(w in text.split() for w in words)


@pytest.mark.parametrize(("query", "want"), [
    ("red", lambda t: holds(t, ["red"])),
    ("red door", lambda t: holds(t, ["red"]) or holds(t, ["door"])),
    ("red AND door", lambda t: holds(t, ["red", "door"])),
    ("+red -door", lambda t: holds(t, ["red"]) and not holds(t, ["door"])),
    ('"red door"', lambda t: "red door" in t),
    ("(red OR blue) AND door", lambda t: (holds(t, ["red"]) or holds(t, ["blue"])) and holds(t, ["door"])),
    ("red OR blue AND door", lambda t: holds(t, ["red"]) or holds(t, ["blue", "door"])),
    ("(red AND NOT door) OR green", lambda t: holds(t, ["red"]) and not holds(t, ["door"]) or holds(t, ["green"])),
    ("-red", lambda t: not holds(t, ["red"])),
    ("name:blue^3 other:red", lambda t: holds(t, ["blue"])),
    ("*", lambda t: True),
    ("nothing", lambda t: False),
])
def test_queries(spark, query, want):
    d = spark.createDataFrame([(i, n, "") for i, n in enumerate(NAMES)], "id int, name string, other string")
    expected = [(i,) for i, n in enumerate(NAMES) if want(n)]
    assert rows(S.search(d, query), "id") == expected
    stored = S.Index.of(d, ["name", "other"])
    assert rows(S.search(stored, query, ids=d.select("id")), "id") == expected


@pytest.mark.parametrize("query", ["a AND", "OR a", "(a", "a)", "", "+", "a AND OR b", '"open', "NOT"])
def test_bad_queries(query):
    with pytest.raises(ValueError):
        S.parse_query(query)


def test_bm25_weighs_fields_and_stored_equals_fly(spark):
    d = spark.createDataFrame([(1, "red", "door"), (2, "door", "red"), (3, "red red", None), (4, "sky", "sky")], "id int, name string, doc string")
    weights = {"name": 3.0, "doc": 1.0}
    fly = {r.id: r.score for r in S.bm25(d, "red", weights).collect()}
    stored = {r.id: r.score for r in S.bm25(S.Index.of(d, ["name", "doc"]), "red", weights).collect()}
    assert fly == pytest.approx(stored) and set(fly) == {1, 2, 3} and fly[1] > fly[2]


def test_normal_paths(spark):
    for path, want in (("a/./b//c", "a/b/c"), ("a/b/../c", "a/c"), ("../../x", "x"), ("a/..", ""), ("./a/../../b", "b")):
        assert one(spark, normal(F.lit(path))) == want


def test_imports_prefer_their_own_folder_and_short_paths(spark):
    files = ["a/x.h", "b/x.h", "b/c.c", "deep/er/y.h", "y.h", "k/m/Foo.java", "m/Foo.kt", "p/src/lib.rs", "p/src/net/mod.rs", "p/src/net/http.rs"]
    f = spark.createDataFrame([(p,) for p in files], "file_path string").withColumn("language", C.language_of(F.col("file_path")))
    asked = {("b/c.c", "x.h"): "b/x.h", ("b/c.c", "y.h"): "y.h", ("b/c.c", "../a/x.h"): "a/x.h", ("k/m/Foo.java", "m.Foo"): "k/m/Foo.java", ("p/src/lib.rs", "crate::net::http::get"): "p/src/net/http.rs", ("p/src/net/http.rs", "super::Client"): "p/src/net/mod.rs", ("p/src/net/http.rs", "serde::De"): None}
    i = spark.createDataFrame([(a, b, 1) for a, b in asked], "file_path string, import_path string, line long")
    got = {(r.file_path, r.import_path): r.resolution for r in resolve_imports(i, f).collect()}
    assert {k: v.value if v.tag == "Resolved" else None for k, v in got.items()} == asked
    assert resolve_imports(i.limit(0), f).count() == 0 and {r.resolution.tag for r in resolve_imports(i, f.limit(0)).collect()} == {"External", "Unresolved"}


def test_ignore_lines():
    import re

    cases = [("*.min.js", "a/b.min.js", True), ("/top", "top/x.js", True), ("/top", "in/top/x.js", False), ("out/", "a/out/x.js", True), ("a/**/z.js", "a/b/c/z.js", True), ("doc?.js", "doc1.js", True)]
    for (pattern, path, want), _ in itertools.product(cases, [0]):
        assert bool(re.search(ignore_regex(pattern), path)) is want, pattern


def test_a_search_looks_at_the_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(5, None)], "id int, name string")
    got = S.search(d.mapInArrow(look, "id int, name string"), '(red OR sky) AND door NOT "red door"')
    assert rows(got, "id") == [(4,)] and seen.value == len(NAMES) + 1
    stored = S.search(S.Index.of(d, ["name"]), '(red OR sky) AND door NOT "red door"')
    assert got.first().score == pytest.approx(stored.first().score)
