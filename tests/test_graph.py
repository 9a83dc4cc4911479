"""Graph operators on generated graphs against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analysis as A
from sparkloom.operators import graph as G
from sparkloom.operators import resolve as R


def generated(seed, nodes, count, acyclic=False):
    r = random.Random(seed)
    pairs = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(count)]
    return [(f"n{min(p):02}", f"n{max(p):02}") for p in pairs if p[0] != p[1]] if acyclic else [(f"n{a:02}", f"n{b:02}") for a, b in pairs]


def frame(spark, pairs):
    return G.from_pairs(spark, pairs)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def distances(pairs, start):
    out, level, depth, links = {start: 0}, [start], 0, defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
    while level:
        depth += 1
        level = sorted({b for a in level for b in links[a]} - set(out))
        out |= dict.fromkeys(level, depth)
    return out


PAIRS = generated(1, 30, 45)


@pytest.mark.parametrize("depth", [0, 1, 3, None])
def test_trace_both_ways(spark, depth):
    for pairs, edges in ((PAIRS, frame(spark, PAIRS)), ([(b, a) for a, b in PAIRS], G.reverse(frame(spark, PAIRS)))):
        want = sorted((n, d) for n, d in distances(pairs, "n03").items() if d and (depth is None or d <= depth))
        assert rows(G.trace(edges, ids(spark, "n03"), depth), "id", "depth") == want


def test_trace_of_what_is_not_there(spark):
    assert rows(G.trace(frame(spark, PAIRS), ids(spark, "elsewhere"), 3), "id") == []
    assert rows(G.trace(frame(spark, PAIRS).limit(0), ids(spark, "n03"), 3), "id") == []


def test_trace_all_keeps_parallel_edges(spark):
    pairs = [("x", "y"), ("x", "y"), ("y", "x"), ("y", "z")]
    assert rows(G.trace_all(frame(spark, pairs), "x", 2), "id", "depth") == [("x", 2), ("y", 1), ("y", 1), ("z", 2)]


def test_neighbours_and_degrees(spark):
    e = frame(spark, PAIRS)
    nodes = sorted({n for p in PAIRS for n in p} | {"alone"})
    assert rows(G.neighbours(e, "n03"), "id") == sorted({(b,) for a, b in PAIRS if a == "n03"})
    assert rows(G.neighbours(e, "n03", incoming=True), "id") == sorted({(a,) for a, b in PAIRS if b == "n03"})
    assert rows(G.degrees(ids(spark, *nodes), e), "id", "fan_in", "fan_out") == [(n, sum(b == n for _, b in PAIRS), sum(a == n for a, _ in PAIRS)) for n in nodes]


@pytest.mark.parametrize("seed", [2, 3])
def test_components(spark, seed):
    pairs = generated(seed, 20, 28)
    reach = {n: {m for m, d in distances(pairs, n).items()} for p in pairs for n in p}
    want = []
    for n in reach:
        group = {m for m in reach[n] if n in reach[m]}
        if len(group) > 1:
            want.append((n, min(group)))
    assert rows(G.strong_components(frame(spark, pairs)), "id", "component") == sorted(want)
    assert G.has_cycle(frame(spark, pairs)) == bool(want)


def test_levels(spark):
    pairs = generated(4, 18, 30, acyclic=True)
    level = {}

    def of(n):
        if n not in level:
            level[n] = max((of(a) + 1 for a, b in pairs if b == n), default=0)
        return level[n]

    want = sorted((n, of(n)) for p in pairs for n in p)
    assert rows(G.topological_levels(frame(spark, pairs)), "id", "level") == sorted(set(want))
    with pytest.raises(ValueError):
        G.topological_levels(frame(spark, [*pairs, (pairs[0][1], pairs[0][0])]))
    with pytest.raises(ValueError):
        G.topological_levels(frame(spark, [*pairs, ("n01", "n01")]))


def test_impact_claims_by_order(spark):
    pairs = generated(5, 25, 40)
    changed = ["n07", "n02", "n11"]
    back = [(b, a) for a, b in pairs]
    want = {}
    for c in changed:
        for n, d in distances(back, c).items():
            if 0 < d <= 2 and n not in want:
                want[n] = (n, d, "direct" if d == 1 else "transitive", c)
    got = G.impact(frame(spark, pairs), spark.createDataFrame([(c, i) for i, c in enumerate(changed)], "id string, ord int"), 2)
    assert rows(got, "id", "distance", "level", "caused_by") == sorted(want.values())


def test_dead_code_reasons(spark):
    names = {"start": 0, "used": 0, "lonely": 1.0, "island_a": 0.8, "island_b": 1.0, "test_island": 0.5, "shape_test_b": 0.5, "_inner": 0.7}
    pairs = [("start", "used"), ("island_b", "island_a"), ("test_island", "_inner")]
    s = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    assert rows(A.dead_code(s, frame(spark, pairs), ids(spark, "start")), "id", "confidence") == sorted((n, c) for n, c in names.items() if c)
    assert A.dead_code(s, frame(spark, pairs), ids(spark).limit(0)).count() == len(names)


def test_entry_points(spark):
    rows_of = lambda data: spark.createDataFrame(data, "id string, name string, kind string, is_exported boolean")
    assert rows(A.entry_points(rows_of([("1", "main", "Function", False), ("2", "x", "Class", True), ("3", "y", "Function", False)])), "id") == [("1",), ("2",)]
    assert rows(A.entry_points(rows_of([("5", "z", "Class", False), ("4", "y", "Method", False), ("3", "y", "Function", False)])), "id") == [("3",)]


def test_rules_in_one_pass(spark):
    nodes = [f"{layer}/{i}" for layer in ("web", "core", "data") for i in range(4)]
    r = random.Random(9)
    pairs = sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(40)})
    rules = [{"name": "a", "rule_type": "Forbidden", "source_pattern": "web/*", "target_pattern": "data/*"}, {"name": "b", "rule_type": "layer", "source_pattern": "core/*", "target_pattern": "data/*"}, {"name": "c", "rule_type": "required", "source_pattern": "core/*", "target_pattern": "data/2"}]
    want = [("a", x, y) for x, y in pairs if x[:3] == "web" and y[:4] == "data"] + [("b", x, y) for x, y in pairs if x[:4] == "data" and y[:4] == "core"]
    want += [("c", n, "data/2") for n in nodes if n[:4] == "core" and (n, "data/2") not in pairs]
    e = frame(spark, pairs)
    assert rows(A.check_rules(ids(spark, *nodes), e, rules), "rule_name", "src", "dst") == sorted(want)
    single = [A.forbidden(e, "a", "web/*", "data/*"), A.layer(e, "b", "core/*", "data/*"), A.required(ids(spark, *nodes), e, "c", "core/*", "data/2")]
    assert sorted(x for df in single for x in rows(df, "rule_name", "src", "dst")) == sorted(want)
    assert A.check_rules(ids(spark, *nodes), e, []).count() == 0


def test_batches_open_at_their_first_event(spark):
    r = random.Random(10)
    events = [(r.choice("ab"), r.randrange(0, 4_000_000)) for _ in range(200)] + [(None, 5)]
    want = []
    for k in ("a", "b", None):
        start = None
        for t in sorted(t for x, t in events if x == k):
            if start is None or t >= start + 500_000:
                start = t
                want.append([k, start, 0])
            want[-1][2] += 1
    df = spark.createDataFrame(events, "key string, t long").select("key", F.timestamp_micros("t").alias("ts"))
    got = A.debounced(df, 500).select("key", F.unix_micros("batch_start").alias("t"), "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert A.debounced(df.limit(0)).count() == 0


def test_calls_are_deduplicated_by_the_most_specific(spark):
    calls = [("f", "go", 3, 9, "Direct"), ("f", "go", 3, 4, "Virtual"), ("f", "go", 4, 1, "Direct"), ("g", "go", 3, 1, "Odd")]
    df = spark.createDataFrame(calls, "file_path string, callee_name string, line long, col long, call_type string")
    assert rows(R.distinct_calls(df), "file_path", "line", "call_type") == [("f", 3, "Virtual"), ("f", 4, "Direct"), ("g", 3, "Odd")]


def test_containment_of_long_functions(spark):
    r = random.Random(12)
    spans = [("f", f"s{i}", a, a + r.randrange(0, 700), "Function") for i, a in enumerate(r.sample(range(2000), 25))]
    sites = [("f", "callee", r.randrange(2500)) for _ in range(40)]
    want = sorted((line, s) for _, _, line in sites for _, s, a, z, _ in spans if a <= line <= z)
    got = R.enclosing(spark.createDataFrame(sites, "file_path string, callee_name string, line long"), spark.createDataFrame(spans, "file_path string, symbol_id string, line long, end_line long, kind string"))
    assert rows(got, "line", "caller_id") == want


@pytest.mark.parametrize("pairs", [
    [(f"n{i:03}", f"n{i // 2:03}") for i in range(2, 90)] + [("n005", "n005")],
    [(f"n{i:03}", f"n{i - 1:03}") for i in range(1, 40)] + [("a", "n007"), ("a", "n007")],
    [(f"n{i:03}", f"n{i - 1:03}") for i in range(1, 9)] + [("n000", "n003"), ("b", "a")],
    [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")],
    [("a", "b"), ("b", "a"), ("c", "a")],
    [],
])
def test_counts_of_ancestors(spark, pairs):
    want = {s: {b for a, b in pairs if a == s} for p in pairs for s in p}
    for _ in want:
        want = {s: v.union(*[want[x] for x in v]) for s, v in want.items()}
    names = sorted({x for p in pairs for x in p}) or ["x"]
    got = G.ancestor_counts(frame(spark, pairs) if pairs else spark.createDataFrame([], "src string, dst string"), ids(spark, *names))
    assert rows(got, "id", "n") == sorted((s, len(v - {s})) for s, v in want.items() if v - {s})


def test_metrics_of_a_forest_trace_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "trace", None)
    s = spark.range(1, 200).select("id", F.col("id").cast("string").alias("name"))
    heritage = s.where("id > 1").select(F.col("id").alias("src"), F.expr("id div 2").alias("dst"))
    got = A.all_metrics(s, heritage, heritage)
    assert rows(got, "id", "depth_of_inheritance") == [(i, i.bit_length() - 1) for i in range(1, 200)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [0, 9, 10**6])
def test_components_are_the_same_in_one_task_and_in_all(spark, monkeypatch, held):
    monkeypatch.setattr(G, "HELD", held)
    # Rings of 2, 3 and 30, a bridge between two of them, a tail, a self loop.
    pairs = [("a", "b"), ("b", "a"), ("d", "c"), ("c", "e"), ("e", "d"), ("b", "c"), ("e", "t"), ("t", "u"), ("u", "u")] + [(f"r{i:02}", f"r{(i + 1) % 30:02}") for i in range(30)]
    want = sorted([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")] + [(f"r{i:02}", "r00") for i in range(30)])
    assert rows(G.strong_components(frame(spark, pairs)), "id", "component") == want
    assert G.has_cycle(frame(spark, pairs)) and not G.has_cycle(frame(spark, [("a", "b"), ("b", "c"), ("c", "c")]))


def test_few_edges_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "_propagate", None)
    ring = [(f"r{i:03}", f"r{(i + 1) % 300:03}") for i in range(300)]
    assert G.strong_components(frame(spark, ring)).select("component").distinct().count() == 1
