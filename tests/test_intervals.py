"""Joins of points with intervals, and overlaps, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analysis as A
from sparkloom.operators import intervals as I
from sparkloom.operators import resolve as R

SITE, SPAN = "file_path string, callee_name string, line long", "file_path string, symbol_id string, line long, end_line long, kind string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("seed", "length"), [(1, 3), (2, 60), (3, 5000)])
def test_each_pair_that_meets_comes_once(spark, seed, length):
    r = random.Random(seed)
    spans = [(r.choice("fg"), f"s{i}", a, a + r.randrange(-2, length), "method") for i, a in enumerate(r.choices(range(-70, 300), k=60))]
    sites = [(r.choice("fgh"), f"c{i}", r.randrange(-80, 400)) for i in range(60)]
    want = sorted((c, s) for f, c, line in sites for g, s, a, z, _ in spans if f == g and a <= line <= z)
    assert rows(R.enclosing(spark.createDataFrame(sites, SITE), spark.createDataFrame(spans, SPAN)), "callee_name", "caller_id") == want
    assert R.enclosing(spark.createDataFrame(sites, SITE), spark.createDataFrame([], SPAN)).count() == 0


def test_one_crowded_line_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(I, "SIDE", 32)
    sites = spark.range(400).select(F.lit("f").alias("file_path"), F.col("id").alias("callee_name"), F.lit(9).cast("long").alias("line"))
    spans = spark.range(300).select(F.lit("f").alias("file_path"), F.col("id").alias("symbol_id"), F.lit(8).alias("line"), F.lit(9).alias("end_line"), F.lit("function").alias("kind"))
    got = R.enclosing(sites, spans)
    share = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(share) == got.distinct().count() == 400 * 300 and max(share) < 0.2 * sum(share)


@pytest.mark.parametrize("seed", [4, 5])
def test_overlaps_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    spans = [(r.choice("fg"), f"s{i % 50}", a, a + r.choice([-4, -3, 0, 1, 9, 40])) for i, a in enumerate(r.choices(range(-30, 200), k=70))]
    hunks = [(r.choice("fgh"), b, b + r.choice([-3, 0, 0, 2, 9, 30])) for b in r.choices(range(-40, 220), k=40)] * 2
    want = {}
    for f, s, a, z in spans:
        for b in [min(e, z) - max(b, a) + 1 for g, b, e in hunks if f == g and b <= z and e >= a]:
            n, most = want.get(s, (0, -99))
            want[s] = n + b, max(most, z - a + 1)
    h = spark.createDataFrame(hunks, "file_path string, start long, end long")
    got = A.affected(h, spark.createDataFrame(spans, "file_path string, symbol_id string, line long, end_line long"))
    assert rows(got, "symbol_id", "overlap_ratio") == sorted((s, pytest.approx(min(n / m, 1.0))) for s, (n, m) in want.items())


def test_overlaps_form_no_pairs(spark):
    hunks = spark.range(3000).select(F.lit("f").alias("file_path"), F.lit(3).alias("start"), F.lit(4).alias("end"))
    spans = spark.range(3000).select(F.lit("f").alias("file_path"), F.col("id").alias("symbol_id"), F.lit(1).alias("line"), F.lit(90000).alias("end_line"))
    got = A.affected(hunks, spans)
    assert [tuple(x) for x in got.limit(2).collect()] == [(0, pytest.approx(6000 / 90000)), (1, pytest.approx(6000 / 90000))]
    met = got._jdf.queryExecution().executedPlan()
    got.collect()
    made = [int(n.metrics().apply("numOutputRows").value()) for n in joins(met)]
    assert made and max(made) <= 4 * 3000  # the rows of both sides, and again for the sample of the sort


def joins(plan):
    """Join nodes of a Java plan, those of adaptive plans and their stages too."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joins(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan] * ("Join" in kind) + [x for p in below for x in joins(p)]
