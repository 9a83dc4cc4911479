"""Joins of points with intervals of whole numbers, and sums over overlaps, that never look at pairs that don't meet.

An interval is made up of few blocks 2^k * i .. 2^k * (i + 1) - 1 (two for each k at most), and a point lies in one block for each
k: points and intervals with equal blocks are the pairs that meet, and each such pair has one block. Blocks with many of them are
dealt to cells, so that tasks get about equal numbers of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import checkpointed

#: Points and intervals of a block in one cell, about; a task gets some CELLS full cells.
SIDE, CELLS = 1024, 4


def in_blocks(df: DataFrame, a: str, z: str) -> DataFrame:
    """A row for each block (_k, _i) that makes up a..z (longs, a <= z), both ends included."""
    # Exploded and not by functions over arrays, for which Spark compiles no code. One k more than needed, in case the logarithm is rounded.
    each = df.withColumn("_k", F.explode(F.expr(f"sequence(0, cast(log2({z} - {a} + 1) as int) + 1)")))
    each = each.withColumns({"_l": F.expr(f"shiftright({a} + shiftleft(1L, _k) - 1, _k)"), "_r": F.expr(f"shiftright({z} + 1, _k)")}).where("_l < _r")
    ends = F.explode(F.expr("array(if(_l & 1 = 1, _l, null), if(_r & 1 = 1 and (_l & 1 = 0 or _l + 1 < _r), _r - 1, null))"))
    return each.withColumn("_i", ends).where("_i is not null").drop("_l", "_r")


def stabbed(points: DataFrame, intervals: DataFrame, key: str, at: str, a: str, z: str) -> DataFrame:
    """Rows of points beside those of intervals with the same key and at between a and z; key comes once."""
    rows = intervals.where(F.col(z) >= F.col(a)).withColumns({"_a": F.col(a).cast("long"), "_z": F.col(z).cast("long")})
    longest = rows.agg(F.max(F.col("_z") - F.col("_a") + 1)).first()[0] or 0
    rows = in_blocks(rows, "_a", "_z").drop("_a", "_z")
    dots = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(longest.bit_length())))).withColumn("_i", F.expr(f"shiftright(cast({at} as bigint), _k)"))
    where = [key, "_k", "_i"]
    counts = dots.groupBy(*where).agg(F.count("*").alias("_p")).join(rows.groupBy(*where).agg(F.count("*").alias("_q")), where)
    counts = checkpointed(counts)
    pairs = counts.agg(F.sum(F.col("_p") * F.col("_q"))).first()[0] or 0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // (CELLS * SIDE * SIDE)))
    grid = counts.select(*where, F.ceil(F.col("_p") / SIDE).alias("_n"), F.ceil(F.col("_q") / SIDE).alias("_m"))

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        here = df.withColumn("_h", F.xxhash64(*df.columns)).join(grid, where)
        here = here.withColumn(own, F.pmod("_h", own_n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)))
        # One column as the key: of several, Spark leaves out constants, and deals anew by the others to as few tasks as it likes.
        cell = F.concat_ws("/", "_k", "_i", "_x", "_y", key).alias("_c")
        return here.select(cell, *[c for c in df.columns if c not in (where if df is rows else where[1:])]).repartition(tasks, "_c")

    met = dealt(dots, "_x", "_n", "_y", "_m").join(dealt(rows, "_y", "_m", "_x", "_n").hint("merge"), "_c")
    return met.select(*points.columns, *[c for c in intervals.columns if c != key])


def overlapped(intervals: DataFrame, ranges: DataFrame, key: str, a: str, z: str, start: str, end: str) -> DataFrame:
    """intervals with _both: the sum over ranges (start, end) of the same key of the least of both ends less the greatest of both
    starts, plus 1, for ranges with start <= z and end >= a. Intervals without any are left out.

    For ends that are not before their starts this is the number of lines of ranges up to z less that before a, so pairs are not
    formed; a running sum over the places of a key has all those numbers. What ends before it starts is joined with what it meets.
    """
    least = F.least(F.col(end), F.col(z)) - F.greatest(F.col(start), F.col(a)) + 1
    right, odd = ranges.where(F.col(end) >= F.col(start)), ranges.where(F.col(end) < F.col(start))
    event = lambda at, n, s: F.struct(F.col(key).alias(key), at.cast("long").alias("_at"), n.alias("_n"), s.cast("long").alias("_s"))
    none = F.lit(0).cast("long")
    events = right.select(F.explode(F.array(event(F.col(start), F.lit(1), 1 - F.col(start)), event(F.col(end) + 1, F.lit(-1), F.col(end)))).alias("e")).select("e.*")
    sound = intervals.where(F.col(z) >= F.col(a))
    asked = sound.select(F.explode(F.array(event(F.col(z), none, none), event(F.col(a) - 1, none, none))).alias("e")).select("e.*")
    places = events.unionByName(asked).groupBy(key, "_at").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    so_far = Window.partitionBy(key).orderBy("_at")
    lines = checkpointed(places.select(key, "_at", (F.col("_at") * F.sum("_n").over(so_far) + F.sum("_s").over(so_far)).alias("_f")))
    upto = lambda at, name: lines.select(F.col(key), F.col("_at").alias(at), F.col("_f").alias(name))
    ends = sound.withColumns({"_to": F.col(z).cast("long"), "_from": F.col(a).cast("long") - 1})
    ends = ends.join(upto("_to", "_g"), [key, "_to"]).join(upto("_from", "_h"), [key, "_from"])
    out = ends.withColumn("_both", F.col("_g") - F.col("_h")).where("_both > 0").select(*intervals.columns, "_both")
    # An interval that ends before it starts meets ranges over both its ends, a range that does meets intervals over both of its.
    bent = intervals.where(F.col(z) < F.col(a))
    if not bent.isEmpty():
        met = stabbed(bent, right, key, z, start, end).where(F.col(end) >= F.col(a))
        out = out.unionByName(met.select(*intervals.columns, least.cast("long").alias("_both")))
    if not odd.isEmpty():
        met = stabbed(odd, intervals, key, start, a, z).where(F.col(end) >= F.col(a))
        out = out.unionByName(met.select(*intervals.columns, least.cast("long").alias("_both")))
    return out
