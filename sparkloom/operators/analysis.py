"""Metrics, dead code, architecture rules, diffs and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import graph
from sparkloom.operators.intervals import overlapped


def all_metrics(symbols: DataFrame, edges: DataFrame, heritage: DataFrame | None = None) -> DataFrame:
    """id, name, complexity, fan_in, fan_out, depth_of_inheritance (distinct ancestors). symbols: id, name, complexity or source."""
    text = C.complexity(F.col("source")) if "source" in symbols.columns else F.lit(1).cast("long")
    own = F.coalesce(F.col("complexity"), text, F.lit(1)) if "complexity" in symbols.columns else F.coalesce(text, F.lit(1))
    s = symbols.select("id", "name", own.cast("long").alias("complexity"))
    # No side here is of a size that may be sent to the driver, though its files may be small.
    out = s.join(graph.degrees(s, edges).hint("merge"), "id")
    if heritage is None:
        return out.withColumn("depth_of_inheritance", F.lit(0).cast("long"))
    depth = graph.ancestor_counts(heritage, s).withColumnRenamed("n", "depth_of_inheritance")
    return out.join(depth.hint("merge"), "id", "left").withColumn("depth_of_inheritance", F.coalesce("depth_of_inheritance", F.lit(0)).cast("long"))


def dead_code(symbols: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """id, name, confidence, reason of the symbols that no entry point reaches."""
    gone = symbols.select("id", "name").join(graph.reachable(edges, entries), "id", "left_anti")
    d = gone.join(graph.degrees(gone, edges).select("id", "fan_in").hint("merge"), "id")
    name = F.col("name")
    confidence = F.when(name.startswith("test_") | name.contains("_test"), 0.5).when(name.startswith("_"), 0.7).when(F.col("fan_in") == 0, 1.0).otherwise(0.8)
    reason = F.when(name.startswith("test_") | name.contains("_test"), "test").when(name.startswith("_"), "private").when(F.col("fan_in") == 0, "no callers").otherwise(F.concat(F.lit("unreachable, callers: "), F.col("fan_in").cast("string")))
    return d.select("id", "name", confidence.alias("confidence"), reason.alias("reason"))


def entry_points(symbols: DataFrame) -> DataFrame:
    """Symbols called main or exported; without any, the first callable one."""
    found = symbols.where("name = 'main' or is_exported").select("id")
    return found if not found.isEmpty() else symbols.where(F.lower("kind").isin("function", "method")).orderBy("id").select("id").limit(1)


def forbidden(edges: DataFrame, name: str, source: str, target: str) -> DataFrame:
    return edges.where(C.glob(F.col("src"), source) & C.glob(F.col("dst"), target)).select(F.lit(name).alias("rule_name"), "src", "dst")


def required(nodes: DataFrame, edges: DataFrame, name: str, source: str, target: str) -> DataFrame:
    """Source nodes without a dependency that matches the target."""
    having = edges.where(C.glob(F.col("dst"), target)).select(F.col("src").alias("id")).distinct()
    return nodes.where(C.glob(F.col("id"), source)).join(having, "id", "left_anti").select(F.lit(name).alias("rule_name"), F.col("id").alias("src"), F.lit(target).alias("dst"))


def layer(edges: DataFrame, name: str, source: str, target: str) -> DataFrame:
    """Edges that run from the lower layer back to the upper one."""
    down = C.glob(F.col("src"), source) & C.glob(F.col("dst"), target)
    up = C.glob(F.col("src"), target) & C.glob(F.col("dst"), source)
    return edges.where(~down & up).select(F.lit(name).alias("rule_name"), "src", "dst")


def check_rules(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Violations of all rules: rule_name, src, dst. One pass over the edges for forbidden and layer rules together, and one
    aggregation by source for all required rules."""
    kinds = {"forbidden": [], "layer": [], "required": []}
    for r in rules:
        kinds[r["rule_type"].lower()].append(r)
    broken = []
    for r in kinds["forbidden"] + kinds["layer"]:
        down = C.glob(F.col("src"), r["source_pattern"]) & C.glob(F.col("dst"), r["target_pattern"])
        up = C.glob(F.col("src"), r["target_pattern"]) & C.glob(F.col("dst"), r["source_pattern"])
        broken.append(F.when(down if r in kinds["forbidden"] else ~down & up, F.lit(r["name"])))
    names = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    out = edges.select(F.explode(names).alias("rule_name"), "src", "dst")
    if not kinds["required"]:
        return out
    has = [F.max(C.glob(F.col("dst"), r["target_pattern"])).alias(f"has{i}") for i, r in enumerate(kinds["required"])]
    met = nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(*has), "id", "left")
    lacks = F.array(*[F.when(C.glob(F.col("id"), r["source_pattern"]) & ~F.coalesce(F.col(f"has{i}"), F.lit(False)), F.struct(F.lit(r["name"]).alias("name"), F.lit(r["target_pattern"]).alias("dst"))) for i, r in enumerate(kinds["required"])])
    missing = met.select("id", F.explode(F.filter(lacks, lambda x: x.isNotNull())).alias("v"))
    return out.unionByName(missing.select(F.col("v.name").alias("rule_name"), F.col("id").alias("src"), F.col("v.dst").alias("dst")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, has_cycle, cycle_count (strong components of two nodes or more)."""
    cycles = graph.strong_components(edges).agg(F.countDistinct("component").alias("cycle_count"))
    counts = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    return counts.crossJoin(cycles).select("node_count", "edge_count", (F.col("cycle_count") > 0).alias("has_cycle"), "cycle_count")


def allowed_layers(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges between different layers (node, layer) that no allowed pair (a, b) permits."""
    e = edges.join(layers.select(F.col("node").alias("src"), F.col("layer").alias("a")), "src").join(layers.select(F.col("node").alias("dst"), F.col("layer").alias("b")), "dst")
    return e.where("a <> b").join(allowed, ["a", "b"], "left_anti")


def parse_hunks(lines: DataFrame) -> DataFrame:
    """file_path, start, end of the new side of every hunk. lines: diff_id, line_no, value."""
    w = Window.partitionBy("diff_id").orderBy("line_no")
    at = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    named = lines.withColumn("file_path", F.last(F.when(F.col("value").rlike(r"^\+\+\+ "), F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(w))
    hunks = named.where(F.col("value").rlike(at)).select("file_path", F.regexp_extract("value", at, 1).cast("long").alias("start"), F.when(F.regexp_extract("value", at, 2) == "", 1).otherwise(F.regexp_extract("value", at, 2).cast("long")).alias("n"))
    return hunks.where("n > 0 and file_path <> '/dev/null'").select("file_path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def affected(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, overlap_ratio: share of a symbol's lines in hunks of its file, at most 1, largest first."""
    s = symbols.select("symbol_id", "file_path", F.col("line").alias("a"), F.col("end_line").alias("z"))
    # Columns with other names than those of symbols, as both sides may be joined.
    h = hunks.select("file_path", F.col("start").alias("_start"), F.col("end").alias("_end"))
    j = overlapped(s, h, "file_path", "a", "z", "_start", "_end")
    shares = j.groupBy("symbol_id").agg(F.least(F.sum("_both") / F.max(F.col("z") - F.col("a") + 1), F.lit(1.0)).alias("overlap_ratio"))
    return shares.orderBy(F.desc("overlap_ratio"), "symbol_id")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, deleted, modified) between two snapshots (path, hash)."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    return j.where("a is null or b is null or a <> b").select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("modified").alias("change"))


def changed_only(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new (path, hash) whose hash is not the stored one."""
    return new.join(stored.select("path", F.col("hash").alias("_old")), "path", "left").where("_old is null or _old <> hash").drop("_old")


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: added, deleted, modified (renamed and type-changed files count as modified) of changes (change)."""
    c = F.col("change")
    return changes.agg(F.count_if(c == "added").alias("added"), F.count_if(c == "deleted").alias("deleted"), F.count_if(c.isin("modified", "renamed", "type_changed")).alias("modified"))


def with_renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_path, change between snapshots (path, hash); a deleted and an added file of equal content are one renamed file."""
    d = snapshot_diff(old, new)
    place = lambda side: Window.partitionBy("hash").orderBy(side)
    gone = d.where("change = 'deleted'").join(old, "path").select(F.col("path").alias("old_path"), "hash").withColumn("n", F.row_number().over(place("old_path")))
    come = d.where("change = 'added'").join(new, "path").select("path", "hash").withColumn("n", F.row_number().over(place("path")))
    moved = come.join(gone, ["hash", "n"]).select("path", "old_path")
    rest = d.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return moved.select("path", "old_path", F.lit("renamed").alias("change")).unionByName(rest.select("path", F.lit(None).cast("string").alias("old_path"), "change"))


def range_map_totals(ranges: DataFrame) -> DataFrame:
    """One row: files, symbols of a range map (file_path, symbol_id)."""
    return ranges.agg(F.countDistinct("file_path").alias("files"), F.count("symbol_id").alias("symbols"))


def debounced(events: DataFrame, millis: int = 500) -> DataFrame:
    """key, batch_start, n: batches that open at their first event and close `millis` later, whatever comes in between.

    events: key, ts. Keys are hash-partitioned and sorted by time, and a task folds its sorted rows one after another, so it
    holds one open batch whatever the number of a key's events.
    """
    kind, key = dict(events.dtypes)["ts"], dict(events.dtypes)["key"]
    timed = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).where("t is not null")

    def run(batches):
        import pyarrow as pa

        known = schema = None
        start = n = 0
        for b in batches:
            schema = pa.schema([("key", b.schema.field(0).type), ("t", pa.int64()), ("n", pa.int64())])
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if known == (k,) and t < start + millis * 1000:
                    n += 1
                    continue
                if known:
                    out.append((known[0], start, n))
                known, start, n = (k,), t, 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((known[0], start, n), schema)], schema=schema)

    folded = timed.repartition("key").sortWithinPartitions("key", "t").mapInArrow(run, f"key {key}, t long, n long")
    return folded.select("key", F.timestamp_micros("t").cast(kind).alias("batch_start"), "n")
