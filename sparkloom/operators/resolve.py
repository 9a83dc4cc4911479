"""From call sites to edges, and from names to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.intervals import stabbed


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the last in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(x) for x in order]))).where("_n = 1").drop("_n")


def keep_best(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def callee_in_file(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites with callee_id: the last symbol of that name in the same file, else the name itself; empty names drop."""
    last = symbols.groupBy("file_path", F.col("name").alias("callee_name")).agg(F.max_by("symbol_id", "ord").alias("found"))
    return sites.where(F.length("callee_name") > 0).join(last, ["file_path", "callee_name"], "left").withColumn("callee_id", F.coalesce("found", "callee_name")).drop("found")


def enclosing(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites with caller_id, a row for each function or method of the file whose lines hold the site."""
    fns = symbols.where(F.lower("kind").isin("function", "method")).select("file_path", F.col("symbol_id").alias("caller_id"), F.col("line").alias("_from"), F.col("end_line").alias("_to"))
    return stabbed(sites, fns, "file_path", "line", "_from", "_to").drop("_from", "_to")


def call_edges(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved edges: sites that know their caller keep it, the others get their enclosing functions."""
    s = callee_in_file(sites, symbols)
    known = s.where("caller_id is not null and caller_id <> ''")
    return known.unionByName(enclosing(s.where("caller_id is null or caller_id = ''").drop("caller_id"), symbols), allowMissingColumns=True)


def resolve_across(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ends that are no known id become the first symbol of that name, or stay as they are."""
    ids = symbols.select(F.col("symbol_id").alias("k"), F.lit(True).alias("known")).distinct()
    names = symbols.groupBy(F.col("name").alias("k")).agg(F.min_by("symbol_id", "ord").alias("by_name"))
    keys = edges.select(F.col("src").alias("k")).union(edges.select("dst")).distinct()
    found = keys.join(ids, "k", "left").join(names, "k", "left").select("k", F.when(F.col("known"), F.col("k")).otherwise(F.coalesce("by_name", "k")).alias("to"))
    out = edges.join(found.withColumnsRenamed({"k": "src", "to": "s"}), "src").join(found.withColumnsRenamed({"k": "dst", "to": "d"}), "dst")
    return out.drop("src", "dst").withColumnsRenamed({"s": "src", "d": "dst"})


def placeholders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for ends that the node table lacks."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.col("id").cast("string").alias("name"), F.lit("unknown").alias("kind"), F.lit("").alias("file_path"))


def batch_resolve(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """ids (pos, id) with their symbols; missing ones are left out, order and repeats stay."""
    return ids.join(symbols, "id")


def lookup(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, symbol_id: the symbol with that id, else the last one of that name, else the key itself."""
    ids = symbols.select(F.col("symbol_id").alias("key"), F.lit(True).alias("known")).distinct()
    names = symbols.groupBy(F.col("name").alias("key")).agg(F.max_by("symbol_id", "ord").alias("by_name"))
    return keys.select("key").join(ids, "key", "left").join(names, "key", "left").select("key", F.when(F.col("known"), F.col("key")).otherwise(F.coalesce("by_name", "key")).alias("symbol_id"))


def located(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """nodes (id, ...) with name, kind and location: file:line, or the file, or ? where the symbol is unknown."""
    s = symbols.select(F.col("symbol_id").alias("id"), "name", "kind", F.coalesce(F.concat_ws(":", "file_path", F.col("line").cast("string")), "file_path").alias("at"))
    return nodes.join(s, "id", "left").withColumn("name", F.coalesce("name", F.col("id").cast("string"))).withColumn("location", F.coalesce("at", F.lit("?"))).drop("at")


#: Call types from the most specific to the least.
SPECIFIC = ("MacroExpansion", "Virtual", "Callback", "Direct", "Unknown")


def distinct_calls(calls: DataFrame) -> DataFrame:
    """One row for each (file_path, callee_name, line): that of the most specific call type, then the first column."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SPECIFIC)), F.col("call_type")), F.lit(0))
    return keep_best(calls.withColumn("_r", F.when(rank == 0, 99).otherwise(rank)), ["file_path", "callee_name", "line"], [F.col("_r"), F.col("col")]).drop("_r")
