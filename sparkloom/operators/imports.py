"""Imports to files: ranked candidates of every import, joined with the paths that exist.

Each import becomes a list of candidate paths by the rules of its language, best first; candidates meet the files in one equi
join, and the best one that exists is the import's file. Relative imports are normalised against their file's folder; package
paths (Java, Kotlin, C includes, Rust crates) match the end of a path, the shortest path first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File endings that an import may leave out.
JS_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def normal(path: Column) -> Column:
    """The path without . and .. segments; .. at the root stays out."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))), "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _rust(file: Column, path: Column) -> Column:
    """Modules of the crate: crate:: from src, self:: and super:: from the file's folder; the last name may be an item."""
    own = F.regexp_replace(F.regexp_replace(file, r"/(mod|lib|main)\.rs$", ""), r"\.rs$", "")
    bare = F.regexp_replace(F.regexp_replace(path, r"\s+as\s+\w+|::\{.*|::\*$", ""), "::", "/")
    base = F.when(bare.startswith("crate/"), F.concat(F.regexp_extract(file, r"^((?:.*/)?src)/", 1), F.lit("/"), F.substring(bare, 7, 4096)))
    base = base.when(bare.startswith("self/"), F.concat(own, F.lit("/"), F.substring(bare, 6, 4096))).when(bare.startswith("super/"), normal(F.concat(own, F.lit("/../"), F.substring(bare, 7, 4096))))
    spots = F.array(base, folder(base))
    return F.flatten(F.transform(spots, lambda b: F.array(F.concat(b, F.lit(".rs")), F.concat(b, F.lit("/mod.rs")))))


def candidates(language: Column, file: Column, path: Column) -> Column:
    """Candidate paths, best first; those that begin with a slash match the end of a path."""
    local = normal(F.concat(folder(file), F.lit("/"), path))
    js = F.when(path.startswith("."), F.transform(F.array(*map(F.lit, JS_ENDINGS)), lambda e: F.concat(local, e)))
    dotted = F.concat(F.lit("/"), F.replace(path, F.lit("."), F.lit("/")))
    java = F.when(~path.endswith("*"), F.array(F.concat(dotted, F.lit(".java")), F.concat(dotted, F.lit(".kt")), F.concat(folder(dotted), F.lit(".java")), F.concat(folder(dotted), F.lit(".kt"))))
    c = F.array(local, F.concat(F.lit("/"), path))
    none = F.array().cast("array<string>")
    found = F.when(language.isin("typescript", "javascript"), js).when(language.isin("java", "kotlin"), java).when(language.isin("c", "cpp"), c).when(language == "rust", F.filter(_rust(file, path), lambda x: x.isNotNull()))
    return F.coalesce(found, none)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file_path, import_path, line) with resolution struct<tag, value>: Resolved to a file of `files` (file_path,
    language), External for packages, Unresolved for relative paths that lead nowhere."""
    keyed = imports.withColumn("_n", F.monotonically_increasing_id()).join(files.select("file_path", "language"), "file_path", "left")
    tried = keyed.select("_n", F.posexplode(candidates(F.col("language"), F.col("file_path"), F.col("import_path"))).alias("rank", "key"))
    parts = F.split("file_path", "/")
    # Every end of a path is a key; paths are short.
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    keys = files.select("file_path", F.explode(F.concat(F.array("file_path"), ends)).alias("key"))
    best = tried.join(keys, "key").groupBy("_n").agg(F.min(F.struct("rank", F.length("file_path").alias("size"), "file_path")).alias("best"))
    relative = F.col("import_path").rlike(r"^(\.|crate::|self::|super::)")
    tag = F.when(F.col("best").isNotNull(), "Resolved").when(relative, "Unresolved").otherwise("External")
    resolution = F.struct(tag.alias("tag"), F.coalesce(F.col("best.file_path"), "import_path").alias("value"))
    return keyed.join(best, "_n", "left").withColumn("resolution", resolution).drop("_n", "best", "language")
