"""File trees and snapshots as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import LANGUAGES, extension, language_of

# Folders that are left out unless told otherwise.
EXCLUDES = ["**/node_modules/**", "**/target/**", "**/build/**", "**/dist/**", "**/.git/**", "**/vendor/**"]


def ignore_regex(pattern: str) -> str:
    """Regular expression of an ignore-file line, for paths relative to the root."""
    p = pattern.strip()
    rooted, folder = p.startswith("/"), p.endswith("/")
    body = re.sub(r"\\\*\\\*/", "(?:.*/)?", re.escape(p.strip("/"))).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if rooted or "/" in p.strip("/") else "(?:^|.*/)") + body + ("/.*$" if folder else "(?:/.*)?$")


#: Folders below the root in which ignore files are looked for, by depth.
IGNORE_DEPTH = 4


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(regular expression of relative paths, ignored or taken back) of the .gitignore files, outer folders first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    rules: list[tuple[str, bool]] = []
    for depth in range(IGNORE_DEPTH):
        for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * depth + "/.gitignore")) or ():
            stream = fs.open(s.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            folder = s.getPath().getParent().toUri().getPath()[len(base) :]
            for line in text.splitlines():
                line = line.rstrip()
                if line and not line.startswith("#"):
                    back = line.startswith("!")
                    rule = ignore_regex(line[1:] if back else line)
                    rules.append((f"^{re.escape(folder)}/{rule.removeprefix('^')}" if folder else rule, not back))
    return rules


def crawl(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """file_path (relative), language, content, content_hash, length of the files whose extension is known.

    Left out is what the excludes name and what .gitignore files name (the last matching line decides).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = F.regexp_replace("path", r"^\w+:/*", "/")
    prefix = "/" + re.sub(r"^\w+:/*", "", root).strip("/") + "/"
    files = raw.withColumn("file_path", F.substring(where, len(prefix) + 1, 1 << 20)).where(extension(F.col("path")).isin(*LANGUAGES))
    for pattern in EXCLUDES if excludes is None else excludes:
        files = files.where(~F.col("file_path").rlike(ignore_regex(pattern)))
    ignored = F.lit(False)
    for rule, hides in ignore_rules(spark, root):
        ignored = F.when(F.col("file_path").rlike(rule), F.lit(hides)).otherwise(ignored)
    files = files.where(~ignored)
    return files.select("file_path", language_of(F.col("file_path")).alias("language"), F.expr("try_validate_utf8(cast(content as string))").alias("content"), F.sha2("content", 256).alias("content_hash"), "length")


def git_diff(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """path, old_path, change between two refs, from name-status output."""
    import subprocess

    out = subprocess.run(["git", "-C", repo, "diff", "--name-status", "-z", "--end-of-options", old, new], capture_output=True, text=True, check=True).stdout.split("\0")
    kinds, rows, i = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "T": "type_changed"}, [], 0
    while i < len(out) - 1:
        k = out[i][:1]
        two = k in "RC"
        rows.append((out[i + 1 + two], out[i + 1] if two else None, kinds.get(k, "modified")))
        i += 2 + two
    return spark.createDataFrame(rows, "path string, old_path string, change string")
