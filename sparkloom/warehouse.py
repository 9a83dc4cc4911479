"""Relations of a source tree as Parquet, with snapshots that appear as a whole.

A commit writes new tables beside the old ones and then one small file that names the table of every relation; readers take
the file with the highest number, so they see all of a commit or nothing, and running reads keep their files. Two writers of
the same number cannot both succeed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import resolve as R
from sparkloom.operators.imports import resolve_imports
from sparkloom.operators.search import Index
from sparkloom.sources.crawl import crawl
from sparkloom.sources.extract import extract

FIELDS = ["name", "signature", "doc_comment"]


class LoomError(Exception):
    """Base of this library's errors."""


class SymbolNotFound(LoomError):
    pass


class QueryError(LoomError):
    pass


class IndexMissing(LoomError):
    pass


class CommitConflict(LoomError):
    pass


class Warehouse:
    """files, symbols, sites (calls as written), edges (resolved), imports, heritage, postings and stats under one path."""

    TABLES = ("files", "symbols", "sites", "edges", "imports", "heritage", "postings", "stats")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict[str, str]:
        """Relation -> folder, of the last commit or of the given one."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise IndexMissing(f"no index under {self.path}" if version is None else f"no commit {version} under {self.path}")
        n = known[-1] if version is None else version
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/commits/{n:010d}.json").collect()))

    def exists(self) -> bool:
        return bool(self.versions())

    def missing(self) -> list[str]:
        """Relations that the last commit lacks; all of them without one."""
        have = self.snapshot() if self.exists() else {}
        return [t for t in self.TABLES if t not in have]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        tables = self.snapshot(version)
        if name not in tables:
            raise IndexMissing(f"the index has no {name}")
        return self.spark.read.parquet(f"{self.path}/{tables[name]}")

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Written tables that no snapshot names yet: relation -> folder."""
        folders = {name: f"data/{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folders[name]}")
        return folders

    def staged(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def commit(self, tables: dict[str, DataFrame | str], removed: tuple[str, ...] = ()) -> int:
        """Put (tables, or folders that are staged) and remove relations in one step; the others stay. The new snapshot's number."""
        known = self.versions()
        now = {k: v for k, v in (self.snapshot().items() if known else ()) if k not in removed}
        number = known[-1] + 1 if known else 0
        now |= self.stage({k: v for k, v in tables.items() if not isinstance(v, str)}) | {k: v for k, v in tables.items() if isinstance(v, str)}
        target, fs = self._fs(f"{self.path}/commits/{number:010d}.json")
        part, _ = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(now), "utf-8"))
        out.close()
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise CommitConflict(f"another writer has made commit {number}")
        return number

    def vacuum(self) -> int:
        """Delete tables that only older snapshots name; the number of folders deleted."""
        keep = {v.rpartition("/")[2] for v in self.snapshot().values()}
        p, fs = self._fs(f"{self.path}/data")
        gone = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName() not in keep]
        for x in gone:
            fs.delete(x, True)
        for n in self.versions()[:-1]:
            fs.delete(self._fs(f"{self.path}/commits/{n:010d}.json")[0], False)
        return len(gone)

    def _parsed(self, files: DataFrame) -> dict[str, DataFrame]:
        """Relations of the given files alone, before names are resolved."""
        found = extract(files.select("file_path", "content")).persist()
        ids = C.stable_id(F.col("language"), F.col("file_path"), F.lower("kind"), F.col("name"))
        symbols = found.where("record = 'symbol'").withColumn("symbol_id", ids).drop("record")
        counts = symbols.groupBy("file_path").agg(F.count("*").alias("symbol_count"))
        sites = found.where("record = 'call'").select("file_path", F.lit(None).cast("string").alias("caller_id"), F.col("name").alias("callee_name"), "line", "col", F.col("kind").alias("call_type"), F.lit(0.9).alias("confidence"))
        return {
            "found": found,
            "files": files.drop("content").join(counts, "file_path", "left").fillna(0, ["symbol_count"]).withColumn("indexed_at", F.current_timestamp()),
            "symbols": symbols,
            "sites": R.distinct_calls(sites),
            "imports": found.where("record = 'import'").select("file_path", F.col("name").alias("import_path"), "line"),
            "heritage": found.where("record = 'heritage'").select("file_path", F.col("name").alias("child"), "parent", F.col("kind").alias("relation")),
        }

    def _with_derived(self, folders: dict[str, str]) -> dict:
        """Staged relations, and what depends on more than one file: resolved edges and imports, the search index."""
        symbols, sites = self.staged(folders["symbols"]), self.staged(folders["sites"])
        edges = R.call_edges(sites, symbols).withColumnsRenamed({"caller_id": "src", "callee_id": "dst"}).select("src", "dst", "file_path", "line", "call_type", "confidence")
        index = Index.of(symbols.withColumn("id", F.col("symbol_id")), FIELDS)
        return folders | {
            "edges": R.resolve_across(edges, symbols.withColumn("ord", F.struct("file_path", "ord"))),
            "imports": resolve_imports(self.staged(folders["imports"]), self.staged(folders["files"])),
            "postings": index.postings.repartition("term").sortWithinPartitions("term"),
            "stats": index.stats,
        }

    def _stats(self, found: DataFrame, version: int) -> dict:
        counts = {r.record: r.n for r in found.groupBy("record").agg(F.count("*").alias("n")).collect()}
        failed = [r.file_path for r in found.where("record = 'failed'").select("file_path").limit(1000).collect()]
        return {"files_scanned": self.read("files").count(), "symbols_found": counts.get("symbol", 0), "calls_found": counts.get("call", 0), "imports_found": counts.get("import", 0), "failed_files": failed, "version": version}

    def build(self, root: str, excludes: list[str] | None = None) -> dict:
        """Crawl, extract, resolve and commit all relations; statistics of the run."""
        parts = self._parsed(crawl(self.spark, root, excludes))
        found = parts.pop("found")
        version = self.commit(self._with_derived(self.stage(parts)))
        stats = self._stats(found, version)
        found.unpersist()
        return stats

    def reindex(self, root: str, file_paths: list[str] | None = None, excludes: list[str] | None = None) -> dict:
        """Only files whose content has changed are parsed; rows of changed and of removed files are replaced by file.

        file_paths: look at these alone. Names are resolved again over all relations, as any file may refer to a changed one.
        """
        if not self.exists():
            return self.build(root, excludes) | {"changed": None, "removed": None}
        files, known = crawl(self.spark, root, excludes), self.read("files")
        chosen = (lambda df: df) if file_paths is None else (lambda df: df.where(F.col("file_path").isin(file_paths)))
        changed = chosen(files).join(known.select("file_path", F.col("content_hash").alias("_old")), "file_path", "left").where("_old is null or _old <> content_hash").drop("_old")
        removed = chosen(known).join(files.select("file_path"), "file_path", "left_anti").select("file_path")
        parts = self._parsed(changed)
        found = parts.pop("found")
        gone = changed.select("file_path").union(removed).distinct().persist()
        n_changed, n_removed = changed.count(), removed.count()
        version = self.versions()[-1]
        if n_changed or n_removed:
            old = {k: self.read(k) if k != "imports" else self.read(k).drop("resolution") for k in parts}
            merged = {k: old[k].join(gone, "file_path", "left_anti").unionByName(v) for k, v in parts.items()}
            version = self.commit(self._with_derived(self.stage(merged)))
        stats = self._stats(found, version) | {"changed": n_changed, "removed": n_removed}
        found.unpersist()
        gone.unpersist()
        return stats
