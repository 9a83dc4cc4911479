"""The seventeen tools over a warehouse, each with a response envelope, and page tokens."""

from __future__ import annotations

import base64
import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.config import Config
from sparkloom.functions import columns as C
from sparkloom.operators import analysis as A
from sparkloom.operators import graph as G
from sparkloom.operators import resolve as R
from sparkloom.operators import search as S
from sparkloom.warehouse import CommitConflict, IndexMissing, LoomError, QueryError, SymbolNotFound, Warehouse  # noqa: F401

SCHEMA_VERSION = 3


@dataclass
class Envelope:
    request_id: str
    status: str
    data: object = None
    warnings: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def warn(self, text: str) -> Envelope:
        self.warnings.append(text)
        self.status = "Partial" if self.status == "Success" else self.status
        return self

    def to_json(self, rows: int = 10_000) -> str:
        """The envelope as JSON text; tables become lists of at most `rows` objects."""

        def plain(x):
            if isinstance(x, DataFrame):
                return [json.loads(r) for r in x.limit(rows).toJSON().collect()]
            return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

        return json.dumps({"request_id": self.request_id, "status": self.status, "data": plain(self.data), "warnings": self.warnings, "meta": self.meta}, indent=2, default=str)


def page_token(query: dict, offset: int) -> str:
    """Where a listing goes on, tied to the query that it lists."""
    return base64.urlsafe_b64encode(json.dumps({"query_hash": _query_hash(query), "offset": offset}).encode()).decode()


def _query_hash(query: dict) -> str:
    return hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()[:16]


def offset_of(token: str, query: dict) -> int:
    try:
        found = json.loads(base64.urlsafe_b64decode(token))
        offset = int(found["offset"])
    except (ValueError, KeyError, TypeError) as x:
        raise QueryError("the page token cannot be read") from x
    if found.get("query_hash") != _query_hash(query) or offset < 0:
        raise QueryError("the page token belongs to another query")
    return offset


class Tools:
    """Every method answers with an Envelope whose data is a DataFrame or a dict of plain values and DataFrames."""

    def __init__(self, warehouse: Warehouse, config: Config | None = None):
        self.w, self.config = warehouse, config or Config()

    def _answer(self, work) -> Envelope:
        began, e = time.time(), Envelope(str(uuid.uuid4()), "Success")
        try:
            e.data = work(e)
        except (LoomError, ValueError) as x:
            e.status, e.warnings = "Error", [str(x)]
        e.meta |= {"took_ms": int(1000 * (time.time() - began))}
        return e

    def _edges(self) -> DataFrame:
        return self.w.read("edges").select("src", "dst")

    def _symbol(self, symbol_id: str) -> DataFrame:
        found = self.w.read("symbols").where(F.col("symbol_id") == symbol_id).limit(1)
        if found.isEmpty():
            raise SymbolNotFound(symbol_id)
        return found

    def resolve(self, text: str) -> str:
        """A symbol's id from what a user types: the id itself, else the best hit by name, else the text."""
        symbols = self.w.read("symbols")
        if not symbols.where(F.col("symbol_id") == text).isEmpty():
            return text
        terms = S.terms_of(text)
        best = S.top(S.bm25(self._index(), text, {"name": 1.0}), 1).first() if terms else None
        return best.id if best else text

    def _seed(self, symbol_id: str) -> DataFrame:
        return self._symbol(symbol_id).select(F.col("symbol_id").alias("id"))

    def _index(self) -> S.Index:
        return S.Index(self.w.read("postings"), self.w.read("stats"))

    def _ranked(self, scored: DataFrame, k: int, language=None, kind=None) -> DataFrame:
        """The k best symbols; language and kind are filtered before the limit."""
        s = self.w.read("symbols").withColumn("id", F.col("symbol_id"))
        s = s if language is None else s.where(F.col("language") == language)
        s = s if kind is None else s.where(F.lower("kind") == kind.lower())
        return s.join(scored, "id").orderBy(F.desc("score"), "id").limit(k)

    def search_symbol(self, query: str, kind=None, language=None, limit: int | None = None) -> Envelope:
        k = min(self.config.search.limit if limit is None else limit, 100)
        ids = lambda: self.w.read("symbols").select(F.col("symbol_id").alias("id"))
        return self._answer(lambda e: self._ranked(S.search(self._index(), query, "name", ids()), k, language, kind))

    def semantic_search(self, description: str, limit: int = 10, language=None) -> Envelope:
        c = self.config.search
        weights = {"name": c.name_weight, "signature": c.signature_weight, "doc_comment": c.doc_weight}
        return self._answer(lambda e: self._ranked(S.bm25(self._index(), description, weights), min(limit, 50), language))

    def get_symbol(self, symbol_id: str) -> Envelope:
        return self._answer(lambda e: self._symbol(symbol_id))

    def get_file_symbols(self, file_path: str) -> Envelope:
        def work(e):
            found = self.w.read("symbols").where(F.col("file_path") == file_path).limit(10_000)
            if found.isEmpty():
                raise SymbolNotFound(file_path)
            return found

        return self._answer(work)

    def _nodes(self, found: DataFrame, outgoing: bool) -> DataFrame:
        """symbol_id, name, kind, depth, call_type, location of traced nodes; call_type is that of an edge that leads there."""
        e = self.w.read("edges").groupBy(F.col("dst" if outgoing else "src").alias("id")).agg(F.min("call_type").alias("call_type"))
        named = R.located(found.join(e, "id", "left"), self.w.read("symbols"))
        return named.select(F.col("id").alias("symbol_id"), "name", "kind", "depth", C.call_tag(F.col("call_type")).alias("call_type"), "location").orderBy("depth", "symbol_id")

    def _traced(self, symbol_id: str, depth: int | None, outgoing: bool) -> tuple[DataFrame, int]:
        edges = self._edges() if outgoing else G.reverse(self._edges())
        found = G.trace(edges, self._seed(symbol_id), depth).select("id", "depth").persist()
        return self._nodes(found, outgoing), found.count()

    def trace_callers(self, symbol_id: str, max_depth: int = 3, include_indirect: bool = True) -> Envelope:
        def work(e):
            callers, n = self._traced(symbol_id, max_depth if include_indirect else min(max_depth, 1), False)
            return {"target": symbol_id, "callers": callers, "total_callers": n}

        return self._answer(work)

    def trace_callees(self, symbol_id: str, max_depth: int = 3) -> Envelope:
        def work(e):
            callees, n = self._traced(symbol_id, max_depth, True)
            return {"source": symbol_id, "callees": callees, "total_callees": n}

        return self._answer(work)

    def find_references(self, symbol_id: str, limit: int = 50) -> Envelope:
        def work(e):
            found, n = self._traced(symbol_id, 10, False)
            if n > limit:
                e.warn(f"{n - limit} references are not shown")
            return {"target": symbol_id, "references": found.limit(limit), "total_references": n}

        return self._answer(work)

    def get_call_graph(self, symbol_id: str, caller_depth: int = 2, callee_depth: int = 2) -> Envelope:
        def work(e):
            callers, a = self._traced(symbol_id, caller_depth, False)
            callees, b = self._traced(symbol_id, callee_depth, True)
            return {"center": symbol_id, "callers": callers, "callees": callees, "total_nodes": a + b + 1}

        return self._answer(work)

    def analyze_impact(self, symbol_ids: list[str], max_depth: int = 5) -> Envelope:
        def work(e):
            changed = self.w.spark.createDataFrame(list(zip(symbol_ids, range(len(symbol_ids)))), "id string, ord int")
            found = G.impact(self._edges(), changed, max_depth).persist()
            named = R.located(found, self.w.read("symbols")).withColumnRenamed("id", "symbol_id").orderBy("distance", "symbol_id")
            part = lambda level: named.where(F.col("level") == level).drop("level")
            return {"changed_symbols": symbol_ids, "direct_impacts": part("direct"), "transitive_impacts": part("transitive"), "total_affected": found.select("id").distinct().count(), "max_depth": max_depth}

        return self._answer(work)

    def _hierarchy(self) -> DataFrame:
        """Heritage by name to symbol ids, by the smallest id of that name."""
        by_name = self.w.read("symbols").where(F.lower("kind").isin(*G.TYPE_KINDS)).groupBy("name").agg(F.min("symbol_id").alias("id"))
        h = self.w.read("heritage")
        return h.join(by_name.withColumnsRenamed({"name": "child", "id": "src"}), "child").join(by_name.withColumnsRenamed({"name": "parent", "id": "dst"}), "parent").select("src", "dst", "relation")

    def get_type_hierarchy(self, symbol_id: str, direction: str = "both") -> Envelope:
        def work(e):
            if direction not in ("ancestors", "descendants", "both"):
                raise QueryError(f"unknown direction {direction}")
            h, seed, symbols = self._hierarchy(), self._seed(symbol_id), self.w.read("symbols")
            found = {k: f for k, f in (("ancestors", G.ancestors), ("descendants", G.descendants)) if direction in (k, "both")}
            shown = {k: R.located(f(h, seed).select("id", "depth"), symbols).withColumnRenamed("id", "symbol_id") for k, f in found.items()}
            n = h.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("types")).first()
            return {"target": symbol_id, "ancestors": None, "descendants": None} | shown | {"graph_stats": {"edge_count": n.edges, "subtype_count": n.types}}

        return self._answer(work)

    def get_metrics(self, symbol_id=None, file_path=None, metric_types=None) -> Envelope:
        def work(e):
            s = self.w.read("symbols")
            s = s.where(F.col("file_path") == file_path) if file_path else s.where(F.col("symbol_id") == symbol_id) if symbol_id else s
            if s.isEmpty():
                raise SymbolNotFound(file_path or symbol_id or "the index is empty")
            m = A.all_metrics(s.select(F.col("symbol_id").alias("id"), "name", "complexity"), self._edges(), self._hierarchy())
            if file_path or symbol_id:
                return m.select("id", "name", *metric_types) if metric_types else m
            c, limits = F.col("complexity"), self.config.metrics
            r = m.agg(F.count("*").alias("total_symbols"), F.round(F.avg(c), 3).alias("mean_complexity"), F.max(c).alias("max_complexity"), F.count_if(c > limits.complexity_warning).alias("warnings"), F.count_if(c > limits.complexity_error).alias("errors")).first()
            return r.asDict() | {"most_complex": m.orderBy(F.desc("complexity"), "id").limit(10)}

        return self._answer(work)

    def detect_dead_code(self, entry_points=None) -> Envelope:
        def work(e):
            names = list(entry_points or self.config.metrics.entry_points)
            s = self.w.read("symbols").where(F.lower("kind").isin("function", "method")).select(F.col("symbol_id").alias("id"), "name", "kind", "is_exported")
            entries = s.where(F.col("name").isin(*names) | F.col("id").isin(*names))
            if entries.isEmpty():
                e.warn("no entry point is a symbol: main, exported symbols or the first function stand for them")
                entries = A.entry_points(s)
            found = A.dead_code(s, self._edges(), entries.select("id")).persist()
            shown = found.orderBy(F.desc("confidence"), "id").withColumn("label", C.confidence_label(F.col("confidence")))
            return {"entry_points": names, "total_symbols": s.count(), "dead_code_count": found.count(), "dead_entries": shown}

        return self._answer(work)

    def _files_graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of file dependencies."""
        e = G.dependency_graph(self.w.read("imports"))
        return e.select(F.col("src").alias("id")).union(e.select("dst")).union(self.w.read("files").select("file_path")).distinct(), e

    def check_arch_rules(self, rules: list[dict] | None = None, rule_names=None) -> Envelope:
        def work(e):
            known = self.config.rules if rules is None else rules
            chosen = [r for r in known if not rule_names or r["name"] in rule_names]
            if rule_names and (missing := set(rule_names) - {r["name"] for r in known}):
                e.warn(f"unknown rules: {', '.join(sorted(missing))}")
            nodes, edges = self._files_graph()
            found = A.check_rules(nodes, edges.select("src", "dst"), chosen).persist()
            stats = A.graph_stats(nodes, edges.select("src", "dst")).first().asDict()
            return {"status": "failed" if found.count() else "passed", "rules_checked": len(chosen), "graph_stats": stats, "violations": found}

        return self._answer(work)

    def get_dependency_graph(self, level: str = "file", file_path=None) -> Envelope:
        def work(e):
            _, files = self._files_graph()
            if level == "symbol":
                edges = G.symbol_graph(self._edges(), self._edges().limit(0))
            elif level == "module":
                p = files.select(F.col("src").alias("file")).union(files.select("dst")).distinct().withColumn("package", F.coalesce(C.package_of(F.col("file")), F.lit("")))
                edges = G.module_graph(files, p).withColumn("edge_type", F.lit("import"))
            elif level == "file":
                edges = G.ego_net(files, file_path) if file_path else files
            else:
                raise QueryError(f"unknown level {level}")
            edges = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", "count").persist()
            nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
            return {"level": level, "nodes": nodes, "edges": edges, "total_nodes": nodes.count(), "total_edges": edges.count()}

        return self._answer(work)

    def list_files(self, language=None, limit: int = 100, offset: int = 0, page: str | None = None) -> Envelope:
        """A page of files; meta has the token of the next one while there is one."""

        def work(e):
            query = {"tool": "list_files", "language": language, "limit": limit}
            start = offset_of(page, query) if page else offset
            f = self.w.read("files")
            f = f if language is None else f.where(F.col("language") == language)
            total = f.count()
            e.meta |= {"total": total, "returned": max(0, min(limit, total - start))}
            if start + limit < total:
                e.meta["next_page"] = page_token(query, start + limit)
            return f.orderBy("file_path").offset(start).limit(limit)

        return self._answer(work)

    def get_index_status(self, verbose: bool = False) -> Envelope:
        def work(e):
            if not self.w.exists():
                return {"status": "empty", "schema_version": SCHEMA_VERSION}
            out = {"symbols": self.w.read("symbols").count(), "edges": self.w.read("edges").count(), "files": self.w.read("files").count(), "schema_version": SCHEMA_VERSION, "snapshot": self.w.versions()[-1]}
            out["status"] = "ready" if out["symbols"] else "empty"
            if verbose:
                counts = self.w.read("files").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").collect()
                out["language_distribution"] = {r.language: r.n for r in counts}
            return out

        return self._answer(work)

    def reindex(self, root: str, full: bool = False, file_paths: list[str] | None = None) -> Envelope:
        excludes = self.config.index.excludes or None

        def work(e):
            stats = self.w.build(root, excludes) if full else self.w.reindex(root, file_paths, excludes)
            if stats["failed_files"]:
                e.warn(f"{len(stats['failed_files'])} files could not be read")
            return {"status": "completed", "mode": "full" if full else "incremental", "stats": stats}

        return self._answer(work)
