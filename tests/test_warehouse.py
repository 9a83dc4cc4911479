"""An index over a tree that is edited and deleted from; tools, command line, settings, watching."""

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.api import QueryError, Tools, offset_of, page_token
from sparkloom.config import Config, load
from sparkloom.sources.crawl import crawl, git_diff
from sparkloom.sources.extract import records, register, registered
from sparkloom.streaming import watch
from sparkloom.warehouse import CommitConflict, IndexMissing, Warehouse

TREE = {
    "src/main.rs": "use crate::till::Till;\n/// Where it all begins.\nfn main() {\n    serve();\n}\nfn serve() {\n    count();\n}\nfn count() {}\nfn forgotten() {}\n",
    "src/till.rs": "pub struct Till;\nimpl Drop for Till {\n    fn drop(&mut self) { close(); }\n}\nfn close() {}\n",
    "web/a.ts": "import { b } from './b';\nexport interface Shape {}\nexport class Round implements Shape {}\nexport class Ball extends Round {}\nexport function roll() { return b(); }\n",
    "web/b.ts": "import { roll } from './a';\nexport function b() { return 1; }\n",
    "web/skip.min.js": "function hidden() {}\n",
    "target/built.rs": "fn built() {}\n",
    ".gitignore": "*.min.js\n!keep.min.js\n",
}


def put(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture
def project(tmp_path):
    put(tmp_path, TREE)
    return tmp_path


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_build_edit_delete(spark, project):
    w = Warehouse(spark, str(project / ".index"))
    assert w.missing() == list(Warehouse.TABLES) and Tools(w).get_symbol("x").status == "Error"
    with pytest.raises(IndexMissing):
        w.read("symbols")
    first = w.build(str(project))
    assert first["files_scanned"] == 4 and first["failed_files"] == [] and w.missing() == []
    symbols = w.read("symbols")
    assert "hidden" not in names(symbols) and "built" not in names(symbols)
    assert symbols.where("name = 'main'").first().doc_comment == "Where it all begins."
    links = {(r.file_path, r.resolution.value) for r in w.read("imports").where("resolution.tag = 'Resolved'").collect()}
    assert links == {("src/main.rs", "src/till.rs"), ("web/a.ts", "web/b.ts"), ("web/b.ts", "web/a.ts")}

    again = w.reindex(str(project))
    assert (again["changed"], again["removed"], again["version"]) == (0, 0, first["version"])

    put(project, {"src/main.rs": TREE["src/main.rs"].replace("count();", "renamed();").replace("fn count", "fn renamed")})
    os.remove(project / "web/b.ts")
    put(project, {"web/c.ts": "export function extra() { return 2; }\n"})
    partial = w.reindex(str(project), ["web/c.ts"])
    assert (partial["changed"], partial["removed"]) == (1, 0) and "extra" in names(w.read("symbols")) and "count" in names(w.read("symbols"))
    now = w.reindex(str(project))
    assert (now["changed"], now["removed"]) == (1, 1)
    fresh = Warehouse(spark, str(project / ".other"))
    fresh.build(str(project))
    for table in Warehouse.TABLES:
        cols = [c for c in fresh.read(table).columns if c not in ("indexed_at", "resolution", "places")]
        key = lambda x: repr(tuple(x))
        assert sorted(map(key, w.read(table).select(*cols).collect())) == sorted(map(key, fresh.read(table).select(*cols).collect())), table
    assert names(w.read("symbols", first["version"]).where("file_path = 'web/b.ts'")) == ["b"]  # older snapshots stay readable
    assert w.vacuum() > 0 and names(w.read("files"), "file_path") == ["src/main.rs", "src/till.rs", "web/a.ts", "web/c.ts"]


def test_commits_are_whole_and_exclusive(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.commit({"files": spark.range(3), "symbols": spark.range(2)})
    before = w.read("files")
    w.commit({"files": spark.range(5)}, removed=("symbols",))
    assert (before.count(), w.read("files").count(), w.missing()[0]) == (3, 5, "symbols")
    late = Warehouse(spark, str(tmp_path / "w"))
    late.versions = lambda: [0]
    late.snapshot = lambda version=None: {}
    with pytest.raises(CommitConflict):
        late.commit({"files": spark.range(1)})
    assert w.read("files").count() == 5


def test_tools(spark, project):
    w = Warehouse(spark, str(project / ".index"))
    w.build(str(project))
    t = Tools(w)
    by_name = {r.name: r.symbol_id for r in w.read("symbols").collect()}
    callees = t.trace_callees(by_name["main"]).data
    assert callees["total_callees"] == 2 and [(r.name, r.depth, r.call_type, r.location) for r in callees["callees"].collect()] == [("serve", 1, "direct", "src/main.rs:6"), ("count", 2, "direct", "src/main.rs:9")]
    assert [r.name for r in t.trace_callers(by_name["count"], include_indirect=False).data["callers"].collect()] == ["serve"]
    assert t.get_call_graph(by_name["serve"]).data["total_nodes"] == 3
    refs = t.find_references(by_name["count"], limit=1)
    assert refs.status == "Partial" and refs.data["total_references"] == 2 and refs.data["references"].count() == 1
    impact = t.analyze_impact([by_name["count"]]).data
    assert names(impact["direct_impacts"]) == ["serve"] and names(impact["transitive_impacts"]) == ["main"] and impact["total_affected"] == 2
    dead = t.detect_dead_code().data
    assert {"forgotten", "close", "roll"} <= set(names(dead["dead_entries"])) and dead["dead_code_count"] == dead["dead_entries"].count()
    assert t.detect_dead_code(["no such"]).status == "Partial"
    up = t.get_type_hierarchy(by_name["Ball"]).data
    assert names(up["ancestors"]) == ["Round", "Shape"] and names(up["descendants"]) == []
    assert names(t.search_symbol("roll OR serve").data) == ["roll", "serve"] and names(t.search_symbol("*", kind="class").data) == ["Ball", "Round"]
    assert t.search_symbol("roll AND").status == "Error"
    assert names(t.semantic_search("begins").data) == ["main"]
    assert names(t.get_file_symbols("web/b.ts").data) == ["b"] and t.get_file_symbols("no").status == "Error"
    assert t.get_metrics().data["total_symbols"] == w.read("symbols").count() and t.get_metrics(file_path="web/b.ts").data.count() == 1
    rules = [{"name": "web", "rule_type": "forbidden", "source_pattern": "web/a*", "target_pattern": "web/b*"}, {"name": "rust", "rule_type": "forbidden", "source_pattern": "src/*", "target_pattern": "web/*"}]
    checked = t.check_arch_rules(rules).data
    assert checked["status"] == "failed" and names(checked["violations"], "rule_name") == ["web"]
    assert checked["graph_stats"] == {"node_count": 4, "edge_count": 3, "has_cycle": True, "cycle_count": 1}
    assert t.check_arch_rules(rules, ["rust"]).data["status"] == "passed" and t.check_arch_rules(rules, ["none"]).status == "Partial"
    graph = t.get_dependency_graph().data
    assert (graph["total_nodes"], graph["total_edges"]) == (4, 3) and t.get_dependency_graph("module").data["total_nodes"] >= 1
    assert t.get_dependency_graph("planet").status == "Error"
    page = t.list_files(limit=3)
    rest = t.list_files(limit=3, page=page.meta["next_page"])
    assert names(page.data, "file_path") + names(rest.data, "file_path") == ["src/main.rs", "src/till.rs", "web/a.ts", "web/b.ts"] and "next_page" not in rest.meta
    assert t.list_files(limit=2, page=page.meta["next_page"]).status == "Error"
    assert t.get_index_status(True).data["language_distribution"] == {"rust": 2, "typescript": 2}
    assert t.reindex(str(project)).data["mode"] == "incremental"
    assert json.loads(refs.to_json())["data"]["references"][0]["name"] == "serve"
    assert (t.resolve(by_name["roll"]), t.resolve("roll"), t.resolve("nowhere")) == (by_name["roll"], by_name["roll"], "nowhere")


def test_page_tokens():
    token = page_token({"a": 1}, 40)
    assert offset_of(token, {"a": 1}) == 40
    for bad in ("%%", token[:-4], page_token({"a": 2}, 40), page_token({"a": 1}, -1)):
        with pytest.raises(QueryError):
            offset_of(bad, {"a": 1})


def test_command_line(spark, project):
    def run(*args):
        out = io.StringIO()
        code = cli.main(["-p", str(project), *args], spark, out)
        return code, out.getvalue()

    (project / "sparkloom.toml").write_text('[metrics]\nentry_points = ["roll"]\n[[rules]]\nname = "r"\nrule_type = "forbidden"\nsource_pattern = "web/*"\ntarget_pattern = "web/*"\n')
    assert run("search", "main")[0] == 1
    assert run("index", "-f")[0] == 0 and run("index")[0] == 0
    assert json.loads(run("search", "main")[1])["data"][0]["name"] == "main"
    assert run("check-rules")[0] == 1 and json.loads(run("status", "-v")[1])["data"]["files"] == 4
    assert json.loads(run("call-graph", "serve")[1])["data"]["total_nodes"] == 3
    assert json.loads(run("references", "count")[1])["data"]["total_references"] == 2
    assert json.loads(run("analyze", "deadcode")[1])["data"]["entry_points"] == ["roll"]
    tools = Tools(Warehouse(spark, str(project / ".sparkloom/index")))
    assert cli.served(tools, '{"tool": "get_index_status"}').status == "Success"
    for bad in ("{", "{}", '{"tool": "_edges"}', '{"tool": "get_symbol"}', '{"tool": "w"}'):
        assert cli.served(tools, bad).status == "Error"


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    assert load(str(tmp_path)) == Config()
    (tmp_path / "home/sparkloom").mkdir(parents=True)
    (tmp_path / "home/sparkloom/sparkloom.toml").write_text("[search]\nlimit = 7\nname_weight = 2\n")
    (tmp_path / "sparkloom.toml").write_text("[search]\nlimit = 9\n")
    assert (load(str(tmp_path)).search.limit, load(str(tmp_path)).search.name_weight) == (9, 2)
    for bad in ("[search]\nlimits = 1\n", "[search]\nlimit = 'x'\n", "[[rules]]\nname = 'r'\n"):
        (tmp_path / "sparkloom.toml").write_text(bad)
        with pytest.raises(ValueError):
            load(str(tmp_path))


def test_a_language_can_be_registered(spark):
    register("tiny", "c", [("Function", r"def\s+(?P<name>\w+)")], r"load\s+(\w+)", ["tiny"])
    assert "tiny" in registered()
    assert [(r["record"], r["name"]) for r in records("x.tiny", "load y\ndef go { stop(); }\n")] == [("import", "y"), ("symbol", "go"), ("call", "stop")]
    with pytest.raises(ValueError):
        register("bad", "c", [("Function", r"def (\w+)")], "x", [])


def test_crawl_and_git(spark, project):
    import subprocess

    assert names(crawl(spark, str(project), []), "file_path") == ["src/main.rs", "src/till.rs", "target/built.rs", "web/a.ts", "web/b.ts"]
    git = lambda *a: subprocess.run(["git", "-C", str(project), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    os.remove(project / "web/b.ts")
    put(project, {"web/a.ts": "let a = 1;\n", "web/n.ts": "let n = 1;\n"})
    git("add", "-A")
    git("commit", "-qm", "two")
    got = {(r.path, r.change) for r in git_diff(spark, str(project), "HEAD~1", "HEAD").collect()}
    assert got == {("web/a.ts", "modified"), ("web/b.ts", "deleted"), ("web/n.ts", "added")}


def test_folding_is_anchored_at_the_first_event():
    assert watch.folded([(30, "b"), (10, "a"), (14, "a")], None, [], 10) == ([(10, ["a"])], 30, ["b"])
    assert watch.folded([(12, "c")], 5, ["a"], 10) == ([], 5, ["a", "c"])
    assert watch.folded([], None, [], 10) == ([], None, [])


def test_watching(spark, project, tmp_path):
    w = Warehouse(spark, str(project / ".index"))
    events = tmp_path / "events"
    events.mkdir()

    def tell(n, *rows):
        (events / f".{n}.json").write_text("".join(json.dumps({"root": "r", "path": p, "kind": k, "ts": f"2024-01-01T00:00:{s:06.3f}"}) + "\n" for p, k, s in rows))
        os.rename(events / f".{n}.json", events / f"{n}.json")
        time.sleep(0.05)

    def stream():
        s = spark.readStream.schema("root string, path string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(events))
        return watch.batches(watch.watched(s, ["web/"]).select("root", "path", "ts"), 500, "1 second")

    tell(1, ("src/main.rs", "modify", 1.0), ("src/till.rs", "Modify", 1.2), ("src/main.rs", "modify", 1.4), ("web/a.ts", "modify", 1.1), ("notes.md", "create", 1.1), ("src/x.rs", "access", 1.1))
    tell(2, ("src/late.rs", "create", 1.6))
    tell(3, ("src/far.rs", "remove", 50.0))
    with pytest.raises(IndexMissing):
        watch.keep_indexed(stream(), w, str(project), str(tmp_path / "c0"))
    w.build(str(project))
    seen = []

    def apply(paths):
        seen.append(sorted(paths))
        if len(seen) == 1:
            raise RuntimeError("the loop goes on")

    q = watch.keep_indexed(stream(), w, str(project), str(tmp_path / "c1"), apply, availableNow=True)
    q.awaitTermination(120)
    assert sorted(p for batch in seen for p in batch) == ["src/late.rs", "src/main.rs", "src/till.rs"]

    put(project, {"src/late.rs": "fn late() {}\n"})
    q = watch.keep_indexed(stream(), w, str(project), str(tmp_path / "c2"), availableNow=True)
    q.awaitTermination(120)
    assert "late" in names(w.read("symbols"))
    stored = w.read("files").select("file_path", "content_hash")
    assert watch.skip_unchanged(stored, stored).count() == 0 and watch.skip_unchanged(stored, stored.limit(1)).count() == stored.count() - 1


def test_polled_files(spark, project):
    s, trigger = watch.stream_files(spark, str(project / "src"))
    assert s.isStreaming and trigger == {"processingTime": "2 seconds"}
    assert s.select(F.col("path")).columns == ["path"]
