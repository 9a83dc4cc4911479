"""The library's operators as named queries over the driver's tables, each with the same question in SQL.

Relations are derived from the tables by expressions both engines have: symbols from part, call edges from lineitem (parts that
follow one another in an order), cyclic and acyclic graphs from supplier, documents and pages for text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import analysis as A
from sparkloom.operators import graph as G
from sparkloom.operators import resolve as R
from sparkloom.operators import search as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def symbols(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("language"), F.lower("p_type").alias("kind"), F.col("p_size").cast("long").alias("complexity"))


def edges(spark, sf) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_orderkey").alias("line"))
    return e.where("dst is not null")


ALL = "e as (select src, dst, line from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as dst, l_orderkey as line from lineitem) where dst is not null)"
SYMBOLS = "s as (select p_partkey as id, p_name as name, p_brand as language, lower(p_type) as kind, cast(p_size as bigint) as complexity from part)"


def first_source(e: DataFrame) -> DataFrame:
    return e.agg(F.min("src").alias("id"))


def ring(spark, sf, a: int = 7, b: int = 3) -> DataFrame:
    s = table(spark, sf, "supplier")
    n = s.agg(F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), F.pmod(F.col("s_suppkey") * a + b, F.col("n")).alias("dst"))


RING = "r as (select s_suppkey as src, (s_suppkey * {} + {}) % (select count(*) from supplier) as dst from supplier)"


def tree(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))


TREE = "t as (select s_suppkey as src, s_suppkey // 2 as dst from supplier where s_suppkey > 0)"


@query(f"with {SYMBOLS} select * from s where id = 17")
def sym_get_by_id(spark, sf):
    return symbols(spark, sf).where("id = 17")


@query(f"with {SYMBOLS} select * from s where language = 'Brand#11' order by id limit 10000")
def sym_by_file(spark, sf):
    return symbols(spark, sf).where("language = 'Brand#11'").orderBy("id").limit(10_000)


@query(f"with {SYMBOLS} select * from s where kind like '%econ%' and language <> 'Brand#11'")
def sym_filter_kind_lang(spark, sf):
    return symbols(spark, sf).where(F.col("kind").contains("econ") & (F.col("language") != "Brand#11"))


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderkey limit 50 offset 20")
def list_files_page(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").offset(20).limit(50)


@query("select lang, count(*) as files, cast(sum(n_chars) as bigint) as symbols from documents group by lang")
def lang_distribution(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("symbols"))


@query(f"with {SYMBOLS}, {ALL} select case when (select count(*) from s) > 0 then 'ready' else 'empty' end as status, (select count(*) from s) as symbols, (select count(*) from e) as edges")
def index_status(spark, sf):
    s, e = symbols(spark, sf).agg(F.count("*").alias("symbols")), edges(spark, sf).agg(F.count("*").alias("edges"))
    return s.crossJoin(e).select(F.when(F.col("symbols") > 0, "ready").otherwise("empty").alias("status"), "symbols", "edges")


@query("select p_partkey, concat_ws('::', p_brand, p_name, p_type, p_name, left(sha256(concat_ws('::', p_name, p_name, p_brand, p_type)), 8)) as symbol_id from part")
def stable_id_fingerprint(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.stable_id("p_brand", "p_name", "p_type", "p_name").alias("symbol_id"))


TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) > 0 and strlen(x) <= 40)"


@query(f"select term, count(*) as tf, count(distinct p_partkey) as df from (select p_partkey, unnest({TOKENS.format('p_name')}) as term from part) group by term")
def name_tokenize(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.explode(C.tokens(F.col("p_name"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("p_partkey").alias("df"))


def _bm25_sql(source: str, key: str, text: str, terms: str, k: int) -> str:
    return f"with t as (select {key} as id, {TOKENS.format(text)} as t from {source}), st as (select count(*) as n, avg(len(t)) as avgdl from t), h as (select id, dl, term, count(*) as tf from (select id, len(t) as dl, unnest(t) as term from t) where term in ({terms}) group by id, dl, term), d as (select term, count(*) as df from h group by term) select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from h join d using (term), st group by id order by score desc, id limit {k}"


def _top(scored: DataFrame, k: int) -> DataFrame:
    return S.top(scored.select("id", F.round("score", 6).alias("score")), k)


@query(_bm25_sql("part", "p_partkey", "p_name", "'steel','large'", 20))
def bm25_name_topk(spark, sf):
    return _top(S.bm25(symbols(spark, sf), "steel large", {"name": 1.0}), 20)


@query(_bm25_sql("documents", "doc_id", "text", "'the','licensed','thanedble'", 20))
def bm25_doc_topk(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return _top(S.bm25(d, "the licensed thanedble", {"text": 1.0}), 20)


@query(f"select doc_id as id from (select doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' as t from documents) where t like '% of the %'")
def phrase_search(spark, sf):
    return S.phrase(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "text", "of the").select("id")


@query(f"with {SYMBOLS}, i as (select * from (values (0, 5::bigint), (1, 3), (2, 5), (3, -1), (4, 1)) v(pos, id)) select pos, id, name from i join s using (id)")
def batch_resolve(spark, sf):
    ids = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, -1), (4, 1)], "pos int, id long")
    return R.batch_resolve(ids, symbols(spark, sf)).select("pos", "id", "name")


@query(f"with {ALL} select src, dst, count(*) as n from e group by src, dst having count(*) > 1")
def edge_build(spark, sf):
    return edges(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


@query(f"with {SYMBOLS}, {ALL}, ns as (select name, min(id) as id from s group by name), m as (select e.src, e.dst, a.name as src_name from e join s a on a.id = e.src) select coalesce(ns.id, -1) as src, m.dst, count(*) as n from m left join ns on ns.name = m.src_name group by 1, 2")
def edge_resolve_coalesce(spark, sf):
    s = symbols(spark, sf).select(F.col("id").cast("string").alias("symbol_id"), "name", F.col("id").alias("ord"))
    e = edges(spark, sf).join(s.select(F.col("ord").alias("src"), "name"), "src").select(F.col("name").alias("src"), F.col("dst").cast("string").alias("dst"))
    return R.resolve_across(e, s).groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.count("*").alias("n"))


@query(f"with {ALL} select distinct id from (select src as id from e union all select dst from e) where id not in (select p_partkey from part where p_partkey % 5 <> 0)")
def placeholder_nodes(spark, sf):
    return R.placeholders(edges(spark, sf), symbols(spark, sf).where("id % 5 <> 0")).select("id")


def _spans(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_path"), (F.col("p_size") * 10).cast("long").alias("line"), (F.col("p_size") * 10 + F.col("p_partkey") % 17).cast("long").alias("end_line"), F.lit("function").alias("kind"))


SPANS = "sp as (select p_partkey as symbol_id, p_brand as file_path, cast(p_size * 10 as bigint) as line, cast(p_size * 10 + p_partkey % 17 as bigint) as end_line from part)"


@query(f"with {SPANS} select s_suppkey, symbol_id as caller_id from supplier join sp on file_path = 'Brand#' || (11 + s_suppkey % 5) and s_suppkey * 7 % 500 between line and end_line")
def call_site_containment(spark, sf):
    sites = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("file_path"), (F.col("s_suppkey") * 7 % 500).alias("line"))
    return R.enclosing(sites, _spans(spark, sf)).select("s_suppkey", "caller_id")


@query(f"with {SYMBOLS}, {ALL} select s.id, (select count(*) from e where e.dst = s.id) as fan_in, (select count(*) from e where e.src = s.id) as fan_out from s")
def degree_fan(spark, sf):
    return G.degrees(symbols(spark, sf), edges(spark, sf))


@query(f"with {ALL} select src as id from e where dst = 10")
def direct_callers(spark, sf):
    return G.callers_of(edges(spark, sf), 10)


@query(f"with {ALL} select dst as id from e where src = 10")
def direct_callees(spark, sf):
    return G.callees_of(edges(spark, sf), 10)


def _trace_sql(a: str, b: str, depth: int, seed: str = "(select min(src) from e)") -> str:
    return f"with recursive {ALL}, w(id, depth) as (select {seed}, 0 union select e.{b}, w.depth + 1 from w join e on e.{a} = w.id where w.depth < {depth}) select id, cast(min(depth) as integer) as depth from w group by id having min(depth) > 0"


@query(_trace_sql("dst", "src", 4))
def trace_callers(spark, sf):
    e = edges(spark, sf)
    return G.trace(G.reverse(e.select("src", "dst")), first_source(e), 4).select("id", "depth")


@query(_trace_sql("src", "dst", 4))
def trace_callees(spark, sf):
    e = edges(spark, sf)
    return G.trace(e, first_source(e), 4).select("id", "depth")


@query("with recursive " + ALL + ", u(id, depth) as (select 1::bigint, 0 union select e.src, u.depth + 1 from u join e on e.dst = u.id where u.depth < 2), d(id, depth) as (select 1::bigint, 0 union select e.dst, d.depth + 1 from d join e on e.src = d.id where d.depth < 2) select id, cast(min(depth) as integer) as depth, 'caller' as direction from u group by id having min(depth) > 0 union all select id, cast(min(depth) as integer), 'callee' from d group by id having min(depth) > 0")
def call_subgraph(spark, sf):
    return G.subgraph(edges(spark, sf).select("src", "dst"), 1)


@query(_trace_sql("dst", "src", 10).replace("select id, cast(min(depth)", "select id, cast(min(depth)") + " order by depth, id limit 50")
def references_topn(spark, sf):
    e = edges(spark, sf)
    return G.trace(G.reverse(e.select("src", "dst")), first_source(e), 10).select("id", "depth").orderBy("depth", "id").limit(50)


_IMPACT = "with recursive " + ALL + ", c as (select * from (values (3::bigint, 0), (7::bigint, 1), (11::bigint, 2)) v(id, ord)), w(id, seed, ord, depth) as (select id, id, ord, 0 from c union select e.src, w.seed, w.ord, w.depth + 1 from w join e on e.dst = w.id where w.depth < 3), m as (select id, seed, ord, min(depth) as depth from w group by id, seed, ord having min(depth) > 0), k as (select id, seed, depth, row_number() over (partition by id order by ord, depth, seed) as rn from m) select id, cast(depth as integer) as distance, case when depth = 1 then 'direct' else 'transitive' end as level, seed as caused_by from k where rn = 1"


def _impact(spark, sf):
    changed = spark.createDataFrame([(3, 0), (7, 1), (11, 2)], "id long, ord int")
    return G.impact(edges(spark, sf).select("src", "dst"), changed, 3)


@query(f"select * from ({_IMPACT}) where level = 'direct'")
def impact_direct(spark, sf):
    return _impact(spark, sf).where("level = 'direct'")


@query(f"select * from ({_IMPACT}) where level = 'transitive'")
def impact_transitive(spark, sf):
    return _impact(spark, sf).where("level = 'transitive'")


@query(f"with recursive {ALL}, w(id) as (select min(src) from e union select e.dst from w join e on e.src = w.id) select id from w")
def reachable_set(spark, sf):
    e = edges(spark, sf)
    return G.reachable(e, first_source(e))


_NAMED_SUPPLIERS = "s as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'test_' when 1 then '_' else 'fn' end || s_suppkey as name from supplier)"
_DEAD = f"with recursive {_NAMED_SUPPLIERS}, {TREE}, w(id) as (select id from s where id % 10 = 7 union select t.dst from w join t on t.src = w.id) select id, name, case when name like 'test%' then 0.5::double when name like '\\_%' escape '\\' then 0.7::double when not exists (select 1 from t where t.dst = s.id) then 1.0::double else 0.8::double end as confidence from s where id not in (select id from w)"


def _dead(spark, sf):
    k = F.col("s_suppkey")
    prefix = F.when(k % 4 == 0, "test_").when(k % 4 == 1, "_").otherwise("fn")
    s = table(spark, sf, "supplier").select(k.alias("id"), F.concat(prefix, k.cast("string")).alias("name"))
    return A.dead_code(s, tree(spark, sf), s.where("id % 10 = 7").select("id"))


@query(f"select id, name from ({_DEAD})")
def dead_code(spark, sf):
    return _dead(spark, sf).select("id", "name")


@query(f"select confidence, count(*) as n from ({_DEAD}) group by confidence")
def dead_code_confidence(spark, sf):
    return _dead(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"))


@query("with recursive " + RING.format(6, 2) + ", w(a, b) as (select src, dst from r union select w.a, r.dst from w join r on r.src = w.b) select x.a as id, min(least(x.a, x.b)) as component from w x join w y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a")
def scc_cycles(spark, sf):
    return G.strong_components(ring(spark, sf, 6, 2))


@query("with recursive " + RING.format(7, 3) + f", {TREE}, a(x, y) as (select src, dst from r where src <> dst union select a.x, r.dst from a join r on r.src = a.y and r.src <> r.dst), b(x, y) as (select src, dst from t where src <> dst union select b.x, t.dst from b join t on t.src = b.y and t.src <> t.dst) select exists (select 1 from a where x = y) as ring, exists (select 1 from b where x = y) as tree")
def has_cycle(spark, sf):
    return spark.createDataFrame([(G.has_cycle(ring(spark, sf)), G.has_cycle(tree(spark, sf)))], "ring boolean, tree boolean")


@query(f"with recursive {TREE}, n as (select src as id from t union select dst from t), w(id, level) as (select id, 0 from n where id not in (select dst from t) union select t.dst, w.level + 1 from w join t on t.src = w.id) select id, cast(max(level) as integer) as level from w group by id")
def topo_levels(spark, sf):
    return G.topological_levels(tree(spark, sf))


HREFS = "select regexp_extract(url, '^https?://([^/?#]+)', 1) as src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as dst from pages"


def hrefs(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("file_path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("import_path"))


@query(HREFS.replace("as src", "as file_path").replace("as dst", "as import_path"))
def import_extract(spark, sf):
    return hrefs(spark, sf)


@query(f"select src, dst, 'import' as edge_type, count(*) as \"count\" from ({HREFS}) where dst <> '' group by src, dst")
def dep_file_graph(spark, sf):
    i = hrefs(spark, sf).withColumn("resolution", F.struct(F.lit("Resolved").alias("tag"), F.col("import_path").alias("value")))
    return G.dependency_graph(i)


@query(f"with {ALL} select src, dst, case when min(k) = 0 then 'call' else 'reference' end as edge_type, count(*) as \"count\" from (select src, dst, 0 as k from e union all select dst, src, 1 from e) group by src, dst")
def dep_symbol_graph(spark, sf):
    e = edges(spark, sf)
    return G.symbol_graph(e, G.reverse(e.select("src", "dst")))


@query(f"with {ALL} select a.p_brand as src, b.p_brand as dst, count(*) as \"count\" from e join part a on a.p_partkey = e.src join part b on b.p_partkey = e.dst group by 1, 2")
def dep_module_rollup(spark, sf):
    d = edges(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("count"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("package"))
    return G.module_graph(d, p)


@query(f"with {ALL}, d as (select distinct src, dst from e), n as (select 1 as id union select dst from d where src = 1 union select src from d where dst = 1) select src, dst from d where src in (select id from n) and dst in (select id from n)")
def dep_ego_net(spark, sf):
    return G.ego_net(edges(spark, sf).select("src", "dst").distinct(), 1)


def _closure(a: str, b: str) -> str:
    return f"with recursive {TREE}, w(seed, id) as (select src, src from t union select w.seed, t.{b} from w join t on t.{a} = w.id)"


@query(_closure("src", "dst") + " select seed, count(*) as n from w where seed <> id group by seed")
def type_ancestors(spark, sf):
    t = tree(spark, sf)
    return G.ancestors(t, t.select(F.col("src").alias("id"))).groupBy("seed").agg(F.count("*").alias("n"))


@query(_closure("dst", "src") + " select id from w where seed = 1 and id <> 1")
def type_descendants(spark, sf):
    return G.descendants(tree(spark, sf), spark.createDataFrame([(1,)], "id long")).select("id")


_KINDS = "k as (select s_suppkey as id, case s_suppkey % 3 when 0 then 'class' when 1 then 'interface' else 'trait' end as kind, s_suppkey // 2 as parent_id from supplier where s_suppkey > 0)"


def _types(spark, sf) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, "class").when(F.col("s_suppkey") % 3 == 1, "interface").otherwise("trait")
    return table(spark, sf, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("id"), kind.alias("kind"), F.expr("s_suppkey div 2").alias("parent_id"))


_RELATION = "case when c.kind = 'class' and p.kind = 'class' then 'extends/0.9' when c.kind = 'class' then 'implements/0.9' when p.kind <> 'class' then 'extends/0.8' else 'extends/0.3' end"


@query(f"with {_KINDS} select split_part(r, '/', 1) as relation, cast(split_part(r, '/', 2) as double) as confidence, count(*) as n from (select {_RELATION} as r from k c join k p on p.id = c.parent_id) group by 1, 2")
def inherit_relation(spark, sf):
    return G.hierarchy(_types(spark, sf)).groupBy("relation", "confidence").agg(F.count("*").alias("n"))


@query(f"with recursive {_KINDS}, h as (select c.id as src, p.id as dst from k c join k p on p.id = c.parent_id where {_RELATION} like 'implements%'), w(seed, id) as (select id, id from k union select w.seed, h.src from w join h on h.dst = w.id) select seed, id from w where seed <> id")
def type_implementations(spark, sf):
    t = _types(spark, sf)
    return G.implementations(G.hierarchy(t), t.select("id")).select("seed", "id")


_WORDS = "', '".join(C.BRANCH_WORDS)
_COMPLEXITY = f"1 + len(list_filter(string_split_regex(text, '[\\s(){{}};,]'), lambda x: x in ('{_WORDS}'))) + (length(text) - length(replace(text, '??', ''))) // 2 + (length(text) - length(replace(text, '?.', ''))) // 2"


@query(f"select doc_id, cast({_COMPLEXITY} as bigint) as complexity from documents")
def complexity_lexer(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.complexity(F.col("text")).alias("complexity"))


@query(f"with {SYMBOLS} select id, complexity, cast(row_number() over (order by complexity desc, id) as integer) as rank from s order by complexity desc, id limit 10")
def complexity_topn(spark, sf):
    t = symbols(spark, sf).select("id", "complexity").orderBy(F.desc("complexity"), "id").limit(10)
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("complexity"), "id")))


@query(f"with {SYMBOLS} select count(*) as n, cast(sum(complexity) as bigint) as total, round(avg(complexity), 6) as mean, count(*) filter (complexity > 15) as over_15, count(*) filter (complexity > 30) as over_30 from s")
def complexity_stats(spark, sf):
    c = F.col("complexity")
    return symbols(spark, sf).agg(F.count("*").alias("n"), F.sum(c).alias("total"), F.round(F.avg(c), 6).alias("mean"), F.count_if(c > 15).alias("over_15"), F.count_if(c > 30).alias("over_30"))


@query(f"with recursive {SYMBOLS}, {ALL}, h as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1), up(seed, id) as (select src, dst from h union select up.seed, h.dst from up join h on h.src = up.id), d as (select seed, count(*) as n from up group by seed), fi as (select dst as id, count(*) as n from e group by dst), fo as (select src as id, count(*) as n from e group by src) select s.id, s.name, s.complexity, coalesce(fi.n, 0) as fan_in, coalesce(fo.n, 0) as fan_out, coalesce(d.n, 0) as depth_of_inheritance from s left join fi using (id) left join fo using (id) left join d on d.seed = s.id")
def metrics_all(spark, sf):
    heritage = table(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return A.all_metrics(symbols(spark, sf), edges(spark, sf).select("src", "dst"), heritage)


def _named(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("n"))
    e = edges(spark, sf)
    return e.join(p.withColumnsRenamed({"k": "src", "n": "a"}), "src").join(p.withColumnsRenamed({"k": "dst", "n": "b"}), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


NAMED = f"{ALL}, n as (select distinct a.p_brand || '/' || a.p_partkey as src, b.p_brand || '/' || b.p_partkey as dst from e join part a on a.p_partkey = e.src join part b on b.p_partkey = e.dst)"


@query(f"with {NAMED} select 'r1' as rule_name, src, dst from n where src like 'Brand#1%/%' and dst like 'Brand#2%'")
def rule_forbidden(spark, sf):
    return A.forbidden(_named(spark, sf), "r1", "Brand#1*/*", "Brand#2*")


@query(f"with {NAMED} select distinct 'r2' as rule_name, src, 'Brand#1*' as dst from n where src like 'Brand#2%' and src not in (select src from n where dst like 'Brand#1%')")
def rule_required(spark, sf):
    e = _named(spark, sf)
    return A.required(e.select(F.col("src").alias("id")).distinct(), e, "r2", "Brand#2*", "Brand#1*")


@query(f"with {NAMED} select 'r3' as rule_name, src, dst from n where not (src like 'Brand#1%' and dst like 'Brand#3%') and src like 'Brand#3%' and dst like 'Brand#1%'")
def rule_layer(spark, sf):
    return A.layer(_named(spark, sf), "r3", "Brand#1*", "Brand#3*")


@query(f"with {SPANS}, h as (select 'Brand#' || (11 + s_suppkey % 5) as file_path, s_suppkey * 3 % 500 as a, s_suppkey * 3 % 500 + 9 as z from supplier) select symbol_id, round(least(sum(least(z, end_line) - greatest(a, line) + 1) / max(end_line - line + 1), 1.0), 6) as overlap_ratio from h join sp using (file_path) where a <= end_line and z >= line group by symbol_id")
def diff_overlap(spark, sf):
    h = table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("file_path"), (F.col("s_suppkey") * 3 % 500).alias("start"), (F.col("s_suppkey") * 3 % 500 + 9).alias("end"))
    return A.affected(h, _spans(spark, sf)).select("symbol_id", F.round("overlap_ratio", 6).alias("overlap_ratio"))


@query("select 'f' || s_suppkey as file_path, s_suppkey + 1 as start, s_suppkey + 1 + s_suppkey % 4 as \"end\" from supplier")
def diff_hunks(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("--- a/f"), k, F.lit("\n+++ b/f"), k, F.lit("\n@@ -1 +"), (F.col("s_suppkey") + 1).cast("string"), F.lit(","), (F.col("s_suppkey") % 4 + 1).cast("string"), F.lit(" @@ fn\n+x"))
    return A.parse_hunks(s.select(F.col("s_suppkey").alias("diff_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "value")))


_NEW = "select doc_id, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as h from documents where doc_id % 10 <> 1"


def _snapshots(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


@query(f"with o as (select doc_id, sha256(text) as h from documents where doc_id % 10 <> 0), w as ({_NEW}) select coalesce(o.doc_id, w.doc_id) as path, case when o.doc_id is null then 'added' when w.doc_id is null then 'deleted' else 'modified' end as change from o full outer join w on o.doc_id = w.doc_id where o.h is null or w.h is null or o.h <> w.h")
def snapshot_diff(spark, sf):
    return A.snapshot_diff(*_snapshots(spark, sf))


@query(f"with o as (select doc_id, sha256(text) as h from documents where doc_id % 10 <> 0), w as ({_NEW}) select w.doc_id as path from w left join o using (doc_id) where o.h is null or o.h <> w.h")
def change_skip(spark, sf):
    old, new = _snapshots(spark, sf)
    return A.changed_only(new, old).select("path")


@query(f"with {SYMBOLS} select id, name, language from (select *, row_number() over (partition by language, name order by complexity desc, id) as rn from s) where rn = 1")
def dedup_priority(spark, sf):
    return R.keep_best(symbols(spark, sf), ["language", "name"], [F.desc("complexity"), F.col("id")]).select("id", "name", "language")


@query(f"with {SYMBOLS} select max(id) as id, name, language from s group by name, language")
def dedup_keep_last(spark, sf):
    return R.keep_last(symbols(spark, sf), ["language", "name"], ["id"]).select("id", "name", "language")


@query("with recursive v as (select user_id as key, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events), w(key, rn, batch_start) as (select key, rn, ts from v where rn = 1 union all select v.key, v.rn, case when v.ts >= w.batch_start + interval 1 hour then v.ts else w.batch_start end from w join v on v.key = w.key and v.rn = w.rn + 1) select key, batch_start, count(*) as n from w group by key, batch_start")
def debounce_batches(spark, sf):
    return A.debounced(table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts"), 3_600_000)


@query("with v as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as fresh from events), g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from v) select user_id, min(ts) as session_start, count(*) as n from g group by user_id, s")
def session_windows(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("select page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/')[:-2], lambda x: x <> '' and x <> 'src')[-1] as package from pages")
def package_infer(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.package_of(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)).alias("package"))


@query("select file_key, count(*) as n, cast(sum(l) as bigint) as total from (select p_brand as file_key, length(p_name) as l from part where starts_with(p_brand, 'Brand#2')) group by file_key")
def prefix_scan(spark, sf):
    """Keys of one namespace by their beginning."""
    p = table(spark, sf, "part").where(F.col("p_brand").startswith("Brand#2"))
    return p.groupBy(F.col("p_brand").alias("file_key")).agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("total"))


@query(f"with {ALL} select id, list_sort(list(distinct dst)) as callees from (select src as id, dst from e where src between 100 and 119) group by id")
def edges_of_callers(spark, sf):
    e = edges(spark, sf).where("src between 100 and 119")
    return e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))


@query(f"with {SYMBOLS} select id as symbol_id, name from s where name <> ''")
def scan_ids(spark, sf):
    return symbols(spark, sf).where("name <> ''").select(F.col("id").alias("symbol_id"), "name")


_KEYS = "keys as (select * from (values ('17'), ('large'), ('steel'), ('nobody'), ('3')) v(key))"


@query(f"with {SYMBOLS}, {_KEYS}, n as (select split_part(name, ' ', 1) as word, max(id) as last from s group by 1) select key, coalesce(cast(s.id as varchar), cast(n.last as varchar), key) as symbol_id from keys left join s on cast(s.id as varchar) = key left join n on n.word = key")
def lookup_id_then_name(spark, sf):
    keys = spark.createDataFrame([("17",), ("large",), ("steel",), ("nobody",), ("3",)], "key string")
    s = symbols(spark, sf).select(F.col("id").cast("string").alias("symbol_id"), F.split_part("name", F.lit(" "), F.lit(1)).alias("name"), F.col("id").alias("ord"))
    return R.lookup(keys, s)


@query(_trace_sql("src", "dst", 2).replace("select id, cast(min(depth) as integer) as depth from w group by id having min(depth) > 0", "select w.id, cast(min(depth) as integer) as depth, any_value(p_name) as name, coalesce(any_value(p_brand) || ':' || any_value(p_size), '?') as location from w left join part on p_partkey = w.id and p_partkey % 7 <> 0 group by w.id having min(depth) > 0").replace("any_value(p_name)", "coalesce(any_value(p_name), cast(w.id as varchar))"))
def trace_located(spark, sf):
    e = edges(spark, sf)
    found = G.trace(e, first_source(e), 2).select("id", "depth")
    s = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.lit("f").alias("kind"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"))
    return R.located(found, s).select("id", "depth", "name", "location")


@query(f"select cast(count(distinct id) as bigint) as total_affected, count(*) filter (level = 'direct') as direct from ({_IMPACT})")
def impact_totals(spark, sf):
    return _impact(spark, sf).agg(F.countDistinct("id").alias("total_affected"), F.count_if(F.col("level") == "direct").alias("direct"))


@query("with recursive " + ALL + ", u(id, depth) as (select 1::bigint, 0 union select e.src, u.depth + 1 from u join e on e.dst = u.id where u.depth < 2), d(id, depth) as (select 1::bigint, 0 union select e.dst, d.depth + 1 from d join e on e.src = d.id where d.depth < 2) select (select count(distinct id) from u where id <> 1) as callers, (select count(distinct id) from d where id <> 1) as callees, (select count(distinct id) from u where id <> 1) + (select count(distinct id) from d where id <> 1) + 1 as total_nodes")
def subgraph_totals(spark, sf):
    g = G.subgraph(edges(spark, sf).select("src", "dst"), 1)
    return g.agg(F.count_if(F.col("direction") == "caller").alias("callers"), F.count_if(F.col("direction") == "callee").alias("callees"), (F.count("*") + 1).alias("total_nodes"))


@query("with recursive " + RING.format(6, 2) + ", w(a, b) as (select src, dst from r union select w.a, r.dst from w join r on r.src = w.b), c as (select x.a as id, min(least(x.a, x.b)) as component from w x join w y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a) select (select count(*) from supplier) as node_count, (select count(*) from r) as edge_count, (select count(*) from c) > 0 as has_cycle, (select count(distinct component) from c) as cycle_count")
def arch_graph_stats(spark, sf):
    return A.graph_stats(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), ring(spark, sf, 6, 2))


RULES = [{"name": n, "rule_type": t, "source_pattern": a, "target_pattern": b} for n, t, a, b in (("r1", "forbidden", "Brand#1*/*", "Brand#2*"), ("r2", "required", "Brand#2*", "Brand#10*"), ("r3", "layer", "Brand#1*", "Brand#3*"), ("r4", "forbidden", "Brand#4*", "Brand#4*"))]


@query(f"with {NAMED}, ids as (select src as id from n union select dst from n) select rule_name, count(*) as broken, count(distinct src) as sources from (select 'r1' as rule_name, src from n where src like 'Brand#1%/%' and dst like 'Brand#2%' union all select 'r2', id from ids where id like 'Brand#2%' and id not in (select src from n where dst like 'Brand#10%') union all select 'r3', src from n where not (src like 'Brand#1%' and dst like 'Brand#3%') and src like 'Brand#3%' and dst like 'Brand#1%' union all select 'r4', src from n where src like 'Brand#4%' and dst like 'Brand#4%') group by rule_name")
def rules_all(spark, sf):
    e = _named(spark, sf)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return A.check_rules(nodes, e, RULES).groupBy("rule_name").agg(F.count("*").alias("broken"), F.countDistinct("src").alias("sources"))


@query(f"with {NAMED}, l as (select *, cast(substr(src, 7, 1) as int) as a, cast(substr(dst, 7, 1) as int) as b from n) select a, b, count(*) as n from l where a <> b and a < b group by a, b")
def layers_allowed(spark, sf):
    e = _named(spark, sf)
    layers = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("layer", F.substring("node", 7, 1).cast("int"))
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(10) if a > b], "a int, b int")
    return A.allowed_layers(e, layers, pairs).groupBy("a", "b").agg(F.count("*").alias("n"))


_CHANGES = f"with o as (select doc_id, sha256(text) as h from documents where doc_id % 10 <> 0), w as ({_NEW}), c as (select case when o.doc_id is null then 'added' when w.doc_id is null then 'deleted' else 'modified' end as change from o full outer join w on o.doc_id = w.doc_id where o.h is null or w.h is null or o.h <> w.h)"


@query(_CHANGES + " select count(*) filter (change = 'added') as added, count(*) filter (change = 'deleted') as deleted, count(*) filter (change = 'modified') as modified from c")
def change_counts(spark, sf):
    return A.change_counts(A.snapshot_diff(*_snapshots(spark, sf)))


_MOVES = "o as (select 'a/' || doc_id as path, sha256(text) as hash from documents where doc_id % 10 <> 3), w as (select case when doc_id % 9 = 4 then 'b/' else 'a/' end || doc_id as path, sha256(text) as hash from documents where doc_id % 10 <> 5)"


@query(f"with {_MOVES}, gone as (select path, hash, row_number() over (partition by hash order by path) as n from o where path not in (select path from w)), come as (select path, hash, row_number() over (partition by hash order by path) as n from w where path not in (select path from o)), moved as (select come.path, gone.path as old_path from come join gone using (hash, n)) select path, old_path, 'renamed' as change from moved union all select path, null, 'added' from come where path not in (select path from moved) union all select path, null, 'deleted' from gone where path not in (select old_path from moved)")
def snapshot_renames(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    k = F.col("doc_id").cast("string")
    old = d.where("doc_id % 10 <> 3").select(F.concat(F.lit("a/"), k).alias("path"), "hash")
    new = d.where("doc_id % 10 <> 5").select(F.concat(F.when(F.col("doc_id") % 9 == 4, "b/").otherwise("a/"), k).alias("path"), "hash")
    return A.with_renames(old, new)


@query(f"with {SPANS} select count(distinct file_path) as files, count(symbol_id) as symbols from sp")
def range_map_totals(spark, sf):
    return A.range_map_totals(_spans(spark, sf))


@query("select file_path, callee_name, line, call_type from (select o_custkey % 50 as file_path, o_orderpriority as callee_name, o_orderkey % 20 as line, case o_orderstatus when 'F' then 'Direct' when 'O' then 'Virtual' else 'MacroExpansion' end as call_type, row_number() over (partition by o_custkey % 50, o_orderpriority, o_orderkey % 20 order by case o_orderstatus when 'F' then 3 when 'O' then 1 else 0 end, o_orderkey) as rn from orders) where rn = 1")
def dedup_calls(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Direct").when(F.col("o_orderstatus") == "O", "Virtual").otherwise("MacroExpansion")
    calls = o.select((F.col("o_custkey") % 50).alias("file_path"), F.col("o_orderpriority").alias("callee_name"), (F.col("o_orderkey") % 20).alias("line"), F.col("o_orderkey").alias("col"), kind.alias("call_type"))
    return R.distinct_calls(calls).drop("col")


def _doc_tokens(*has: str) -> str:
    return f"select doc_id as id from (select doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' as t from documents) where " + " ".join(has)


@query(_doc_tokens("(t like '% license %' or t like '% the %') and t like '% of %' and not t like '% of the %'"))
def boolean_search(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.search(d, '(license OR the) AND of NOT "of the"', "text").select("id")


@query("select term, cast(sum(tf) as bigint) as tf, count(*) as df, cast(sum(first) as bigint) as first from (select doc_id, term, count(*) as tf, min(pos) as first from (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from (select doc_id, " + TOKENS.format("text") + " as t from documents)) group by doc_id, term) where term in ('the', 'of', 'license', 'and') group by term")
def stored_postings(spark, sf):
    index = S.Index.of(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), ["text"])
    p = index.hits(["the", "of", "license", "and"], ["text"])
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.sum(F.element_at("places", 1)).alias("first"))


@query(f"with {SYMBOLS} select id, language || '::' || name || '::' || kind as symbol_id, language, kind from s where id <= 500")
def parse_ids(spark, sf):
    s = symbols(spark, sf).where("id <= 500").select("id", F.concat_ws("::", "language", "name", "kind", F.lit("n"), F.lit("f")).alias("full"), F.concat_ws("::", "language", "name", "kind").alias("symbol_id"))
    p = C.parse_id(F.col("full"))
    return s.select("id", "symbol_id", p.language.alias("language"), p.kind.alias("kind"))


@query("select event_id, cast(json_extract(props, '$.k') as varchar) as k, cast(floor(epoch(ts)) as bigint) as at, cast(year(ts) as integer) as y from events")
def json_and_dates(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.year("ts").alias("y"))


FIXTURE = [
    ("src/app.rs", "use crate::store::Shelf;\nuse std::io;\n/// An account.\npub struct Account { id: u32 }\nimpl Account {\n    pub fn open(id: u32) -> Account {\n        check(id);\n        Account { id }\n    }\n}\nfn check(id: u32) -> bool { id > 0 }\nfn main() { Account::open(1); println!(\"{}\", check(2)); }\n"),
    ("src/store.rs", "use super::app;\npub enum Shelf { Top }\n"),
    ("web/shop.ts", "import { a } from './lib/a';\nimport React from 'react';\nimport { b } from './gone';\nexport class Shop extends Base {\n  sell(x: number) {\n    return price(x);\n  }\n}\nexport function price(x: number) { return x; }\n"),
    ("web/lib/a/index.js", "const c = require('../util');\nfunction a() { return c(); }\n"),
    ("web/lib/util.js", "export const c = () => 1;\n"),
    ("java/src/shop/Main.java", "package shop;\nimport shop.util.Money;\nimport java.util.List;\npublic class Main implements Runnable {\n  public static void main(String[] a) {\n    run();\n  }\n  static void run() {}\n}\n"),
    ("java/src/shop/util/Money.kt", "package shop.util\n/** Money. */\ndata class Money(val cents: Int) {\n  fun add(o: Money): Money { return make(o) }\n}\n"),
    ("net/Till.cs", "using System;\nnamespace Shop {\n  public class Till : Box {\n    public int Count { get; set; }\n    public void Open() { Log(1); }\n  }\n}\n"),
    ("native/ring.c", "#include \"ring.h\"\n#include <stdio.h>\n#define SIZE 8\nstruct ring { int at; };\nstatic int step(int x) { return x + 1; }\nint turn(int x) { return step(x); }\n"),
    ("native/ring.h", "int turn(int x);\n"),
    ("native/wheel.cpp", "#include \"ring.h\"\nclass Wheel : public Disc {\n};\nint spin(int n) {\n  return turn(n);\n}\n"),
]


def _fixture(spark) -> DataFrame:
    return spark.createDataFrame(FIXTURE, "file_path string, content string")


def _values(columns: str, rows: list[tuple]) -> str:
    """The known answer as SQL."""
    literal = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::bigint" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


_SYMBOLS = [
    ("java/src/shop/Main.java", "Main", "Class", 4, 9, True, None),
    ("java/src/shop/Main.java", "main", "Method", 5, 7, True, None),
    ("java/src/shop/Main.java", "run", "Method", 8, 8, False, None),
    ("java/src/shop/util/Money.kt", "Money", "Class", 3, 5, True, "Money."),
    ("java/src/shop/util/Money.kt", "add", "Method", 4, 4, True, None),
    ("java/src/shop/util/Money.kt", "cents", "Field", 3, 5, False, "Money."),
    ("native/ring.c", "SIZE", "Macro", 3, 3, True, None),
    ("native/ring.c", "ring", "Struct", 4, 4, True, None),
    ("native/ring.c", "step", "Function", 5, 5, False, None),
    ("native/ring.c", "turn", "Function", 6, 6, True, None),
    ("native/wheel.cpp", "Wheel", "Class", 2, 3, True, None),
    ("native/wheel.cpp", "spin", "Function", 4, 6, True, None),
    ("net/Till.cs", "Count", "property", 4, 4, True, None),
    ("net/Till.cs", "Open", "Method", 5, 5, True, None),
    ("net/Till.cs", "Shop", "Module", 2, 7, False, None),
    ("net/Till.cs", "Till", "Class", 3, 6, True, None),
    ("src/app.rs", "Account", "Struct", 4, 4, True, "An account."),
    ("src/app.rs", "check", "Function", 11, 11, False, None),
    ("src/app.rs", "main", "Function", 12, 12, False, None),
    ("src/app.rs", "open", "Method", 6, 9, True, None),
    ("src/store.rs", "Shelf", "Enum", 2, 2, True, None),
    ("web/lib/a/index.js", "a", "Function", 2, 2, False, None),
    ("web/lib/a/index.js", "c", "Variable", 1, 1, False, None),
    ("web/lib/util.js", "c", "Function", 1, 1, True, None),
    ("web/shop.ts", "Shop", "Class", 4, 8, True, None),
    ("web/shop.ts", "price", "Function", 9, 9, True, None),
    ("web/shop.ts", "sell", "Method", 5, 7, False, None),
]


@query(_values("file_path, name, kind, line, end_line, is_exported, doc_comment", _SYMBOLS))
def extract_symbols(spark, sf):
    from sparkloom.sources.extract import extract

    return extract(_fixture(spark)).where("record = 'symbol'").select("file_path", "name", "kind", "line", "end_line", "is_exported", "doc_comment")


_CALLS = [
    ("java/src/shop/Main.java", "run", "Direct", 6),
    ("java/src/shop/util/Money.kt", "make", "Direct", 4),
    ("native/ring.c", "step", "Direct", 6),
    ("native/ring.h", "turn", "Direct", 1),
    ("native/wheel.cpp", "turn", "Direct", 5),
    ("net/Till.cs", "Log", "Direct", 5),
    ("src/app.rs", "check", "Direct", 7),
    ("src/app.rs", "check", "Direct", 12),
    ("src/app.rs", "open", "Direct", 12),
    ("src/app.rs", "println", "MacroExpansion", 12),
    ("web/lib/a/index.js", "c", "Direct", 2),
    ("web/lib/a/index.js", "require", "Direct", 1),
    ("web/shop.ts", "price", "Direct", 6),
]


@query(_values("file_path, name, kind, line", _CALLS))
def extract_calls(spark, sf):
    from sparkloom.sources.extract import extract

    return extract(_fixture(spark)).where("record = 'call'").select("file_path", "name", "kind", "line")


_HERITAGE = [("java/src/shop/Main.java", "Main", "implements", "Runnable"), ("native/wheel.cpp", "Wheel", "extends", "Disc"), ("net/Till.cs", "Till", "extends", "Box"), ("web/shop.ts", "Shop", "extends", "Base")]


@query(_values("file_path, child, relation, parent", _HERITAGE))
def extract_heritage(spark, sf):
    from sparkloom.sources.extract import extract

    return extract(_fixture(spark)).where("record = 'heritage'").select("file_path", F.col("name").alias("child"), F.col("kind").alias("relation"), "parent")


_RESOLVED = [
    ("java/src/shop/Main.java", "java.util.List", "External", "java.util.List"),
    ("java/src/shop/Main.java", "shop", "External", "shop"),
    ("java/src/shop/Main.java", "shop.util.Money", "Resolved", "java/src/shop/util/Money.kt"),
    ("native/ring.c", "ring.h", "Resolved", "native/ring.h"),
    ("native/ring.c", "stdio.h", "External", "stdio.h"),
    ("native/wheel.cpp", "ring.h", "Resolved", "native/ring.h"),
    ("net/Till.cs", "System", "External", "System"),
    ("src/app.rs", "crate::store::Shelf", "Resolved", "src/store.rs"),
    ("src/app.rs", "std::io", "External", "std::io"),
    ("src/store.rs", "super::app", "Resolved", "src/app.rs"),
    ("web/lib/a/index.js", "../util", "Resolved", "web/lib/util.js"),
    ("web/shop.ts", "./gone", "Unresolved", "./gone"),
    ("web/shop.ts", "./lib/a", "Resolved", "web/lib/a/index.js"),
    ("web/shop.ts", "react", "External", "react"),
]


@query(_values("file_path, import_path, tag, value", _RESOLVED))
def import_resolve(spark, sf):
    from sparkloom.operators.imports import resolve_imports
    from sparkloom.sources.extract import extract

    found = extract(_fixture(spark)).where("record = 'import'").select("file_path", F.col("name").alias("import_path"), "line")
    files = _fixture(spark).select("file_path", C.language_of(F.col("file_path")).alias("language"))
    return resolve_imports(found, files).select("file_path", "import_path", "resolution.tag", "resolution.value")


@query("with s as (select doc_id % 50 as file_path, doc_id as id, lang from documents), g as (select * from (values (3), (7), (49)) v(file_path)) select file_path, id, lang from s where file_path not in (select file_path from g) union all select file_path, id + 1, upper(lang) from s where file_path in (3, 7)")
def reindex_upsert(spark, sf):
    """Rows of changed files (3, 7) are replaced, those of removed files (49) go."""
    from sparkloom.streaming.watch import upsert

    stored = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("file_path"), F.col("doc_id").alias("id"), "lang")
    fresh = stored.where("file_path in (3, 7)").select("file_path", (F.col("id") + 1).alias("id"), F.upper("lang").alias("lang"))
    return upsert(stored, fresh, spark.createDataFrame([(49,)], "file_path long"))
