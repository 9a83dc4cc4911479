"""Graph operators over edges (src, dst): traversal, closure, cycles, order, impact, dependency graphs, hierarchies.

Loops write the distinct edges once, partitioned by src, to the folder that all executors share, so a level reads those and
not the source again. Each level joins its frontier with them and leaves out what is visited; levels are written as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import checkpointed


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out for every node; parallel edges and self loops count."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select(F.col("src"), F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(counts.hint("merge"), "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def callers_of(edges: DataFrame, key) -> DataFrame:
    return edges.where(F.col("dst") == F.lit(key)).select(F.col("src").alias("id"))


def callees_of(edges: DataFrame, key) -> DataFrame:
    return edges.where(F.col("src") == F.lit(key)).select(F.col("dst").alias("id"))


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def links_of(edges: DataFrame) -> DataFrame:
    """The distinct edges, written once and partitioned by src."""
    return checkpointed(edges.select("src", "dst").repartition("src").distinct())


def from_pairs(spark, pairs, kind: str = "string") -> DataFrame:
    """Edges of a list of pairs."""
    return spark.createDataFrame(list(pairs), f"src {kind}, dst {kind}")


def neighbours(edges: DataFrame, key, incoming: bool = False) -> DataFrame:
    """id of the distinct direct dependents (incoming) or dependencies of a node."""
    return (callers_of if incoming else callees_of)(edges, key).distinct()


def trace(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """seed, id, depth: nodes reachable along edges with the least depth; the seed itself is left out.

    seeds: column id. max_depth None: until nothing new is found.
    """
    links = links_of(edges)
    frontier = checkpointed(seeds.select(F.col("id").alias("seed"), F.col("id"), F.lit(0).alias("depth")).distinct())
    visited, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(links, frontier.id == links.src).select("seed", F.col("dst").alias("id")).distinct()
        step = checkpointed(step.join(visited.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)).select("seed", "id", "depth"))
        if step.isEmpty():
            break
        visited, frontier = visited.union(step), step
    return visited.where("depth > 0")


def trace_all(edges: DataFrame, start, max_depth: int) -> DataFrame:
    """id, depth with the multiplicity of parallel edges at depth 1 and the start allowed to come back (compatible form)."""
    first = edges.where(F.col("src") == F.lit(start)).select(F.col("dst").alias("id"), F.lit(1).alias("depth"))
    frontier = checkpointed(first.distinct())
    out, visited, links = first, frontier, links_of(edges)
    for depth in range(2, max_depth + 1):
        step = frontier.join(links, frontier.id == links.src).select(F.col("dst").alias("id")).distinct()
        step = checkpointed(step.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        out, visited, frontier = out.union(step), visited.union(step), step
    return out


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id of everything reachable from any seed, the seeds included (also those that the graph lacks)."""
    links = links_of(edges)
    frontier = checkpointed(seeds.select("id").distinct())
    visited = frontier
    while True:
        step = frontier.join(links, frontier.id == links.src).select(F.col("dst").alias("id")).distinct()
        step = checkpointed(step.join(visited, "id", "left_anti"))
        if step.isEmpty():
            return visited
        visited, frontier = visited.union(step), step


def impact(edges: DataFrame, changed: DataFrame, max_depth: int = 5) -> DataFrame:
    """id, distance, level, caused_by: callers of changed symbols (id, ord); the first changed symbol in order claims them."""
    found = trace(reverse(edges), changed.select("id"), max_depth)
    ranked = found.join(changed.select(F.col("id").alias("seed"), "ord"), "seed")
    best = ranked.groupBy("id").agg(F.min(F.struct("ord", "depth", "seed")).alias("b"))
    return best.select("id", F.col("b.depth").alias("distance"), F.when(F.col("b.depth") == 1, "direct").otherwise("transitive").alias("level"), F.col("b.seed").alias("caused_by"))


def subgraph(edges: DataFrame, centre, caller_depth: int = 2, callee_depth: int = 2) -> DataFrame:
    """id, depth, direction around a centre."""
    seed = edges.sparkSession.createDataFrame([(centre,)], ["id"])
    up = trace(reverse(edges), seed, caller_depth).select("id", "depth", F.lit("caller").alias("direction"))
    return up.union(trace(edges, seed, callee_depth).select("id", "depth", F.lit("callee").alias("direction")))


#: Edges that one task may hold to find their components, some 200 MB of Python's memory. More are worked on by all tasks.
HELD = 500_000


def trimmed(edges: DataFrame, enough: int = 0) -> DataFrame:
    """Edges left when nodes without incoming or without outgoing edges are taken away until none is left, or enough edges have
    gone for the rest to be no more than that; no self loops."""
    e = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    n = e.count()
    while n > enough:
        e = checkpointed(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if (m := e.count()) == n:
            break
        n = m
    return e


def _components_of_few(e: DataFrame) -> DataFrame:
    """strong_components of HELD edges at most, in one task by Tarjan's algorithm."""

    def run(batches):
        import pyarrow as pa

        to, kind = {}, None
        for b in batches:
            kind = b.schema.field(0).type
            for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to.setdefault(a, []).append(z)
        number, low, held, stack, out = {}, {}, set(), [], ([], [])
        for root in to:
            if root in number:
                continue
            number[root] = low[root] = len(number)
            stack.append(root)
            held.add(root)
            path = [(root, iter(to[root]))]
            while path:
                a, rest = path[-1]
                for z in rest:
                    if z not in number:
                        number[z] = low[z] = len(number)
                        stack.append(z)
                        held.add(z)
                        path.append((z, iter(to.get(z, ()))))
                        break
                    if z in held:
                        low[a] = min(low[a], number[z])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[a])
                    if low[a] == number[a]:
                        at = len(stack) - 1
                        while stack[at] != a:
                            at -= 1
                        part = stack[at:]
                        del stack[at:]
                        held.difference_update(part)
                        if len(part) > 1:
                            out[0].extend(part)
                            out[1].extend([min(part)] * len(part))
        for i in range(0, len(out[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 10_000], kind) for c in out], names=["id", "component"])

    kind = dict(e.dtypes)["src"]
    return checkpointed(e.repartition(1).mapInArrow(run, f"id {kind}, component {kind}"))


def has_cycle(edges: DataFrame) -> bool:
    e = trimmed(edges, HELD)
    return e.count() > HELD or not _components_of_few(e).isEmpty()


def _propagate(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along edges (id, label), by rounds until nothing changes.

    Every node also has a jump, at first one of its successors, which doubles each round: labels run down a chain or a ring of
    n nodes in log n rounds and not in n. A jump follows edges, so it carries nothing that they would not.
    """
    jump = checkpointed(e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to")))
    while True:
        ways = e.select("src", "dst").union(jump.select("id", "to"))
        sent = ways.join(labels, ways.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("sent"))
        new = checkpointed(labels.join(sent, "id", "left").select("id", F.least("label", F.coalesce("sent", "label")).alias("label"), (F.coalesce("sent", "label") < F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jump = checkpointed(jump.join(far, "to", "left").select("id", F.coalesce("far", "to").alias("to")))


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of strongly connected components of two nodes or more.

    Forward-backward colouring: every node takes the least id that reaches it; what reaches the colour's root within the colour
    is the root's component. The rest goes another round, until it is small enough for one task.
    """
    e = trimmed(edges, HELD)
    out = None
    while e.count() > HELD:
        nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        colour = checkpointed(_propagate(e, checkpointed(nodes.select("id", F.col("id").alias("label")))))
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = checkpointed(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # 0 runs from each root against the edges of its colour, which are no other colour's.
        reached = _propagate(back, checkpointed(colour.select("id", (F.col("id") != F.col("label")).cast("int").alias("label"))))
        found = checkpointed(reached.where("label = 0").select("id").join(colour.select("id", F.col("label").alias("component")), "id"))
        many = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        part = found.join(many, "component", "left_semi").select("id", "component")
        out = part if out is None else out.union(part)
        e = trimmed(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"), HELD)
    part = _components_of_few(e)
    return part if out is None else out.union(part)


def topological_levels(edges: DataFrame) -> DataFrame:
    """id, level: 0 for nodes without incoming edges, else one more than the highest predecessor. Raises on a cycle."""
    e = checkpointed(edges.select("src", "dst").distinct())
    if not e.where("src = dst").isEmpty():
        raise ValueError("the graph has a cycle: a node leads to itself")
    left = checkpointed(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    out, level = None, 0
    while not left.isEmpty():
        now = left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        now = checkpointed(now.withColumn("level", F.lit(level)))
        if now.isEmpty():
            raise ValueError("the graph has a cycle")
        out = now if out is None else out.union(now)
        left = checkpointed(left.join(now, "id", "left_anti"))
        e = checkpointed(e.join(now.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return out if out is not None else edges.select(F.col("src").alias("id"), F.lit(0).alias("level")).limit(0)


def dependency_graph(imports: DataFrame) -> DataFrame:
    """src, dst, edge_type, count from imports (file_path, resolution struct<tag, value>); unresolved ones drop."""
    target = F.when(F.col("resolution.tag").isin("Resolved", "External"), F.col("resolution.value"))
    return imports.select(F.col("file_path").alias("src"), target.alias("dst")).where("dst is not null and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("count")).select("src", "dst", F.lit("import").alias("edge_type"), "count")


def symbol_graph(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """src, dst, edge_type, count over call and reference edges; a pair that has both is a call."""
    both = calls.select("src", "dst", F.lit(0).alias("k")).union(refs.select("src", "dst", F.lit(1).alias("k")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("count"), F.min("k").alias("k")).select("src", "dst", F.when(F.col("k") == 0, "call").otherwise("reference").alias("edge_type"), "count")


def module_graph(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """File dependencies (src, dst, count) rolled up by packages (file, package)."""
    a = packages.select(F.col("file").alias("src"), F.col("package").alias("p"))
    b = packages.select(F.col("file").alias("dst"), F.col("package").alias("q"))
    return deps.join(a, "src").join(b, "dst").groupBy(F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.sum("count").alias("count"))


def ego_net(edges: DataFrame, centre) -> DataFrame:
    """Edges both of whose ends are the centre or a direct neighbour of it."""
    near = edges.where((F.col("src") == F.lit(centre)) | (F.col("dst") == F.lit(centre)))
    ids = near.select(F.col("src").alias("id")).union(near.select("dst")).union(near.sparkSession.createDataFrame([(centre,)], ["id"])).distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


TYPE_KINDS = ("class", "interface", "struct", "enum", "trait")


def relation(child_kind, parent_kind):
    """struct<relation, confidence> of a child type and its parent."""
    cls, iface = ("class", "struct", "enum"), ("interface", "trait")
    pair = lambda r, c: F.struct(F.lit(r).alias("relation"), F.lit(c).alias("confidence"))
    return F.when(child_kind.isin(*cls) & parent_kind.isin(*cls), pair("extends", 0.9)).when(child_kind.isin(*cls) & parent_kind.isin(*iface), pair("implements", 0.9)).when(child_kind.isin(*iface) & parent_kind.isin(*iface), pair("extends", 0.8)).otherwise(pair("extends", 0.3))


def hierarchy(symbols: DataFrame) -> DataFrame:
    """src (child), dst (parent), relation, confidence from symbols (id, kind, parent_id); both ends must be types."""
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS))
    parents = types.select(F.col("id").alias("dst"), F.col("kind").alias("pk"))
    joined = types.select(F.col("id").alias("src"), "kind", F.col("parent_id").alias("dst")).join(parents, "dst").withColumn("r", relation(F.col("kind"), F.col("pk")))
    return joined.select("src", "dst", "r.relation", "r.confidence")


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return trace(edges, seeds, None).where("seed <> id")


def ancestor_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, n: how many distinct ancestors the nodes have that have any.

    Where no node has two parents, each node's jump up, with its length, doubles each round: log n rounds with a row for each node.
    With several parents, or a cycle, every pair of node and ancestor is traced.
    """
    links = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    most, count = links.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    up = links.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("open"))
    # A jump is open until it ends where nothing leads on; one that is longer than there are nodes runs in a ring.
    for _ in range(count.bit_length() + 1 if most == 1 else 0):
        far = up.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("n").alias("m"))
        # Sides of unknown size: no broadcast, whatever their files weigh.
        on = up.where("open").join(far.hint("merge"), "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.col("far").isNotNull().alias("open"))
        up = checkpointed(on.union(up.where("not open")))
        if up.where("open").isEmpty():
            return nodes.select("id").join(up.select("id", "n").hint("merge"), "id")
    return ancestors(links, nodes).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("n"))


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return trace(reverse(edges), seeds, None).where("seed <> id")


def implementations(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Types below the seeds along implements edges only."""
    return descendants(edges.where("relation = 'implements'"), seeds)
