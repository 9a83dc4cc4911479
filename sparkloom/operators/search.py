"""Full-text search: inverted index, BM25, phrases, a boolean query language.

An index is two tables: postings (id, field, term, tf, dl, places) and field statistics (field, n, avgdl). Stored, they answer
any query by one scan of the query's terms; without them the same plan runs on postings made on the fly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import tokens
from sparkloom.scratch import checkpointed

K1, B = 1.2, 0.75


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(r"[^\W_]+", text.lower()) if len(t.encode()) <= 40]


@dataclass
class Index:
    postings: DataFrame
    stats: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, fields: list[str], terms: list[str] | None = None) -> Index:
        """Of documents (id and text fields). terms: the only ones kept, filtered where the text is read."""
        columns = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])
        each = docs.select("id", F.explode(columns).alias("f")).select("id", "f.field", "f.t")
        stats = each.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
        placed = F.transform(F.col("t"), lambda x, i: F.struct(x.alias("term"), i.alias("place")))
        if terms is not None:
            # One look at the texts: beside its hits a document has a row without a term, which the statistics are counted from.
            bare = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("place")))
            placed = F.concat(bare, F.filter(placed, lambda p: p.term.isin(terms) if terms else F.lit(False)))
        hits = each.select("id", "field", F.size("t").alias("dl"), F.explode(placed).alias("p"))
        grouped = hits.groupBy("id", "field", "dl", F.col("p.term").alias("term")).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("p.place")).alias("places"))
        postings = grouped.select("id", "field", "term", "tf", "dl", "places")
        if terms is None:
            return cls(postings, stats)
        held = checkpointed(postings)
        sizes = held.where("term is null").groupBy("field").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avgdl"))
        return cls(held.where("term is not null"), checkpointed(sizes))

    def hits(self, terms: list[str], fields: list[str]) -> DataFrame:
        """Postings of the terms in the fields: a filter that a stored index hands to its scan."""
        return self.postings.where(F.col("term").isin(terms) & F.col("field").isin(fields))

    def scored(self, hits: DataFrame, weights: dict[str, float]) -> DataFrame:
        """id, field, term, score of the given postings."""
        # Rows of statistics: one for each field, one for each field and term of the query.
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
        s = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(self.stats), "field")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("field"))
        return s.select("id", "field", "term", (weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("score"))


def bm25(docs: DataFrame | Index, query: str, weights: dict[str, float]) -> DataFrame:
    """id, score of the documents (or of a stored index) with any query term."""
    terms = list(dict.fromkeys(terms_of(query)))
    index = docs if isinstance(docs, Index) else Index.of(docs, list(weights), terms)
    return index.scored(index.hits(terms, list(weights)), weights).groupBy("id").agg(F.sum("score").alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def phrase(docs: DataFrame, field: str, words: str) -> DataFrame:
    """Documents in which the words follow one another."""
    # Tokens hold no spaces, so a run of tokens is a run of the joined text between spaces.
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col(field), F.lit(""))), " "), F.lit(" "))
    return docs.where(joined.contains(f" {' '.join(terms_of(words))} "))


def phrase_hits(index: Index, field: str, words: str) -> DataFrame:
    """id of the documents whose places of the words follow one another."""
    terms = terms_of(words)
    hits = index.hits(terms, [field])
    if not terms:
        return hits.select("id").limit(0)
    offsets = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)]))
    begins = hits.select("id", "term", "places", offsets.alias("o")).where("term = o.t").select("id", F.transform("places", lambda p: p - F.col("o.i")).alias("begins"))
    runs = begins.select("id", F.explode("begins").alias("at")).groupBy("id", "at").agg(F.count("*").alias("n"))
    return runs.where(F.col("n") == len(terms)).select("id").distinct()


@dataclass
class Leaf:
    text: str
    field: str | None = None
    is_phrase: bool = False
    boost: float = 1.0


@dataclass
class Group:
    """Clauses with how each counts: + must match, - must not, empty may."""

    clauses: list[tuple[str, Leaf | Group]]


_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<word>AND|OR|NOT)(?![\w:])|(?P<sign>[+-])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<term>[^\s()"+:^]+))(?:\^(?P<boost>\d+(?:\.\d+)?))?)')


def parse_query(text: str) -> Group:
    """The tree of a query: words, "phrases", +must, -not, field:word, word^boost, AND, OR, NOT, parentheses.

    AND binds more than OR, and what stands side by side may each match. Bad syntax raises ValueError.
    """
    found, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"bad query at {text[at:at + 20]!r}")
        found.append(m.groupdict())
        at = m.end()
    at = 0

    def peek(name):
        return at < len(found) and found[at][name]

    def unit():
        nonlocal at
        sign = ""
        while peek("sign") or peek("word") == "NOT":
            sign = found[at]["sign"] or "-"
            at += 1
        if at == len(found) or peek("close") or peek("word"):
            raise ValueError("an operator stands without what it joins")
        t = found[at]
        at += 1
        if t["open"]:
            inner = either()
            if not peek("close"):
                raise ValueError("a parenthesis is not closed")
            at += 1
            return sign, inner
        is_phrase = t["phrase"] is not None
        return sign, Leaf(t["phrase"] if is_phrase else t["term"], t["field"], is_phrase, float(t["boost"] or 1))

    def both():
        nonlocal at
        parts = [unit()]
        while peek("word") == "AND":
            at += 1
            parts.append(unit())
        return parts[0] if len(parts) == 1 else ("", Group([(s or "+", x) for s, x in parts]))

    def either():
        nonlocal at
        parts = [both()]
        while at < len(found) and not peek("close"):
            if peek("word") == "OR":
                at += 1
            elif peek("word") == "AND":
                raise ValueError("an operator stands without what it joins")
            parts.append(both())
        return Group(parts)

    if not found:
        raise ValueError("the query is empty")
    tree = either()
    if at < len(found):
        raise ValueError("a parenthesis is closed that was not open")
    return tree


def leaves(node: Leaf | Group) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for _, c in node.clauses for x in leaves(c)]


def search(docs: DataFrame | Index, query: str, default_field: str = "name", ids: DataFrame | None = None) -> DataFrame:
    """id, score for the query language over documents or a stored index; `*` alone matches all of docs (or ids)."""
    everything = ids if isinstance(docs, Index) else docs
    if query.strip() == "*":
        return everything.select("id", F.lit(1.0).alias("score"))
    tree = parse_query(query)
    found = leaves(tree)
    fields = sorted({x.field or default_field for x in found})
    index = docs if isinstance(docs, Index) else Index.of(docs, fields, sorted({t for x in found for t in terms_of(x.text)}))

    def run(node: Leaf | Group) -> DataFrame:
        if isinstance(node, Leaf):
            field = node.field or default_field
            hit = bm25(index, node.text, {field: node.boost})
            return hit.join(phrase_hits(index, field, node.text), "id", "left_semi") if node.is_phrase else hit
        parts = [run(c).withColumn("must", F.lit(int(s == "+"))) for s, c in node.clauses if s != "-"]
        out = reduce(DataFrame.union, parts) if parts else everything.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("must"))
        needed = sum(s == "+" for s, _ in node.clauses)
        out = out.groupBy("id").agg(F.sum("score").alias("score"), F.sum("must").alias("met")).where(F.col("met") == needed).select("id", "score")
        for s, c in node.clauses:
            if s == "-":
                out = out.join(run(c).select("id"), "id", "left_anti")
        return out

    return run(tree)
