"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, by DataFrame functions only.

A text is the set of 64-bit digests of its paragraphs (lines, long ones cut after the sentence that passes 100 characters).
A sketch hashes each digest into one cell of each of three tables; a cell holds a count, the XOR of its digests and the XOR of
their checksums. The fingerprint is the sketch of 24 cells in hexadecimal. Two texts' fingerprints are subtracted cell by cell,
whatever their size, and peeling (cells of count 1 whose checksum fits give a digest, which leaves its other cells) recovers
the digests in which they differ; likeness is then shared / (shared + differing). When peeling fails, larger sketches are
tried: digests are dealt to buckets of about eight, each with a sketch of its own, whose tables grow (`SIZES` cells) until the
bucket peels. Two digests that fall together in all three tables of the largest size (2^-48 for a pair) would never peel; only
then the bucket's sets are compared as they are, which is exact too.

Everything is an expression over one row's arrays, so no key gathers rows of other documents: a hot group costs nothing. The
dealing is in two levels, which keeps the work for very long texts near n^1.5.

The next document of each (descending ids, the last followed by the first) comes from a range partitioning of the ids alone,
joined at the partitions' edges; texts are shuffled once by id, and only as much of the next text as is needed goes on.

Defined results: null and empty texts have no digests and an all-zero sketch; two empty sets have likeness 1; a repeated id is
one place in the order, its text there is the one with the least hash, and each of its rows is reported; rows without doc_id
are one place too, after the smallest id; a single document follows itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise

#: A paragraph's piece: up to 100 characters and then up to 100 more to a sentence's end, within one line.
PIECE = r"[^\n]{1,100}[^.!?\n]{0,100}[.!?]*"
ROUNDS = 10
#: Cells of a table, and digests of both texts in a bucket.
SIZES, BUCKET = (4, 8, 32, 128, 1024, 65536), 8


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def prepared(keys: Column) -> Column:
    """The digests with their checksums and the bits that place them: in the three tables (u0, u1, u2) and in buckets (g, b)."""
    bits = lambda k, at: F.shiftrightunsigned(k, at).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k).alias("h"), bits(k, 0).alias("u0"), bits(k, 16).alias("u1"), bits(k, 32).alias("u2"), F.shiftrightunsigned(F.xxhash64(k), 8).bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("g"), F.shiftrightunsigned(F.xxhash64(k), 36).bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("b")))


def _entry(n, x, h) -> Column:
    return F.struct(n.alias("n"), x.alias("x"), h.alias("h"))


def sketch(keys: Column, c: int | Column) -> Column:
    """3 * c cells of prepared digests: count, XOR of digests, XOR of their checksums."""
    zero = _entry(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda s, p: _entry(s.n + 1, s.x.bitwiseXOR(p.k), s.h.bitwiseXOR(p.h))
    c = F.lit(c) if isinstance(c, int) else c

    def table(t: int) -> Column:
        return F.transform(F.sequence(F.lit(0), c - 1), lambda i: F.aggregate(F.filter(keys, lambda p: p[f"u{t}"].bitwiseAND(c - 1) == i), zero, add))

    return F.concat(*map(table, range(3)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: _entry(u.n - v.n, u.x.bitwiseXOR(v.x), u.h.bitwiseXOR(v.h)))


def peel(cells: Column, c: int | Column) -> Column:
    """Number of differing digests that peeling the subtracted cells recovers; null where cells remain."""
    c = F.lit(c) if isinstance(c, int) else c
    bits = lambda k, at: F.shiftrightunsigned(k, at).bitwiseAND((c - 1).cast("long")).cast("int") + c * (at // 16)
    pure = lambda cells: F.array_distinct(F.transform(F.filter(cells, lambda z: (F.abs(z.n) == 1) & (z.h == F.xxhash64(z.x))), lambda z: F.struct(z.x.alias("x"), z.n.alias("n"), z.h.alias("h"), bits(z.x, 0).alias("a"), bits(z.x, 16).alias("b"), bits(z.x, 32).alias("c"))))
    off = lambda z, q: _entry(z.n - q.n, z.x.bitwiseXOR(q.x), z.h.bitwiseXOR(q.h))

    def step(s: Column, _) -> Column:
        without = F.transform(s.cells, lambda z, i: F.aggregate(F.filter(s.pure, lambda q: (q.a == i) | (q.b == i) | (q.c == i)), z, off))
        found = s.found + F.size(s.pure)
        again = F.transform(F.array(without), lambda w: F.struct(w.alias("cells"), pure(w).alias("pure"), found.alias("found")))[0]
        return F.when(F.size(s.pure) == 0, s).otherwise(again)

    start = F.transform(F.array(cells), lambda w: F.struct(w.alias("cells"), pure(w).alias("pure"), F.lit(0).alias("found")))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(~F.exists(s.cells, lambda z: (z.n != 0) | (z.x != 0)), s.found))


def differing(a: Column, b: Column) -> Column:
    """Digests in one set and not in the other, of one bucket: larger sketches until one peels."""
    attempt = lambda c: peel(subtract(sketch(a, c), sketch(b, c)), c)
    peeled = F.aggregate(F.array(*map(F.lit, SIZES)), F.lit(None).cast("int"), lambda done, c: F.when(done.isNull(), attempt(c)).otherwise(done))
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(peeled, exact))


def side_of(a: Column, b: Column) -> Column:
    """Buckets are side * side, of about BUCKET digests of both texts."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(a) + F.size(b)) / F.lit(float(BUCKET)))).cast("int"))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column, side: Column) -> Column:
    """Shared digests over all digests, from the fingerprints' cells or else from larger sketches. a, b: prepared."""
    n = F.size(a) + F.size(b)

    def outer(g: Column) -> Column:
        one = F.struct(F.filter(a, lambda p: F.pmod(p.g, side) == g).alias("a"), F.filter(b, lambda p: F.pmod(p.g, side) == g).alias("b"))
        inner = lambda s: F.aggregate(F.sequence(F.lit(0), side - 1), F.lit(0), lambda acc, j: acc + F.transform(F.array(F.struct(F.filter(s.a, lambda p: F.pmod(p.b, side) == j).alias("a"), F.filter(s.b, lambda p: F.pmod(p.b, side) == j).alias("b"))), lambda t: differing(t.a, t.b))[0])
        return F.transform(F.array(one), inner)[0]

    buckets = F.aggregate(F.sequence(F.lit(0), side - 1), F.lit(0), lambda acc, g: acc + outer(g))
    # 24 cells give back 24 digests at most.
    d = F.when(a == b, F.lit(0)).otherwise(F.coalesce(F.when(F.abs(F.size(a) - F.size(b)) <= 24, peel(subtract(sketch_a, sketch_b), 8)), buckets))
    return F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d).cast("double"))


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda z: F.concat_ws(":", F.hex(z.n.cast("long")), F.hex(z.x), F.hex(z.h))), ";")


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id, next_id for distinct ids (doc_id): the next smaller id; the smallest is followed by the largest."""
    spark = ids.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = materialise(ids.repartitionByRange(n, "doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ids")
    edges = sorted((r.part, r.top) for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect())  # a row per partition
    tops = [t for _, t in edges]
    below = spark.createDataFrame([(p, tops[i - 1]) for i, (p, _) in enumerate(edges)], "part int, below long")
    w = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    return dealt.join(F.broadcast(below), "part").select("doc_id", F.coalesce(F.lead("doc_id").over(w), "below").alias("next_id"))


#: Place of the rows without doc_id, and reported as such.
NO_ID = -(1 << 63)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = F.col(doc_id).cast("long")
    d = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sizes = d.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    sizes = materialise(sizes, "sizes")
    pairs = next_ids(sizes.select("doc_id")).join(sizes.select("doc_id", F.floor(F.col("n") / 2).cast("int").alias("half")), "doc_id")
    source = d
    if sizes.where("rows > 1").limit(1).count():
        source = d.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    heads = source.join(pairs.select(F.col("doc_id").alias("own_id"), "next_id", "half").hint("merge"), F.col("doc_id") == F.col("next_id")).select("own_id", F.expr("left(text, half)").alias("head"), digests(F.col("text")).alias("next_keys"))
    both = d.join(heads, d.doc_id == heads.own_id).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "head", "next_keys")
    n = F.length("text")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.expr("left(head, cast(floor(length(text) / 2) as int))"))
    staged = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), digests(F.col("text")).alias("keys"), digests(edited).alias("edited_keys"), "next_keys")
    staged = materialise(staged.select("*", side_of(F.col("keys"), F.col("edited_keys")).alias("edited_side"), side_of(F.col("keys"), F.col("next_keys")).alias("next_side")), "digests")
    ready = staged.select("doc_id", "n_chars", "edited_sha256", "edited_side", "next_side", prepared(F.col("keys")).alias("k"), prepared(F.col("edited_keys")).alias("ek"), prepared(F.col("next_keys")).alias("nk"))
    cells = ready.select("*", sketch(F.col("k"), 8).alias("s"), sketch(F.col("ek"), 8).alias("e"))
    near = lambda b, sb, side: likeness(F.col("k"), F.col(b), F.col("s"), sb, F.col(side))
    return cells.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), near("ek", F.col("e"), "edited_side").alias("near_edited"), near("nk", sketch(F.col("nk"), 8), "next_side").alias("near_next"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
