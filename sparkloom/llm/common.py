"""What the training-data operators share: scratch tables, batches of bounded size, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        held = tempfile.TemporaryDirectory(prefix="sparkloom-")
        atexit.register(held.cleanup)
        _own_dirs[app] = f"file://{held.name}"
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's own switch: shuffle files of a finished write go at once, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Small rows (ids, labels) that one task writes at least, where their number is known.
FEW = 100_000


def materialise(df: DataFrame, name: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors.

    rows: about how many small rows there are at most; they are written in files of FEW, not one for each shuffle partition.
    """
    df = df if rows is None else df.coalesce(max(1, -(-rows // FEW)))
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for t in tables:
        delete_path(t.sparkSession, t.scratch)


#: Rows and bytes of an Arrow batch to a Python worker, for every operator: plans are lazy, so the value has to be one.
BATCH_ROWS, BATCH_BYTES = 2_000, "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers are bounded; the workers find this package and give memory back when it is free."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system: workers are used again and would keep what the largest task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def arrow(df: DataFrame, run: Callable, kind: str) -> DataFrame:
    """df.mapInArrow(run, kind); a worker gives its memory back after each task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, kind)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most `size` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Component of every node of `edges` (src long, dst long): columns node, component, the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round is two hash aggregations; a node's
    neighbourhood is only ever reduced to its minimum, never gathered. Self loops are allowed; an empty table gives an
    empty table. Tables between rounds are written to the shared folder and deleted when the next one stands. Rounds grow
    with the logarithm of the nodes squared at most; raises if the last round still changes something.
    """
    e = materialise(contract(edges.where("src is not null and dst is not null").select("src", "dst")).distinct(), "cc")
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    star, before, size = e, None, e.count()
    for _ in range(max_rounds):
        last, star = star, materialise(_small_star(_large_star(star)), "cc", rows=size)
        if last is not e:
            release(last)
        n, s = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, s) == before:
            break
        before = (n, s)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    label = star.where("u <> v").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Nodes that contract() holds at a time.
HELD = 300_000


def contract(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars u, v around the smallest node, self loops kept: as connected, with short paths.

    A task holds at most about HELD nodes; then it hands on the stars that it has and begins anew.
    """
    bounded_batches(edges.sparkSession)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        root: dict[int, int] = {}

        def find(i):
            while (r := root[i]) != i:
                root[i] = r = root[r]
                i = r
            return i

        for b in batches:
            for a, z in zip(*columns(b, "src", "dst")):
                root.setdefault(a, a)
                root.setdefault(z, z)
                a, z = find(a), find(z)
                if a != z:
                    root[max(a, z)] = min(a, z)
            if len(root) > HELD:
                yield from batched(((i, find(i)) for i in root), schema)
                root.clear()
        yield from batched(((i, find(i)) for i in root), schema)

    return arrow(edges, run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m <> u").select("u", F.col("m").alias("v"))).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
