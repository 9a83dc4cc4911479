"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes the empty text; nothing else may change, as any other
change could change the count) with the digest of the tokenizer's file. Keys are joined to the counts stored under that
tokenizer version; of the distinct keys that miss, one document each is encoded, and the new counts are appended to the
cache (a Parquet folder partitioned by tokenizer version, so versions never mix and a scan prunes to one).

Shuffles: keys with a row key (small rows, combined on the map side), then one pass of the texts to their representatives
by that key; hot content collapses to one row before anything is encoded. A task that is lost re-encodes only its
own misses; an append that is repeated adds equal rows, which reading collapses.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated texts and rows share one entry and are each
reported, rows without doc_id too; texts of any length and with runs of any length are encoded whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.common import arrow, batched, bounded_batches, columns, materialise, scratch_path

CACHE = "digest binary, n_tokens long, tokenizer string"


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes")).withColumn("row", row_key("doc_id"))


def row_key(doc_id: str):
    """Identity of a row by its id, if any, and its text's digest."""
    return F.xxhash64(F.col(doc_id).cast("string"), "digest")


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts in the cache under this version, one row per digest; none where the cache does not exist yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, reps: DataFrame, tokenizer: str | None, doc_id: str, text: str) -> DataFrame:
    """digest, n_tokens of the representatives' texts (reps: rep, digest)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches):
        enc = bpe.encoder(tokenizer)
        yield from batched(((d, len(enc.ids(t)) if t else 0) for b in batches for d, t in zip(*columns(b, "digest", "t"))), schema)

    t = F.col(text).cast("string")
    keys = docs.select(F.col(doc_id).alias("_d"), t.alias("t"), F.unhex(F.sha2(F.coalesce(t, F.lit("")), 256)).alias("digest"))
    joined = keys.select("t", "digest", row_key("_d").alias("rep")).join(reps.select("rep").hint("merge"), "rep")
    return arrow(joined.select("digest", "t"), run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, cache: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens. New counts are in `cache` afterwards."""
    spark = docs.sparkSession
    version = bpe.version(tokenizer)
    keys = keyed(docs, doc_id, text)
    reps = keys.groupBy("digest").agg(F.min("row").alias("rep"))
    misses = reps.join(stored(spark, cache, version), "digest", "left_anti").select("rep", "digest")
    encode_misses(docs, misses, tokenizer, doc_id, text).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # Written, so that Spark can split the rows of one digest in the last join.
    known = materialise(reps.select("digest").join(stored(spark, cache, version), "digest"), "token-counts")
    return keys.join(known.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that every distinct text is encoded."""
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "token-cache"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)
