"""WARC archives with an external index merge.

Writing: each task writes one archive per `roll` bytes (one gzip member per record) and the capture index of what it wrote
as a run sorted by (URL key, timestamp). Merging: the sorted runs are cut at common key boundaries, and for every key range
one task merges its pieces of all runs with a k-way loser tree, which gives globally ordered capture histories. Reading:
archives come back through Spark's binaryFile reader, so they may lie in any store Spark reads.

Payloads that are equal and of at least `min_bytes` are stored once: the record of the smallest page id is the response and
the others are revisits of it, which carry its digest and length, so that reading needs no join. Digests are aggregated on the
map side (digest, smallest id), so a page copied onto a third of all rows is one row per task there.

A run's piece of a key range is streamed in batches by the merging task, which holds one loser tree of k heads. A URL with
a third of all captures does not fill one task either: ranges are cut by (key, timestamp, page id).

Defined results: null html is the empty payload; null urls have the empty key; repeated page ids are each a capture, and a
repeated row of a response is a response; rows without page_id are responses, captured at the epoch, and first of their
history; an empty table gives no archives and no rows; other columns are ignored. Files are named by stage attempt and are only read
when the writing task has committed its index row, so a lost executor or a repeated task leaves nothing that is read twice.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, batched, bounded_batches, columns, materialise, release, scratch_path

#: Captures carry no time of their own in `pages`; a page's capture time is this epoch plus its id in seconds.
EPOCH = 1_600_000_000
#: Our own header of a revisit: bytes of the payload that it stands for.
LENGTH = "X-Payload-Length"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query (scheme, port 80/443, www and fragment dropped)."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").lower()
        port = u.port
    except ValueError:
        return f")/{url}"
    host = re.sub(r"^www\d*\.", "", host)
    tail = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{tail}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


class LoserTree:
    """Merge of k sorted iterators: a winner costs one comparison per level on the way from its leaf to the root."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and x is not None or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.tree[0]] is not None:
            w = self.tree[0]
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def record(kind: str, url: str, when: int, page_id: object, digest: str, payload: bytes, refers_to: object) -> bytes:
    """One WARC/1.1 record."""
    import datetime

    date = datetime.datetime.fromtimestamp(when, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), (LENGTH, str(len(payload)))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else b""


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one after another."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def record_at(data: bytes, offset: int, length: int) -> bytes:
    return zlib.decompress(data[offset : offset + length], 31)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _open(path: str):
    """Output stream in the shared folder, which may be in any store pyarrow knows."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
    store.create_dir(where.rpartition("/")[0], recursive=True)
    return store.open_output_stream(where, compression=None)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = 32 << 20) -> DataFrame:
    """Archives under `folder`; returns the runs: key, ts, page_id, kind, digest, file, offset, length, run."""
    spark = pages.sparkSession
    bounded_batches(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.unhex(F.sha1("html")))
    sized = p.where(F.octet_length("html") >= min_bytes).select("page_id", "sha1")
    # Written, so that Spark can split the rows of one digest in the join.
    firsts = materialise(sized.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "refers_to"), "firsts")
    revisits = materialise(sized.join(firsts, "sha1").where("page_id <> refers_to").distinct(), "revisits")
    release(firsts)
    typed = p.join(revisits, ["page_id", "sha1"], "left").drop("sha1")
    schema = pa.schema([("key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.string())])

    def run(batches):
        from pyspark import TaskContext

        c = TaskContext.get()
        name = f"run-{c.partitionId():05d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, at, part, rows = None, 0, 0, []
        for b in batches:
            for page_id, url, html, refers in zip(*columns(b, "page_id", "url", "html", "refers_to")):
                payload = html.encode()
                digest, kind, ts = base32(hashlib.sha1(payload).digest()), "response" if refers is None else "revisit", EPOCH + (page_id or 0)
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    path, at, part = f"{folder}/{name}-{part:04d}.warc.gz", 0, part + 1
                    out = _open(path)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(record(kind, url or "", ts, page_id, digest, payload, refers)) + z.flush()
                out.write(data)
                rows.append((url_key(url), ts, page_id, kind, digest, path.rpartition("/")[2], at, len(data), name))
                at += len(data)
        if out is not None:
            out.close()
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        yield from batched(iter(rows), schema)

    runs = materialise(arrow(typed, run, "key string, ts long, page_id long, kind string, digest string, file string, offset long, length long, run string"), "warc-runs")
    release(revisits)
    return runs


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' entries in global order of (key, ts, page_id), with their place in it: columns of runs and `part`, `pos`.

    Range partitioning deals every run's entries to key ranges; inside a range, each run's piece is sorted and a loser tree
    merges the k pieces.
    """
    names = runs.columns
    n = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = runs.repartitionByRange(n, "key", "ts", "page_id").sortWithinPartitions("run", "key", "ts", "page_id")
    schema = pa.schema([("key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.string()), ("part", pa.int32()), ("pos", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pieces: dict[str, list[pa.Table]] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            at, r = 0, b.column(names.index("run")).to_pylist()
            while at < len(r):
                end = at + 1
                while end < len(r) and r[end] == r[at]:
                    end += 1
                pieces.setdefault(r[at], []).append(t.slice(at, end - at))
                at = end

        def stream(tables):
            for t in tables:
                for batch in t.to_batches(max_chunksize=256):
                    yield from zip(*(c.to_pylist() for c in batch.columns))

        merged = LoserTree([(((x[0], x[1], x[2] or 0), x) for x in stream(t)) for t in pieces.values()])
        yield from batched(((*x, part, i) for i, (_, x) in enumerate(merged)), schema)

    return arrow(dealt.select(*names), run, "key string, ts long, page_id long, kind string, digest string, file string, offset long, length long, run string, part int, pos long")


RECORDS = "page_id long, url string, kind string, payload_bytes long, payload_digest string, refers_to long, file string, offset long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in the folder, none without a folder (join with a capture history to leave out files of lost attempts).

    A response's bytes and digest are those of its payload, checked against its record; a revisit's are those it carries.
    """
    bounded_batches(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])

    def number(x: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(found[1]) if found else None

    def run(batches):
        def out():
            for b in batches:
                for file, data in zip(*columns(b, "file", "content")):
                    left = io.BytesIO(data)
                    size = len(data)
                    offset = 0
                    while offset < size:
                        left.seek(offset)
                        d, raw = zlib.decompressobj(31), []
                        while not d.eof:
                            raw.append(d.decompress(left.read(1 << 16)))
                        end = left.tell() - len(d.unused_data)
                        h, payload = parse(b"".join(raw))
                        response = h["WARC-Type"] == "response"
                        told = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and base32(hashlib.sha1(payload).digest()) != told:
                            raise ValueError(f"{file} at {offset}: the payload has another digest than its record says")
                        yield number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], len(payload) if response else int(h[LENGTH]), told, number(h.get("WARC-Refers-To")), file, offset
                        offset = end

        yield from batched(out(), schema)

    return arrow(files, run, RECORDS)


def numbered(merged: DataFrame) -> DataFrame:
    """The merged entries with history_pos, their place in the whole history from 0."""
    merged = materialise(merged, "warc-history")
    sizes = sorted(merged.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    begins, at = [], 0
    for r in sizes:
        begins.append((r.part, at))
        at += r.n
    before = merged.sparkSession.createDataFrame(begins, "part int, before long")
    return merged.join(F.broadcast(before), "part").withColumn("history_pos", F.col("before") + F.col("pos")).drop("before")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive `pages`, merge the capture index, read the archives back; every record has its place in the merged history."""
    folder = scratch_path(spark, "warc")
    runs = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    history = numbered(merge_runs(runs)).select("file", "offset", "history_pos")
    placed = read_archives(spark, folder).join(history, ["file", "offset"])
    return placed.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "history_pos")


ORACLE_SQL = r"""
with p as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, coalesce(url, '') as url from pages
), u as (
    select *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[0-9]*\.', '') as host,
        regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q
    from p
), k as (
    select *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when path = '' then '/' else lower(path) end
        || case when q = '' then '' else '?' || lower(q) end as key, min(page_id) over (partition by h) as first
    from u
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as int) >> (15 - 5 * (i % 4))) & 31) + 1]), '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to,
    row_number() over (order by key, page_id) - 1 as history_pos
from k
"""
