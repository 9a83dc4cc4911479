"""Incremental maintenance: watched files, batches anchored at their first event, an index that follows them."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import LANGUAGES, extension
from sparkloom.operators.analysis import changed_only
from sparkloom.scratch import workers_find_us
from sparkloom.sources.crawl import ignore_regex
from sparkloom.warehouse import IndexMissing, Warehouse

EXTENSIONS = sorted(LANGUAGES)
log = logging.getLogger(__name__)


def watched(events: DataFrame, excludes: list[str] = ()) -> DataFrame:
    """Events (path, kind, ts) of files worth indexing: created, modified or removed, known extension, not excluded."""
    out = events.where(F.lower("kind").isin("create", "modify", "remove") & extension(F.col("path")).isin(*EXTENSIONS))
    for p in excludes:
        out = out.where(~F.col("path").rlike(ignore_regex(p)))
    return out


def folded(events: list[tuple[int, str]], start: int | None, paths: list[str], micros: int) -> tuple[list[tuple[int, list[str]]], int | None, list[str]]:
    """Batches that the events (time, path) close, and the batch that stays open: it opens at its first event."""
    done = []
    for t, path in sorted(events):
        if start is not None and t >= start + micros:
            done.append((start, sorted(set(paths))))
            start, paths = None, []
        start = t if start is None else start
        paths = [*paths, path] if path not in paths else paths
    return done, start, paths


def batches(events: DataFrame, millis: int = 500, watermark: str = "10 seconds") -> DataFrame:
    """root, batch_start, paths of a stream (root, path, ts): a batch opens at the first event of a root that waits and closes
    `millis` later, whatever comes in between; the state is one open batch for each root."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    workers_find_us(events.sparkSession)
    micros = millis * 1000

    def step(key, frames, state: GroupState):
        start, paths = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        if state.hasTimedOut:
            done, start, paths = [(start, sorted(set(paths)))] if start is not None else [], None, []
        else:
            rows = [(int(t.value // 1000) if t.unit == "ns" else int(t.as_unit("us").value), p) for f in frames for t, p in zip(f["ts"], f["path"])]
            done, start, paths = folded(rows, start, paths, micros)
        if start is None:
            state.remove()
        else:
            state.update((start, paths))
            state.setTimeoutTimestamp(max(start // 1000 + millis, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({"root": [key[0]] * len(done), "batch_start": pd.to_datetime([s for s, _ in done], unit="us"), "paths": [p for _, p in done]})

    return events.withWatermark("ts", watermark).groupBy("root").applyInPandasWithState(step, "root string, batch_start timestamp, paths array<string>", "start long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_files(spark: SparkSession, root: str, every: str = "2 seconds") -> tuple[DataFrame, dict]:
    """A stream of files under root, polled; the trigger to start it with."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    return s, {"processingTime": every}


def upsert(stored: DataFrame, fresh: DataFrame, removed: DataFrame) -> DataFrame:
    """stored without the rows of changed or removed files (file_path), and the fresh rows."""
    gone = fresh.select("file_path").union(removed.select("file_path")).distinct()
    return stored.join(gone, "file_path", "left_anti").unionByName(fresh)


def skip_unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    return changed_only(files.select(F.col("file_path").alias("path"), F.col("content_hash").alias("hash")), known.select(F.col("file_path").alias("path"), F.col("content_hash").alias("hash"))).select(F.col("path").alias("file_path"))


def keep_indexed(stream: DataFrame, warehouse: Warehouse, root: str, checkpoint: str, apply: Callable[[list[str]], object] | None = None, **trigger):
    """Reindex the paths of every closed batch (see batches); started only where an index stands.

    A batch that fails is logged and the loop goes on; a batch that is given again after a crash changes nothing, as files
    are compared by content and replaced by path.
    """
    if not warehouse.exists():
        raise IndexMissing(f"no index under {warehouse.path}: nothing to keep up to date")
    work = apply or (lambda paths: warehouse.reindex(root, paths))

    def run(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select(F.explode("paths").alias("path")).distinct().collect()]  # one batch of changes
        try:
            if paths:
                work(paths)
        except Exception:
            log.exception("batch %s was not indexed", number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
