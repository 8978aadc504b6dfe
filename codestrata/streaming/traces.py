"""Runtime traces, watches and limits, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def accumulate(calls: DataFrame, min_count: int = 1) -> DataFrame:
    """(caller, callee, n, total_ms, min_ms, max_ms, n_errors): works on a table and on a stream (update or complete mode)."""
    a = calls.groupBy("caller", "callee").agg(F.count("*").alias("n"), F.round(F.sum(F.col("ms").cast("decimal(18,6)")).cast("double"), 4).alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.count_if(F.col("callee") == "error").alias("n_errors"))
    return a.where(F.col("n") >= min_count)


def windowed(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts per window and callee of a stream; rows later than the watermark are dropped, as Structured Streaming defines."""
    return calls.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "callee").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "callee", "n")


def quiet_sessions(changes: DataFrame, gap: str = "1 minute", late: str = "10 minutes", key: str = "path", time: str = "ts") -> DataFrame:
    """Debounced changes: one row per key and run of changes with smaller gaps; the end of a session triggers a re-index."""
    return changes.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_since(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a rescan that the scan before did not have."""
    return after.select(*keys).dropDuplicates().join(before.select(*keys).dropDuplicates(), keys, "left_anti")


def merge_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None, keep: int = 2, **trigger):
    """Starts a query that merges each micro-batch into a parquet table by key; written to a new version each time, of which the last `keep` stay.

    order: the column by which the later row of a key wins, within a batch and against what is stored; without it a batch's row always
    replaces the stored one, and within a batch the greatest row wins. A batch that is run again starts from the version before it.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        versions = sorted(int(v[1:]) for v in found if v[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS")))
        before = [v for v in versions if v < batch_id]
        rest = [c for c in batch.columns if c not in keys]
        by = F.struct(*([order] if order else []), *[c for c in rest if c != order])
        latest = lambda d: d.groupBy(*keys).agg(F.max(by).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]) if rest else d.dropDuplicates(keys)
        out = fresh = latest(batch)
        if before:
            old = spark.read.parquet(f"{path}/v{before[-1]}")
            out = latest(old.unionByName(fresh)) if order else old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
        out.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in before[: max(0, len(before) + 1 - keep)]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def limited(requests: DataFrame, limit: int = 5, window_ms: int = 60_000) -> DataFrame:
    """(key, ts_ms, allowed) of a stream of (key, ts_ms): a fixed window per key that begins with its first hit."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        for b in batches:
            ok = []
            for t in b.sort_values("ts_ms").ts_ms:
                if start is None or t - start >= window_ms:
                    start, n = int(t), 0
                n += 1
                ok.append(n <= limit)
            yield pd.DataFrame({"key": key[0], "ts_ms": b.sort_values("ts_ms").ts_ms.to_numpy(), "allowed": ok})
        state.update((start, n))

    return requests.groupBy("key").applyInPandasWithState(run, "key string, ts_ms long, allowed boolean", "start long, n long", "append", "NoTimeout")
