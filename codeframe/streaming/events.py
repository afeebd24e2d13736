"""Event streams: throttles, cooldowns, debounce windows, and an upsert sink.

Each operator has a batch form over a bounded table, and the same semantics as a
streaming form with state per key and a watermark that bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeframe.operators import overlay


def throttle_batch(events: DataFrame, key: str, ts: str, order: str, seconds: float) -> DataFrame:
    """Leading edge: an event is emitted if none of its key was in the last ``seconds``.

    The walk over a key is sequential by nature; it streams sorted batches and keeps one
    time per key, so a hot key costs time but no memory.
    """
    schema = events.schema

    gap = np.timedelta64(round(seconds * 1e9), "ns")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for b in batches:
            times, keep = b[ts].to_numpy().astype("datetime64[ns]"), np.zeros(len(b), bool)
            new = np.append(True, b[key].to_numpy()[1:] != b[key].to_numpy()[:-1])
            starts = np.append(np.nonzero(new)[0], len(b))
            for s, e in zip(starts[:-1], starts[1:]):
                k = b[key].iloc[s]
                # from one emitted event straight to the next that may be
                at = s if k != last_key or last is None else s + np.searchsorted(times[s:e], last + gap)
                while at < e:
                    keep[at] = True
                    last = times[at]
                    at = s + np.searchsorted(times[s:e], last + gap)
                if k != last_key and not keep[s:e].any():
                    last = None
                last_key = k
            yield b[keep]

    return events.repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(run, schema)


def throttle_stream(events: DataFrame, key: str, ts: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """The same on a stream: state is the last emitted time of a key and goes when the watermark passes it by ``seconds``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for f in frames:
            for t in sorted(f[ts]):
                if last is None or (t - last).total_seconds() >= seconds:
                    out.append((k[0], t))
                    last = t
        if last is not None:
            state.update((int(last.value // 1000),))
            at = int(last.value // 1_000_000 + seconds * 1000)
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts"])

    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, "key string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_stream(events: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """One event per key and cooldown: a repeat within ``window`` of the first is dropped."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def debounce(events: DataFrame, ts: str, path: str, width: str) -> DataFrame:
    """Tumbling windows with the number of different paths: start, paths."""
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count_distinct(path).alias("paths")).select(F.col("w.start").alias("start"), "paths")


def debounce_stream(events: DataFrame, ts: str, path: str, width: str, late: str) -> DataFrame:
    """On a stream: the paths of each window, emitted when the watermark closes it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.collect_set(path).alias("paths")).select(F.col("w.start").alias("start"), "paths")


def as_json(events: DataFrame, kind: str, *payload: str) -> DataFrame:
    """One JSON string per event: {"type": ..., "payload": {...}}."""
    return events.select(F.to_json(F.struct(F.col(kind).alias("type"), F.struct(*payload).alias("payload"))).alias("value"))


def upsert_layers(store: str):
    """A foreachBatch sink: the store holds the last write of every (layer, hash), one version per batch.

    A batch writes a new version beside the old one, and readers take the newest complete
    one, so a batch that is run again after a failure changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = current_layers(spark, store, below=epoch)
        rows = batch if old is None else old.unionByName(batch.select(*old.columns))
        overlay.last_writes(rows).write.mode("overwrite").parquet(f"{store}/v{epoch:012d}")

    return write


def current_layers(spark, store: str, below: int | None = None) -> DataFrame | None:
    """The newest version that is complete (has _SUCCESS), optionally before an epoch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS")) and (below is None or int(n[1:]) < below)]
    return spark.read.parquet(f"{store}/{done[-1]}") if done else None


def latest_per_key(events: DataFrame, key: str, ts: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(ts))
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
