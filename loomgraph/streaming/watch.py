"""The change stream: files of events in; admitted, debounced, kept as pending state and synced."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from loomgraph.functions.text import language_of
from loomgraph.operators.sync import quiet_sessions
from loomgraph.sources.files import Rule, ignored, ignored_by_default


def change_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def admitted(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Events of source files that nothing ignores."""
    p = F.col("path")
    return events.filter(~ignored_by_default(p) & ~ignored(p, rules or []) & (language_of(p) != "unknown"))


def debounced(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """A session is emitted once the watermark has passed its quiet period, so state stays bounded."""
    return quiet_sessions(stream.withWatermark("ts", late), key, gap)


def pending_state(stream: DataFrame, quiet_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """Per path, as a stream: first_seen, last_seen and count of its events, given out and forgotten when it has been quiet for ``quiet_ms`` of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for b in batches:
            ts = b["ts"].astype("datetime64[us]").astype("int64")
            first = int(ts.min()) if first is None else min(first, int(ts.min()))
            last = int(ts.max()) if last is None else max(last, int(ts.max()))
            n += len(b)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + quiet_ms, state.getCurrentWatermarkMs() + 1))

    return stream.withWatermark("ts", late).groupBy("path").applyInPandasWithState(step, "path string, first_seen timestamp, last_seen timestamp, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def sync_stream(stream: DataFrame, sync: Callable[[list[str]], object], checkpoint: str):
    """Run ``sync`` with the paths of every micro-batch.  A batch whose sync fails isn't committed and comes again after a restart, so each change is synced at least once."""

    def one(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]
        if paths:
            sync(paths)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def may_watch(root: str, environment: dict[str, str] | None = None, release: str = "") -> bool:
    """Not where the environment says no, and not on a mounted Windows drive, which sends no events."""
    env = os.environ if environment is None else environment
    return env.get("LOOMGRAPH_NO_WATCH", "") in ("", "0") and not ("microsoft" in release.lower() and root.startswith("/mnt/"))
