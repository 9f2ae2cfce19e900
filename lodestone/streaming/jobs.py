"""Structured Streaming jobs. Each has a batch twin in operators/ that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import rate_limit
from lodestone.operators.lounge import LEASE_S

#: Rows that a stream's task gives at once.
SLICE = 1 << 14


def read_events(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    """A file of events, or the files of a folder, as a stream; ts becomes an instant, as watermarks need one."""
    # as a pattern, since the source takes a plain path for a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each record once, though it may be delivered again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Leases as session windows: one online span of an agent ends LEASE_S after its last record."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{LEASE_S} seconds"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_seconds("session_window.start").alias("start_s"), F.unix_seconds("session_window.end").alias("end_s"), "n")


def rates(events: DataFrame, window: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Events of each type in each window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n")


def presence_changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(did, state, at_s) whenever an agent comes online, changes its state, ends, or its lease runs out.

    A record older than the agent's last one changes nothing. Records later than `late` are dropped, so the delay must
    cover how far the files are out of order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            current, lease = state.get
            state.remove()
            gone = [] if current == "ended" else [(key[0], "offline", int(lease))]
            yield pd.DataFrame(gone, columns=["did", "state", "at_s"])
            return
        current, lease = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, kind in zip(rows["ts"].astype("int64") // 10**9 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].map(lambda x: int(x.timestamp())), rows["event_type"], strict=True):
            new = "ended" if kind == "error" else kind
            if ts + LEASE_S < lease:
                continue
            if current is not None and current != "ended" and ts >= lease:
                out.append((key[0], "offline", int(lease)))
                current = None
            if new != current:
                out.append((key[0], new, int(ts)))
            current, lease = new, int(ts) + LEASE_S
        # an ended one is remembered as long, so that a repeat in a later batch is no change
        state.update((current, lease))
        state.setTimeoutTimestamp(max(lease * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["did", "state", "at_s"])

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "did long, state string, at_s long", "state string, lease long", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket(calls: DataFrame, tokens: int = rate_limit.TOKENS, seconds: int = rate_limit.SECONDS, burst: int = rate_limit.BURST, late: str = "1 hour") -> DataFrame:
    """`rate_limit.token_bucket` of a stream (key, ms, id): a bucket's level and last call are its state.

    A bucket idle for the time that fills it is forgotten by a timer, which changes nothing: a new one is full. Calls are
    ordered within a micro-batch; one that comes in a later batch than a newer call is judged after it, at its time.
    Watermarks begin at 1970, so times before count as late and are dropped.
    """
    unit, full = 1000 * seconds, 1000 * seconds * burst

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, at = state.get if state.exists else (full, None)
        # of a micro-batch only times and ids are held, as arrays; what it gives leaves in slices
        ms, ids = (np.concatenate(c) for c in zip(*((b["ms"].to_numpy(), b["id"].to_numpy()) for b in batches), strict=True))
        order = np.lexsort((ids, ms)) if ids.dtype != object else pd.DataFrame({"ms": ms, "id": ids}).sort_values(["ms", "id"], kind="stable").index.to_numpy()
        for lo in range(0, len(order), SLICE):
            own = order[lo : lo + SLICE]
            passed, left = [], []
            for t in ms[own].tolist():
                level, ok = rate_limit.step(level, 0 if at is None else t - at, unit, tokens, full)
                at = t if at is None else max(at, t)
                passed.append(ok)
                left.append(level / unit)
            yield pd.DataFrame({"key": key[0], "ms": ms[own], "id": ids[own], "allowed": passed, "left": left})
        state.update((level, at))
        state.setTimeoutTimestamp(max(at + -(-full // tokens), state.getCurrentWatermarkMs() + 1))

    timed = calls.where("key IS NOT NULL AND ms IS NOT NULL").withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    schema = f"key {kinds['key']}, ms long, id {kinds['id']}, allowed boolean, left double"
    return timed.groupBy("key").applyInPandasWithState(take, schema, "level long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def apply_changes(changes: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches to a store: `fold(batch, number)` must be idempotent in the batch's number."""
    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run an appending stream over what is there, into Parquet under `folder`, and read the rows back."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
