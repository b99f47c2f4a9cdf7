"""Continuous forms of the jobs. Each takes a streaming DataFrame and is started with availableNow or any trigger.

State and checkpoints live below spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.vectors import assign_nearest
from tessera.sources.tables import shared_folder

ADMITTED = "user_id long, event_id long, ts timestamp, admitted boolean, remaining int, retry_after_s double"


def _admit(hits: deque, at: pd.Timestamp, limit: int, window_s: float) -> tuple[bool, int, float]:
    """Whether a hit at this time is let in; only hits that were let in count. hits holds at most `limit` times."""
    while hits and (at - hits[0]).total_seconds() >= window_s:
        hits.popleft()
    if len(hits) < limit:
        hits.append(at)
        return True, limit - len(hits), 0.0
    return False, 0, window_s - (at - hits[0]).total_seconds()


def rate_limited(events: DataFrame, limit: int, window_s: float) -> DataFrame:
    """Batch form: events (user_id, event_id, ts) in time order per user. Rows are sorted and streamed, so a user's
    rows are never gathered; the state is one short queue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, hits = None, deque()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.user_id != user:
                    user, hits = r.user_id, deque()
                out.append((r.user_id, r.event_id, r.ts, *_admit(hits, r.ts, limit, window_s)))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "admitted", "remaining", "retry_after_s"])

    rows = events.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "ts").repartition("user_id")
    return rows.sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, ADMITTED)


def rate_limited_stream(events: DataFrame, limit: int, window_s: float, late: str = "10 minutes") -> DataFrame:
    """Streaming form: the queue of each user is state; it ends when its last hit has left the window."""

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(pd.Timestamp(x) for x in (state.get[0] if state.exists else []))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = [(key[0], r.event_id, r.ts, *_admit(hits, r.ts, limit, window_s)) for r in rows.itertuples(index=False)]
        state.update(([x.to_pydatetime() for x in hits],))
        if hits:
            end = int((hits[-1].timestamp() + window_s) * 1000)
            if end > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "admitted", "remaining", "retry_after_s"])

    rows = events.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(run, ADMITTED, "hits array<timestamp>", "append", "EventTimeTimeout")


def lease_expiry_stream(events: DataFrame, lease_s: int = 60, limit: int = 3, forget_s: int = 86_400, late: str = "1 minute") -> DataFrame:
    """events (job_id, ts, kind): a job whose last heartbeat is older than the lease is queued again, or failed after `limit` expiries. A job that
    finishes, fails, or sends nothing for forget_s after it was queued again leaves no state; a heartbeat after that begins anew."""
    schema = "job_id long, last timestamp, new_status string"

    def run(key, batches, state):
        last, lost, waiting = state.get if state.exists else (None, 0, False)
        if state.hasTimedOut:
            if waiting:  # queued again, and not heard of since
                state.remove()
                return
            lost += 1
            yield pd.DataFrame([(key[0], last, "failed" if lost >= limit else "queued")], columns=["job_id", "last", "new_status"])
            if lost >= limit:
                state.remove()
                return
            state.update((last, lost, True))
            state.setTimeoutTimestamp(max(int((pd.Timestamp(last).timestamp() + lease_s + forget_s) * 1000), state.getCurrentWatermarkMs() + 1))
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        newest = rows.iloc[-1]
        if newest["kind"] == "finish":
            if state.exists:
                state.remove()
            return
        beat = newest["ts"] if last is None else max(pd.Timestamp(last), newest["ts"])
        state.update((beat.to_pydatetime(), lost, False))
        state.setTimeoutTimestamp(max(int((beat.timestamp() + lease_s) * 1000), state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(run, schema, "last timestamp, lost int, waiting boolean", "append", "EventTimeTimeout")


def assign_or_error(rows: DataFrame, centroids, threshold: float = 0.0) -> DataFrame:
    """rows (id, v) to (id, cluster, margin, error): the nearest topic, none under the margin threshold, and none, with the reason, for a vector that
    cannot be compared. No row fails the others."""
    width = centroids.shape[1]
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    error = F.when(F.col("v").isNull() | (F.size("v") == 0), "absent").when(F.size("v") != width, "width").when(odd, "not finite")
    marked = rows.select("id", "v", error.alias("error"))
    found = assign_nearest(marked.where("error IS NULL"), centroids)
    good = found.select("id", F.when(F.col("margin") >= threshold - 1e-9, F.col("cluster")).alias("cluster"), "margin", "error")
    return good.unionByName(marked.where("error IS NOT NULL").select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("margin"), "error"))


def windowed_kpis(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean value by tumbling window and type."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drain a stream (availableNow) into a table, one folder per micro-batch so that a repeated batch
    overwrites itself; the rows of the table."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made: list = []

    def write(df: DataFrame, batch: int) -> None:
        out = each(df) if each else df
        out.write.mode("overwrite").parquet(f"{base}/rows/batch={batch if mode == 'append' else 0}")
        made[:] = [out.schema]

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if not made:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(made[0]).parquet(f"{base}/rows").select(*made[0].names)
