"""Streaming jobs: continuous upsert, job status, routing by workflow."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sowmill.sources.merge import latest_per_key

#: States that end a job.
ENDS = ("completed", "error")

# --- batch forms, shared with the streams ---------------------------------------------------------


def latest_status(events: DataFrame, job: str = "job_id", status: str = "status", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest status per job; max_by keeps one row per job and task, so a hot job does not pile up."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(ts, tie)).alias(status), F.max(ts).alias("updated_at"))


def job_states(events: DataFrame, stuck_after: int | None = None, as_of: Column | None = None, job: str = "job_id", status: str = "status", ts: str = "ts",
               tie: str = "event_id") -> DataFrame:
    """(job, status, reason, since) by allowed moves alone: queued, then processing, then completed or error.

    A job starts queued; its first processing event moves it on, and the first
    completed or error event after that ends it. All other events change
    nothing: completed before processing, anything after the end, unknown or
    repeated ones. Order is by time, then by ``tie``, whatever order events come
    in. A job that is still processing ``stuck_after`` seconds later, by its
    next event or by ``as_of``, ends as error with the reason ``stuck``. An
    event without a time or a job is ignored.

    Both steps are minima, so a job with very many events costs no task more.
    """
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    known = events.where(F.col(ts).isNotNull() & F.col(job).isNotNull())
    begun = known.groupBy(job).agg(F.min(F.when(F.col(status) == "processing", at)).alias("_p"))
    ends = known.where(F.col(status).isin(*ENDS)).select(job, at.alias("_at"), F.col(status).alias("_end"))
    ended = ends.join(begun.where(F.col("_p").isNotNull()), job).where(F.col("_at") > F.col("_p")).groupBy(job) \
        .agg(F.min(F.struct("_at.ts", "_at.tie", F.col("_end").alias("status"))).alias("_e"))
    found = begun.join(ended, job, "left")
    limit = F.lit(None).cast("timestamp") if stuck_after is None else F.col("_p.ts") + F.make_interval(secs=F.lit(stuck_after))
    stuck = F.coalesce(F.coalesce(F.col("_e.ts"), F.lit(None) if as_of is None else as_of) >= limit, F.lit(False))
    return found.select(
        job, F.when(F.col("_p").isNull(), "queued").when(stuck, "error").when(F.col("_e").isNotNull(), F.col("_e.status")).otherwise("processing").alias("status"),
        F.when(stuck, "stuck").alias("reason"), F.when(stuck, limit).otherwise(F.coalesce("_e.ts", "_p.ts")).alias("since"))


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Historical SOWs, kept with confidence 1.0, and new ones, which need a plan."""
    kind = F.col("processing_type")
    return df.where(kind == "historical").withColumn("confidence", F.lit(1.0)), df.where(kind == "new_staffing")


def list_jobs(jobs: DataFrame, status: DataFrame, processing_type: str | None = None) -> DataFrame:
    """Jobs with their status, all of them or of one processing type; a job without events is queued."""
    wanted = jobs if processing_type is None else jobs.where(F.col("processing_type") == processing_type)
    return wanted.join(status, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))


# --- streams ---------------------------------------------------------------------------------------


def read_store(spark: SparkSession, path: str, key: str, order: str | list[str]) -> DataFrame | None:
    """Newest row per key of an upserted table, the later batch where orders are equal; None before the first batch."""
    try:
        log = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return latest_per_key(log, key, F.struct(*_names(order), "batch")).drop("batch")


def _names(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else order


def upsert_batch(path: str, key: str, order: str | list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the newest row per key of a batch to the log of a table.

    A batch costs what it holds, whatever the size of the table; it replaces
    its own part of the log, so one that runs again after a failure changes
    nothing. Rows of late files lose to newer ones when the log is read.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(batch, key, F.struct(*_names(order)))
        newest.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return apply


def compact_store(spark: SparkSession, path: str, fresh: str, key: str, order: str | list[str]) -> None:
    """Write the newest rows of a table as the first part of a fresh log, which then takes the place of the old one."""
    rows = read_store(spark, path, key, order)
    if rows is not None:
        rows.write.mode("overwrite").parquet(os.path.join(fresh, "batch=-1"))


def stream_upsert(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, key: str, order: str | list[str],
                  checkpoint: str) -> StreamingQuery:
    """New files are transformed and put into the table, newest row per key."""
    return (transform(source).writeStream.foreachBatch(upsert_batch(path, key, order))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_status(events: DataFrame, path: str, checkpoint: str, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> StreamingQuery:
    """Newest event per job, in a table that ``read_store`` reads; late and repeated events do no harm, since the newest counts."""
    return stream_upsert(events, lambda df: df, path, job, list(order), checkpoint)


class JobMoves:
    """What decides the state of a job: its first processing event, the first end after that, and earlier ends.

    An earlier end counts if a processing event from before it comes late, so
    it is kept until the watermark has passed it.
    """

    def __init__(self, text: str | None = None):
        begun, end, early, self.version = json.loads(text) if text else (None, None, [], 0)
        self.begun, self.end, self.early = begun and tuple(begun), end and tuple(end), [tuple(e) for e in early]

    def text(self) -> str:
        return json.dumps([self.begun, self.end, self.early, self.version])

    def add(self, events: list[tuple[int, int, str]], watermark: int) -> None:
        """Events are (time in microseconds, tie, status); those from before the watermark are too late."""
        events = [e for e in events if e[0] >= watermark]
        self.begun = min([e[:2] for e in events if e[2] == "processing"] + ([self.begun] if self.begun else []), default=None)
        ends = sorted({*self.early, *([self.end] if self.end else []), *[e for e in events if e[2] in ENDS]})
        after = [e for e in ends if self.begun and e[:2] > self.begun]
        self.end = after[0] if after else None
        self.early = [e for e in ends if e[0] >= watermark and not (self.begun and e[:2] > self.begun)]

    def state(self, stuck: int | None, watermark: int) -> tuple[str, str | None, int | None]:
        """(status, reason, since) as of the watermark."""
        if not self.begun:
            return "queued", None, None
        limit = None if stuck is None else self.begun[0] + stuck
        if limit is not None and (self.end[0] if self.end else watermark) >= limit:
            return "error", "stuck", limit
        return (self.end[2], None, self.end[0]) if self.end else ("processing", None, self.begun[0])


def stream_job_states(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", stuck_after: int | None = None, job: str = "job_id", status: str = "status",
                      ts: str = "ts", tie: str = "event_id") -> StreamingQuery:
    """The states of ``job_states`` kept as events come, in a table that ``read_store`` reads by ``version``.

    Events may come in any order and more than once; one that is older than the
    watermark (``late`` behind the newest) changes nothing. A timer ends a job
    that is processing when the watermark passes ``stuck_after`` seconds. State
    is a few events per job.
    """
    stuck = None if stuck_after is None else stuck_after * 1_000_000
    key = events.schema[job].dataType.simpleString()
    micros = F.unix_micros(F.col(ts))
    source = events.where(F.col(ts).isNotNull() & F.col(job).isNotNull()).withWatermark(ts, late) \
        .select(job, ts, micros.alias("_us"), F.col(tie).cast("long").alias("_tie"), F.col(status).alias("_status"))

    def move(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moves, watermark = JobMoves(state.get[0] if state.exists else None), state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for frame in frames:
                moves.add(list(zip(frame["_us"].tolist(), frame["_tie"].tolist(), frame["_status"].tolist(), strict=True)), watermark)
        moves.version += 1
        state.update((moves.text(),))
        found, reason, since = moves.state(stuck, watermark)
        if found == "processing" and stuck is not None:
            state.setTimeoutTimestamp((moves.begun[0] + stuck) // 1000 + 1)
        yield pd.DataFrame({job: [group[0]], "status": [found], "reason": [reason], "since_us": pd.array([since], dtype="Int64"), "version": [moves.version]})

    states = source.groupBy(job).applyInPandasWithState(move, f"{job} {key}, status string, reason string, since_us long, version long", "moves string", "update",
                                                        GroupStateTimeout.EventTimeTimeout)
    shown = states.select(job, "status", "reason", F.timestamp_micros("since_us").alias("since"), "version")
    return (shown.writeStream.outputMode("update").foreachBatch(upsert_batch(path, job, "version")).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_route(source: DataFrame, path: str, plan: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Write historical rows and planned new rows under ``path`` per batch; a batch that runs again replaces its own part."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            old, new = route(batch)
            old.write.mode("overwrite").parquet(os.path.join(path, "historical", f"batch={batch_id}"))
            plan(new).write.mode("overwrite").parquet(os.path.join(path, "planned", f"batch={batch_id}"))
        finally:
            batch.unpersist()

    return (source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
