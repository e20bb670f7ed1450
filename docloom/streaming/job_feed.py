"""Jobs as a stream: one active job for each version, across micro-batches and restarts; a worker; and states of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docloom.operators.versions import next_states


def read_jobs(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def accept_once(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One job of each version within the watermark's reach; state older than ``delay`` is dropped."""
    return jobs.withWatermark("requested_at", delay).dropDuplicatesWithinWatermark(["version_id"])


#: Events of a job in the order that those of one moment count.
EVENTS = ("queued", "running", "succeeded", "failed")


def _next(active: tuple[int, str] | None, job: int, event: str) -> tuple[tuple[int, str] | None, str]:
    """A version's active job and its state after an event, and what became of the event."""
    if event == "queued":
        return ((job, "queued"), "accepted") if active is None else (active, "refused")
    if event == "running" and active == (job, "queued"):
        return (job, "running"), "started"
    if event in ("succeeded", "failed") and active == (job, "running"):
        return None, "ended"
    return active, "ignored"


def admit(events: DataFrame) -> DataFrame:
    """A stream of job events (version_id, job_id, at, event of ``EVENTS``), each with its ``outcome``: accepted, refused, started, ended or ignored.

    A version has one active job at most: a request is refused from when another, or the same, was accepted until that one ends, however long it
    takes; then the version is free again. A job starts only once it was accepted and ends only once it has started; all else is ignored. The state is
    the active job of each version, kept in the stream's checkpoint; a version without one has none. Events of one micro-batch count in the order
    of time, job and ``EVENTS``, later micro-batches after earlier ones. Events that lack a value or have another name are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event"))
    slim = events.select(F.col("version_id").cast("long"), F.col("job_id").cast("long"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "event", rank.cast("int").alias("rank")).dropna().where("rank > 0")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["at", "job_id", "rank"], kind="stable", ignore_index=True)
        active, outcomes = (state.get if state.exists else None), []
        for job, event in zip(frame["job_id"].tolist(), frame["event"].tolist(), strict=True):
            active, outcome = _next(active, job, event)
            outcomes.append(outcome)
        if active is not None:
            state.update(active)
        elif state.exists:
            state.remove()
        yield frame.assign(outcome=outcomes)[["version_id", "job_id", "at", "event", "outcome"]]

    found = slim.groupBy("version_id").applyInPandasWithState(run, "version_id long, job_id long, at long, event string, outcome string", "job_id long, state string", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("at", F.timestamp_micros("at").cast(events.schema["at"].dataType))


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream has now to a Parquet table, each row once also after a restart, and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_off(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on the jobs of each micro-batch that is there, and stops when none is left.

    A batch writes a folder of its own under ``out``, so one that is run again after a failure replaces what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed_jobs(events: DataFrame) -> DataFrame:
    """Jobs that have failed, with their error; of a table of events as ``next_states`` takes."""
    return next_states(events).where(F.col("state") == "failed").select("job_id", "finished_at", "error")
