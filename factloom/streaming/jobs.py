"""The job queue as a stream: outcome counts by event time, and leases that run out by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def outcome_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped, repeated event ids count once."""
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def drained(rows: DataFrame, folder: str) -> DataFrame:
    """The whole result of an aggregated stream after all that is there now; ``folder`` keeps its state and what each batch gave.

    A batch writes a folder of its number, so one that is run again after a stop takes the place of what it wrote before: the result is the same
    however the input falls into batches, and a later call with the same folder goes on from there. Nothing passes through the driver.
    """
    spark, batches = rows.sparkSession, f"{folder}/batches"
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{batches}/of_batch=-1")  # so that there is something to read without a batch

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{batches}/of_batch={n}")

    run = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    every = spark.read.parquet(batches)
    newest = every.agg(F.max("of_batch")).first()[0]
    return every.where(F.col("of_batch") == (-1 if newest is None else newest)).drop("of_batch")


LEASE = "id string, state string, at timestamp"


def leases(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """(id, state, at) of jobs that end, or whose lease runs out: ``events`` (id, kind: start, heartbeat or finish, ts, lease_ms)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (until,) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "state": ["expired"], "at": [pd.Timestamp(until, unit="ms")]})
            return
        until = state.get[0] if state.exists else None
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                if r.kind == "finish" and until is not None:
                    yield pd.DataFrame({"id": [key[0]], "state": ["finished"], "at": [r.ts]})
                    until = None
                elif r.kind != "finish":
                    until = int(r.ts.timestamp() * 1000) + int(r.lease_ms)
        if until is None:
            if state.exists:
                state.remove()
        else:
            state.update((until,))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("ts", late)
    return marked.groupBy("id").applyInPandasWithState(step, LEASE, "until long", "append", GroupStateTimeout.EventTimeTimeout)
