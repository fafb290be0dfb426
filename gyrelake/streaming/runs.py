"""Running work under watch: heartbeats and cancellation as a stream with timers, job tags, gapless numbers of appended events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gyrelake.plans.commits import Store

ENDED = "run_id string, status string, reason string, at_ms long"


def watch(signals: DataFrame, lease_ms: int = 30_000, watermark: str = "1 second", clock: str = "event") -> DataFrame:
    """A stream of runs that ended: ``cancelled`` on request or when a heartbeat is missing for ``lease_ms``, or ``finished``.

    signals: a stream of run_id, kind ('start', 'beat', 'cancel', 'finish') and ts. A run lives from its first
    signal to its end; what comes after is not heard until it starts again. Missing heartbeats are noticed by timers: of event time
    (a run is late when the whole stream is past its lease) or, with ``clock='processing'``, of the cluster's time.
    State is a few numbers for each run that lives or has ended within a lease.
    """
    if lease_ms < 1:
        raise ValueError("a lease lasts a millisecond at least")
    timed = clock == "event"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lives, last = state.get if state.exists else (True, 0)
        if state.hasTimedOut:
            state.remove()
            if lives:
                yield pd.DataFrame({"run_id": [key[0]], "status": ["cancelled"], "reason": ["heartbeat"], "at_ms": [last + lease_ms]})
            return
        heard = sorted((int(ts.timestamp() * 1000), kind) for part in parts for kind, ts in zip(part["kind"], part["ts"], strict=True))
        out = []
        for at, kind in heard:
            if lives and last and timed and at - last > lease_ms:  # silent for longer than its lease, whatever came later
                out.append((key[0], "cancelled", "heartbeat", last + lease_ms))
                lives = False
            if kind == "start" and not lives:
                lives = True
            if lives and kind in ("cancel", "finish"):
                out.append((key[0], "cancelled" if kind == "cancel" else "finished", "requested" if kind == "cancel" else None, at))
                lives = False
            last = max(last, at)
        state.update((lives, last))
        if timed:
            state.setTimeoutTimestamp(max(last + lease_ms, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame(out, columns=["run_id", "status", "reason", "at_ms"]).astype({"at_ms": "int64"})

    stream = signals.select(F.col("run_id").cast("string").alias("run_id"), "kind", "ts").where("run_id is not null and kind is not null and ts is not null")
    if timed:
        stream = stream.withWatermark("ts", watermark)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("run_id").applyInPandasWithState(step, ENDED, "lives boolean, last long", "append", timeout)


def tag(run_id: str) -> str:
    return "run-" + "".join(c if c.isalnum() else "_" for c in run_id)


def under_tag(spark: SparkSession, run_id: str, work: Callable[[], object]) -> object:
    """Calls ``work``; the Spark jobs that it starts from this thread carry the run's tag."""
    sc, name = spark.sparkContext, tag(run_id)
    sc.addJobTag(name)
    try:
        return work()
    finally:
        sc.removeJobTag(name)


def cancel_ended(spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``watch``: ends the jobs of every run that was cancelled in the batch."""

    def stop(batch: DataFrame, _: int) -> None:
        for row in batch.where("status = 'cancelled'").select("run_id").distinct().toLocalIterator():  # runs that ended in this batch
            spark.sparkContext.cancelJobsWithTag(tag(row["run_id"]))

    return stop


def numbered(rows: DataFrame, order: list, scratch: str, first: int = 1, column: str = "sequence", partitions: int | None = None) -> DataFrame:
    """rows with gapless numbers from ``first`` in the given order (ties in any order).

    Rows are range-partitioned and written under ``scratch``, a folder that all executors share, so that a lost task gives
    the same partition again; partitions are counted, and each row's number is its place plus the rows of all partitions before. A count for each
    partition goes to the driver and back (there are as many as shuffle partitions), no row does.
    """
    spark = rows.sparkSession
    path = f"{scratch.rstrip('/')}/numbered-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumns({"part__": F.spark_partition_id(), "place__": F.monotonically_increasing_id()})
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    counts, before, rest = stored.groupBy("part__").count().collect(), {}, first
    for part, n in sorted(counts):
        before[part], rest = rest, rest + n
    # the place counts within the partition; a partition's number stands in its upper bits
    offsets = spark.createDataFrame(sorted(before.items()), "part__ int, before__ long")
    joined = stored.join(F.broadcast(offsets), "part__")  # a row for each shuffle partition
    return joined.withColumn(column, F.col("before__") + F.col("place__").bitwiseAND((1 << 33) - 1)).drop("part__", "place__", "before__")


def append_events(store: Store, batch: DataFrame, batch_id: int, order: list, scratch: str, source: str = "events") -> int:
    """Adds a batch of ``foreachBatch`` to the store's ``events`` with the next sequence numbers; returns the head.

    The rows, the head and the batch's number are one commit, so that a batch that is played again changes nothing and no number
    is given twice or left out.
    """
    base, notes = store.version(), store.notes()
    head = int(notes.get(f"{source}.head", 0))
    if batch_id <= int(notes.get(f"{source}.batch", -1)):
        return head
    aside = f"{scratch.rstrip('/')}/batch-{uuid.uuid4().hex}"
    try:
        rows = numbered(batch, order, aside, head + 1)
        head += rows.count()
        store.commit(appended={source: rows}, notes={f"{source}.batch": batch_id, f"{source}.head": head}, base=base)
    finally:
        store.files.delete(aside)
    return head
