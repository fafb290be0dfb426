"""The event log: pages, gaps, retention, progress, leases, checkpoints and retries; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.operators.grouping import sorted_groups


def event_page(events: DataFrame, after: int, limit: int = 100) -> DataFrame:
    """The next events after a sequence; limit 1..500."""
    if not 1 <= limit <= 500 or after < 0:
        raise ValueError("limit is 1..500 and after is 0 or more")
    return events.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def retained(events: DataFrame, most: int = 1000) -> DataFrame:
    """The ring of the last ``most`` sequences; sequences rise without gaps, so that the head decides."""
    if not 10 <= most <= 100_000:
        raise ValueError("a ring holds 10..100000 events")
    head = events.agg(F.max("sequence").alias("head"))
    return events.join(F.broadcast(head), F.col("sequence") > F.col("head") - most).drop("head")  # one row


def gaps(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each cursor (after): oldest and latest sequence, and whether events between were lost."""
    edge = events.agg(F.min("sequence").alias("oldest"), F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("latest"))
    oldest = F.coalesce("oldest", F.col("latest") + 1)
    return cursors.join(F.broadcast(edge)).select("after", oldest.alias("oldest"), "latest", ((F.col("after") > 0) & (F.col("after") < oldest - 1)).alias("gap"))  # one row


def latest(events: DataFrame, key: str, *columns: str) -> DataFrame:
    """The last values of each key."""
    return events.groupBy(key).agg(F.max("sequence").alias("sequence"), *[F.max_by(c, "sequence").alias(c) for c in columns])


def leases(requests: DataFrame) -> DataFrame:
    """Requests (run_id, sequence, at, owner, seconds) with ``granted``, and the owner and expiry after each.

    ``kind`` tells 'acquire' (the default: granted when the run is free, expired at its time, or has the
    same owner), 'renew' and 'release' (both granted to the owner only, expired or not; a release frees
    the run). Each run's requests stream in order; state is one owner and one expiry.
    """

    def work(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        owner = until = None
        for sequence, at, who, seconds, kind in rows:
            if kind == "acquire":
                granted = owner is None or owner == who or until <= at
            else:
                granted = owner is not None and owner == who
            if granted:
                owner, until = (None, None) if kind == "release" else (who, at + seconds)
            yield *key, owner, until, sequence, granted

    kind = F.coalesce("kind", F.lit("acquire")) if "kind" in requests.columns else F.lit("acquire")
    rows = requests.select("run_id", "sequence", "at", "owner", "seconds", kind.alias("kind"))
    name = requests.schema["run_id"].dataType.simpleString()
    return sorted_groups(rows, ["run_id"], work, f"run_id {name}, owner string, until long, sequence long, granted boolean", ("sequence",))


def retry_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """run_id, stage: attempts made and the end: completed, failed (a final error or too many tries) or running.

    attempts: sequence and outcome ('ok', 'retry', 'error') of each try; nothing after the end counts.
    """
    w = Window.partitionBy("run_id", "stage").orderBy("sequence")
    tried = attempts.withColumn("n", F.row_number().over(w))
    ends = (F.col("outcome") != "retry") | (F.col("n") >= most)
    before = F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = tried.withColumn("before", before).where("before = 0")
    last = made.groupBy("run_id", "stage").agg(F.max("n").cast("long").alias("attempts"), F.max_by("outcome", "n").alias("outcome"))
    status = F.when(F.col("outcome") == "ok", "completed").when((F.col("outcome") == "error") | (F.col("attempts") >= most), "failed").otherwise("running")
    return last.select("run_id", "stage", "attempts", status.alias("status"))


def reusable(checkpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """Checkpoints with ``reuse``: completed, and the evidence is there with the same checksum."""
    have = evidence.select(F.col("path").alias("evidence_path"), F.col("sha256").alias("have"))
    good = (F.col("status") == "completed") & F.coalesce(F.lower("have") == F.lower("evidence_sha256"), F.lit(False))
    return checkpoints.join(have, "evidence_path", "left").withColumn("reuse", good).drop("have")


def admitted(jobs: DataFrame, capacity: int = 8) -> DataFrame:
    """Submitted jobs (sequence, run_id) with the decision: duplicates of a waiting run and what exceeds the queue are refused."""
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("sequence"))
    ranked = jobs.withColumn("nth", first)
    kept = ranked.where("nth = 1").orderBy("sequence").limit(capacity).select("sequence", F.lit(True).alias("in"))
    decision = F.when(F.col("nth") > 1, "duplicate").when(F.col("in"), "queued").otherwise("full")
    return ranked.join(kept, "sequence", "left").select("sequence", "run_id", decision.alias("decision"))
