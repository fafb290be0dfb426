"""State changes as table rewrites, and staged writes.

A change is a new table computed from the old one. ``publish`` writes it beside a plain folder and moves it into
place; for a moment between its two renames there is no folder, so that what readers must always find, and changes of
several tables, go through ``commits.Store``, where a change is one manifest.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require_known(rows: DataFrame, column: str, value) -> None:
    if rows.where(F.col(column) == F.lit(value)).isEmpty():
        raise KeyError(value)


def set_state(rows: DataFrame, key: str, value, state: str) -> DataFrame:
    require_known(rows, key, value)
    return rows.withColumn("state", F.when(F.col(key) == F.lit(value), F.lit(state)).otherwise(F.col("state")))


def set_run_status(runs: DataFrame, run_id: str, status: str, failure_code=None, started_at=None, finished_at=None) -> DataFrame:
    """started_at stays where no new one is given; failure_code and finished_at are always replaced."""
    require_known(runs, "run_id", run_id)
    mine = F.col("run_id") == F.lit(run_id)
    new = {"status": F.lit(status), "failure_code": F.lit(failure_code).cast("string"), "started_at": F.coalesce(F.lit(started_at).cast("timestamp"), "started_at"), "finished_at": F.lit(finished_at).cast("timestamp")}
    return runs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})


def activate(rows: DataFrame, key: str, value, allowed: tuple[str, ...] = ("validated", "approved")) -> DataFrame:
    """The row becomes active and what was active becomes approved."""
    if rows.where((F.col(key) == F.lit(value)) & F.col("state").isin(*allowed)).isEmpty():
        raise ValueError(f"{value} cannot become active")
    state = F.when(F.col(key) == F.lit(value), "active").when(F.col("state") == "active", "approved").otherwise(F.col("state"))
    return rows.withColumn("state", state)


def delete(rows: DataFrame, key: str, value) -> DataFrame:
    require_known(rows, key, value)
    return rows.where((F.col(key) != F.lit(value)) | F.col(key).isNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of every key; new rows win ties."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("is_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("is_new")))
    return both.withColumn("nth", latest).where("nth = 1").select(old.columns)


def retained(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The newest ``most`` rows."""
    return rows.orderBy(F.desc(order)).limit(most)


def publish(spark: SparkSession, rows: DataFrame, target: str, **options) -> None:
    """Writes beside the target and moves into place; what was there goes only after the new rows are whole."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    staged, old = f"{target}.staged-{uuid.uuid4().hex}", f"{target}.old-{uuid.uuid4().hex}"
    writer = rows.write
    if by := options.get("partition_by"):
        writer = writer.partitionBy(*by)
    writer.parquet(staged)
    fs = path(target).getFileSystem(conf)
    had = fs.exists(path(target))
    if had and not fs.rename(path(target), path(old)):  # else the new rows would be moved into the old folder
        fs.delete(path(staged), True)
        raise OSError(f"{target} could not be moved aside")
    if not fs.rename(path(staged), path(target)):
        if had:
            fs.rename(path(old), path(target))
        raise OSError(f"{target} could not be replaced")
    fs.delete(path(old), True)


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, UTF-8; numbers that are not finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def save_json(path: str | os.PathLike, value) -> str:
    """Writes a small document atomically on the driver and returns its SHA-256."""
    import hashlib

    path, body = Path(path), canonical_json(value)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with part.open("wb") as out:
        out.write(body)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)
    return hashlib.sha256(body).hexdigest()


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> dict[str, int]:
    """Copies of tables with their row counts, checked after the write."""
    counts = {}
    for name, rows in tables.items():
        publish(spark, rows, f"{target.rstrip('/')}/{name}")
        counts[name] = spark.read.parquet(f"{target.rstrip('/')}/{name}").count()
        if counts[name] != rows.count():
            raise OSError(f"the copy of {name} is not whole")
    return counts
