"""The engine's input shapes derived from the driver's tables.

Each adapter is a table, select expressions that mean the same in Spark and DuckDB, and a filter,
so that a query and its oracle start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS: dict[str, tuple[str, list[str], str]] = {
    "det_frame": (
        "lineitem",
        [
            "cast(l_orderkey % 16 as int) as frame", "cast(l_partkey % 63 as int) as slice_index", "cast(l_linenumber % 4 as int) as cls", "round(l_discount*100)/16e0 as conf",
            "cast((l_partkey*37 + l_orderkey*11) % 1200 as double) as x1", "cast((l_suppkey*91 + l_orderkey*13) % 1200 as double) as y1",
            "cast((l_partkey*37 + l_orderkey*11) % 1200 as double) + l_quantity*2 as x2", "cast((l_suppkey*91 + l_orderkey*13) % 1200 as double) + l_quantity as y2",
        ],
        "true",
    ),
    "det_acq": (
        "lineitem",
        [
            "l_orderkey as acq", "cast(l_linenumber % 2 as int) as cls", "round(l_discount*100)/16e0 as conf", "cast(l_partkey % 40 as double) as x1", "cast(l_suppkey % 30 as double) as y1",
            "cast(l_partkey % 40 as double) + l_quantity as x2", "cast(l_suppkey % 30 as double) + 1 + l_linenumber * 5 as y2", "cast(l_suppkey % 63 as int) as slice_index",
        ],
        "true",
    ),
    "runs": (
        "orders",
        [
            "concat('run-', o_orderkey) as run_id", "concat('acq-', o_custkey) as acquisition_id", "concat('pipeline-', o_custkey % 50, '-r', o_orderkey % 3 + 1) as pipeline_snapshot_id",
            "case when o_orderkey % 2 = 0 then 'offline' else 'online' end as source", "case o_orderkey % 3 when 0 then 'upper' when 1 then 'lower' else 'not_applicable' end as side",
            "case o_orderstatus when 'F' then 'completed' when 'O' then 'created' else 'running' end as status", "o_orderdate as created_at",
        ],
        "true",
    ),
    "models": (
        "part",
        [
            "concat('model-', p_partkey) as model_bundle_id", "p_name as display_name", "concat('', p_size) as model_version",
            "case when p_partkey = 7 then 'active' else case p_size % 5 when 0 then 'valid' when 1 then 'approved' when 2 then 'retired' when 3 then 'valid' else 'rejected' end end as state",
            "(p_partkey * 7919) % 100003 as created_ord",
        ],
        "true",
    ),
    "pipelines": (
        "supplier",
        [
            "concat('pipeline-', s_suppkey % 50, '-r', cast(floor(s_suppkey / 50) as bigint) + 1) as pipeline_snapshot_id", "concat('pipeline-', s_suppkey % 50) as pipeline_id",
            "cast(floor(s_suppkey / 50) as bigint) + 1 as revision", "s_name as display_name",
            "case s_suppkey % 4 when 0 then 'active' when 1 then 'approved' when 2 then 'draft' else 'validated' end as state",
            "case when s_suppkey % 5 = 0 then null else concat('model-', s_suppkey * 3) end as model_bundle_id", "(s_suppkey * 31) % 1009 as created_ord",
        ],
        "true",
    ),
    "run_events": ("events", ["event_id + 1 as sequence", "event_type", "concat('run-', user_id) as run_id", "user_id", "value"], "true"),
    "pairs": (
        "orders",
        [
            "cast(floor(o_orderkey / 16) as bigint) as acq", "cast(o_orderkey % 16 + 1 as int) as source_frame", "cast((o_orderkey % 16 + 1) % 16 + 1 as int) as target_frame",
            "-225e-1 + ((o_custkey * 37) % 401 - 200) / 80e0 as angle_degrees", "1e0 + ((o_custkey * 13) % 21 - 10) / 1000e0 as scale",
            "cast((o_orderkey * 7) % 60 as int) as inlier_count", "((o_custkey * 11) % 60) / 10e0 as residual_px", "150e0 + (o_custkey % 41 - 20) * 10e0 as center_x", "-500e0 + (o_custkey % 37 - 18) * 10e0 as center_y",
        ],
        "true",
    ),
    "residuals": ("lineitem", ["cast(l_suppkey % 16 + 1 as int) as pair", "l_partkey / 1024e0 as residual_px"], "true"),
    "points": ("lineitem", ["l_orderkey % 8 as pair", "cast((l_partkey * 17) % 1600 as double) as x", "cast((l_suppkey * 29 + l_partkey) % 1200 as double) as y", "l_orderkey as k1", "l_linenumber as k2", "l_partkey as k3", "l_suppkey as k4"], "true"),
    "angles": ("lineitem", ["cast((l_partkey * 7 + l_suppkey) % 360 as int) as bin", "cast(l_suppkey % 256 as double) as v", "cast(l_partkey % 256 as double) as sat"], "true"),
    "pixels": (
        "lineitem",
        ["cast(l_orderkey % 16 + 1 as int) as frame", "cast(l_partkey % 64 as int) as x", "cast(l_suppkey % 48 as int) as y", "cast(l_partkey % 256 as int) as r", "cast(l_suppkey % 256 as int) as g", "cast(l_orderkey % 256 as int) as b"],
        "true",
    ),
    "manifests": (
        "orders",
        [
            "cast(floor(o_orderkey / 16) as bigint) as acq", "cast(o_orderkey % 16 + 1 as int) as position", "(o_orderkey % 16) * 225e-1 + case when o_orderkey % 611 = 0 then 1 else 0 end as angle_degrees",
            "concat('content-', o_custkey * 7 + o_orderkey % 4) as sha256",
        ],
        "o_orderkey % 397 > 0",
    ),
    "ray_angles": ("orders", ["cast(floor(o_orderkey / 16) as bigint) as acq", "case when o_orderkey % 211 = 0 then cast('infinity' as double) else ((o_custkey * 37) % 500) * 15e-1 - 300 end as angle"], "o_orderkey % 16 < 5"),
    "images": ("supplier", ["cast(s_suppkey as int) as frame", "cast(400 + (s_suppkey * 131) % 6161 as int) as width", "cast(300 + (s_suppkey * 777) % 4649 as int) as height"], "true"),
    "edges": (
        "orders",
        [
            "cast(floor(o_orderkey / 16) as bigint) as acq", "cast(o_orderkey % 16 + 1 as int) as frame", "75e-2 + (o_custkey % 8) / 64e0 as c", "(o_custkey % 5 - 2) / 16e0 as s",
            "(o_orderkey * 7) % 40 - 2e1 as tx", "(o_custkey * 3) % 30 - 15e0 as ty",
        ],
        "true",
    ),
    "flashes": (
        "orders",
        ["cast(floor(o_orderkey / 16) as bigint) as acq", "cast(o_orderkey % 16 as int) as place", "36e0 * (o_orderkey % 16) + (o_custkey * 7) % 11 as a", "36e0 * (o_orderkey % 16) + (o_custkey * 5) % 13 + 4 as b"],
        "o_orderkey % 16 < 10",
    ),
    "plates": (
        "lineitem",
        [
            "cast(floor(l_orderkey / 4000) as int) as acq", "cast(l_orderkey % 4 as int) as frame", "cast(l_partkey % 64 as int) as x", "cast((l_suppkey + l_linenumber * 7) % 48 as int) as y",
            "cast(l_partkey % 256 as int) as r", "cast(l_suppkey % 256 as int) as g", "cast((l_orderkey * 5) % 256 as int) as b", "case when (l_partkey + l_linenumber) % 4 > 0 then 255 else 0 end as mask",
        ],
        "true",
    ),
    "matches": (
        "(select *, cast((l_partkey * 37) % 1600 as double) as sx, cast((l_suppkey * 29 + l_partkey * 7) % 1200 as double) as sy, case when l_partkey % 5 = 0 then 'held' else 'fit' end as part, (l_linenumber + l_partkey + l_orderkey) % 5 < 2 and l_partkey % 5 > 0 as off from lineitem)",
        [
            "cast(floor(l_orderkey / 4000) as int) as acq", "cast(l_orderkey % 16 + 1 as int) as source_frame", "cast((l_orderkey + 1) % 16 + 1 as int) as target_frame", "part", "off", "sx", "sy",
            # a turn by -22.5 degrees about (800, -1500), a few tenths of noise, and two of five fit points somewhere else
            "800e0 + 0.9238795325112867e0 * (sx - 800e0) + 0.3826834323650898e0 * (sy + 1500e0) + ((l_partkey * 13) % 7 - 3) / 10e0 + case when off then 100 + (l_partkey * 53) % 700 else 0 end as tx",
            "-1500e0 - 0.3826834323650898e0 * (sx - 800e0) + 0.9238795325112867e0 * (sy + 1500e0) + ((l_suppkey * 11) % 7 - 3) / 10e0 - case when off then 150 + (l_suppkey * 31) % 500 else 0 end as ty",
        ],
        "true",
    ),
    "masks": (
        "lineitem",
        ["cast(floor(l_orderkey / 3000) as int) as acq", "l_linenumber as id", "cast(l_partkey % 24 as int) as x", "cast(l_suppkey % 16 as int) as y"],
        "l_orderkey % 3 > 0",
    ),
}


#: A comma between columns: one that no bracket encloses.
SPLIT = re.compile(r",\s*(?![^()]*\))")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, condition = ADAPTERS[name]
    if not table.startswith("("):
        return read(spark, sf_dir, table).where(condition).selectExpr(*columns)
    stem = table.rsplit(" from ", 1)[1].rstrip(")")  # named columns over a table, so that they need not be written twice
    return read(spark, sf_dir, stem).selectExpr(*SPLIT.split(table.removeprefix("(select ").rsplit(" from ", 1)[0])).where(condition).selectExpr(*columns)


def sql(name: str) -> str:
    """The adapter as DuckDB SQL, in brackets."""
    table, columns, condition = ADAPTERS[name]
    return f"(select {', '.join(columns)} from {table} where {condition})"
