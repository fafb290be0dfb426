"""Queries of the solvers that take correspondences, and of numbered events, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyrelake.operators import calibration, projective, warp
from gyrelake.registry import query
from gyrelake.session import scratch_dir
from gyrelake.sources.testdata import adapted, read, sql
from gyrelake.streaming import runs

SIZE = (1600, 1200)


@query(f"""
    with p as (select * from {sql("matches")}),
    good as (select * from p where part = 'fit' and not off),
    m as (select acq, source_frame, target_frame, avg(sx) as mx, avg(sy) as my, avg(tx) as ux, avg(ty) as uy from good group by all),
    f as (
        select acq, source_frame, target_frame, count(*) as inlier_count, any_value(mx) as mx, any_value(my) as my, any_value(ux) as ux, any_value(uy) as uy,
            sum((sx - mx) * (tx - ux) + (sy - my) * (ty - uy)) / sum((sx - mx) ** 2 + (sy - my) ** 2) as re, sum((sx - mx) * (ty - uy) - (sy - my) * (tx - ux)) / sum((sx - mx) ** 2 + (sy - my) ** 2) as im
        from good join m using (acq, source_frame, target_frame) group by all
    ),
    s as (select *, ux - re * mx + im * my as shift_x, uy - im * mx - re * my as shift_y from f),
    h as (select acq, source_frame, median(sqrt((re * sx - im * sy + shift_x - tx) ** 2 + (im * sx + re * sy + shift_y - ty) ** 2)) as residual from p join s using (acq, source_frame, target_frame) where part = 'held' group by all)
    select acq, source_frame, target_frame, round(degrees(atan2(im, re)), 6) as angle_degrees, round(sqrt(re * re + im * im), 8) as scale, round(shift_x, 4) as tx, round(shift_y, 4) as ty, cast(inlier_count as integer) as inlier_count, round(residual, 5) as residual_px
    from s left join h using (acq, source_frame)
""")
def cycle_calibration(spark, sf_dir):
    """A robust similarity for each pair; two of five fit points are planted outliers."""
    out = calibration.pair_similarities(adapted(spark, sf_dir, "matches"))
    return out.select("acq", "source_frame", "target_frame", F.round("angle_degrees", 6).alias("angle_degrees"), F.round("scale", 8).alias("scale"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"), "inlier_count", F.round("residual_px", 5).alias("residual_px"))


@query()
def calibration_build(spark, sf_dir):
    """Rows only: medians and rays over fitted pairs; tests hold the operator against a planted calibration."""
    return calibration.calibrate(calibration.pair_similarities(adapted(spark, sf_dir, "matches")), *SIZE)


#: Frame to reference: a shear, a shift and a little perspective that grow from frame to frame; frame 1 is the identity.
POSE = ["1e0", "(f - 1) / 64e0", "(f - 1) * 10e0", "(f - 1) / -64e0", "1e0", "(f - 1) * 5e0", "(f - 1) / 1048576e0", "0e0", "1e0"]


#: Factors that make the planted cells whole numbers, so that rounding has no ties.
UNITS = [1, 64, 1, 64, 1, 1, 1 << 20, 1]


def ring(spark, sf_dir):
    """Points of the reference plane seen by both frames of a pair."""
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "cast(floor(l_orderkey / 4000) as int) as acq", "cast(l_orderkey % 16 + 1 as int) as source_frame", "cast((l_orderkey + 1) % 16 + 1 as int) as target_frame", "case when l_partkey % 5 = 0 then 'held' else 'fit' end as part",
        "cast((l_partkey * 37) % 1600 as double) as qx", "cast((l_suppkey * 29 + l_partkey * 7) % 1200 as double) as qy",
    )
    for side, at in (("source_frame", "s"), ("target_frame", "t")):
        rows = rows.withColumns({f"{at}__{k}": F.expr(c.replace("f", side)) for k, c in enumerate(POSE)})
        back = warp.adjugate([F.col(f"{at}__{k}") for k in range(9)])
        rows = rows.withColumn(f"{at}__i", back)
        i = F.col(f"{at}__i")
        w = i[6] * F.col("qx") + i[7] * F.col("qy") + i[8]
        rows = rows.withColumns({f"{at}x": (i[0] * F.col("qx") + i[1] * F.col("qy") + i[2]) / w, f"{at}y": (i[3] * F.col("qx") + i[4] * F.col("qy") + i[5]) / w})
    return rows.select("acq", "source_frame", "target_frame", "part", "sx", "sy", "tx", "ty")


@query(f"""
    with n as (select cast(floor(l_orderkey / 4000) as integer) as acq, l_orderkey % 16 as s, count(*) filter (l_partkey % 5 > 0) as fit, count(*) filter (l_partkey % 5 = 0) as held from lineitem group by all),
    ok as (select acq from n group by acq having count(*) = 16 and min(fit) >= 8 and min(held) >= 5)
    select acq, cast(f as integer) as frame, {", ".join(f"round({c} * {UNITS[k]}, 3) + 0 as m{k}" for k, c in enumerate(POSE[:8]))} from ok, (select unnest(range(1, 17)) as f)
""")
def projective_solve(spark, sf_dir):
    """The poses of passed acquisitions: the planted ones, as the correspondences are exact."""
    out = projective.projective_reconstructions(ring(spark, sf_dir), *map(float, SIZE)).where("passed")
    frames = out.select("acq", F.posexplode("poses").alias("at", "m"))
    return frames.select("acq", (F.col("at") + 1).alias("frame"), *[(F.round(F.col("m")[k] * unit, 3) + 0.0).alias(f"m{k}") for k, unit in enumerate(UNITS)])


@query("select event_id, user_id, row_number() over (order by user_id desc, event_id) as sequence from events")
def numbered_events(spark, sf_dir):
    """Gapless numbers over the whole table by counts of range partitions, no single task ordering it."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id")
    return runs.numbered(rows, [F.desc("user_id"), "event_id"], scratch_dir(spark)).select("event_id", "user_id", "sequence")
