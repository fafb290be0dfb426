"""Queries of manifests, nominal and corrected transforms, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyrelake.operators import placement, registration
from gyrelake.registry import query
from gyrelake.sources.testdata import adapted, sql

MANIFEST_SQL = f"""
    select acq, case when n <> 16 then 'count' when not (places = 16 and lo = 1 and hi = 16) then 'positions' when not ring then 'angles' when contents <> 16 then 'content' end as problem
    from (select acq, count(*) as n, count(distinct position) as places, min(position) as lo, max(position) as hi, bool_and(coalesce(angle_degrees = (position - 1) * 22.5e0, false)) as ring, count(distinct sha256) as contents from {sql("manifests")} group by acq)
"""


@query(MANIFEST_SQL)
def manifest_problems(spark, sf_dir):
    return placement.manifest_problems(adapted(spark, sf_dir, "manifests"))


@query(f"""
    with t as (select acq, case when isfinite(angle) then ((angle % 360) + 360) % 360 end as a from {sql("ray_angles")}),
    s as (select acq, count(*) as n, count(a) as finite, count(distinct round(a, 9)) as different, list_sort(list(round(a, 6)) filter (a is not null)) as angles from t group by acq),
    p as (select *, case when n <> 5 then 'count' when finite <> 5 then 'finite' when different <> 5 then 'unique' end as problem from s)
    select acq, problem, case when problem is null then array_to_string(angles, ',') end as angles from p
""")
def angle_sets(spark, sf_dir):
    out = placement.angle_sets(adapted(spark, sf_dir, "ray_angles"), 5)
    return out.select("acq", "problem", F.array_join(F.transform("angles", lambda a: F.round(a, 6).cast("string")), ",").alias("angles"))


CENTERS = "acq, 800e0 + acq % 50 as cx, -1500e0 + acq % 70 as cy, 2698e0 + acq % 3 as ox, 2698e0 + acq % 3 as oy"
#: Rotation by a, after the move of the source's center to the output's; rows a b tx and c d ty.
NOMINAL_SQL = f"""(select *, cos(radians(a)) as m0, -sin(radians(a)) as m1, ox - cos(radians(a)) * cx + sin(radians(a)) * cy as m2, sin(radians(a)) as m3, oy - sin(radians(a)) * cx - cos(radians(a)) * cy as m5
    from (select acq, position, angle_degrees as a, {CENTERS.removeprefix("acq, ")} from {sql("manifests")}))"""


def nominal(spark, sf_dir):
    frames = adapted(spark, sf_dir, "manifests").select("acq", "position", "angle_degrees")
    return placement.nominal_transforms(frames, frames.select("acq").distinct().selectExpr(*CENTERS.split(", ")))


def cells(frame, column):
    return [(F.round(F.col(column)[k], 6) + 0.0).alias(f"m{k}") for k in (0, 1, 2, 3, 5)]


@query(f"select acq, position, {', '.join(f'round(m{k}, 6) + 0 as m{k}' for k in (0, 1, 2, 3, 5))}, 0e0 as off from {NOMINAL_SQL}")
def nominal_transforms(spark, sf_dir):
    """Transforms of every frame; ``off`` says how far the inverse is from undoing them."""
    out = nominal(spark, sf_dir)
    there, back = F.col("source_to_output"), F.col("output_to_source")
    off = F.greatest(*[F.abs(sum((there[3 * i + k] * back[3 * k + j] for k in range(1, 3)), there[3 * i] * back[j]) - float(i == j)) for i in range(3) for j in range(3)])
    return out.select("acq", "position", *cells(out, "source_to_output"), (F.round(off, 6) + 0.0).alias("off"))


@query(f"""
    with p as (select distinct acq, source_frame, ((acq * 7 + source_frame * 13) % 21 - 10) / 100e0 as step from {sql("pairs")}),
    q as (select *, sum(step) over (partition by acq) / 16 as mean, count(*) over (partition by acq) as n from p),
    c as (select acq, source_frame as position, coalesce(sum(step - mean) over (partition by acq order by source_frame rows between unbounded preceding and 1 preceding), 0) as correction from q where n = 16),
    t as (select m.*, radians(m.a + correction) as r from {NOMINAL_SQL} m join c using (acq, position))
    select acq, position, round(cos(r), 6) + 0 as m0, round(-sin(r), 6) + 0 as m1, round(ox - cos(r) * cx + sin(r) * cy, 6) + 0 as m2, round(sin(r), 6) + 0 as m3, round(oy - sin(r) * cx - cos(r) * cy, 6) + 0 as m5 from t
""")
def corrected_transforms(spark, sf_dir):
    """Nominal transforms turned by the corrections of a solved ring (equal weights, so that SQL can say them)."""
    p = adapted(spark, sf_dir, "pairs").select("acq", "source_frame", "target_frame").distinct()
    p = p.withColumns({"correction": F.expr("((acq * 7 + source_frame * 13) % 21 - 10) / 100e0"), "confidence": F.lit(1.0)})
    out = placement.corrected_transforms(nominal(spark, sf_dir), registration.ring_corrections(p, 100.0))
    return out.select("acq", "position", *cells(out, "source_to_output"))


@query(f"""
    select coalesce(f.acq, m.acq) as acq, coalesce(f.position, m.position) as position, case when m.acq is null then 'matrix' else 'frame' end as missing
    from (select acq, position from {sql("manifests")} where position % 7 > 0) f full join (select acq, position from {sql("manifests")} where (acq + position) % 5 > 0) m on f.acq = m.acq and f.position = m.position where f.acq is null or m.acq is null
""")
def unpaired_frames(spark, sf_dir):
    """Frames and matrices that a strict pairing would refuse."""
    m = adapted(spark, sf_dir, "manifests").select("acq", "position")
    return placement.paired(m.where("position % 7 > 0"), m.where("(acq + position) % 5 > 0"), ["acq", "position"])[1]


@query(f"select pipeline_id || '-r' || revision as snapshot_id, display_name from {sql('pipelines')}")
def snapshot_ids(spark, sf_dir):
    return adapted(spark, sf_dir, "pipelines").select(placement.snapshot_id(F.col("pipeline_id"), F.col("revision")).alias("snapshot_id"), "display_name")


@query(f"select run_id, frame_index, sha256 from (select 'run-' || acq as run_id, position - 1 as frame_index, sha256 from {sql('manifests')}) where run_id = 'run-7' order by frame_index")
def frames_by_index(spark, sf_dir):
    frames = adapted(spark, sf_dir, "manifests").select(F.concat(F.lit("run-"), "acq").alias("run_id"), (F.col("position") - 1).alias("frame_index"), "sha256")
    return placement.frames_of(frames, "run-7")
