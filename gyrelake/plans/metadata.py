"""Repository queries: pages, lookups, references, revisions, details and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODEL_STATES = ["imported", "verifying", "valid", "approved", "active", "retired", "rejected"]
PIPELINE_STATES = ["draft", "testing", "validated", "approved", "active", "retired", "rejected", "archived"]
RUN_STATES = ["created", "running", "completed", "failed", "cancelled"]


def page(rows: DataFrame, created: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page by creation (newest first), then key; limit 1..200, offset 0 or more."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1..200 and offset is 0 or more")
    return rows.orderBy(F.desc(created), F.asc(key)).offset(offset).limit(limit)


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The row of a (composite) key, or none; the filter reaches the scan."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.limit(1)


def active(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("state") == "active")


def models_with_references(models: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Models with their number of pipelines and what may be done: one aggregate and one left join."""
    used = pipelines.where("model_bundle_id is not null").groupBy("model_bundle_id").agg(F.count("*").alias("pipelines"))
    n = F.coalesce("pipelines", F.lit(0)).cast("long")
    return models.join(used, "model_bundle_id", "left").select(
        "model_bundle_id", "state", n.alias("pipelines"), (n > 0).alias("referenced"), ((F.col("state") != "active") & (n == 0)).alias("can_archive"), ((F.col("state") == "retired") & (n == 0)).alias("can_delete"),
    )


def next_revision(pipelines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The next revision of every wanted pipeline id, 1 for a new one."""
    last = pipelines.groupBy("pipeline_id").agg(F.max("revision").alias("last"))
    return wanted.join(last, "pipeline_id", "left").select("pipeline_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("revision"))


def run_details(runs: DataFrame, checkpoints: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs with their checkpoints (by stage) and artifacts (by id) as sorted arrays; runs without any have empty ones."""
    c = checkpoints.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage_name", "status"))).alias("checkpoints"))
    a = artifacts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("artifact_id", "size_bytes"))).alias("artifacts"))
    return runs.join(c, "run_id", "left").join(a, "run_id", "left").withColumns({n: F.coalesce(n, F.array().cast(t.schema[n].dataType)) for n, t in (("checkpoints", c), ("artifacts", a))})


def runnable(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Runs whose pipeline is approved or active."""
    return runs.join(pipelines.where(F.col("state").isin("approved", "active")).select("pipeline_snapshot_id"), "pipeline_snapshot_id", "left_semi")


def usable_pipelines(pipelines: DataFrame, models: DataFrame) -> DataFrame:
    """Pipelines without a model, or with one that is valid, approved or active."""
    good = models.where(F.col("state").isin("valid", "approved", "active")).select("model_bundle_id")
    return pipelines.where("model_bundle_id is null").unionByName(pipelines.join(good, "model_bundle_id", "left_semi").select(pipelines.columns))


def unreferenced(models: DataFrame, pipelines: DataFrame) -> DataFrame:
    return models.join(pipelines.select("model_bundle_id"), "model_bundle_id", "left_anti")


def inventory_difference(declared: DataFrame, found: DataFrame) -> DataFrame:
    """path and problem: declared files that are missing, undeclared ones, and changed checksums."""
    both = declared.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "undeclared").when(F.lower("want") != F.lower("have"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def violations(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule and key of every row that breaks a rule; a rule that is null counts as kept, as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key.cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def pair_rule(a: str, b: str) -> Column:
    """Both null or neither."""
    return F.col(a).isNull() == F.col(b).isNull()


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, column: str, parent: str) -> DataFrame:
    """Children whose non-null reference has no parent."""
    return children.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, column: str, parent: str) -> DataFrame:
    """Children that survive when their parents are those given."""
    return children.join(parents.select(F.col(parent).alias(column)), column, "left_semi")


def repeated(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Rows whose value came before in the order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(value).orderBy(*order))).where("nth > 1").drop("nth")


def ready(components: DataFrame) -> DataFrame:
    """One row: whether all components are ready, and which are not."""
    return components.agg(F.bool_and("ready").alias("ready"), F.array_sort(F.collect_list(F.when(~F.col("ready"), F.col("component")))).alias("missing"))


def stages_ok(stages: DataFrame) -> DataFrame:
    """Stages that break their life cycle: a finish before the start, or an error without failure and the reverse."""
    late = F.col("finished_at") < F.col("started_at")
    odd = (F.col("status") == "failed") != F.col("error").isNotNull()
    return stages.where(F.coalesce(late, F.lit(False)) | odd)


def contiguous(values: DataFrame, group: str, value: str, start: int = 0) -> DataFrame:
    """Groups whose values are not start, start + 1, ... once each."""
    seen = values.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"), F.count_distinct(value).alias("d"))
    return seen.where((F.col("lo") != start) | (F.col("hi") != start + F.col("n") - 1) | (F.col("d") != F.col("n"))).select(group)


def transform_sets(transforms: DataFrame, group: str = "acq") -> DataFrame:
    """n, first, last, and distinct positions, hashes and masks of each set of (frame, sha256, mask_path)."""
    distinct = [F.count_distinct(c).alias(n) for c, n in (("frame", "positions"), ("sha256", "hashes"), ("mask_path", "masks"))]
    return transforms.groupBy(group).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), *distinct)
