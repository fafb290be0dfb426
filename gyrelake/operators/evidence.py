"""Registration evidence: spatial split, even sampling, held-out metrics and gates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spatial_split(points: DataFrame, group: list[str], ties: list[str], tile: int = 256, stride: int = 5) -> DataFrame:
    """Points with ``ordinal`` in tile order and ``part``: every ``stride``-th is held out, the rest fits.

    Points are numbered inside a line of pixels of their tile, by as many tasks as there are such lines, and go on from the number of
    points in the group's lines before; only the table of lines, at most ``tile`` for each tile, is ordered group by group.
    """
    placed = points.withColumns({"ty__": F.floor(F.col("y") / tile), "tx__": F.floor(F.col("x") / tile), "line__": F.floor("y")})
    key = [*group, "ty__", "tx__", "line__"]
    tiles = placed.groupBy(*key).agg(F.count("*").alias("n__"))
    before = (F.sum("n__").over(Window.partitionBy(*group).orderBy("ty__", "tx__", "line__")) - F.col("n__")).alias("before__")
    same = [placed[k].eqNullSafe(F.col(f"{k}_t")) for k in key]
    joined = placed.join(tiles.select(*[F.col(k).alias(f"{k}_t") for k in key], before), same)
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("y", "x", *ties)) - 1
    ordinal = joined.withColumn("ordinal", F.col("before__") + inside).select(*points.columns, "ordinal")
    return ordinal.withColumn("part", F.when(F.col("ordinal") % stride == 0, "held").otherwise("fit"))


def evenly_kept(n: Column, rank: Column, most: int) -> Column:
    """Whether the rank (from 0) is among ``most`` positions spread evenly over n, ends included; doubles, then floor."""
    if most < 2:
        return rank < most
    step = (n - 1) / F.lit(float(most - 1))
    # floor(i * step) = rank only for an i next to rank / step: a few are tried, not all positions
    about = F.floor(rank / step)
    at = lambda i: F.when(i == most - 1, n - 1).when(i.between(0, most - 2), F.floor(i * step)).cast("long")
    picked = [F.coalesce(at(about + d) == rank, F.lit(False)) for d in (-1, 0, 1, 2)]
    return (n <= most) | picked[0] | picked[1] | picked[2] | picked[3]


def even_sample(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, spread evenly over its order; the size of the sample is the operator's purpose."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    return ranked.where(evenly_kept(F.col("n"), F.col("rank"), most)).drop("n")


def ranked_sample(rows: DataFrame, group: list[str], rank: str, most: int) -> DataFrame:
    """``even_sample`` of rows that have their rank (0, 1, ... in each group) already: groups are counted, not ordered."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("n__"))
    return rows.join(counts, group).where(evenly_kept(F.col("n__"), F.col(rank), most)).select(*rows.columns)


#: Brackets of a percentile are found to one in so many ranks.
ACCURACY = 100_000


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n, most and the exact percentiles (linear between ranks) named in ``shares``; without keys, of all rows. Null values do not count.

    A sketch, combined before the shuffle, brackets each percentile between two values; a second pass counts what is below and above
    and the different values inside the bracket, which hold some four of ``ACCURACY`` ranks. So no task
    sees all values of a key, be it the grand total.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v__"))
    slack, names = 2 / ACCURACY, list(shares)
    wanted = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-slack, slack)]
    sketch = [F.count("*").alias("n"), F.max("v__").alias("most"), F.min("v__").alias("low__"), F.percentile_approx("v__", wanted, ACCURACY).alias("edges__")]
    about = known.groupBy(*keys).agg(*sketch)
    if keys:
        both = known.join(about, keys)
    else:
        both = known.join(F.broadcast(about))  # one row
    # ranks 0 and n - 1 are the ends, whatever the sketch says of them
    low = lambda i: F.when(F.lit(wanted[2 * i]) <= 0, F.col("low__")).otherwise(F.col("edges__")[2 * i])
    high = lambda i: F.when(F.lit(wanted[2 * i + 1]) >= 1, F.col("most")).otherwise(F.col("edges__")[2 * i + 1])
    both = both.withColumns({f"low__{i}": low(i) for i in range(len(names))} | {f"high__{i}": high(i) for i in range(len(names))})
    side = [F.when(F.col("v__") < F.col(f"low__{i}"), -1).when(F.col("v__") > F.col(f"high__{i}"), 1).otherwise(0) for i in range(len(names))]
    each = both.select(*keys, "n", "most", "v__", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("side")) for i, x in enumerate(side)])).alias("e"))
    # what is below and what is above counts as one value each, the one next to the bracket
    inside = each.groupBy(*keys, "n", "most", "e.i", "e.side", F.when(F.col("e.side") == 0, F.col("v__")).alias("same__"))
    inside = inside.agg(F.count("*").alias("k"), F.max("v__").alias("greatest"), F.min("v__").alias("least")).withColumn("v", F.when(F.col("side") < 0, F.col("greatest")).otherwise(F.col("least")))
    seen = inside.withColumn("to", F.sum("k").over(Window.partitionBy(*keys, "i").orderBy("v")))
    share = F.element_at(F.array(*map(F.lit, shares.values())), F.col("i") + 1)
    rank = (F.col("n") - 1) * share
    at = lambda r: F.min(F.when(F.col("to") > r, F.col("v")))  # noqa: E731  the value of a rank
    found = seen.withColumn("rank", rank).groupBy(*keys, "n", "most", "i", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    part = F.col("rank") - F.floor("rank")
    exact = found.withColumn("p", F.col("a") + (F.col("b") - F.col("a")) * part)
    return exact.groupBy(*keys, "n", "most").agg(*[F.max(F.when(F.col("i") == i, F.col("p"))).alias(n) for i, n in enumerate(names)])


def heldout_metrics(residuals: DataFrame, key: str = "pair", value: str = "residual_px") -> DataFrame:
    """Count, median, 95th percentile (linear) and maximum for each pair and, with a null key, over all raw residuals."""
    shares = {"median": 0.5, "p95": 0.95}
    every = percentiles(residuals, [], value, shares).withColumn(key, F.lit(None).cast(residuals.schema[key].dataType))
    columns = [key, "n", "median", "p95", "most"]
    return percentiles(residuals, [key], value, shares).select(columns).unionByName(every.select(columns))


def heldout_reasons(metrics: DataFrame, limit: float = 1.0, least: int = 5) -> DataFrame:
    """All rules that a row of metrics breaks, in order, and whether it passed."""
    rules = [F.when(F.col("n") < least, "count"), F.when(F.col("median") > limit, "median"), F.when(F.col("p95") > limit, "p95"), F.when(F.col("most") > limit, "maximum")]
    reasons = F.array_compact(F.array(*rules))
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size(reasons) == 0)


QUERY_BLOCK = 16_384
#: Products of vectors and queries that are held at once.
PRODUCTS = 1 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    return np.array(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(len(column), -1)


def different(v: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the rows that can be among two nearest: of rows with the same vector two of the least id and two of the ids after it.

    Whatever id a query has, the two of least id that are not its own are among these, so that copies do not meet copies pair by pair.
    """
    group = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_inverse=True)[1] if v.shape[1] else np.zeros(len(v), np.int64)
    order = np.lexsort((keys, group))
    group, keys, place = group[order], keys[order], np.arange(len(order))
    begins = np.concatenate([[True], group[1:] != group[:-1]])[: len(order)]
    other = keys != keys[np.maximum.accumulate(np.where(begins, place, 0))]
    begins[1:] |= other[1:] != other[:-1]
    return np.sort(order[place - np.maximum.accumulate(np.where(begins, place, 0)) < 2])


def two_nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """query, id and d (squared) of the two vectors of all batches that are nearest to each query of a block, ties to the smaller id.

    Batches are taken in slices of ``PRODUCTS`` pairs, whatever the block's size is; two rows of each query are kept from slice to slice,
    and what is farther than the second of them is not looked at.
    """
    own, step = (block**2).sum(1), max(2, PRODUCTS // max(1, len(ids)))
    right = np.vstack([-2 * block.T, np.ones(len(ids)), own])  # [v, |v|^2, 1] times this is the squared distance, about
    by_id = np.argsort(ids, kind="stable")
    sorted_ids = ids[by_id]
    key, d = np.zeros((len(ids), 2), np.int64), np.full((len(ids), 2), np.inf)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, keys = matrix(batch["v"]), batch["id"].to_numpy()
        few = different(vectors, keys)
        for at in range(0, len(few), step):
            v, k = vectors[few[at : at + step]], keys[few[at : at + step]]
            size = (v**2).sum(1)
            about = np.column_stack([v, size, np.ones(len(v))]) @ right  # picks; what is picked is measured exactly below
            low, high = (np.searchsorted(sorted_ids, k, side) for side in ("left", "right"))
            for i in np.flatnonzero(high > low).tolist():
                about[i, by_id[low[i] : high[i]]] = np.inf
            most = d[:, 1].copy()
            fresh = np.flatnonzero(np.isinf(most))
            if len(fresh) and len(v) > 1:
                most[fresh] = np.partition(about[:, fresh], 1, axis=0)[1]
            row, query = np.nonzero(about <= most + 1e-9 * (size.max(initial=0) + own))
            known = about[row, query] < np.inf
            row, query = row[known], query[known]
            who, place = np.unique(query, return_inverse=True)
            every = np.concatenate([np.arange(len(who)).repeat(2), place])
            both = np.concatenate([key[who].ravel(), k[row]]), np.concatenate([d[who].ravel(), ((v[row] - block[query]) ** 2).sum(1)])
            order = np.lexsort((*both, every))
            first = order[np.searchsorted(every[order], np.arange(len(who)))[:, None] + [0, 1]]
            key[who], d[who] = both[0][first], both[1][first]
    query, nth = np.nonzero(d < np.inf)
    yield pa.record_batch([pa.array(ids[query], pa.int64()), pa.array(key[query, nth], pa.int64()), pa.array(d[query, nth], pa.float64())], ["query", "id", "d"])


def ratio_matches(vectors: DataFrame, queries: DataFrame, scratch: str, ratio: float = 0.78) -> DataFrame:
    """query, neighbour, d1 and d2 (squared) of queries whose nearest vector is clearly nearer than the second.

    The stated query set (query, qv), which may be all vectors, goes over the vectors (id, v) in blocks of about ``QUERY_BLOCK`` rows, one broadcast block
    and one job at a time, whose two best rows of each query and task are ranked and written under ``scratch``, a folder that all executors share.
    Every query meets every vector: the work grows with the product of both. All vectors have the same number of components; a null id or vector takes no part.
    """
    spark, path = vectors.sparkSession, f"{scratch.rstrip('/')}/ratio-{uuid.uuid4().hex}"
    vectors, queries = vectors.where("id is not null and v is not null"), queries.where("query is not null and qv is not null")
    n = -(-queries.count() // QUERY_BLOCK) or 1
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b).select(F.col("query").cast("long"), "qv").toArrow()  # about QUERY_BLOCK rows
        shared = spark.sparkContext.broadcast((rows["query"].to_numpy(), matrix(rows["qv"])) if rows.num_rows else None)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return two_nearest(batches, *shared.value) if shared.value else iter(())

        found = vectors.select(F.col("id").cast("long"), "v").mapInArrow(run, "query long, id long, d double")
        order = Window.partitionBy("query").orderBy("d", "id")
        found.withColumn("rank", F.row_number().over(order)).where("rank <= 2").write.parquet(f"{path}/{b}")
        shared.destroy()
    two = spark.read.schema("query long, id long, d double, rank int").parquet(*(f"{path}/{b}" for b in range(n)))
    out = two.groupBy("query").agg(F.min_by("id", "rank").alias("neighbour"), F.min("d").alias("d1"), F.max("d").alias("d2"), F.count("*").alias("n"))
    return out.where((F.col("n") == 2) & (F.sqrt("d1") < ratio * F.sqrt("d2"))).drop("n")


def flow_accepted(most_displacement: float, most_round_trip: float, most_error: float) -> Column:
    """Whether a tracked corner is kept: found both ways, finite and short moves, small errors; a null is not kept."""
    near = lambda c, most: ~F.isnan(c) & (F.col(c) <= most)
    kept = F.col("forward_found") & F.col("backward_found") & near("displacement", most_displacement) & near("round_trip", most_round_trip)
    return F.coalesce(kept & near("forward_error", most_error) & near("backward_error", most_error), F.lit(False))


def best_channel(counts: DataFrame, group: str = "pair") -> DataFrame:
    """The channel with most kept corners ``n``, the first in order (``ordinal``) on ties; a group without any has none."""
    best = F.max_by(F.struct("channel", "n"), F.struct("n", -F.col("ordinal"))).alias("b")
    return counts.where("n > 0").groupBy(group).agg(best).select(group, "b.channel", "b.n")
