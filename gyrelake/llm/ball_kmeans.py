"""Ball k-means over whole numbers: clusters are balls, and a vector meets only centroids that its ball lets near.

Components x become floor(256 * x) (x as double); all arithmetic after that is on whole numbers and exact: in
doubles while components are within ``SMALL``, in Python's integers beyond. The first ``k`` centroids are the
vectors whose ids have the least hashes. A round assigns every vector to the nearest centroid (ties: smaller
number) and moves each centroid to its vectors' componentwise floored mean; an empty cluster stays.

What a round compares: cluster i is the ball of radius R_i round its new centroid (the farthest member of the
last round plus the centroid's way). Only centroids at most 2 R_i away are its neighbours. A member at distance d
can be nearer to neighbour j only if j is at most 2 d away, so that neighbours sorted by distance split the ball
into a stable core, where nothing is compared, and annuli, each with one neighbour more. ``work`` counts comparisons.

A round is one pass over a written table of packed vectors and their clusters, in the shared folder; beside its rows
each task writes exact partial sums, a few rows for each cluster. Only sums over clusters (k times components rows)
reach the driver and only k centroids go to tasks, at any size; no row is shuffled, so that no cluster is too large.

Vectors that are null, have another number of components, or hold a null or non-finite one take no part. A null id
is kept and comes last among the ids that begin clusters; repeated rows are rows of their own (ties of ids: by
components). A component whose product leaves the doubles counts as the largest double; distances and
inertias beyond a long are given as the largest long. Other columns are ignored. An empty table gives an empty result;
with fewer than ``k`` vectors each begins a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch

K, ROUNDS, SCALE, DIMS, SEED = 40, 5, 256, 64, "2"
#: Components up to here give squared distances below 2 ** 53, which doubles hold exactly.
SMALL = 1 << 20
LONG = (1 << 63) - 1
LIMB = 32


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles, as doubles."""
    with np.errstate(over="ignore"):
        top = np.finfo(float).max
        return np.clip(np.floor(SCALE * values), -top, top)


def integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.vectorize(int, otypes=[object])(x)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: 16-bit numbers where they fit, doubles elsewhere."""
    small = (np.abs(x) < 1 << 15).all(1)
    near = np.where(small[:, None], x, 0).astype("<i2")
    return [n.tobytes() if s else r.astype("<f8").tobytes() for s, n, r in zip(small, near, x, strict=True)]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 2 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(-1, dims).astype(float)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dims else "<f8").astype(float) for r in rows]).reshape(-1, dims)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from the vector c."""
    apart = x - c
    return (apart * apart).sum(1)


def upward(value: int) -> float:
    """A double that is not below a whole number."""
    try:
        return float(value) * (1 + 1e-12)
    except OverflowError:
        return float("inf")


class Balls:
    """Centroids, the squared distances between them, and each one's neighbours, nearest first."""

    def __init__(self, centroids: list[list[int]], radii: list[float]):
        self.exact = np.array(centroids, object)
        self.small = max(abs(v) for c in centroids for v in c) <= SMALL
        self.doubles = self.exact.astype(float) if self.small else None
        self.neighbours, self.apart = [], []
        for i in range(len(centroids)):
            away = squares(self.exact, self.exact[i])
            reach = 4 * radii[i] * radii[i] * (1 + 1e-9) + 1
            near = sorted((away[j], j) for j in range(len(centroids)) if j != i and away[j] <= reach)
            self.neighbours.append([j for _, j in near])
            self.apart.append([d for d, _ in near])

    def nearest(self, x: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, comparisons) of whole rows x, each known to be in cluster ``guess``."""
        fits = self.small and (np.abs(x) <= SMALL).all()
        x, centroids, kind = (x, self.doubles, float) if fits else (integers(x), self.exact, object)
        cluster, distance, work = guess.copy(), np.zeros(len(x), kind), 0
        for i in np.unique(guess):
            at = np.flatnonzero(guess == i)
            own = squares(x[at], centroids[i])
            reach = np.searchsorted(np.array(self.apart[i], kind), 4 * own, "right")  # the annulus: so many neighbours may be nearer
            work += len(at) + int(reach.sum())
            order = np.argsort(-reach, kind="stable")
            at, own, reach = at[order], own[order], reach[order]
            rows, found = x[at[: np.count_nonzero(reach)]], np.full(len(at), i)  # the rest is the stable core
            for turn in range(int(reach.max(initial=0))):
                j = self.neighbours[i][turn]
                n = int(np.searchsorted(-reach, -turn, "left"))  # rows whose annulus has more than ``turn`` neighbours
                other = squares(rows[:n], centroids[j])
                better = (other < own[:n]) | ((other == own[:n]) & (j < found[:n]))
                own[:n] = np.where(better, other, own[:n])
                found[:n] = np.where(better, j, found[:n])
            cluster[at], distance[at] = found, own
        return cluster, distance, work


def limbs(value: int) -> list[int]:
    """A whole number as a sum of longs times powers of 2 ** LIMB."""
    out = []
    while not -(1 << 62) < value < 1 << 62:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class Sums:
    """Exact sums of a task for each cluster: components, count, inertia, comparisons; and the farthest member."""

    def __init__(self, k: int, dims: int):
        self.totals, self.far = [[0] * (dims + 3) for _ in range(k)], [0] * k

    def add(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, work: int) -> None:
        fits = distance.dtype != object
        self.totals[int(cluster[0])][-1] += work
        for i in np.unique(cluster):
            at = cluster == i
            own = (x[at] if fits else integers(x[at])).sum(0)
            for c, value in enumerate([*own, np.count_nonzero(at), distance[at].sum()]):
                self.totals[i][c] += int(value)
            self.far[i] = max(self.far[i], int(distance[at].max()))

    def rows(self) -> Iterator[tuple[int, int, list[int], float]]:
        """(cluster, limb, sums, farthest squared distance)."""
        for i, totals in enumerate(self.totals):
            if any(totals):
                parts = [limbs(t) for t in totals]
                for limb in range(max(map(len, parts))):
                    yield i, limb, [p[limb] if limb < len(p) else 0 for p in parts], upward(self.far[i])


ROWS = "vec_id long, v binary, cluster int, distance long"
SUMS = "limb int, sums array<long>, far double"


def ball_kmeans(spark: SparkSession, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    scratch = Scratch(spark, "kmeans")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    by = F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    begun = kept.orderBy(by, "embedding").limit(k).collect()  # k rows
    if not begun:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [[int(v) for v in whole(np.array(r["embedding"], float))] for r in begun]
    radii, table = [float("inf")] * len(centroids), kept

    def assign(balls: Balls, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(balls.exact), dims)
            for batch in batches:
                if not batch.num_rows:
                    continue
                if "v" in batch.schema.names:
                    v, guess = batch["v"].to_pylist(), batch["cluster"].to_numpy().astype(np.int64)
                    x = unpacked(v, dims)
                else:
                    x = whole(batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims))
                    v, guess = packed(x), np.zeros(len(x), np.int64)
                cluster, distance, work = balls.nearest(x, guess)
                sums.add(x, cluster, distance, work)
                n = len(x)
                away = [min(int(d), LONG) for d in distance]
                columns = [batch["vec_id"], pa.array([None] * n if last else v, pa.binary()), pa.array(cluster, pa.int32()), pa.array(away, pa.int64())]
                yield pa.record_batch([pa.array(["row"] * n), *columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.float64())], NAMES)
            rows = list(sums.rows())
            n, columns = len(rows), list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.float64()]
            cluster, *rest = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.record_batch([pa.array(["sum"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), cluster, pa.nulls(n, pa.int64()), *rest], NAMES)

        return run

    for turn in range(rounds + 1):
        last = turn == rounds
        name, balls = f"round{turn}", Balls(centroids, radii)
        table.mapInArrow(assign(balls, last), f"kind string, {ROWS}, {SUMS}").write.partitionBy("kind").mode("overwrite").parquet(scratch.path(name))
        table = spark.read.schema(ROWS).parquet(f"{scratch.path(name)}/kind=row")
        parts = spark.read.schema(f"cluster int, {SUMS}").parquet(f"{scratch.path(name)}/kind=sum")
        totals, far = gathered(parts, len(centroids), dims)
        if turn:
            scratch.drop(f"round{turn - 1}")
        if not last:
            moved = [[t // totals[i][dims] for t in totals[i][:dims]] if totals[i][dims] else c for i, c in enumerate(centroids)]
            way = [upward(int(squares(np.array([a], object), np.array(b, object))[0])) for a, b in zip(centroids, moved, strict=True)]
            radii = [(f**0.5 + w**0.5) * (1 + 1e-12) for f, w in zip(far, way, strict=True)]
            centroids = moved
    inertia = sum(t[dims + 1] for t in totals)
    ends = [(i, min(t[dims + 1], LONG), min(inertia, LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, (t, c) in enumerate(zip(totals, centroids, strict=True))]
    facts = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


NAMES = ["kind", "vec_id", "v", "cluster", "distance", "limb", "sums", "far"]


def gathered(parts: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[float]]:
    """(exact sums, farthest squared distance) of each cluster from the partial sums of all tasks."""
    each = parts.select("cluster", "limb", "far", F.posexplode("sums").alias("at", "value"))
    rows = each.groupBy("cluster", "limb", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.max("far").alias("far")).collect()
    totals, far = [[0] * (dims + 3) for _ in range(k)], [0.0] * k
    for r in rows:  # k times components, few limbs
        totals[r["cluster"]][r["at"]] += int(r["value"]) << (LIMB * r["limb"])
        far[r["cluster"]] = max(far[r["cluster"]], r["far"])
    return totals, far
