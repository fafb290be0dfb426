"""Exact top-k search by inner product: a ball tree in every shard, searched by branch and bound.

Components x become floor(256 * x) (x as double). Queries are the rows whose vec_id is divisible
by ``EVERY``; a query's candidates are all rows but itself. Rows are cut into shards of at most
``SHARD`` vectors; each shard's tree is built once, in the task that holds the shard, and written. Queries
go over the shards in blocks of about ``BLOCK`` (bounded, broadcast), each block as two distributed jobs:
every ``FIRST``-th shard is searched without a bound, which gives each query a kth score that all other
shards then start from. No task holds more than a shard and a block, and the driver searches nothing.

In a shard, a node's bound for query q is q.center + |q| * radius. Nodes whose bound is below the
query's kth score are cut off; leaves are visited in the order of their bounds, each visit raising
the score. Scores are whole numbers, exact as doubles while below 2 ** 53; larger ones are
computed with Python's integers, and those beyond a long count as the largest or least long (so that such
rows tie). A component whose product leaves the doubles counts as the largest double.

Rows take no part when their vec_id or vector is null or a component is null or not finite.
Vectors of other lengths count as padded with zeros; an empty vector scores 0. Repeated rows are rows
of their own: each is a query and a candidate for the other. Ties go to the smaller vec_id. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch

K, EVERY, SCALE = 5, 50, 256
SHARD, BLOCK, LEAF, FIRST = 16_384, 8_192, 64, 8
EXACT, LONG = float(1 << 53), (1 << 63) - 1


def matrix(rows: list[list[float]], width: int = 0) -> np.ndarray:
    """Vectors of whole doubles padded with zeros; doubles, or Python integers where products might round."""
    width = max(width, max(map(len, rows), default=0))
    if all(len(r) == width for r in rows):
        x = np.array(rows, float).reshape(len(rows), width)
    else:
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
    return x if np.abs(x).max(initial=0) < 2.0**52 else np.vectorize(int, otypes=[object])(x)


def pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x and q, as doubles or Python integers within a long."""
    if x.dtype != object and q.dtype != object:
        big = np.sqrt((x * x).sum(1)).max(initial=0) * np.sqrt((q * q).sum(1)).max(initial=0)
        if big * max(1, x.shape[1]) < EXACT:
            return x @ q.T
    whole = lambda m: m if m.dtype == object else np.vectorize(int, otypes=[object])(m)
    if not (x.size and q.size):
        return np.zeros((len(x), len(q)), object)
    return np.maximum(np.minimum(whole(x) @ whole(q).T, LONG), -LONG - 1)


class Best:
    """The k best of each query: (score, vec_id) in order, with the kth score."""

    def __init__(self, floors: list, k: int):
        self.k, self.floor, self.found, self.visits = k, list(floors), [[] for _ in floors], 0

    def add(self, query: int, score: int, vec_id: int) -> None:
        rows = self.found[query]
        rows.append((-score, vec_id))
        rows.sort()
        del rows[self.k :]
        if len(rows) == self.k and (self.floor[query] is None or -rows[-1][0] > self.floor[query]):
            self.floor[query] = -rows[-1][0]


class BallTree:
    """Balls over the rows of x: split at the median of the direction of the widest two rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x.astype(float)
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []  # from, to, center, radius, children
        if len(x):
            self._build(0, len(x), leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        rows = self.x[self.order[a:b]]
        with np.errstate(all="ignore"):
            center = rows.mean(0)
            away = np.sqrt(((rows - center) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append((a, b, center, float(away.max()), -1, -1))
        if b - a > leaf and away.max() > 0:
            middle = (a + b) // 2
            with np.errstate(all="ignore"):
                one = rows[away.argmax()]
                two = rows[((rows - one) ** 2).sum(1).argmax()]
                self.order[a:b] = self.order[a:b][np.argsort(rows @ (one - two), kind="stable")]
            left = self._build(a, middle, leaf)
            right = self._build(middle, b, leaf)
            self.nodes[me] = (*self.nodes[me][:4], left, right)
        return me

    def bounds(self, q: np.ndarray, floors: list, norms: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
        """(leaves, bounds [query, leaf]); minus infinity where a ball above the leaf is cut off."""
        q = q.astype(float)
        norms = np.sqrt((q * q).sum(1)) if norms is None else norms
        low = np.array([-np.inf if f is None else float(f) for f in floors])
        leaves, columns = [], []
        stack = [(0, np.full(len(q), np.inf))] if self.nodes else []
        while stack:
            node, above = stack.pop()
            _, _, center, radius, left, right = self.nodes[node]
            with np.errstate(all="ignore"):
                bound = q @ center + norms * radius
                bound = bound + np.abs(bound) * 1e-9 + 1
            bound[np.isnan(bound)] = np.inf  # beyond doubles nothing is known, so nothing is cut off
            bound = np.where((bound >= low) & (above > -np.inf), bound, -np.inf)
            if not (bound > -np.inf).any():
                continue
            if left < 0:
                leaves.append(node)
                columns.append(bound)
            else:
                stack += [(left, bound), (right, bound)]
        return leaves, np.stack(columns, 1) if columns else np.zeros((len(q), 0))


class Shard:
    """The rows of a shard, whole numbers, and their tree."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: list[list[float]]):
        self.ids, self.keys, self.x = ids, keys, matrix(vectors)
        self.tree = BallTree(self.x)
        if self.x.dtype != object:
            self.tree.x = self.x  # one array, not two


def search(shard: Shard, q: np.ndarray, query_keys: np.ndarray, floors: list, k: int = K) -> Best:
    """The k best rows of the shard for each query, as far as they reach the query's floor."""
    x, ids, keys, tree = shard.x, shard.ids, shard.keys, shard.tree
    own, width = x.shape[1], max(x.shape[1], q.shape[1])
    best = Best(floors, k)
    # components that the shard's rows lack count as zeros there, and as zeros in the query where it lacks them
    with np.errstate(over="ignore"):
        norms = np.sqrt((q.astype(float) ** 2).sum(1))
    q = pad(q, width)[:, :own]
    leaves, bounds = tree.bounds(q, floors, norms)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for turn in range(len(leaves)):
        at = order[:, turn]
        bound = bounds[np.arange(len(q)), at]
        low = np.array([-np.inf if f is None else float(f) for f in best.floor])
        live = np.flatnonzero((bound > -np.inf) & (bound >= low))
        if not len(live):
            break
        for leaf in np.unique(at[live]):
            queries = live[at[live] == leaf]
            a, b = tree.nodes[leaves[leaf]][:2]
            rows = tree.order[a:b]
            best.visits += len(queries)
            scores = products(x[rows], q[queries])
            cut = np.array([-np.inf if best.floor[j] is None else float(best.floor[j]) for j in queries])
            hit = (scores.astype(float) >= cut - np.abs(cut) * 1e-9) & (keys[rows][:, None] != query_keys[queries][None, :])
            for r, c in zip(*np.nonzero(hit), strict=True):
                best.add(int(queries[c]), int(scores[r, c]), int(ids[rows[r]]))
    return best


def top_k(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best rows of every query row."""
    scratch = Scratch(spark, "topk")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        top = np.finfo(float).max
        for batch in batches:
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(SCALE * batch["v"].flatten().to_numpy(zero_copy_only=False)), -top, top)
            ends = np.append(0, np.cumsum(pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)))
            columns = [batch["vec_id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole)), pa.array(np.arange(at, at + batch.num_rows), pa.int64())]
            yield pa.record_batch(columns, ["vec_id", "v", "key"])
            at += batch.num_rows

    table = scratch.write("rows", rows.mapInArrow(number, "vec_id long, v array<double>, key long"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shard_arrays(batches):
            yield pa.record_batch([pa.array([pickle.dumps(Shard(*shard), 5)], pa.binary())], ["tree"])

    n_shards = -(-table.count() // SHARD) or 1
    shards = scratch.write("shards", table.repartition(n_shards, "key").mapInArrow(build, "tree binary").withColumn("shard", F.monotonically_increasing_id()))
    ids = [r["shard"] for r in shards.select("shard").sort("shard").collect()]  # a number for each SHARD rows
    first = set(ids[::FIRST])
    asked = scratch.write("asked", table.where(F.col("vec_id") % every == 0))
    n_blocks = -(-asked.count() // BLOCK) or 1
    parts: list[str] = []

    def scan(wanted: DataFrame, block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, query_keys, query_ids, floors = block.value
            for batch in batches:
                for tree in batch["tree"]:
                    best = search(pickle.loads(tree.as_buffer()), q, query_keys, floors, k)
                    flat = [(int(query_keys[j]), query_ids[j], i, -s) for j, found in enumerate(best.found) for s, i in found]
                    yield pa.record_batch([pa.array([x[c] for x in flat], pa.int64()) for c in range(4)], ["key", "query_id", "vec_id", "score"])

        return wanted.select("tree").mapInArrow(run, "key long, query_id long, vec_id long, score long")

    for b in range(n_blocks):
        got = sorted(asked.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n_blocks)) == b).select("key", "vec_id", "v").collect())  # about BLOCK rows
        if not got:
            continue
        q, query_keys, query_ids = matrix([r["v"] for r in got]), np.array([r["key"] for r in got]), [r["vec_id"] for r in got]
        begun = spark.sparkContext.broadcast((q, query_keys, query_ids, [None] * len(got)))
        seen = scratch.write(f"first{b}", best_of(scan(shards.where(F.col("shard").isin(first)), begun), k))
        parts.append(f"first{b}")
        if len(ids) > len(first):
            kth = {r["key"]: r["score"] for r in seen.where(F.col("rank") == k).select("key", "score").collect()}  # a row for each query of the block
            raised = spark.sparkContext.broadcast((q, query_keys, query_ids, [kth.get(int(key)) for key in query_keys]))
            scratch.write(f"rest{b}", best_of(scan(shards.where(~F.col("shard").isin(first)), raised), k))
            parts.append(f"rest{b}")
    kinds = "key long, query_id long, vec_id long, score long, rank int"
    if not parts:
        return spark.createDataFrame([], kinds).select("query_id", "rank", "vec_id", "score")
    return best_of(spark.read.schema(kinds).parquet(*map(scratch.path, parts)).drop("rank"), k).select("query_id", "rank", "vec_id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shard_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[float]]]]:
    """The task's rows in arrays of SHARD rows at most."""
    ids, keys, vectors = [], [], []
    for batch in batches:
        ids += batch["vec_id"].to_pylist()
        keys += batch["key"].to_pylist()
        vectors += batch["v"].to_pylist()
        while len(ids) >= SHARD:
            yield np.array(ids[:SHARD]), np.array(keys[:SHARD]), vectors[:SHARD]
            ids, keys, vectors = ids[SHARD:], keys[SHARD:], vectors[SHARD:]
    if ids:
        yield np.array(ids), np.array(keys), vectors
