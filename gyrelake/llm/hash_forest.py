"""Approximate nearest neighbours by cosine: a forest of sorted hash strings, searched by longest prefixes.

Each of ``TREES`` trees gives a vector a long hash string: a symbol of 7 bits (which axis of a random rotation of
64 axes lies nearest, and on which side), then ``FINE`` symbols of 4 bits (the same over 8 random axes each). A tree is
the sorted array of its strings: vectors that share a prefix are neighbours in it. A query descends to its place in
every tree and then ascends in all trees at once, one symbol at a time, until the rows that share its prefix number
``ENOUGH`` over all trees; all of them are scored exactly, on the original vectors.

On Spark a tree's array is range-partitioned by (tree, string) and sorted in the partitions ("tiles" of about
``TILE`` rows). A first pass moves strings alone and counts, for each query and prefix length, the rows
that share it; a second pass moves the vectors and scores each query's ranges. Trees go through in groups whose arrays
hold at most ``AT_ONCE`` rows (or one tree), so that the disk a pass takes is bounded. Every row is in every array; no
vector goes to the driver, only the random axes go to tasks, and these are drawn, not fitted.

A prefix's range ends where its tile ends, so that a query beside a tile's border may miss rows in that tree
(others have their borders elsewhere), and a group of equal strings larger than a tile is searched one tile
in each tree, another one each time (equal strings are ordered by a hash of row and tree). Bit-identical vectors are one
row of the forest with their least ids, which is exact: a third of all rows may be one vector. ``TREES`` and
``ENOUGH`` set effort and recall.

Vectors take no part when they or their vec_id are null, when a component is null or not finite, or when all are zero. Shorter vectors count as
padded with zeros; components beyond the 64th are folded into the first 64 by signs for the strings only. Repeated
rows are rows of their own; ties go to the smaller vec_id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch, salted_join

K, EVERY, TREES, ENOUGH = 5, 50, 48, 3000
WIDTH, AXES, FINE = 64, 8, 9
#: Bits of the string that a prefix of so many symbols has.
BITS = [0, *(7 + 4 * i for i in range(FINE + 1))]
ALL = BITS[-1]
TILE, AT_ONCE = 1 << 17, 1 << 30
CELLS, ASKED = 1 << 20, 64


def axes(trees: int = TREES, seed: int = 13) -> np.ndarray:
    """[tree, component, axis]: a rotation for the first symbol, orthonormal axes for each of the others."""
    rng = np.random.default_rng(seed)
    parts = [[np.linalg.qr(rng.standard_normal((WIDTH, n)))[0] for n in (WIDTH, *[AXES] * FINE)] for _ in range(trees)]
    return np.stack([np.hstack(p) for p in parts])


class Vectors:
    """Rows of an Arrow list array; dense blocks of them are made on demand, padded with zeros."""

    def __init__(self, column: pa.ListArray):
        self.flat = column.flatten().to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def block(self, rows: np.ndarray) -> np.ndarray:
        """Those rows scaled by powers of two, so that no square leaves the doubles."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        width = int(sizes.max(initial=0))
        if (sizes == width).all():
            out = self.flat[self.ends[rows][:, None] + np.arange(width)].astype(float)
        else:
            out = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                out[i, : sizes[i]] = self.flat[self.ends[r] : self.ends[r + 1]]
        top = np.abs(out).max(1, initial=0)
        odd = (top > 1e100) | (top < 1e-100)
        if odd.any():
            out[odd] = np.ldexp(out[odd], -np.frexp(top[odd])[1][:, None])
        return out

    def pieces(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        """Row numbers from lo to hi, in runs of at most CELLS components (a row at least)."""
        while lo < hi:
            to = max(lo + 1, int(np.searchsorted(self.ends, self.ends[lo] + CELLS, "right")) - 1)
            yield np.arange(lo, min(to, hi))
            lo = to


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def folded(x: np.ndarray) -> np.ndarray:
    """Rows of WIDTH components: later ones are added to the first with a sign of their block."""
    out = np.zeros((len(x), WIDTH))
    for block in range(0, x.shape[1], WIDTH):
        part = x[:, block : block + WIDTH]
        sign = np.where(np.random.default_rng(block).integers(0, 2, part.shape[1]), 1, -1) if block else 1
        out[:, : part.shape[1]] += part * sign
    return out


def strings(x: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """[row, tree]: the hash strings as whole numbers, first symbol in the highest bits."""
    out = np.zeros((len(x), len(drawn)), np.int64)
    for tree, a in enumerate(drawn):
        y = x @ a
        at, value = 0, np.zeros(len(x), np.int64)
        for n in (WIDTH, *[AXES] * FINE):
            part = y[:, at : at + n]
            axis = np.abs(part).argmax(1)
            value = value * (2 * n) + 2 * axis + (part[np.arange(len(x)), axis] > 0)
            at += n
        out[:, tree] = value
    return out


def spans(hashes: np.ndarray, asked: np.ndarray, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the rows that share the first ``bits`` bits with each asked string."""
    shift = ALL - np.asarray(bits)
    first = (asked >> shift) << shift
    return np.searchsorted(hashes, first, "left"), np.searchsorted(hashes, first + (np.int64(1) << shift), "left")


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition's rows, one tree after another."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    trees = table["tree"].to_numpy()
    ends = [0, *(np.flatnonzero(np.diff(trees)) + 1), len(trees)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield table.slice(a, b - a)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, depth and n: how many rows of the tile share so many symbols with each asked row."""
    for tile in tiles(batches):
        hashes, asked = tile["hash"].to_numpy(), np.flatnonzero(tile["asked"].to_numpy(zero_copy_only=False))
        if len(asked):
            cls, own = tile["cls"].to_numpy()[asked], hashes[asked]
            n = np.concatenate([np.subtract(*spans(hashes, own, b)[::-1]) for b in BITS])
            yield pa.record_batch([pa.array(np.tile(cls, len(BITS))), pa.array(np.repeat(np.arange(len(BITS)), len(cls)), pa.int32()), pa.array(n, pa.int64())], ["cls", "depth", "n"])


class Best:
    """The k best rows of each of some queries: score down, then least id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, r, s = np.concatenate([self.query, query]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((ids[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        self.query, self.row, self.score = (x[place < self.k] for x in (q, r, s))
        full = place == self.k - 1
        self.floor[q[full]] = s[full]


def nearest(vectors: Vectors, ids: np.ndarray, asked: np.ndarray, lo: int, hi: int, k: int) -> Best:
    """The k rows from lo to hi of largest cosine with each asked row (its own among them)."""
    best, own = Best(len(asked), k), vectors.block(asked)
    near = unit(own)
    for rows in vectors.pieces(lo, hi):
        x = vectors.block(rows)
        width = min(x.shape[1], near.shape[1])
        about = unit(x)[:, :width] @ near[:, :width].T  # picks; the score below is summed pair by pair, alike in every tile
        kth = np.partition(about, -k, axis=0)[-k] if len(rows) > k else np.full(len(asked), -np.inf)
        r, q = np.nonzero(about >= np.maximum(kth, best.floor) - 1e-9)
        a, b = x[r], own[q]
        score = (a[:, :width] * b[:, :width]).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        best.add(q, rows[r], score, ids)
    return best


def scored(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles(batches):
            level = tile["level"].to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(~np.isnan(level))
            if not len(asked):
                continue
            hashes, cls, ids = (tile[c].combine_chunks() for c in ("hash", "cls", "ids"))
            vectors, least = Vectors(tile["v"].combine_chunks()), pc.list_element(ids, 0).to_numpy()
            lo, hi = spans(hashes.to_numpy(), hashes.to_numpy()[asked], np.array(BITS)[level[asked].astype(int)])
            order = np.lexsort((hi, lo))
            cuts = np.flatnonzero(np.diff(lo[order]) | np.diff(hi[order])) + 1
            for alike in np.split(order, cuts):  # queries of one range
                for at in range(0, len(alike), ASKED):
                    some = asked[alike[at : at + ASKED]]
                    best = nearest(vectors, least, some, int(lo[alike[0]]), int(hi[alike[0]]), k)
                    found = pa.array(best.row)
                    yield pa.record_batch([cls.take(pa.array(some[best.query])), cls.take(found), pa.array(best.score), ids.take(found)], ["query", "cls", "score", "ids"])

    return run


def forest_search(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, enough: int = ENOUGH, tile: int = TILE, at_once: int = AT_ONCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine): the k nearest rows found of every query row."""
    scratch = Scratch(spark, "forest")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    key = F.concat_ws("-", F.xxhash64("embedding"), F.xxhash64(F.lit(17), F.reverse("embedding")))  # 128 bits stand for a vector
    rows = vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", key.alias("key"))
    kind = rows.schema["embedding"].dataType.simpleString()
    asks = F.col("vec_id") % every == 0
    # of equal vectors the k + 1 least ids can be among the k nearest of a query, itself left out
    turn = F.row_number().over(Window.partitionBy("key", "asked").orderBy("vec_id"))
    few = rows.withColumn("asked", asks).withColumn("turn", turn).where(F.col("turn") <= k + 1)
    alike = few.groupBy("key").agg(F.first("embedding").alias("v"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
    drawn = spark.sparkContext.broadcast(axes(trees))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = Vectors(batch["v"])
            parts = [strings(folded(unit(x.block(at))), drawn.value) for at in x.pieces(0, batch.num_rows)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * trees, pa.int32()), pa.array(flat))
            yield batch.append_column("hashes", hashes)

    shape = f"key string, v {kind}, ids array<long>, asked boolean"
    classes = scratch.write("classes", alike.mapInArrow(hashed, f"{shape}, hashes array<long>").withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    step = min(trees, max(1, at_once // max(n, 1)))
    groups_of_trees = [(a, min(step, trees - a)) for a in range(0, trees, step)]

    def arrays(table: DataFrame, first: int, of: int, *columns: str) -> DataFrame:
        """The sorted arrays of some trees, cut into tiles."""
        each = table.select("cls", *columns, F.posexplode(F.slice("hashes", first + 1, of)).alias("tree", "hash"))
        by = ["tree", "hash", F.xxhash64("cls", "tree")]
        return each.repartitionByRange(-(-max(1, n) * of // tile), *by).sortWithinPartitions(*by)

    for a, of in groups_of_trees:
        scratch.write(f"counts{a}", arrays(classes, a, of, "asked").mapInArrow(counted, "cls long, depth int, n long"))
    together = spark.read.schema("cls long, depth int, n long").parquet(*(scratch.path(f"counts{a}") for a, _ in groups_of_trees))
    level = F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("depth"))), F.lit(0)).alias("level")
    levels = scratch.write("levels", together.groupBy("cls", "depth").agg(F.sum("n").alias("n")).groupBy("cls").agg(level))
    leveled = classes.join(levels, "cls", "left")
    found_kind = "query long, cls long, score double, ids array<long>"
    for a, of in groups_of_trees:
        scratch.write(f"found{a}", arrays(leveled, a, of, "level", "v", "ids").mapInArrow(scored(k + 1), found_kind))
    found = spark.read.schema(found_kind).parquet(*(scratch.path(f"found{a}") for a, _ in groups_of_trees)).dropDuplicates(["query", "cls"])
    first_classes = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1))
    few_classes = found.withColumn("turn", F.row_number().over(first_classes)).where(F.col("turn") <= k + 1)
    near = few_classes.select("query", "score", (F.col("query") == F.col("cls")).alias("own"), F.explode("ids").alias("vec_id"))
    # k + 1 classes of k + 1 ids at most
    order = lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1).otherwise(0)
    lists = near.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id", "own")), order), 1, k + 1).alias("best"))
    answers = lists.join(classes.select(F.col("cls").alias("query"), "key"), "query").select("key", "best")
    queries = scratch.write("queries", rows.where(asks).select(F.col("vec_id").alias("query_id"), "key"))
    both = salted_join(queries, scratch.write("answers", answers), "key", "query_id")
    own = F.array_position(F.transform("best", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("at")), 1, k)
    ranked = both.withColumn("at", own).select("query_id", F.posexplode(others).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
