"""Importance resampling towards a target: hashed word-run features, noise-keyed scores, a merge of sorted runs.

Features of a text are all runs of 1 to ``RUN`` consecutive words, repeats counted; a feature's bucket
is its bytes' crc32 modulo ``BUCKETS``. Counts of the source (``docs``) and of the target give each
bucket a gain, floor(1000 ln of the smoothed share in the target over that in the source). A document's
weight is the floored mean of its features' gains, its score adds Gumbel noise drawn from its id.
Of the documents with ``LEAST`` words or more, ``SHARE`` percent of highest score are drawn.

The draw is a merge, not a sort: every partition writes its eligible rows as one sorted run; exact counts of
the scores (whole numbers of a bounded range, see ``SCORES``) name the least score that can be drawn; runs
are cut into ranges of about ``RANGE`` rows; and a tournament tree merges the pieces of all runs inside
a range, knows the ranks before it from the counts of earlier ranges and stops at the exact draw count.
No range, however large the draw, is more than one task's bounded work, and a hot key (equal scores and
ids) is cut by its place in the runs.

Null texts count as without words; a text without words has no feature and weight 0. A null id counts as the
empty text in its hash and comes last among ties. Repeated rows are rows of their own. Texts are read whole,
in slices of ``SLICE`` bytes that end at a word's end. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch, groups

BUCKETS, RUN, LEAST, SHARE, SEED = 10_000, 2, 20, 25, "7"
SLICE, RANGE = 1 << 20, 1 << 20
#: Distinct scores there can be: gains lie within 1000 ln(2 ** 127) either way, noise between -3,200 and 22,900.
SCORES = 2 * 88_100 + 26_100

#: Letters, digits and bytes from 80 on are of words, A-Z in lower case; all else is space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slices(data: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of spaced bytes, some ``size`` bytes at a time, no word cut."""
    at = 0
    while at < len(data):
        to = at + size
        if to < len(data):
            cut = data.rfind(b" ", at, to)
            to = cut if cut > at else data.find(b" ", to)
            to = len(data) if to < 0 else to
        words = data[at:to].split()
        at = to
        if words:
            yield words


def features(text: str, n_buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, int]:
    """(buckets of all features, number of words) of a text.

    A run's checksum continues that of the run one word shorter, so that no feature is built as text.
    """
    found, n_words = [], 0
    before: list[list[int]] = [[] for _ in range(run)]  # checksums, with a space behind, of the runs that end where the slice begins
    for words in slices(text.encode("utf-8", "surrogatepass").translate(_WORDS)):
        n_words += len(words)
        sums = list(map(crc32, words))
        found.append(np.fromiter(sums, np.uint32, len(sums)))
        for length in range(1, run):
            spaced = before[length] + list(map(crc32, repeat(b" "), sums))
            ended = words[1:] if not before[length] else words
            before[length] = spaced[-1:]
            sums = list(map(crc32, ended, spaced))
            found.append(np.fromiter(sums, np.uint32, len(sums)))
            words = ended
            if not words:
                break
    return (np.concatenate(found) if found else np.zeros(0, np.uint32)).astype(np.int64) % n_buckets, n_words


def bucket_counts(texts: DataFrame, text: str, n_buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket; a row for each bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for _, rows in groups(batches, text):
            for row in rows:
                total += np.bincount(features(row, n_buckets, run)[0], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for bucket, n in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_source + b) / ((s + 1.0) * (all_target + b))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target, strict=True)], np.int64)


def noise(doc_id, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, drawn from the id's hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, run: int = RUN, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            ids, rows = part["doc_id"].to_pylist(), []
            for doc_id, text in zip(ids, texts, strict=True):
                buckets, n_words = features(text, len(gains), run)
                weight = int(gains[buckets].sum()) // len(buckets) if len(buckets) else 0
                rows.append((doc_id, n_words, len(buckets), weight, weight + noise(doc_id, seed)))
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A loser tree over sorted runs: ``pop`` gives the least head; only the path of the run it came from is played again."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1 << max(1, (len(runs) - 1).bit_length())
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size  # of the match at each inner node
        winners = list(range(self.size))
        first = self.size
        while len(winners) > 1:
            first //= 2
            pairs = list(zip(winners[::2], winners[1::2], strict=True))
            winners = [a if self._before(a, b) else b for a, b in pairs]
            self.losers[first : first + len(pairs)] = [b if w == a else a for w, (a, b) in zip(winners, pairs, strict=True)]
        self.winner = winners[0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def pop(self):
        """The least head, or None when all runs have ended."""
        run = self.winner
        head = self.heads[run]
        if head is None:
            return None
        self.heads[run] = next(self.runs[run], None)
        node = (self.size + run) // 2
        while node:
            other = self.losers[node]
            if self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.winner = run
        return head


def merged(keys: np.ndarray, scores: np.ndarray, ids: list, limit: int) -> list[int]:
    """The ``limit`` first keys by (score down, id up, key); keys of one run (key >> 33) are in order already."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.diff(keys[order] >> 33)) + 1

    def run(rows: np.ndarray) -> Iterator[tuple]:
        return ((-int(scores[i]), ids[i] is None, ids[i] or 0, int(keys[i])) for i in rows)

    tree, out = Tournament([run(rows) for rows in np.split(order, ends)]), []
    while len(out) < limit and (head := tree.pop()) is not None:
        out.append(head[-1])
    return out


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, rows_a_range: int = RANGE) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document."""
    scratch = Scratch(spark, "resample")
    gains = bucket_gains(bucket_counts(docs, "text"), bucket_counts(target, "text"))
    able = F.col("n_words") >= least
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # a partition is a run: its rows in the order of the draw; the key holds the run and the place in it
    runs = scratch.write("runs", scored(docs, gains).sortWithinPartitions(*by).withColumn("key", F.monotonically_increasing_id()))
    tally = sorted(runs.where(able).groupBy("score").count().collect(), reverse=True)  # at most SCORES rows
    draw = share * sum(n for _, n in tally) // 100
    above, cut = 0, None
    for score, n in tally:
        if above >= draw:
            break
        above, cut = above + n, score
    if cut is None:
        return runs.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    live = runs.where(able & (F.col("score") >= cut)).select("score", "doc_id", "key")
    n_ranges = -(-above // rows_a_range)
    pieces = scratch.write("pieces", live.repartitionByRange(n_ranges, *by, F.asc("key")).withColumn("range", F.spark_partition_id()))
    begins, wanted = 0, {}  # a number for each range: its first rank and how many rows of it are drawn
    for number, n in sorted(pieces.groupBy("range").count().collect()):
        if begins < draw:
            wanted[number] = (begins, min(n, draw - begins))
        begins += n

    def merge(table: pa.Table) -> pa.Table:
        first, limit = wanted[table["range"][0].as_py()]
        keys = merged(table["key"].to_numpy(), table["score"].to_numpy(), table["doc_id"].to_pylist(), limit)
        return pa.table({"key": pa.array(keys, pa.int64()), "rank": pa.array(range(first + 1, first + 1 + len(keys)), pa.int64())})

    ranks = pieces.where(F.col("range") <= max(wanted)).groupBy("range").applyInArrow(merge, "key long, rank long")
    return runs.join(scratch.write("ranks", ranks), "key", "left").select("doc_id", "n_features", "weight", "score", "rank")
