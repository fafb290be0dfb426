"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document holds a benchmark item when some stretch of it is within the item's edit budget,
``BUDGET`` of its length (semi-global edit distance over code points, after lower-casing and
joining white space). With k edits an item of length L keeps at least L + 1 - q * (k + 1) of its
character q-grams, all on k + 1 neighbouring diagonals (document position less item position), so
that shared q-grams are counted in overlapping bands of diagonals; bands below that bound cannot
hold the item. The others are verified by a banded alignment, which also gives place and edits. q is ``Q``,
and for a short item as much less as keeps the bound at 1 or more under its whole budget (5 at least);
an item shorter than ``Q`` has no edits in its budget and must occur as it is.

Benchmark items are read in blocks of about ``BLOCK_CHARS`` characters, each block a bounded index
that is broadcast; a larger benchmark takes more jobs, one pass over the documents each, whose hits are
written (``scan_blocks``), so that no worker holds two indexes. Documents are read whole and never meet each other.

Nulls: null or blank items match nothing; a null text is empty and holds nothing; null ids stay.
Repeated rows are searched one by one, repeated items report their own ids; other columns are
ignored, or carried along by ``drop_contaminated``. Empty tables give empty results or no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch, block_hits, claim, fresh, groups, scan_blocks

Q, BUDGET = 8, 0.1
BLOCK_CHARS = 16_000_000
_BASE = 0x100000001B3
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 20
_SHIFT = 32
#: Equal q-grams that are looked at together.
SLICE = 1_000_000


def normalise(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, their start in the text, their end): lower case, white space joined to one space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0) | (points == 0x3000)
    points[blank] = 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    return points[at], at, at + 1


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling as far as q has it, then a character at a time."""
    h, n, base = points.astype(np.uint64), 1, _BASE
    if len(h) < q:
        return h[:0]
    while 2 * n <= q:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % 2**64, 2 * n
    for more in range(n, q):
        h = h[:-1] * np.uint64(_BASE) + points[more:]
    return h * _SPREAD


def gram_length(length: int, edits: int) -> int:
    """The longest q up to ``Q`` of which an item keeps at least one under so many edits."""
    return min(Q, length // (edits + 1))


class Grams:
    """The q-grams of the items of a block that have the same q."""

    def __init__(self, q: int, items: list[int], points: list[np.ndarray], k: list[int]):
        self.q, self.items = q, np.array(items, np.int64)
        own = [grams(p, q) for p in points]
        self.width = np.array(k, np.int64) + 1  # of each item, so that a long one does not widen the bands of all
        self.need_of = np.array([len(p) + 1 - q * (e + 1) for p, e in zip(points, k, strict=True)], np.int64)
        g = np.concatenate(own)
        order = np.argsort(g, kind="stable")
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g))
        self.item = np.repeat(np.arange(len(own)), list(map(len, own)))[order]
        self.at = np.concatenate([np.arange(len(x)) for x in own])[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def postings(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, its position, diagonal) of all equal q-grams of text and items, in slices of about ``SLICE``."""
        h = grams(points, self.q)
        where = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        slot = np.searchsorted(self.grams, h[where])
        slot[slot == len(self.grams)] = 0
        same = self.grams[slot] == h[where]
        where, slot = where[same], slot[same]
        ends = np.cumsum(self.first[slot + 1] - self.first[slot])
        at = 0
        while at < len(where):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            first = self.first[slot[at:to]]
            n = self.first[slot[at:to] + 1] - first
            post = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
            yield self.item[post], self.at[post], np.repeat(where[at:to], n) - self.at[post]
            at = to

    def candidates(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of a band) wherever a band of 2 * width diagonals shares enough q-grams.

        Bands are counted slice by slice, so that a repetitive text and item, whose equal q-grams are
        as many as the product of their lengths, need no more room than their bands and positions.
        """
        lowest = -int(self.at.max(initial=0))
        span = len(points) - lowest + 2  # more than there are bands
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, _, diagonal in self.postings(points):
            k, n = np.unique(item * span + (diagonal - lowest) // self.width[item] + 1, return_counts=True)
            if len(keys):
                k, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                n = np.bincount(back, np.concatenate([counts, n]), len(k)).astype(np.int64)
            keys, counts = k, n
        if not len(keys):
            return []
        # a band and the next one overlap: every run of ``width`` diagonals lies inside some pair
        following = np.searchsorted(keys, keys + 1)
        following[following == len(keys)] = 0
        pair = counts + np.where(keys[following] == keys + 1, counts[following], 0)
        need = self.need_of[keys // span]
        found = np.union1d(keys[pair >= need], keys[counts >= need] - 1)  # also the pair that ends with this band
        if not len(found):
            return []
        # counted anew without repeats: an item's q-gram counts once in a band
        long = int(self.at.max()) + 1
        once = np.zeros(0, np.int64)
        for item, at, diagonal in self.postings(points):
            key = item * span + (diagonal - lowest) // self.width[item] + 1
            for back in (0, 1):  # the pair that begins with this band, and the one that ends with it
                slot = np.minimum(np.searchsorted(found, key - back), len(found) - 1)
                hit = found[slot] == key - back
                once = np.union1d(once, slot[hit] * long + at[hit])
        have = np.bincount(once // long, minlength=len(found))
        items = found // span
        ok = have >= self.need_of[items]
        first = (found % span - 1) * self.width[items] + lowest
        return list(zip(self.items[items[ok]].tolist(), first[ok].tolist(), strict=True))


class Index:
    """The items of a block, their edit budgets and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.points, self.k, self.short = [], [], [], []
        by_q: dict[int, list[int]] = {}
        for item_id, text in items:
            p = normalise((text or "").strip())[0]
            if not len(p):
                continue
            if len(p) < Q:
                self.short.append((item_id, p))
                continue
            k = int(BUDGET * len(p))
            by_q.setdefault(gram_length(len(p), k), []).append(len(self.ids))
            self.ids.append(item_id)
            self.points.append(p)
            self.k.append(k)
        self.width = np.array(self.k, np.int64) + 1
        self.parts = [Grams(q, own, [self.points[i] for i in own], [self.k[i] for i in own]) for q, own in sorted(by_q.items())]

    def candidates(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of a band) wherever q-grams let the item be."""
        return [x for part in self.parts for x in part.candidates(points)]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the items that ``text`` holds: the best place of each group of bands."""
        if not text:
            return []
        points, start, end = normalise(text)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, diagonal in self.candidates(points):
            if hit := self.align(points, item, diagonal):
                edits, a, b = hit
                key = (item, b)
                found[key] = min(found.get(key, hit), hit)
        out, last = [], {}
        for (item, _), (edits, a, b) in sorted(found.items()):
            if item in last and a < last[item][2]:  # the same place by another band
                if edits < last[item][0]:
                    last[item] = (edits, a, b)
                    out[-1] = (item, edits, a, b)
                continue
            last[item] = (edits, a, b)
            out.append((item, edits, a, b))
        rows = [(self.ids[i], int(start[a]), int(end[b - 1]), e) for i, e, a, b in out]
        if self.short:
            flat = "".join(map(chr, points.tolist()))
            for item_id, p in self.short:
                a = flat.find(word := "".join(map(chr, p.tolist())))
                while a >= 0:
                    rows.append((item_id, int(start[a]), int(end[a + len(p) - 1]), 0))
                    a = flat.find(word, a + len(p))
        return sorted(rows, key=lambda r: (str(r[0]), r[1:]))

    def align(self, points: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item inside the band's stretch of the text, or None above its budget.

        Semi-global distance, row by row over the item; a cell holds edits and the start that it
        comes from, and only cells within ``k`` of the band are kept.
        """
        p, k, width = self.points[item], self.k[item], int(self.width[item])
        first = max(0, diagonal)
        exact = points[first : max(0, diagonal + 2 * width + len(p))].tobytes().find(p.tobytes())
        if exact >= 0 and exact % 4 == 0:
            return 0, first + exact // 4, first + exact // 4 + len(p)
        lo, reach = diagonal - k, 2 * width + 2 * k  # diagonals lo .. lo + reach - 1
        one = np.int64(1) << _SHIFT
        far = np.int64(len(p) + 2) << _SHIFT
        cells = np.arange(reach + 1, dtype=np.int64)
        j = lo + cells  # text position before which a cell of row 0 stands
        inside = (j >= 0) & (j <= len(points))
        row = np.where(inside, np.maximum(j, 0), far)
        step = cells << _SHIFT
        padded = np.full(reach + 1 + len(p), 0xFFFFFFFF, np.uint32)
        a, b = max(0, lo), min(len(points), lo + len(padded))
        if a < b:
            padded[a - lo : b - lo] = points[a:b]
        for i in range(1, len(p) + 1):
            # cell c of row i stands at text position lo + c + i - 1 + ... : diagonal lo + c
            here = padded[i - 1 : i - 1 + reach + 1]
            j = lo + cells + i
            drop = np.full(reach + 1, far)
            change = row + np.where(here == p[i - 1], 0, one)
            change[(j < 1) | (j > len(points))] = far
            drop[:-1] = row[1:]
            drop += one  # item character without a partner: next diagonal of the row above
            now = np.minimum(change, drop)
            now = np.minimum.accumulate(now - step) + step  # text characters without a partner
            now[(j < 0) | (j > len(points))] = far
            row = np.minimum(now, far)
            if i % 16 == 0 and int(row.min() >> _SHIFT) > k:
                return None
        best = int(row.argmin())
        edits, start = int(row[best] >> _SHIFT), int(row[best] & (one - 1))
        return (edits, start, lo + best + len(p)) if edits <= k else None



def id_kind(benchmark: DataFrame) -> str:
    """Item ids are told as whole numbers where they are such, else as text."""
    return "bigint" if benchmark.schema["item_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


MATCH = "array<struct<item_id:{0},start:bigint,end:bigint,edits:bigint>>"


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``limit`` characters."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = int(total // limit) + 1
    for b in range(n):
        part = benchmark.select(F.col("item_id").cast(id_kind(benchmark)), "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (str(x[0]), x[1] or ""))


def found_in(index: Index, texts: list[str]) -> list[list[dict]]:
    """The matches of each text."""
    claim("decontamination")
    return [[{"item_id": i, "start": s, "end": e, "edits": d} for i, s, e, d in index.matches(t)] for t in texts]


def arrow_kind(kind: str) -> pa.DataType:
    return pa.list_(pa.struct([("item_id", pa.int64() if kind == "bigint" else pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def find_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and matches, an array of (item_id, start, end, edits), of every row of ``docs``."""
    kind = id_kind(benchmark)
    return scan_blocks(spark, docs, map(Index, blocks(benchmark, limit)), found_in, MATCH.format(kind), arrow_kind(kind))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated (1 or 0), n_matches and matches as item:start:end:edits, comma-joined."""
    found = find_matches(spark, docs, benchmark)
    told = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"], m["edits"])), ",")
    return found.select("doc_id", (F.size("matches") > 0).cast("long").alias("contaminated"), F.size("matches").cast("long").alias("n_matches"), told.alias("matches"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    indexes = map(Index, blocks(benchmark, limit))
    begun = list(islice(indexes, 2))
    if len(begun) < 2:
        index = spark.sparkContext.broadcast(begun[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            for part, texts in groups(batches):
                yield part.filter(pa.array([not index.value.matches(t) for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    (key,) = fresh(docs, "key")
    scratch, kind = Scratch(spark, "decontamination"), id_kind(benchmark)
    keyed = scratch.write("docs", docs.withColumn(key, F.monotonically_increasing_id()))
    hits = block_hits(scratch, keyed.select(F.col(key).alias("key"), "text"), chain(begun, indexes), found_in, MATCH.format(kind), arrow_kind(kind))
    return keyed.join(hits.select(F.col("key").alias(key)).distinct(), key, "left_anti").drop(key)
