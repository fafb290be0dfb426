"""Hashed maximum-entropy language model with class-factored softmax.

log10 P(text) = sum over tokens of log10 P(class | context) + log10 P(word | class, context). Tokens are words
(lower case A-Z, split at ASCII white space), then one end token for each text; the end also stands
before the first word. A word's class is a hash of its last two bytes, or of six where these are not ASCII
(``CLASSES`` in all, the end has its own). Both factors are maximum-entropy models over hashed features:

* P(class | context): bias, the word before (n-gram), the word before that (skip), and the two together.
* P(word | class, context): a word's features are its own hash inside the class (``BINS``) with the word before and
  with the word before that, over its add-half count as reference: P is (c + 0.5) * exp(weights) over the sum of the
  same over all words of the class, with a place in every bin for words not seen in training. Words of one bin share their
  weights, so that this sum over the whole vocabulary is exact and goes over the bins.

Training, over all rows whose crc32(doc_id as text; null: empty) mod ``FOLDS`` is not ``HELD``: one
pass counts every word and every (context, class) and (context, class and bin) cell; cells are the sufficient
statistics of both factors and bounded (``CELLS``, ``INNER``), whatever the corpus is. Each of ``STEPS`` updates
computes the expected feature counts over the partitions of a cell table, adds them up feature by feature
in tasks, and moves the weights by the gradient of the likelihood with a quadratic penalty, scaled by the
features' counts. The driver is sent one row for each feature, however many partitions there are.

Scoring: a worker makes the tables of log probabilities from the weights, a batch looks up its tokens' cells there (numpy), and word
counts of the ``HEAD`` most frequent words (bounded, broadcast); all other words are joined with the
whole count table, so that no count is cut off. Texts are whole.

Nulls: a null text counts as empty (its end token alone); null ids stay and are training rows. Without
training rows c, N and V are 0. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import Scratch, crc_text, hash_word, mix, slices

FOLDS, HELD = 5, 1
CLASSES, BEFORE, SKIP, PAIRS = 48, 512, 64, 4096
CONTEXTS = BEFORE * SKIP
CELLS = CONTEXTS * CLASSES
#: The word factor: bins of a class, buckets of the word before that (those of the word before are ``BEFORE``), cells.
BINS, NEAR = 32, 8
OUTCOMES = CLASSES * BINS
INNER = BEFORE * NEAR * OUTCOMES
STEPS, RATE, PENALTY, PARTS = 8, 0.5, 5.0, 8
HEAD, HEAD_BYTES = 131_072, 64
#: Distinct words that a task of the survey holds before it merges them, and cells that it sends at once.
FLUSH, CHUNK = 600_000, 1 << 19
END = b"\n"  # no word is white space
#: Bytes of a word that are hashed at once with other words; longer ones go one by one.
SHORT = 64
#: Features of the class factor and of the word factor, below each other; a row of sums has what was seen and what is expected.
FEATURES, WORD_FEATURES = BEFORE + SKIP + PAIRS, BEFORE + NEAR
SUMS = "at int, part int, sums binary, fit double"


def _bytes(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one integer; ``data`` has eight more bytes at its end."""
    found = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[at]
    return np.where(n >= 8, found, found & ((np.uint64(1) << (8 * np.minimum(n, 7)).astype(np.uint64)) - np.uint64(1)))


def codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(class * ``BINS`` + bin, hash) of words, an array of strings or binaries; END has a class of its own."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    body = words.buffers()[2]
    data = np.concatenate([np.frombuffer(body, np.uint8)[: starts[-1]] if body else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    starts, ends = starts[:-1], starts[1:]
    n = ends - starts
    h = mix(n)
    for at in range(0, SHORT, 8):
        some = np.flatnonzero(n > at)
        h[some] = mix(h[some] * np.uint64(0x9E3779B97F4A7C15) ^ _bytes(data, starts[some] + at, n[some] - at))
    for i in np.flatnonzero(n > SHORT):
        h[i] = hash_word(data[starts[i] : ends[i]].tobytes())
    wide = (data[ends - 1] | data[np.maximum(ends - 2, starts)]) >= 128
    at = np.maximum(ends - np.where(wide, 6, 2), starts)
    tail = _bytes(data, at, ends - at)
    kind = (mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64)
    kind[(n == 1) & (data[starts] == END[0])] = CLASSES - 1
    return kind * BINS + (h >> np.uint64(40)).astype(np.int64) % BINS, h


@dataclass
class Tokens:
    """The tokens of some texts in their order: distinct words (END last), and of every token its word, its text and its cells."""

    words: pa.Array
    outcome: np.ndarray  # of every distinct word
    token: np.ndarray
    text: np.ndarray
    cell: np.ndarray
    inner: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    if (blank := pc.index(words, "").as_py()) >= 0:  # before leading and after trailing white space
        text, ids = text[ids != blank], ids[ids != blank]
    words = pa.concat_arrays([words, pa.array([END.decode()], words.type)])
    end = len(words) - 1
    # two ends before every text and one behind it
    whole = np.full(len(ids) + 3 * len(texts), end)
    whole[np.arange(len(ids)) + 3 * text + 2] = ids
    sizes = np.bincount(text, minlength=len(texts)) + 1
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(text)) + 2 * (text + 1)
    outcome, h = codes(words)
    before, skip = (h % np.uint64(BEFORE)).astype(np.int64), (h // np.uint64(BEFORE) % np.uint64(SKIP)).astype(np.int64)
    token, one, two = whole[at], before[whole[at - 1]], skip[whole[at - 2]]
    inner = (one * NEAR + two % NEAR) * OUTCOMES + outcome[token]
    return Tokens(words, outcome, token, text, (one * SKIP + two) * CLASSES + outcome[token] // BINS, inner)


def pair_bucket(context: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PAIRS


def survey(docs: DataFrame) -> DataFrame:
    """word, cell and n: counts of the training rows' words (cell: the word's class and bin) and cells (word null; those of words from ``CELLS`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, inner, found, size = np.zeros(CELLS, np.int64), np.zeros(INNER, np.int32), [], 0
        shape = pa.schema([("word", pa.binary()), ("cell", pa.int32()), ("n", pa.int64())])

        def merged() -> pa.Table:
            sums = pa.concat_tables(found).group_by(["word", "cell"], use_threads=False).aggregate([("n", "sum")])
            return sums.rename_columns({"n_sum": "n"}).select(shape.names).cast(shape)

        for part in slices(batches):
            learn = pa.array([crc_text(i) % FOLDS != HELD for i in part.column(0).to_pylist()], pa.bool_())
            texts = part.column(1).filter(learn)
            if not len(texts):
                continue
            t = tokens_of(texts)
            np.add.at(cells, t.cell, 1)
            np.add.at(inner, t.inner, 1)
            n = np.bincount(t.token, minlength=len(t.words))
            at = np.flatnonzero(n)
            found.append(pa.table([t.words.take(pa.array(at)).cast(pa.binary()), pa.array(t.outcome[at], pa.int32()), pa.array(n[at])], schema=shape))
            size += len(at)
            if size > FLUSH:
                found = [merged()]
                size = found[0].num_rows
                if size > FLUSH // 2:
                    yield from found[0].to_batches()
                    found, size = [], 0
        if found:
            yield from merged().to_batches()
        for first, counts in ((0, cells), (CELLS, inner)):
            for begin in range(0, len(counts), CHUNK):
                at = np.flatnonzero(counts[begin : begin + CHUNK]) + begin
                yield pa.record_batch([pa.nulls(len(at), pa.binary()), pa.array(at + first, pa.int32()), pa.array(counts[at], pa.int64())], schema=shape)

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, cell int, n long").groupBy("word", "cell").agg(F.sum("n").alias("n"))


def sums_batch(at: np.ndarray, sums: np.ndarray, fit: float = 0.0) -> pa.RecordBatch:
    """``SUMS`` of some features, a row of ``sums`` each; the fit stands in the first row."""
    part = np.full(len(at), TaskContext.get().partitionId(), np.int32)
    rows = [x.tobytes() for x in sums.astype(np.float32)]
    return pa.record_batch([pa.array(at, pa.int32()), pa.array(part), pa.array(rows, pa.binary()), pa.array([fit, *[0.0] * len(at)][: len(at)], pa.float64())], ["at", "part", "sums", "fit"])


def _sums(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, 2, width)


def added(parts: DataFrame, features: int, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(seen, expected) sums of every feature and the sum of the fits, from ``SUMS`` of any number of partitions.

    One task adds a feature's rows, in the order of their partitions, so that the driver is sent at most ``features`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, fit = np.zeros((features, 2, width)), np.zeros(features, bool), 0.0
        for b in batches:
            at = b["at"].to_numpy()
            np.add.at(total, at, _sums(b["sums"], width))
            some[at] = True
            fit += float(b["fit"].to_numpy().sum())
        at = np.flatnonzero(some)
        yield sums_batch(at, total[at].reshape(len(at), 2 * width), fit)

    found = parts.repartition("at").sortWithinPartitions("at", "part").mapInArrow(run, SUMS).toArrow()  # a row for each feature
    total = np.zeros((features, 2, width))
    total[found["at"].to_numpy()] = _sums(found["sums"], width)
    return total[:, 0], total[:, 1], float(found["fit"].to_numpy().sum())


class Weights:
    """Weights of the maximum-entropy part."""

    def __init__(self):
        self.bias = np.zeros(CLASSES)
        self.before, self.skip, self.pair = (np.zeros((n, CLASSES)) for n in (BEFORE, SKIP, PAIRS))

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        z = self.bias + self.before[context // SKIP] + self.skip[context % SKIP] + self.pair[pair_bucket(context)]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def table(self) -> np.ndarray:
        """log10 P of every cell, some contexts at once."""
        out = np.empty((CONTEXTS, CLASSES), np.float32)
        for at in range(0, len(out), 4096):
            out[at : at + 4096] = self.log_probabilities(np.arange(at, min(at + 4096, len(out)))) / np.log(10)
        return out.ravel()

    @staticmethod
    def gather(context: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``values`` for every feature: before, skip and pair below each other."""
        out = np.zeros((FEATURES, CLASSES))
        for at in (context // SKIP, BEFORE + context % SKIP, BEFORE + SKIP + pair_bucket(context)):
            np.add.at(out, at, values)
        return out

    def move(self, seen: np.ndarray, expected: np.ndarray) -> None:
        w = np.concatenate([self.before, self.skip, self.pair])
        step = RATE * (seen - expected - PENALTY * w) / (0.5 * (seen + expected) + 1 + PENALTY)
        self.before += step[:BEFORE]
        self.skip += step[BEFORE : BEFORE + SKIP]
        self.pair += step[BEFORE + SKIP :]


def expectations(cells: DataFrame, weights: Weights, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, float]:
    """(seen, expected) feature counts and the log likelihood, summed over the partitions of the cell table."""
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b["cell"].to_numpy(), b["n"].to_numpy()) for b in batches]
        if not rows:
            return
        cell, n = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (0, 1))
        context, at = np.unique(cell // CLASSES, return_inverse=True)
        counts = np.zeros((len(context), CLASSES))
        np.add.at(counts, (at, cell % CLASSES), n)
        logs = shared.value.log_probabilities(context)
        expected = np.exp(logs) * counts.sum(1, keepdims=True)
        sums = np.hstack([Weights.gather(context, counts), Weights.gather(context, expected)])
        at = np.flatnonzero(sums.any(1))
        yield sums_batch(at, sums[at], float((counts * logs).sum()))

    found = added(cells.mapInArrow(run, SUMS), FEATURES, CLASSES)
    shared.destroy()
    return found


def train(spark: SparkSession, cells: DataFrame) -> tuple[Weights, list[float]]:
    """Weights, and the log likelihood before each update."""
    weights, fits = Weights(), []
    by_class = {r["k"]: r["n"] for r in cells.groupBy((F.col("cell") % CLASSES).alias("k")).agg(F.sum("n").alias("n")).collect()}
    all_n = sum(by_class.values())
    weights.bias = np.log([(by_class.get(k, 0) + 0.5) / (all_n + 0.5 * CLASSES) for k in range(CLASSES)])
    for _ in range(STEPS if all_n else 0):
        seen, expected, fit = expectations(cells, weights, spark)
        weights.move(seen, expected)
        fits.append(fit)
    return weights, fits


class WordWeights:
    """Weights of the word factor: of a class and bin with the word before and the word before that.

    ``masses`` are the reference: add-half counts of every bin's words, with one place for those not seen.
    """

    def __init__(self, masses: np.ndarray):
        self.reference = np.log(masses)
        self.before, self.near = np.zeros((BEFORE, OUTCOMES)), np.zeros((NEAR, OUTCOMES))

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """log P(bin | class, context) for every class and bin, a row for each context."""
        z = (self.reference + self.before[context // NEAR] + self.near[context % NEAR]).reshape(len(context), CLASSES, BINS)
        z -= z.max(2, keepdims=True)
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return z.reshape(len(context), OUTCOMES)

    def table(self) -> np.ndarray:
        """log10 P of every cell, some contexts at once."""
        out = np.empty((BEFORE * NEAR, OUTCOMES), np.float32)
        for at in range(0, len(out), 256):
            out[at : at + 256] = self.log_probabilities(np.arange(at, min(at + 256, len(out)))) / np.log(10)
        return out.ravel()


def word_expectations(inner: DataFrame, weights: WordWeights, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, float]:
    """(seen, expected) feature counts, words before and words before that below each other, and the log likelihood.

    All contexts of a word before are in one partition of ``inner``, so that its counts are dealt once.
    """
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b["cell"].to_numpy(), b["n"].to_numpy()) for b in batches]
        if not rows:
            return
        cell, n = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (0, 1))
        near, fit = np.zeros((2, NEAR, OUTCOMES)), 0.0
        owner = cell // (NEAR * OUTCOMES)
        order = np.argsort(owner, kind="stable")
        befores, starts = np.unique(owner[order], return_index=True)
        for before, some in zip(befores.tolist(), np.split(order, starts[1:]), strict=True):
            counts = np.bincount(cell[some] - before * NEAR * OUTCOMES, n[some], NEAR * OUTCOMES).reshape(NEAR, OUTCOMES)
            logs = shared.value.log_probabilities(before * NEAR + np.arange(NEAR))
            of_class = counts.reshape(NEAR, CLASSES, BINS).sum(2)
            expected = np.exp(logs) * np.repeat(of_class, BINS, 1)
            near += [counts, expected]
            fit += float((counts * logs).sum())
            yield sums_batch(np.array([before]), np.hstack([counts.sum(0), expected.sum(0)])[None])
        yield sums_batch(BEFORE + np.arange(NEAR), np.hstack(near), fit)

    found = added(inner.mapInArrow(run, SUMS), WORD_FEATURES, OUTCOMES)
    shared.destroy()
    return found


def train_words(spark: SparkSession, inner: DataFrame, masses: np.ndarray) -> tuple[WordWeights, list[float]]:
    """Weights of the word factor, and the log likelihood of the bins before each update."""
    weights, fits = WordWeights(masses), []
    for _ in range(STEPS):
        seen, expected, fit = word_expectations(inner, weights, spark)
        w = np.concatenate([weights.before, weights.near])
        step = RATE * (seen - expected - PENALTY * w) / (0.5 * (seen + expected) + 1 + PENALTY)
        weights.before += step[:BEFORE]
        weights.near += step[BEFORE:]
        fits.append(fit)
    return weights, fits


@dataclass
class Model:
    """What scoring needs: the weights of both factors, the bins' masses, and the most frequent words with their counts."""

    weights: Weights
    inner: WordWeights
    masses: np.ndarray
    head: pa.Array
    head_n: np.ndarray

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of every cell of both factors; made once in a worker, since they are some four times their weights."""
        return self.weights.table(), self.inner.table()


def frequent(words: DataFrame) -> pa.Table:
    """The words of the highest counts, at most HEAD rows: a threshold from the histogram of counts, then one filter."""
    step = F.floor(F.log2("c") * 8).cast("int")
    room, least = HEAD, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 8 rows for each power of 2
        if r["n"] > room:
            break
        room, least = room - r["n"], r["step"]
    return words.where(F.lit(False) if least is None else step >= least).select("word", "c").toArrow()


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    scratch = Scratch(spark, "lm")
    counts = scratch.write("counts", survey(docs))
    known_cells = counts.where("word is null").select("cell", "n")
    cells = scratch.write("cells", known_cells.where(F.col("cell") < CELLS).repartition(PARTS, F.floor(F.col("cell") / (CLASSES * SKIP))))
    at = F.col("cell") - CELLS
    inner = scratch.write("inner", known_cells.where(at >= 0).select(at.alias("cell"), "n").repartition(PARTS, F.floor(at / (NEAR * OUTCOMES))))
    words = counts.where("word is not null").select("word", F.col("cell").alias("k"), F.col("n").alias("c"))
    totals = words.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # OUTCOMES rows
    masses = np.full(OUTCOMES, 0.5)
    for r in totals:
        masses[r["k"]] = r["n"] + 0.5 * (r["v"] + 1)
    all_n, all_v = sum(r["n"] for r in totals), sum(r["v"] for r in totals)
    head = frequent(words.where(F.octet_length("word") <= HEAD_BYTES))
    weights, _ = train(spark, cells)
    inner_weights, _ = train_words(spark, inner, masses) if all_n else (WordWeights(masses), [])
    model = spark.sparkContext.broadcast(Model(weights, inner_weights, np.log10(masses), head["word"].combine_chunks(), head["c"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (logs, inner), masses, head, head_n = model.value.tables, model.value.masses, model.value.head, model.value.head_n
        key = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            rows = part.num_rows
            t = tokens_of(part.column(1))
            each = lambda values: np.bincount(t.text, values, rows)
            context = each(logs[t.cell].astype(np.float64) + inner[t.inner] - masses[t.outcome[t.token]])
            words = t.words.cast(pa.binary())
            at = pc.fill_null(pc.index_in(words, head), -1).to_numpy()
            c = head_n[at[at >= 0]]
            worth = np.zeros(len(at))
            worth[at >= 0] = np.log10(c + 0.5)
            is_rare = (at < 0)[t.token]
            pairs, times = np.unique(t.text[is_rare] * len(at) + t.token[is_rare], return_counts=True)
            ends = pa.array(np.searchsorted(pairs // len(at), np.arange(rows + 1)), pa.int32())
            known = each(~is_rare).astype(np.int64)
            held = [crc_text(i) % FOLDS == HELD for i in part.column(0).to_pylist()]
            out = [pa.array(np.arange(key, key + rows)), pa.array(held, pa.bool_()), pa.array(np.bincount(t.text, minlength=rows)), pa.array(known), pa.array(each(worth[t.token])), pa.array(context)]
            out += [pa.ListArray.from_arrays(ends, words.take(pa.array(pairs % len(at)))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
            key += rows
            yield pa.record_batch([part.column(0), *out], ["doc_id", "key", "held_out", "n_tokens", "known", "sum", "context", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.write("rows", docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, held_out boolean, n_tokens long, known long, sum double, context double, rare array<binary>, times array<long>"))
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(words.select("word", "c"), "word", "left").groupBy("key").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
    total = F.col("sum") + F.coalesce("more", F.lit(0.0))
    every = float(np.log10(all_n + 0.5 * (all_v + 1)))
    out = rows.drop("rare", "times").join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(all_n)).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(every)).alias("base_score"), (total + F.col("context")).alias("score"),
    )
    return out
