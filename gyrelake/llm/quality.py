"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote on every document: good (1), bad (0) or abstain (2).
2. Their vote patterns (at most 3 ** labellers, whatever the input is) are counted over all
   documents; expectation-maximisation on the counts estimates each labeller's accuracies and the
   share of good documents, starting from labellers that are better than chance.
3. The posterior of a pattern labels documents softly. A bounded sample of them (``SAMPLE`` rows
   of each side, taken by a hash of id and text length) trains a hashed linear scorer over
   character-shape n-grams and repetition buckets.
4. Every whole text is scored; a document is kept when its score is ``KEEP`` at least.

Nulls: a null or empty text gets votes of abstention alone and is scored like any text without
features; null ids stay; repeated rows get equal scores. If there are no votes at all, all is kept
(score 1). Other columns are ignored, or carried along by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import claim, groups

SAMPLE, KEEP = 3000, 0.5
BUCKETS = 1024
ROUNDS, STEP, RIDGE = 200, 2.0, 1e-4
ANCHOR, TEMPER = 0.02, 0.8

#: Character classes of the shapes.
LOWER, UPPER, DIGIT, SPACE, BREAK, STOP, BAR, BANG, SYMBOL, OTHER = range(10)
_table: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _table:
        table = np.full(0x10000, OTHER, np.uint8)
        for c in range(0x10000):
            x = chr(c)
            if x.isalpha():
                table[c] = UPPER if x.isupper() else LOWER
            elif x.isdigit():
                table[c] = DIGIT
            elif x.isspace():
                table[c] = BREAK if x == "\n" else SPACE
        for x, kind in ((".,;:?'\"()-", STOP), ("|", BAR), ("!", BANG), ("#$%&*@^~<>{}[]=+\\/_", SYMBOL)):
            for c in x:
                table[ord(c)] = kind
        _table.append(table)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _table[0][np.minimum(points, 0xFFFF)]


class Look:
    """What the labellers and the scorer see of a text."""

    def __init__(self, text: str):
        self.shape = _classes(text)
        self.n = max(1, len(self.shape))
        self.count = np.bincount(self.shape, minlength=10)
        words = text.split()
        self.words = len(words)
        self.distinct = len(set(words)) / max(1, len(words))
        self.twins = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
        self.letters = int(self.count[LOWER] + self.count[UPPER])

    def share(self, *kinds: int) -> float:
        return float(sum(self.count[k] for k in kinds)) / self.n


def _bad(on: bool) -> int:
    return 0 if on else 2


def _prose(x: Look) -> int:
    """Good where most tokens are lower-case words with some stops between; bad where hardly any are."""
    if not x.words:
        return 2
    plain = x.share(LOWER, DIGIT, SPACE, BREAK, STOP) + min(1, x.count[UPPER]) / x.n
    if plain > 0.9 and x.twins < 0.06 and x.share(SYMBOL, BAR, BANG) < 0.02:
        return 1
    return _bad(plain < 0.7 or x.twins > 0.3)


#: Each labeller abstains (2) where it has nothing to say; their grounds overlap.
LABELLERS = {
    "symbols": lambda x: _bad(x.words >= 3 and x.share(SYMBOL) > 0.06),
    "bars": lambda x: _bad(x.words >= 5 and x.share(BAR) > 0.03),
    "shouting": lambda x: _bad(x.letters >= 20 and x.count[UPPER] > 0.4 * x.letters),
    "bangs": lambda x: _bad(x.words >= 5 and x.share(BANG) > 0.03),
    "twins": lambda x: _bad(x.words >= 10 and x.twins > 0.15),
    "few_words": lambda x: 2 if x.words < 20 else 0 if x.distinct < 0.12 and x.words < 2000 else 1 if x.distinct > 0.3 else 2,
    "marks": lambda x: 2 if not x.words else 0 if (m := x.share(SYMBOL, BAR, BANG)) > 0.04 else 1 if m < 0.01 else 2,
    "prose": _prose,
}


def votes(look: Look) -> int:
    """The labellers' votes as one number in base 3."""
    code = 0
    for f in LABELLERS.values():
        code = 3 * code + int(f(look))
    return code


def features(look: Look) -> np.ndarray:
    """Hashed counts, as square roots of shares: shape n-grams of 1 to 4, repetition buckets."""
    s = look.shape.astype(np.int64)
    out = np.zeros(BUCKETS)
    code = np.zeros(len(s), np.int64)
    for n in range(1, 5):
        if len(s) < n:
            break
        code = (code[: len(s) - n + 1] * 10 + s[n - 1 :]) if n > 1 else s
        out += np.bincount((code * 2654435761 + n * 40503 >> 7) % BUCKETS, minlength=BUCKETS) / (4 * look.n)
    out = np.sqrt(out)
    for name, value in (("distinct", look.distinct), ("twins", look.twins), ("words", min(1.0, np.log1p(look.words) / 12))):
        out[(hash_name(name) + int(10 * value)) % BUCKETS] += 1
    return out


def hash_name(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, p(vote | class) by labeller): naive-Bayes mixture of two classes."""
    votes_of = np.stack([patterns // 3 ** (labellers - 1 - k) % 3 for k in range(labellers)], 1)
    # p(vote | class) before any data: bad, good, abstain; worth ``ANCHOR`` of the documents, which
    # keeps the classes' meaning
    prior = np.tile(np.array([[0.4, 0.1, 0.5], [0.02, 0.48, 0.5]]), (labellers, 1, 1))
    table, weight = prior.copy(), ANCHOR * counts.sum()
    good = 0.8
    posterior = np.full(len(patterns), good)
    for _ in range(rounds):
        logs = np.log(table)[np.arange(labellers), :, votes_of]  # pattern, labeller, class
        # labellers that overlap repeat each other's evidence, so that their sum is tempered
        odds = np.log(good / (1 - good)) + TEMPER * (logs[:, :, 1] - logs[:, :, 0]).sum(1)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        good = float(np.clip((posterior * counts).sum() / counts.sum(), 0.02, 0.98))
        for c, p in ((0, 1 - posterior), (1, posterior)):
            w = p * counts
            for v in range(3):
                table[:, c, v] = (w[:, None] * (votes_of == v)).sum(0) + weight * prior[:, c, v]
        table /= table.sum(2, keepdims=True)
    return posterior, table


def fit_scorer(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full gradient steps with momentum; sides weigh the same."""
    x, target = x.astype(np.float32), target.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    side = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum())).astype(np.float32)
    dw, db, scale = np.zeros_like(w), 0.0, STEP
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -30, 30)))
        g = (p - target) * side
        dw = 0.9 * dw + x.T @ g + RIDGE * w
        db = 0.9 * db + g.sum()
        w, b = w - scale * dw, b - scale * db
    return w, float(b)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """The votes on each document, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for _, texts in groups(batches):
            yield pa.record_batch({"votes": pa.array([votes(Look(t)) for t in texts], pa.int32())})

    return docs.select("text").mapInArrow(run, "votes int")


def train(docs: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights of the scorer, or None where no labeller says anything."""
    pick = F.abs(F.xxhash64("doc_id", F.length("text")) % 1_000_000).alias("pick")
    rows = vote_patterns(docs).groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not rows:
        return None
    rows.sort()
    patterns, counts = np.array([r["votes"] for r in rows]), np.array([r["n"] for r in rows], float)
    posterior, _ = expectation_maximisation(patterns, counts, len(LABELLERS))
    label = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    size = {side: counts[(posterior >= 0.5) == side].sum() for side in (False, True)}
    most = {side: 1_000_000 * min(1.0, SAMPLE / max(1.0, n)) for side, n in size.items()}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            out = []
            for text, pick in zip(texts, part.column(1).to_pylist(), strict=True):
                if pick < max(most.values()):
                    look = Look(text)
                    p = label[votes(look)]
                    if pick < most[p >= 0.5]:
                        out.append((p, features(look).astype(np.float32).tobytes()))
            yield pa.record_batch({"target": pa.array([x[0] for x in out], pa.float64()), "x": pa.array([x[1] for x in out], pa.binary())})

    taken = docs.select("text", pick).mapInArrow(sample, "target double, x binary").collect()  # about 2 * SAMPLE rows
    if not taken:
        return None
    taken.sort(key=lambda r: (r["target"], bytes(r["x"])))
    return fit_scorer(np.stack([np.frombuffer(r["x"], np.float32) for r in taken]), np.array([r["target"] for r in taken]))


def _scores(texts: list[str], model: tuple[np.ndarray, float] | None) -> list[float]:
    if model is None:
        return [1.0] * len(texts)
    w, b = model
    return [float(1 / (1 + np.exp(-np.clip(features(Look(t)) @ w + b, -30, 30)))) for t in texts]


def quality_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, score and keep (1 or 0) of every row."""
    model = spark.sparkContext.broadcast(train(docs))  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            scores = _scores(texts, model.value)
            yield pa.record_batch({"doc_id": part.column(0), "score": pa.array(scores, pa.float64()), "keep": pa.array([int(s >= KEEP) for s in scores], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep long")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns."""
    model = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            yield part.filter(pa.array([s >= KEEP for s in _scores(texts, model.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
