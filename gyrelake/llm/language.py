"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts become hashed counts of character 1- to 3-grams; document frequencies come from
all training rows. A bounded sample of the labelled rows (about ``SAMPLE`` of each language, by a
hash of id and text length) trains the weights by follow-the-regularised-leader with elastic-net
penalties; a further, disjoint sample of about ``CALIBRATION`` each fits one temperature. Every
whole text is then predicted from its characters alone.

Learning rows: text and lang not null and crc32 of doc_id as text (null: empty) mod ``FOLDS`` not 0.
Nulls: a null text, and one without a letter, gets ``und`` with score 0; without any learning row
everything does. Ties go to the language that sorts first. Repeated rows get equal answers, other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import groups, has_letter

BUCKETS, FOLDS = 1 << 15, 5
SAMPLE, CALIBRATION = 1500, 400
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 2e-4, 1e-4, 2


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed character 1-, 2- and 3-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.zeros(BUCKETS, np.int64)
    code = np.zeros(len(points), np.uint32)
    for n in range(1, 4):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        found += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(found)
    return at, found[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF values."""
    x = (1 + np.log(counts)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights [bucket, class] after ``EPOCHS`` passes of FTRL-proximal with elastic-net penalties."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, label in rows:
            zi, ni = z[at], n[at]
            w = leader(zi, ni)
            error = softmax(8.0 * (x @ w))
            error[label] -= 1
            g = 8.0 * x[:, None] * error
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return 8.0 * leader(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, from a fixed grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return "und", 0.0
        at, counts = gram_counts(text)
        p = softmax(weighted(at, counts, self.idf) @ self.weights[at] / self.heat)
        return self.languages[int(p.argmax())], float(p.max())


def train(docs: DataFrame, folds: int = FOLDS) -> Model:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc % folds != 0))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 1)), 1.0)
    share = {k: (SAMPLE + CALIBRATION) / n for k, n in counts.items()}
    split = SAMPLE / (SAMPLE + CALIBRATION)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document frequencies of the task's rows, and the sampled rows themselves."""
        found, n = np.zeros(BUCKETS, np.int64), 0
        for part, texts in groups(batches):
            out = []
            for text, lang, pick in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                at, tf = gram_counts(text)
                found[at] += 1
                n += 1
                if pick < share[lang] and len(at):
                    out.append((lang, pick / share[lang], at.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()))
            yield pa.record_batch({"bucket": pa.nulls(len(out), pa.int32()), "n": pa.nulls(len(out), pa.int64()), **{k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("lang", pa.string()), ("pick", pa.float64()), ("at", pa.binary()), ("tf", pa.binary())))}})
        at = np.append(np.flatnonzero(found), BUCKETS)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(np.append(found, n)[at], pa.int64()), "lang": pa.nulls(len(at), pa.string()), "pick": pa.nulls(len(at), pa.float64()), "at": pa.nulls(len(at), pa.binary()), "tf": pa.nulls(len(at), pa.binary())})

    pick = ((F.xxhash64("doc_id", F.length("text")) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6).alias("pick")
    seen = learn.select("text", "lang", pick).mapInArrow(frequencies, "bucket int, n long, lang string, pick double, at binary, tf binary")
    # one row for each bucket, and the bounded sample
    rows = seen.groupBy("bucket", "lang", "pick", "at", "tf").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in rows:
        if r["bucket"] is not None:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sample = sorted((r["pick"], r["lang"], bytes(r["at"]), bytes(r["tf"])) for r in rows if r["bucket"] is None)
    data, late = [], []
    for p, lang, at, tf in sample:
        where = np.frombuffer(at, np.int32)
        (data if p < split else late).append((where, weighted(where, np.frombuffer(tf, np.int32), idf), languages.index(lang)))
    weights = follow_the_leader(data, len(languages))
    logits = np.array([x @ weights[at] for at, x, _ in late]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for _, _, y in late], int)))


def identify(spark: SparkSession, docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang)."""
    model = spark.sparkContext.broadcast(train(docs, folds))  # BUCKETS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            found = [model.value.predict(t) for t in texts]
            yield pa.record_batch({"doc_id": part.column(0), "held_out": part.column(2), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (crc % folds == 0).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
