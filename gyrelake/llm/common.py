"""What the operators of this package share: scratch tables, batches, hashing, word splitting."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that an operator handles at once inside an Arrow batch.
GROUP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none (tests, a laptop) gets a folder of its own; on a cluster
    executors could not see it, so that there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gyrelake-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Written tables of one operator run, in the shared folder; they cut lineage and survive executors.

    ``write`` stores a frame and reads it back; ``drop`` removes what is no longer needed; whatever
    is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/gyrelake-{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        self.written: list[str] = []
        atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def write(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        self.written.append(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def write_bucketed(self, table: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Stores a frame in buckets by ``key``, so that joins on it move only the other side."""
        name = f"gyrelake_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").option("path", self.path(table)).saveAsTable(name)
        self.tables[table] = name
        self.written.append(table)
        return self.spark.table(name)

    def drop(self, *tables: str) -> None:
        for table in tables or list(self.tables):
            if name := self.tables.pop(table, None):
                try:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                except Exception:  # as below
                    return
        for path in [self.path(t) for t in tables] or [self.base]:
            try:
                jvm = self.spark.sparkContext._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session may be gone at exit; cleaning up is best effort
                return

    def collect_garbage(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of frames that nothing refers to any more.

        Frames that Python has just let go are released in the JVM a little later, so that one call alone leaves the last ones.
        """
        gc.collect()
        for _ in range(2):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)

    def drop_all_but(self, kept: str) -> None:
        """Removes every written table but one."""
        self.drop(*(t for t in self.written if t != kept))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A key with more than one in HOT of a table's rows is hot; there are at most HOT such keys.
HOT = 1000


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, which is unique in ``right``; a hot key's rows are dealt over several tasks.

    ``counts`` is a written table of key and ``count`` of ``left``; without it ``left`` should be a
    written table and is counted. At most ``HOT`` keys are hot at any size, so that their list is
    broadcast, and ``right`` grows by at most 2 * ``HOT`` rows. ``by`` is the column of ``left``
    that deals the rows; ``hint`` is a join hint for ``right``.
    """
    total = left.count() if counts is None else counts.agg(F.sum("count")).first()[0] or 0
    limit = max(64, total // HOT)
    if total <= limit:
        return left.join(right, key, how)
    counts = left.groupBy(key).count() if counts is None else counts
    hot = F.broadcast(counts.where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("salts__")))
    salts = F.coalesce("salts__", F.lit(1))
    left = left.join(hot, key, "left").withColumn("salt__", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts__")
    right = right.join(hot, key, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts__")
    return left.join(right.hint(hint) if hint else right, [key, "salt__"], how).drop("salt__")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    mark = uuid.uuid4().hex
    return [f"{n}_{mark}" for n in names]


def quoted(columns: list[str]) -> list:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.fromiter((x or 0 for x in pc.binary_length(column).to_pylist()), np.int64, batch.num_rows)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same with their texts, null texts as ''."""
    for part in slices(batches, text, limit):
        yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def scan_blocks(spark: SparkSession, docs: DataFrame, blocks: Iterable, matches: Callable[[object, list[str]], list[list]], kind: str, arrow: pa.DataType) -> DataFrame:
    """doc_id and ``matches`` of every row of ``docs``, whose texts are searched for each of some blocks.

    ``matches(block, texts)`` gives a list of ``kind`` (Arrow's ``arrow``) for each text. Every block is a job of its
    own whose hits are written, so that a worker never holds two blocks, however many there are; a single block
    needs neither a written table nor a join.
    """
    blocks = iter(blocks)
    begun = list(islice(blocks, 2))
    if len(begun) < 2:
        block = spark.sparkContext.broadcast(begun[0]) if begun else None

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in groups(batches):
                yield pa.record_batch([part.column(0), pa.array(matches(block.value, texts) if block else [[]] * len(texts), arrow)], ["doc_id", "matches"])

        return docs.select("doc_id", "text").mapInArrow(one, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, matches {kind}")
    scratch = Scratch(spark, "blocks")
    keyed = scratch.write("docs", docs.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id()))
    hits = block_hits(scratch, keyed.select("key", "text"), chain(begun, blocks), matches, kind, arrow)
    told = hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))  # a row for each block at most
    return keyed.select("key", "doc_id").join(told, "key", "left").select("doc_id", F.coalesce("matches", F.array().cast(kind)).alias("matches"))


def block_hits(scratch: Scratch, keyed: DataFrame, blocks: Iterable, matches: Callable[[object, list[str]], list[list]], kind: str, arrow: pa.DataType) -> DataFrame:
    """key and ``matches`` of the rows (key, text) with any, for each block that has some; a written table and one Python stage a block."""
    shape, n = f"key long, matches {kind}", 0
    for n, value in enumerate(blocks, 1):
        block = scratch.spark.sparkContext.broadcast(value)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part, texts in groups(batches):
                found = matches(block.value, texts)
                at = [i for i, f in enumerate(found) if f]
                yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], arrow)], ["key", "matches"])

        scratch.write(f"hits{n}", keyed.mapInArrow(run, shape))
        block.destroy()
    return scratch.spark.read.schema(shape).parquet(*(scratch.path(f"hits{i}") for i in range(1, n + 1)))


def crc_text(value) -> int:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode())


class TwoGenerations(dict):
    """A cache bounded in bytes: when what is new takes ``limit`` bytes, the older generation is forgotten.

    What is in use is carried over, so frequent keys stay; a text key over ``LONGEST`` characters is kept for the present
    batch alone. Speed only: values never depend on it.
    """

    LONGEST, ENTRY = 512, 200

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size, self.old, self.passing = limit, 0, {}, {}

    def __missing__(self, key: str):
        return self.passing[key]

    def empty(self) -> None:
        """Forgets everything."""
        self.clear()
        self.old, self.passing, self.size = {}, {}, 0

    def put(self, keys: list[str], values: list) -> None:
        """Remembers values of keys."""
        if max(map(len, keys), default=0) > self.LONGEST:
            self.passing.update((k, v) for k, v in zip(keys, values, strict=True) if len(k) > self.LONGEST)
            keys, values = zip(*((k, v) for k, v in zip(keys, values, strict=True) if len(k) <= self.LONGEST), strict=True) if min(map(len, keys)) <= self.LONGEST else ((), ())
        self.update(zip(keys, values, strict=True))
        self._count(keys, values)

    def _count(self, keys, values) -> None:
        # a character takes 4 bytes at most, and most keys are short beside their entry
        self.size += self.ENTRY * len(keys) + 4 * sum(map(len, keys)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)

    def absent(self, keys: set) -> list:
        """Those keys that must be computed; the others are made present."""
        if self.passing:
            self.passing = {}
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        missing, old = keys.difference(self), self.old
        if old and (kept := missing.intersection(old)):
            again = {k: old[k] for k in kept}
            self.update(again)
            self._count(again.keys(), list(again.values()))
            missing -= kept
        return list(missing)


def windows(text: str, size: int, blank: str = " ") -> Iterator[str]:
    """Stretches of some ``size`` characters, each but the first beginning with ``blank`` after another character."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text):
            to = text.find(blank, to)
            if to < 0 or not text[to - 1].isspace():
                break
            to += 1
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


_holder: list = ["", ()]


def claim(owner: str, *caches: dict) -> None:
    """Says that an operator uses these caches in this worker now; those of another operator are emptied.

    A worker serves one operator after another, and what the last one remembered would only add up.
    """
    if _holder[0] != owner:
        for cache in _holder[1]:
            cache.empty() if isinstance(cache, TwoGenerations) else cache.clear()
    _holder[:] = [owner, caches]


#: Words of the contracts: lower case A-Z only, split at bytes 0x20 and 0x09-0x0D.
def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


_MASK = (1 << 64) - 1


def hash_word(word: bytes, seed: int = 0) -> int:
    """A stable 64-bit hash of bytes (xxh64)."""
    return xxhash.xxh64_intdigest(word, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = hash_word(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of an array of texts in a row, nulls as '', and where each begins, and the end."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return bytes(memoryview(data)[at[0] : at[-1]]) if data else b"", at - at[0]


def word_hashes(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (``words_of``) of texts in a row, eight bytes at a time, and which is the first of each text, and the end."""
    n = len(raw)
    data = np.frombuffer(raw.lower() + bytes(8), np.uint8)
    word, cut = ~_BLANK[data[:n]], at[(at > 0) & (at < n)]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[cut], ends[cut - 1] = word[cut], word[cut - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = ends - begins
    eight = np.ndarray(n + 1, "<u8", data, strides=(1,))
    out = mix(size.astype(np.uint64) * _GOLDEN + (eight[begins] & _FIRST_BYTES[np.minimum(size, 8)]))
    left, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        out[left] = mix(out[left] * _GOLDEN + (eight[begins[left] + k] & _FIRST_BYTES[np.minimum(size[left] - k, 8)]))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = hash_word(data[begins[i] : ends[i]].tobytes())
    return out, np.searchsorted(begins, at)


def shingles(raw: bytes, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each of some texts in a row; the whole sequence where it is shorter."""
    hashes, at = word_hashes(raw, at)
    count = np.diff(at)
    out = np.full(len(hashes), n, np.uint64)
    for i in range(min(n, len(hashes))):
        out[: len(hashes) - i] = mix(out[: len(hashes) - i] * _GOLDEN + hashes[i:])
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        one = np.full(1, count[i], np.uint64)
        for k in range(at[i], at[i + 1]):
            one = mix(one * _GOLDEN + hashes[k])
        out[at[i]] = one[0]
    held, found = np.where(count < n, np.minimum(count, 1), count - n + 1), []
    for begin, k in zip(at.tolist(), held.tolist(), strict=False):
        own = out[begin : begin + k]
        own.sort()
        found.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if k > 1 else own)
    return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
