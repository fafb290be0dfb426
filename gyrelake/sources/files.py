"""File sources: ordered image folders, bundles, archives, documents and ONNX models.

Everything starts from Spark's ``binaryFile`` reader, so that any file system that Spark reads will
do; headers and archives are parsed by executors in Arrow functions over the file's bytes.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrelake.functions.text import IMAGE_SUFFIXES, leading_number

FRAMES = 16
MOST_FILES, MOST_BYTES, MOST_RATIO = 10_000, 20 << 30, 200


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, relative, name, length of the files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    relative = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    return files.select("path", relative.alias("relative"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def is_image(name: Column) -> Column:
    out = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        out = out | F.lower(name).endswith(suffix)
    return out


def ordered_images(spark: SparkSession, folder: str, frames: int = FRAMES) -> DataFrame:
    """path, name, position of a folder's images by the number that begins their name; ValueError unless 1..frames once each."""
    found = listing(spark, folder).where(is_image(F.col("name"))).withColumn("position", leading_number(F.col("name")))
    seen = found.agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_if(F.col("position").isNull()).alias("odd")).first()
    if (seen["n"], seen["d"], seen["lo"], seen["hi"], seen["odd"]) != (frames, frames, 1, frames, 0):
        raise ValueError(f"the folder does not hold images 1..{frames} once each: {seen.asDict()}")
    return found.select("path", "name", "position").orderBy("position")


def inventory_problems(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """relative paths (lower case) that are only in the folder or only among ``expected`` (relative)."""
    found = listing(spark, folder, True).where(is_image(F.col("name"))).select(F.lower("relative").alias("relative"), F.lit(1).alias("found"))
    want = expected.select(F.lower("relative").alias("relative"), F.lit(1).alias("expected"))
    return found.join(want, "relative", "full_outer").where("found is null or expected is null")


def colliding(files: DataFrame) -> DataFrame:
    """Paths that differ by case alone."""
    return files.groupBy(F.lower("relative").alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


def over_limits(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row of totals when a tree has too many files or bytes, none otherwise."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).where((F.col("files") > most_files) | (F.col("bytes") > most_bytes))


def running_limit(files: DataFrame, group: str) -> DataFrame:
    """Files of each source with their running count and bytes, in path order."""
    w = Window.partitionBy(group).orderBy("relative").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumns({"count_so_far": F.count("*").over(w), "bytes_so_far": F.sum("length").over(w)})


def image_header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the header of a PNG, JPEG or TIFF; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("PNG", *struct.unpack(">II", data[16:24]))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", width, height
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        end = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(end + "I", data[4:8])[0]
        size: dict[int, int] = {}
        if at + 2 <= len(data):
            for k in range(struct.unpack(end + "H", data[at : at + 2])[0]):
                entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
                if len(entry) == 12:
                    tag, kind = struct.unpack(end + "HH", entry[:4])
                    size[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
        return ("TIFF", size[256], size[257]) if 256 in size and 257 in size else None
    return None


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, format, width, height of a folder's images; format is null where the header is not understood."""
    files = spark.read.format("binaryFile").load(folder).where(is_image(F.element_at(F.split("path", "/"), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [image_header(x) or (None, None, None) for x in batch["content"].to_pylist()]
            yield pa.record_batch([batch["path"], batch["sha256"], *(pa.array([s[k] for s in seen], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32())))], ["path", "sha256", "format", "width", "height"])

    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, "path string, sha256 string, format string, width int, height int")


def one_size(found: DataFrame, group: str) -> DataFrame:
    """Groups of images without exactly sixteen files of one known size."""
    seen = found.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct("width", "height").alias("sizes"), F.count("format").alias("known"))
    return seen.where((F.col("n") != FRAMES) | (F.col("sizes") != 1) | (F.col("known") != F.col("n")))


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, packed, encrypted, link, problem of every entry of ZIP archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                for info in zipfile.ZipFile(io.BytesIO(content)).infolist():
                    if not info.is_dir():
                        rows.append((where, info.filename, info.file_size, info.compress_size, bool(info.flag_bits & 1), (info.external_attr >> 16 & 0o170000) == 0o120000))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "name", "size", "packed", "encrypted", "link"])

    entries = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, size long, packed long, encrypted boolean, link boolean")
    twice = F.count("*").over(Window.partitionBy("path", F.lower("name"))) > 1
    problem = F.when(F.col("encrypted"), "encrypted").when(F.col("link"), "link").when(twice, "collision").when(F.col("size") > MOST_RATIO * F.greatest(F.col("packed"), F.lit(1)), "ratio")
    return entries.withColumn("problem", problem)


def documents(spark: SparkSession, path: str, schema: str, most: int = 10 << 20, required: tuple[str, ...] = ()) -> DataFrame:
    """path, value and problem of JSON documents: too long, no object, with fields that the schema lacks, or a required one missing or of another type."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.decode("content", "UTF-8").alias("body"))
    parsed = files.withColumn("value", F.from_json("body", schema, {"mode": "PERMISSIVE"})).withColumn("fields", F.json_object_keys("body"))
    known = F.array(*[F.lit(f) for f in spark.createDataFrame([], schema).columns])
    problem = F.when(F.col("length") > most, "length").when(F.col("fields").isNull(), "json").when(F.size(F.array_except("fields", known)) > 0, "extra")
    gone = F.lit(False)
    for f in required:
        gone = gone | F.col("value")[f].isNull()
    return parsed.select("path", "value", problem.when(gone, "missing").alias("problem"))


def onnx_tensors(spark: SparkSession, path: str) -> DataFrame:
    """path, side, name, type and shape (as text; named sizes keep their names) of the inputs and outputs of ONNX models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        for batch in batches:
            rows = []
            for where, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                session = onnxruntime.InferenceSession(content, providers=["CPUExecutionProvider"])
                for side, tensors in (("input", session.get_inputs()), ("output", session.get_outputs())):
                    rows += [(where, side, t.name, t.type, ",".join(str(s) for s in t.shape)) for t in tensors]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], ["path", "side", "name", "type", "shape"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, side string, name string, type string, shape string")


def score_onnx(rows: DataFrame, model: bytes, column: str, output: str = "scores") -> DataFrame:
    """Rows with the first output of an ONNX model over a float array column; one session for each task, in batches."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for batch in batches:
            x = np.array(batch[column].to_pylist(), np.float32)
            y = session.run(None, {name: x})[0].reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield batch.append_column(output, pa.array(y.astype(np.float32).tolist(), pa.list_(pa.float32())))

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(output, ArrayType(FloatType()))]))
