"""Small groups in a stream of sorted rows, without the cost of a grouped map's call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that are Python objects at once, and bytes of binary values that wait for a batch of results.
ROWS, FLUSH_BYTES = 512, 4 << 20


def row_stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True)


def packed(rows: Iterable[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 10,000 and about ``FLUSH_BYTES`` of binary values; an empty one at the end where nothing is left."""
    pack = lambda found: pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(kind)], schema=kind)
    found, size = [], 0
    for row in rows:
        found.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(found) >= 10_000 or size >= FLUSH_BYTES:
            yield pack(found)
            found, size = [], 0
    yield pack(found)


def sorted_groups(rows: DataFrame, keys: list[str], work: Callable[[tuple, Iterable[tuple]], Iterable[tuple]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Calls ``work(key, rows)`` for each group of ``keys`` (first columns of ``rows``) and collects the rows it gives.

    One shuffle by the keys and a sort, then Arrow batches; a task holds one group, ``ROWS`` rows of a batch as Python objects
    and about ``FLUSH_BYTES`` of what the work gives.
    With ``order`` a group comes sorted by these columns, as an iterator: then it is never held whole.
    """
    width = len(keys)
    columns = [*keys, *[c for c in rows.columns if c not in keys]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(out)

        def results() -> Iterator[tuple]:
            for key, group in groupby(row_stream(batches), lambda r: r[:width]):
                rest = (r[width:] for r in group)
                yield from work(key, rest if order else list(rest))

        yield from packed(results(), kind)

    out: StructType = _parse_datatype_string(schema)
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
