import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gyrelake.operators import evidence, grouping
from gyrelake.raster_queries import reference_fill


def test_two_nearest_holds_slices_of_the_products():
    """A full block of queries against a full batch: 10,000 x 4,096 products would be 328 MB."""
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, (10_000, 8)).astype(np.float64)  # many ties
    batch = pa.record_batch([pa.array(np.arange(10_000)), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])
    ids = np.arange(0, 10_000, 3)[:3000]
    tracemalloc.start()
    out = pa.Table.from_batches(evidence.two_nearest(iter([batch.slice(0, 6000), batch.slice(6000)]), ids, v[ids])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    got = {}
    for r in sorted(out, key=lambda r: (r["query"], r["d"], r["id"])):
        got.setdefault(r["query"], []).append((r["d"], r["id"]))
    for q in ids[::200].tolist():
        d = ((v - v[q]) ** 2).sum(1)
        assert got[q] == sorted((x, i) for i, x in enumerate(d.tolist()) if i != q)[:2]


def test_results_are_flushed_by_bytes():
    kind = pa.schema([("k", pa.int64()), ("data", pa.binary())])
    sizes = [b["data"].nbytes for b in grouping.packed(((i, bytes(1 << 20)) for i in range(40)), kind)]
    assert max(sizes) <= grouping.FLUSH_BYTES + (2 << 20) and len(sizes) >= 10


def test_even_positions_by_few_comparisons(spark):
    for most in (1, 2, 3, 7, 300):
        kept = evidence.evenly_kept(F.col("n"), F.col("r"), most)
        assert "sequence" not in str(kept)
        rows = spark.createDataFrame([(n, r) for n in (1, 2, 5, 8, 299, 301, 777, 1000) for r in range(n)], "n long, r long")
        got = {(x.n, x.r) for x in rows.where(kept).collect()}
        want = set()
        for n in (1, 2, 5, 8, 299, 301, 777, 1000):
            if n <= most or most < 2:
                want |= {(n, r) for r in range(min(n, most))}
            else:
                step = (n - 1) / float(most - 1)
                want |= {(n, n - 1 if i == most - 1 else int(np.floor(i * step))) for i in range(most)}
        assert got == want


def test_the_reference_layer_is_warped_once(spark, small_dir):
    plan = reference_fill(spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    warps = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(warps) == 3  # blocks, targets, pixels


def test_equal_boxes_are_one_polygon(spark, tmp_path):
    """Rows of one box that differ in other columns are filled once: the plan joins distinct boxes back."""
    from gyrelake.raster_queries import polygon_footprints

    plan = polygon_footprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan
