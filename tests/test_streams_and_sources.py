"""Event log, leases, cycles, life cycle writes and file sources."""

import datetime as dt
import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gyrelake.operators import registration
from gyrelake.plans import contracts, lifecycle, metadata
from gyrelake.sources import files
from gyrelake.streaming import cycles, events


def test_event_ring(spark):
    log = events.retained(spark.range(1, 16).selectExpr("id as sequence"), 10)
    assert [r.sequence for r in events.event_page(log, 1, 3).collect()] == [6, 7, 8]
    got = {r.after: r for r in events.gaps(log, spark.createDataFrame([(0,), (1,), (5,)], "after long")).collect()}
    assert got[1].gap and not got[0].gap and not got[5].gap and got[1].latest == 15
    empty = events.gaps(log.limit(0), spark.createDataFrame([(3,)], "after long")).first()
    assert (empty.oldest, empty.latest, empty.gap) == (1, 0, False)
    with pytest.raises(ValueError):
        events.event_page(log, 0, 501)


def test_leases_and_retries(spark):
    asked = [("r", 1, 0, "a", 10), ("r", 2, 5, "b", 10), ("r", 3, 8, "a", 10), ("r", 4, 18, "b", 10), ("r", 5, 20, "a", 1)]
    got = events.leases(spark.createDataFrame(asked, "run_id string, sequence long, at long, owner string, seconds long"))
    assert [r.granted for r in got.orderBy("sequence").collect()] == [True, False, True, True, False]
    asked = [("r", 1, 0, "a", 10, "renew"), ("r", 2, 1, "a", 10, None), ("r", 3, 2, "b", 10, "release"), ("r", 4, 30, "a", 5, "renew"), ("r", 5, 31, "b", 5, "acquire"), ("r", 6, 32, "a", 5, "release"), ("r", 7, 33, "b", 5, "acquire")]
    got = events.leases(spark.createDataFrame(asked, "run_id string, sequence long, at long, owner string, seconds long, kind string")).orderBy("sequence").collect()
    assert [(r.owner, r.until, r.granted) for r in got] == [(None, None, False), ("a", 11, True), ("a", 11, False), ("a", 35, True), ("a", 35, False), (None, None, True), ("b", 38, True)]
    tries = [("r", "s", 1, "retry"), ("r", "s", 2, "retry"), ("r", "s", 3, "retry"), ("r", "s", 4, "ok"), ("r", "t", 1, "retry"), ("r", "t", 2, "ok"), ("r", "u", 1, "error"), ("r", "v", 1, "retry")]
    out = events.retry_state(spark.createDataFrame(tries, "run_id string, stage string, sequence long, outcome string"))
    assert sorted((r.stage, r.attempts, r.status) for r in out.collect()) == [("s", 3, "failed"), ("t", 2, "completed"), ("u", 1, "failed"), ("v", 1, "running")]
    marks = spark.createDataFrame([("a", "completed", "AA"), ("b", "completed", "bb"), ("c", "running", "cc"), ("d", "completed", "dd")], "evidence_path string, status string, evidence_sha256 string")
    have = spark.createDataFrame([("a", "aa"), ("b", "xx"), ("c", "cc")], "path string, sha256 string")
    assert {r.evidence_path: r.reuse for r in events.reusable(marks, have).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_cycle_gate(spark):
    data = [("a", p) for p in range(1, 17)] + [("b", p) for p in range(1, 9)] + [("c", 1), ("c", 1)]
    got = {r.cycle: r.status for r in cycles.cycle_gate(spark.createDataFrame(data, "cycle string, position int")).collect()}
    assert got == {"a": "complete", "b": "incomplete", "c": "duplicate"}


def test_cycle_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    batches = [
        [("a", p, t0 + dt.timedelta(milliseconds=100 * p)) for p in range(1, 17)] + [("b", p, t0) for p in range(1, 5)],
        [("z", 1, t0 + dt.timedelta(seconds=30))],
        [("z", 2, t0 + dt.timedelta(seconds=200))],
        [("z", 3, t0 + dt.timedelta(seconds=201))],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "cycle string, position int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    files_in = spark.readStream.schema("cycle string, position int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = cycles.assemble(files_in, 1000, 60_000).writeStream.format("memory").queryName("cycles_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.cycle: (r.status, r.positions) for r in spark.table("cycles_out").collect()}
    assert got["a"] == ("complete", 16) and got["b"] == ("incomplete", 4)


def test_state_changes(spark):
    models = spark.createDataFrame([("m1", "approved"), ("m2", "active"), ("m3", "valid")], "id string, state string")
    assert {r.id: r.state for r in lifecycle.activate(models, "id", "m1").collect()} == {"m1": "active", "m2": "approved", "m3": "valid"}
    with pytest.raises(ValueError):
        lifecycle.activate(models, "id", "m3")
    with pytest.raises(KeyError):
        lifecycle.set_state(models, "id", "none", "retired")
    assert sorted(r.id for r in lifecycle.delete(models, "id", "m2").collect()) == ["m1", "m3"]
    runs = spark.createDataFrame([("r", "created", "x", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "run_id string, status string, failure_code string, started_at timestamp, finished_at timestamp")
    got = lifecycle.set_run_status(runs, "r", "running").first()
    assert (got.status, got.failure_code, got.started_at, got.finished_at) == ("running", None, dt.datetime(2024, 1, 1), None)
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 1, "w")], "k string, v int, s string")
    assert sorted(map(tuple, lifecycle.upsert(old, new, ["k"], "v").collect())) == [("a", 1, "z"), ("b", 1, "y"), ("c", 1, "w")]
    assert metadata.pair_rule("a", "b") is not None
    with pytest.raises(ValueError):
        metadata.page(old, "v", "k", 201)


def test_publish_replaces_whole_tables(spark, tmp_path):
    target = str(tmp_path / "t")
    lifecycle.publish(spark, spark.range(5), target)
    lifecycle.publish(spark, spark.range(3), target)
    assert spark.read.parquet(target).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert lifecycle.snapshot(spark, {"n": spark.range(4)}, str(tmp_path / "copy")) == {"n": 4}
    digest = lifecycle.save_json(tmp_path / "c.json", {"b": 1, "a": "é"})
    assert (tmp_path / "c.json").read_bytes() == '{"a":"é","b":1}'.encode() and len(digest) == 64
    with pytest.raises(ValueError):
        lifecycle.canonical_json(float("nan"))


def test_contract_rules(spark):
    schema = "id string, inference_enabled boolean, mode string, threshold double, sahi boolean, reconstruction_enabled boolean, segments int, degrees double, model_bundle_id string, intake string, automatic boolean"
    data = [
        ("good", True, "sahi", 0.5, True, True, 16, 22.5, "m", "manual_folder", None),
        ("bare", False, None, None, None, False, None, None, None, "manual_folder", None),
        ("turn", False, None, None, None, True, 16, 22.0, None, "automatic_folder", True),
        ("slices", True, "direct", 0.5, True, False, None, None, None, "automatic_folder", None),
    ]
    got = metadata.violations(spark.createDataFrame(data, schema), F.col("id"), contracts.pipeline_rules()).collect()
    assert {(r.key, r.rule) for r in got} == {("bare", "some_stage"), ("turn", "full_turn"), ("slices", "no_slices_for_direct"), ("slices", "model_with_inference"), ("slices", "automatic_settings")}
    names = spark.createDataFrame([("{cycle}_{position}.jpg",), ("{cycle}.jpg",), ("{cycle}_{position}{x}",), ("a/{cycle}{position}",)], "filename_template string")
    got = metadata.violations(names, F.col("filename_template"), contracts.template_rules()).collect()
    assert {(r.key, r.rule) for r in got} == {("{cycle}.jpg", "one_position"), ("{cycle}_{position}{x}", "no_other_braces"), ("a/{cycle}{position}", "safe_characters")}
    schema = "id string, side string, strategy string, plate_only boolean, screens boolean, angles array<double>, replaces_screens boolean, offset double, median_limit double, most_limit double"
    ten = [float(x) for x in range(10)]
    data = [("u", "upper", "upper_black_plate", True, False, [], False, None, 3.0, 8.0), ("l", "lower", "lower_complete_assembly", False, True, ten, True, 1.0, 3.0, 8.0), ("x", "upper", "upper_black_plate", True, False, None, False, 2.0, 9.0, 8.0), ("y", "lower", "lower_complete_assembly", False, True, ten[:9], False, None, 3.0, 8.0)]
    got = metadata.violations(spark.createDataFrame(data, schema), F.col("id"), contracts.center_rules()).collect()
    assert {(r.key, r.rule) for r in got} == {("x", "upper_has_no_offset"), ("x", "limits"), ("y", "ten_angles")}


def test_radial_band(spark):
    data = [(1, 0.0, 0.0, -50.0, 100.0, 50.0, 300.0, 90.0), (2, 0.0, 0.0, 0.0, 100.0, 1.0, 300.0, 90.0)]
    got = registration.radial_bands(spark.createDataFrame(data, "acq int, cx double, cy double, left double, top double, right double, bottom double, ray double")).collect()
    edge = 100 / math.cos(math.radians(11.25))
    assert [(r.acq, r.inner, r.outer) for r in got] == [(1, math.ceil(edge + 2), math.floor(50 / math.sin(math.radians(11.25)) - 2))]


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\0\0\0"


def test_image_folders(spark, tmp_path):
    folder = tmp_path / "cycle"
    folder.mkdir()
    for i in range(1, 17):
        (folder / f"{i}_camera.png").write_bytes(png(32, 24) + bytes([i]))
    (folder / "notes.txt").write_text("x")
    assert [r.position for r in files.ordered_images(spark, str(folder)).collect()] == list(range(1, 17))
    seen = files.images(spark, str(folder))
    assert {(r.format, r.width, r.height) for r in seen.collect()} == {("PNG", 32, 24)}
    assert files.one_size(seen.withColumn("g", F.lit(1)), "g").isEmpty()
    expected = spark.createDataFrame([(f"{i}_CAMERA.png",) for i in range(1, 16)] + [("gone.png",)], "relative string")
    assert sorted(r.relative for r in files.inventory_problems(spark, str(folder), expected).collect()) == ["16_camera.png", "gone.png"]
    (folder / "1_again.png").write_bytes(png(32, 24))
    with pytest.raises(ValueError):
        files.ordered_images(spark, str(folder))
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 48, 64) + b"\0" * 9
    tiff = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHHHHIHH", 256, 3, 1, 7, 0, 257, 3, 1, 9, 0)
    assert files.image_header(jpeg) == ("JPEG", 64, 48) and files.image_header(tiff) == ("TIFF", 7, 9) and files.image_header(b"no") is None


def test_archives_and_documents(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "x")
        z.writestr("A.TXT", "y")
        z.writestr("big.bin", b"\0" * 2_000_000)
        z.writestr("fine.bin", "hello")
    (tmp_path / "b.zip").write_bytes(body.getvalue())
    assert {r.name: r.problem for r in files.archive_entries(spark, str(tmp_path / "b.zip")).collect()} == {"a.txt": "collision", "A.TXT": "collision", "big.bin": "ratio", "fine.bin": None}
    for name, text in (("ok", '{"a": 1}'), ("extra", '{"a": 1, "b": 2}'), ("bad", "{")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in files.documents(spark, str(tmp_path / "*.json"), "a int").collect()}
    assert got == {"ok.json": None, "extra.json": "extra", "bad.json": "json"}
