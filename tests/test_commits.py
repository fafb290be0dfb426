import glob
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gyrelake.plans import commits
from gyrelake.streaming import runs


class Crash(BaseException):
    """The process ends here: no handler of the code under test runs its course."""


def crash_at(n):
    """A step hook that ends at the n-th step, and the names of the steps that were reached."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == n:
            raise Crash(name)

    return step, seen


def rows_of(store, name):
    return sorted(map(tuple, store.read(name).collect()), key=str)


def run_row(spark, run_id):
    return spark.createDataFrame([(run_id, "created")], "run_id string, status string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def test_commit_of_two_tables_survives_a_crash_at_any_step(spark, tmp_path):
    root = str(tmp_path / "store")
    store = commits.Store(spark, root)
    assert store.version() == 0 and commits.add_run(store, run_row(spark, "a")) == 1
    for n in range(1, 9):
        step, seen = crash_at(n)
        try:
            commits.add_run(commits.Store(spark, root, step), run_row(spark, "b"))
        except Crash:
            fresh = commits.Store(spark, root)
            assert fresh.version() == 1 and [r[0] for r in rows_of(fresh, "runs")] == ["a"] and fresh.read("run_control").count() == 1
            fresh.verify()
        else:
            assert seen == ["write runs", "write run_control", "stage the manifest", "add the manifest"] and n == 5
            break
    assert [r[0] for r in rows_of(store, "runs")] == ["a", "b"] and store.read("run_control").where("lease_owner is null and not cancellation_requested").count() == 2
    left = len(glob.glob(f"{root}/data/*/*"))
    gone = store.vacuum()
    assert gone and len(glob.glob(f"{root}/data/*/*")) == left - len(gone) == 4
    store.verify()


def test_keys_and_conflicts(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "store"))
    commits.add_run(store, run_row(spark, "a"))
    for bad in ("a", None):
        with pytest.raises(KeyError):
            commits.add_run(store, run_row(spark, bad))
    with pytest.raises(KeyError):
        commits.add_run(store, run_row(spark, "c").union(run_row(spark, "c")))
    assert store.version() == 1
    store.commit({"other": spark.range(3)}, base=1)
    with pytest.raises(commits.Conflict):
        store.commit({"other": spark.range(4)}, base=1)
    assert store.read("other").count() == 3 and "other" not in store.tables(1)
    with pytest.raises(ValueError):
        store.commit(appended={"other": spark.range(2).withColumnRenamed("id", "x")})
    assert not [n for n in os.listdir(tmp_path / "store" / "log") if n.startswith(".staged") and not n.endswith(".crc")]


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, None, [1.0]), (None, 1, None), (2, 2, [])], "x int, y int, z array<double>")
    assert commits.fingerprint(a) == commits.fingerprint(a.orderBy("y").repartition(3))
    b = spark.createDataFrame([(None, 1, [1.0]), (1, None, None), (2, 2, [])], "x int, y int, z array<double>")
    assert commits.fingerprint(a) != commits.fingerprint(b) and commits.fingerprint(a) != commits.fingerprint(a.limit(2))
    assert commits.fingerprint(a.union(a))[0] == 6 and commits.fingerprint(a.limit(0)) == (0, 0)
    assert commits.fingerprint(spark.sql("select map('a', 1) as m")) != commits.fingerprint(spark.sql("select map('a', 2) as m"))


def test_backup_and_restore(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "store"))
    store.commit({"n": spark.range(50), "m": spark.range(5)}, notes={"head": 7})
    target = str(tmp_path / "copy")
    store.backup(target)
    with pytest.raises(commits.Conflict):
        store.backup(target)
    store.commit({"n": spark.range(9)})
    for n in range(1, 6):  # a restore that ends early changes nothing
        step, _ = crash_at(n)
        try:
            commits.Store(spark, str(tmp_path / "store"), step).restore(target)
        except Crash:
            assert store.version() == 2 and store.read("n").count() == 9
    assert store.version() == 3 and store.read("n").count() == 50 and store.notes() == {"head": 7} and store.read("n", 2).count() == 9
    (part, *_) = glob.glob(f"{target}/data/n/*/part-*.parquet")
    folder = os.path.dirname(part)
    spark.range(49).union(spark.range(60, 61)).coalesce(1).write.mode("overwrite").parquet(folder)  # as many rows, one of them changed
    with pytest.raises(commits.Damaged):
        store.restore(target)
    (part, *_) = glob.glob(f"{folder}/part-*.parquet")
    with open(part, "r+b") as f:
        f.write(b"no parquet")
    with pytest.raises(commits.Damaged):
        store.restore(target)
    assert store.version() == 3 and store.read("n").count() == 50
    store.verify()


def bundle(tmp_path, name):
    (tmp_path / name).mkdir()
    (tmp_path / name / "model.bin").write_bytes(b"weights")
    return str(tmp_path / name)


def describe(model):
    return lambda folder: {"model_bundle_id": model, "display_name": os.listdir(folder)[0]}


def test_import_and_delete_resume_after_a_crash_at_any_step(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "store"))
    folder, source = str(tmp_path / "models"), bundle(tmp_path, "upload")
    whole = lambda: sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.isdir(folder) else []
    known = lambda: sorted(r[0] for r in store.read("models").select("model_bundle_id").collect()) if "models" in store.tables() else []
    done = 0
    for n in range(1, 12):
        step, seen = crash_at(n)
        try:
            commits.Library(commits.Store(spark, store.root, step), folder).bring_in(source, describe("m1"))
            done = n
            break
        except Crash:
            commits.Library(store, folder).resume()
            assert whole() == known() == []
    assert done == len(seen) + 1 == 7 and whole() == known() == ["m1"] and os.path.exists(f"{folder}/m1/model.bin")
    library = commits.Library(store, folder)
    with pytest.raises(commits.Conflict):
        library.bring_in(source, describe("m1"))
    with pytest.raises(ZeroDivisionError):
        library.bring_in(source, lambda f: 1 / 0)
    with pytest.raises(ValueError):
        library.bring_in(source, describe("../m2"))
    assert whole() == known() == ["m1"] and not os.listdir(f"{folder}/.staging")
    none = spark.createDataFrame([], "model_bundle_id string")
    with pytest.raises(ValueError):
        library.delete_archived("m1", none)
    store.commit({"models": store.read("models").withColumn("state", F.lit("retired"))})
    with pytest.raises(ValueError):
        library.delete_archived("m1", spark.createDataFrame([("m1",)], "model_bundle_id string"))
    states = set()
    for n in range(1, 12):
        step, seen = crash_at(n)
        try:
            commits.Library(commits.Store(spark, store.root, step), folder).delete_archived("m1", none)
            break
        except Crash:
            library.resume()
            assert whole() == known() and not [f for f in os.listdir(folder) if f == ".trash" and os.listdir(f"{folder}/.trash")]
            states.add(bool(known()))
            if not known():  # the row went before the crash, so the folder went with it
                break
    assert states == {True, False} and whole() == known() == []


def test_a_failure_is_taken_back(spark, tmp_path, monkeypatch):
    store = commits.Store(spark, str(tmp_path / "store"))
    library = commits.Library(store, str(tmp_path / "models"))
    library.bring_in(bundle(tmp_path, "up"), describe("m"))
    store.commit({"models": store.read("models").withColumn("state", F.lit("retired"))})
    monkeypatch.setattr(store, "commit", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        library.delete_archived("m", spark.createDataFrame([], "model_bundle_id string"))
    assert os.path.exists(tmp_path / "models" / "m" / "model.bin")


def test_numbers_are_gapless_and_played_once(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "store"))
    batch = lambda a, b: spark.range(a, b).selectExpr("id", "(id * 7919) % 101 as at", "'x' as kind").repartition(5)
    scratch = str(tmp_path / "scratch")
    assert runs.append_events(store, batch(0, 50), 0, ["at", "id"], scratch) == 50
    assert runs.append_events(store, batch(50, 90), 1, ["at", "id"], scratch) == 90
    assert runs.append_events(store, batch(50, 90), 1, ["at", "id"], scratch) == 90  # the batch again
    for n in range(1, 5):
        step, _ = crash_at(n)
        try:
            runs.append_events(commits.Store(spark, store.root, step), batch(90, 95), 2, ["at", "id"], scratch)
        except Crash:
            assert store.read("events").count() == 90
    got = store.read("events").orderBy("sequence").collect()
    assert [r.sequence for r in got] == list(range(1, 96))
    for a, b in ((0, 50), (50, 90), (90, 95)):
        keys = [(r["at"], r["id"]) for r in got[a:b]]
        assert keys == sorted(keys) and {k[1] for k in keys} == set(range(a, b))
    assert runs.append_events(store, batch(0, 0), 3, ["at", "id"], scratch) == 95
    assert not os.listdir(scratch)


def signals(spark, path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame([(r, k, t) for r, k, t in rows], "run_id string, kind string, s double").selectExpr("run_id", "kind", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append").json(f"{path}/{i}")
    return f"{path}/*"


def test_silent_and_cancelled_runs_end(spark, tmp_path):
    files = [
        [("a", "start", 100.0), ("b", "start", 100.0), ("c", "start", 100.0), ("d", "start", 100.0), (None, "start", 100.0)],
        [("a", "beat", 120.0), ("b", "beat", 120.0), ("c", "cancel", 121.0)],
        [("a", "beat", 140.0), ("c", "beat", 141.0), ("b", "finish", 142.0)],  # d is silent since 100
        [("a", "beat", 165.0), ("e", "start", 165.0)],
        [("a", "beat", 190.0), ("e", "beat", 190.0)],
        [("a", "beat", 300.0)],  # a was silent from 190 to 300
        [("f", "start", 400.0)],
    ]
    path = signals(spark, str(tmp_path / "in"), files)
    stream = spark.readStream.schema("run_id string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).json(path)
    out = runs.watch(stream, 30_000).writeStream.format("memory").queryName("ended_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.table("ended_runs").collect())
    assert got == [("a", "cancelled", "heartbeat", 220_000), ("b", "finished", None, 142_000), ("c", "cancelled", "requested", 121_000), ("d", "cancelled", "heartbeat", 130_000), ("e", "cancelled", "heartbeat", 220_000)]


def test_a_cancelled_run_loses_its_jobs(spark):
    failed = []

    def work():
        try:
            runs.under_tag(spark, "r/1", lambda: spark.range(0, 10**13, 1, 4).agg(F.sum(F.expr("id % 7"))).collect())
        except Exception as error:
            failed.append(str(error))

    thread = threading.Thread(target=work)
    began = time.time()
    thread.start()
    time.sleep(4)
    runs.cancel_ended(spark)(spark.createDataFrame([("other", "finished"), ("r/1", "cancelled")], "run_id string, status string"), 0)
    thread.join(60)
    assert failed and not thread.is_alive() and time.time() - began < 30
    assert runs.under_tag(spark, "r/2", lambda: spark.range(5).count()) == 5
