import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import incremental as inc

RECORDS = "record_id long, root_dir string, scan_id long, path string, size long, mtime double, arrived_at string, status string"
SCANS = "scan_id long, root_dir string, status string, kb_name string"


def brute(records, scans):
    listing = {}
    for r in sorted(records, key=lambda r: r[0]):
        if r[5] is not None and r[3] is not None:
            listing.setdefault(r[2], {})[r[3].replace("\\", "/")] = (r[5], r[4])
    out, last = set(), {}
    for scan, root, status, _ in sorted(scans, key=lambda s: s[0]):
        if status != "success":
            continue
        now, before = listing.get(scan, {}), listing.get(last.get(root), {}) if root in last else {}
        out |= {(scan, p) for p, v in now.items() if before.get(p) != v}
        last[root] = scan
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    scans = [(i, rng.choice("aab"), rng.choice(["success", "success", "failed", None]), None) for i in range(1, 25)]
    records = []
    for i in range(1500):
        scan = rng.choice(scans)
        path = rng.choice(["x/", "x\\"]) + str(rng.randrange(12))
        records.append((i, scan[1], scan[0], path, rng.choice([1, 2, None]), rng.choice([1.0, 2.0, None]), "late", "clash"))
    got = inc.changed_paths(spark.createDataFrame(records, RECORDS), spark.createDataFrame(scans, SCANS)).collect()
    assert {(r.scan_id, r.path) for r in got} == brute(records, scans) and len(got) == len({(r.scan_id, r.path) for r in got})


def test_empty_and_null(spark):
    none = inc.changed_paths(spark.createDataFrame([], RECORDS), spark.createDataFrame([], SCANS))
    assert none.count() == 0
    rows = [(None, "a", 1, "p", None, 1.0, None, None), (2, "a", None, "p", 1, 1.0, None, None), (3, "a", 1, None, 1, 1.0, None, None)]
    got = inc.changed_paths(spark.createDataFrame(rows, RECORDS), spark.createDataFrame([(1, "a", "success", None)], SCANS)).collect()
    assert [(r.scan_id, r.path, r.size) for r in got] == [(1, "p", None)]


SCHEMA = "path string, version long, n long"


def source(spark, rows):
    return spark.createDataFrame(rows, "path string, version long")


def work(df):
    return df.withColumn("n", F.length("path").cast("long"))


def test_runs_survive_failures(spark, tmp_path):
    target = inc.VersionedTarget(spark, f"file://{tmp_path}/t")
    run = lambda rows, f=work: target.run(source(spark, rows), ["path"], ["version"], f, SCHEMA)
    assert run([("a", 1), ("b", 1), ("a", 1)]) == 1
    assert sorted(map(tuple, target.read(SCHEMA).collect())) == [("a", 1, 1), ("b", 1, 1)]

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run([("a", 2), ("c", 1)], dies)
    target.stage(work(source(spark, [("a", 2)])), 2)  # a run that died after writing and before publishing
    assert target.versions() == [1] and target.read(SCHEMA).count() == 2
    assert run([("a", 1), ("a", 2), ("b", 1), ("c", 1)]) == 2
    assert sorted((r.path, r.version) for r in target.read(SCHEMA).collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert run([("a", 2), ("c", 1)]) is None and target.versions() == [1, 2]


def test_a_version_is_published_once(spark, tmp_path):
    target = inc.VersionedTarget(spark, f"file://{tmp_path}/t")
    first, second = target.stage(work(source(spark, [("a", 1)])), 1), target.stage(work(source(spark, [("b", 1)])), 1)
    target.publish(1, first)
    with pytest.raises(FileExistsError):
        target.publish(1, second)
    assert [r.path for r in target.read(SCHEMA).collect()] == ["a"]


def test_runs_equal_changed_paths(spark, tmp_path):
    """An mtime that goes back, a path that returns unchanged and one that only vanishes: one run per scan gives the rows of changed_paths."""
    lists = [{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 2.0, "c": 1.0}, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 1.0}]
    records = [(10 * s + i, "r", s, p, 1, m, None, None) for s, held in enumerate(lists) for i, (p, m) in enumerate(held.items())]
    rows = spark.createDataFrame(records, RECORDS)
    want = {(r.scan_id, r.path) for r in inc.changed_paths(rows, spark.createDataFrame([(s, "r", "success", None) for s in range(5)], SCANS)).collect()}
    target, got, seen = inc.VersionedTarget(spark, f"file://{tmp_path}/t"), set(), 0
    schema = "path string, mtime double, size long"
    for s in range(5):
        target.run(inc.listings(rows.where(F.col("scan_id") == s)).drop("scan_id"), ["path"], ["mtime", "size"], lambda df: df, schema, whole=True)
        held = target.read(schema).count()
        new = [r.path for n in target.versions() if n > seen for r in spark.read.parquet(f"{target.root}/{target._commit(n)['folder']}").collect()]
        assert held == len(got) + len(new)
        got, seen = got | {(s, p) for p in new}, (target.versions() or [0])[-1]
    assert got == want and (2, "a") in got and (2, "b") in got


def test_a_version_that_returns_is_processed_again(spark, tmp_path):
    target = inc.VersionedTarget(spark, f"file://{tmp_path}/t")
    run = lambda v: target.run(source(spark, [("a", v)]), ["path"], ["version"], work, SCHEMA)
    assert [run(1), run(2), run(1), run(1)] == [1, 2, 3, None]


def test_two_interleaved_runs_repeat_nothing(spark, tmp_path):
    target, other = (inc.VersionedTarget(spark, f"file://{tmp_path}/t") for _ in range(2))
    calls = []

    def overtaken(df):
        if not calls:
            calls.append(other.run(source(spark, [("a", 1)]), ["path"], ["version"], work, SCHEMA))
        return work(df)

    assert target.run(source(spark, [("a", 1), ("b", 1)]), ["path"], ["version"], overtaken, SCHEMA) == 2
    assert calls == [1] and sorted(r.path for r in target.read(SCHEMA).collect()) == ["a", "b"]


def test_a_root_without_scheme_is_on_the_default_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://c/")
    conf.set("fs.viewfs.mounttable.c.link./data", f"file://{tmp_path}")
    try:
        target = inc.VersionedTarget(spark, "/data/t")
        assert target.root == "viewfs://c/data/t"
        assert target.run(source(spark, [("a", 1)]), ["path"], ["version"], work, SCHEMA) == 1
        assert (tmp_path / "t/commits/1.json").exists() and target.read(SCHEMA).count() == 1
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_state_is_kept_every_few_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "COMPACT", 2)
    target = inc.VersionedTarget(spark, f"file://{tmp_path}/t")
    run = lambda *rows: target.run(source(spark, list(rows)), ["path"], ["version"], work, SCHEMA)
    assert [run(("a", 1), ("b", 1)), run(("a", 2)), run(("a", 1), ("b", 1)), run(("b", 2), ("a", 1)), run(("b", 2)), run(("b", 1))] == [1, 2, 3, 4, None, 5]
    assert "listing" in target._commit(2) and "listing" in target._commit(4) and "listing" not in target._commit(3)
    assert sorted(map(tuple, target.state(["path"], ["version"], SCHEMA).collect())) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("seed", range(2))
def test_runs_over_scans_equal_the_whole_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    scans = [(i, rng.choice("aab"), rng.choice(["success", "success", "failed", None]), None) for i in range(1, 16)]
    records = [(i, s[1], s[0], rng.choice(["x/", "x\\"]) + str(rng.randrange(6)), rng.choice([1, 2, None]), rng.choice([1.0, 2.0, None]), "", "") for i in range(400) for s in [rng.choice(scans)]]
    rows, target = spark.createDataFrame(records, RECORDS), inc.VersionedTarget(spark, f"file://{tmp_path}/t")
    for upto in (4, 5, 9, 15, 15):
        before = target.versions()
        with pytest.MonkeyPatch.context() as m:  # a run that dies between writing and publishing
            m.setattr(target, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            known = spark.createDataFrame([s for s in scans if s[0] <= upto], SCANS)
            if inc.scan_plan(known, target.read(inc.HISTORY, before[-1:]).where("held and path is null").select("scan_id", "root") if before else None).where("new").isEmpty():
                assert inc.process_scans(target, rows, known) is None
                continue
            with pytest.raises(RuntimeError):
                inc.process_scans(target, rows, known)
        assert target.versions() == before and inc.process_scans(target, rows, known) == len(before) + 1
    got = [(r.scan_id, r.path) for r in inc.processed_paths(target).collect()]
    assert set(got) == brute(records, scans) and len(got) == len(set(got))
