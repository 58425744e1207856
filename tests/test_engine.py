import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from rowtide.operators import lookup
from rowtide.plans import config, planner, runs
from rowtide.plans.config import ConfigError, State
from rowtide.sources import avro_file, delete_writers, scans, table_log, vectors
from rowtide.sources.index_store import Index
from rowtide.sources.table_log import Conflict, Table
from rowtide.streaming import engine, ingest

PK = {config.PRIMARY_KEYS: "id", config.INDEX_BUCKETS: "2"}


def make(spark, tmp_path, version=3, partition_by=(), schema="id bigint, name string, dept string", props=PK):
    t = Table.create(spark, str(tmp_path / "t"), schema, partition_by, props, version)
    return t, Index.create(spark, str(tmp_path / "index"), "ns.t", 2)


def rows(spark, *ids, dept="eng", name="a"):
    return spark.createDataFrame([(i, f"{name}{i}", dept) for i in ids], "id bigint, name string, dept string")


def keys(spark, *ids, dept=None):
    if dept is None:
        return spark.createDataFrame([(i,) for i in ids], "id bigint")
    return spark.createDataFrame([(i, dept) for i in ids], "id bigint, dept string")


def seen(t, meta=None):
    return sorted((r.id, r.name, r.dept) for r in t.visible(meta).collect())


def contents(t):
    return sorted((r.content, r.records) for r in t.files().collect())


@pytest.mark.parametrize("version", [2, 3])
def test_single_conversion(spark, tmp_path, version):
    t, i = make(spark, tmp_path, version)
    t.append(rows(spark, 1, 2, 3).coalesce(1))
    t.write(delete_keys=keys(spark, 2))
    before = seen(t)
    assert [r[0] for r in before] == [1, 3]
    assert engine.process_all(t, i) == 2
    assert seen(t) == before
    kind = "dv" if version == 3 else "pos"
    assert contents(t) == [("data", 3), (kind, 1)]
    m = t.meta()
    assert m.summary == {config.CONVERTED: "true"} and State.of(m.properties) == State(2, 0)
    assert m.properties[config.PINNED_KEYS] == "id" and m.properties[config.PINNED_BUCKETS] == "2"


@pytest.mark.parametrize("version", [2, 3])
def test_merges_with_present_deletes(spark, tmp_path, version):
    t, i = make(spark, tmp_path, version)
    t.append(rows(spark, 1, 2, 3).coalesce(1))
    path = t.files(content="data").first().path
    t.write(positions=spark.createDataFrame([(path, 0), (path, 0)], "data_file_path string, pos bigint"))
    assert [r[0] for r in seen(t)] == [2, 3]
    t.write(delete_keys=keys(spark, 3))
    engine.process_all(t, i)
    assert [r[0] for r in seen(t)] == [2]
    assert contents(t) == [("data", 3), ("dv" if version == 3 else "pos", 2)]
    t.append(rows(spark, 4, 5).coalesce(1))
    path = next(r.data_file_path for r in t.scan(t.files(content="data"), t.meta()).collect() if r.id == 4)
    t.write(positions=spark.createDataFrame([(path, 0)], "data_file_path string, pos bigint"))
    t.append(rows(spark, 6))
    engine.process_all(t, i)
    # the run ends after the position delete, so the index never gets the deleted row
    assert sorted(r.pk for r in i.rows().where(F.col("data_file_path") == path).collect()) == ["020a"]


def test_many_files_and_nothing_to_convert(spark, tmp_path):
    t, i = make(spark, tmp_path)
    t.append(rows(spark, 1))
    t.append(rows(spark, 2))
    t.write(delete_keys=keys(spark, 1, 2, 99))
    engine.process_all(t, i)
    assert seen(t) == [] and contents(t) == [("data", 1), ("data", 1), ("dv", 1), ("dv", 1)]
    t.write(delete_keys=keys(spark, 99))
    engine.process_all(t, i)
    assert not [c for c in contents(t) if c[0] == "eq"]


def test_partition_scope_and_spec_scope(spark, tmp_path):
    t, i = make(spark, tmp_path, 3, ["dept"])
    t.append(rows(spark, 1).unionByName(rows(spark, 1, dept="sales")))
    t.write(delete_keys=keys(spark, 1, dept="eng"))
    before = seen(t)
    assert before == [(1, "a1", "sales")]
    engine.process_all(t, i)
    assert seen(t) == before
    t.evolve_partitioning(["dept", "name"])
    t.append(rows(spark, 7))
    wide = spark.createDataFrame([(7, "eng", "a7"), (1, "sales", "a1")], "id bigint, dept string, name string")
    t.write(delete_keys=wide)
    before = seen(t)
    # the delete is of the new spec, so the old row stays
    assert before == [(1, "a1", "sales")]
    engine.process_all(t, i)
    assert seen(t) == before


def test_null_keys_and_composite(spark, tmp_path):
    t, i = make(spark, tmp_path, props={config.PRIMARY_KEYS: "id, name ,"})
    df = spark.createDataFrame([(None, "x", "d"), (None, None, "d"), (1, "x", "d")], "id bigint, name string, dept string")
    t.append(df)
    t.write(delete_keys=df.where("id is null and name is null").select("id", "name"))
    before = sorted(map(str, t.visible().collect()))
    assert len(before) == 2
    engine.process_all(t, i)
    assert sorted(map(str, t.visible().collect())) == before


def test_walk_alternates_and_resumes(spark, tmp_path):
    t, i = make(spark, tmp_path)
    for k in range(3):
        t.upsert(rows(spark, 1, 2, k + 3, name=f"v{k}"))
    m = t.meta()
    listed = planner.runs(runs.walkable(t, m)).orderBy("run_id").collect()
    assert [(r.kind, r.max_seq) for r in listed] == [(0, 1), (1, 1), (0, 2), (1, 2), (0, 3), (1, 3)]
    before = seen(t)
    one = engine.process_next_run(t, i)
    assert (one.kind, one.max_seq) == (0, 1) and State.of(t.meta().properties) == State(1, 0)
    assert engine.process_all(t, i) == 5 and engine.process_next_run(t, i) is None
    assert seen(t) == before and len(before) == 5
    for m in t.snapshots():
        if m.summary.get(config.CONVERTED):
            parent = next(p for p in t.snapshots() if p.snapshot_id == m.parent_id)
            assert lookup.same_rows(t.visible(m), t.visible(parent))


def test_large_random_upserts_keep_the_visible_rows(spark, tmp_path):
    t, i = make(spark, tmp_path)
    rnd = np.random.default_rng(42)
    for k in range(3):
        ids = rnd.integers(0, 6000, 5000)
        t.upsert(spark.createDataFrame([(int(x), f"{k}-{n}", "d") for n, x in enumerate(ids)], "id bigint, name string, dept string"), ["name"])
    before = t.visible().cache()
    assert before.count() == before.select("id").distinct().count()
    engine.process_all(t, i)
    assert lookup.same_rows(before, t.visible())
    assert not t.files(content="eq").count()


def test_unconvertible_deletes_stay(spark, tmp_path):
    t, i = make(spark, tmp_path)
    t.append(rows(spark, 1, 2))
    t.write(delete_keys=spark.createDataFrame([("a1",)], "name string"), delete_columns=["name"])
    t.append(rows(spark, 3))
    run = runs.plan_next(t, t.meta())
    assert (run.kind, run.max_seq, run.count) == (1, 3, t.files(content="data").count())
    before = seen(t)
    engine.process_all(t, i)
    assert seen(t) == before and [r[0] for r in before] == [2, 3]
    assert t.files(content="eq").count() == 1


def test_drift_and_versions(spark, tmp_path):
    t, i = make(spark, tmp_path, props={config.PRIMARY_KEYS: "id"})
    t.append(rows(spark, 1))
    engine.process_all(t, i)
    t.append(rows(spark, 2))
    # an unset bucket count is its default, no drift
    assert engine.process_all(t, i) == 1
    t.set_properties({config.PRIMARY_KEYS: "name"})
    with pytest.raises(ConfigError, match="primary-keys"):
        runs.plan_next(t, t.meta())
    t.set_properties({config.PRIMARY_KEYS: "id", config.INDEX_BUCKETS: "7"})
    with pytest.raises(ConfigError, match="index-buckets"):
        runs.plan_next(t, t.meta())
    with pytest.raises(ConfigError, match="format-version"):
        config.check_version(1)
    with pytest.raises(ConfigError):
        config.TableConfig.of({})


def convert_by_hand(t, i, meta):
    run = runs.plan_next(t, meta)
    found = i.find(engine.probes(t, meta, run))
    adds, old = delete_writers.merged(t, meta, t.files(meta), found)
    return planner.assemble(adds, run.files, old)


def test_conflicts(spark, tmp_path):
    t, i = make(spark, tmp_path)
    t.append(rows(spark, 1, 2, 3).coalesce(1))
    engine.process_all(t, i)
    t.write(delete_keys=keys(spark, 2))
    meta = t.meta()
    adds, removes = convert_by_hand(t, i, meta)
    path = t.files(content="data").first().path
    t.write(positions=spark.createDataFrame([(path, 0)], "data_file_path string, pos bigint"))
    with pytest.raises(Conflict, match="meanwhile"):
        t.commit(meta, adds, removes)
    # the same again, planned anew, succeeds
    engine.process_all(t, i)
    assert [r[0] for r in seen(t)] == [3]
    with pytest.raises(Conflict, match="gone"):
        t.commit(t.meta(), None, removes)
    with pytest.raises(Conflict):
        t._put(t.meta())


def test_vanished_data_file_is_no_conflict(spark, tmp_path):
    t, i = make(spark, tmp_path)
    t.append(rows(spark, 1, 2).coalesce(1))
    engine.process_all(t, i)
    t.write(delete_keys=keys(spark, 2))
    meta = t.meta()
    adds, removes = convert_by_hand(t, i, meta)
    t.commit(meta, None, t.files(content="data").select("path", "referenced", "content"))
    assert t.commit(meta, adds, removes).version == t.meta().version
    assert seen(t) == []


def test_crash_between_index_and_watermark(spark, tmp_path, monkeypatch):
    t, i = make(spark, tmp_path)
    t.append(rows(spark, 1, 2))
    real = Table.commit
    monkeypatch.setattr(Table, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        engine.process_next_run(t, i)
    monkeypatch.setattr(Table, "commit", real)
    t.write(delete_keys=keys(spark, 1))
    engine.process_all(t, i)
    assert [r[0] for r in seen(t)] == [2] and i.rows().count() == 2


def test_no_op_commit(spark, tmp_path):
    t, _ = make(spark, tmp_path)
    assert t.commit(t.meta()) == t.meta()


def test_manifests_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table_log, "FOLDERS", 3)
    t, _ = make(spark, tmp_path)
    for k in range(5):
        t.append(rows(spark, k))
    assert len(t.meta().manifests) <= 3 and len(seen(t)) == 5


@pytest.mark.parametrize("fmt", ["parquet", "orc", "avro"])
def test_reader_formats(spark, tmp_path, fmt):
    path = str(tmp_path / f"f.{fmt}")
    ids = [10, 20, 30, 40, 50, 60]
    if fmt == "avro":
        avro_file.write(path, [("id", "long"), ("name", "string")], [(i, None if i == 30 else f"n{i}") for i in ids])
    else:
        out = str(tmp_path / "d")
        spark.createDataFrame([(i, None if i == 30 else f"n{i}") for i in ids], "id bigint, name string").coalesce(1).write.format(fmt).save(out)
        os.rename(next(os.path.join(out, n) for n in os.listdir(out) if n.endswith(fmt)), path)
    from pyspark.sql.types import StructType

    listing = spark.createDataFrame([(path, fmt)], "path string, format string")
    got = scans.rows(spark, listing, StructType.fromDDL("id bigint, name string"))
    assert [(r.pos, r.id, r.name) for r in got.orderBy("pos").collect()] == [(p, i, None if i == 30 else f"n{i}") for p, i in enumerate(ids)]
    dead = spark.createDataFrame([(path, p) for p in (0, 2, 2, 4, 4, 5)], "data_file_path string, pos bigint")
    assert sorted(r.id for r in scans.without_positions(got, dead).collect()) == [20, 40]
    only = scans.rows(spark, listing, StructType.fromDDL("id bigint, name string"), ["id"])
    assert only.columns == ["data_file_path", "pos", "id"] and only.count() == 6


def test_unknown_format(spark):
    from pyspark.sql.types import StructType

    with pytest.raises(NotImplementedError):
        scans.rows(spark, spark.createDataFrame([("x", "csv")], "path string, format string"), StructType.fromDDL("id bigint"))


def test_index_strategies_agree_and_are_what_they_say(spark, tmp_path):
    i = Index.create(spark, str(tmp_path), "a.b-c", 4)
    assert i.path.endswith("a_b_c")
    e = spark.range(5000).select(F.lit(0).alias("spec_id"), F.lit("").alias("partition_key"), F.format_string("%08x", "id").alias("pk"), F.lit("f").alias("data_file_path"), F.col("id").alias("pos"), F.lit(1).alias("seq"))
    i.append(e)
    i.append(e.where("pos < 10").withColumn("seq", F.lit(2)).withColumn("pos", F.col("pos") + 9000))
    again = Index.create(spark, str(tmp_path), "a.b-c", 4)
    probe = e.where("pos % 7 = 0").select("spec_id", "partition_key", "pk")
    probe = probe.unionByName(probe).unionByName(spark.createDataFrame([(0, "", "zz"), (1, "", "00000000")], probe.schema))
    results = []
    for compacted in (False, True):
        if compacted:
            again.compact()
            assert again.vacuum()
        for how in ("in", "broadcast", "merge", None):
            results.append(sorted(map(tuple, again.find(probe, how).collect())))
    assert all(r == results[0] for r in results) and len(results[0]) == 715
    assert (0, "", "00000007", "f", 9007) in results[0]
    assert again.warm() == 5000 and sorted(map(tuple, again.find(probe).collect())) == results[0]
    i.append(e.where("pos = 7").withColumn("seq", F.lit(3)))
    assert (0, "", "00000007", "f", 7) in set(map(tuple, again.find(probe).collect()))
    again.cool()
    again.compact()
    few = again.find(probe.where("pk = '00000007'"), "in")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = few._jdf.queryExecution().toString() + again.find(probe.where("pk = '00000007'"), "in")._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 4" in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "BroadcastHashJoin" in again.find(probe, "broadcast")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in again.find(probe, "merge")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        lookup.lookup(e, again.entries(), ["pk"], "pk", "in")


@pytest.mark.parametrize("compacted", [False, True])
def test_index_of_all_entries(spark, tmp_path, compacted):
    t, _ = make(spark, tmp_path)
    i = Index.create(spark, str(tmp_path / "index"), "all", 2, every=True)
    t.append(rows(spark, 1, 1, 2).coalesce(1))
    engine.process_all(t, i)
    if compacted:
        i.compact()
    t.write(delete_keys=keys(spark, 1))
    before = seen(t)
    engine.process_all(t, i)
    assert seen(t) == before == [(2, "a2", "eng")]
    assert Index.create(spark, str(tmp_path / "index"), "all", 2).version().every


def test_vector_codec():
    rnd = np.random.default_rng(1)
    for p in ([], [0], [0, 1, 65535, 65536, 1 << 33, (1 << 33) + 5], rnd.integers(0, 200_000, 60_000), np.arange(5000), rnd.integers(0, 1 << 40, 3000)):
        p = np.unique(np.asarray(p, np.int64))
        assert np.array_equal(vectors.read_vector(vectors.write_vector(p)), p)
    data, places = vectors.write_puffin({"a": np.array([3, 1, 3]), "b": np.arange(9)})
    assert [(b["properties"]["referenced-data-file"], b["offset"], b["length"]) for b in vectors.puffin_blobs(data)] == [(k, *places[k][:2]) for k in ("a", "b")]
    o, n, c = places["a"]
    assert c == 2 and vectors.read_vector(data[o : o + n]).tolist() == [1, 3]
    for bad in (data[o : o + n - 1], data[o : o + n][:-1] + b"x", b"\0" * 20):
        with pytest.raises(ValueError):
            vectors.read_vector(bad)
    for bad in (b"", data[:-1], b"PFA1" + bytes(12) + b"PFA1"):
        with pytest.raises(ValueError):
            vectors.puffin_blobs(bad)
    with pytest.raises(ValueError):
        vectors.write_bitmap(np.array([-1]))


def test_vectors_agree_with_the_java_library(spark):
    jvm = spark._jvm
    p = np.unique(np.concatenate([np.arange(70_000), np.random.default_rng(2).integers(0, 1 << 20, 500)]))
    b = vectors._write32(p.astype(np.uint32))
    m = jvm.org.roaringbitmap.RoaringBitmap()
    m.deserialize(jvm.java.nio.ByteBuffer.wrap(bytearray(b)))
    assert m.getLongCardinality() == len(p) and m.last() == int(p[-1])
    m.runOptimize()
    out = jvm.java.nio.ByteBuffer.allocate(m.serializedSizeInBytes())
    m.serialize(out)
    got, end = vectors._read32(bytes(out.array()), 0)
    assert np.array_equal(got, p) and end == m.serializedSizeInBytes()


def test_streaming_ingest_equals_last_versions(spark, tmp_path):
    import json
    import random

    t = Table.create(spark, str(tmp_path / "t"), "id bigint, name string, ts bigint", (), PK, 2)
    src = tmp_path / "in"
    src.mkdir()
    rnd, last, ts = random.Random(42), {}, 0
    for n in range(3):
        with open(src / f"{n}.json", "w") as f:
            for _ in range(300):
                ts += 1
                r = {"id": rnd.randrange(100), "name": f"row-{rnd.randrange(10**6)}", "ts": ts}
                last[r["id"]] = r["name"]
                f.write(json.dumps(r) + "\n")
        q = ingest.upsert_stream(ingest.json_stream(spark, str(src), "id bigint, name string, ts bigint"), t, ["ts"], str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert {r.id: r.name for r in t.visible().collect()} == last
    # a batch that comes again is skipped
    version = t.meta().version
    table_prop = t.meta().properties["rowtide.batch.ingest"]
    assert table_prop == "2" and version == t.meta().version
    i = Index.create(spark, str(tmp_path / "index"), "t", 2)
    engine.process_all(t, i)
    assert {r.id: r.name for r in t.visible().collect()} == last
    assert not t.files(content="eq").count()


def test_catalog_and_supervisor(spark, tmp_path):
    root = tmp_path / "wh"
    a = Table.create(spark, str(root / "ns" / "deep" / "a"), "id bigint, name string, dept string", (), PK)
    Table.create(spark, str(root / "ns" / "plain"), "id bigint")
    os.makedirs(root / "broken" / "metadata")
    said = []
    assert [t.path for t in table_log.tables(spark, str(root), said.append)] == [a.path]
    assert len(said) == 1 and "broken" in said[0]
    a.append(rows(spark, 1, 2))
    a.write(delete_keys=keys(spark, 1))
    done = []

    class Seen(engine.Metrics):
        def run_done(self, table, run, seconds):
            done.append((run.kind, run.count))

        def idle(self, table):
            done.append("idle")

    s = engine.Supervisor(spark, engine.Settings(str(root), str(tmp_path / "ix"), 0.01, 1000, 0, workers=2), Seen(), said.append)
    s.run(sweeps=3)
    assert [d[0] for d in done[:2]] == [1, 0] and done[2] == "idle"
    assert s.sweep() == [] and [r[0] for r in seen(a)] == [2]
    a.set_properties({config.PRIMARY_KEYS: "name"})
    s._rest_until.clear()
    s.run(sweeps=1)
    assert "primary-keys" in said[-1]


def test_settings():
    env = {"ROWTIDE_ROOT": "/x", "ROWTIDE_POLL_SECONDS": "2", "ROWTIDE_WORKERS": "9", "ROWTIDE_EVERY_ENTRY": "true", "OTHER": "1", "ROWTIDE_OPTION_spark_sql_ansi_enabled": "true"}
    s = engine.Settings.from_env(env)
    assert (s.root, s.poll_seconds, s.workers, s.every_entry, s.idle_seconds) == ("/x", 2.0, 9, True, 30.0)
    assert s.options == {"spark.sql.ansi.enabled": "true"}


def test_a_slow_table_holds_up_no_other(spark, tmp_path):
    """Turns end on their own, listings are cached once a table, and a run over time is cancelled and taken up again."""
    import threading

    root, slow_began, release = tmp_path / "wh", threading.Event(), threading.Event()
    slow, fast = (Table.create(spark, str(root / n), "id bigint, name string, dept string", (), PK) for n in ("slow", "fast"))
    for k in range(2):
        fast.append(rows(spark, k))
        fast.write(delete_keys=keys(spark, k))
    slow.append(rows(spark, 1))
    done, failed = [], []

    class Seen(engine.Metrics):
        def run_done(self, table, run, seconds):
            done.append(os.path.basename(table))
            if done.count("fast") == 4:
                release.set()

        def run_failed(self, table, error):
            failed.append(os.path.basename(table))

    class Held:
        def __init__(self, index):
            self.index, self.find = index, index.find

        def append(self, r):
            slow_began.set()
            assert release.wait(120)
            return self.index.append(r)

    def index(t):
        i = Index.create(spark, str(tmp_path / "ix"), os.path.basename(t.path), 2)
        return Held(i) if t.path == slow.path else i

    persisted = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for t in (slow, fast):
        t.close()
    before = persisted()
    s = engine.Supervisor(spark, engine.Settings(str(root), poll_seconds=0.01, idle_seconds=0, retry_seconds=0, workers=2), Seen(), lambda m: None, index)
    runner = threading.Thread(target=s.run)
    runner.start()
    assert slow_began.wait(60) and release.wait(120)
    for _ in range(600):
        if "slow" in done and len(done) >= 5:
            break
        s.stop.wait(0.1)
    s.stop.set()
    runner.join(60)
    assert done.index("slow") >= 4 and not failed and persisted() == before

    class Stuck(engine.Metrics):
        def run_failed(self, table, error):
            failed.append(str(error))
            s.stop.set()

    slow.append(rows(spark, 2))
    wait_long = F.udf(lambda x: __import__("time").sleep(60) or x, "bigint")

    class Sleeps(Held):
        def append(self, r):
            return self.index.append(r.withColumn("pos", wait_long("pos")))

    s = engine.Supervisor(spark, engine.Settings(str(root), poll_seconds=0.2, idle_seconds=100, run_seconds=4, workers=2), Stuck(), lambda m: None, lambda t: Sleeps(Index.create(spark, str(tmp_path / "ix"), "slow", 2)))
    s.run()
    assert len(failed) == 1 and "cancel" in failed[0].lower()


def test_late_commits_are_detected(spark, tmp_path):
    t, i = make(spark, tmp_path)
    t.append(rows(spark, 1))
    t.append(rows(spark, 2))
    engine.process_all(t, i)
    # a file that claims a place the walk has passed
    file = t.files(content="data").limit(1)
    late = file.withColumn("path", F.concat("path", F.lit(".copy"))).drop("version")
    t.commit(t.meta(), late)
    with pytest.raises(config.LateCommit, match="the watermark is 2"):
        engine.process_next_run(t, i)


def test_incremental_step(spark, tmp_path):
    src, _ = make(spark, tmp_path)
    out = Table.create(spark, str(tmp_path / "out"), "id bigint, name string, dept string", (), PK)
    twice = lambda df: df.withColumn("name", F.upper("name"))
    src.append(rows(spark, 1, 2))
    assert table_log.process_new(spark, src, out, twice) is not None
    assert table_log.process_new(spark, src, out, twice) is None
    src.append(rows(spark, 3))
    with pytest.raises(Exception, match="boom"):
        table_log.process_new(spark, src, out, lambda df: df.withColumn("name", F.raise_error(F.lit("boom")).cast("string")))
    table_log.process_new(spark, src, out, twice)
    assert seen(out) == [(1, "A1", "eng"), (2, "A2", "eng"), (3, "A3", "eng")]


def test_incremental_step_carries_deletes(spark, tmp_path):
    src, _ = make(spark, tmp_path)
    out = Table.create(spark, str(tmp_path / "out"), "id bigint, name string, dept string", (), PK)

    def step():
        assert table_log.process_new(spark, src, out, lambda df: df.withColumn("name", F.upper("name"))) is not None
        return [r[:2] for r in seen(out)]

    # deletes that are there at the first step: a position and a later equality delete
    src.append(rows(spark, 7).coalesce(1))
    gone = src.files(content="data").first().path
    src.append(rows(spark, 1, 2, 3, 4, 4).coalesce(1))
    path = src.files(content="data").where(F.col("path") != gone).first().path
    src.write(positions=spark.createDataFrame([(path, 0)], "data_file_path string, pos bigint"), delete_keys=keys(spark, 2))
    assert step() == [(3, "A3"), (4, "A4"), (4, "A4"), (7, "A7")]
    # two versions of one key between two steps, a vector on one of two equal processed rows, a processed file removed
    src.upsert(rows(spark, 3, 5, name="b"))
    src.upsert(rows(spark, 3, name="c"))
    src.write(positions=spark.createDataFrame([(path, 3)], "data_file_path string, pos bigint"))
    src.commit(src.meta(), None, src.files().where(F.col("path") == gone).select("path", "referenced", "content"))
    assert step() == [(3, "C3"), (4, "A4"), (5, "B5")]


def test_racing_incremental_steps(spark, tmp_path):
    """Of two steps that began from one version of the sink one succeeds, the other has a Conflict and leaves nothing."""
    src, _ = make(spark, tmp_path)
    out = Table.create(spark, str(tmp_path / "out"), "id bigint, name string, dept string", (), PK)
    src.append(rows(spark, 1, 2))

    def while_another_steps(df):
        if out.meta().version == 1:
            table_log.process_new(spark, src, Table(spark, out.path), lambda x: x)
        return df

    with pytest.raises(Conflict):
        table_log.process_new(spark, src, out, while_another_steps)
    assert seen(out) == seen(src) and out.meta().version == 2


def test_scan_shuffles_no_data_rows(spark, tmp_path, monkeypatch):
    t, _ = make(spark, tmp_path)
    for k in range(4):
        t.append(rows(spark, *range(10 * k, 10 * k + 10)).coalesce(1))
    paths = [r.path for r in t.files(content="data").orderBy("path").collect()]
    t.write(positions=spark.createDataFrame([(p, n) for p in paths[:2] for n in (0, 9)], "data_file_path string, pos bigint"))
    before = seen(t)
    assert len(before) == 36
    plan = t.visible()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    # a listing over the bound is read in parts; equality deletes join
    monkeypatch.setattr(scans, "MAP_BYTES", 500)
    assert seen(t) == before
    t.write(delete_keys=keys(spark, 5, 15))
    assert seen(t) == [r for r in before if r[0] not in (5, 15)]


def test_position_deletes_that_name_no_file(spark, tmp_path):
    t, i = make(spark, tmp_path, 2)
    t.append(rows(spark, 1, 2, 3).coalesce(1))
    t.append(rows(spark, 4, 5, 6).coalesce(1))
    paths = [r.path for r in t.files(content="data").orderBy("seq").collect()]
    out = str(tmp_path / "loose")
    spark.createDataFrame([(paths[0], 1), (paths[1], 2), ("gone", 0)], "file_path string, pos bigint").coalesce(1).write.parquet(out)
    file = next(os.path.join(out, n) for n in os.listdir(out) if n.endswith("parquet"))
    entry = spark.createDataFrame([("pos", file, "parquet", 0, "", 3)], "content string, path string, format string, spec_id int, partition_key string, records bigint")
    t.commit(t.meta(), entry)
    assert [r[0] for r in seen(t)] == [1, 3, 4, 5]
    t.write(delete_keys=keys(spark, 1))
    engine.process_all(t, i)
    assert [r[0] for r in seen(t)] == [3, 4, 5]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "avro"])
def test_delete_format_and_target_size(spark, tmp_path, fmt):
    props = {**PK, config.DELETE_FORMAT: fmt, config.DELETE_TARGET: str(40 * delete_writers.POSITION_BYTES)}
    t, i = make(spark, tmp_path, 2, props=props)
    t.append(rows(spark, *range(100)).coalesce(1))
    t.write(delete_keys=keys(spark, *range(0, 100, 2)))
    before = seen(t)
    engine.process_all(t, i)
    assert seen(t) == before and [r[0] for r in before] == list(range(1, 100, 2))
    files = t.files(content="pos").collect()
    assert sorted(f.records for f in files) == [10, 40] and {f.format for f in files} == {fmt}
    if fmt == "parquet":
        return
    # merged with what is there
    t.write(delete_keys=keys(spark, 1))
    engine.process_all(t, i)
    assert [r[0] for r in seen(t)] == list(range(3, 100, 2)) and sum(f.records for f in t.files(content="pos").collect()) == 51


def test_avro_blocks_and_orc_stripes_are_split(spark, tmp_path):
    from pyarrow import orc
    import pyarrow as pa
    from pyspark.sql.types import StructType

    a, o = str(tmp_path / "f.avro"), str(tmp_path / "f.orc")
    avro_file.write(a, [("id", "long")], [(n,) for n in range(1000)], block_rows=300)
    assert [(first, n) for _, first, n in avro_file.blocks(a)] == [(0, 300), (300, 300), (600, 300), (900, 100)]
    with orc.ORCWriter(o, stripe_size=1 << 10) as w:
        for k in range(4):
            w.write(pa.table({"id": pa.array(np.random.default_rng(k).integers(0, 1 << 60, 20_000))}))
    assert orc.ORCFile(o).nstripes > 1
    for path, fmt in ((a, "avro"), (o, "orc")):
        got = scans.rows(spark, spark.createDataFrame([(path, fmt)], "path string, format string"), StructType.fromDDL("id bigint")).orderBy("pos").collect()
        want = range(1000) if fmt == "avro" else orc.read_table(path)["id"].to_pylist()
        assert [r.id for r in got] == list(want) and [r.pos for r in got] == list(range(len(want)))
    bad = str(tmp_path / "bad.avro")
    open(bad, "wb").write(open(a, "rb").read()[:-5])
    with pytest.raises(ValueError):
        list(avro_file.read(bad))
