import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rowtide.functions import bitmaps, keys
from rowtide.operators import lookup
from rowtide.plans import planner
from rowtide.plans.config import State, delete_format
from rowtide.queries import model, problems, problems_sql

SF = "/root/testdata/sf0.001"


# -- keys

FIELDS = [
    ("i", T.IntegerType(), [0, -1, 2**31 - 1, -(2**31), None]),
    ("l", T.LongType(), [0, 63, 64, -(2**63), 2**63 - 1]),
    ("s", T.StringType(), ["", "x" * 200, "ä漢", None, "0"]),
    ("b", T.BinaryType(), [b"", b"\0\xff", None, b"abc", b"z" * 64]),
    ("d", T.DateType(), [dt.date(1969, 12, 31), None, dt.date(2025, 2, 3), dt.date(1970, 1, 1), dt.date(2100, 1, 1)]),
    ("n", T.TimestampNTZType(), [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), None, dt.datetime(2025, 1, 2, 3, 4, 5, 6), dt.datetime(1970, 1, 1), dt.datetime(1971, 1, 1)]),
    ("o", T.BooleanType(), [True, False, None, True, False]),
    ("f", T.DoubleType(), [0.0, -1.5, None, 1e300, 2.0]),
    ("m", T.DecimalType(10, 2), [Decimal("0.00"), Decimal("-12345678.90"), None, Decimal("99999999.99"), Decimal("1.25")]),
]


@pytest.mark.parametrize("names", [["i"], ["l"], ["s"], ["b"], ["d"], ["n"], ["o"], ["f"], ["m"], ["i", "l", "s", "b", "d", "n", "o"], ["s", "f", "m"]])
def test_key_codec(spark, names):
    fields = [f for f in FIELDS if f[0] in names]
    schema = T.StructType([T.StructField(n, k, n != "l") for n, k, _ in fields])
    rows = list(zip(*[v for *_, v in fields]))
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("k", keys.key_hex(schema)).withColumn("back", keys.decode_udf(T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in schema.fields]))("k"))
    for row, r in zip(rows, df.collect()):
        assert r.k == keys.encode_row(row, schema).hex()
        assert keys.decode_row(bytes.fromhex(r.k), schema) == row
        got = tuple(bytes(v) if isinstance(v, bytearray) else v for v in r.back)
        assert got == row
    assert df.select("k").distinct().count() == len(set(rows))


def test_known_keys(spark):
    # required string, and optional string in a union
    assert keys.encode_row(["R062151"], T.StructType([T.StructField("x", T.StringType(), False)])).hex() == "0e52303632313531"
    assert keys.encode_row(["central"], T.StructType([T.StructField("x", T.StringType())])).hex() == "020e63656e7472616c"
    assert spark.range(1).select(keys.key_hex(T.StructType([]))).first()[0] == ""


def test_bad_keys(spark):
    s = T.StructType([T.StructField("x", T.LongType())])
    for bad in (b"", b"\2", b"\2\x80", b"\0\0"):
        with pytest.raises((ValueError, IndexError)):
            keys.decode_row(bad, s)
    with pytest.raises(ValueError):
        keys.encode_row([None], T.StructType([T.StructField("x", T.LongType(), False)]))
    for kind in (T.ArrayType(T.LongType()), T.MapType(T.LongType(), T.LongType()), T.DayTimeIntervalType()):
        with pytest.raises(TypeError):
            keys.key_hex(T.StructType([T.StructField("x", kind)]))
    for bad in ("abc", "zz", "0 "):
        with pytest.raises(Exception, match="not hex"):
            spark.createDataFrame([(bad,)], "h string").select(keys.from_hex("h")).collect()
    got = spark.createDataFrame([("00fF",), (None,), ("",)], "h string").select(keys.from_hex("h").alias("b")).select(keys.to_hex("b")).collect()
    assert [r[0] for r in got] == ["00ff", None, ""]


def test_names():
    assert keys.comma_list(" a, b ,,c ") == ["a", "b", "c"] and keys.comma_list(None) == []
    assert keys.identifier_text("a.b-c d") == "a_b_c_d"
    assert keys.setting_name("ROWTIDE_INDEX_ROOT", "ROWTIDE_") == "index.root"
    assert delete_format({}) == "parquet" and delete_format({"write.format.default": "orc"}) == "orc"


def test_bucket_is_that_of_bucketed_tables(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("pk")).write.bucketBy(4, "pk").option("path", str(tmp_path / "b")).saveAsTable("bucket_check")
    df = spark.table("bucket_check").select(keys.bucket("pk", 4).alias("b"), F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{5})\.c", 1).cast("int").alias("f"))
    assert df.where("b <> f").count() == 0


# -- bitmaps


def test_position_sets(spark):
    rows = [(f, p) for f in ("a", "b") for p in (0, 1, 1, 32766, 32767, 32768, 70_000)] + [("a", None), ("a", -1), (None, 5)]
    df = spark.createDataFrame(rows, "f string, pos bigint")
    s = bitmaps.position_sets(df, ["f"])
    assert {r.f: r.positions for r in bitmaps.cardinality(s, ["f"]).collect()} == {"a": 6, "b": 6, None: 1}
    more = bitmaps.position_sets(spark.createDataFrame([("a", 0), ("a", 2)], "f string, pos bigint"), ["f"])
    assert {r.f: r.positions for r in bitmaps.cardinality(bitmaps.union_sets(s.unionByName(more), ["f"]), ["f"]).collect()}["a"] == 7


# -- planning


def test_runs_and_next_run(spark):
    rnd = random.Random(7)
    files = [(rnd.choice([1, 2]), rnd.randrange(1, 15), rnd.choice([0, 1]), f"f{i}") for i in range(60)] + [(1, None, 1, "n")]
    df = spark.createDataFrame(files, "t int, seq bigint, kind int, path string")
    got = {(r.t, r.run_id): (r.kind, r.min_seq, r.max_seq, r.files, r.previous_max) for r in planner.runs(df, ["t"]).collect()}
    want = {}
    for t in (1, 2):
        run, kind, prev = 0, None, None
        for s, k, _ in sorted((s, k, p) for a, s, k, p in files if a == t and s is not None):
            if k != kind:
                prev = want[t, run][2] if run else None
                run, kind = run + 1, k
                want[t, run] = (k, s, s, 0, prev)
            o = want[t, run]
            want[t, run] = (k, o[1], s, o[3] + 1, o[4])
    assert got == want
    one = df.where("t = 1")
    state = State()
    seen = []
    while part := planner.next_run(one, state).collect():
        assert len({r.kind for r in part}) == 1
        seen += [r.path for r in part]
        state = max(State(r.seq, r.kind) for r in part)
    assert sorted(seen) == sorted(p for a, s, k, p in files if a == 1 and s is not None)
    assert planner.runs(df.limit(0), ["t"]).count() == 0


def test_convertible(spark):
    rows = [("EQUALITY_DELETES", [2, 1], [1, 2], True, True, True), ("EQUALITY_DELETES", [1], [1, 2], True, True, False), ("EQUALITY_DELETES", [1], [1], False, True, False), ("POSITION_DELETES", [1], [1], True, True, False)]
    df = spark.createDataFrame(rows, "c string, a array<int>, b array<int>, p boolean, q boolean, want boolean")
    assert df.where(planner.convertible(F.col("c"), F.col("a"), F.col("b"), F.col("p"), F.col("q")) != F.col("want")).count() == 0


# -- joins


def test_lookups_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, 4, None]), i) for i in range(60)]
    dels = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None])) for _ in range(4)]
    r = spark.createDataFrame(rows, "k string, seq int, id int")
    d = spark.createDataFrame(dels, "k string, seq int").withColumn("id", F.lit(0))
    dead = {i for k, s, i in rows if any(a == k and b is not None and s is not None and b > s for a, b in dels)}
    assert {x.id for x in lookup.deleted(r, d, ["k"], "seq").collect()} == dead
    assert {x.id for x in lookup.visible(r, d, ["k"], "seq").collect()} == {i for *_, i in rows} - dead
    assert lookup.visible(r, d.limit(0), ["k"], "seq").count() == 60
    want = {}
    for k, s in set(dels):
        past = [b for a, b, _ in rows if a == k and None not in (b, s) and b < s]
        if past:
            want[k, s] = (max(past), len(past))
    got = {(x.k, x.seq): (x.last_seq, x.matches) for x in lookup.as_of(d, r, ["k"], "seq").where("seq is not null").collect()}
    got = {k: v for k, v in got.items()}
    nulls = {k: sum(1 for a, b, _ in rows if a == k and b is None) for k in ("a", "b", None)}
    assert {k: (v[0], v[1] - nulls[k[0]]) for k, v in got.items() if v[0] is not None} == want


def test_latest_breaks_ties_by_the_rest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (None, 1, "x"), (1, 4, "z")], "k int, o int, v string")
    assert sorted(map(tuple, lookup.latest(df, ["k"], ["o"]).collect()), key=str) == sorted([(1, 5, "b"), (None, 1, "x")], key=str)


def test_same_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "i int, s string")
    assert lookup.same_rows(a, a.select("s", "i")) and not lookup.same_rows(a, a.distinct())


# -- every query against its SQL


SLOW = {"conversion_v2", "conversion_v3", "stream_ingest", "stream_json", "p1_incremental", "converted_snapshots", "resumed_conversion", "refused_commit"}


@pytest.mark.parametrize("name", sorted((set(model.SQL) | set(problems_sql.SQL)) - SLOW))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    every, sql = {**model.QUERIES, **problems.QUERIES}, {**model.SQL, **problems_sql.SQL}
    assert spark_rows(every[name](spark, SF)) == duck_rows(connect(SF), sql[name])


def test_plans(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(problems.QUERIES["p5_found"](spark, SF))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    # one exchange by key serves the windows and the sum of the signs
    assert found.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<table_id:bigint,op:string" in found and "arrived_at" not in found
    swept = plan(model.QUERIES["lookup_d100"](spark, SF))
    assert "PushedFilters: [In(o_orderkey" in swept and "Exchange hashpartitioning" not in swept
    assert "BroadcastHashJoin" in plan(model.QUERIES["lookup_d1000"](spark, SF))
    for name in ("p1_found", "p3_found", "p4_found", "visible", "run_window_deletes"):
        assert "CartesianProduct" not in plan({**model.QUERIES, **problems.QUERIES}[name](spark, SF))


def changed(spark, tmp_path, name, df):
    """The test tables with another one of this name."""
    for n in os.listdir(SF):
        if n != f"{name}.parquet":
            os.symlink(f"{SF}/{n}", tmp_path / n)
    df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_null_pk_is_an_orphan(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    e = spark.read.parquet(f"{SF}/eq_delete_rows.parquet")
    d = changed(spark, tmp_path, "eq_delete_rows", e.unionByName(e.limit(1).withColumn("row_id", F.lit(-1).cast("bigint")).withColumn("pk", F.lit(None).cast("string"))))
    got = spark_rows(problems.p4_found(spark, d))
    assert ("eq_delete_rows.pk", "-1", "None") in got[1]
    assert got == duck_rows(connect(d), problems_sql.SQL["p4_found"])


def test_conversion_keeps_events_without_time(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    e = spark.read.parquet(f"{SF}/events.parquet").limit(6)
    d = changed(spark, tmp_path, "events", e.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts"))))
    assert spark_rows(model.QUERIES["conversion_v3"](spark, d)) == duck_rows(connect(d), model.SQL["conversion_v3"])
