"""Queries of the merge-on-read operators over the test tables, with their SQL twins.

``events`` is an upsert log: key user_id, partition event_type, one commit a day, one data file for each
partition and commit. The tables of the indexing service are walked as they are.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions import bitmaps, canon, keys
from rowtide.operators import cdc, lookup, manifest_diff, ordered
from rowtide.plans import config, planner, runs
from rowtide.plans.config import State
from rowtide.queries import problems
from rowtide.queries.common import table
from rowtide.queries.problems_sql import hex_, path, pkey, up
from rowtide.session import cut, shared_dir
from rowtide.sources import scans
from rowtide.sources.index_store import Index
from rowtide.sources.scans import local
from rowtide.sources.table_log import Conflict, Table
from rowtide.streaming import engine, ingest

KEY = ["event_type", "user_id"]
POSITION = ["data_file_path", "pos"]

QUERIES: dict = {}
SQL: dict[str, str] = {}

D = """
WITH d AS (SELECT event_id, event_type, user_id, CAST(day(ts) AS BIGINT) AS seq, concat('data/', event_type, '/', CAST(day(ts) AS VARCHAR)) AS data_file_path,
   CAST(row_number() OVER (PARTITION BY event_type, day(ts) ORDER BY event_id) - 1 AS BIGINT) AS pos FROM events),
eq AS (SELECT DISTINCT event_type, user_id, seq FROM d),
idx AS (SELECT event_type, user_id, seq, data_file_path, pos FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, seq ORDER BY pos DESC) AS rn FROM d) WHERE rn = 1),
pd AS (SELECT d.data_file_path, d.pos FROM d JOIN idx i ON d.event_type = i.event_type AND d.user_id = i.user_id AND d.seq = i.seq WHERE d.pos < i.pos),
conv AS (SELECT i.data_file_path, i.pos FROM idx i WHERE EXISTS (SELECT 1 FROM eq WHERE eq.event_type = i.event_type AND eq.user_id = i.user_id AND eq.seq > i.seq)),
walk AS (SELECT DISTINCT seq, 1 AS kind, data_file_path AS path FROM d WHERE seq % 3 = 1 UNION ALL SELECT DISTINCT seq, 0 AS kind, concat('eq/', event_type) AS path FROM d WHERE seq % 3 <> 1)
"""


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the upsert log with the file and position they are at."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.day("ts").cast("bigint").alias("seq"))
    placed = ordered.row_positions(e, ["event_type", "seq"], "event_id")
    return placed.withColumn("data_file_path", F.concat(F.lit("data/"), "event_type", F.lit("/"), F.col("seq").cast("string")))


def eq_deletes(rows: DataFrame) -> DataFrame:
    """A delete of each key in every commit that writes it."""
    return rows.select(*KEY, "seq").distinct()


def entries(rows: DataFrame) -> DataFrame:
    """Index entries: the last row of a key in each commit."""
    return lookup.latest(rows.select(*KEY, "seq", "pos", "data_file_path"), [*KEY, "seq"], ["pos"])


def replaced(rows: DataFrame) -> DataFrame:
    """Positions that a later row of the same key and commit replaces."""
    return rows.join(entries(rows).withColumnRenamed("pos", "last"), [*KEY, "seq", "data_file_path"]).where("pos < last").select(*POSITION)


def walk(rows: DataFrame) -> DataFrame:
    files = rows.select("event_type", "seq", "data_file_path").distinct()
    a = files.where("seq % 3 = 1").select("seq", F.lit(1).alias("kind"), F.col("data_file_path").alias("path")).distinct()
    return a.unionByName(files.where("seq % 3 <> 1").select("seq", F.lit(0).alias("kind"), F.concat(F.lit("eq/"), "event_type").alias("path")).distinct())


@query(D + "SELECT d.data_file_path, d.pos FROM d WHERE EXISTS (SELECT 1 FROM eq WHERE eq.event_type = d.event_type AND eq.user_id = d.user_id AND eq.seq > d.seq)")
def eq_positions(spark, d):
    r = log(spark, d)
    return lookup.deleted(r, eq_deletes(r), KEY, "seq").select(*POSITION)


@query(D + "SELECT event_id, event_type, user_id FROM d WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.event_type = d.event_type AND eq.user_id = d.user_id AND eq.seq > d.seq)")
def visible(spark, d):
    r = log(spark, d)
    return lookup.visible(r, eq_deletes(r), KEY, "seq").select("event_id", *KEY)


@query(D + "SELECT event_type, user_id, seq, data_file_path, pos FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY seq DESC, pos DESC) AS rn FROM idx) WHERE rn = 1")
def index_final(spark, d):
    return lookup.latest(entries(log(spark, d)), KEY, ["seq", "pos"])


@query(D + "SELECT i.* FROM idx i WHERE EXISTS (SELECT 1 FROM eq WHERE eq.event_type = i.event_type AND eq.user_id = i.user_id AND eq.seq > i.seq)")
def indexed_deleted(spark, d):
    r = log(spark, d)
    return lookup.deleted(entries(r), eq_deletes(r), KEY, "seq").select(*KEY, "seq", *POSITION)


@query(D + "SELECT e.event_type, e.user_id, e.seq, max(i.seq) AS last_seq, count(*) AS matches FROM eq e JOIN idx i ON i.event_type = e.event_type AND i.user_id = e.user_id AND i.seq < e.seq GROUP BY 1, 2, 3")
def asof(spark, d):
    r = log(spark, d)
    return lookup.as_of(eq_deletes(r), entries(r), KEY, "seq")


@query(D + "SELECT event_id, event_type, user_id FROM d WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM pd UNION SELECT * FROM conv) x WHERE x.data_file_path = d.data_file_path AND x.pos = d.pos)")
def visible_upsert(spark, d):
    r = log(spark, d)
    converted = lookup.deleted(entries(r), eq_deletes(r), KEY, "seq").select(*POSITION)
    return lookup.without(r, replaced(r).unionByName(converted)).select("event_id", *KEY)


@query(D + "SELECT data_file_path, count(*) AS positions FROM (SELECT * FROM pd UNION SELECT * FROM conv) GROUP BY 1")
def dv_merge_existing(spark, d):
    r = log(spark, d)
    old = bitmaps.position_sets(replaced(r), ["data_file_path"])
    new = bitmaps.position_sets(lookup.deleted(entries(r), eq_deletes(r), KEY, "seq").select(*POSITION), ["data_file_path"])
    return bitmaps.cardinality(bitmaps.union_sets(old.unionByName(new), ["data_file_path"]), ["data_file_path"])


@query(
    D
    + """, runs AS (SELECT seq, kind, path, SUM(chg) OVER (ORDER BY seq, kind, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
 FROM (SELECT *, CASE WHEN lag(kind) OVER (ORDER BY seq, kind, path) = kind THEN 0 ELSE 1 END AS chg FROM walk))
SELECT CAST(run_id AS BIGINT) AS run_id, kind, max(seq) AS max_seq, count(*) AS files FROM runs GROUP BY 1, 2"""
)
def group_runs(spark, d):
    return planner.runs(walk(log(spark, d))).select("run_id", "kind", "max_seq", "files")


@query(D + "SELECT * FROM walk WHERE seq > 10 OR (seq = 10 AND kind > 0)")
def resume_from_state(spark, d):
    return walk(log(spark, d)).where(planner.after(State(10, 0)))


@query(
    D
    + """SELECT e.event_type, e.user_id, e.seq, i.data_file_path, i.pos FROM eq e JOIN idx i ON i.event_type = e.event_type AND i.user_id = e.user_id AND i.seq < e.seq
 AND CASE WHEN i.seq <= 15 THEN 0 ELSE 1 END = CASE WHEN e.seq <= 15 THEN 0 ELSE 1 END"""
)
def spec_scoped_lookup(spark, d):
    """Every hit of every delete, by its commit: the join's output is the result, so it cannot be smaller."""
    r = log(spark, d)
    e = eq_deletes(r).withColumn("spec_id", lookup.spec_of("seq", 15))
    i = entries(r).withColumn("spec_id", lookup.spec_of("seq", 15)).withColumnRenamed("seq", "entry_seq")
    return e.join(i, [*KEY, "spec_id"]).where("entry_seq < seq").select(*KEY, "seq", *POSITION)


_LWW = "l_shipdate, l_partkey, l_suppkey, l_extendedprice"


@query(f"SELECT l_orderkey, l_linenumber, {_LWW} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LWW.split(', '))}) AS rn FROM lineitem) WHERE rn = 1")
def composite_key_lww(spark, d):
    order = _LWW.split(", ")
    return lookup.latest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *order), ["l_orderkey", "l_linenumber"], order)


@query("SELECT event_id, lower(hex(event_type)) AS k FROM events")
def hex_key(spark, d):
    return table(spark, d, "events").select("event_id", keys.to_hex("event_type").alias("k"))


@query("SELECT event_id, event_type AS k FROM events")
def hex_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", keys.from_hex(keys.to_hex("event_type")).cast("string").alias("k"))


def _sql_byte(x: str) -> str:
    return f"lpad(lower(printf('%x', {x})), 2, '0')"


_Z = "(user_id * 2)"
_VARINT = f"CASE WHEN {_Z} < 128 THEN {_sql_byte(_Z)} WHEN {_Z} < 16384 THEN {_sql_byte(f'({_Z} % 128 + 128)')} || {_sql_byte(f'{_Z} // 128')} ELSE {_sql_byte(f'({_Z} % 128 + 128)')} || {_sql_byte(f'({_Z} // 128 % 128 + 128)')} || {_sql_byte(f'{_Z} // 16384')} END"


@query(f"SELECT event_id, '02' || {_sql_byte('2 * strlen(event_type)')} || lower(hex(event_type)) || {_VARINT} AS pk FROM events")
def avro_key(spark, d):
    """Avro binary of (event_type optional, user_id required) in hex."""
    s = T.StructType([T.StructField("event_type", T.StringType(), True), T.StructField("user_id", T.LongType(), False)])
    return table(spark, d, "events").select("event_id", keys.key_hex(s).alias("pk"))


@query("SELECT event_id, event_type, user_id FROM events")
def avro_roundtrip(spark, d):
    s = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType())])
    e = table(spark, d, "events").select("event_id", keys.key_hex(s).alias("pk"))
    return e.select("event_id", keys.decode_udf(s)("pk").alias("k")).select("event_id", "k.*")


# -- the service's own tables

_PK_IDS = "pk AS (SELECT table_id, max(list_sort(list_distinct(pk_field_ids))) AS ids FROM ice_tables GROUP BY 1)"


@query(
    f"""WITH {_PK_IDS}, f AS (SELECT file_id, max(table_id) AS table_id, max({up('content')}) AS content, max({up('file_format')}) AS fmt, max(list_sort(list_distinct(equality_ids))) AS ids, max({path('referenced_data_file')}) AS ref, max(removed_at) AS gone FROM delete_files GROUP BY 1)
SELECT file_id, CASE WHEN content = 'EQUALITY_DELETES' THEN CASE WHEN f.ids = pk.ids THEN 'convertible' ELSE 'unconvertible' END WHEN fmt = 'PUFFIN' THEN 'vector' WHEN ref IS NOT NULL THEN 'file_scoped' ELSE 'partition_scoped' END AS class
FROM f LEFT JOIN pk USING (table_id) WHERE gone IS NULL"""
)
def classify_deletes(spark, d):
    """Live delete files by what the planner does with them."""
    f = table(spark, d, "delete_files").groupBy("file_id").agg(
        F.max("table_id").alias("table_id"), F.max(canon.label("content")).alias("content"), F.max(canon.label("file_format")).alias("fmt"),
        F.max(canon.id_set("equality_ids")).alias("ids"), F.max(canon.file_path("referenced_data_file")).alias("ref"), F.max("removed_at").alias("gone"),
    )
    pk = table(spark, d, "ice_tables").groupBy("table_id").agg(F.max(canon.id_set("pk_field_ids")).alias("key_ids"))
    ok = planner.convertible(F.col("content"), F.col("ids"), F.col("key_ids"), F.lit(True), F.lit(True))
    eq = F.when(F.coalesce(ok, F.lit(False)), "convertible").otherwise("unconvertible")
    what = F.when(F.col("content") == "EQUALITY_DELETES", eq).when(F.col("fmt") == "PUFFIN", "vector").when(F.col("ref").isNotNull(), "file_scoped").otherwise("partition_scoped")
    return f.where("gone is null").join(pk, "table_id", "left").select("file_id", what.alias("class"))


@query(
    f"""WITH {_PK_IDS}, f AS (SELECT file_id, max(table_id) AS table_id, max(list_sort(list_distinct(equality_ids))) AS ids, max(data_sequence_number) AS seq, max(removed_at) AS gone FROM delete_files WHERE {up('content')} = 'EQUALITY_DELETES' GROUP BY 1)
SELECT file_id, f.table_id, seq FROM f JOIN pk ON pk.table_id = f.table_id AND pk.ids = f.ids WHERE gone IS NULL"""
)
def convertible_filter(spark, d):
    m = manifest_diff.convertible(table(spark, d, "delete_files"), table(spark, d, "ice_tables"))
    return m.where("removed_at is null").select("file_id", "table_id", F.col("data_sequence_number").alias("seq"))


def service_walk(spark: SparkSession, d: str) -> DataFrame:
    """Live walkable files of all tables: file_id, table_id, path, seq, kind."""
    data = manifest_diff.data_manifest(table(spark, d, "data_files"))
    eq = manifest_diff.convertible(table(spark, d, "delete_files"), table(spark, d, "ice_tables")).select(*data.columns)
    live = data.unionByName(eq).where("removed_at is null")
    return live.select("file_id", "table_id", "path", F.col("data_sequence_number").alias("seq"), "kind")


_WALK = f"""WITH {_PK_IDS}, w AS (SELECT file_id, max(table_id) AS table_id, max({path('data_file_path')}) AS path, max(data_sequence_number) AS seq, 1 AS kind FROM data_files GROUP BY 1 HAVING max(removed_at) IS NULL
 UNION ALL SELECT f.file_id, f.table_id, f.path, f.seq, 0 FROM (SELECT file_id, max(table_id) AS table_id, max({path('file_path')}) AS path, max(list_sort(list_distinct(equality_ids))) AS ids, max(data_sequence_number) AS seq FROM delete_files WHERE {up('content')} = 'EQUALITY_DELETES' GROUP BY 1 HAVING max(removed_at) IS NULL) f JOIN pk ON pk.table_id = f.table_id AND pk.ids = f.ids),
n AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY table_id ORDER BY seq, kind, file_id) = kind THEN 0 ELSE 1 END AS chg FROM w),
r AS (SELECT *, CAST(SUM(chg) OVER (PARTITION BY table_id ORDER BY seq, kind, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_id FROM n),
runs AS (SELECT table_id, run_id, max(kind) AS kind, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS files FROM r GROUP BY 1, 2)
"""


@query(_WALK + "SELECT *, lag(max_seq) OVER (PARTITION BY table_id ORDER BY run_id) AS previous_max FROM runs")
def walk_runs(spark, d):
    return planner.runs(service_walk(spark, d), ["table_id"])


@query(_WALK + "SELECT table_id, kind, max_seq, files FROM runs WHERE run_id = 1")
def first_runs(spark, d):
    return planner.runs(service_walk(spark, d), ["table_id"]).where("run_id = 1").select("table_id", "kind", "max_seq", "files")


_POS = f"""p AS (SELECT file_id, max(table_id) AS table_id, max({path('referenced_data_file')}) AS path, max(data_sequence_number) AS seq, max(record_count) AS n FROM delete_files WHERE {up('content')} = 'POSITION_DELETES' GROUP BY 1 HAVING max(removed_at) IS NULL)"""


def _positions(spark, d) -> DataFrame:
    f = table(spark, d, "delete_files").where(canon.label("content") == "POSITION_DELETES").groupBy("file_id").agg(
        F.max("table_id").alias("table_id"), F.max(canon.file_path("referenced_data_file")).alias("path"), F.max("data_sequence_number").alias("seq"), F.max("record_count").alias("n"), F.max("removed_at").alias("gone"),
    )
    return f.where("gone is null").drop("gone")


@query(
    _WALK
    + f""", {_POS}, files AS (SELECT r.table_id, r.run_id, r.path, m.max_seq FROM r JOIN runs m ON m.table_id = r.table_id AND m.run_id = r.run_id WHERE r.kind = 1)
SELECT f.table_id, f.run_id, p.file_id AS delete_file_id FROM files f JOIN p ON p.table_id = f.table_id AND p.path = f.path WHERE p.seq <= f.max_seq"""
)
def run_window_deletes(spark, d):
    """The position deletes and vectors that apply to the files of each DATA run."""
    w = service_walk(spark, d)
    r = planner.runs(w, ["table_id"]).where("kind = 1")
    # a file's run is the first that ends at or after it: runs of a table do not overlap
    hit = ordered.next_bound(w.where("kind = 1"), r.select("table_id", F.col("max_seq").alias("seq"), "run_id"), ["table_id"], "seq", ["run_id"])
    files = w.where("kind = 1").join(hit, ["table_id", "seq"]).select("table_id", "path", "run_id", F.col("bound_seq").alias("max_seq"))
    p = _positions(spark, d).select("table_id", F.col("path").alias("referenced"), "seq", F.col("file_id").alias("delete_file_id"))
    return planner.run_deletes(files, p, ["table_id"], ["run_id"]).select("table_id", "run_id", "delete_file_id")


@query(
    f"SELECT table_id, path AS data_file_path, count(*) AS delete_files, CAST(sum(n) AS BIGINT) AS records FROM (WITH {_POS} SELECT * FROM p) WHERE path IS NOT NULL GROUP BY 1, 2"
)
def deletes_by_file(spark, d):
    return _positions(spark, d).where("path is not null").groupBy("table_id", F.col("path").alias("data_file_path")).agg(F.count(F.lit(1)).alias("delete_files"), F.sum("n").alias("records"))


@query(f"SELECT DISTINCT table_id, spec_id, {pkey()} AS partition_key FROM eq_delete_rows")
def touched_partitions(spark, d):
    return table(spark, d, "eq_delete_rows").select("table_id", "spec_id", canon.partition_key("partition_key").alias("partition_key")).distinct()


@query(
    f"""WITH t AS (SELECT DISTINCT table_id, spec_id, {pkey()} AS partition_key FROM eq_delete_rows),
v AS (SELECT table_id, max(format_version) AS v FROM ice_tables GROUP BY 1),
f AS (SELECT file_id, max(table_id) AS table_id, max(spec_id) AS spec_id, max({pkey()}) AS partition_key, max({up('content')}) AS content, max({up('file_format')}) AS fmt, max({path('referenced_data_file')}) AS ref FROM delete_files GROUP BY 1 HAVING max(removed_at) IS NULL)
SELECT f.file_id, f.ref AS data_file_path FROM f JOIN v USING (table_id) JOIN t ON t.table_id = f.table_id AND t.spec_id = f.spec_id AND t.partition_key = f.partition_key
WHERE content = 'POSITION_DELETES' AND ref IS NOT NULL AND ((v = 3 AND fmt = 'PUFFIN') OR (v = 2 AND fmt <> 'PUFFIN'))"""
)
def existing_deletes(spark, d):
    """Per-file deletes that a conversion of all touched partitions has to merge."""
    f = table(spark, d, "delete_files").groupBy("file_id").agg(
        F.max("table_id").alias("table_id"), F.max("spec_id").alias("spec_id"), F.max(canon.partition_key("partition_key")).alias("partition_key"), F.max(canon.label("content")).alias("c"),
        F.max(canon.label("file_format")).alias("fmt"), F.max(canon.file_path("referenced_data_file")).alias("referenced"), F.max("removed_at").alias("gone"),
    ).where("gone is null and c = 'POSITION_DELETES'").withColumn("content", F.when(F.col("fmt") == "PUFFIN", "dv").otherwise("pos"))
    v = table(spark, d, "ice_tables").groupBy("table_id").agg(F.max("format_version").alias("v"))
    f = f.join(v, "table_id")
    t = touched_partitions(spark, d)
    columns = ["table_id", "spec_id", "partition_key"]
    kept = [planner.existing_deletes(planner.touched(t, f.where(F.col("v") == n), columns), t, n) for n in (2, 3)]
    return kept[0].unionByName(kept[1]).select("file_id", F.col("referenced").alias("data_file_path"))


@query(f"SELECT DISTINCT table_id, {path('x')} AS path FROM (SELECT table_id, unnest(eq_deletes_to_remove) AS x FROM commit_plans) WHERE x IS NOT NULL")
def rewritten_dedupe(spark, d):
    """Files that plans remove, each location once."""
    p = table(spark, d, "commit_plans").select("table_id", F.explode("eq_deletes_to_remove").alias("x")).where("x is not null")
    return p.select("table_id", canon.file_path("x").alias("path")).dropDuplicates(["table_id", "path"])


@query(
    f"""WITH s AS (SELECT table_id, spec_id, {pkey()} AS partition_key, {hex_('pk')} AS pk, {path('data_file_path')} AS data_file_path, pos,
  CASE WHEN {up('op')} IN ('+I', '+U', 'INSERT', 'UPDATE_AFTER') THEN 1 ELSE 0 END AS live, sequence_number AS q, CASE WHEN {up('file_kind')} = 'DATA' THEN 1 ELSE 0 END AS k, ordinal FROM index_changes),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id, spec_id, partition_key, pk ORDER BY q DESC, k DESC, ordinal DESC, live DESC, data_file_path DESC, pos DESC) AS rn FROM s),
i AS (SELECT * FROM r WHERE rn = 1 AND live = 1), e AS (SELECT DISTINCT table_id, spec_id, {pkey()} AS partition_key, {hex_('pk')} AS pk FROM eq_delete_rows)
SELECT i.table_id, i.spec_id, i.partition_key, i.pk, i.data_file_path, i.pos FROM i JOIN e ON e.table_id = i.table_id AND e.spec_id = i.spec_id AND e.partition_key = i.partition_key AND e.pk = i.pk"""
)
def eq_lookup(spark, d):
    """Equality-delete rows looked up in the index that all changes leave."""
    e = table(spark, d, "eq_delete_rows").select("table_id", "spec_id", canon.partition_key("partition_key").alias("partition_key"), canon.hex_key("pk").alias("pk"))
    return lookup.lookup(e, problems.p5_found(spark, d), problems.KEY, "pk")


@query(f"SELECT table_id, {path('data_file_path')} AS data_file_path, count(DISTINCT pos) AS positions FROM index_changes WHERE data_file_path IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2")
def position_bitmaps(spark, d):
    c = table(spark, d, "index_changes").where("data_file_path is not null").select("table_id", canon.file_path("data_file_path").alias("data_file_path"), "pos")
    by = ["table_id", "data_file_path"]
    return bitmaps.cardinality(bitmaps.position_sets(c, by), by)


@query(
    f"""WITH u AS (SELECT unit_id, table_id, kind, max_seq, {up('status')} AS s, row_number() OVER (PARTITION BY unit_id ORDER BY logged_at DESC NULLS LAST, attempt DESC NULLS LAST, {up('status')} DESC) AS rn FROM work_units)
SELECT table_id, max(max_seq * 2 + CASE WHEN {up('kind')} = 'DATA' THEN 1 ELSE 0 END) // 2 AS seq, max(max_seq * 2 + CASE WHEN {up('kind')} = 'DATA' THEN 1 ELSE 0 END) % 2 AS kind FROM u WHERE rn = 1 AND s = 'COMMITTED' GROUP BY 1"""
)
def watermarks(spark, d):
    """How far each table's successful runs have come."""
    u = manifest_diff.successful_units(table(spark, d, "work_units"), table(spark, d, "snapshots"))
    g = u.groupBy("table_id").agg(F.max("walk").alias("w"))
    return g.select("table_id", F.expr("w div 2").alias("seq"), F.expr("w % 2").alias("kind"))


@query("SELECT table_id, table_name, regexp_replace(table_name, '[^a-zA-Z0-9_]', '_', 'g') AS index_name, array_to_string([trim(x) for x in string_split(primary_keys, ',') if trim(x) <> ''], ',') AS key_columns, coalesce(index_buckets, 1) AS buckets FROM ice_tables WHERE trim(primary_keys) <> ''")
def catalog_scan(spark, d):
    """Tables that opt in, with their index names and parsed properties: made in a folder of their own and found by the scan of the catalog."""
    from rowtide.sources import table_log

    root = _folder(spark)
    for r in table(spark, d, "ice_tables").collect():
        props = {"name": r.table_name, config.PRIMARY_KEYS: r.primary_keys, config.INDEX_BUCKETS: None if r.index_buckets is None else str(r.index_buckets)}
        table_log.Table.create(spark, f"{root}/{r.table_id % 3}/{r.table_id}", "id bigint", (), {k: v for k, v in props.items() if v and v.strip()})
    found = []
    for t in table_log.tables(spark, root):
        props = t.meta().properties
        conf = config.TableConfig.of(props)
        found.append((int(t.path.rpartition("/")[2]), props["name"], keys.identifier_text(props["name"]), ",".join(conf.primary_keys), conf.buckets))
    return spark.createDataFrame(found, "table_id bigint, table_name string, index_name string, key_columns string, buckets int")


@query("SELECT table_id, operation, count(DISTINCT snapshot_id) AS snapshots, max(sequence_number) AS last_seq FROM snapshots GROUP BY 1, 2")
def snapshot_counts(spark, d):
    once = table(spark, d, "snapshots").groupBy("table_id", "operation", "snapshot_id").agg(F.max("sequence_number").alias("s"))
    return once.groupBy("table_id", "operation").agg(F.count(F.lit(1)).alias("snapshots"), F.max("s").alias("last_seq"))


@query("SELECT user_id, count(*) AS rows, CAST(1 AS BIGINT) AS buckets, true AS in_range FROM events GROUP BY 1")
def key_buckets(spark, d):
    """Every key is in one bucket of 16. Which one is the hash's business, which SQL does not have."""
    b = table(spark, d, "events").select("user_id", keys.bucket(F.col("user_id").cast("string"), 16).alias("b"))
    fine = b.groupBy("user_id", "b").agg(F.count(F.lit(1)).alias("n"))
    return fine.groupBy("user_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("buckets"), F.min(F.col("b").between(0, 15)).alias("in_range"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def unique_lines(spark, d):
    """Rows whose key no other row has: both except directions of a row-set comparison come down to counts."""
    l = table(spark, d, "lineitem")  # noqa: E741
    g = l.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("l_quantity"))
    return g.where("n = 1").drop("n")


@query("SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def rowset_difference(spark, d):
    o = table(spark, d, "orders")
    return lookup.row_difference(o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"))


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o WHERE o_orderstatus <> 'F'")
def position_filter(spark, d):
    """A scan with the reader's own row positions, less the positions of a delete set."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("_metadata.file_path").alias("data_file_path"), F.col("_metadata.row_index").alias("pos"))
    dead = o.where("o_orderstatus = 'F'").select(*POSITION)
    return lookup.without(o, dead).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


def _sweep(n: int, how: str):
    def f(spark, d):
        o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("pos"))
        probe = o.where(F.col("pk") < n).select("pk")
        return lookup.lookup(probe, o, ["pk"], "pk", how)

    return f


# as measured, and each way by itself
for _n, _how in ((1, None), (100, None), (1_000, None), (10_000, None), (100_000, None), (500, "in"), (5_000, "broadcast"), (50_000, "merge")):
    _name = f"lookup_{_how}" if _how else f"lookup_d{_n}"
    QUERIES[_name] = _sweep(_n, _how)
    SQL[_name] = f"SELECT o_orderkey AS pk, o_custkey AS pos FROM orders WHERE o_orderkey < {_n}"


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def cdc_latest(spark, d):
    """The events as a change feed of +I and +U on user_id, applied by the signed multiset."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.lit(True).alias("live"), "event_id", "event_type")
    return cdc.apply_changes(e, ["user_id"], ["seq"], "live", ["event_id", "event_type"])


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    folder = os.path.join(local(shared_dir(spark)), f"rowtide-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _upserts(spark: SparkSession, d: str, root: str, version: int = 3) -> tuple[Table, list[DataFrame]]:
    """A table for the events, and its rows in three parts by day."""
    props = {config.PRIMARY_KEYS: "user_id", config.INDEX_BUCKETS: "8"}
    t = Table.create(spark, f"{root}/t", "event_id bigint, user_id bigint, event_type string", ["event_type"], props, version)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.coalesce(F.day("ts"), F.lit(1)).alias("_day"))
    return t, [e.where(F.col("_day").between(low, high)).drop("_day") for low, high in ((1, 10), (11, 20), (21, 31))]


def _converted(spark: SparkSession, d: str, version: int, stream: Callable[[str], DataFrame] | None = None) -> Table:
    """The events as upserts into a table of their own in the shared folder, converted."""
    root = _folder(spark)
    t, parts = _upserts(spark, d, root, version)
    if stream:
        ingest.upsert_stream(stream(root), t, ["event_id"], f"{root}/checkpoint", f"s{uuid.uuid4().hex}").awaitTermination()
    else:
        for p in parts:
            t.upsert(p, ["event_id"])
    engine.process_all(t, Index.create(spark, root, "index", 8))
    return t


_LAST = "SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY 1, 2"


@query(_LAST)
def conversion_v3(spark, d):
    return _converted(spark, d, 3).visible()


@query(_LAST)
def conversion_v2(spark, d):
    return _converted(spark, d, 2).visible()


@query(_LAST)
def stream_ingest(spark, d):
    schema = table(spark, d, "events").schema
    return _converted(spark, d, 3, lambda root: spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("event_id", "user_id", "event_type")).visible()


@query(_LAST)
def stream_json(spark, d):
    """The same from JSON files."""

    def stream(root: str) -> DataFrame:
        table(spark, d, "events").select("event_id", "user_id", "event_type").write.json(f"{root}/json")
        return ingest.json_stream(spark, f"{root}/json", "event_id bigint, user_id bigint, event_type string")

    return _converted(spark, d, 3, stream).visible()


@query("SELECT CAST(6 AS BIGINT) AS snapshots, CAST(3 AS BIGINT) AS converted, CAST(0 AS BIGINT) AS changed")
def converted_snapshots(spark, d):
    """Snapshots of a converted table of three upserts, how many conversions made, and how many of those changed a visible row."""
    t = _converted(spark, d, 3)
    snapshots = {m.snapshot_id: m for m in t.snapshots()}
    made = [m for m in snapshots.values() if m.summary.get(config.CONVERTED)]
    changed = sum(not lookup.same_rows(t.visible(m), t.visible(snapshots[m.parent_id])) for m in made)
    return spark.createDataFrame([(len(snapshots), len(made), changed)], "snapshots bigint, converted bigint, changed bigint")


@query(_LAST)
def resumed_conversion(spark, d):
    """Two crashes in between, each after files were written: a DATA run dies before its watermark, an EQ_DEL run before its commit; other objects go on from what is stored."""
    root = _folder(spark)
    t, parts = _upserts(spark, d, root)

    class Dies(Table):
        def commit(self, *args, **how):
            raise OSError("killed")

    for p in parts:
        t.upsert(p, ["event_id"])
        for _ in range(2):
            try:
                engine.process_next_run(Dies(spark, t.path), Index.create(spark, root, "index", 8))
            except OSError:
                engine.process_next_run(Table(spark, t.path), Index.create(spark, root, "index", 8))
    engine.process_all(Table(spark, t.path), Index.create(spark, root, "index", 8))
    return t.visible()


@query(_LAST)
def refused_commit(spark, d):
    """A conversion that was planned before another writer's deletes on the same files is refused, and succeeds when planned again."""
    root = _folder(spark)
    t, parts = _upserts(spark, d, root)
    index = Index.create(spark, root, "index", 8)
    t.upsert(parts[0].unionByName(parts[1]), ["event_id"])
    engine.process_all(t, index)
    t.upsert(parts[2], ["event_id"])
    meta = t.meta()
    run = runs.plan_next(t, meta)
    adds, removes = engine.converted(t, meta, run, index.find(engine.probes(t, meta, run)))
    # somebody else converts the same run first
    engine.process_next_run(Table(spark, t.path), index)
    try:
        t.commit(meta, adds, removes)
    except Conflict:
        engine.process_all(t, index)
        return t.visible()
    raise AssertionError("the stale commit went through")


@query("SELECT 0 AS spec_id, '' AS partition_key, CAST(o_orderkey AS VARCHAR) AS pk, 'orders' AS data_file_path, o_custkey AS pos FROM orders WHERE o_orderkey % 3 = 0")
def bucketed_lookup(spark, d):
    """An index that was appended to twice and compacted into its bucketed base: a third of all keys are looked up as measured."""
    index = Index.create(spark, _folder(spark), "orders", 8)
    o = table(spark, d, "orders").select(F.lit(0).alias("spec_id"), F.lit("").alias("partition_key"), F.col("o_orderkey").cast("string").alias("pk"), F.lit("orders").alias("data_file_path"), F.col("o_custkey").alias("pos"), F.col("o_orderkey").alias("k"))
    index.append(o.where("k % 2 = 0").withColumn("pos", F.lit(-1)).withColumn("seq", F.lit(1)))
    index.append(o.withColumn("seq", F.lit(2)))
    index.compact()
    return index.find(o.where("k % 3 = 0").select("spec_id", "partition_key", "pk"))


_PLACES = "SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos FROM orders"


def _scanned(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """The orders by key in one file of a format, scanned with positions."""
    out = f"{_folder(spark)}/orders.{fmt}"
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartition(1).sortWithinPartitions("o_orderkey")
    if fmt == "avro":

        def write(batches):
            from rowtide.sources import avro_file

            avro_file.write(out, [("o_orderkey", "long"), ("o_orderstatus", "string")], (r for b in batches for r in b.itertuples(index=False, name=None)), block_rows=1000)
            yield pd.DataFrame({"path": [out]})

        files = cut(o.mapInPandas(write, "path string"))
    else:
        o.write.format(fmt).save(out)
        files = spark.createDataFrame([(str(p),) for p in Path(out).glob(f"*.{fmt}")], "path string")
    return scans.rows(spark, files.withColumn("format", F.lit(fmt)), o.schema).drop("data_file_path")


@query(_PLACES)
def scan_parquet(spark, d):
    return _scanned(spark, d, "parquet")


@query(_PLACES)
def scan_orc(spark, d):
    return _scanned(spark, d, "orc")


@query(_PLACES)
def scan_avro(spark, d):
    return _scanned(spark, d, "avro")
