"""Queries of the general problems 1 to 5, over whole tables."""

from __future__ import annotations

import os
import uuid
import zlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.operators import cdc, compaction, manifest_diff, references, selection, skew
from rowtide.plans import config
from rowtide.queries.common import table
from rowtide.session import cut, shared_dir
from rowtide.sources.scans import local
from rowtide.sources.table_log import Table, process_new

KEY = ["table_id", "spec_id", "partition_key", "pk"]


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, t) for t in ("data_files", "delete_files", "ice_tables", "work_units", "snapshots"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return manifest_diff.pending(*_files(spark, d)).select("file_id")


def p1_version_deltas(spark: SparkSession, d: str) -> DataFrame:
    return manifest_diff.version_deltas(*_files(spark, d))


def p1_deltas_since(spark: SparkSession, d: str) -> DataFrame:
    """Like p1_version_deltas, less what vectors had already deleted at the processed version."""
    return manifest_diff.version_deltas(*_files(spark, d), since=True)


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The sink of incremental steps over a source that gets appends, upserts, vectors and equality deletes, with a crash before a commit.

    The events are the source: days 1 to 10 appended, 11 to 20 upserted by (event_type, user_id), events divisible by 7 deleted by vectors, views of users
    divisible by 5 by an equality delete, 21 to 31 upserted.
    """
    root = os.path.join(local(shared_dir(spark)), f"rowtide-{uuid.uuid4().hex}")
    schema, props = "event_id bigint, user_id bigint, event_type string", {config.PRIMARY_KEYS: "user_id"}
    source, sink = (Table.create(spark, f"{root}/{n}", schema, ["event_type"], props) for n in ("source", "sink"))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.coalesce(F.day("ts"), F.lit(1)).alias("_day"))
    days = lambda low, high: e.where(F.col("_day").between(low, high)).drop("_day")

    class Dies(Table):
        def commit(self, *args, **how):
            raise OSError("killed")

    def step(dies: bool = False) -> None:
        # listings are not kept in memory between steps
        for t in [Dies(spark, sink.path), sink] if dies else [sink]:
            try:
                process_new(spark, source, t, lambda df: df)
            except OSError:
                pass
            t.close()
        source.close()

    source.append(days(1, 10))
    step()
    source.upsert(days(11, 20), ["event_id"])
    step()
    head = source.meta()
    source.write(positions=source.live(source.files(head), head).where("event_id % 7 = 0").select("data_file_path", "pos"))
    source.write(delete_keys=e.where("event_type = 'view' and user_id % 5 = 0").select("user_id", "event_type"))
    step(dies=True)
    source.upsert(days(21, 31), ["event_id"])
    step()
    return sink.visible()


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact_delete_files(table(spark, d, "delete_files"), table(spark, d, "eq_delete_rows"), table(spark, d, "ice_tables"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d).select(F.explode("members.file_id").alias("file_id")).distinct()


def p2_compacted(spark: SparkSession, d: str) -> DataFrame:
    out = _compacted(spark, d)
    return out.select("table_id", "spec_id", "partition_key", "content", F.array_join(F.col("ids").cast("array<string>"), ",").alias("equality_ids"), "out_no", "files", "records", "bytes", "crc", "payload")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files and records of each group that is consolidated."""
    out = _compacted(spark, d)
    g = out.groupBy("table_id", "spec_id", "partition_key", "content", F.array_join(F.col("ids").cast("array<string>"), ",").alias("equality_ids"))
    return g.agg(F.sum("files").alias("files"), F.sum("records").alias("records"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The same for real files: each small delete file is written to the shared folder, joined there, and read again from the joined files.

    Rows: table_id, files, records (as stated), deletes (rows of equality deletes found in the outputs).
    """
    root = os.path.join(local(shared_dir(spark)), f"rowtide-{uuid.uuid4().hex}")
    small = compaction.small_delete_files(table(spark, d, "delete_files"), table(spark, d, "ice_tables"))
    frames = compaction.delete_frames(small, table(spark, d, "eq_delete_rows")).select("table_id", "file_id", "piece", "frame")
    listing = cut(frames.mapInPandas(_write_frames(root), "path string, length bigint, crc bigint"))
    joined = compaction.compact_paths(spark, listing, f"{root}/joined", target=1 << 20)
    lines = joined.select("out_path", "members").mapInPandas(_read_lines, "path string, line string")
    x = lines.select(F.regexp_extract("path", r"/(\d+)-\d+-\d+$", 1).cast("bigint").alias("table_id"), F.from_json("line", "record_count bigint, path string, pk string, spec_id int").alias("j"), F.col("line").contains('"record_count"').alias("head"))
    return x.groupBy("table_id").agg(F.count(F.when(F.col("head"), 1)).alias("files"), F.sum(F.when(F.col("head"), F.col("j.record_count"))).alias("records"), F.count(F.when(~F.col("head"), 1)).alias("deletes"))


def _write_frames(root: str):
    def run(batches):
        for b in batches:
            made = []
            for t, f, piece, frame in b.itertuples(index=False, name=None):
                folder = os.path.join(root, "small", str(f % 256))
                os.makedirs(folder, exist_ok=True)
                out = os.path.join(folder, f"{t}-{f}-{piece}")
                with open(f"{out}.{uuid.uuid4().hex}", "wb") as w:
                    w.write(frame)
                os.replace(w.name, out)
                made.append((out, len(frame), zlib.crc32(frame)))
            yield pd.DataFrame(made, columns=["path", "length", "crc"])

    return run


def _read_lines(batches):
    """The lines of each member, cut out of the joined files."""
    import zstandard

    for b in batches:
        for out, members in zip(b["out_path"], b["members"]):
            with open(out, "rb") as f:
                for m in members:
                    f.seek(m["offset"])
                    text = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(f.read(m["length"])).decode()
                    yield pd.DataFrame({"path": m["path"], "line": text.splitlines()})


def _key_fields(changes: DataFrame, *columns: str) -> DataFrame:
    """Both key fields of every delivered change in long form, null paths too."""
    fields = F.array(F.struct(F.lit("partition_key").alias("key_field"), canon.partition_key("partition_key").alias("key_value")), F.struct(F.lit("data_file_path").alias("key_field"), canon.file_path("data_file_path").alias("key_value")))
    return changes.select("table_id", *columns, F.explode(fields).alias("f")).select("table_id", "f.key_field", "f.key_value", *columns)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    shares = {"partition_key": Fraction(1, 4), "data_file_path": Fraction(1, 20)}
    rows = _key_fields(table(spark, d, "index_changes"))
    return selection.heavy_values(rows, ["table_id", "key_field"], "key_value", ("key_field", shares)).select("table_id", "key_field", "key_value")


def p3_key_stats(spark: SparkSession, d: str) -> DataFrame:
    long = _key_fields(table(spark, d, "index_changes"), "spec_id", "pk", "changed_at", "change_id").where("key_value is not null")
    return selection.key_stats(long, ["table_id", "key_field", "key_value"], [F.col("spec_id"), canon.hex_key("pk")], ["changed_at", "change_id"])


def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    long = _key_fields(table(spark, d, "index_changes"), "sequence_number").where("key_value is not null")
    return selection.exact_quantiles(long, ["table_id", "key_field", "key_value"], "sequence_number", [0.25, 0.5, 0.9])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """ref_field, table_id, ref_id, ref_value, day of every orphan reference."""
    changes, plans, deleted = table(spark, d, "index_changes"), table(spark, d, "commit_plans"), table(spark, d, "eq_delete_rows")
    data = manifest_parents(table(spark, d, "data_files"), "data_file_path", "index_changes.data_file_path")
    delete_files = table(spark, d, "delete_files")
    eq = manifest_parents(delete_files.where(canon.label("content") == "EQUALITY_DELETES"), "file_path", "commit_plans.eq_deletes_to_remove")
    refs = changes.select("table_id", F.lit("index_changes.data_file_path").alias("ref_field"), F.col("change_id").alias("ref_id"), canon.file_path("data_file_path").alias("path"), F.col("changed_at").alias("at"))
    removals = plans.select("table_id", F.lit("commit_plans.eq_deletes_to_remove").alias("ref_field"), F.col("plan_id").alias("ref_id"), F.explode("eq_deletes_to_remove").alias("p"), F.col("planned_at").alias("at")).withColumn("path", canon.file_path("p")).drop("p")
    children = refs.unionByName(removals).where("path is not null")
    by_path = references.orphans(children, data.unionByName(eq), ["ref_field", "table_id", "path"], ["ref_id"])
    files = delete_files.groupBy("table_id", canon.file_path("file_path").alias("path")).agg(F.max("data_sequence_number").alias("dsn"), F.max("added_at").alias("added_at"))
    rows = deleted.select("row_id", "table_id", "spec_id", canon.partition_key("partition_key").alias("partition_key"), canon.hex_key("pk").alias("pk"), canon.file_path("file_path").alias("path"))
    rows = skew.join(rows, files, ["table_id", "path"], ["row_id", "pk"], "left").drop("path")
    by_pk = references.state_orphans(rows, _changes(spark, d), KEY, ["row_id", "added_at"], "dsn", "sequence_number", F.col("kind") == 1, F.col("ordinal"), "live")
    return by_path.select("ref_field", "table_id", "ref_id", F.col("path").alias("ref_value"), F.to_date("at").alias("day")).unionByName(
        by_pk.select(F.lit("eq_delete_rows.pk").alias("ref_field"), "table_id", F.col("row_id").alias("ref_id"), F.col("pk").alias("ref_value"), F.to_date("added_at").alias("day"))
    )


def manifest_parents(listing: DataFrame, path: str, ref_field: str) -> DataFrame:
    """When each file was there: one row a file, gone if any listing says so."""
    files = listing.groupBy("file_id", "table_id", canon.file_path(path).alias("path")).agg(F.min("added_at").alias("added"), F.max("removed_at").alias("removed"))
    return files.select(F.lit(ref_field).alias("ref_field"), "table_id", "path", "added", "removed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "ref_id", "ref_value").distinct()


def p4_per_table_day(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of each kind per table and day of the reference (of its delete file for pk), each once."""
    return _orphans(spark, d).distinct().groupBy("ref_field", "table_id", "day").agg(F.count(F.lit(1)).alias("orphans"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "index_changes")
    return c.select(
        "table_id", "spec_id", canon.partition_key("partition_key").alias("partition_key"), canon.hex_key("pk").alias("pk"),
        "sequence_number", canon.kind_order("file_kind").alias("kind"), "ordinal", canon.leaves_row("op").alias("live"), canon.file_path("data_file_path").alias("data_file_path"), "pos",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cdc.apply_changes(_changes(spark, d), KEY, ["sequence_number", "kind", "ordinal"], "live", ["data_file_path", "pos"])


def p5_live_per_table(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("table_id").agg(F.count(F.lit(1)).alias("live_keys"), F.count_distinct("data_file_path").alias("files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_version_deltas, p1_deltas_since, p1_incremental, p2_found, p2_compacted, p2_groups, p2_files, p3_found, p3_key_stats, p3_quantiles, p4_found, p4_per_table_day, p5_found, p5_live_per_table)}
