"""Processing only new or changed records, by diffing immutable file manifests.

A manifest lists the files of one table version, one row a file. The diff of
two manifests is a set of record deltas: files added, files removed, deletion
vectors that appeared, changed or went away. The version a run has processed
is saved in the same commit as its output (``sources.table_log``), so a run
that dies leaves either both or neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.operators.ordered import next_bound

DATA, EQ_DEL = 1, 0


def data_manifest(data_files: DataFrame) -> DataFrame:
    """One row a data file from a listing with repeated and incomplete rows.

    A file is removed if any of its rows says so; every other value is the
    largest one that any row states. Extra columns are ignored.
    """
    return data_files.groupBy("file_id").agg(
        F.max("table_id").alias("table_id"),
        F.lit(DATA).alias("kind"),
        F.max(canon.file_path("data_file_path")).alias("path"),
        F.lit(None).cast("array<int>").alias("field_ids"),
        F.max("data_sequence_number").alias("data_sequence_number"),
        F.max("added_snapshot_id").alias("added_snapshot_id"),
        F.max("record_count").alias("record_count"),
        F.max("removed_at").alias("removed_at"),
    )


def delete_manifest(delete_files: DataFrame, content: str = "EQUALITY_DELETES") -> DataFrame:
    """Like :func:`data_manifest` for the delete files of one content."""
    return (
        delete_files.where(canon.label("content") == content)
        .groupBy("file_id")
        .agg(
            F.max("table_id").alias("table_id"),
            F.lit(EQ_DEL).alias("kind"),
            F.max(canon.file_path("file_path")).alias("path"),
            F.max(canon.id_set("equality_ids")).alias("field_ids"),
            F.max("data_sequence_number").alias("data_sequence_number"),
            F.max("added_snapshot_id").alias("added_snapshot_id"),
            F.max("record_count").alias("record_count"),
            F.max("removed_at").alias("removed_at"),
        )
    )


def convertible(delete_files: DataFrame, tables: DataFrame) -> DataFrame:
    """The equality-delete manifest, only files on exactly their table's key columns."""
    keys = tables.groupBy("table_id").agg(F.max(canon.id_set("pk_field_ids")).alias("_key_ids"))
    return delete_manifest(delete_files).join(keys, "table_id").where(F.col("field_ids") == F.col("_key_ids")).drop("_key_ids")


def position(seq: Column, kind: Column) -> Column:
    """(sequence number, kind) as one integer that sorts in walk order: EQ_DEL before DATA."""
    return (seq * 2 + kind).cast("bigint")


def successful_units(work_units: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(table_id, walk, start_seq) of units whose latest status is COMMITTED.

    The latest row is that with the largest logged_at; ties go to the higher
    attempt, then to the status that sorts last. Rows without logged_at count
    as the earliest. A unit whose starting snapshot is unknown has a null start_seq.
    """
    latest = work_units.groupBy("unit_id").agg(
        F.max("table_id").alias("table_id"),
        F.max(canon.kind_order("kind")).alias("kind"),
        F.max("max_seq").alias("max_seq"),
        F.max("starting_snapshot_id").alias("snapshot_id"),
        F.max(F.struct("logged_at", "attempt", canon.label("status").alias("status"))).alias("last"),
    )
    seqs = snapshot_sequence(snapshots)
    return (
        latest.where(F.col("last.status") == "COMMITTED")
        .join(seqs.withColumnRenamed("seq", "start_seq"), "snapshot_id", "left")
        .select("table_id", position(F.col("max_seq"), F.col("kind")).alias("walk"), "start_seq")
    )


def snapshot_sequence(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("snapshot_id").agg(F.max("sequence_number").alias("seq"))


def processed_manifest(files: DataFrame, work_units: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The files that successful units took: the manifest of the processed version.

    A unit owns the walk positions after the preceding successful unit's up to
    its own. It took a file there only if it could see it: the file's snapshot
    is not younger than the one the unit started from. Files without sequence
    number or with an unknown snapshot were taken by nobody.
    """
    placed = files.withColumn("walk", position(F.col("data_sequence_number"), F.col("kind")))
    owner = next_bound(placed, successful_units(work_units, snapshots), ["table_id"], "walk", ["start_seq"])
    return (
        placed.join(owner, ["table_id", "walk"])
        .join(snapshot_sequence(snapshots), F.col("added_snapshot_id") == F.col("snapshot_id"))
        .where((F.col("walk") > 1) & (F.col("seq") <= F.col("start_seq")))
        .select(*files.columns)
    )


def diff(older: DataFrame, newer: DataFrame, vectors_older: DataFrame | None = None, vectors_newer: DataFrame | None = None) -> DataFrame:
    """Record deltas from one manifest to a newer one.

    Both need table_id, file_id, record_count. Vectors need table_id, file_id
    (of the data file they belong to) and deleted (their cardinality). The
    tagged rows of all four are summed in one shuffle, no join:

    ADDED    in newer only; records_added = record_count less what its vector deletes
    REMOVED  in older only; records_removed = what was still visible of it
    CHANGED  in both with another vector cardinality

    Unchanged files give no row. Repeated manifest rows count once; a null
    record_count stays null.
    """
    void = older.select("table_id", "file_id").limit(0).withColumn("deleted", F.lit(0).cast("bigint"))

    def tagged(m: DataFrame, side: int) -> DataFrame:
        return m.select("table_id", "file_id", F.lit(side).alias("side"), F.col("record_count").cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("gone"))

    def vector(v: DataFrame | None, side: int) -> DataFrame:
        return (v if v is not None else void).select("table_id", "file_id", F.lit(side).alias("side"), F.lit(None).cast("bigint").alias("n"), F.col("deleted").cast("bigint").alias("gone"))

    rows = tagged(older, 1).unionByName(tagged(newer, 2))
    if vectors_older is not None or vectors_newer is not None:
        rows = rows.unionByName(vector(vectors_older, 3)).unionByName(vector(vectors_newer, 4))
    pick = lambda what, side: F.max(F.when(F.col("side") == side, F.col(what)))
    has = lambda side: F.max((F.col("side") == side).cast("int"))
    g = rows.groupBy("table_id", "file_id").agg(
        has(1).alias("was"), has(2).alias("is"), pick("n", 1).alias("n1"), pick("n", 2).alias("n2"),
        F.coalesce(pick("gone", 3), F.lit(0)).alias("d1"), F.coalesce(pick("gone", 4), F.lit(0)).alias("d2"),
    )
    change = F.when((F.col("was") == 0) & (F.col("is") == 1), "ADDED").when((F.col("was") == 1) & (F.col("is") == 0), "REMOVED").when((F.col("was") == 1) & (F.col("d1") != F.col("d2")), "CHANGED")
    return (
        g.withColumn("change", change)
        .where("change is not null")
        .select(
            "table_id", "file_id", "change",
            F.when(F.col("change") == "ADDED", F.col("n2") - F.col("d2")).when(F.col("change") == "CHANGED", F.greatest(F.col("d1") - F.col("d2"), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("records_added"),
            F.when(F.col("change") == "REMOVED", F.col("n1") - F.col("d1")).when(F.col("change") == "CHANGED", F.greatest(F.col("d2") - F.col("d1"), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("records_removed"),
        )
    )


def pending(data_files: DataFrame, delete_files: DataFrame, tables: DataFrame, work_units: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What a next run has to process: the diff from the processed to the live manifest.

    Rows of :func:`diff` with path and kind, ADDED only: live files nobody took.
    (REMOVED rows of that diff are files taken and gone since.)
    """
    every = data_manifest(data_files).unionByName(convertible(delete_files, tables).select(*data_manifest(data_files).columns))
    live = every.where("removed_at is null")
    return diff(processed_manifest(live, work_units, snapshots), live).where("change = 'ADDED'")


def _vectors(delete_files: DataFrame) -> DataFrame:
    """One row a deletion vector that names its data file."""
    return (
        delete_files.where((canon.label("content") == "POSITION_DELETES") & (canon.label("file_format") == "PUFFIN"))
        .groupBy("file_id")
        .agg(
            F.max("table_id").alias("table_id"), F.max(canon.file_path("referenced_data_file")).alias("path"), F.max("data_sequence_number").alias("dsn"),
            F.max("added_snapshot_id").alias("snapshot_id"), F.max("record_count").alias("deleted"), F.max("removed_at").alias("removed_at"),
        )
        .where("path is not null")
    )


def _newest(vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """The newest vector of each group: ``by`` and deleted, an unknown cardinality as 0."""
    newest = vectors.groupBy(*by).agg(F.max(F.struct("dsn", "file_id", "deleted")).alias("newest"))
    return newest.select(*by, F.coalesce(F.col("newest.deleted"), F.lit(0)).alias("deleted"))


def processed_vectors(vectors: DataFrame, files: DataFrame, work_units: DataFrame, snapshots: DataFrame) -> DataFrame:
    """table_id, file_id (of the data file), deleted: the newest vector of each of ``files`` at its table's processed version.

    The processed version is that of the table's last successful unit: a run subtracts the deletes numbered up to its own
    max_seq that its starting snapshot shows. So a vector was in force if its number is not above the unit's, its snapshot
    not younger than the one the unit started from, and it was not removed by then; one that was removed no earlier
    than its file was in force as long as the file was there.
    """
    times = snapshots.groupBy("table_id", F.col("sequence_number").alias("start_seq")).agg(F.max("committed_at").alias("starting_at"))
    last = successful_units(work_units, snapshots).join(times, ["table_id", "start_seq"], "left")
    last = last.groupBy("table_id").agg(F.max(F.struct("walk", "start_seq", "starting_at")).alias("u"))
    of = files.select("table_id", "path", F.col("file_id").alias("data_id"), F.col("removed_at").alias("file_removed_at"))
    seen = (
        vectors.join(snapshot_sequence(snapshots), "snapshot_id").join(of, ["table_id", "path"]).join(last, "table_id")
        .where((F.col("dsn") <= F.shiftright(F.col("u.walk"), 1)) & (F.col("seq") <= F.col("u.start_seq")))
        .where(F.col("removed_at").isNull() | (F.col("removed_at") > F.col("u.starting_at")) | (F.col("removed_at") >= F.col("file_removed_at")))
    )
    return _newest(seen, ["table_id", "data_id"]).withColumnRenamed("data_id", "file_id")


def version_deltas(data_files: DataFrame, delete_files: DataFrame, tables: DataFrame, work_units: DataFrame, snapshots: DataFrame, since: bool = False) -> DataFrame:
    """Record deltas of each table between its processed manifest and the live one, vectors included.

    The live side subtracts the newest live vector of each data file. ``since``: the processed side likewise
    subtracts :func:`processed_vectors`, so only records deleted since then count; without it the processed side
    carries no vector, and records count as the files were written. Rows: table_id, change, files, records_added, records_removed.
    """
    every = data_manifest(data_files)
    live = every.where("removed_at is null")
    taken = processed_manifest(every, work_units, snapshots)
    vectors = _vectors(delete_files)
    on_files = live.select("table_id", "path", "file_id").join(_newest(vectors.where("removed_at is null"), ["table_id", "path"]), ["table_id", "path"]).select("table_id", "file_id", "deleted")
    before = processed_vectors(vectors, taken, work_units, snapshots) if since else None
    return (
        diff(taken, live, before, on_files)
        .groupBy("table_id", "change")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("records_added").alias("records_added"), F.sum("records_removed").alias("records_removed"))
    )
