"""The walk: files in order of (sequence number, kind), grouped into runs of one kind.

Works on file listings of any number of tables at once. Columns: ``by`` columns (such as
table_id), seq, kind (0 EQ_DEL, 1 DATA), and whatever else describes a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.plans.config import State


def convertible(content: Column, field_ids: Column, key_ids: Column, file_partitioned: Column, table_partitioned: Column) -> Column:
    """An equality delete on exactly the key columns, partitioned as the table is."""
    return (content == "EQUALITY_DELETES") & (canon.id_set(field_ids) == canon.id_set(key_ids)) & (file_partitioned == table_partitioned)


def after(state: State) -> Column:
    """Files past the watermark, strictly."""
    return (F.col("seq") > state.seq) | ((F.col("seq") == state.seq) & (F.col("kind") > state.kind))


def runs(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, run_id, kind, min_seq, max_seq, files, previous_max: maximal stretches of one kind in walk order.

    Files first combine to one row a place (seq, kind), so the windows see as many rows as a table has
    commits, not files. ``previous_max`` is the max_seq of the run before, null for the first.
    Files without seq or kind are not walked.
    """
    places = files.where("seq is not null and kind is not null").groupBy(*by, "seq", "kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("seq", "kind")
    changed = F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1)
    numbered = places.withColumn("_new", changed).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*by, "run_id").agg(F.max("kind").alias("kind"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum("n").alias("files"))
    return out.withColumn("previous_max", F.lag("max_seq").over(Window.partitionBy(*by).orderBy("run_id")))


def next_run(files: DataFrame, state: State) -> DataFrame:
    """The files of the first run after ``state`` of one table."""
    rest = files.where(after(state))
    first = runs(rest).where("run_id = 1").select(F.col("kind").alias("_kind"), F.col("max_seq").alias("_max"))
    # before the end of the first run there are only files of its own kind
    inside = (F.col("kind") == F.col("_kind")) & (F.col("seq") <= F.col("_max"))
    return rest.join(F.broadcast(first), inside).drop("_kind", "_max")


def run_deletes(run: DataFrame, deletes: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The position deletes and vectors that apply to a DATA run's files: all up to the end of the run.

    ``run`` has path and max_seq, deletes have referenced and seq, both ``by`` columns (such as table_id); ``keep`` columns of the run come
    with each delete. A delete of a file outside the run, or one that names no file, is not used. The
    lower end is open: deletes committed together with the run's first files count. A path is in a run once.
    """
    files = run.select(*by, F.col("path").alias("referenced"), F.col("max_seq").alias("_end"), *keep)
    return deletes.where(F.col("referenced").isNotNull()).join(files, [*by, "referenced"]).where(F.col("seq") <= F.col("_end")).drop("_end")


def touched(partitions: DataFrame, files: DataFrame, columns: Sequence[str] = ("spec_id", "partition_key")) -> DataFrame:
    """The files in a partition of ``partitions``."""
    return files.join(partitions.select(*columns).distinct(), list(columns), "left_semi")


def existing_deletes(deletes: DataFrame, touched_partitions: DataFrame, format_version: int) -> DataFrame:
    """The per-file deletes that a conversion has to merge: vectors for version 3, file-scoped position deletes for version 2."""
    live = deletes.where(F.col("referenced").isNotNull())
    kind = F.col("content") == ("dv" if format_version == 3 else "pos")
    return touched(touched_partitions, live.where(kind))


def late(state: State, version: Column, processed: int) -> Column:
    """Files that came after the watermark was set, but belong before it: the walk would never come to them."""
    return (version > processed) & ~after(state)


def assemble(outputs: DataFrame, eq_deletes: DataFrame, rewritten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a conversion's commit adds and removes: all new delete files; the converted equality deletes, and each rewritten delete file once, by its location."""
    place = ["path", "referenced", "content"]
    return outputs, eq_deletes.select(*place).unionByName(rewritten.select(*place)).dropDuplicates(["path", "referenced"])
