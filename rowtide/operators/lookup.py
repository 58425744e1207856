"""Joins and aggregations of the merge-on-read model, over plain DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.session import cut, local_rows

#: Probes up to this many keys become an IN list, which prunes buckets, files and row groups.
IN_KEYS = 100
#: Probes up to this many keys are taken to the driver at the first look, which need not be repeated then.
LOCAL_KEYS = 1_000
#: What is broadcast has no more bytes than this; they are measured before.
BROADCAST_BYTES = 64 << 20


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, columns as they were: a combining maximum, so a hot key is reduced before the shuffle.

    Ties in ``order`` go to the largest of the other columns. Null keys are a key; nulls in ``order`` come first.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    g = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_l"))
    return g.select(*[c if c in keys else F.col(f"_l.{c}").alias(c) for c in rows.columns])


def last_delete(deletes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row a key: the last delete decides whether any is later than a row."""
    return deletes.groupBy(*keys).agg(F.max(seq).alias("_dead"))


def _against(rows: DataFrame, deletes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    d = last_delete(deletes, keys, seq)
    d = d.select(F.struct(*keys).alias("_k"), "_dead")
    return rows.withColumn("_k", F.struct(*keys)).join(d, "_k", "left").drop("_k")


def visible(rows: DataFrame, deletes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Rows without a later equality delete of their key; null keys equal each other, a row without seq stays."""
    return _against(rows, deletes, keys, seq).where((F.col("_dead") > F.col(seq)).isNull() | (F.col("_dead") <= F.col(seq))).drop("_dead")


def deleted(rows: DataFrame, deletes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The other rows: those that a later equality delete hits."""
    return _against(rows, deletes, keys, seq).where(F.col("_dead") > F.col(seq)).drop("_dead")


def as_of(probes: DataFrame, index: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """keys, seq, last_seq, matches: for each distinct probe the last index entry before it and how many there are.

    Both sides go through one window in order of seq, index entries first combined to one row a key and seq;
    no pair is ever formed. Probes without an earlier entry are left out. Null keys equal each other.
    """
    e = index.groupBy(*keys, seq).agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.col(seq)).withColumn("_probe", F.lit(0))
    p = probes.select(*keys, seq).distinct().withColumn("_n", F.lit(0).cast("bigint")).withColumn("_at", F.lit(None).cast(index.schema[seq].dataType)).withColumn("_probe", F.lit(1))
    # a probe sorts before the entries of its own seq: only earlier ones count
    w = Window.partitionBy(*keys).orderBy(F.col(seq), F.col("_probe").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(e).select(*keys, seq, "_probe", F.last("_at", ignorenulls=True).over(w).alias("last_seq"), F.sum("_n").over(w).alias("matches"))
    return both.where("_probe = 1 and matches > 0").drop("_probe")


def measured_bytes(df: DataFrame) -> int:
    """About the bytes of all rows: texts, whatever their length, and 16 for anything else."""
    kinds = dict(df.dtypes)
    size = F.lit(16)
    for c, kind in kinds.items():
        plain = F.col(c) if kind in ("string", "binary") else F.to_json(F.struct(c)) if kind.startswith("struct") else None
        size = size + (F.lit(16) if plain is None else F.coalesce(F.octet_length(plain), F.lit(0)) + 16)
    return df.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes are in bounds; measuring runs it once."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def lookup(probe: DataFrame, index: DataFrame, keys: Sequence[str], pushed: str, how: str | None = None) -> DataFrame:
    """The index rows of the probe's keys; misses give nothing, repeated probes nothing more.

    ``pushed`` is the key column whose values go into the scan of the index when there are few. Unless ``how`` says what to do, the
    distinct keys are looked at once: up to LOCAL_KEYS come to the driver, and are an IN list (up to IN_KEYS) or a broadcast without a
    further job; more are materialised, measured, and broadcast within BROADCAST_BYTES, else merged. An "in" beyond LOCAL_KEYS or a "broadcast" beyond
    its bytes is refused, not tried.
    """
    p = probe.select(*keys).distinct()
    if how not in (None, "in", "broadcast", "merge"):
        raise ValueError(how)
    if how in (None, "in"):
        found = p.limit(LOCAL_KEYS + 1).collect()
        if len(found) <= LOCAL_KEYS:
            here = local_rows(p.sparkSession, found, p.schema)
            if how == "in" or len(found) <= IN_KEYS:
                hits = index.where(F.col(pushed).isin(sorted({r[pushed] for r in found if r[pushed] is not None})))
                return hits if list(keys) == [pushed] else hits.join(F.broadcast(here), list(keys), "left_semi")
            if sum(len(str(v)) + 16 for r in found for v in r) <= BROADCAST_BYTES:
                return index.join(F.broadcast(here), list(keys), "left_semi")
        elif how == "in":
            raise ValueError("too many keys for an IN list")
    if how == "merge":
        return index.join(p.hint("merge"), list(keys), "left_semi")
    p = cut(p)
    if measured_bytes(p) <= BROADCAST_BYTES:
        return index.join(F.broadcast(p), list(keys), "left_semi")
    if how == "broadcast":
        raise ValueError("too many bytes to broadcast")
    return index.join(p.hint("merge"), list(keys), "left_semi")


def without(rows: DataFrame, positions: DataFrame, on: Sequence[str] = ("data_file_path", "pos")) -> DataFrame:
    """Rows whose position is not in ``positions``."""
    return rows.join(positions.select(*on), list(on), "left_anti")


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``a`` that ``b`` does not have, as often as ``a`` has more of them; nulls equal each other, columns go by name."""
    names = sorted(a.columns)
    return a.select(*names).exceptAll(b.select(*names))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two DataFrames hold the same rows as often; stops at the first difference found."""
    return not row_difference(a, b).limit(1).count() and not row_difference(b, a).limit(1).count()


def spec_of(seq: Column | str, change_at: int) -> Column:
    """The partition spec in force: 0 up to ``change_at``, 1 after."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.when(c <= change_at, 0).otherwise(1)
