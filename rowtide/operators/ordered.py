"""Ordered lookups: for a point, the next boundary at or after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one block; a window never holds more distinct points than this, however large a group is.
BLOCK = 4096


def next_bound(points: DataFrame, bounds: DataFrame, by: Sequence[str], order: str, payload: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Each distinct point of ``points`` with the first row of ``bounds`` at or after it in ``order``.

    ``order`` is an integer column in both. The groups ``by`` are divided into
    blocks of ``order``: a window inside each block finds bounds nearby, a
    second window, over one row a block, finds the first bound of the later
    blocks. So a group that holds most rows is spread over its blocks. Points
    come back once each; ``payload`` is null where no bound follows. Rows with
    a null in ``by`` or ``order`` match nothing; of bounds at the same place the
    largest payload counts.
    """
    by = list(by)
    held = F.struct(F.col(order), *payload)
    b = bounds.where(F.col(order).isNotNull()).select(*by, order, *payload).groupBy(*by, order).agg(F.max(held).alias("_held"))
    p = points.where(F.col(order).isNotNull()).select(*by, order).distinct()
    blocked = lambda df: df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    b = blocked(b)
    both = blocked(p).withColumn("_held", F.lit(None).cast(b.schema["_held"].dataType)).withColumn("_point", F.lit(1)).unionByName(b.withColumn("_point", F.lit(0)))
    w = Window.partitionBy(*by, "_block").orderBy(F.col(order).desc(), F.col("_point")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_held", ignorenulls=True).over(w)).where("_point = 1")
    blocks = both.groupBy(*by, "_block").agg(F.min("_held").alias("_first"))
    later = Window.partitionBy(*by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", F.last("_first", ignorenulls=True).over(later).alias("_far"))
    found = near.join(blocks, [*by, "_block"], "left").withColumn("_hit", F.coalesce("_near", "_far"))
    return found.select(*by, order, F.col(f"_hit.{order}").alias(f"bound_{order}"), *[F.col(f"_hit.{c}").alias(c) for c in payload])


def row_positions(rows: DataFrame, by: Sequence[str], order: str, name: str = "pos", block: int = 1 << 16) -> DataFrame:
    """``rows`` with ``name``: the place of each row in its group by ``order``, from 0.

    ``order`` is an integer column, unique in a group (ties get places in no certain order; null comes first). Groups are cut into
    blocks of ``order``; places inside a block are counted in parallel and shifted by the rows of the blocks before. So a group
    with most rows is not one task's. Null keys form a group.
    """
    cut_ = rows.withColumn("_g", F.struct(*by)).withColumn("_block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62))))
    counts = cut_.groupBy("_g", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_g", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_g", "_block").orderBy(order))
    return cut_.withColumn("_rn", inside).join(shifts, ["_g", "_block"]).withColumn(name, (F.col("_shift") + F.col("_rn") - 1).cast("bigint")).drop("_g", "_block", "_rn", "_shift")
