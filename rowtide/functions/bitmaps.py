"""Sets of row positions as built-in bitmaps: union, construction, cardinality.

A bitmap covers the 32768 positions of one bucket, so every aggregation groups
by bucket; positions are shifted by one since numbers 0 and 1 would share a bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Positions in one bitmap. Position p has bit p % BUCKET of the bucket p // BUCKET + 1.
BUCKET = 32768


def position_sets(positions: DataFrame, by: Sequence[str], pos: str = "pos") -> DataFrame:
    """by, bucket, bits: the set of positions of each group. Repeats collapse; null and negative positions are ignored."""
    p = positions.where(F.col(pos) >= 0).withColumn("_p", F.col(pos) + 1)
    return p.groupBy(*by, F.bitmap_bucket_number("_p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("bits"))


def union_sets(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def cardinality(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, positions: how many positions each group has."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("positions"))
