"""Applying a change feed as a signed multiset.

Each deduplicated change contributes -1 for the image it takes back and +1 for
the image it leaves; multiplicities are summed with the base and rows with a
positive sum are the table. What is taken back is what the feed's own
before-image states (a -U or -D after the row it belongs to, whether or not it
repeats the row's columns); where the feed lost it, it is derived from the change before in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.operators import skew

#: Where a contribution comes from: +1 of an after-image, -1 that the feed states, -1 of a before-image that it lost, -1 of a tombstone.
AFTER, STATED, DERIVED, SUPERSEDED = "after", "stated", "derived", "superseded"


def _all(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def signed_images(df: DataFrame, keys: Sequence[str], order: Sequence[str], live: str, image: Sequence[str], tombstones: bool = False) -> DataFrame:
    """keys, live, image, place, sign, origin: what each deduplicated change contributes.

    A change that leaves a row contributes +1 for it (AFTER). The row of the change before is taken back, -1: STATED if
    this change is a before-image of it (leaves nothing, and states no column of the image or the same ones), else DERIVED. A before-image
    with nothing to take back is a stray one and contributes nothing. Of repeats of a change, and of changes at one
    place in the order, the largest counts: live before dead, then by image. ``place`` is the struct of ``order``.

    With ``tombstones`` a change that leaves nothing contributes +1 for that (live false), taken back by the next (SUPERSEDED):
    so the sums of any part of a key's changes can be summed again with those of the other parts.

    One sort for all; the windows look one row ahead and one back, so a key's changes are never held together.
    """
    w = Window.partitionBy(*keys).orderBy(*order, live, *image)
    row = F.struct(F.col(live).alias("live"), *image, F.struct(*order).alias("place"))
    here = F.struct(*order)
    once = df.withColumn("_next", F.lead(here).over(w)).where(F.col("_next").isNull() | (F.col("_next") != here)).drop("_next")
    seen = once.select(*keys, row.alias("_row"), F.lag(row).over(w).alias("_prev"))
    silent = _all([F.col(f"_row.{c}").isNull() for c in image])
    same = _all([F.col(f"_row.{c}").eqNullSafe(F.col(f"_prev.{c}")) for c in image])
    stated = ~F.col("_row.live") & (silent | same)
    back = F.when(~F.col("_prev.live"), SUPERSEDED).when(stated, STATED).otherwise(DERIVED)
    one = lambda r, sign, origin: F.struct(F.col(r).alias("row"), F.lit(sign).alias("sign"), origin.alias("origin"))
    signed = seen.select(*keys, F.explode(F.array(one("_row", 1, F.lit(AFTER)), one("_prev", -1, back))).alias("s")).where("s.row is not null")
    if not tombstones:
        signed = signed.where("s.row.live")
    return signed.select(*keys, F.col("s.row.live").alias("live"), *[F.col(f"s.row.{c}").alias(c) for c in image], F.col("s.row.place").alias("place"), F.col("s.sign").alias("sign"), F.col("s.origin").alias("origin"))


def apply_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str], live: str, image: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """The table after all changes: keys and image of every row with a positive multiplicity.

    ``changes`` may hold repeats and come in any order; ``live`` says whether a
    change leaves a row. Changes without a live flag or with a null in ``order``
    say nothing about the state and are ignored. Keys may be null and then equal each
    other. Of changes at one place in the order the largest counts: live before
    dead, then by image. ``base`` (keys and image, one row a key) precedes all
    changes. Extra columns are ignored.

    One shuffle by key. A key with more than skew.ROWS rows is cut into as many pieces as
    its count asks for, by the hash of the place in the order so that repeats meet. Each piece is netted by the same
    signed sums, tombstones kept with their places; what is left, one row a piece, is summed again.
    """
    _order = [f"_o{i}" for i in range(len(order))]
    rows = changes.select(*keys, *[F.col(o).alias(n) for o, n in zip(order, _order)], F.col(live).alias("_live"), *image).where(F.col("_live").isNotNull() & _all([F.col(o).isNotNull() for o in _order])).withColumn("_level", F.lit(1))
    if base is not None:
        types = dict(rows.dtypes)
        rows = rows.unionByName(base.select(*keys, *[F.lit(None).cast(types[o]).alias(o) for o in _order], F.lit(True).alias("_live"), *image, F.lit(0).alias("_level")))
    place = ["_level", *_order]

    def net(df: DataFrame, by: Sequence[str], tombstones: bool) -> DataFrame:
        signed = signed_images(df, by, place, "_live", image, tombstones)
        # at every place but that of a key's last change the sum is 0
        at = ["place"] if tombstones else []
        return signed.groupBy(*by, "live", *image, *at).agg(F.sum("sign").alias("_m")).where("_m > 0")

    hot = skew.hot_keys(rows, keys)
    if not hot:
        return net(rows, keys, False).select(*keys, *image)
    warm = rows.where(skew.is_hot(keys, hot)).withColumn("_piece", skew.piece(keys, place, hot))
    left = net(warm, [*keys, "_piece"], True).select(*keys, F.col("live").alias("_live"), *image, *[F.col(f"place.{o}").alias(o) for o in place])
    return net(rows.where(~skew.is_hot(keys, hot)), keys, False).unionByName(net(left, keys, False)).select(*keys, *image)
