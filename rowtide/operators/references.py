"""References to records that do not exist, at the time of the reference.

Parents and children are one long table, tagged: a parent's row says from when
to when its key exists, a child's row when it refers to it. Within a group
(parent table, key) the rows in order of time carry the number of parents
alive; children that meet none are orphans. Groups without any parent are the
plain case of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.operators import skew


def orphans(children: DataFrame, parents: DataFrame, keys: Sequence[str], child: Sequence[str], at: str = "at", added: str = "added", removed: str = "removed") -> DataFrame:
    """The rows of ``children`` without a parent at their time: keys, ``child`` columns, ``at``.

    A parent lives from ``added`` on (inclusive) until ``removed`` (exclusive,
    null means forever). A parent without ``added`` never lives; a child without
    ``at`` or with a null in its keys has no parent and is an orphan. Repeated
    children come back as often as they came.

    One shuffle by key, and the window holds no group in memory. Hot keys are
    split into pieces by the children's own columns; their parents go to each.
    """
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    bad = children.where(~ok | F.col(at).isNull())
    children_ok = children.where(ok & F.col(at).isNotNull())
    hot = skew.hot_keys(children_ok, keys)
    types = dict(children.dtypes)
    nothing = [F.lit(None).cast(types[c]).alias(c) for c in child]
    kids = children_ok.select(*keys, *child, F.col(at).alias("_t"), F.lit(0).alias("_delta"), F.lit(1).alias("_child"), skew.piece(keys, [*child, at], hot).alias("_piece"))
    lives = parents.where(ok & F.col(added).isNotNull() & (F.col(removed).isNull() | (F.col(removed) > F.col(added))))
    ends = F.array(F.struct(F.col(added).alias("t"), F.lit(1).alias("d")), F.struct(F.col(removed).alias("t"), F.lit(-1).alias("d")))
    events = lives.select(*keys, F.explode(ends).alias("e"), skew.all_pieces(keys, hot).alias("_p")).where("e.t is not null")
    events = events.select(*keys, *nothing, F.col("e.t").alias("_t"), F.col("e.d").alias("_delta"), F.lit(0).alias("_child"), F.explode("_p").alias("_piece"))
    w = Window.partitionBy(*keys, "_piece").orderBy("_t", "_child").rowsBetween(Window.unboundedPreceding, 0)
    alive = kids.unionByName(events).withColumn("_alive", F.sum("_delta").over(w))
    found = alive.where("_child = 1 and _alive = 0").select(*keys, *child, F.col("_t").alias(at))
    return found.unionByName(bad.select(*keys, *child, at))


def state_orphans(children: DataFrame, changes: DataFrame, keys: Sequence[str], child: Sequence[str], before: str, seq: str, late: Column, within: Column, live: str) -> DataFrame:
    """Children whose key is not live after all changes with ``seq`` below their ``before``.

    The state of a key is that its last change leaves, in the order (seq, late, within): ``late`` is a flag, ``within`` a
    number below 2**62; a key without changes is not live. Children without ``before`` or
    with a null key are orphans. Changes without flag or order are ignored.

    Changes first combine to one a key and ``seq``, so the group of a hot key
    has no more rows than the table has commits, besides its children; those
    are split into pieces if hot, with the changes in each.
    """
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    kids_ok = children.where(ok & F.col(before).isNotNull())
    hot = skew.hot_keys(kids_ok, keys)
    types = dict(children.dtypes)
    nothing = [F.lit(None).cast(types[c]).alias(c) for c in child]
    # the flag rides in the lowest bit of the order: fixed-width maxima, so hash aggregation with map-side combine
    placed = (within.cast("bigint") * 2 + F.col(live).cast("bigint")).alias("_x")
    states = changes.where(ok & F.col(seq).isNotNull()).select(*keys, F.col(seq).cast("bigint").alias("_t"), late.alias("_late"), placed).where("_x is not null and _late is not null")
    states = states.groupBy(*keys, "_t").agg(F.max(F.when(F.col("_late"), F.col("_x"))).alias("_x1"), F.max(F.when(~F.col("_late"), F.col("_x"))).alias("_x0"))
    states = states.withColumn("_live", F.pmod(F.coalesce("_x1", "_x0"), F.lit(2)).cast("int"))
    states = states.select(*keys, *nothing, "_t", "_live", F.lit(1).alias("_change"), F.explode(skew.all_pieces(keys, hot)).alias("_piece"))
    kids = kids_ok.select(*keys, *child, F.col(before).cast("bigint").alias("_t"), F.lit(None).cast("int").alias("_live"), F.lit(0).alias("_change"), skew.piece(keys, [*child, before], hot).alias("_piece"))
    w = Window.partitionBy(*keys, "_piece").orderBy("_t", "_change").rowsBetween(Window.unboundedPreceding, 0)
    seen = kids.unionByName(states).withColumn("_state", F.last("_live", ignorenulls=True).over(w))
    found = seen.where("_change = 0 and coalesce(_state, 0) = 0").select(*keys, *child, F.col("_t").alias(before))
    return found.unionByName(children.where(~ok | F.col(before).isNull()).select(*keys, *child, F.col(before).cast("bigint").alias(before)))
