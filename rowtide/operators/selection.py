"""Per-key results without gathering the values of hot keys: distributed exact selection.

Ranks are found by refining value histograms: each round counts the rows of
every still open interval in bins, merges the counts, and narrows each rank
to the bin that holds it, until the bin has a single value. A task sends
counts only, so a key that holds a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.operators import skew
from rowtide.session import cut

#: Open intervals up to this number (times a few dozen bytes) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000


def _narrowed(open_: DataFrame, hist: DataFrame, group: str, on: Sequence[str], least: str | None) -> DataFrame:
    """Each open target with the bin that its rank falls into: lo, hi, below, n (known once the bin has one value).

    Targets and bins go through one window in order of rank, so many targets and many bins of a group never meet as pairs.
    """
    upto = hist.withColumn("upto", F.sum("c").over(Window.partitionBy(*on).orderBy("v0").rowsBetween(Window.unboundedPreceding, 0)))
    bins = upto.select(*on, F.col("upto").alias("_at"), F.struct("c", "v0", "v1", "upto").alias("_bin"))
    targets = open_.select(*on, (F.col("rank") - F.col("below")).alias("_at"), F.struct(*open_.columns).alias("_target"))
    # from the top down: the last bin seen is the first that reaches the rank
    w = Window.partitionBy(*on).orderBy(F.col("_at").desc(), F.col("_target").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = bins.unionByName(targets, allowMissingColumns=True).withColumn("_hit", F.last("_bin", ignorenulls=True).over(w)).where("_target is not null and _hit is not null")
    rest = [c for c in open_.columns if c not in (group, "rank", "lo", "hi", "below", "n")]
    t, b = (lambda c: F.col(f"_target.{c}")), (lambda c: F.col(f"_hit.{c}"))
    step = met.select(
        t(group).alias(group), t("rank").alias("rank"), b("v0").alias("lo"), b("v1").alias("hi"), *[t(c).alias(c) for c in rest],
        (t("below") + b("upto") - b("c")).alias("below"), F.when(b("v0") == b("v1"), b("c")).alias("n"), b("c").alias("_c"),
    )
    return (step if least is None else step.where(F.col("_c") >= F.col(least))).drop("_c")


def select_ranks(df: DataFrame, group: str, value: str, targets: DataFrame, bins: int = 1024, least: str | None = None, first: DataFrame | None = None) -> DataFrame:
    """The value at each target's rank in its group.

    ``df`` has a struct column ``group`` (structs compare null-safely) and a
    bigint ``value`` without nulls, whose range in a group is below 2**62.
    ``targets`` has group, rank (1-based), lo, hi (bounds of the group's
    values), and any extra columns, which come back. ``least`` names a column
    of targets: a target is dropped as soon as its bin has fewer rows, for
    callers that look only for values with at least so many. ``first`` is a histogram the caller has
    already (group, c, v0, v1: count, least and largest value of each bin), which saves the first round.
    Returns targets with value and n, the number of rows equal to it.

    While the open intervals are few they are broadcast and every task sends counts only. When they are
    many the rows meet them by shuffle, where groups of more than skew.ROWS rows are split.
    """
    extra = [c for c in targets.columns if c not in (group, "rank", "lo", "hi")]
    state = targets.select(group, "rank", "lo", "hi", *extra, F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("n"))
    state = cut(state if first is None else _narrowed(state, first, group, [group], least))
    done: list[DataFrame] = []
    hot: skew.Hot | None = None
    while True:
        is_open = F.col("n").isNull()
        open_ = state.where(is_open)
        # bounded by what decides between broadcast and shuffle
        size = open_.select(group, "lo", "hi").distinct().limit(BROADCAST_ROWS + 1).count()
        done.append(state.where(~is_open))
        if size == 0:
            break
        spans, source, on = open_.select(group, "lo", "hi").distinct(), df.select(group, value), [group]
        if size <= BROADCAST_ROWS:
            spans = F.broadcast(spans)
        else:
            hot = skew.hot_keys(df, [F.col(group)]) if hot is None else hot
            if hot:
                on = [group, "_piece"]
                source = source.withColumn("_piece", skew.piece([F.col(group)], [F.monotonically_increasing_id()], hot))
                spans = spans.withColumn("_piece", F.explode(skew.all_pieces([F.col(group)], hot)))
        width = F.expr(f"(hi - lo) div {bins} + 1")
        binned = source.join(spans, on).where(F.col(value).between(F.col("lo"), F.col("hi")))
        hist = (
            binned.groupBy(group, "lo", "hi", ((F.col(value) - F.col("lo")) / width).cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("c"), F.min(value).alias("v0"), F.max(value).alias("v1"))
        )
        state = cut(_narrowed(open_, hist, group, [group, "lo", "hi"], least))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(group, "rank", *extra, F.col("lo").alias("value"), "n")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], bins: int = 1024) -> DataFrame:
    """keys, prob, rows, value: the smallest value with at least ``prob`` of the group's rows at or below it.

    ``value`` is an integer, date or timestamp column; nulls do not count, groups
    without any value give no row, null keys form a group. The type comes back.
    """
    kind = dict(df.dtypes)[value]
    long = {"timestamp": F.unix_micros(F.col(value)), "timestamp_ntz": F.unix_micros(F.col(value).cast("timestamp")), "date": F.unix_date(F.col(value)).cast("bigint")}.get(kind, F.col(value).cast("bigint"))
    back = {"timestamp": F.timestamp_micros("value"), "timestamp_ntz": F.timestamp_micros("value").cast("timestamp_ntz"), "date": F.date_from_unix_date(F.col("value").cast("int"))}.get(kind, F.col("value").cast(kind))
    rows = df.select(F.struct(*keys).alias("_g"), long.alias("_v")).where("_v is not null")
    ends = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("rows"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    p = F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("prob")
    targets = ends.select("_g", "rows", "lo", "hi", p).withColumn("rank", F.greatest(F.ceil(F.col("prob") * F.col("rows")).cast("bigint"), F.lit(1).cast("bigint")))
    found = select_ranks(rows, "_g", "_v", targets, bins)
    return found.select(*[F.col(f"_g.{k}").alias(k) for k in keys], "prob", "rows", back.alias("value"))


def exact_share(share: Fraction | float) -> Fraction:
    """``share`` as the fraction that is meant: 0.05 is 1/20. It must be above 0, and its terms below 10**18, so products stay exact."""
    f = share if isinstance(share, Fraction) else Fraction(str(share))
    if f <= 0 or max(f.numerator, f.denominator) >= 10**18:
        raise ValueError(f"not a usable share: {share}")
    return f


def heavy_values(df: DataFrame, keys: Sequence[str], value: str, share: Fraction | float | tuple[str, Mapping[str, Fraction]], bins: int = 1024) -> DataFrame:
    """keys, ``value``, n: values that more than ``share`` of their group's rows have.

    ``share`` may be a key column and the share for each of its values; groups of other values give
    nothing. Rows with a null value count for the group but give no result; null keys
    form a group. A value with more than share * rows covers at least one of
    the ranks ceil(j * rows * share): so selecting those ranks, over the values'
    hashes, gives every such value, and nothing else has to be counted. The value
    of a hash is then read from the rows of the few hashes left; should two
    values share one, they are counted apart.

    Three passes in all, of which each task sends counts only: hashes have a known range, so the first histogram needs no bounds
    and also tells the rows of each group.
    """
    if isinstance(share, tuple):
        column, parts = share[0], {k: exact_share(v) for k, v in share[1].items()}
        pick = lambda what: F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.lit(what(v)).cast("decimal(19,0)"))])[F.col(f"_g.{column}")]
    else:
        one = exact_share(share)
        pick = lambda what: F.lit(what(one)).cast("decimal(19,0)")
    hashed = df.select(F.struct(*keys).alias("_g"), F.when(F.col(value).isNotNull(), F.shiftrightunsigned(F.xxhash64(value), 2)).alias("_h"))
    top = (1 << 62) - 1
    # nulls are in a bin of their own, which only the total counts
    hist = cut(hashed.groupBy("_g", F.coalesce(F.expr(f"_h div {top // bins + 1}"), F.lit(-1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_h").alias("v0"), F.max("_h").alias("v1")))
    ends = hist.groupBy("_g").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("bin") >= 0, F.col("c"))).alias("rows"))
    ends = ends.where("rows > 0").withColumn("up", pick(lambda f: f.numerator)).withColumn("down", pick(lambda f: f.denominator)).where("up is not null")
    step = F.explode(F.expr("sequence(1L, cast((down + up - 1) div up as bigint))")).alias("j")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    targets = (
        ends.withColumns({"_total": exact("total"), "_rows": exact("rows")})
        .select("_g", "rows", "_rows", "up", "down", F.expr("cast(_total * up div down + 1 as bigint)").alias("least"), step)
        .withColumn("_upto", (F.col("j").cast("decimal(19,0)") * F.col("up")).cast("decimal(19,0)"))
        .withColumn("rank", F.least(F.expr("cast((_upto * _rows + down - 1) div down as bigint)"), F.col("rows")))
        .select("_g", "rank", F.lit(0).cast("bigint").alias("lo"), F.lit(top).alias("hi"), "least").distinct()
    )
    first = hist.where("bin >= 0").select("_g", "c", "v0", "v1")
    found = cut(select_ranks(hashed.where("_h is not null"), "_g", "_h", targets, bins, "least", first).select("_g", F.col("value").alias("_h"), "least").distinct())
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    back = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.shiftrightunsigned(F.xxhash64(value), 2).alias("_h"), F.col(value).alias("_value"))
    on = ["_g", "_h"]
    if few:
        found = F.broadcast(found)
    elif hot := skew.hot_keys(back, on):
        on.append("_piece")
        back = back.withColumn("_piece", skew.piece(["_g", "_h"], [F.monotonically_increasing_id()], hot))
        found = found.withColumn("_piece", F.explode(skew.all_pieces(["_g", "_h"], hot)))
    named = back.join(found, on).groupBy("_g", "_value").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    return named.where("n >= least").select(*[F.col(f"_g.{k}").alias(k) for k in keys], F.col("_value").alias(value), "n")


def key_stats(df: DataFrame, keys: Sequence[str], distinct: Sequence[Column], latest: Sequence[str]) -> DataFrame:
    """keys, rows, keys_distinct, and the ``latest`` columns of the largest such row.

    Two combining aggregations: the first on the keys and the distinct columns
    spreads a hot key over its distinct values, the second adds up one row for
    each. Null keys form a group; distinct values with a null count as a value.
    """
    fine = df.groupBy(*keys, F.struct(*distinct).alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*latest)).alias("_l"))
    g = fine.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.max("_l").alias("_l"))
    return g.select(*keys, "rows", "distinct_keys", *[F.col(f"_l.{c}").alias(f"latest_{c}") for c in latest])
