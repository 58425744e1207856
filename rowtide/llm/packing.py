"""Filling containers of fixed capacity: shortest pack first over the length histogram."""

from __future__ import annotations

from collections.abc import Mapping
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.operators import skew

def pack_histogram(counts: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Packing patterns: (how many items of each length, how many containers of that kind).

    Lengths go longest first. Each goes to the containers with the most room
    left, one to each at a time; only when none has room, new ones are opened,
    filled with as many items of the length as they hold. Cost depends on the
    number of lengths and patterns, not of items.
    """
    room: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(left: int, pattern: dict[int, int], n: int) -> None:
        if left not in room:
            room[left] = []
            heappush(heap, -left)
        room[left].append([pattern, n])

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        n = counts[length]
        while n:
            if not heap or -heap[0] < length:
                each = min(capacity // length, n)
                packs, n = divmod(n, each)
                put(capacity - each * length, {length: each}, packs)
                if n:
                    put(capacity - n * length, {length: n}, 1)
                    n = 0
                break
            left = -heap[0]
            pattern, have = room[left].pop()
            if not room[left]:
                heappop(heap)
                del room[left]
            use = min(have, n)
            n -= use
            put(left - length, {**pattern, length: pattern.get(length, 0) + 1}, use)
            if have > use:
                put(left, pattern, have - use)
    return [(p, n) for groups in room.values() for p, n in groups]


def _places(patterns: list[tuple[dict[int, int], int]]) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length the rank ranges it is placed in: (first rank, first container, items in each container)."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    upto: dict[int, int] = {}
    first = 0
    for pattern, n in patterns:
        for length, each in pattern.items():
            places.setdefault(length, []).append((upto.get(length, 0), first, each))
            upto[length] = upto.get(length, 0) + each * n
        first += n
    return places, first


def pieces(sizes: DataFrame, item: str, size: str, capacities: dict[int, int]) -> DataFrame:
    """container_kind, capacity, item, piece, start, length for every kind of container.

    An item is one piece unless it exceeds the capacity; then all pieces but the last are full.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(capacities.items())])
    each = sizes.select(F.col(item).alias("item"), F.col(size).alias("size"), F.explode(kinds).alias("k")).select("item", "size", "k.*")
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("bigint") - 1, F.lit(0).cast("bigint"))
    cut_ = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece") * F.col("capacity")
    return cut_.select("container_kind", "capacity", "item", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("size") - start, F.col("capacity")).alias("length"))


def pack(sizes: DataFrame, capacities: dict[int, int], item: str = "doc_id", size: str = "tokens") -> DataFrame:
    """container_kind, container_id, ``item``, piece, start, length: where every piece of every item goes.

    ``capacities`` gives the capacity of each container kind. Items without size
    (null) are in no container: container_id is null; those of size 0 take
    no room and are spread over the containers (container 0 if there is none).
    Repeated items are placed as often as they come. Only the length
    histogram, at most the sum of the capacities, comes to the driver; items
    find their place by their rank among those of their length. Ranks are counted in
    slices, as many as leave skew.ROWS of all pieces in each, so a length that most items share is not one task's work.

    ``sizes`` is read three times; materialise it if it is costly.
    """
    cut_ = pieces(sizes.where(F.col(size).isNotNull()), item, size, capacities)
    cut_ = cut_.withColumn("slice", F.pmod(F.xxhash64("item", "piece"), F.lit(skew.pieces_of(cut_.count()))))
    counts = cut_.groupBy("container_kind", "length", "slice").agg(F.count(F.lit(1)).alias("n"))
    hist: dict[int, dict[int, int]] = {k: {} for k in capacities}
    for r in counts.groupBy("container_kind", "length").agg(F.sum("n").alias("n")).collect():
        hist[r.container_kind][r.length] = r.n
    # the places of all kinds and lengths, one after another: a sorted key finds the one of a rank
    ends, base, start, first, each = {}, {}, [], [], []
    for kind, capacity in sorted(capacities.items()):
        places, used = _places(pack_histogram({k: v for k, v in hist[kind].items() if k}, capacity))
        places[0] = [(0, 0, 0)]
        base[kind] = max(used, 1)
        for length, ranges in places.items():
            ends[kind, length] = len(start), len(start) + len(ranges)
            for s, f, e in sorted(ranges):
                start.append(s), first.append(f), each.append(e)
    starts, firsts, eaches = (np.array(x, dtype=np.int64) for x in (start, first, each))

    @F.pandas_udf("bigint")
    def container(kind: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(kind), dtype=np.int64)
        for (k, n), at in pd.DataFrame({"k": kind, "n": length}).groupby(["k", "n"]).indices.items():
            a, b = ends[k, n]
            r = rank.to_numpy()[at]
            if n == 0:
                out[at] = r % base[k]
                continue
            i = a + np.searchsorted(starts[a:b], r, side="right") - 1
            out[at] = firsts[i] + (r - starts[i]) // eaches[i]
        return pd.Series(out)

    before = Window.partitionBy("container_kind", "length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("container_kind", "length", "slice").orderBy("item", "piece")
    ranked = cut_.withColumn("rn", F.row_number().over(within)).join(offsets, ["container_kind", "length", "slice"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)
    placed = ranked.select("container_kind", container("container_kind", "length", "rank").alias("container_id"), F.col("item").alias(item), "piece", "start", "length")
    kinds = F.explode(F.array(*[F.lit(k) for k in sorted(capacities)])).alias("container_kind")
    none = F.lit(None).cast("bigint")
    without = sizes.where(F.col(size).isNull()).select(kinds, none.alias("container_id"), F.col(item).alias(item), F.lit(None).cast("int").alias("piece"), none.alias("start"), none.alias("length"))
    return placed.unionByName(without)


def usage(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """container_kind, containers, tokens, capacity, used: the share of the room that is filled."""
    table = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(c).cast("bigint"))])
    g = packed.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("length").alias("tokens"))
    g = g.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return g.withColumn("capacity", table[F.col("container_kind")]).withColumn("used", F.col("tokens") / (F.col("capacity") * F.col("containers")))
