"""Finding hot keys by their counts, and splitting them so that no task gets more than a stated number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may get (about 200 MB at 100 bytes a row). A key with more is hot and split.
ROWS = 2_000_000
#: Counters of the first look. Only buckets that hold more than ROWS rows are looked at key by key.
BUCKETS = 8192


@dataclass(frozen=True)
class Hot:
    """The hashes of the hot keys, by the number of pieces each is split into (powers of two)."""

    by_pieces: dict[int, list[int]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.by_pieces)


NONE = Hot()


def key_hash(keys: Sequence[Column | str]) -> Column:
    return F.xxhash64(*keys)


def pieces_of(rows: int, most: int | None = None) -> int:
    """The power of two that leaves at most ``most`` (ROWS) of so many rows in each piece."""
    n = 1
    while n * (most or ROWS) < rows:
        n *= 2
    return n


def hot_keys(df: DataFrame, keys: Sequence[Column | str], most: int | None = None) -> Hot:
    """The keys of ``df`` that have more than ``most`` (ROWS) rows, each with as many pieces as its count asks for.

    Nothing here depends on a share of the input: the bound is rows a task, at any size. A first pass counts in BUCKETS
    counters, of which each task sends at most BUCKETS; if none exceeds the bound, no key can, and that was all. Else
    the keys of the buckets beyond it are counted one by one (16 bytes a key and task, combined before the shuffle). The
    driver receives the hot ones only: at most one for each ``most`` rows of the input.
    """
    most = most or ROWS
    hashed = df.select(key_hash(keys).alias("h"))
    of = F.pmod(F.col("h"), F.lit(BUCKETS))
    full = sorted(r.b for r in hashed.groupBy(of.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect())
    if not full:
        return NONE
    within = hashed.where(of.isin(full)) if len(full) < BUCKETS else hashed
    out: dict[int, list[int]] = {}
    for r in within.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect():
        out.setdefault(pieces_of(r.n, most), []).append(r.h)
    return Hot({n: sorted(hs) for n, hs in sorted(out.items())})


def is_hot(keys: Sequence[Column | str], hot: Hot) -> Column:
    every = sorted(h for hs in hot.by_pieces.values() for h in hs)
    return key_hash(keys).isin(every) if every else F.lit(False)


def _by_pieces(keys: Sequence[Column | str], hot: Hot, what, otherwise: Column) -> Column:
    out = None
    for n, hashes in hot.by_pieces.items():
        hit = key_hash(keys).isin(hashes)
        out = F.when(hit, what(n)) if out is None else out.when(hit, what(n))
    return otherwise if out is None else out.otherwise(otherwise)


def piece(keys: Sequence[Column | str], by: Sequence[Column | str], hot: Hot) -> Column:
    """0 for rows of cold keys; for hot ones a number below their pieces, from the hash of ``by``."""
    spread = F.xxhash64(*by)
    return _by_pieces(keys, hot, lambda n: F.pmod(spread, F.lit(n)).cast("int"), F.lit(0))


def all_pieces(keys: Sequence[Column | str], hot: Hot) -> Column:
    """The pieces that rows matching ``keys`` may be in: the other side of a split join explodes this."""
    return _by_pieces(keys, hot, lambda n: F.sequence(F.lit(0), F.lit(n - 1)), F.array(F.lit(0)))


def join(big: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``keys`` (one row a key there); hot keys of ``big`` are split by the hash of ``by``.

    ``how`` is inner, left or left_semi. Null keys match nothing.
    """
    hot = hot_keys(big, keys)
    if not hot:
        return big.join(small, list(keys), how)
    cut_ = big.withColumn("_split", piece(keys, by, hot))
    copies = small.withColumn("_split", F.explode(all_pieces(keys, hot)))
    return cut_.join(copies, [*keys, "_split"], how).drop("_split")
