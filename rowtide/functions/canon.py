"""Canonical spellings of keys, paths and labels, as column expressions.

All are plain JVM expressions, so filters and joins on them stay inside
whole-stage code generation. Null stays null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Blanks that may surround a value.
BLANKS = " \t\r\n"


def trimmed(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(BLANKS))


def hex_key(c: Column | str) -> Column:
    """Hex text without the blanks around it, in lower case."""
    return F.lower(trimmed(c))


def partition_key(c: Column | str) -> Column:
    """Like :func:`hex_key`; null is the key of an unpartitioned table, ``''``."""
    return F.coalesce(hex_key(c), F.lit(""))


def file_path(c: Column | str) -> Column:
    """``s3a`` becomes ``s3``; repeated slashes become one, but for the two after the scheme.

    Most paths are canonical already, and a plain search tells so; only the
    others go through the patterns. The look-behind keeps the scheme's own
    slashes, which the first replacement has already brought to two.
    """
    p = trimmed(c)
    one = F.regexp_replace(p, r"^(?i:s3a?):/+", "s3://")
    return F.when(p.startswith("s3://") & ~F.substring(p, 6, 1 << 30).contains("//") & ~F.substring(p, 6, 1).eqNullSafe("/"), p).otherwise(F.regexp_replace(one, r"(?<=[^:/])/{2,}", "/"))


def label(c: Column | str) -> Column:
    """Upper case without surrounding blanks (``op``, ``status``, ``source``)."""
    return F.upper(trimmed(c))


def id_set(c: Column | str) -> Column:
    """A sorted array of the distinct ids, so equal sets compare equal; null stays null."""
    return F.array_sort(F.array_distinct(col(c)))


def kind_order(c: Column | str) -> Column:
    """0 for EQ_DEL, 1 for DATA, null for anything else: the order within one sequence number."""
    k = label(c)
    return F.when(k == "EQ_DEL", F.lit(0)).when(k == "DATA", F.lit(1))


def leaves_row(op: Column | str) -> Column:
    """True for +I and +U, false for -U and -D, long names included; null if unknown."""
    o = label(op)
    return F.when(o.isin("+I", "+U", "INSERT", "UPDATE_AFTER"), F.lit(True)).when(
        o.isin("-U", "-D", "UPDATE_BEFORE", "DELETE"), F.lit(False)
    )
