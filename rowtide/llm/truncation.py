"""Finding texts that were cut off, and where each source cuts.

The hazard of a length is the share of the texts at least so long that stop there within running text. A field limit
shows as a length whose hazard stands out from those around it; each is tested against its neighbours under
false-discovery control. A transfer that breaks off anywhere leaves no length of its own, so its hazard is spread: over
lengths of one order, and over all, the texts that stop within running text are tested against those that whole texts,
misread, would leave there. A text is cut off if it stops within running text at a length that either test finds; one
that seems to stop so at any other length counts as misread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.session import cut

#: What a cut leaves in place of the rest: dots or an ellipsis, in brackets or not.
MARK = r"(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|…|\.\.\.)$"
#: The end of a sentence, with what may close after it.
STOP = r"[.!?。！？．][\"'”’»)\]）」』]*$"
#: Lines that are no running text: page marks, rules of asterisks, figure labels, tags, notes or formulas in parentheses.
MATTER = r"^(?:-? ?\d+ ?/ ?\d+ ?-?|[*\s]+|(?:FIG|Fig|Abb|Figure|図|图)\.? ?\d+[a-z]?|(?:</?\w+>\s*)+|\(.+\))$"
#: An entry of a list of signs: a number and a name, no sentence.
ITEM = r"^\d+[a-z]?\s+[^.。]*$"
#: A heading above a list is no longer than this.
HEADING = 60
#: What is left at the very end by a character that was cut in its bytes.
BROKEN = "\ufffd"
#: Blanks at the end of a text, those of other scripts included.
BLANKS = " \t\r\n\x0b\x0c\u00a0\u2002\u2003\u2009\u200b\u202f\u3000\ufeff"
#: Lines looked at first; where all of them are closing matter, all lines are.
TAIL = 12

OPEN, MARKED, WHOLE = "open", "marked", "whole"


def _lines(text: Column) -> Column:
    """The lines that are neither blank nor closing matter; entries of lists stay."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: (x != "") & ~x.rlike(MATTER))


def with_ending(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``ending``: open, marked (a mark in place of the rest) or whole; null for null, whole for blank text.

    Only the last line that is running text decides; labels, tags, page marks and lists after it are
    passed over. A short line without stop above list entries is their heading, and the text whole.
    Each step is a column of its own, so that none is evaluated twice.
    """
    run = lambda x: ~x.rlike(ITEM)
    d = df.withColumn("_t", F.rtrim(F.col(text), F.lit(BLANKS)))
    d = d.withColumn("_tail", _lines(F.substring_index("_t", "\n", -TAIL)))
    d = d.withColumn("_lines", F.when(F.exists("_tail", run), F.col("_tail")).otherwise(_lines(F.col("_t"))))
    d = d.withColumn("_last", F.trim(F.regexp_replace(F.try_element_at(F.filter("_lines", run), F.lit(-1)), r"(?:</?\w+>\s*)+$", "")))
    listed = F.try_element_at("_lines", F.lit(-1)).rlike(ITEM)
    ending = (
        F.when(F.col("_t").isNull(), F.lit(None).cast("string"))
        .when(F.substring_index("_t", "\n", -1).rlike(MARK), MARKED)
        .when(F.col("_last").isNull() | (F.col("_last") == "") | F.col("_last").rlike(STOP), WHOLE)
        .when(listed & (F.length("_last") <= HEADING), WHOLE)
        .otherwise(OPEN)
    )
    return d.withColumn("ending", ending).drop("_t", "_tail", "_lines", "_last")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source (lower case), ending, chars, bytes: the measures in which fields may be limited.

    Blanks at the end count, what is left there of a broken character does not. Null texts have null
    measures. The result is narrow and read more than once, so it is materialised: texts are read once.
    """
    d = with_ending(documents.select("doc_id", "source", F.rtrim("text", F.lit(BROKEN)).alias("_kept"), "text"))
    return cut(d.select("doc_id", F.lower(canon.trimmed("source")).alias("source"), "ending", F.length("_kept").alias("chars"), F.octet_length("_kept").alias("bytes")))


#: Width in which each measure is counted: single lengths, and 16 together for cuts at the last word before a limit.
UNITS = (("chars", "chars", 1), ("bytes", "bytes", 1), ("chars16", "chars", 16), ("bytes16", "bytes", 16))
BLOCK = 1024


def _poisson_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= n) for a Poisson variable, by its terms."""
    out = []
    for k, m in zip(n.to_numpy(), mean.to_numpy()):
        if k <= 0 or not np.isfinite(m) or m <= 0:
            out.append(1.0 if k <= 0 else 0.0 if m == 0 else 1.0)
            continue
        term = math.exp(k * math.log(m) - m - math.lgamma(k + 1))
        total, i = 0.0, k
        while term > total * 1e-12 and i < k + 10_000:
            total += term
            i += 1
            term *= m / i
        out.append(min(total, 1.0))
    return pd.Series(out)


def lengths(measures: DataFrame) -> DataFrame:
    """source, unit, length, n, incomplete, at_risk: how many texts end at each length, how many of them within running text, and how many are at least so long.

    ``measures`` is the output of :func:`measured`; blank and null texts do not count. Unit "block" is the length in bytes modulo BLOCK,
    for transfers in whole blocks; all texts are at risk there. Null source is a source.

    Windows run over the counts of lengths of one source and unit, never over texts.
    """
    units = [F.struct(F.lit(u).alias("unit"), F.expr(f"{c} div {w}").cast("bigint").alias("length")) for u, c, w in UNITS]
    units.append(F.struct(F.lit("block").alias("unit"), (F.col("bytes") % BLOCK).cast("bigint").alias("length")))
    bad = F.col("ending").isin(OPEN, MARKED).cast("bigint")
    live = measures.where("chars > 0").select("source", bad.alias("bad"), F.explode(F.array(*units)).alias("m"))
    counts = live.groupBy("source", "m.unit", "m.length").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("incomplete"))
    by = Window.partitionBy("source", "unit")
    down = by.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.when(F.col("unit") == "block", F.sum("n").over(by)).otherwise(F.sum("n").over(down)))


def _discovered(tests: DataFrame, by: Sequence[str], least: int, fdr: float) -> DataFrame:
    """``tests`` (incomplete, expected) with p and significant: Benjamini-Hochberg at ``fdr`` in each group ``by``.

    Rows with fewer than ``least`` incomplete endings are no discovery, but count as tests.
    """
    tail = F.pandas_udf(_poisson_tail, "double")
    t = tests.withColumn("p", F.when(F.col("incomplete") >= least, tail(F.col("incomplete"), F.col("expected"))).otherwise(F.lit(1.0)))
    w = Window.partitionBy(*by)
    rank, of = F.row_number().over(w.orderBy("p")), F.count(F.lit(1)).over(w)
    t = t.withColumn("_under", F.when(F.col("p") <= rank / of * fdr, F.col("p")))
    return t.withColumn("significant", F.coalesce(F.col("p") <= F.max("_under").over(w), F.lit(False)) & (F.col("incomplete") >= least)).drop("_under")


def hazards(measures: DataFrame, reach: int = 40, least: int = 3, fdr: float = 0.001) -> DataFrame:
    """The columns of :func:`lengths` with expected, p, significant, for every length at which texts end.

    The hazard of a length is incomplete / at_risk. Expected is what the larger of the mean hazards within ``reach`` lengths, empty ones
    too, on either side would give: each side by itself, over the lengths that occur at all, so neither a trend nor the ends of the range look
    like a limit. A length that many whole texts share is none either: they are no events. Lengths with ``least`` events or more
    are tested, the false-discovery rate is held to ``fdr`` in each source and unit.
    """
    c = lengths(measures).withColumn("hazard", F.col("incomplete") / F.col("at_risk"))
    by = Window.partitionBy("source", "unit")
    left, right = by.orderBy("length").rangeBetween(-reach, -1), by.orderBy("length").rangeBetween(1, reach)
    most, fewest = F.max("length").over(by), F.min("length").over(by)
    mean = lambda side, room: F.coalesce(F.sum("hazard").over(side), F.lit(0.0)) / F.greatest(F.least(room, F.lit(reach)), F.lit(1))
    beside = F.greatest(mean(left, F.col("length") - fewest), mean(right, most - F.col("length")))
    # half a text keeps empty sides from having no hazard at all
    c = c.withColumn("expected", F.col("at_risk") * F.greatest(beside, 0.5 / (F.col("at_risk") * reach)))
    return _discovered(c, ["source", "unit"], least, fdr).drop("hazard")


def limits(measures: DataFrame, **how: float) -> DataFrame:
    """source, unit, length, n, incomplete, expected, p of the significant lengths."""
    return hazards(measures, **how).where("significant").select("source", "unit", "length", "n", "incomplete", "expected", "p")


#: Spans over which break-offs are looked for: lengths of one order (powers of two), and all lengths.
ORDERS, EVERY = "order", "every"


def _spans() -> Column:
    order = F.struct(F.lit(ORDERS).alias("span"), F.floor(F.log2("chars")).cast("bigint").alias("at"))
    return F.array(order, F.struct(F.lit(EVERY).alias("span"), F.lit(0).cast("bigint").alias("at")))


def break_offs(measures: DataFrame, unlimited: DataFrame, misread: float = 0.002, least: int = 3, fdr: float = 0.001) -> DataFrame:
    """source, span, at, n, incomplete, expected, p, significant: where texts break off without a limit.

    ``unlimited`` are the texts of ``measures`` with incomplete endings at no limit. In each span of lengths they are tested against
    what the whole texts that end there would leave if a share of ``misread`` of them only looked incomplete; the false-discovery rate is
    held to ``fdr`` in each source. Too few to tell from misread ones are none.
    """
    count = lambda df, name: df.where("chars > 0").select("source", F.explode(_spans()).alias("s")).groupBy("source", "s.span", "s.at").agg(F.count(F.lit(1)).alias(name))
    some = count(unlimited, "incomplete").select(F.col("source").alias("_s"), F.col("span").alias("_span"), F.col("at").alias("_at"), "incomplete")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("span") == F.col("_span")) & (F.col("at") == F.col("_at"))
    tests = count(measures, "n").join(some, same, "left").drop("_s", "_span", "_at").fillna({"incomplete": 0})
    return _discovered(tests.withColumn("expected", F.col("n") * misread), ["source"], least, fdr)


def truncated(documents: DataFrame, misread: float = 0.002, **how: float) -> DataFrame:
    """doc_id, source, ending, at_limit of every text that is cut off: an incomplete ending at a significant length or in a significant span.

    Null and blank texts are whole. Extra columns are ignored; repeated documents come back as often.
    The limits and spans, a few a source, are turned into one row a source before they are joined.
    """
    m = measured(documents)
    name = lambda a, b: F.concat_ws(":", a, F.col(b).cast("string"))
    per = limits(m, **how).groupBy("source").agg(F.collect_set(name("unit", "length")).alias("limits")).withColumnRenamed("source", "_s")
    spelled = [F.concat(F.lit(f"{u}:"), F.expr(f"{c} div {w}").cast("string")) for u, c, w in UNITS] + [F.concat(F.lit("block:"), (F.col("bytes") % BLOCK).cast("string"))]
    # only incomplete endings are joined, so the large majority is never moved
    cuttable = m.where(F.col("ending").isin(OPEN, MARKED) & (F.col("chars") > 0))
    at = cut(cuttable.join(per, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("at_limit", F.coalesce(F.arrays_overlap("limits", F.array(*spelled)), F.lit(False))).drop("_s", "limits"))
    found = break_offs(m, at.where("not at_limit"), misread, **{k: v for k, v in how.items() if k in ("least", "fdr")}).where("significant")
    spans = found.groupBy("source").agg(F.collect_set(name("span", "at")).alias("spans")).withColumnRenamed("source", "_s")
    mine = F.transform(_spans(), lambda x: F.concat_ws(":", x["span"], x["at"].cast("string")))
    out = at.join(spans, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.where(F.col("at_limit") | F.coalesce(F.arrays_overlap("spans", mine), F.lit(False))).select("doc_id", "source", "ending", "at_limit")


def rates(documents: DataFrame, **how: float) -> DataFrame:
    """source, documents, truncated, at_limit, rate for every source, null included; rate over all its documents."""
    cut_ = truncated(documents, **how).groupBy("source").agg(F.count(F.lit(1)).alias("truncated"), F.sum(F.col("at_limit").cast("int")).alias("at_limit")).withColumnRenamed("source", "_s")
    every = documents.groupBy(F.lower(canon.trimmed("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    g = every.join(cut_, F.col("source").eqNullSafe(F.col("_s")), "left").fillna({"truncated": 0, "at_limit": 0})
    return g.select("source", "documents", "truncated", "at_limit", (F.col("truncated") / F.col("documents")).alias("rate"))
