"""Queries of problems 6 to 8, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.llm import mixing, packing, tokens, truncation
from rowtide.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    """The kinds of container; pack_containers is a fixed table of a few rows."""
    return {r.container_kind: r.capacity_tokens for r in _table(spark, d, "pack_containers").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()}


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """doc_id, tokens and ``columns``: narrow, and used more than once, so materialised."""
    docs = _table(spark, d, "documents").select("doc_id", "text", *columns)
    return cut(tokens.with_tokens(docs))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), _capacities(spark, d))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p6_pack(spark, d), _capacities(spark, d))


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """What every packing has to keep: container_kind, placed and unplaced texts, overfull containers, texts divided without need or with a part missing."""
    sizes, kinds = _sizes(spark, d), _capacities(spark, d)
    packed = cut(packing.pack(sizes, kinds))
    capacity = F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), F.lit(c))])[F.col("container_kind")]
    loads = packed.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("length").alias("load"))
    overfull = loads.groupBy("container_kind").agg(F.count(F.when(F.col("load") > capacity, 1)).alias("overfull"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.sum("length").alias("length"), F.count("piece").alias("pieces")).join(sizes, "doc_id")
    fewest = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    broken = F.count(F.when((F.col("pieces") > fewest) | ~F.col("length").eqNullSafe(F.col("tokens")), 1))
    g = texts.groupBy("container_kind").agg(F.count("tokens").alias("placed"), F.count(F.when(F.col("tokens").isNull(), 1)).alias("unplaced"), broken.alias("broken"))
    return g.join(overfull, "container_kind")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "source"), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_selection(spark, d), _table(spark, d, "mix_targets"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What every mix has to keep: for each target, whether the share is off by more than a hundredth, and whether a cap is exceeded."""
    shares = mixing.shares(p7_selection(spark, d), _table(spark, d, "mix_targets"))
    caps = mixing.plan(_sizes(spark, d, "source").withColumn("source", canon.label("source")), _table(spark, d, "mix_targets")).select("mix_id", "source", "cap")
    off = F.abs(F.col("actual_share") - F.col("target_share")) > 0.01
    return shares.join(caps, ["mix_id", "source"]).select("mix_id", "source", off.alias("off"), F.coalesce(F.col("most_copies") > F.col("cap"), F.lit(False)).alias("over"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_table(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_table(spark, d, "documents").select("doc_id", "text", "source"))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.limits(truncation.measured(_table(spark, d, "documents").select("doc_id", "text", "source"))).select("source", "unit", "length", "n", "incomplete")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The counts that the hazards are made of."""
    return truncation.lengths(truncation.measured(_table(spark, d, "documents").select("doc_id", "text", "source")))


def p8_endings(spark: SparkSession, d: str) -> DataFrame:
    """How every text ends."""
    return truncation.with_ending(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ending")


QUERIES = {f.__name__: f for f in (p6_pack, p6_usage, p6_placed, p7_selection, p7_shares, p7_kept, p8_found, p8_rates, p8_limits, p8_lengths, p8_endings)}

def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("'", "''") + "'"


_BLANKS = " || ".join([_text(" "), *(f"chr({ord(c)})" for c in truncation.BLANKS if c != " ")])
_ENDINGS = f"""
WITH b AS (SELECT {_BLANKS} AS blanks), t AS (SELECT doc_id, rtrim(text, blanks) AS t, blanks FROM documents, b),
l AS (SELECT doc_id, t, [y for y in [trim(x, blanks) for x in string_split(t, chr(10))] if y <> '' AND NOT regexp_matches(y, {_text(truncation.MATTER)})] AS lines FROM t),
r AS (SELECT doc_id, t, lines, trim(regexp_replace([x for x in lines if NOT regexp_matches(x, {_text(truncation.ITEM)})][-1], {_text(r"(?:</?\w+>\s*)+$")}, '')) AS last FROM l)
SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN regexp_matches(string_split(t, chr(10))[-1], {_text(truncation.MARK)}) THEN 'marked' WHEN last IS NULL OR last = '' OR regexp_matches(last, {_text(truncation.STOP)}) THEN 'whole'
  WHEN regexp_matches(lines[-1], {_text(truncation.ITEM)}) AND length(last) <= {truncation.HEADING} THEN 'whole' ELSE 'open' END AS ending FROM r
"""

_UNITS = " UNION ALL ".join(f"SELECT source, bad, '{u}' AS unit, {c} // {w} AS length FROM m" for u, c, w in truncation.UNITS)
_LENGTHS = f"""
WITH e AS ({_ENDINGS}), m AS (SELECT lower(trim(source)) AS source, length(rtrim(text, chr({ord(truncation.BROKEN)}))) AS chars, strlen(rtrim(text, chr({ord(truncation.BROKEN)}))) AS bytes,
  CASE WHEN ending IN ('open', 'marked') THEN 1 ELSE 0 END AS bad FROM documents JOIN e USING (doc_id) WHERE length(rtrim(text, chr({ord(truncation.BROKEN)}))) > 0),
u AS ({_UNITS} UNION ALL SELECT source, bad, 'block', bytes % {truncation.BLOCK} FROM m),
g AS (SELECT source, unit, length, count(*) AS n, CAST(sum(bad) AS BIGINT) AS incomplete FROM u GROUP BY 1, 2, 3)
SELECT source, unit, length, n, incomplete, CAST(CASE unit WHEN 'block' THEN sum(n) OVER (PARTITION BY source, unit) ELSE sum(n) OVER (PARTITION BY source, unit ORDER BY length DESC) END AS BIGINT) AS at_risk FROM g
"""

#: Token counts, random rounding and significance tests are beyond SQL; those queries are tested by brute force.
SQL = {
    "p6_placed": "SELECT container_kind, count(text) AS placed, count(*) - count(text) AS unplaced, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS broken FROM documents, pack_containers GROUP BY 1",
    "p7_kept": "SELECT DISTINCT mix_id, upper(trim(source)) AS source, false AS off, false AS over FROM mix_targets",
    "p8_endings": _ENDINGS,
    "p8_lengths": _LENGTHS,
}
