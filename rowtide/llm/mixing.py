"""Mixing sources to target shares by pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.session import cut

#: Items of one leaf of the reduction tree, and residuals that one inner node takes.
LEAF, FAN = 20_000, 1_000


def pivot(weight: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> int | None:
    """Rounds ``mass`` in place to 0 or ``weight``, but for one item at most; returns that one.

    Items meet in pairs; mass goes from one to the other until either is empty
    or full, in the direction that keeps every item's expected mass. The sum never changes.
    """
    carry = None
    draws = rng.random(len(mass))
    for i in range(len(mass)):
        if mass[i] <= 0 or mass[i] >= weight[i]:
            continue
        if carry is None:
            carry = i
            continue
        j = carry
        up, down = min(weight[i] - mass[i], mass[j]), min(mass[i], weight[j] - mass[j])
        step = up if draws[i] * (up + down) < down else -down
        mass[i] += step
        mass[j] -= step
        carry = None
        for k in (i, j):
            near = 1e-9 * weight[k]
            if mass[k] < near:
                mass[k] = 0.0
            elif mass[k] > weight[k] - near:
                mass[k] = weight[k]
            else:
                carry = k
    return carry


STATE = "mix_id int, source string, node bigint, doc_id bigint, tokens bigint, whole bigint, part double, open boolean"


def _node(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    # long texts first, so that the one left open at the end is most likely short
    pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    key = f"{seed}/{pdf.mix_id[0]}/{pdf.source[0]}/{pdf.node[0]}/{len(pdf)}"
    weight = pdf.tokens.to_numpy(float)
    mass = weight * pdf.part.to_numpy(float)
    left = pivot(weight, mass, np.random.default_rng(zlib.crc32(key.encode())))
    pdf["part"], pdf["open"] = mass / weight, False
    if left is not None:
        pdf.loc[left, "open"] = True
    return pdf


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share, cap, docs, source_tokens, copies: expected copies of each text.

    The mix is as large as the caps allow: the smallest of max_repeats * tokens
    / share over the capped sources; without caps it has as many tokens as its sources. A
    source without tokens, or with a cap of 0 or less, cannot contribute: it has no copies, and the others keep
    their proportions. A share that is null or not above 0 gives no copies. Repeated
    target rows of a source in a mix count once (the largest share and cap; no cap is the largest).
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("source_tokens"))
    goal = targets.groupBy("mix_id", canon.label("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.when(F.count("max_repeats") == F.count(F.lit(1)), F.max("max_repeats")).alias("cap"))
    g = goal.join(per, "source", "left").withColumn("live", (F.col("target_share") > 0) & (F.col("source_tokens") > 0) & (F.col("cap").isNull() | (F.col("cap") > 0)))
    w = Window.partitionBy("mix_id")
    limit = F.min(F.when(F.col("live") & F.col("cap").isNotNull(), F.col("cap") * F.col("source_tokens") / F.col("target_share"))).over(w)
    total = F.coalesce(limit, F.sum(F.when(F.col("live"), F.col("source_tokens"))).over(w).cast("double"))
    copies = F.when(F.col("live"), F.least(total * F.col("target_share") / F.col("source_tokens"), F.col("cap").cast("double"))).otherwise(0.0)
    return g.select("mix_id", "source", "target_share", "cap", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), copies.alias("copies"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """mix_id, source, doc_id, tokens, copies: each chosen text with how often it comes.

    ``sizes`` has doc_id, source, tokens. Sources compare without case and
    blanks. Texts without tokens (null or 0), of null source or of a source in no target
    are in no mix. Every text gets the whole part of its expected copies, and one more
    with its fractional part as probability; those are rounded by the pivotal
    method weighted by tokens, so each source's tokens are exact but for one text.
    Repeated rows are texts of their own.

    Leaves of about LEAF texts are rounded in parallel; each leaves at most one
    open text, and the open ones go up a tree of FAN children a node until one is
    left for each mix and source; it is drawn last. So no source, however large, is one task's.
    ``targets`` is read as a table of fixed size: more than 10,000 rows are joined by shuffle.
    """
    sizes = sizes.select("doc_id", canon.label("source").alias("source"), "tokens").where("tokens > 0 and source is not null")
    rates = cut(plan(sizes, targets))
    small = rates.limit(10_001).count() <= 10_000
    most = rates.agg(F.max("docs")).first()[0] or 0
    chosen = rates.where("copies > 0").select("mix_id", "source", "copies", "docs")
    nodes = F.ceil(F.col("docs") / F.lit(LEAF)).cast("bigint")
    rows = sizes.join(F.broadcast(chosen) if small else chosen, "source").select(
        F.col("mix_id").cast("int").alias("mix_id"), "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), nodes).alias("node"), "doc_id", "tokens",
        F.floor("copies").cast("bigint").alias("whole"), (F.col("copies") - F.floor("copies")).alias("part"), F.lit(True).alias("open"),
    )
    # what comes a whole number of times has nothing to round
    done = rows.where("part = 0").withColumn("open", F.lit(False))
    state = cut(rows.where("part > 0").groupBy("mix_id", "source", "node").applyInPandas(lambda p: _node(p, seed), STATE))
    done, open_ = done.unionByName(state.where("not open")), state.where("open")
    leaves = -(-most // LEAF)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        state = cut(open_.withColumn("node", F.floor(F.col("node") / FAN).cast("bigint")).groupBy("mix_id", "source", "node").applyInPandas(lambda p: _node(p, seed), STATE))
        done, open_ = done.unionByName(state.where("not open")), state.where("open")
    draw = F.pmod(F.xxhash64("mix_id", "source", "doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = open_.withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0))
    return done.unionByName(last).select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.round("part").cast("bigint")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share, texts, most_copies, tokens, actual_share, for every target."""
    got = mixed.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    goal = targets.groupBy("mix_id", canon.label("source").alias("source")).agg(F.max("target_share").alias("target_share"))
    zero = {"texts": 0, "most_copies": 0, "tokens": 0}
    g = goal.join(got, ["mix_id", "source"], "left").fillna(zero)
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return g.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total))
