"""Ranked lists: top-n per query with one fixed tie order, fusion, and the hop split.

A ranking has query_id, card_id, score and rank (from 1). Scores are rounded to six
places before ranking and ties go to the smaller card_id, so results do not depend on
the order in which Spark adds numbers up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6
RRF_K = 60
RECENCY = 0.0006
IN_DEGREE = 0.35


def ranked(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All of ``scores`` (query_id, card_id, score) with ranks."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col("score").desc(), "card_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long"))


def top(scores: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n best per query; Spark prunes each partition before the shuffle (window group limit)."""
    return ranked(scores, by).where(F.col("rank") <= n)


def fused(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the rankings."""
    parts = [r.select("query_id", "card_id", (F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "card_id").agg(F.round(F.sum("part"), PLACES + 2).alias("score"))


def decayed(score: Column, age_days: Column, rate: float = RECENCY) -> Column:
    return F.round(score / (F.lit(1.0) + F.lit(rate) * age_days), PLACES + 2)


def boosted(score: Column, in_degree: Column, weight: float = IN_DEGREE) -> Column:
    return F.round(score * (F.lit(1.0) + F.lit(weight) * F.log1p(in_degree.cast("double"))), PLACES + 2)


def hop_split(first: DataFrame, second: DataFrame, k: int, seeds: int = 10) -> DataFrame:
    """Half of the result from the first stage, then what the second hop adds.

    Bands in order: the first max(1, k / 2) of the first stage; cards of the second stage
    with positive score outside the first ``seeds``; the other seeds by second score; the
    tail of the first stage. The result has score 1 / rank.
    """
    head = max(1, k // 2)
    f = first.select("query_id", "card_id", F.col("rank").alias("r1"))
    s = second.select("query_id", "card_id", F.col("score").alias("s2"))
    both = f.join(s, ["query_id", "card_id"], "full")
    is_seed = F.col("r1") <= seeds
    band = (
        F.when(F.col("r1") <= head, 0)
        .when((F.col("s2") > 0) & ~F.coalesce(is_seed, F.lit(False)), 1)
        .when(is_seed & (F.col("s2") > 0), 2)
        .when(F.col("r1").isNotNull(), 3)
    )
    inside = F.when(F.col("band").isin(1, 2), -F.col("s2")).otherwise(F.col("r1").cast("double"))
    banded = both.withColumn("band", band).where("band is not null").withColumn("inside", inside)
    order = Window.partitionBy("query_id").orderBy("band", "inside", "card_id")
    out = banded.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return out.select("query_id", "card_id", (F.lit(1.0) / F.col("rank")).alias("score"), "rank")
