"""Ranking metrics that tolerate incomplete labels.

Rankings: run, query_id, card_id, rank. Labels: query_id, card_id, grade and slot. A
query without labels has null metrics and leaves averages; an unjudged card is not a
negative one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.storage import small


def judgment_pool(rankings: DataFrame, k: int) -> DataFrame:
    """query_id, card_id: what any run has in its first k."""
    return rankings.where(F.col("rank") <= k).select("query_id", "card_id").distinct()


def _gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1)


def ideal(labels: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "card_id")
    best = labels.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
    return best.groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("i"))).alias("ideal"))


def ndcg(rankings: DataFrame, labels: DataFrame, k: int, judged: DataFrame | None = None) -> DataFrame:
    """run, query_id, ndcg. With ``judged`` the unjudged are taken out and ranks close up before the cut (condensed)."""
    r = rankings.select("run", "query_id", "card_id", "rank")
    if judged is not None:
        known = judged.select("query_id", "card_id").union(labels.select("query_id", "card_id")).distinct()
        close = Window.partitionBy("run", "query_id").orderBy("rank")
        r = r.join(known, ["query_id", "card_id"], "left_semi").withColumn("rank", F.row_number().over(close).cast("long"))
    r = r.where(F.col("rank") <= k).join(labels.select("query_id", "card_id", "grade"), ["query_id", "card_id"])
    gains = r.groupBy("run", "query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    every = _for_each_run(ideal(labels, k), rankings)
    return every.join(gains, ["run", "query_id"], "left").select("run", "query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def _for_each_run(rows: DataFrame, rankings: DataFrame) -> DataFrame:
    """``rows`` once for every run; runs are the few methods under comparison."""
    return rows.crossJoin(small(rankings.select("run").distinct(), 1000))


def _per_query(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per run and labelled query with n_relevant."""
    return _for_each_run(labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")), rankings)


def hits(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    return rankings.select("run", "query_id", "card_id", "rank").join(labels.select("query_id", "card_id", "grade", "slot"), ["query_id", "card_id"])


def reciprocal_rank(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    first = hits(rankings, labels).groupBy("run", "query_id").agg(F.min("rank").alias("first"))
    return _per_query(rankings, labels).join(first, ["run", "query_id"], "left").select("run", "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def recall(rankings: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    found = hits(rankings, labels).where(F.col("rank") <= k).groupBy("run", "query_id").agg(F.count(F.lit(1)).alias("found"))
    return _per_query(rankings, labels).join(found, ["run", "query_id"], "left").select("run", "query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"))


def bpref(rankings: DataFrame, labels: DataFrame, pool: DataFrame) -> DataFrame:
    """Every retrieved relevant card counts 1 - min(nonrelevant above it, d) / d; R relevant and N judged nonrelevant
    cards, d = min(R, N), or R if N is 0; divided by R."""
    rel = labels.select("query_id", "card_id", F.lit(1).alias("rel"))
    nonrel = pool.join(rel, ["query_id", "card_id"], "left_anti")
    sizes = _per_query(rankings, labels).join(nonrel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_non")), "query_id", "left").withColumn("n_non", F.coalesce("n_non", F.lit(0)))
    judged = rel.union(nonrel.select("query_id", "card_id", F.lit(0)))
    seen = rankings.select("run", "query_id", "card_id", "rank").join(judged, ["query_id", "card_id"])
    above = Window.partitionBy("run", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("above", F.sum(1 - F.col("rel")).over(above)).where("rel = 1").join(sizes, ["run", "query_id"])
    d = F.when(F.col("n_non") > 0, F.least("n_relevant", "n_non")).otherwise(F.col("n_relevant"))
    parts = seen.groupBy("run", "query_id").agg(F.sum(1 - F.least(F.col("above"), d) / d).alias("s"))
    return sizes.join(parts, ["run", "query_id"], "left").select("run", "query_id", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n_relevant"), 6).alias("bpref"))


def slots(rankings: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """run, query_id, slot_recall (any card of a slot counts), chain_recall (all slots), last_hop (the last slot)."""
    wanted = _for_each_run(labels.select("query_id", "slot").distinct(), rankings)
    found = hits(rankings, labels).where(F.col("rank") <= k).select("run", "query_id", "slot", F.lit(1).alias("in_top")).distinct()
    per = wanted.join(found, ["run", "query_id", "slot"], "left").withColumn("in_top", F.coalesce("in_top", F.lit(0)))
    return per.groupBy("run", "query_id").agg(
        F.round(F.avg("in_top"), 6).alias("slot_recall"), F.min("in_top").cast("double").alias("chain_recall"), F.max_by("in_top", "slot").cast("double").alias("last_hop")
    )


def chain_tau(rankings: DataFrame, labels: DataFrame, times: DataFrame) -> DataFrame:
    """Kendall's tau between first position and evidence time over the slots a run has found (null below two)."""
    pos = hits(rankings, labels).join(times.select("card_id", "committed_at"), "card_id")
    per = pos.groupBy("run", "query_id", "slot").agg(F.min(F.struct("rank", "committed_at")).alias("p")).select("run", "query_id", "slot", F.col("p.rank").alias("rank"), F.col("p.committed_at").alias("at"))
    a, b = per.alias("a"), per.alias("b")
    same = (F.col("a.run") == F.col("b.run")) & (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.slot") < F.col("b.slot"))
    later = F.when(F.col("a.at") < F.col("b.at"), 1).when(F.col("a.at") > F.col("b.at"), -1).otherwise(0)
    lower = F.when(F.col("a.rank") < F.col("b.rank"), 1).when(F.col("a.rank") > F.col("b.rank"), -1).otherwise(0)
    pairs = a.join(b, same).select("a.run", "a.query_id", (later * lower).alias("s")).where("s <> 0")
    return pairs.groupBy("run", "query_id").agg(F.round(F.avg("s"), 6).alias("tau"), F.min((F.col("s") > 0).cast("int")).alias("in_order"))


def order_exact(rankings: DataFrame, labels: DataFrame, times: DataFrame) -> DataFrame:
    """run, query_id, exact: whether every slot was found and no two of them stand against the order of evidence."""
    wanted = _for_each_run(labels.groupBy("query_id").agg(F.count_distinct("slot").alias("wanted")), rankings)
    got = hits(rankings, labels).groupBy("run", "query_id").agg(F.count_distinct("slot").alias("got"))
    tau = chain_tau(rankings, labels, times).select("run", "query_id", "in_order")
    joined = wanted.join(got, ["run", "query_id"], "left").join(tau, ["run", "query_id"], "left")
    return joined.select("run", "query_id", (F.coalesce(F.col("got") == F.col("wanted"), F.lit(False)) & (F.coalesce("in_order", F.lit(1)) == 1)).alias("exact"))
