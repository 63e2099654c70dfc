"""Scorers that go from the first stage's cards to others, over citations or over entities.

All start at the ten best cards of the first stage, rank what they reach with the same
personalised PageRank, return only what a query may see, and spend the result on both
hops. The result has query_id, card_id, score, rank, top_score (the first stage's best,
so that all share one threshold for abstaining) and chain_pos (the place in the order of
evidence that the walk claims).

A record gives queries, versions, texts, text_edges, entity_mentions, entity_facts and
first_stage().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import asof, graph, ranking
from rankloom.storage import small, written

SEEDS, HOPS = 10, 3
#: Cards that a walker is offered at a hop, evidence it starts with, hops at most.
OFFERED, STARTED, MOST_HOPS = 20, 3, 3

#: A walker: (hop, evidence, candidates) -> the chosen candidates (query_id, card_id, k) and whether the walk ends there.
#: Evidence and candidates have query_id, card_id, k (place), committed_at; texts join by card_id.
Walker = Callable[[int, DataFrame, DataFrame], tuple[DataFrame, bool]]


def first_three(hop: int, evidence: DataFrame, candidates: DataFrame) -> tuple[DataFrame, bool]:
    """A walker by rule: the three best candidates, two hops."""
    return candidates.where("k <= 3").select("query_id", "card_id", "k"), hop >= 1


def _first(rec) -> DataFrame:
    """The first stage, stored once for all walks of a record."""
    if not hasattr(rec, "first_ranking"):
        rec.first_ranking = written(rec.first_stage().select("query_id", "card_id", "score", "rank"), "first")
    return rec.first_ranking


def _seen(rec, scores: DataFrame) -> DataFrame:
    """Scores above 0 of cards in a query's pool."""
    return asof.masked(scores.where("score > 0"), rec.queries, rec.versions, pool=True).select("query_id", "card_id", "score")


def _finished(result: DataFrame, first: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """``result`` with top_score and chain_pos; ``chain`` has query_id, card_id and a sort key ``c``."""
    best = first.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
    out = result.join(best, "query_id")
    if chain is None:
        return out.withColumn("chain_pos", F.col("rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("c").asc_nulls_last(), "rank")
    return out.join(chain, ["query_id", "card_id"], "left").withColumn("chain_pos", F.row_number().over(order).cast("long")).drop("c")


def dag_links(nodes: DataFrame, rec, blind: bool) -> DataFrame:
    """query_id, src, dst among ``nodes``: citations and version steps of the query's time."""
    edges = rec.text_edges.select("src", "dst", "valid_from")
    steps = rec.versions.where("supersedes_id is not null").select(F.col("card_id").alias("src"), F.col("supersedes_id").alias("dst"), F.col("committed_at").alias("valid_from"))
    n = nodes.select("query_id", "card_id")
    both = edges.unionByName(steps).join(n.withColumnRenamed("card_id", "src"), "src").join(n.withColumnRenamed("card_id", "dst"), ["query_id", "dst"])
    if not blind:
        both = both.join(small(rec.queries.select("query_id", "as_of")), "query_id").where("valid_from <= as_of")
    return both.select("query_id", "src", "dst")


def dag_walk(rec, k: int = 10, blind: bool = False) -> DataFrame:
    """Three undirected steps along citations and versions from the first stage, then PageRank on what was reached."""
    first = _first(rec)
    seeds = first.where(F.col("rank") <= SEEDS)
    roots = written(asof.version_roots(rec.versions), "roots")
    walked = written(graph.walk(seeds, rec.queries.select("query_id", "as_of"), rec.versions, roots, rec.text_edges, HOPS, blind), "walked")
    p = graph.pagerank(walked, dag_links(walked, rec, blind), seeds.select("query_id", "card_id", F.col("score").alias("weight")))
    result = ranking.hop_split(first, _seen(rec, p), k, SEEDS)
    return _finished(result, first, walked.select("query_id", "card_id", F.col("depth").alias("c")))


#: Queries of one time and intent that one task ranks.
TOGETHER = 16


class EntityGraph:
    """The cards and entities of a record as a graph for each time and intent of a query, stored once.

    Queries that see the same links share them: a view is named by one of its queries.
    """

    def __init__(self, rec, blind: bool = False):
        self.rec = rec
        seen = [] if blind else ["as_of", "intent"]
        q = rec.queries.select("query_id", "as_of", "intent")
        nth = F.row_number().over(Window.partitionBy(*(seen or [F.lit(0)])).orderBy("query_id"))  # a row for each query
        q = q.withColumn("part", F.floor((nth - 1) / TOGETHER))
        self.views = written(q.withColumn("view", F.min("query_id").over(Window.partitionBy(*seen, "part"))), "views")
        times = self.views.where("view = query_id").select("query_id", "as_of", "intent")
        at = rec.versions.select("card_id", F.col("committed_at").alias("valid_from"))
        mentions = rec.entity_mentions.select("card_id", "entity_id").distinct().join(at, "card_id")
        facts = rec.entity_facts.select("subj", "obj", "valid_from", "valid_until")
        self.links = written(graph.entity_links(mentions, facts, times, blind), "entity-links")

    def scores(self, weights: DataFrame) -> DataFrame:
        """query_id, card_id, score of cards that a query may see, by PageRank from ``weights`` (query_id, card_id, weight)."""
        kind = dict(self.rec.versions.dtypes)["card_id"]
        named = weights.select("query_id", F.concat(F.lit("c"), F.col("card_id").cast("string")).alias("card_id"), "weight")
        p = graph.pagerank(None, self.links, named, views=self.views.select("query_id", "view"), only="c", lone=True)
        return _seen(self.rec, p.select("query_id", F.expr("substring(card_id, 2)").cast(kind).alias("card_id"), "score"))


def _graph(rec, blind: bool = False) -> EntityGraph:
    """The entity graph, stored once for all walks of a record."""
    known = rec.__dict__.setdefault("entity_graphs", {})
    if blind not in known:
        known[blind] = EntityGraph(rec, blind)
    return known[blind]


def onto_walk(rec, k: int = 10, blind: bool = False) -> DataFrame:
    """PageRank from the first stage over cards and the entities that they mention, at the query's time."""
    first = _first(rec)
    seeds = first.where(F.col("rank") <= SEEDS).select("query_id", "card_id", F.col("score").alias("weight"))
    return _finished(ranking.hop_split(first, _graph(rec, blind).scores(seeds), k, SEEDS), first)


def onto_llm_walk(rec, k: int = 10, walker: Walker = first_three) -> DataFrame:
    """A walker chooses each hop among the 20 best new cards of a PageRank from all evidence alike.

    Evidence comes first in the order in which it was chosen, then the first stage; the
    chain is the evidence by date.
    """
    first = _first(rec)
    at = rec.versions.select("card_id", "committed_at")
    found = _graph(rec)
    evidence = written(first.where(F.col("rank") <= STARTED).select("query_id", "card_id", F.col("rank").alias("k")).join(at, "card_id"), "evidence")
    for hop in range(MOST_HOPS):
        near = found.scores(evidence.select("query_id", "card_id", F.lit(1.0).alias("weight"))).join(evidence.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
        offered = written(ranking.top(near, OFFERED).select("query_id", "card_id", F.col("rank").alias("k")).join(at, "card_id"), "offered")
        chosen, done = walker(hop, evidence, offered)
        new = offered.join(chosen.select("query_id", "card_id", F.col("k").alias("nth")), ["query_id", "card_id"])
        evidence = written(evidence.unionByName(new.select("query_id", "card_id", (F.lit(100 * (hop + 1)) + F.col("nth")).alias("k"), "committed_at")), "evidence")
        if done or not new.limit(1).count():
            break
    lead = evidence.select("query_id", "card_id", F.lit(0).alias("band"), F.col("k").cast("long").alias("k"))
    rest = first.join(evidence.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti").select("query_id", "card_id", F.lit(1).alias("band"), F.col("rank").alias("k"))
    order = Window.partitionBy("query_id").orderBy("band", "k", "card_id")
    result = lead.unionByName(rest).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    result = result.select("query_id", "card_id", (F.lit(1.0) / F.col("rank")).alias("score"), "rank")
    return _finished(result, first, evidence.select("query_id", "card_id", F.unix_micros(F.col("committed_at").cast("timestamp")).alias("c")))
