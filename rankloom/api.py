"""Scorers by name, guarded, and a report that compares two of them.

A scorer is a function of a record (``Record(spark, folder)`` or ``Record.from_frames``)
that gives a ranking: query_id, card_id, score, rank, top_score (what an abstaining run
compares with its threshold) and chain_pos (the scorer's own order of evidence, null where
it claims none). Its flags say which structure it reads, so that it is not judged by
labels mined from it.

What a model would do is a function to hand in: ``embed.Embedder`` makes vectors,
``networks.reranked`` takes the scorer of candidate texts, ``walkers.onto_llm_walk`` the
walker and ``judge.duel`` the judge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import guards, metrics, ranking, stats, walkers
from rankloom.plans import retrieval
from rankloom.sources.record import Record
from rankloom.storage import written


@dataclass(frozen=True)
class Scorer:
    name: str
    run: Callable[[Record], DataFrame]
    uses_graph: bool = False
    uses_entities: bool = False


SCORERS: dict[str, Scorer] = {}


def register(name: str, run: Callable[[Record], DataFrame], **flags: bool) -> Scorer:
    """Adds a scorer; a later one of the same name replaces it."""
    SCORERS[name] = Scorer(name, run, **flags)
    return SCORERS[name]


def _late(module: str, name: str) -> Callable[[Record], DataFrame]:
    def run(rec: Record) -> DataFrame:
        from importlib import import_module

        return getattr(import_module(f"rankloom.plans.{module}"), name)(rec)

    return run


register("bm25", retrieval.bm25_topk)
register("dense", retrieval.dense_topk)
register("hybrid_rrf", retrieval.rrf_hybrid_topk)
register("hybrid_rrf_fresh", retrieval.fresh_topk)
register("graph_boost", retrieval.graph_boost_topk, uses_graph=True)
register("rerank", _late("networks", "rerank_topk"))
register("first_stage", retrieval.first_stage)
register("two_step", retrieval.two_step_topk)
register("dag_walk", walkers.dag_walk, uses_graph=True)
register("dag_walk_blind", lambda rec: walkers.dag_walk(rec, blind=True), uses_graph=True)
register("onto_walk", walkers.onto_walk, uses_entities=True)
register("onto_walk_blind", lambda rec: walkers.onto_walk(rec, blind=True), uses_entities=True)
register("onto_llm_walk", walkers.onto_llm_walk, uses_entities=True)
register("hop_split", retrieval.hop_split_topk, uses_graph=True)


def rankings(rec: Record, name: str, label_source: str = "planted", k: int = 10) -> DataFrame:
    """The first k of a scorer, refused if its labels come from what it reads."""
    s = SCORERS[name]
    guards.check_circular(s.uses_graph, s.uses_entities, label_source)
    out = s.run(rec)
    guards.check_truth(out)
    out = out.where(F.col("rank") <= k)
    if "top_score" not in out.columns:
        best = out.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
        out = out.join(best, "query_id").withColumn("chain_pos", F.lit(None).cast("long"))
    return out.select(F.lit(name).alias("run"), "query_id", "card_id", "score", "rank", "top_score", "chain_pos")


def compare(rec: Record, a: str, b: str, label_source: str = "planted", k: int = 10) -> dict:
    """Is b better than a: mean of both, paired difference with its interval, power and a verdict. A few rows reach the driver."""
    both = written(rankings(rec, a, label_source, k).unionByName(rankings(rec, b, label_source, k)), "compare")
    m = written(metrics.ndcg(both, rec.labels, k, metrics.judgment_pool(both, k)), "compare")
    d = written(stats.paired(m.where(F.col("run") == a), m.where(F.col("run") == b), "ndcg").select(F.lit("all").alias("label"), "query_id", "delta"), "compare")
    row = stats.bootstrap(d).select("*", stats.verdict(F.col("lo"), F.col("hi")).alias("verdict")).first()
    power = stats.power(d).first()
    means = {r.run: r.m for r in m.groupBy("run").agg(F.round(F.avg("ndcg"), 6).alias("m")).collect()}
    if row is None:
        return {"a": a, "b": b, "n": 0, "verdict": "NO DATA"}
    return {"a": a, "b": b, "n": row.n, "ndcg": means, "delta": row["mean"], "lo": row.lo, "hi": row.hi, "mde": power.mde, "n_required": power.n_required, "verdict": row.verdict}


__all__ = ["SCORERS", "Scorer", "compare", "rankings", "ranking", "register"]
