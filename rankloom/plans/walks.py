"""Named queries: the walk scorers over the text record, seeded by its first stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import metrics, ranking, stats, walkers
from rankloom.operators.graph import ITERATIONS
from rankloom.plans import retrieval
from rankloom.plans.networks import SPLIT, _ppr_sql, _walk_sql
from rankloom.plans.prelude import TEXT
from rankloom.sources.record import Record
from rankloom.storage import written


def scorer_dag_walk(rec: Record):
    return walkers.dag_walk(rec)


def scorer_dag_walk_blind(rec: Record):
    return walkers.dag_walk(rec, blind=True)


def scorer_onto_walk(rec: Record):
    return walkers.onto_walk(rec)


def scorer_onto_walk_blind(rec: Record):
    return walkers.onto_walk(rec, blind=True)


def scorer_onto_llm_walk(rec: Record):
    return walkers.onto_llm_walk(rec)


#: Methods of the comparison, and the pairs of them that are tested.
METHODS = {
    "fresh": lambda rec: ranking.top(rec.fresh(), 10),
    "two_step": retrieval.two_step_topk,
    "dag_walk": walkers.dag_walk,
    "onto_walk": walkers.onto_walk,
    "onto_llm_walk": walkers.onto_llm_walk,
    "dag_walk_blind": lambda rec: walkers.dag_walk(rec, blind=True),
    "onto_walk_blind": lambda rec: walkers.onto_walk(rec, blind=True),
}
TESTED = [("dag_walk", "onto_walk"), ("two_step", "onto_walk"), ("two_step", "dag_walk"), ("fresh", "two_step"), ("onto_walk_blind", "onto_walk"), ("dag_walk_blind", "dag_walk")]


def _method_slots(rec: Record) -> DataFrame:
    """run, query_id, slot_recall, chain_recall, last_hop of all methods, and of an oracle that returns a card of each slot; stored."""
    if not hasattr(rec, "method_slots"):
        parts = [make(rec).select(F.lit(name).alias("run"), "query_id", "card_id", "rank") for name, make in METHODS.items()]
        best = rec.labels.groupBy("query_id", "slot").agg(F.min("card_id").alias("card_id"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("slot")).cast("long")
        parts.append(best.select(F.lit("oracle").alias("run"), "query_id", "card_id", nth.alias("rank")))
        rec.method_slots = written(metrics.slots(written(reduce(DataFrame.unionByName, parts), "methods"), rec.labels, 10), "method-slots")
    return rec.method_slots


def walk_methods(rec: Record) -> DataFrame:
    """Slot and chain recall of every method, with the oracle's row, which must be 1; and the share of contrast
    pairs of which both are answered in full."""
    s = _method_slots(rec)
    pair = s.join(rec.pairs, "query_id").groupBy("run", "pair_id").agg(F.count(F.lit(1)).alias("k"), F.min("chain_recall").alias("both")).where("k = 2")
    pair = pair.groupBy("run").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("both"), 6).alias("both_right"))
    out = s.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("slot_recall", "chain_recall", "last_hop")])
    return out.join(pair, "run", "left")


def walk_comparisons(rec: Record) -> DataFrame:
    """Paired differences of chain recall with intervals, discordant pairs and verdicts, over all queries and by whether the
    citation walk could reach the answer; the blind pairs are the time ablation."""
    s = _method_slots(rec)
    reach = written(walkers.dag_walk(rec, k=1_000_000).join(rec.labels.select("query_id", "card_id"), ["query_id", "card_id"], "left_semi").select("query_id").distinct(), "reach")
    strata = rec.labels.select("query_id").distinct().join(reach.withColumn("r", F.lit(True)), "query_id", "left")
    strata = strata.select("query_id", F.explode(F.array(F.lit("all"), F.when(F.col("r"), "reachable").otherwise("entity_only"))).alias("stratum"))
    parts = []
    for a, b in TESTED:
        side = lambda run, c: s.where(F.col("run") == run).select("query_id", F.col("chain_recall").alias(c))
        parts.append(side(a, "va").join(side(b, "vb"), "query_id").join(strata, "query_id").select(F.concat_ws(":", F.lit(a), F.lit(b), "stratum").alias("label"), "query_id", "va", "vb"))
    rows = written(reduce(DataFrame.unionByName, parts), "pairs")
    ci = stats.bootstrap(rows.select("label", "query_id", (F.col("vb") - F.col("va")).alias("delta")))
    mc = stats.mcnemar(rows.select("label", (F.col("va") > 0).alias("right_a"), (F.col("vb") > 0).alias("right_b")))
    return ci.join(mc, "label").select("*", stats.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


NAMES = [walk_comparisons, walk_methods, scorer_dag_walk, scorer_dag_walk_blind, scorer_onto_llm_walk, scorer_onto_walk, scorer_onto_walk_blind]
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Record(spark, sf_dir))) for f in NAMES}

COMMON = """
fs AS MATERIALIZED (SELECT query_id, card_id, score, rank FROM first_stage),
seeds AS (SELECT query_id, card_id, rank FROM fs WHERE rank <= 10),
tops AS (SELECT query_id, score AS top_score FROM fs WHERE rank = 1),
ord AS MATERIALIZED (SELECT v.*, min(card_id) OVER (PARTITION BY md5(text)) AS root FROM versions v JOIN documents ON doc_id = card_id),
walks AS (SELECT query_id, as_of FROM queries)
"""
POOL = "committed_at <= as_of AND (intent <> 'current' OR superseded_at IS NULL OR superseded_at > as_of)"
EMIT = "SELECT s.query_id, s.card_id, 1.0::DOUBLE / s.rank AS score, s.rank, top_score, {chain} AS chain_pos FROM (SELECT * FROM split WHERE rank <= 10) s JOIN tops USING (query_id) {join}"


def _recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {TEXT.strip()},{COMMON}, {ctes.strip()}\n{select}\n"


def _dag_sql(blind: bool) -> str:
    gate = "true" if blind else "e.valid_from <= w.as_of"
    return _recursive(
        """adjacent AS (
  SELECT a, b, min(valid_from) AS valid_from FROM (
    SELECT s.root AS a, d.root AS b, valid_from FROM text_edges e JOIN ord s ON e.src = s.card_id JOIN ord d ON e.dst = d.card_id
    UNION ALL SELECT d.root, s.root, valid_from FROM text_edges e JOIN ord s ON e.src = s.card_id JOIN ord d ON e.dst = d.card_id) WHERE a <> b GROUP BY 1, 2),
"""
        + _walk_sql(blind=blind)
        + f""",
nodes AS (SELECT query_id, card_id FROM walked),
every_edge AS (SELECT src, dst, valid_from FROM text_edges UNION ALL SELECT card_id, supersedes_id, committed_at FROM versions WHERE supersedes_id IS NOT NULL),
links AS (
  SELECT a.query_id, src, dst FROM every_edge e JOIN walked a ON a.card_id = e.src JOIN walked b ON b.card_id = e.dst AND b.query_id = a.query_id
  JOIN walks w ON w.query_id = a.query_id WHERE {gate}),
wseeds AS (SELECT query_id, card_id, score AS weight FROM fs WHERE rank <= 10),
{_ppr_sql(ITERATIONS)},
second AS (SELECT p.* FROM ppr p JOIN versions USING (card_id) JOIN queries USING (query_id) WHERE score > 0 AND {POOL}),
"""
        + SPLIT.format(first="fs", second="second"),
        EMIT.format(chain="row_number() OVER (PARTITION BY s.query_id ORDER BY depth NULLS LAST, s.rank)", join="LEFT JOIN walked w ON w.query_id = s.query_id AND w.card_id = s.card_id"),
    )


def _entities(blind: bool) -> str:
    began = "true" if blind else "committed_at <= as_of"
    lasts = "true" if blind else "valid_from <= as_of AND (intent = 'history' OR valid_until IS NULL OR valid_until > as_of)"
    return f"""
names AS (SELECT DISTINCT card_id, unnest(w) AS entity FROM toks),
few AS (SELECT entity FROM names WHERE length(entity) >= 12 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20),
ments AS MATERIALIZED (SELECT card_id, entity, committed_at, superseded_at FROM names SEMI JOIN few USING (entity) JOIN versions USING (card_id)),
facts AS (
  SELECT lag(entity) OVER (PARTITION BY card_id ORDER BY entity) AS subj, entity AS obj, committed_at AS valid_from, superseded_at AS valid_until FROM ments),
links AS MATERIALIZED (
  SELECT query_id, 'c' || card_id AS src, 'e' || entity AS dst FROM ments JOIN queries ON {began}
  UNION ALL SELECT query_id, 'e' || subj, 'e' || obj FROM facts JOIN queries ON {lasts} WHERE subj IS NOT NULL)"""


def _named(weights: str, tag: str = "") -> str:
    return f"""
wseeds{tag} AS ({weights}),
nodes AS (SELECT query_id, src AS card_id FROM links UNION SELECT query_id, dst FROM links UNION SELECT query_id, 'c' || card_id FROM fs WHERE rank <= 10)"""


def _cards(ppr: str) -> str:
    return f"""SELECT query_id, card_id, score FROM (SELECT query_id, substr(card_id, 2)::BIGINT AS card_id, score FROM {ppr} WHERE score > 0 AND card_id LIKE 'c%')
  JOIN versions USING (card_id) JOIN queries USING (query_id) WHERE {POOL}"""


def _onto_sql(blind: bool) -> str:
    weights = "SELECT query_id, 'c' || card_id AS card_id, score AS weight FROM fs WHERE rank <= 10"
    return _recursive(
        _entities(blind) + "," + _named(weights) + "," + _ppr_sql(ITERATIONS) + f", second AS ({_cards('ppr')})," + SPLIT.format(first="fs", second="second"),
        EMIT.format(chain="s.rank", join=""),
    )


def _llm_sql() -> str:
    out = _entities(False) + """,
nodes AS (SELECT query_id, src AS card_id FROM links UNION SELECT query_id, dst FROM links UNION SELECT query_id, 'c' || card_id FROM fs),
ev0 AS (SELECT query_id, card_id, rank AS k FROM fs WHERE rank <= 3)"""
    for i in (0, 1):
        out += f""",
wl{i} AS (SELECT query_id, 'c' || card_id AS card_id, 1.0::DOUBLE AS weight FROM ev{i}),
{_ppr_sql(ITERATIONS, f"l{i}", f"wl{i}")},
off{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS k FROM ({_cards(f"pprl{i}")}) ANTI JOIN ev{i} USING (query_id, card_id)),
ev{i + 1} AS (SELECT * FROM ev{i} UNION ALL SELECT query_id, card_id, {100 * (i + 1)} + k FROM off{i} WHERE k <= 3)"""
    out += """,
every_card AS (
  SELECT query_id, card_id, 0 AS band, k FROM ev2 UNION ALL SELECT query_id, card_id, 1, rank FROM fs ANTI JOIN ev2 USING (query_id, card_id)),
split AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY band, k, card_id) AS rank FROM every_card)"""
    return _recursive(
        out,
        EMIT.format(
            chain="row_number() OVER (PARTITION BY s.query_id ORDER BY CASE WHEN e.card_id IS NOT NULL THEN v.committed_at END NULLS LAST, s.rank)",
            join="LEFT JOIN ev2 e ON e.query_id = s.query_id AND e.card_id = s.card_id JOIN versions v ON v.card_id = s.card_id",
        ),
    )


ORACLE_SQL = {
    "scorer_dag_walk": _dag_sql(False),
    "scorer_dag_walk_blind": _dag_sql(True),
    "scorer_onto_walk": _onto_sql(False),
    "scorer_onto_walk_blind": _onto_sql(True),
    "scorer_onto_llm_walk": _llm_sql(),
}
