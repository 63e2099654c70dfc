"""Named queries: snapshots, ranking, metrics and statistics over text cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import asof, lexical, metrics, ranking, stats
from rankloom.plans.prelude import with_text
from rankloom.sources.record import Record
from rankloom.storage import small, written

K = 10


def _rankings(rec: Record) -> DataFrame:
    """The two runs under comparison, stored: ten rows per query and run, which metrics read several times."""
    if not hasattr(rec, "rankings"):
        a = rec.lexical_top(K).withColumn("run", F.lit("bm25"))
        b = ranking.top(rec.fresh(), K).withColumn("run", F.lit("fresh"))
        rec.rankings = written(a.unionByName(b), "rankings")
    return rec.rankings


def bm25_topk(rec: Record) -> DataFrame:
    return rec.lexical_top(K)


def postings_tf(rec: Record) -> DataFrame:
    return lexical.postings(rec.toks, rec.terms).groupBy("term").agg(F.count(F.lit(1)).alias("n_cards"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


def idf_table(rec: Record) -> DataFrame:
    idf = lexical.inverse_frequencies(lexical.postings(rec.toks, rec.terms), rec.stats)
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def asof_snapshot_counts(rec: Record) -> DataFrame:
    q = small(rec.queries.select("as_of").distinct())
    seen = rec.versions.join(q, asof.in_snapshot(F.col("as_of")))
    return seen.groupBy(F.date_format("as_of", "yyyy-MM-dd HH").alias("as_of"), "line").agg(F.count(F.lit(1)).alias("n_cards"), F.count_if(asof.current(F.col("as_of"))).alias("n_current"))


def current_asof(rec: Record) -> DataFrame:
    q = F.broadcast(rec.queries.agg(F.min("as_of").alias("as_of")))
    seen = rec.versions.join(q, asof.in_snapshot(F.col("as_of")) & asof.current(F.col("as_of")))
    return seen.select("card_id", "line")


def version_roots(rec: Record) -> DataFrame:
    return asof.version_roots(rec.versions)


def validity_windows(rec: Record) -> DataFrame:
    hours = F.expr("timestampdiff(HOUR, committed_at, superseded_at)")
    none = F.lit(-1).cast("long")
    return rec.versions.select("card_id", F.coalesce("supersedes_id", none).alias("supersedes_id"), F.coalesce(hours, none).alias("valid_hours"))


def version_cited_asof(rec: Record) -> DataFrame:
    """Each card cites its line's first chain; the version it means is the latest by then."""
    roots = asof.version_roots(rec.versions)
    v = rec.versions.join(roots, "card_id")
    first = small(v.groupBy("line").agg(F.min("root").alias("root")))
    cites = v.select(F.col("card_id").alias("src"), "line", F.col("committed_at").alias("at")).join(first, "line").select("src", "root", "at")
    return asof.cited_as_of(cites, v).select("src", "root", "dst")


def dense_topk(rec: Record) -> DataFrame:
    return rec.dense_top(K)


def rrf_hybrid_topk(rec: Record) -> DataFrame:
    return ranking.top(rec.rrf(100), K)


def fresh_topk(rec: Record) -> DataFrame:
    return ranking.top(rec.fresh(), K)


def graph_boost_topk(rec: Record) -> DataFrame:
    return ranking.top(rec.boosted(), K)


def first_stage(rec: Record) -> DataFrame:
    return ranking.top(rec.rrf(150, pool=True), 50)


def _expanded(rec: Record, first: DataFrame) -> DataFrame:
    """First stage for each query with its feedback terms added."""
    seen = first.where(F.col("rank") <= 5).select("card_id").distinct()
    own = written(lexical.postings(lexical.tokenised(rec.texts.join(seen, "card_id", "left_semi"))), "feedback")
    extra = written(lexical.feedback_terms(first, own, rec.idf_of(own), rec.terms), "extra")
    lex = rec.bm25_best(rec.terms.unionByName(extra), 150, pool=True)
    return ranking.ranked(ranking.fused([ranking.top(lex, 150), rec.dense_top(150, pool=True)]))


def two_step_topk(rec: Record) -> DataFrame:
    first = written(rec.first_stage(), "first-stage")
    return ranking.hop_split(first, _expanded(rec, first), K)


def hop_split_topk(rec: Record) -> DataFrame:
    """The hop split of the first stage with the in-degree boosted ranking as second stage."""
    return ranking.hop_split(rec.first_stage(), rec.boosted(), K)


def judgment_pool(rec: Record) -> DataFrame:
    return metrics.judgment_pool(_rankings(rec), K)


def ndcg_condensed(rec: Record) -> DataFrame:
    r = _rankings(rec)
    return metrics.ndcg(r, rec.labels, K, metrics.judgment_pool(r, K))


def ndcg_raw(rec: Record) -> DataFrame:
    return metrics.ndcg(_rankings(rec), rec.labels, K)


def mrr(rec: Record) -> DataFrame:
    return metrics.reciprocal_rank(_rankings(rec), rec.labels)


def recall_at_k(rec: Record) -> DataFrame:
    return metrics.recall(_rankings(rec), rec.labels, K)


def bpref(rec: Record) -> DataFrame:
    r = _rankings(rec)
    return metrics.bpref(r, rec.labels, metrics.judgment_pool(r, K))


def slot_chain_recall(rec: Record) -> DataFrame:
    return metrics.slots(_rankings(rec), rec.labels, K)


def chain_tau(rec: Record) -> DataFrame:
    return metrics.chain_tau(_rankings(rec), rec.labels, rec.versions)


def _deltas(rec: Record) -> DataFrame:
    m = metrics.reciprocal_rank(_rankings(rec), rec.labels)
    d = stats.paired(m.where("run = 'bm25'"), m.where("run = 'fresh'"), "mrr")
    named = d.select(F.when(F.col("query_id") % 2 == 0, "current").otherwise("history").alias("label"), "query_id", "delta")
    return named.select(F.lit("all").alias("label"), "query_id", "delta").unionByName(named)


def paired_delta(rec: Record) -> DataFrame:
    return _deltas(rec).select("label", "query_id", F.round("delta", 6).alias("delta"))


def bootstrap_ci(rec: Record) -> DataFrame:
    return stats.bootstrap(_deltas(rec))


def bootstrap_ci_pcg64(rec: Record) -> DataFrame:
    return stats.bootstrap_pcg64(_deltas(rec))


def paired_power(rec: Record) -> DataFrame:
    return stats.power(_deltas(rec))


def _right(rec: Record) -> DataFrame:
    m = metrics.reciprocal_rank(_rankings(rec), rec.labels)
    a = m.where("run = 'bm25'").select("query_id", (F.col("mrr") >= 0.5).alias("right_a"))
    b = m.where("run = 'fresh'").select("query_id", (F.col("mrr") >= 0.5).alias("right_b"))
    return a.join(b, "query_id").select(F.lit("all").alias("label"), "right_a", "right_b")


def mcnemar_counts(rec: Record) -> DataFrame:
    return stats.mcnemar_counts(_right(rec))


def mcnemar_p(rec: Record) -> DataFrame:
    return stats.mcnemar(_right(rec))


def cohen_kappa(rec: Record) -> DataFrame:
    return stats.kappa(rec.table("labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


def kendall_tau(rec: Record) -> DataFrame:
    """Agreement of the two runs' reciprocal ranks over the queries of each label."""
    m = metrics.reciprocal_rank(_rankings(rec), rec.labels)
    a, b = m.where("run = 'bm25'").select("query_id", F.col("mrr").alias("x")), m.where("run = 'fresh'").select("query_id", F.col("mrr").alias("y"))
    return stats.kendall(a.join(b, "query_id").select(F.lit("all").alias("label"), F.col("query_id").alias("key"), "x", "y"))


def verdict_rows(rec: Record) -> DataFrame:
    return stats.bootstrap(_deltas(rec)).select("label", "n", "mean", stats.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


def abstain_threshold(rec: Record) -> DataFrame:
    """The 0.1 quantile of the best first-stage score over the queries of each intent."""
    best = rec.first_stage().where("rank = 1").join(rec.queries.select("query_id", "intent"), "query_id")
    return best.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("score", 0.1), 6).alias("threshold"))


def abstention_rates(rec: Record) -> DataFrame:
    """At the shared threshold: no-answer queries that are answered, and answerable ones that are not."""
    best = written(rec.first_stage().where("rank = 1").select("query_id", "score"), "best")
    limit = best.agg(F.percentile("score", 0.1).alias("threshold"))
    has = rec.labels.select("query_id").distinct().withColumn("answerable", F.lit(True))
    rows = best.crossJoin(F.broadcast(limit)).join(has, "query_id", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))
    return rows.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("answered"))


def hard_checks(rec: Record) -> DataFrame:
    """Per run: cards after the query's time, superseded cards above a successor (current intent), answers to no-answer queries."""
    r = _rankings(rec).join(rec.queries.select("query_id", "as_of", "intent"), "query_id").join(rec.versions.select("card_id", "committed_at", "supersedes_id"), "card_id")
    later = r.groupBy("run").agg(F.count_if(F.col("committed_at") > F.col("as_of")).alias("after_as_of"), F.count(F.lit(1)).alias("results"))
    old, new = r.where("intent = 'current'").alias("o"), r.alias("n")
    above = old.join(new, (F.col("o.run") == F.col("n.run")) & (F.col("o.query_id") == F.col("n.query_id")) & (F.col("n.supersedes_id") == F.col("o.card_id")))
    above = above.where(F.col("o.rank") < F.col("n.rank")).groupBy("o.run").agg(F.count(F.lit(1)).alias("superseded_above"))
    empty = r.join(rec.labels.select("query_id").distinct(), "query_id", "left_anti").groupBy("run").agg(F.countDistinct("query_id").alias("no_answer_answered"))
    out = later.join(above, "run", "left").join(empty, "run", "left")
    return out.select("run", "results", "after_as_of", F.coalesce("superseded_above", F.lit(0)).alias("superseded_above"), F.coalesce("no_answer_answered", F.lit(0)).alias("no_answer_answered"))


def _sources(rec: Record) -> DataFrame:
    """query_id, source_card, line of the card a query was made from: the first card that answers it."""
    first = rec.labels.groupBy("query_id").agg(F.min("card_id").alias("source_card"))
    return first.join(rec.versions.select(F.col("card_id").alias("source_card"), F.col("line").alias("source_line")), "source_card")


def distractor_taxonomy(rec: Record) -> DataFrame:
    """What wins at rank 1 of labelled queries that are answered wrongly: a card that is not current, a sibling on the
    line of the query's source, one of another topic (here the language), or something else."""
    topic = rec.table("documents").select(F.col("doc_id").alias("card_id"), F.col("lang").alias("topic"))
    sources = _sources(rec).join(topic.select(F.col("card_id").alias("source_card"), F.col("topic").alias("source_topic")), "source_card")
    best = _rankings(rec).where("rank = 1").join(rec.labels.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
    wrong = best.join(sources, "query_id").join(rec.versions, "card_id").join(topic, "card_id")
    kind = (
        F.when(F.col("superseded_at").isNotNull(), "superseded_version")
        .when(F.col("line").eqNullSafe(F.col("source_line")), "sibling_on_line")
        .when(~F.col("topic").eqNullSafe(F.col("source_topic")), "lookalike_elsewhere")
        .otherwise("other")
    )
    return wrong.groupBy("run", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def scale_subset(rec: Record) -> DataFrame:
    return asof.scale_subset(rec.versions, rec.labels, rec.versions.count() // 2, 11)


def scale_curve(rec: Record) -> DataFrame:
    """Mean reciprocal rank of BM25 when only a part of the cards competes with the relevant ones."""
    total = rec.versions.count()
    out = []
    for share in (25, 50, 100):
        keep = asof.scale_subset(rec.versions, rec.labels, total * share // 100, 11)
        r = ranking.top(rec.bm25_best(rec.terms, K, among=keep), K).withColumn("run", F.lit("bm25"))
        m = metrics.reciprocal_rank(r, rec.labels)
        out.append(m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mrr"), 6).alias("mrr")).select(F.lit(share).cast("long").alias("share"), "n", "mrr"))
    return reduce(DataFrame.unionByName, out)


def slice_table(rec: Record) -> DataFrame:
    """Mean delta by overlapping slices of queries: intent, and short or long wording."""
    n = F.size(F.split("qtext", " "))
    tags = rec.queries.select("query_id", F.explode(F.array(F.lit("all"), F.col("intent"), F.when(n < 12, "short").otherwise("long"))).alias("slice"))
    d = _deltas(rec).where("label = 'all'").join(tags, "query_id")
    return d.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("mean"))


def release_gate(rec: Record) -> DataFrame:
    """BLOCK on a hard-check failure or a slice that is worse; SHIP AS DEFAULT if better overall; else SHIP BEHIND A FLAG."""
    b = stats.bootstrap(_deltas(rec)).agg(F.max(F.when(F.col("label") == "all", F.col("lo"))).alias("lo"), F.max(F.when(F.col("hi") < -0.02, 1).otherwise(0)).alias("worse"))
    h = hard_checks(rec).where("run = 'fresh'").agg(F.sum(F.col("after_as_of") + F.col("superseded_above")).alias("fails"))
    decision = F.when((F.col("fails") > 0) | (F.col("worse") > 0), "BLOCK").when(F.col("lo") > 0, "SHIP AS DEFAULT").otherwise("SHIP BEHIND A FLAG")
    return b.crossJoin(h).select("fails", F.col("worse").cast("long").alias("worse"), decision.alias("decision"))  # one row each


def usage_mined(rec: Record) -> DataFrame:
    """Click log labels: the first relevant card in a query's first three, else the first; grade 2."""
    r = _rankings(rec).where("run = 'bm25' and rank <= 3")
    rel = rec.labels.select("query_id", "card_id", F.lit(0).alias("miss"))
    best = r.join(rel, ["query_id", "card_id"], "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("miss", F.lit(1)).alias("miss"), "rank", "card_id")).alias("b"))
    return best.select("query_id", F.col("b.card_id").alias("card_id"), F.lit(2.0).alias("grade"))


def disconnection_filter(rec: Record) -> DataFrame:
    """Queries of several slots whose last slot the lexical or dense top k finds with the first slot's cards hidden.

    Cards are hidden before the cut, so the lists fill up to k. The other query of a pair
    (two neighbouring items) of which one is dropped is dropped with it.
    """
    ends = rec.labels.groupBy("query_id").agg(F.min("slot").alias("first"), F.max("slot").alias("last")).where("first <> last")
    ends = written(ends, "ends")
    hidden = rec.labels.join(ends, "query_id").where("slot = first").select("query_id", "card_id")
    wanted = rec.labels.join(ends, "query_id").where("slot = last").select("query_id", "card_id")
    tops = rec.lexical_top(K, without=hidden).select("query_id", "card_id").union(rec.dense_top(K, without=hidden).select("query_id", "card_id"))
    single = tops.join(wanted, ["query_id", "card_id"], "left_semi").select("query_id").distinct().withColumn("single", F.lit(True))
    d = ends.select("query_id").join(single, "query_id", "left").join(rec.pairs, "query_id", "left")
    bad = d.where("single and pair_id is not null").select("pair_id").distinct().withColumn("bad", F.lit(True))
    state = F.when(F.col("single"), "single_hop").when(F.col("bad"), "pair_dropped").otherwise("kept")
    return d.join(bad, "pair_id", "left").select("query_id", state.alias("dropped"))


def link_fidelity(rec: Record) -> DataFrame:
    """Recorded links (next on a line) against true ones (next with equal text): shared, and both totals."""
    recorded = rec.text_edges.select("src", "dst").distinct()
    true = rec.versions.where("supersedes_id is not null").select(F.col("card_id").alias("src"), F.col("supersedes_id").alias("dst"))
    shared = true.join(recorded, ["src", "dst"]).agg(F.count(F.lit(1)).alias("shared"))
    out = shared.crossJoin(true.agg(F.count(F.lit(1)).alias("true"))).crossJoin(recorded.agg(F.count(F.lit(1)).alias("recorded")))  # one row each
    return out.select("shared", F.col("true").alias("n_true"), F.col("recorded").alias("n_recorded"), F.round(F.try_divide("shared", "true"), 6).alias("recall"), F.round(F.try_divide("shared", "recorded"), 6).alias("precision"))


def rank_bias(rec: Record) -> DataFrame:
    """Are recorded links those that the incumbent shows anyway: the share of recorded parents of a query's source card
    in the first three, against that of its true but unrecorded support, and their ratio."""
    recorded = rec.text_edges.select("src", "dst").distinct()
    true = rec.versions.where("supersedes_id is not null").select(F.col("card_id").alias("src"), F.col("supersedes_id").alias("dst"))
    links = recorded.withColumn("recorded", F.lit(True)).unionByName(true.join(recorded, ["src", "dst"], "left_anti").withColumn("recorded", F.lit(False)))
    top3 = _rankings(rec).where("run = 'bm25' and rank <= 3").select("query_id", F.col("card_id").alias("dst"), F.lit(True).alias("shown"))
    rows = _sources(rec).select("query_id", F.col("source_card").alias("src")).join(links, "src").join(top3, ["query_id", "dst"], "left")
    part = lambda flag: [F.count_if(flag).alias("n"), F.count_if(flag & F.coalesce("shown", F.lit(False))).alias("hit")]
    (n_rec, hit_rec), (n_un, hit_un) = part(F.col("recorded")), part(~F.col("recorded"))
    one = rows.agg(n_rec.alias("n_recorded"), hit_rec.alias("hit_recorded"), n_un.alias("n_unrecorded"), hit_un.alias("hit_unrecorded"))
    rate = lambda h, n: F.col(h) / F.greatest(F.col(n), F.lit(1))
    return one.select("*", F.round(F.try_divide(rate("hit_recorded", "n_recorded"), rate("hit_unrecorded", "n_unrecorded")), 6).alias("ratio"))


NAMES = [
    abstain_threshold, abstention_rates, asof_snapshot_counts, bm25_topk, bootstrap_ci, bootstrap_ci_pcg64, bpref, chain_tau, cohen_kappa, current_asof,
    dense_topk, disconnection_filter, distractor_taxonomy, first_stage, fresh_topk, graph_boost_topk, hard_checks, hop_split_topk, idf_table, judgment_pool,
    kendall_tau, link_fidelity, mcnemar_counts, mcnemar_p, mrr, ndcg_condensed, ndcg_raw, paired_delta, paired_power, postings_tf, rank_bias, recall_at_k,
    release_gate, rrf_hybrid_topk, scale_curve, scale_subset, slice_table, slot_chain_recall, two_step_topk, usage_mined, validity_windows, verdict_rows,
    version_cited_asof, version_roots,
]
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Record(spark, sf_dir))) for f in NAMES}

DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
BOOT = rf"""
, placed AS (SELECT label, delta, row_number() OVER (PARTITION BY label ORDER BY query_id) - 1 AS i FROM labelled_deltas),
sizes AS (SELECT label, count(*) AS n, avg(delta) AS mean FROM labelled_deltas GROUP BY 1),
draws AS (SELECT label, r, n, unnest(range(n)) AS j FROM sizes, range(2000) t(r)),
resampled AS (
  SELECT d.label, d.r, round(avg(p.delta), 9) AS m FROM draws d
  JOIN placed p ON p.label = d.label AND p.i = {DRAW.format("'7:' || r || ':' || j")} % d.n GROUP BY 1, 2),
limits AS (SELECT label, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM resampled GROUP BY 1),
boot AS (
  SELECT label, n, round(mean, 6) AS mean, CASE WHEN n >= 3 THEN round(lo, 6) END AS lo, CASE WHEN n >= 3 THEN round(hi, 6) END AS hi
  FROM sizes JOIN limits USING (label))
"""
HARD = r"""
, r AS (SELECT k.*, as_of, intent, committed_at, supersedes_id FROM rankings k JOIN queries USING (query_id) JOIN versions USING (card_id)),
hard AS (
  SELECT run, count(*) AS results, count(*) FILTER (committed_at > as_of) AS after_as_of,
         (SELECT count(*) FROM r o JOIN r n ON o.run = n.run AND o.query_id = n.query_id AND n.supersedes_id = o.card_id
          WHERE o.intent = 'current' AND o.rank < n.rank AND o.run = r.run) AS superseded_above,
         count(DISTINCT query_id) FILTER (query_id NOT IN (SELECT query_id FROM labels)) AS no_answer_answered
  FROM r GROUP BY run)
"""
HOP = r"""
, joined AS (
  SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.card_id, s.card_id) AS card_id, f.rank AS r1, s.score AS s2
  FROM first_stage f FULL JOIN {second} s ON f.query_id = s.query_id AND f.card_id = s.card_id),
banded AS (
  SELECT *, CASE WHEN r1 <= 5 THEN 0 WHEN s2 > 0 AND NOT coalesce(r1 <= 10, false) THEN 1 WHEN r1 <= 10 AND s2 > 0 THEN 2 WHEN r1 IS NOT NULL THEN 3 END AS band
  FROM joined),
split AS (
  SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY band, CASE WHEN band IN (1, 2) THEN -s2 ELSE r1 END, card_id) AS rank
  FROM banded WHERE band IS NOT NULL)
SELECT query_id, card_id, 1.0::DOUBLE / rank AS score, rank FROM split WHERE rank <= 10
"""
TWO_STEP = r"""
, posts_all AS (SELECT card_id, dl, term, count(*) AS tf FROM (SELECT card_id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
idf_all AS (
  SELECT term, ln(1.0::DOUBLE + (any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM posts_all, stats GROUP BY term),
weights AS (
  SELECT f.query_id, term, round(sum(tf * idf), 6) AS w FROM first_stage f JOIN posts_all p USING (card_id) JOIN idf_all USING (term)
  WHERE f.rank <= 5 GROUP BY 1, 2),
extra AS (
  SELECT query_id, term FROM (
    SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS k FROM weights
    ANTI JOIN terms USING (query_id, term)) WHERE k <= 10),
terms2 AS (SELECT query_id, term FROM terms UNION ALL SELECT * FROM extra),
bm2 AS (
  SELECT query_id, card_id,
         round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM terms2 JOIN posts_all USING (term) JOIN idf_all USING (term), stats GROUP BY 1, 2),
lex2 AS (
  SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank
  FROM bm2 JOIN queries USING (query_id) JOIN versions USING (card_id)
  WHERE score > 0 AND committed_at <= as_of AND (intent <> 'current' OR superseded_at IS NULL OR superseded_at > as_of)),
second AS (
  SELECT query_id, card_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 8) AS score
  FROM (SELECT * FROM lex2 WHERE rank <= 150 UNION ALL SELECT query_id, card_id, rank FROM dense_pool WHERE rank <= 150) GROUP BY 1, 2)
"""
SUBSET = rf"""
, needles AS (SELECT DISTINCT card_id FROM labels),
rest AS (
  SELECT card_id, row_number() OVER (ORDER BY {DRAW.format("card_id::VARCHAR || ':11'")}, card_id) AS k
  FROM versions WHERE card_id NOT IN (SELECT card_id FROM needles)),
sz AS (SELECT (SELECT count(*) FROM versions) AS total, (SELECT count(*) FROM needles) AS pinned)
"""
DROPPED = r"""
, ends AS (SELECT query_id, min(slot) AS lo, max(slot) AS hi FROM labels GROUP BY 1 HAVING min(slot) <> max(slot)),
hidden AS (SELECT query_id, card_id FROM labels JOIN ends USING (query_id) WHERE slot = lo),
tops AS (
  SELECT query_id, card_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS k FROM lex_seen ANTI JOIN hidden USING (query_id, card_id)) WHERE k <= 10
  UNION SELECT query_id, card_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS k FROM dense_seen ANTI JOIN hidden USING (query_id, card_id)) WHERE k <= 10),
single AS (SELECT DISTINCT t.query_id FROM tops t JOIN labels l ON l.query_id = t.query_id AND l.card_id = t.card_id JOIN ends e ON e.query_id = t.query_id WHERE l.slot = e.hi),
dropped AS (
  SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM single) THEN 'single_hop' WHEN query_id // 2 IN (SELECT query_id // 2 FROM single) THEN 'pair_dropped' ELSE 'kept' END AS dropped FROM ends)
"""
RIGHT = r"""
, pairs AS (SELECT a.mrr >= 0.5 AS right_a, b.mrr >= 0.5 AS right_b FROM (SELECT * FROM mrr WHERE run = 'bm25') a JOIN (SELECT * FROM mrr WHERE run = 'fresh') b USING (query_id)),
mc AS (SELECT count(*) FILTER (right_a AND NOT right_b) AS only_a, count(*) FILTER (NOT right_a AND right_b) AS only_b FROM pairs)
"""
TOP = "SELECT query_id, card_id, score, rank FROM {0} WHERE rank <= {1}"

ORACLE_SQL = {
    "bm25_topk": with_text(TOP.format("lex_all", 10)),
    "dense_topk": with_text(TOP.format("dense_all", 10)),
    "rrf_hybrid_topk": with_text("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM rrf100) WHERE rank <= 10"),
    "fresh_topk": with_text(TOP.format("fresh", 10)),
    "graph_boost_topk": with_text(TOP.format("boost", 10)),
    "first_stage": with_text(TOP.format("first_stage", 50)),
    "two_step_topk": with_text(TWO_STEP + HOP.format(second="second")),
    "hop_split_topk": with_text(HOP.format(second="boost_scores")),
    "postings_tf": with_text("SELECT term, count(*) AS n_cards, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf FROM postings GROUP BY term"),
    "idf_table": with_text("SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "asof_snapshot_counts": with_text("SELECT strftime(as_of, '%Y-%m-%d %H') AS as_of, line, count(*) AS n_cards, count(*) FILTER (superseded_at IS NULL OR superseded_at > as_of) AS n_current FROM versions JOIN (SELECT DISTINCT as_of FROM queries) ON committed_at <= as_of GROUP BY 1, 2"),
    "current_asof": with_text("SELECT card_id, line FROM versions, (SELECT min(as_of) AS as_of FROM queries) WHERE committed_at <= as_of AND (superseded_at IS NULL OR superseded_at > as_of)"),
    "version_roots": "SELECT doc_id AS card_id, min(doc_id) OVER (PARTITION BY text) AS root FROM documents",
    "validity_windows": with_text("SELECT card_id, coalesce(supersedes_id, -1) AS supersedes_id, coalesce(date_diff('hour', committed_at, superseded_at), -1) AS valid_hours FROM versions"),
    "version_cited_asof": with_text(", v AS (SELECT doc_id AS card_id, source AS line, min(doc_id) OVER (PARTITION BY text) AS root FROM documents), f AS (SELECT line, min(root) AS root FROM v GROUP BY 1) SELECT s.card_id AS src, f.root, max(d.card_id) AS dst FROM v s JOIN f ON s.line = f.line JOIN v d ON d.root = f.root AND d.card_id <= s.card_id GROUP BY 1, 2"),
    "judgment_pool": with_text("SELECT * FROM pool"),
    "ndcg_condensed": with_text("SELECT * FROM ndcg"),
    "ndcg_raw": with_text("SELECT p.run, p.query_id, round(coalesce(sum(grade / log2(rank + 1)), 0) / any_value(ideal), 6) AS ndcg FROM per p JOIN ideal USING (query_id) LEFT JOIN hits h ON h.run = p.run AND h.query_id = p.query_id AND rank <= 10 GROUP BY 1, 2"),
    "mrr": with_text("SELECT * FROM mrr"),
    "recall_at_k": with_text("SELECT p.run, p.query_id, round(count(h.card_id) / any_value(n_relevant)::DOUBLE, 6) AS recall FROM per p LEFT JOIN hits h ON h.run = p.run AND h.query_id = p.query_id AND rank <= 10 GROUP BY 1, 2"),
    "bpref": with_text("""
, non AS (SELECT * FROM pool ANTI JOIN labels USING (query_id, card_id)),
sz AS (SELECT p.*, (SELECT count(*) FROM non WHERE non.query_id = p.query_id) AS n_non FROM per p),
judged AS (SELECT query_id, card_id, 1 AS rel FROM labels UNION ALL SELECT query_id, card_id, 0 FROM non),
seen AS (
  SELECT run, r.query_id, rel, sum(1 - rel) OVER (PARTITION BY run, r.query_id ORDER BY rank) AS above FROM rankings r JOIN judged j ON r.query_id = j.query_id AND r.card_id = j.card_id),
parts AS (
  SELECT s.run, s.query_id, sum(1 - least(above, CASE WHEN n_non > 0 THEN least(n_relevant, n_non) ELSE n_relevant END)::DOUBLE / CASE WHEN n_non > 0 THEN least(n_relevant, n_non) ELSE n_relevant END) AS s
  FROM seen s JOIN sz ON sz.run = s.run AND sz.query_id = s.query_id WHERE rel = 1 GROUP BY 1, 2)
SELECT z.run, z.query_id, round(coalesce(s, 0) / n_relevant, 6) AS bpref FROM sz z LEFT JOIN parts p ON p.run = z.run AND p.query_id = z.query_id"""),
    "slot_chain_recall": with_text("""
, per_slot AS (
  SELECT run, w.query_id, w.slot, (SELECT count(*) > 0 FROM hits h WHERE h.run = runs.run AND h.query_id = w.query_id AND h.slot = w.slot AND h.rank <= 10)::INT AS in_top
  FROM runs, (SELECT DISTINCT query_id, slot FROM labels) w)
SELECT run, query_id, round(avg(in_top), 6) AS slot_recall, min(in_top)::DOUBLE AS chain_recall, arg_max(in_top, slot)::DOUBLE AS last_hop FROM per_slot GROUP BY 1, 2"""),
    "chain_tau": with_text("""
, pos AS (SELECT run, query_id, slot, min(rank) AS rank, arg_min(committed_at, rank) AS at FROM hits JOIN versions USING (card_id) GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.run, a.query_id, CASE WHEN (a.at < b.at) = (a.rank < b.rank) THEN 1 ELSE -1 END AS s FROM pos a JOIN pos b ON a.run = b.run AND a.query_id = b.query_id AND a.slot < b.slot
  WHERE a.at <> b.at AND a.rank <> b.rank)
SELECT run, query_id, round(avg(s), 6) AS tau, min((s > 0)::INT) AS in_order FROM pairs GROUP BY 1, 2"""),
    "paired_delta": with_text("SELECT label, query_id, round(delta, 6) AS delta FROM labelled_deltas"),
    "bootstrap_ci": with_text(BOOT + "SELECT * FROM boot"),
    "verdict_rows": with_text(BOOT + "SELECT label, n, mean, CASE WHEN lo IS NULL OR hi IS NULL THEN 'NO DATA' WHEN lo > 0 THEN 'BETTER' WHEN hi < 0 THEN 'WORSE' ELSE 'UNDERPOWERED' END AS verdict FROM boot"),
    "paired_power": with_text("SELECT label, count(*) AS n, round(stddev_samp(delta), 6) AS sd, round(2.8015852186::DOUBLE * stddev_samp(delta) / sqrt(count(*)), 6) AS mde, ceil(round((2.8015852186::DOUBLE * stddev_samp(delta) / 0.02::DOUBLE) ** 2, 6))::BIGINT AS n_required FROM labelled_deltas GROUP BY 1"),
    "mcnemar_counts": with_text(RIGHT + "SELECT 'all' AS label, only_a, only_b, CASE WHEN only_a + only_b > 0 THEN round(greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b)::DOUBLE, 6) END AS stat FROM mc"),
    "cohen_kappa": """
WITH k AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree FROM k),
c AS (SELECT sum(ca * cb)::DOUBLE AS x FROM (SELECT a AS v, count(*) AS ca FROM k GROUP BY 1) JOIN (SELECT b AS v, count(*) AS cb FROM k GROUP BY 1) USING (v))
SELECT n, agree, round(CASE WHEN x / (n * n) < 1 THEN (agree::DOUBLE / n - x / (n * n)) / (1 - x / (n * n)) END, 6) AS kappa FROM n, c
""",
    "kendall_tau": with_text("""
, xy AS (SELECT query_id AS key, a.mrr AS x, b.mrr AS y FROM (SELECT * FROM mrr WHERE run = 'bm25') a JOIN (SELECT * FROM mrr WHERE run = 'fresh') b USING (query_id)),
s AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s FROM xy a JOIN xy b ON a.key < b.key)
SELECT 'all' AS label, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant,
       round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0))::DOUBLE / nullif(count(*) FILTER (s <> 0), 0), 6) AS tau FROM s"""),
    "abstain_threshold": with_text("SELECT intent, count(*) AS n, round(quantile_cont(score, 0.1), 6) AS threshold FROM first_stage JOIN queries USING (query_id) WHERE rank = 1 GROUP BY 1"),
    "abstention_rates": with_text(", best AS (SELECT * FROM first_stage WHERE rank = 1) SELECT query_id IN (SELECT query_id FROM labels) AS answerable, count(*) AS n, count(*) FILTER (score >= (SELECT quantile_cont(score, 0.1) FROM best)) AS answered FROM best GROUP BY 1"),
    "hard_checks": with_text(HARD + "SELECT * FROM hard"),
    "distractor_taxonomy": with_text("""
, sources AS (SELECT query_id, min(card_id) AS source_card FROM labels GROUP BY 1),
wrong AS (SELECT * FROM rankings ANTI JOIN labels USING (query_id, card_id) WHERE rank = 1)
SELECT run, CASE WHEN v.superseded_at IS NOT NULL THEN 'superseded_version' WHEN d.source IS NOT DISTINCT FROM sd.source THEN 'sibling_on_line'
                 WHEN d.lang IS DISTINCT FROM sd.lang THEN 'lookalike_elsewhere' ELSE 'other' END AS kind, count(*) AS n
FROM wrong w JOIN sources s USING (query_id) JOIN versions v ON v.card_id = w.card_id JOIN documents d ON d.doc_id = w.card_id JOIN documents sd ON sd.doc_id = s.source_card GROUP BY 1, 2"""),
    "scale_subset": with_text(SUBSET + "SELECT card_id FROM needles UNION ALL SELECT card_id FROM rest, sz WHERE k <= greatest(0, total // 2 - pinned)"),
    "scale_curve": with_text(SUBSET + """
, shares AS (SELECT unnest([25, 50, 100])::BIGINT AS share),
keep AS (SELECT share, card_id FROM shares, needles UNION ALL SELECT share, card_id FROM shares, rest, sz WHERE k <= greatest(0, total * share // 100 - pinned)),
ranked AS (SELECT share, query_id, s.card_id, row_number() OVER (PARTITION BY share, query_id ORDER BY score DESC, s.card_id) AS rank FROM lex_seen s JOIN keep USING (card_id)),
firsts AS (SELECT share, r.query_id, min(rank) AS first FROM ranked r JOIN labels l ON r.query_id = l.query_id AND r.card_id = l.card_id WHERE rank <= 10 GROUP BY 1, 2)
SELECT share, count(*) AS n, round(avg(round(coalesce(1.0::DOUBLE / first, 0), 6)), 6) AS mrr
FROM (SELECT share, query_id FROM shares, (SELECT DISTINCT query_id FROM labels)) LEFT JOIN firsts USING (share, query_id) GROUP BY share"""),
    "slice_table": with_text("""
, tags AS (SELECT query_id, unnest(['all', intent, CASE WHEN len(string_split(qtext, ' ')) < 12 THEN 'short' ELSE 'long' END]) AS slice FROM queries)
SELECT slice, count(*) AS n, round(avg(delta), 6) AS mean FROM deltas JOIN tags USING (query_id) GROUP BY 1"""),
    "release_gate": with_text(BOOT + HARD + """
, b AS (SELECT max(lo) FILTER (label = 'all') AS lo, max(CASE WHEN hi < -0.02 THEN 1 ELSE 0 END) AS worse FROM boot),
h AS (SELECT sum(after_as_of + superseded_above)::BIGINT AS fails FROM hard WHERE run = 'fresh')
SELECT fails, worse::BIGINT AS worse, CASE WHEN fails > 0 OR worse > 0 THEN 'BLOCK' WHEN lo > 0 THEN 'SHIP AS DEFAULT' ELSE 'SHIP BEHIND A FLAG' END AS decision FROM b, h"""),
    "usage_mined": with_text(", three AS (SELECT r.*, l.card_id IS NULL AS miss FROM run_a r LEFT JOIN labels l ON r.query_id = l.query_id AND r.card_id = l.card_id WHERE rank <= 3) SELECT query_id, arg_min(card_id, miss::INT * 10 + rank) AS card_id, 2.0::DOUBLE AS grade FROM three GROUP BY 1"),
    "disconnection_filter": with_text(DROPPED + "SELECT query_id, dropped FROM dropped"),
    "link_fidelity": with_text("""
, rec AS (SELECT DISTINCT src, dst FROM text_edges), tru AS (SELECT card_id AS src, supersedes_id AS dst FROM versions WHERE supersedes_id IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM tru JOIN rec USING (src, dst)) AS shared, (SELECT count(*) FROM tru) AS n_true, (SELECT count(*) FROM rec) AS n_recorded)
SELECT shared, n_true, n_recorded, round(shared / nullif(n_true, 0)::DOUBLE, 6) AS recall, round(shared / nullif(n_recorded, 0)::DOUBLE, 6) AS precision FROM c"""),
    "rank_bias": with_text("""
, sources AS (SELECT query_id, min(card_id) AS src FROM labels GROUP BY 1),
rec AS (SELECT DISTINCT src, dst FROM text_edges), tru AS (SELECT card_id AS src, supersedes_id AS dst FROM versions WHERE supersedes_id IS NOT NULL),
links AS (SELECT *, true AS recorded FROM rec UNION ALL SELECT *, false FROM (SELECT * FROM tru EXCEPT SELECT * FROM rec)),
rows AS (SELECT recorded, t.card_id IS NOT NULL AS shown FROM sources JOIN links USING (src) LEFT JOIN (SELECT * FROM run_a WHERE rank <= 3) t ON t.query_id = sources.query_id AND t.card_id = links.dst),
c AS (
  SELECT count(*) FILTER (recorded) AS n_recorded, count(*) FILTER (recorded AND shown) AS hit_recorded, count(*) FILTER (NOT recorded) AS n_unrecorded, count(*) FILTER (NOT recorded AND shown) AS hit_unrecorded FROM rows)
SELECT *, round((hit_recorded / greatest(n_recorded, 1)::DOUBLE) / nullif(hit_unrecorded / greatest(n_unrecorded, 1)::DOUBLE, 0), 6) AS ratio FROM c"""),
}
