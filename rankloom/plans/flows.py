"""Named queries: extraction in parts, replaced and updated tables, held-out comparisons, query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import draw, entity_key, tokens
from rankloom.operators import asof, extraction, judge, metrics
from rankloom.plans import networks, retrieval
from rankloom.plans.networks import RANK_ROLE, with_notes
from rankloom.plans.prelude import with_text
from rankloom.plans.retrieval import _rankings
from rankloom.sources.generator import paraphrased
from rankloom.sources.record import Record
from rankloom.sources.tables import EXTRACTED, Tables
from rankloom.storage import new_path, written

# ---- extraction --------------------------------------------------------------------------


def _found(rec: Record) -> tuple[DataFrame, DataFrame]:
    notes = written(networks._notes(rec), "notes")
    return notes, written(extraction.mentions(notes), "found")


def whole_name_roles(rec: Record) -> DataFrame:
    notes, found = _found(rec)
    return extraction.whole_name_roles(notes, found.where("class = 'Method'"))


def cooccurrence_relations(rec: Record) -> DataFrame:
    return extraction.cooccurrence(_found(rec)[1])


def surface_mode(rec: Record) -> DataFrame:
    """The commonest spelling of every part; of equally common ones the first by card and line."""
    found = _found(rec)[1].where("class = 'Method'").select(entity_key(F.col("surface")).alias("key"), "surface", "card_id", "sentence_no")
    return extraction.commonest(found, ["key"], "surface", ["card_id", "sentence_no"])


def bridge_pairs(rec: Record) -> DataFrame:
    """Parts with the number of pairs of an order that uses and another that introduces them."""
    lines = networks._note_lines(rec).groupBy("card_id", F.col("l_partkey").alias("entity"))
    pairs = lines.agg(F.bool_or(F.col("role") == "uses").alias("uses"), F.bool_or(F.col("role") == "introduces").alias("defines"))
    return extraction.bridge_counts(pairs).where("n_bridges > 0")


def pick_cards(rec: Record) -> DataFrame:
    """Cards that answer a query first, then others in seeded order, 300 in all."""
    return extraction.pick_cards(rec.versions.select("card_id", "line"), rec.labels, 300, 20260924)


def extraction_grades(rec: Record) -> DataFrame:
    """All grades of two extractors of the notes: the pattern one, and one that reads even orders only and calls every name a method."""
    lines = written(networks._note_lines(rec), "lines")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    data = F.concat(F.lit("d"), F.col("dataset"))
    truth = {
        "entities": lines.select(part.alias("entity_id"), F.concat(F.lit("Part-"), F.col("l_partkey").cast("string")).alias("name"), F.lit("KernelMethod").alias("kind"), F.lit("Method").alias("parent_kind"))
        .union(lines.select(data, "dataset", F.lit("Benchmark"), F.lit("Dataset")))
        .distinct(),
        "mentions": lines.select("card_id", part.alias("entity_id"), "surface", "role").union(lines.select("card_id", data, "dataset", "role")),
        "facts": lines.select("card_id", part.alias("subj"), F.lit("evaluated_on").alias("rel"), data.alias("obj"), F.lit(None).cast("string").alias("value")).distinct(),
    }
    found = _found(rec)[1].where("class in ('Method', 'Dataset')")
    out = None
    for name, rows, kind in (("patterns", found, F.col("class")), ("half", found.where("card_id % 2 = 0"), F.lit("Method"))):
        rows = written(rows.withColumn("entity_id", entity_key(F.col("surface"))), "ext")
        ext = {
            "cards": rows.select("card_id").distinct(),
            "entities": rows.groupBy("entity_id").agg(F.min("surface").alias("name"), F.min(kind).alias("kind")),
            "mentions": rows.select("card_id", "entity_id", "surface", "role"),
            "facts": extraction.cooccurrence(rows).select("card_id", entity_key(F.col("subj")).alias("subj"), F.lit("evaluatedOn").alias("rel"), entity_key(F.col("obj")).alias("obj"), F.lit(None).cast("string").alias("value")),
            "classes": rows.select(F.col("class"), F.lit(None).cast("string").alias("parent")).distinct(),
        }
        one = extraction.grade(truth, ext).select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- tables ------------------------------------------------------------------------------


def embedding_update(rec: Record) -> DataFrame:
    """Vectors of cards with an even number turned round, in the stored table; the others stay."""
    tables = Tables(rec.spark, new_path(rec.spark, "tables"))
    tables.load(embeddings=rec.table("embeddings").select("vec_id", "embedding"))
    tables.update("embeddings", rec.table("embeddings").where("vec_id % 2 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")), "vec_id", "embedding")
    return tables.read("embeddings").select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), F.size("embedding").alias("dim"))


def usage_mined_replaced(rec: Record) -> DataFrame:
    """Labels by provenance after the usage-mined ones were written twice: the second set replaces the first, planted ones stay."""
    tables = Tables(rec.spark, new_path(rec.spark, "tables"))
    columns = ["query_id", "card_id", "grade"]
    tables.replace("planted", qrels=rec.labels.select(*columns, F.lit("planted").alias("provenance")))
    mined = written(retrieval.usage_mined(rec), "mined")
    for rows in (mined.withColumn("card_id", F.col("card_id") + 1), mined):
        tables.replace("usage_mined", qrels=rows.select(*columns, F.lit("usage_mined").alias("provenance")))
    return tables.read("qrels")


def write_back(rec: Record) -> DataFrame:
    """Rows by table and source after one extractor wrote twice and another, of other cards, once."""
    notes, found = _found(rec)
    tables = Tables(rec.spark, new_path(rec.spark, "tables"))

    def frames(rows: DataFrame) -> dict[str, DataFrame]:
        named = rows.select(F.col("card_id").cast("string").alias("card_id"), entity_key(F.col("surface")).alias("entity_id"), "surface", "role", "class").distinct()
        return {
            "extracted_cards": named.select("card_id").distinct(),
            "entities": named.groupBy("entity_id").agg(F.min("surface").alias("name"), F.min("class").alias("kind")),
            "mentions": named,
            "onto_classes": named.select("class", F.lit(None).cast("string").alias("parent")).distinct(),
        }

    tables.write_back("patterns", **frames(found))
    tables.write_back("methods", **frames(found.where("class = 'Method'")))
    tables.write_back("patterns", **frames(found.where("card_id % 2 = 0")))
    out = None
    for name in EXTRACTED:
        one = tables.read(name).groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "source", "n")
        out = one if out is None else out.unionByName(one)
    return out


def dropped_flags(rec: Record) -> DataFrame:
    """The stored queries with their flag of the disconnection filter, set twice."""
    tables = Tables(rec.spark, new_path(rec.spark, "tables"))
    tables.load(queries=rec.queries.select("query_id", "intent", F.lit("old").alias("dropped")))
    tables.set_flag("queries", "query_id", "dropped", retrieval.disconnection_filter(rec).where("dropped <> 'kept'"))
    return tables.read("queries").select("query_id", "intent", F.coalesce("dropped", F.lit("none")).alias("dropped"))


# ---- query sets --------------------------------------------------------------------------


def snapshot_limit(rec: Record) -> DataFrame:
    """The first 100 cards of the record as it stood at the earliest time of a query."""
    at = F.broadcast(rec.queries.agg(F.min("as_of").alias("as_of")))  # one row
    seen = rec.versions.join(at, asof.in_snapshot(F.col("as_of")))
    return seen.orderBy("committed_at", "card_id").limit(100).select("card_id", "line")


def no_answer_queries(rec: Record) -> DataFrame:
    """Items that no card answers at any time, asked at the end of the record."""
    everywhere = rec.containing().select("query_id").distinct()
    end = rec.versions.agg(F.date_format(F.max("committed_at"), "yyyy-MM-dd HH").alias("as_of"))
    q = rec.queries.select("query_id", F.when(F.size(tokens(F.col("qtext"))) < 12, "short").otherwise("long").alias("slice"))
    return q.join(everywhere, "query_id", "left_anti").crossJoin(end)  # one row


def paraphrase(rec: Record) -> DataFrame:
    """The items in other words: most terms kept, some cut short, a few replaced."""
    return rec.queries.select("query_id", paraphrased(tokens(F.col("qtext")), F.col("query_id"), 5).alias("qtext"))


def judge_prompts(rec: Record) -> DataFrame:
    """The question to a judge for every query: what it asks and the first five of both runs, as line and number."""
    name = rec.versions.select("card_id", F.concat_ws(" ", "line", F.col("card_id").cast("string")).alias("text"))
    r = _rankings(rec).where("rank <= 5").join(name, "card_id")
    shown = lambda run: F.transform(F.sort_array(F.collect_list(F.when(F.col("run") == run, F.struct("rank", "text")))), lambda x: x["text"])
    per = r.groupBy("query_id").agg(shown("bm25").alias("a"), shown("fresh").alias("b")).join(rec.queries, "query_id")
    return per.select("query_id", judge.prompt(F.col("qtext"), F.col("a"), F.col("b")).alias("prompt"))


# ---- held out, matched, examples -----------------------------------------------------------


def gate_holdout(rec: Record) -> DataFrame:
    """Mean difference over all queries, over those whose source card is on a held-out fifth of the lines, and over the rest."""
    source = retrieval._sources(rec).select("query_id", "source_line")
    lines = source.select("source_line").distinct().withColumn("h", draw(F.col("source_line"), F.lit("20260909")))
    place = F.row_number().over(Window.orderBy("h", "source_line"))  # lines are the sources of the record
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    held = lines.withColumn("k", place).withColumn("n", total).where(F.col("k") <= F.greatest(F.floor(F.col("n") / 5), F.lit(1))).select("source_line", F.lit(True).alias("held"))
    d = retrieval._deltas(rec).where("label = 'all'").select("query_id", "delta").join(source.join(held, "source_line", "left"), "query_id")
    rows = d.select("delta", F.explode(F.array(F.lit("overall"), F.when(F.col("held"), "held out").otherwise("dev"))).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("mean"))


def abstention_matched(rec: Record) -> DataFrame:
    """Both runs at their own threshold for a tenth of false abstentions on one half of the answerable queries: how often
    they abstain on the other half, and how often they answer what has no answer."""
    best = _rankings(rec).where("rank = 1").select("run", "query_id", "score")
    has = rec.labels.select("query_id").distinct().withColumn("has", F.lit(True))
    rows = written(best.join(has, "query_id", "left").withColumn("part", F.when(F.col("has").isNull(), "none").when(F.col("query_id") % 2 == 0, "dev").otherwise("held")), "best")
    limit = rows.where("part = 'dev'").groupBy("run").agg(F.percentile("score", 0.1).alias("threshold"))
    joined = rows.join(F.broadcast(limit), "run")  # a row for each run
    rate = lambda part, hit: F.round(F.try_divide(F.count_if((F.col("part") == part) & hit), F.count_if(F.col("part") == part)), 6)
    above = F.col("score") >= F.col("threshold")
    return joined.groupBy("run").agg(F.round(F.max("threshold"), 6).alias("threshold"), rate("none", above).alias("false_answers"), rate("held", ~above).alias("false_abstentions"), F.count_if(F.col("part") == "none").alias("n_no_answer"))


def hard_check_examples(rec: Record) -> DataFrame:
    """Per run and check the number of failures and up to three of them: a result after the query's time, a superseded
    card above its successor for a current question, an answer to a question without one."""
    r = written(_rankings(rec).join(rec.queries.select("query_id", "as_of", "intent"), "query_id").join(rec.versions.select("card_id", "committed_at", "supersedes_id"), "card_id"), "checked")
    late = r.where("committed_at > as_of").select("run", F.lit("after_as_of").alias("check"), "query_id", "card_id")
    o, n = r.where("intent = 'current'").alias("o"), r.alias("n")
    above = o.join(n, (F.col("o.run") == F.col("n.run")) & (F.col("o.query_id") == F.col("n.query_id")) & (F.col("n.supersedes_id") == F.col("o.card_id")) & (F.col("o.rank") < F.col("n.rank")))
    above = above.select("o.run", F.lit("superseded_above").alias("check"), "o.query_id", "o.card_id")
    empty = r.where("rank = 1").join(rec.labels.select("query_id").distinct(), "query_id", "left_anti").select("run", F.lit("no_answer_answered").alias("check"), "query_id", "card_id")
    fails = late.unionByName(above).unionByName(empty)
    k = F.row_number().over(Window.partitionBy("run", "check").orderBy("query_id", "card_id"))
    shown = F.concat_ws(":", F.col("query_id").cast("string"), F.col("card_id").cast("string"))
    few = F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", shown.alias("e")))))["e"], " ")
    return fails.withColumn("k", k).groupBy("run", "check").agg(F.count(F.lit(1)).alias("fails"), few.alias("examples"))


def chain_exact(rec: Record) -> DataFrame:
    """Per run the queries whose every slot was found in the order of evidence."""
    t = metrics.order_exact(_rankings(rec), rec.labels, rec.versions)
    return t.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"))


def slot_overlaps(rec: Record) -> DataFrame:
    """Queries by whether a card stands in more than one of their slots, which a question must not have."""
    per = rec.labels.groupBy("query_id", "card_id").agg(F.count_distinct("slot").alias("s")).groupBy("query_id").agg(F.max("s").alias("s"))
    return per.groupBy((F.col("s") == 1).alias("disjoint")).agg(F.count(F.lit(1)).alias("n"))


NAMES = [
    abstention_matched, bridge_pairs, chain_exact, cooccurrence_relations, dropped_flags, embedding_update, extraction_grades, gate_holdout, hard_check_examples, judge_prompts,
    no_answer_queries, paraphrase, pick_cards, slot_overlaps, snapshot_limit, surface_mode, usage_mined_replaced, whole_name_roles, write_back,
]
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Record(spark, sf_dir))) for f in NAMES}

_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
ORACLE_SQL = {
    "whole_name_roles": with_notes(f"SELECT card_id, surface, arg_min(role, k) AS role FROM (SELECT *, {RANK_ROLE} AS k FROM note_lines) GROUP BY 1, 2"),
    "cooccurrence_relations": with_notes("SELECT DISTINCT card_id, surface AS subj, 'evaluated_on' AS rel, dataset AS obj FROM note_lines UNION ALL SELECT DISTINCT card_id, dataset, 'measured_by', 'price-score' FROM note_lines"),
    "surface_mode": with_notes("""
SELECT 'part' || l_partkey AS key, arg_min(surface, (-n, first)) AS surface, max(n) AS n FROM (
  SELECT l_partkey, surface, count(*) AS n, min((card_id, k)) AS first FROM numbered GROUP BY 1, 2) GROUP BY l_partkey""",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY l_linenumber, l_partkey) - 1 AS k FROM note_lines)"),
    "bridge_pairs": with_notes("""
SELECT entity, u * d - b AS n_bridges FROM (
  SELECT l_partkey AS entity, count(*) FILTER (uses) AS u, count(*) FILTER (defines) AS d, count(*) FILTER (uses AND defines) AS b FROM (
    SELECT card_id, l_partkey, bool_or(role = 'uses') AS uses, bool_or(role = 'introduces') AS defines FROM note_lines GROUP BY 1, 2) GROUP BY 1) WHERE u * d - b > 0"""),
    "pick_cards": with_text(f"SELECT card_id, line FROM versions ORDER BY card_id NOT IN (SELECT card_id FROM labels), {_DRAW.format("card_id || ':20260924'")}, card_id LIMIT 300"),
    "embedding_update": "SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 5) AS first, len(embedding) AS dim FROM embeddings",
    "usage_mined_replaced": with_text("""
, three AS (SELECT r.*, l.card_id IS NULL AS miss FROM run_a r LEFT JOIN labels l ON r.query_id = l.query_id AND r.card_id = l.card_id WHERE rank <= 3)
SELECT query_id, card_id, grade, 'planted' AS provenance FROM labels
UNION ALL SELECT query_id, arg_min(card_id, miss::INT * 10 + rank), 2.0::DOUBLE, 'usage_mined' FROM three GROUP BY 1"""),
    "write_back": with_notes("""
SELECT 'extracted_cards' AS "table", source, count(DISTINCT card_id) AS n FROM named GROUP BY source
UNION ALL SELECT 'entities', source, count(DISTINCT key) FROM named GROUP BY source
UNION ALL SELECT 'mentions', source, count(*) FROM (SELECT DISTINCT source, card_id, key, surface, role, class FROM named) GROUP BY source
UNION ALL SELECT 'onto_classes', source, count(DISTINCT class) FROM named GROUP BY source""",
        """one AS (
  SELECT card_id, surface, 'part' || l_partkey AS key, 'Method' AS class, role FROM note_lines
  UNION ALL SELECT card_id, dataset, lower(replace(dataset, '-', '')), 'Dataset', role FROM note_lines UNION ALL SELECT card_id, 'price-score', 'pricescore', 'Metric', role FROM note_lines),
named AS (SELECT 'patterns' AS source, * FROM one WHERE card_id % 2 = 0 UNION ALL SELECT 'methods', * FROM one WHERE class = 'Method')"""),
    "dropped_flags": with_text(retrieval.DROPPED + "SELECT query_id, intent, coalesce(nullif(dropped, 'kept'), 'none') AS dropped FROM queries LEFT JOIN dropped USING (query_id)"),
    "snapshot_limit": with_text("SELECT card_id, line FROM versions WHERE committed_at <= (SELECT min(as_of) FROM queries) ORDER BY committed_at, card_id LIMIT 100"),
    "no_answer_queries": with_text("""
SELECT query_id, CASE WHEN len(regexp_extract_all(lower(qtext), '[a-z0-9]+')) < 12 THEN 'short' ELSE 'long' END AS slice, (SELECT strftime(max(committed_at), '%Y-%m-%d %H') FROM versions) AS as_of
FROM queries q WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, q.qtext))"""),
    "paraphrase": with_text(f"""
, w AS (SELECT query_id, unnest(regexp_extract_all(lower(qtext), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower(qtext), '[a-z0-9]+'), 1) - 1 AS i FROM queries),
u AS (SELECT *, {_DRAW.format("'5:' || query_id || ':' || i")} / 4294967296.0::DOUBLE AS u FROM w)
SELECT query_id, string_agg(CASE WHEN u < 0.62 THEN t WHEN u < 0.86 THEN left(t, greatest(5, length(t) - 2)) ELSE left(reverse(t), 6) END, ' ' ORDER BY i) AS qtext FROM u GROUP BY 1"""),
    "judge_prompts": with_text("""
, shown AS (SELECT run, query_id, string_agg(rank || '. ' || line || ' ' || card_id, chr(10) ORDER BY rank) AS cards FROM rankings JOIN versions USING (card_id) WHERE rank <= 5 GROUP BY 1, 2)
SELECT query_id, 'Which list answers the question better? Reply with A, B or TIE.' || chr(10) || chr(10) || 'Question: ' || qtext || chr(10) || chr(10) || 'List A' || chr(10) || coalesce(a.cards, '')
       || chr(10) || chr(10) || 'List B' || chr(10) || coalesce(b.cards, '') AS prompt
FROM (SELECT * FROM shown WHERE run = 'bm25') a FULL JOIN (SELECT * FROM shown WHERE run = 'fresh') b USING (query_id) JOIN queries USING (query_id)"""),
    "gate_holdout": with_text(f"""
, src AS (SELECT query_id, line FROM (SELECT query_id, min(card_id) AS card_id FROM labels GROUP BY 1) JOIN versions USING (card_id)),
lines AS (SELECT line, row_number() OVER (ORDER BY {_DRAW.format("line || ':20260909'")}, line) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT line FROM src)),
d AS (SELECT delta, k <= greatest(n // 5, 1) AS held FROM deltas JOIN src USING (query_id) JOIN lines USING (line)),
rows AS (SELECT 'overall' AS label, delta FROM d UNION ALL SELECT CASE WHEN held THEN 'held out' ELSE 'dev' END, delta FROM d)
SELECT label, count(*) AS n, round(avg(delta), 6) AS mean FROM rows GROUP BY 1"""),
    "abstention_matched": with_text("""
, b AS (
  SELECT run, query_id, score, CASE WHEN query_id NOT IN (SELECT query_id FROM labels) THEN 'none' WHEN query_id % 2 = 0 THEN 'dev' ELSE 'held' END AS part FROM rankings WHERE rank = 1),
t AS (SELECT run, quantile_cont(score, 0.1) AS threshold FROM b WHERE part = 'dev' GROUP BY 1)
SELECT run, round(max(threshold), 6) AS threshold, round(count(*) FILTER (part = 'none' AND score >= threshold) / nullif(count(*) FILTER (part = 'none'), 0)::DOUBLE, 6) AS false_answers,
       round(count(*) FILTER (part = 'held' AND score < threshold) / nullif(count(*) FILTER (part = 'held'), 0)::DOUBLE, 6) AS false_abstentions, count(*) FILTER (part = 'none') AS n_no_answer
FROM b JOIN t USING (run) GROUP BY run"""),
    "hard_check_examples": with_text("""
, r AS (SELECT k.*, as_of, intent, committed_at, supersedes_id FROM rankings k JOIN queries USING (query_id) JOIN versions USING (card_id)),
fails AS (
  SELECT run, 'after_as_of' AS "check", query_id, card_id FROM r WHERE committed_at > as_of
  UNION ALL SELECT o.run, 'superseded_above', o.query_id, o.card_id FROM r o JOIN r n ON o.run = n.run AND o.query_id = n.query_id AND n.supersedes_id = o.card_id AND o.rank < n.rank WHERE o.intent = 'current'
  UNION ALL SELECT run, 'no_answer_answered', query_id, card_id FROM r WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM labels)),
k AS (SELECT *, row_number() OVER (PARTITION BY run, "check" ORDER BY query_id, card_id) AS k FROM fails)
SELECT run, "check", count(*) AS fails, string_agg(query_id || ':' || card_id, ' ' ORDER BY k) FILTER (k <= 3) AS examples FROM k GROUP BY 1, 2"""),
    "chain_exact": with_text("""
, f AS (
  SELECT run, h.query_id, slot, arg_min(committed_at, rank) AS at, min(rank) AS rank FROM hits h JOIN versions USING (card_id) GROUP BY 1, 2, 3),
wanted AS (SELECT run, query_id, n FROM runs, (SELECT query_id, count(DISTINCT slot) AS n FROM labels GROUP BY 1)),
got AS (SELECT run, query_id, count(*) AS n FROM f GROUP BY 1, 2),
bad AS (SELECT DISTINCT a.run, a.query_id FROM f a JOIN f b ON a.run = b.run AND a.query_id = b.query_id AND a.slot < b.slot WHERE (a.at < b.at AND a.rank > b.rank) OR (a.at > b.at AND a.rank < b.rank))
SELECT w.run, count(*) AS n, count(*) FILTER (g.n = w.n AND b.query_id IS NULL) AS n_exact
FROM wanted w LEFT JOIN got g ON g.run = w.run AND g.query_id = w.query_id LEFT JOIN bad b ON b.run = w.run AND b.query_id = w.query_id GROUP BY 1"""),
    "slot_overlaps": with_text("SELECT s = 1 AS disjoint, count(*) AS n FROM (SELECT query_id, max(s) AS s FROM (SELECT query_id, card_id, count(DISTINCT slot) AS s FROM labels GROUP BY 1, 2) GROUP BY 1) GROUP BY 1"),
}
