"""Named queries: dated edges, walks, PageRank, entity graphs, samples, extraction and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import clean_title, tokens
from rankloom.operators import asof, embed, extraction, graph, judge, metrics, ranking, stats
from rankloom.plans.prelude import with_orders, with_text
from rankloom.plans.retrieval import _rankings, usage_mined
from rankloom.sources.record import Record
from rankloom.storage import written

AS_OF = "timestamp_ntz'1998-01-01 00:00:00'"


# ---- dated edges ---------------------------------------------------------------------


def _raw_edges(rec: Record) -> DataFrame:
    """Orders cite the order before them by key on a part, so about half of the edges point to the future."""
    lines = rec.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    part = Window.partitionBy("l_partkey").orderBy("l_orderkey")
    e = lines.select(F.col("l_orderkey").alias("src"), F.lag("l_orderkey").over(part).alias("dst"), F.when(F.col("line") == 1, "parent").otherwise("citation").alias("kind"))
    return e.where("dst is not null")


def time_valid_edges(rec: Record) -> DataFrame:
    return asof.checked_edges(_raw_edges(rec), rec.orders).where("kept").select("src", "dst", "kind")


def forward_edges_dropped(rec: Record) -> DataFrame:
    return asof.checked_edges(_raw_edges(rec), rec.orders).groupBy("kind").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def indegree_asof(rec: Record) -> DataFrame:
    d = asof.in_degrees(rec.order_edges, rec.walks)
    return d.groupBy(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "in_degree").agg(F.count(F.lit(1)).alias("n_cards"))


# ---- walks ---------------------------------------------------------------------------


def _roots(rec: Record) -> DataFrame:
    first = Window.partitionBy("line").orderBy("committed_at", "card_id")
    return rec.orders.select("card_id", F.first("card_id").over(first).alias("root"))


def _walk(rec: Record, **options) -> DataFrame:
    return graph.walk(rec.walk_seeds, rec.walks, rec.orders, _roots(rec), rec.order_edges, **options)


def dag_walk_depth(rec: Record) -> DataFrame:
    return _walk(rec)


def dag_walk_blind_depth(rec: Record) -> DataFrame:
    return _walk(rec, blind=True).groupBy("query_id", "depth").agg(F.count(F.lit(1)).alias("n_cards"))


def dag_links(rec: Record) -> DataFrame:
    return graph.induced(_walk(rec), rec.order_edges).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst"))


def ppr_subgraph(rec: Record) -> DataFrame:
    nodes = written(_walk(rec).select("query_id", "card_id"), "nodes")
    seeds = rec.walk_seeds.select("query_id", "card_id", (1.0 / F.col("rank")).alias("weight"))
    return graph.pagerank(nodes, graph.induced(nodes, rec.order_edges), seeds)


def dag_walk_topk(rec: Record) -> DataFrame:
    """Seeds as first stage, PageRank on the walk's links as second, split by hops."""
    return ranking.hop_split(rec.walk_seeds, ppr_subgraph(rec), 10)


def bfs_sample(rec: Record) -> DataFrame:
    sizes = rec.orders.select(F.col("card_id").alias("node"), F.lit(1).alias("size"))
    return graph.snowball(rec.order_edges, sizes, 1, 200).select("node", "depth")


def snowball_sample(rec: Record) -> DataFrame:
    """From the 20 orders of highest degree until half of the line items are in."""
    sizes = rec.table("lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    return graph.snowball(rec.order_edges, sizes, 20, rec.table("lineitem").count() // 2).select("node", "depth")


def dag_snapshot_view(rec: Record) -> DataFrame:
    """Nodes of the order graph at one time by state, with the edges among them."""
    at = F.expr(AS_OF)
    live = rec.orders.where(F.col("committed_at") <= at)
    state = F.when(F.col("superseded_at").isNull() | (F.col("superseded_at") > at), "current").otherwise("superseded")
    nodes = live.select("card_id", state.alias("state"))
    out = rec.order_edges.where(F.col("valid_from") <= at).select(F.col("src").alias("card_id")).groupBy("card_id").agg(F.count(F.lit(1)).alias("n_out"))
    return nodes.join(out, "card_id", "left").select("card_id", "state", F.coalesce("n_out", F.lit(0)).alias("n_out"))


# ---- entities ------------------------------------------------------------------------


def _facts(rec: Record) -> DataFrame:
    """Part supplied by supplier, valid from a shipment until the part's next one."""
    part = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    f = rec.table("lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").alias("valid_from"), F.lead("l_shipdate").over(part).alias("valid_until"))
    return f.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("subj"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("obj"), "valid_from", "valid_until")


def _mentions(rec: Record) -> DataFrame:
    lines = rec.table("lineitem").select(F.col("l_orderkey").alias("card_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity_id")).distinct()
    return lines.join(rec.orders.select("card_id", F.col("committed_at").alias("valid_from")), "card_id")


def _region_walks(rec: Record) -> DataFrame:
    return rec.table("region").select(
        F.col("r_regionkey").cast("long").alias("query_id"),
        F.expr("timestampadd(DAY, 60 * r_regionkey, timestamp_ntz'1996-01-01 00:00:00')").alias("as_of"),
        F.when(F.col("r_regionkey") % 2 == 0, "current").otherwise("history").alias("intent"),
    )


def _region_seeds(rec: Record) -> DataFrame:
    n = rec.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("query_id"))
    c = rec.table("customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("line"), "query_id")
    o = rec.orders.join(c, "line").join(_region_walks(rec), "query_id").where(F.col("committed_at") <= F.col("as_of"))
    return ranking.top(o.select("query_id", "card_id", F.col("price").alias("score")), 10)


def _onto(rec: Record, blind: bool) -> DataFrame:
    times, seeds = _region_walks(rec), written(_region_seeds(rec), "seeds")
    mentions, facts = graph.within_reach(_mentions(rec), _facts(rec), seeds)
    links = graph.entity_links(mentions, facts, times, blind)
    weights = seeds.select("query_id", F.concat(F.lit("c"), F.col("card_id").cast("string")).alias("card_id"), (1.0 / F.col("rank")).alias("weight"))
    p = graph.pagerank(None, links, weights, only="c")
    cards = p.select("query_id", F.substring("card_id", 2, 30).cast("long").alias("card_id"), "score")
    # the result is masked by time even if the walk was blind
    cards = cards.join(rec.orders.select("card_id", "committed_at"), "card_id").join(times, "query_id").where(F.col("committed_at") <= F.col("as_of"))
    return ranking.hop_split(seeds, cards.select("query_id", "card_id", "score"), 10)


def onto_rule_walk(rec: Record) -> DataFrame:
    """Evidence grows along the entity graph: from the three best seeds, twice the three best new cards of a walk that
    starts at all evidence alike. Result: evidence by date, then the seeds that are not part of it."""
    times, seeds = _region_walks(rec), written(_region_seeds(rec), "seeds")
    # the second walk starts at what the first has reached, so both stay within twice its steps
    mentions, facts = graph.within_reach(_mentions(rec), _facts(rec), seeds.where("rank <= 3"), 2 * graph.ITERATIONS)
    links = written(graph.entity_links(mentions, facts, times), "rule-links")
    at = rec.orders.select("card_id", "committed_at")
    evidence = seeds.where("rank <= 3").select("query_id", "card_id")
    for _ in range(2):
        weights = evidence.select("query_id", F.concat(F.lit("c"), F.col("card_id").cast("string")).alias("card_id"), F.lit(1.0).alias("weight"))
        p = graph.pagerank(None, links, weights, only="c")
        near = p.select("query_id", F.substring("card_id", 2, 30).cast("long").alias("card_id"), "score")
        near = near.join(at, "card_id").join(times, "query_id").where(F.col("committed_at") <= F.col("as_of")).join(evidence, ["query_id", "card_id"], "left_anti")
        evidence = written(evidence.union(ranking.top(near.select("query_id", "card_id", "score"), 3).select("query_id", "card_id")), "rule-evidence")
    first = evidence.join(at, "card_id").select("query_id", "card_id", F.lit(0).alias("band"), F.unix_micros(F.col("committed_at").cast("timestamp")).alias("inside"))
    tail = seeds.join(evidence, ["query_id", "card_id"], "left_anti").select("query_id", "card_id", F.lit(1).alias("band"), F.col("rank").alias("inside"))
    order = Window.partitionBy("query_id").orderBy("band", "inside", "card_id")
    return first.union(tail).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("query_id", "card_id", "rank")


def onto_walk_topk(rec: Record) -> DataFrame:
    return _onto(rec, blind=False)


def onto_walk_blind_topk(rec: Record) -> DataFrame:
    return _onto(rec, blind=True)


def onto_snapshot_view(rec: Record) -> DataFrame:
    """Facts that hold at one time: expired and future ones are gone."""
    at = F.expr(AS_OF)
    f = _facts(rec).where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    return f.groupBy("subj", "obj").agg(F.count(F.lit(1)).alias("n"))


# ---- samples and joins ---------------------------------------------------------------


def round_robin_sample(rec: Record) -> DataFrame:
    rows = rec.table("documents").select(F.col("doc_id").alias("card_id"), F.coalesce("lang", F.lit("none")).alias("family"))
    return asof.round_robin(rows, "family", "card_id", 100, 5).select("card_id", "family")


def title_join(rec: Record) -> DataFrame:
    """Suppliers and customers with the same number as title; the first of equal titles counts, collisions are kept as a number."""
    title = lambda c: clean_title(F.regexp_replace(c, "^[A-Za-z]+#", "No. "))
    left = rec.table("supplier").select(title(F.col("s_name")).alias("title"), F.col("s_suppkey").alias("id"))
    right = rec.table("customer").select(title(F.col("c_name")).alias("title"), F.col("c_custkey").alias("id"))
    first = lambda d, n: d.where("title <> ''").groupBy("title").agg(F.min("id").alias(n), (F.count(F.lit(1)) - 1).alias(f"{n}_collisions"))
    return first(left, "left_id").join(first(right, "right_id"), "title")


# ---- labels --------------------------------------------------------------------------


def dag_mined_labels(rec: Record) -> DataFrame:
    """A card's own title words as query; what it cites is relevant with grade 2."""
    e = rec.text_edges.select(F.col("src").alias("query_id"), F.col("dst").alias("card_id"), F.lit(2.0).alias("grade"))
    title = rec.texts.select(F.col("card_id").alias("query_id"), F.concat_ws(" ", F.slice(tokens(F.col("txt")), 1, 8)).alias("qtext"))
    return e.join(title, "query_id")


def known_item_queries(rec: Record) -> DataFrame:
    """Nine words of a card in seeded order as query, the card itself as answer; a query for the first card of every line."""
    from rankloom.functions.text import draw

    first = rec.versions.groupBy("line").agg(F.min("card_id").alias("card_id"))
    words = rec.texts.join(first, "card_id").select("card_id", F.explode(F.array_distinct(tokens(F.col("txt")))).alias("w"))
    order = Window.partitionBy("card_id").orderBy(draw(F.col("w"), F.lit("3")), "w")
    picked = words.withColumn("k", F.row_number().over(order)).where("k <= 9")
    return picked.groupBy("card_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"])).alias("qtext"))


def shared_words(pairs: DataFrame) -> DataFrame:
    """The share of query words that a text has: the offline scorer of candidates."""
    qw = F.array_distinct(tokens(F.col("qtext")))
    return pairs.select("query_id", "card_id", (F.size(F.array_intersect(qw, tokens(F.col("txt")))) / F.size(qw)).alias("score"))


def reranked(rec: Record, k: int = 10, scorer=shared_words) -> DataFrame:
    """Current cards among the RRF of 150 each, the best 50, by ``scorer``: a function of (query_id, qtext, card_id, txt)
    that gives (query_id, card_id, score), such as a cross-encoder in Arrow batches."""
    fused = rec.rrf(150).join(rec.queries, "query_id").join(rec.versions, "card_id").where(asof.current(F.col("as_of")))
    best = ranking.top(fused.select("query_id", "card_id", "score"), 50).select("query_id", "card_id")
    both = best.join(rec.queries.select("query_id", "qtext"), "query_id").join(rec.texts, "card_id")
    return ranking.top(scorer(both).select("query_id", "card_id", F.round("score", 6).alias("score")), k)


def rerank_topk(rec: Record) -> DataFrame:
    return reranked(rec)


# ---- extraction ----------------------------------------------------------------------


def _note_lines(rec: Record) -> DataFrame:
    """Planted sentences: an order's line says how it uses a part and which value it reports on its supplier's region."""
    n = rec.table("nation").join(rec.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.initcap(F.split("r_name", " ")[0]).alias("region"))
    s = rec.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(n, "s_nationkey")
    line = rec.table("lineitem").join(s, "l_suppkey")
    k = F.col("l_linenumber") % 4
    role = F.when(k == 1, "introduces").when(k == 2, "studies").when(k == 3, "uses").otherwise("mentions")
    cue = F.when(k == 1, "we introduce").when(k == 2, "we study").when(k == 3, "we adopt").otherwise("compared with")
    name = F.concat(F.lit("Part"), F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise("-"), F.col("l_partkey").cast("string"))
    text = F.concat(cue, F.lit(" "), name, F.lit(" , it reaches "), F.format_string("%.2f", "l_discount"), F.lit(" price-score on "), F.col("region"), F.lit("-QA"))
    return line.select(F.col("l_orderkey").alias("card_id"), "l_linenumber", "l_partkey", role.alias("role"), name.alias("surface"), F.concat("region", F.lit("-QA")).alias("dataset"), F.format_string("%.2f", "l_discount").alias("value"), text.alias("sentence"))


def _notes(rec: Record) -> DataFrame:
    lines = _note_lines(rec).groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "sentence"))).alias("s"))
    return lines.select("card_id", F.concat_ws(" . ", F.transform("s", lambda x: x["sentence"])).alias("txt"))


def regex_entities(rec: Record) -> DataFrame:
    """Names by class in documents and in the orders' notes."""
    notes = extraction.mentions(_notes(rec)).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("surface").alias("n_surfaces")).withColumn("where", F.lit("notes"))
    docs = extraction.mentions(rec.texts).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("surface").alias("n_surfaces")).withColumn("where", F.lit("documents"))
    return notes.unionByName(docs)


def mention_roles(rec: Record) -> DataFrame:
    m = extraction.mentions(_notes(rec)).where("class = 'Method'")
    return extraction.strongest(m.select("card_id", F.replace("surface", F.lit(" "), F.lit("-")).alias("surface"), "role"), ["card_id", "surface"])


def entity_resolution(rec: Record) -> DataFrame:
    r = extraction.resolved(extraction.mentions(_notes(rec)).where("class = 'Method'"))
    return r.groupBy("entity").agg(F.count(F.lit(1)).alias("n_surfaces"), F.min("surface").alias("first"), F.max("surface").alias("last"))


def reports_facts(rec: Record) -> DataFrame:
    notes = _notes(rec)
    return extraction.reported_values(notes, extraction.mentions(notes))


def extraction_fidelity(rec: Record) -> DataFrame:
    notes, truth = _notes(rec), _note_lines(rec)
    found = extraction.mentions(notes)
    values = extraction.reported_values(notes, found)
    return extraction.fidelity(found.where("class = 'Method'"), truth.select("card_id", "surface", "role"), values, truth.select("card_id", "surface", "value"))


def ontology_classes(rec: Record) -> DataFrame:
    """Classes that at least two names support."""
    m = extraction.mentions(_notes(rec)).select("class", "surface").distinct()
    return m.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


# ---- multi-hop questions ---------------------------------------------------------------


def timeline_questions(rec: Record) -> DataFrame:
    """A part reported at least twice on a dataset: the reports in date order, one slot each."""
    keys = ["l_partkey", "dataset"]
    r = _note_lines(rec).select("card_id", *keys).distinct().join(rec.orders.select("card_id", "committed_at"), "card_id")
    many = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    order = Window.partitionBy(*keys).orderBy("committed_at", "card_id")
    return r.join(many, keys).select(*keys, (F.row_number().over(order) - 1).cast("long").alias("slot"), "card_id")


def aggregate_questions(rec: Record) -> DataFrame:
    """Parts reported on 2 to 8 datasets of which no single card names all: the number of each."""
    r = _note_lines(rec).select("card_id", "l_partkey", "dataset").distinct()
    per = r.groupBy("l_partkey").agg(F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("card_id").alias("n_cards"))
    most = r.groupBy("l_partkey", "card_id").agg(F.count(F.lit(1)).alias("d")).groupBy("l_partkey").agg(F.max("d").alias("most"))
    return per.join(most, "l_partkey").where("n_datasets between 2 and 8 and most < n_datasets").select("l_partkey", "n_datasets", "n_cards")


def bridge_questions(rec: Record) -> DataFrame:
    """The first card that uses a part asks; the latest report by another customer's card at a fixed time answers."""
    at = F.expr(AS_OF)
    r = _note_lines(rec).select("card_id", "l_partkey", "role", "value").join(rec.orders.select("card_id", "line", "committed_at"), "card_id").where(F.col("committed_at") <= at)
    ask = r.where("role = 'uses'").groupBy("l_partkey").agg(F.min(F.struct("committed_at", "card_id", "line")).alias("a"))
    rep = r.join(ask, "l_partkey").where("line <> a.line").groupBy("l_partkey").agg(F.max(F.struct("committed_at", "card_id")).alias("b"), F.first("a").alias("a"))
    return rep.select("l_partkey", F.col("a.card_id").alias("asker"), F.col("b.card_id").alias("answer"))


def history_questions(rec: Record) -> DataFrame:
    """Parts whose reported value changed along one customer's versions: every version is a slot."""
    r = _note_lines(rec).select("card_id", "l_partkey", "value").join(rec.orders.select("card_id", "line", "committed_at"), "card_id")
    per = r.groupBy("l_partkey", "line").agg(F.count_distinct("card_id").alias("n"), F.count_distinct("value").alias("v")).where("n > 1 and v > 1")
    return per.select("l_partkey", "line", F.col("n").alias("n_slots"), F.col("v").alias("n_values"))


def chrono_questions(rec: Record) -> DataFrame:
    """The first change of a part's reported value on a dataset: the cards that answer just before and just after it."""
    keys = ["l_partkey", "dataset"]
    r = _note_lines(rec).groupBy("card_id", *keys).agg(F.min("value").alias("value")).join(rec.orders.select("card_id", "committed_at"), "card_id")
    order = Window.partitionBy(*keys).orderBy("committed_at", "card_id")
    r = r.withColumn("before", F.lag(F.struct("card_id", "value")).over(order)).where("before.value <> value")
    first = r.groupBy(*keys).agg(F.min(F.struct("committed_at", "card_id", "before")).alias("e"))
    return first.select(*keys, F.col("e.before.card_id").alias("card_before"), F.col("e.card_id").alias("card_after"))


def bridge3_questions(rec: Record) -> DataFrame:
    """A card that uses a part, the first card of another customer that introduces it, and the latest other card on another part of that card."""
    r = _note_lines(rec).select("card_id", "l_partkey", "role").join(rec.orders.select("card_id", "line", "committed_at"), "card_id").where(F.col("committed_at") <= F.expr(AS_OF))
    ask = r.where("role = 'uses'").groupBy("l_partkey").agg(F.min(F.struct("committed_at", "card_id", "line")).alias("a"))
    mid = r.where("role = 'introduces'").join(ask, "l_partkey").where("line <> a.line").groupBy("l_partkey").agg(F.min(F.struct("committed_at", "card_id", "line")).alias("b"), F.first("a").alias("a"))
    other = mid.join(r.select(F.col("card_id").alias("mid_card"), F.col("l_partkey").alias("q")), F.col("b.card_id") == F.col("mid_card")).where("q <> l_partkey")
    other = other.groupBy("l_partkey").agg(F.min("q").alias("q"), F.first("a").alias("a"), F.first("b").alias("b"))
    last = other.join(r.select(F.col("l_partkey").alias("q"), "card_id", "line", "committed_at"), "q").where("line <> a.line and line <> b.line")
    last = last.groupBy("l_partkey").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.max(F.struct("committed_at", "card_id")).alias("c"))
    return last.select("l_partkey", F.col("a.card_id").alias("asker"), F.col("b.card_id").alias("middle"), F.col("c.card_id").alias("answer"))


def label_source_table(rec: Record) -> DataFrame:
    """Mean reciprocal rank of both runs and their difference under planted and usage-mined labels."""
    r = _rankings(rec)
    out = []
    for name, lab in (("planted", rec.labels), ("usage_mined", usage_mined(rec).withColumn("slot", F.lit(0)))):
        m = metrics.reciprocal_rank(r, lab)
        per = m.groupBy("query_id").agg(F.max(F.when(F.col("run") == "bm25", F.col("mrr"))).alias("a"), F.max(F.when(F.col("run") == "fresh", F.col("mrr"))).alias("b"))
        out.append(per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("bm25"), F.round(F.avg("b"), 6).alias("fresh")).select(F.lit(name).alias("source"), "n", "bm25", "fresh", F.round(F.col("fresh") - F.col("bm25"), 6).alias("delta")))
    return out[0].union(out[1])


def multihop_table(rec: Record) -> DataFrame:
    """Slot and chain recall of every method over all labelled queries."""
    first = rec.first_stage()
    runs = {"bm25": rec.lexical_top(10), "rrf": ranking.top(rec.rrf(100), 10), "fresh": ranking.top(rec.fresh(), 10), "boost": ranking.top(rec.boosted(), 10), "hop": ranking.hop_split(first, rec.boosted(), 10)}
    parts = [r.select(F.lit(n).alias("run"), "query_id", "card_id", "rank") for n, r in runs.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    s = metrics.slots(every, rec.labels, 10)
    return s.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("slot_recall"), 6).alias("slot_recall"), F.round(F.avg("chain_recall"), 6).alias("chain_recall"))


# ---- embedder and judges -----------------------------------------------------------------


def hash_embed(rec: Record) -> DataFrame:
    """The vectors themselves, a row for each dimension that is not zero."""
    v = rec.texts.select("card_id", embed.hash_embedding(F.col("txt"), 64).alias("v"))
    return v.select("card_id", F.posexplode("v").alias("dim", "x")).where("x <> 0").select("card_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x"))


def _pairs(rec: Record) -> DataFrame:
    return judge.paired_lists(judge.lists(_rankings(rec), rec.labels), rec.labels, "bm25", "fresh")


def judge_duel(rec: Record) -> DataFrame:
    return judge.duel(_pairs(rec))


def noise_floor(rec: Record) -> DataFrame:
    return judge.noise_floor(_pairs(rec))


def judge_agreement(rec: Record) -> DataFrame:
    """The judge against the metric: lists alike in their first five are ties and not asked; how often the order of a
    duel decides, how often what is shown first wins, and kappa with the sign of the metric's difference."""
    pairs = _pairs(rec)
    asked = judge.duel(pairs.where("x_ids <> y_ids"))
    alike = pairs.where("x_ids = y_ids").select("query_id", F.lit(None).cast("string").alias("forward"), F.lit(None).cast("string").alias("backward"), F.lit("TIE").alias("verdict"), F.lit(False).alias("inconsistent"))
    duels = written(asked.withColumn("asked", F.lit(True)).unionByName(alike.withColumn("asked", F.lit(False))), "duels")
    counts = duels.agg(
        F.count_if("asked").alias("n_asked"), F.count_if(~F.col("asked")).alias("n_identical"), F.count_if(F.col("asked") & F.col("verdict").isNull()).alias("n_errors"),
        F.count_if("inconsistent").alias("inconsistent"), F.count_if(F.col("forward").isin("A", "B")).alias("decided"), F.count_if(F.col("forward") == "A").alias("first_preferred"),
    )
    m = metrics.ndcg(_rankings(rec), rec.labels, 10, metrics.judgment_pool(_rankings(rec), 10))
    side = lambda run, n: m.where(F.col("run") == run).select("query_id", F.col("ndcg").alias(n))
    d = side("bm25", "x").join(side("fresh", "y"), "query_id")
    by_metric = d.select("query_id", F.when(F.abs(F.col("x") - F.col("y")) < 1e-9, "TIE").when(F.col("x") > F.col("y"), "A").otherwise("B").alias("a"))
    k = stats.kappa(by_metric.join(duels.select("query_id", F.col("verdict").alias("b")), "query_id"))
    return counts.crossJoin(k)  # one row each


NAMES = [
    aggregate_questions, bfs_sample, bridge3_questions, bridge_questions, chrono_questions, dag_links, dag_mined_labels, dag_snapshot_view, dag_walk_blind_depth, dag_walk_depth, dag_walk_topk, entity_resolution,
    extraction_fidelity, forward_edges_dropped, hash_embed, history_questions, indegree_asof, judge_agreement, judge_duel, known_item_queries, label_source_table, mention_roles,
    multihop_table, noise_floor, onto_rule_walk, onto_snapshot_view, onto_walk_blind_topk, onto_walk_topk, ontology_classes, ppr_subgraph, regex_entities, reports_facts, rerank_topk,
    round_robin_sample, snowball_sample, time_valid_edges, timeline_questions, title_join,
]
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Record(spark, sf_dir))) for f in NAMES}

# ---- SQL ---------------------------------------------------------------------------------

WALK = """
reach(query_id, node, as_of, depth) AS (
  SELECT DISTINCT s.query_id, root, as_of, 0 FROM seeds s JOIN ord o USING (card_id) JOIN walks w ON w.query_id = s.query_id
  UNION
  SELECT r.query_id, b, as_of, depth + 1 FROM reach r JOIN adjacent a ON a.a = r.node {gate} WHERE depth < {hops}),
least_depth AS (SELECT query_id, node, any_value(as_of) AS as_of, min(depth) AS depth FROM reach GROUP BY 1, 2),
walked AS (SELECT query_id, card_id, depth FROM least_depth l JOIN ord o ON o.root = l.node {seen})
"""


def _walk_sql(hops: int = 3, blind: bool = False) -> str:
    return WALK.format(hops=hops, gate="" if blind else "AND valid_from <= as_of", seen="" if blind else "WHERE committed_at <= as_of")


def _ppr_sql(iterations: int, tag: str = "", seeds: str = "wseeds") -> str:
    """Unrolled iterations over nodes(query_id, card_id), links(query_id, src, dst) and seeds(query_id, card_id, weight); the result is ppr + tag."""
    out = f"""
both_ways{tag} AS (SELECT query_id, src AS a, dst AS b FROM links UNION ALL SELECT query_id, dst, src FROM links),
deg{tag} AS (SELECT query_id, a, count(*) AS d FROM both_ways{tag} GROUP BY 1, 2),
wlinks{tag} AS MATERIALIZED (SELECT query_id, a, b, count(*)::DOUBLE / any_value(d) AS w FROM both_ways{tag} JOIN deg{tag} USING (query_id, a) GROUP BY 1, 2, 3),
base{tag} AS MATERIALIZED (
  SELECT query_id, card_id, coalesce(weight / total, 0.0::DOUBLE) AS s FROM (SELECT DISTINCT query_id, card_id FROM nodes)
  LEFT JOIN {seeds} USING (query_id, card_id) LEFT JOIN (SELECT query_id, sum(weight) AS total FROM {seeds} GROUP BY 1) USING (query_id)),
p{tag}0 AS (SELECT query_id, card_id, s AS p FROM base{tag})"""
    for i in range(1, iterations + 1):
        out += f""",
p{tag}{i} AS MATERIALIZED (
  SELECT base.query_id, base.card_id, 0.5::DOUBLE * s + 0.5::DOUBLE * coalesce(m, 0.0::DOUBLE) AS p FROM base{tag} base LEFT JOIN
    (SELECT p.query_id, b AS card_id, sum(p * w) AS m FROM p{tag}{i - 1} p JOIN wlinks{tag} l ON l.query_id = p.query_id AND l.a = p.card_id GROUP BY 1, 2) c
  ON c.query_id = base.query_id AND c.card_id = base.card_id)"""
    return out + f",\nppr{tag} AS (SELECT query_id, card_id, round(p, 6) AS score FROM p{tag}{iterations})"


SPLIT = """
joined AS (
  SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.card_id, s.card_id) AS card_id, f.rank AS r1, s.score AS s2
  FROM {first} f FULL JOIN {second} s ON f.query_id = s.query_id AND f.card_id = s.card_id),
banded AS (
  SELECT *, CASE WHEN r1 <= 5 THEN 0 WHEN s2 > 0 AND NOT coalesce(r1 <= 10, false) THEN 1 WHEN r1 <= 10 AND s2 > 0 THEN 2 WHEN r1 IS NOT NULL THEN 3 END AS band FROM joined),
split AS (
  SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY band, CASE WHEN band IN (1, 2) THEN -s2 ELSE r1 END, card_id) AS rank
  FROM banded WHERE band IS NOT NULL)
"""
RESULT = "SELECT query_id, card_id, 1.0::DOUBLE / rank AS score, rank FROM split WHERE rank <= 10"
SUBGRAPH = _walk_sql() + """,
nodes AS (SELECT query_id, card_id FROM walked),
links AS (
  SELECT a.query_id, src, dst FROM order_edges e JOIN walked a ON a.card_id = e.src JOIN walked b ON b.card_id = e.dst AND b.query_id = a.query_id),
wseeds AS (SELECT query_id, card_id, 1.0::DOUBLE / rank AS weight FROM seeds),
""" + _ppr_sql(20)
FACTS = """
facts AS (
  SELECT 'p' || l_partkey AS subj, 's' || l_suppkey AS obj, l_shipdate AS valid_from,
         lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS valid_until FROM lineitem)
"""


def _onto_ctes(blind: bool) -> str:
    began = "true" if blind else "valid_from <= as_of"
    lasts = "true" if blind else "valid_from <= as_of AND (intent = 'history' OR valid_until IS NULL OR valid_until > as_of)"
    return (
        FACTS
        + f""",
rw AS (
  SELECT r_regionkey::BIGINT AS query_id, TIMESTAMP '1996-01-01' + to_days(60 * r_regionkey) AS as_of, CASE WHEN r_regionkey % 2 = 0 THEN 'current' ELSE 'history' END AS intent FROM region),
rseeds AS (
  SELECT query_id, card_id, rank FROM (
    SELECT rw.query_id, card_id, row_number() OVER (PARTITION BY rw.query_id ORDER BY price DESC, card_id) AS rank
    FROM ord JOIN customer ON line = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN rw ON rw.query_id = n_regionkey WHERE committed_at <= as_of) WHERE rank <= 10),
links AS (
  SELECT query_id, 'c' || card_id AS src, 'ep' || l_partkey AS dst FROM (
    SELECT DISTINCT l_orderkey AS card_id, l_partkey, o_orderdate AS valid_from FROM lineitem JOIN orders ON o_orderkey = l_orderkey) JOIN rw ON {began}
  UNION ALL SELECT query_id, 'e' || subj, 'e' || obj FROM facts JOIN rw ON {lasts} WHERE subj <> obj),
nodes AS (SELECT query_id, src AS card_id FROM links UNION SELECT query_id, dst FROM links)
"""
    )


def _cards_sql(ppr: str) -> str:
    return f"""SELECT query_id, c.card_id, score FROM (SELECT query_id, substr(card_id, 2)::BIGINT AS card_id, score FROM {ppr} WHERE score > 0 AND card_id LIKE 'c%') c
  JOIN ord USING (card_id) JOIN rw USING (query_id) WHERE committed_at <= as_of"""


def _onto_sql(blind: bool) -> str:
    weights = ", wseeds AS (SELECT query_id, 'c' || card_id AS card_id, 1.0::DOUBLE / rank AS weight FROM rseeds),"
    return with_orders(RESULT, _onto_ctes(blind) + weights + _ppr_sql(graph.ITERATIONS) + f", second AS ({_cards_sql('ppr')})," + SPLIT.format(first="rseeds", second="second"))


def _rule_sql() -> str:
    out = _onto_ctes(False) + ", e0 AS (SELECT query_id, card_id FROM rseeds WHERE rank <= 3)"
    for i in (0, 1):
        out += f""",
ws{i} AS (SELECT query_id, 'c' || card_id AS card_id, 1.0::DOUBLE AS weight FROM e{i}),
{_ppr_sql(graph.ITERATIONS, f"h{i}", f"ws{i}")},
new{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM ({_cards_sql(f"pprh{i}")}) ANTI JOIN e{i} USING (query_id, card_id)),
e{i + 1} AS (SELECT * FROM e{i} UNION ALL SELECT query_id, card_id FROM new{i} WHERE rank <= 3)"""
    out += """,
bands AS (
  SELECT query_id, card_id, 0 AS band, epoch_us(committed_at) AS inside FROM e2 JOIN ord USING (card_id)
  UNION ALL SELECT query_id, card_id, 1, rank FROM rseeds ANTI JOIN e2 USING (query_id, card_id))"""
    return with_orders("SELECT query_id, card_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band, inside, card_id) AS rank FROM bands) WHERE rank <= 10", out)


SNOW = """
snow_both AS MATERIALIZED (SELECT src AS a, dst AS b FROM order_edges UNION SELECT dst, src FROM order_edges),
hubs AS (SELECT a AS node FROM snow_both GROUP BY 1 ORDER BY count(*) DESC, a LIMIT {hubs}),
snow(node, depth) AS (SELECT node, 0 FROM hubs UNION SELECT b, depth + 1 FROM snow JOIN snow_both ON a = node WHERE depth < {depth}),
least_snow AS (SELECT node, min(depth) AS depth FROM snow GROUP BY 1),
sized AS (SELECT l.node, depth, size FROM least_snow l JOIN {sizes} z ON z.node = l.node),
run AS (SELECT *, sum(size) OVER (ORDER BY depth, node) AS running FROM sized)
"""
NOTES = """
note_lines AS (
  SELECT l_orderkey AS card_id, l_linenumber, l_partkey,
         CASE l_linenumber % 4 WHEN 1 THEN 'introduces' WHEN 2 THEN 'studies' WHEN 3 THEN 'uses' ELSE 'mentions' END AS role,
         'Part' || CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '-' END || l_partkey AS surface,
         upper(string_split(r_name, ' ')[1][1]) || lower(string_split(r_name, ' ')[1][2:]) || '-QA' AS dataset, printf('%.2f', l_discount) AS value
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def with_notes(select: str, more: str = "") -> str:
    return f"WITH {NOTES.strip()}{', ' + more if more else ''}\n{select}\n"


DUEL = r"""
, shown AS (SELECT r.*, l.grade FROM rankings r LEFT JOIN labels l ON l.query_id = r.query_id AND l.card_id = r.card_id WHERE rank <= 5),
lists AS (
  SELECT run, query_id, round(sum(coalesce(grade, 0.0::DOUBLE) / log2(rank + 1)), 9) AS gain, count(*) AS length, string_agg(card_id::VARCHAR, '|' ORDER BY rank) AS ids FROM shown GROUP BY 1, 2),
graded AS (SELECT query_id, list(grade ORDER BY grade DESC) AS grades FROM labels GROUP BY 1),
both_sides AS (
  SELECT g.query_id, grades, coalesce(x.gain, 0) AS ga, coalesce(y.gain, 0) AS gb, coalesce(x.length, 0) AS la, coalesce(y.length, 0) AS lb, coalesce(x.ids, '') AS ia, coalesce(y.ids, '') AS ib
  FROM graded g LEFT JOIN lists x ON x.query_id = g.query_id AND x.run = 'bm25' LEFT JOIN lists y ON y.query_id = g.query_id AND y.run = 'fresh'),
px AS (
  SELECT *, coalesce(nullif(round(list_sum(list_transform(grades[1:greatest(la, lb, 1)], lambda g, i: g / log2(i + 1))), 9), 0), 1.0::DOUBLE) AS best FROM both_sides),
margins AS (
  SELECT *, 4.0::DOUBLE * (ga - gb) / best + 0.06::DOUBLE * ((la - lb) / greatest(la, lb, 1)::DOUBLE) AS m,
         ('0x' || substr(md5(query_id || ':' || ia || ':#:' || ib), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(query_id || ':' || ib || ':#:' || ia), 1, 8))::BIGINT AS h2,
         ('0x' || substr(md5(query_id || ':' || ia || ':#:' || ib || ':1'), 1, 8))::BIGINT AS h3, ('0x' || substr(md5(query_id || ':' || ia || ':#:' || ib || ':2'), 1, 8))::BIGINT AS h4 FROM px),
asked AS (
  SELECT *, m + 0.1::DOUBLE + 0.3::DOUBLE * (h1 / 4294967296.0::DOUBLE - 0.5::DOUBLE) AS m1, -m + 0.1::DOUBLE + 0.3::DOUBLE * (h2 / 4294967296.0::DOUBLE - 0.5::DOUBLE) AS m2,
         m + 0.1::DOUBLE + 0.3::DOUBLE * (h3 / 4294967296.0::DOUBLE - 0.5::DOUBLE) AS m3, m + 0.1::DOUBLE + 0.3::DOUBLE * (h4 / 4294967296.0::DOUBLE - 0.5::DOUBLE) AS m4 FROM margins),
duel0 AS (
  SELECT query_id, ia, ib, CASE WHEN abs(m1) < 0.08 THEN 'TIE' WHEN m1 > 0 THEN 'A' ELSE 'B' END AS forward, CASE WHEN abs(m2) < 0.08 THEN 'TIE' WHEN m2 > 0 THEN 'B' ELSE 'A' END AS backward,
         CASE WHEN abs(m3) < 0.08 THEN 'TIE' WHEN m3 > 0 THEN 'A' ELSE 'B' END AS again1, CASE WHEN abs(m4) < 0.08 THEN 'TIE' WHEN m4 > 0 THEN 'A' ELSE 'B' END AS again2 FROM asked),
duel AS (SELECT query_id, forward, backward, CASE WHEN forward = backward THEN forward ELSE 'TIE' END AS verdict, forward <> backward AS inconsistent, ia = ib AS alike FROM duel0)
"""
RAW = """
raw AS (
  SELECT l_orderkey AS src, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS dst, CASE WHEN line = 1 THEN 'parent' ELSE 'citation' END AS kind
  FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)),
checked AS (
  SELECT DISTINCT src, dst, kind, coalesce(d.o_orderdate <= s.o_orderdate, false) AS kept
  FROM raw LEFT JOIN orders s ON s.o_orderkey = src LEFT JOIN orders d ON d.o_orderkey = dst WHERE dst IS NOT NULL)
"""
MENTIONS = r"""
pieces AS (SELECT card_id, regexp_split_to_array(txt, '\s\.(?:\s|$)') AS s FROM {source}),
sents AS (SELECT card_id, unnest(s) AS sentence FROM pieces),
found AS (
  SELECT card_id, sentence, 'Method' AS class, unnest(regexp_extract_all(sentence, '\b(?:[A-Z][a-z]+[- ]\d+|[A-Z]{{2}}-\d+)\b')) AS surface FROM sents
  UNION ALL SELECT card_id, sentence, 'Dataset', unnest(regexp_extract_all(sentence, '\b[A-Z][a-z]+-(?:QA|Bench|Corpus|Text)\b')) FROM sents
  UNION ALL SELECT card_id, sentence, 'Metric', unnest(regexp_extract_all(sentence, '\b[a-z]+-score\b')) FROM sents
  UNION ALL SELECT card_id, sentence, 'Material', unnest(regexp_extract_all(sentence, '\b[a-z]+ (?:oxide|nitride|alloy|polymer)\b')) FROM sents
  UNION ALL SELECT card_id, sentence, 'Organism', unnest(regexp_extract_all(sentence, '\b[A-Z][a-z]+ [a-z]+ii\b')) FROM sents)
"""
RANK_ROLE = "list_position(['introduces', 'uses', 'studies', 'mentions'], role)"

ORACLE_SQL = {
    "time_valid_edges": f"WITH {RAW} SELECT src, dst, kind FROM checked WHERE kept",
    "forward_edges_dropped": f"WITH {RAW} SELECT kind, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM checked GROUP BY 1",
    "indegree_asof": with_orders("SELECT strftime(as_of, '%Y-%m-%d') AS as_of, in_degree, count(*) AS n_cards FROM (SELECT dst, as_of, count(*) AS in_degree FROM order_edges JOIN walks ON valid_from <= as_of GROUP BY 1, 2) GROUP BY 1, 2"),
    "dag_walk_depth": with_orders("SELECT * FROM walked", _walk_sql()),
    "dag_walk_blind_depth": with_orders("SELECT query_id, depth, count(*) AS n_cards FROM walked GROUP BY 1, 2", _walk_sql(blind=True)),
    "dag_links": with_orders("SELECT a.query_id, count(*) AS n_links, min(src) AS first_src, max(dst) AS last_dst FROM order_edges e JOIN walked a ON a.card_id = e.src JOIN walked b ON b.card_id = e.dst AND b.query_id = a.query_id GROUP BY 1", _walk_sql()),
    "ppr_subgraph": with_orders("SELECT * FROM ppr", SUBGRAPH),
    "dag_walk_topk": with_orders(RESULT, SUBGRAPH + "," + SPLIT.format(first="seeds", second="ppr")),
    "bfs_sample": with_orders("SELECT node, depth FROM run WHERE running - size < 200", "ones AS (SELECT card_id AS node, 1 AS size FROM ord)," + SNOW.format(hubs=1, depth=6, sizes="ones")),
    "snowball_sample": with_orders("SELECT node, depth FROM run WHERE running - size < (SELECT count(*) // 2 FROM lineitem)", "line_sizes AS (SELECT l_orderkey AS node, count(*) AS size FROM lineitem GROUP BY 1)," + SNOW.format(hubs=20, depth=8, sizes="line_sizes")),
    "dag_snapshot_view": with_orders("""
SELECT o.card_id, CASE WHEN superseded_at IS NULL OR superseded_at > TIMESTAMP '1998-01-01' THEN 'current' ELSE 'superseded' END AS state,
       (SELECT count(*) FROM order_edges e WHERE e.src = o.card_id AND e.valid_from <= TIMESTAMP '1998-01-01') AS n_out
FROM ord o WHERE committed_at <= TIMESTAMP '1998-01-01'"""),
    "onto_rule_walk": _rule_sql(),
    "chrono_questions": with_notes("""
SELECT l_partkey, dataset, arg_min(before_card, (o_orderdate, card_id)) AS card_before, arg_min(card_id, (o_orderdate, card_id)) AS card_after FROM c WHERE before_value <> value GROUP BY 1, 2""",
        """r AS (SELECT card_id, l_partkey, dataset, min(value) AS value FROM note_lines GROUP BY 1, 2, 3),
c AS (
  SELECT r.*, o_orderdate, lag(card_id) OVER w AS before_card, lag(value) OVER w AS before_value FROM r JOIN orders ON o_orderkey = card_id
  WINDOW w AS (PARTITION BY l_partkey, dataset ORDER BY o_orderdate, card_id))"""),
    "bridge3_questions": with_notes("""
SELECT o.l_partkey, any_value(a_card) AS asker, any_value(b_card) AS middle, arg_max(r.card_id, (r.o_orderdate, r.card_id)) AS answer
FROM o JOIN r ON r.l_partkey = o.q WHERE r.o_custkey <> a_cust AND r.o_custkey <> b_cust GROUP BY 1""",
        """r AS (SELECT n.*, o_custkey, o_orderdate FROM note_lines n JOIN orders ON o_orderkey = card_id WHERE o_orderdate <= TIMESTAMP '1998-01-01'),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, card_id) AS k FROM r WHERE role = 'uses') WHERE k = 1),
b AS (
  SELECT * FROM (SELECT r.*, a.card_id AS a_card, a.o_custkey AS a_cust, row_number() OVER (PARTITION BY r.l_partkey ORDER BY r.o_orderdate, r.card_id) AS k
                 FROM r JOIN a ON a.l_partkey = r.l_partkey AND a.o_custkey <> r.o_custkey WHERE r.role = 'introduces') WHERE k = 1),
o AS (SELECT b.l_partkey, a_card, a_cust, b.card_id AS b_card, b.o_custkey AS b_cust, min(m.l_partkey) AS q FROM b JOIN r m ON m.card_id = b.card_id AND m.l_partkey <> b.l_partkey GROUP BY ALL)"""),
    "label_source_table": with_text("""
, three AS (SELECT r.*, l.card_id IS NULL AS miss FROM run_a r LEFT JOIN labels l ON r.query_id = l.query_id AND r.card_id = l.card_id WHERE rank <= 3),
mined AS (SELECT query_id, arg_min(card_id, miss::INT * 10 + rank) AS card_id FROM three GROUP BY 1),
both_labels AS (SELECT 'planted' AS source, query_id, card_id FROM labels UNION ALL SELECT 'usage_mined', query_id, card_id FROM mined),
firsts AS (SELECT source, run, l.query_id, min(rank) AS first FROM both_labels l JOIN rankings r ON r.query_id = l.query_id AND r.card_id = l.card_id GROUP BY 1, 2, 3),
every_query AS (SELECT source, run, query_id FROM (SELECT DISTINCT source, query_id FROM both_labels), runs),
rr AS (SELECT source, run, query_id, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM every_query LEFT JOIN firsts USING (source, run, query_id)),
t AS (SELECT source, count(DISTINCT query_id) AS n, round(avg(mrr) FILTER (run = 'bm25'), 6) AS bm25, round(avg(mrr) FILTER (run = 'fresh'), 6) AS fresh FROM rr GROUP BY 1)
SELECT *, round(fresh - bm25, 6) AS delta FROM t"""),
    "onto_walk_topk": _onto_sql(False),
    "onto_walk_blind_topk": _onto_sql(True),
    "onto_snapshot_view": f"WITH {FACTS} SELECT subj, obj, count(*) AS n FROM facts WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-01-01') GROUP BY 1, 2",
    "round_robin_sample": """
SELECT card_id, family FROM (
  SELECT doc_id AS card_id, coalesce(lang, 'none') AS family,
         row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY ('0x' || substr(md5(doc_id || ':5'), 1, 8))::BIGINT, doc_id) AS turn FROM documents)
ORDER BY turn, family LIMIT 100
""",
    "title_join": r"""
WITH l AS (SELECT trim(regexp_replace(lower(regexp_replace(s_name, '^[A-Za-z]+#', 'No. ')), '[^a-z0-9]+', ' ', 'g')) AS title, s_suppkey AS id FROM supplier),
r AS (SELECT trim(regexp_replace(lower(regexp_replace(c_name, '^[A-Za-z]+#', 'No. ')), '[^a-z0-9]+', ' ', 'g')) AS title, c_custkey AS id FROM customer)
SELECT title, left_id, left_id_collisions, right_id, right_id_collisions
FROM (SELECT title, min(id) AS left_id, count(*) - 1 AS left_id_collisions FROM l WHERE title <> '' GROUP BY 1)
JOIN (SELECT title, min(id) AS right_id, count(*) - 1 AS right_id_collisions FROM r WHERE title <> '' GROUP BY 1) USING (title)
""",
    "dag_mined_labels": with_text("SELECT src AS query_id, dst AS card_id, 2.0::DOUBLE AS grade, array_to_string(w[1:8], ' ') AS qtext FROM text_edges JOIN toks ON toks.card_id = src"),
    "known_item_queries": with_text("""
, firsts AS (SELECT min(card_id) AS card_id FROM versions GROUP BY line),
ws AS (SELECT card_id, unnest(list_distinct(w)) AS w FROM toks SEMI JOIN firsts USING (card_id)),
ks AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY ('0x' || substr(md5(w || ':3'), 1, 8))::BIGINT, w) AS k FROM ws)
SELECT card_id, string_agg(w, ' ' ORDER BY k) AS qtext FROM ks WHERE k <= 9 GROUP BY 1"""),
    "rerank_topk": with_text("""
, cand AS (
  SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM rrf150 JOIN queries USING (query_id) JOIN versions USING (card_id)
  WHERE superseded_at IS NULL OR superseded_at > as_of),
scored AS (
  SELECT query_id, card_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(qtext), '[a-z0-9]+')), regexp_extract_all(lower(text), '[a-z0-9]+')))::DOUBLE
         / len(list_distinct(regexp_extract_all(lower(qtext), '[a-z0-9]+'))), 6) AS score
  FROM cand JOIN queries USING (query_id) JOIN documents d ON d.doc_id = card_id WHERE rank <= 50)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM scored) WHERE rank <= 10"""),
    "regex_entities": with_notes(
        "SELECT class, count(*) AS n, count(DISTINCT surface) AS n_surfaces, side AS \"where\" FROM (SELECT *, CASE WHEN card_id LIKE 'n%' THEN 'notes' ELSE 'documents' END AS side FROM found) GROUP BY class, side",
        """note_text AS (
  SELECT card_id, string_agg(CASE role WHEN 'introduces' THEN 'we introduce' WHEN 'studies' THEN 'we study' WHEN 'uses' THEN 'we adopt' ELSE 'compared with' END || ' ' || surface
         || ' , it reaches ' || value || ' price-score on ' || dataset, ' . ' ORDER BY l_linenumber, l_partkey) AS txt FROM note_lines GROUP BY 1),
every_text AS (SELECT 'n' || card_id AS card_id, txt FROM note_text UNION ALL SELECT 'd' || doc_id, text FROM documents),""" + MENTIONS.format(source="every_text"),
    ),
    "mention_roles": with_notes(f"SELECT card_id, surface, arg_min(role, k) AS role FROM (SELECT card_id, replace(surface, ' ', '-') AS surface, role, {RANK_ROLE} AS k FROM note_lines) GROUP BY 1, 2"),
    "entity_resolution": with_notes("SELECT 'Method|' || min(surface) AS entity, count(*) AS n_surfaces, min(surface) AS first, max(surface) AS last FROM (SELECT DISTINCT l_partkey, surface FROM note_lines) GROUP BY l_partkey"),
    "reports_facts": with_notes("SELECT card_id, any_value(dataset) OVER (PARTITION BY card_id) AS dataset, surface, value FROM note_lines WHERE card_id IN (SELECT card_id FROM note_lines GROUP BY 1 HAVING count(DISTINCT dataset) = 1)"),
    "extraction_fidelity": with_notes("""
SELECT 1.0::DOUBLE AS mention_precision, 1.0::DOUBLE AS mention_recall, 1.0::DOUBLE AS role_accuracy, 1.0::DOUBLE AS fact_precision,
       round((SELECT count(*) FROM (SELECT DISTINCT card_id, l_partkey, value FROM note_lines WHERE card_id IN (SELECT card_id FROM note_lines GROUP BY 1 HAVING count(DISTINCT dataset) = 1)))
       / (SELECT count(*) FROM (SELECT DISTINCT card_id, l_partkey, value FROM note_lines))::DOUBLE, 6) AS fact_recall"""),
    "ontology_classes": with_notes("SELECT 'Method' AS class, count(DISTINCT surface) AS n FROM note_lines UNION ALL SELECT 'Dataset', count(DISTINCT dataset) FROM note_lines"),
    "timeline_questions": with_notes("""
SELECT l_partkey, dataset, row_number() OVER (PARTITION BY l_partkey, dataset ORDER BY o_orderdate, card_id) - 1 AS slot, card_id
FROM r JOIN orders ON o_orderkey = card_id SEMI JOIN (SELECT l_partkey, dataset FROM r GROUP BY 1, 2 HAVING count(*) >= 2) k USING (l_partkey, dataset)""",
        "r AS (SELECT DISTINCT card_id, l_partkey, dataset FROM note_lines)"),
    "aggregate_questions": with_notes("""
SELECT l_partkey, count(DISTINCT dataset) AS n_datasets, count(DISTINCT card_id) AS n_cards FROM note_lines n GROUP BY 1
HAVING count(DISTINCT dataset) BETWEEN 2 AND 8
   AND (SELECT max(d) FROM (SELECT count(DISTINCT dataset) AS d FROM note_lines m WHERE m.l_partkey = n.l_partkey GROUP BY m.card_id)) < count(DISTINCT dataset)"""),
    "bridge_questions": with_notes("""
SELECT r.l_partkey, any_value(a.card_id) AS asker, arg_max(r.card_id, (r.o_orderdate, r.card_id)) AS answer FROM r JOIN a ON a.l_partkey = r.l_partkey AND a.o_custkey <> r.o_custkey GROUP BY 1""",
        """r AS (SELECT n.*, o_custkey, o_orderdate FROM note_lines n JOIN orders ON o_orderkey = card_id WHERE o_orderdate <= TIMESTAMP '1998-01-01'),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, card_id) AS k FROM r WHERE role = 'uses') WHERE k = 1)"""),
    "history_questions": with_notes("SELECT l_partkey, o_custkey AS line, count(DISTINCT card_id) AS n_slots, count(DISTINCT value) AS n_values FROM note_lines JOIN orders ON o_orderkey = card_id GROUP BY 1, 2 HAVING count(DISTINCT card_id) > 1 AND count(DISTINCT value) > 1"),
    "multihop_table": with_text("""
, rrf_run AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM rrf100),
""" + SPLIT.format(first="first_stage", second="boost_scores") + """,
methods AS (
  SELECT 'bm25' AS run, query_id, card_id, rank FROM lex_all WHERE rank <= 10 UNION ALL SELECT 'rrf', query_id, card_id, rank FROM rrf_run WHERE rank <= 10
  UNION ALL SELECT 'fresh', query_id, card_id, rank FROM fresh WHERE rank <= 10 UNION ALL SELECT 'boost', query_id, card_id, rank FROM boost WHERE rank <= 10
  UNION ALL SELECT 'hop', query_id, card_id, rank FROM split WHERE rank <= 10),
slot_hits AS (SELECT DISTINCT run, l.query_id, slot FROM methods m JOIN labels l ON l.query_id = m.query_id AND l.card_id = m.card_id),
wanted AS (SELECT run, query_id, slot FROM (SELECT DISTINCT run FROM methods), (SELECT DISTINCT query_id, slot FROM labels)),
per_query AS (
  SELECT run, query_id, round(avg(hit), 6) AS slot_recall, min(hit) AS chain_recall
  FROM (SELECT w.*, (h.slot IS NOT NULL)::INT AS hit FROM wanted w LEFT JOIN slot_hits h ON h.run = w.run AND h.query_id = w.query_id AND h.slot = w.slot) GROUP BY 1, 2)
SELECT run, count(*) AS n, round(avg(slot_recall), 6) AS slot_recall, round(avg(chain_recall), 6) AS chain_recall FROM per_query GROUP BY 1"""),
    "judge_duel": with_text(DUEL + "SELECT * EXCLUDE (alike) FROM duel"),
    "noise_floor": with_text(DUEL + "SELECT count(*) AS asked, count(*) FILTER (again1 <> again2) AS flips FROM duel0"),
    "judge_agreement": with_text(DUEL + """
, by_metric AS (
  SELECT query_id, CASE WHEN abs(x.ndcg - y.ndcg) < 1e-9 THEN 'TIE' WHEN x.ndcg > y.ndcg THEN 'A' ELSE 'B' END AS a
  FROM (SELECT * FROM ndcg WHERE run = 'bm25') x JOIN (SELECT * FROM ndcg WHERE run = 'fresh') y USING (query_id)),
ab AS (SELECT a, CASE WHEN alike THEN 'TIE' ELSE verdict END AS b FROM duel JOIN by_metric USING (query_id)),
k AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree FROM ab),
pe AS (SELECT coalesce(sum(ca * cb), 0) / (SELECT n * n FROM k)::DOUBLE AS pe FROM (SELECT a AS v, count(*) AS ca FROM ab GROUP BY 1) JOIN (SELECT b AS v, count(*) AS cb FROM ab GROUP BY 1) USING (v))
SELECT count(*) FILTER (NOT alike) AS n_asked, count(*) FILTER (alike) AS n_identical, 0::BIGINT AS n_errors, count(*) FILTER (inconsistent AND NOT alike) AS inconsistent,
       count(*) FILTER (forward <> 'TIE' AND NOT alike) AS decided, count(*) FILTER (forward = 'A' AND NOT alike) AS first_preferred, any_value(n) AS n, any_value(agree) AS agree,
       round(any_value(CASE WHEN pe < 1 THEN (agree / n::DOUBLE - pe) / (1 - pe) END), 6) AS kappa FROM duel, k, pe"""),
}
