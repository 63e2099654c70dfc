"""Steps whose work must grow no faster than the input."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import asof, graph, lexical
from rankloom.sources.record import Record

ODD = [(1, "Kelvin Kelvin wind. Wind"), (2, None), (3, ""), (4, "windñwind 2İx i"), (5, "the long wind blows"), (5, "a wind"), (6, "wiß nd blo"), (7, "no such word")]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cards_are_scored_where_they_lie(spark, sf_dir, monkeypatch):
    def lists(rec):
        hidden = rec.labels.select("query_id", "card_id")
        return [_rows(d) for d in (rec.lexical_top(10), rec.lexical_top(160), rec.lexical_top(10, pool=True), rec.lexical_top(7, without=hidden))]

    with monkeypatch.context() as m:
        m.setattr(lexical, "MOST_TERMS", 0)
        want = lists(Record(spark, sf_dir))
    monkeypatch.setattr(lexical, "bm25", None)  # no pairs of queries and cards are made
    monkeypatch.setattr(lexical, "AT_ONCE", 9000)  # blocks of one card, lists cut again and again
    assert lists(Record(spark, sf_dir)) == want


def test_words_are_those_of_the_expression(spark):
    cards = spark.createDataFrame(ODD, "card_id long, txt string")
    vocabulary = ["blows", "i", "ind", "kelvin", "nd", "wi", "wind", "x"]
    place = F.element_at(F.array(*map(F.lit, vocabulary)), F.col("e.at") + 1)
    got = lexical.index(cards, vocabulary).select("card_id", "dl", F.explode(F.arrays_zip("at", "tf")).alias("e")).select("card_id", "dl", place.alias("term"), "e.tf")
    assert _rows(got) == _rows(lexical.postings(lexical.tokenised(cards).where("card_id <> 5 or dl > 2"), spark.createDataFrame([(w,) for w in vocabulary], "term string")).union(spark.createDataFrame([(5, 2, "wind", 1)], "card_id long, dl int, term string, tf long")))


def test_texts_that_contain_a_query_are_found_by_a_word(spark):
    cards = spark.createDataFrame(ODD, "card_id long, txt string")
    queries = spark.createDataFrame([(1, "wind"), (2, "lvin wi"), (3, "long wind"), (4, "he long wind b"), (5, ""), (6, None), (7, "Kelvin Kelvin w"), (8, "ß nd b"), (9, "Long wind")], "query_id long, qtext string")
    want = cards.join(queries, F.contains("txt", "qtext")).select("query_id", "card_id")
    assert _rows(lexical.containing(cards, queries.collect())) == _rows(want)


@pytest.mark.parametrize("copies", [1, 400])
def test_citations_of_one_root_meet_a_version_each(spark, copies):
    day = lambda c: F.expr(f"timestampadd(DAY, {c}, timestamp_ntz'2025-01-01 00:00:00')")
    versions = spark.range(1, copies + 1).select(F.lit(7).cast("long").alias("root"), F.col("id").alias("card_id"), day("cast(id as int) * 10").alias("committed_at"))
    cites = spark.range(copies * 10).select(F.col("id").alias("src"), F.lit(7).cast("long").alias("root"), day("cast(id as int) + 5").alias("at"))
    out = asof.cited_as_of(cites, versions)
    assert _rows(out.select("src", "dst")) == sorted(((s, min((s + 5) // 10, copies)) for s in range(copies * 10) if s + 5 >= 10), key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan  # joined by root and range of dates, not by root


def test_a_seeded_part_is_not_put_in_order_as_a_whole(spark):
    cards = spark.range(3000).withColumnRenamed("id", "card_id")
    needles = spark.createDataFrame([(i,) for i in (5, 6)], "card_id long")
    h = {r.card_id: r.h for r in cards.withColumn("h", asof.draw(F.col("card_id").cast("string"), F.lit("11"))).collect()}
    for n in (0, 2, 3, 1500, 3000, 4000):
        rest = sorted((x for x in h if x not in (5, 6)), key=lambda x: (h[x], x))[: max(0, n - 2)]
        out = asof.scale_subset(cards, needles, n, 11)
        assert sorted(r.card_id for r in out.collect()) == sorted([5, 6, *rest])
        assert "limit=1498" not in out._jdf.queryExecution().executedPlan().toString()


LINKS = [(1, "ca", "ex"), (1, "cb", "ex"), (1, "cb", "ex"), (1, "cb", "ey"), (1, "ey", "ez"), (1, "cq", "er"), (2, "ca", "ez"), (2, "ca", "ca")]


@pytest.mark.parametrize("lone", [False, True])
def test_a_task_ranks_as_the_joins_do(spark, monkeypatch, lone):
    links = spark.createDataFrame(LINKS, "query_id long, src string, dst string")
    seeds = spark.createDataFrame([(1, "ca", 2.0), (1, "cc", 1.0), (2, "ca", 1.0), (3, "ca", 1.0), (4, "cx", 1.0)], "query_id long, card_id string, weight double")
    views = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 7)], "query_id long, view long")
    nodes = links.select("query_id", F.col("src").alias("card_id")).union(links.select("query_id", "dst"))

    def both():
        return _rows(graph.pagerank(None, links, seeds, views=views, only="c", lone=lone)), _rows(graph.pagerank(nodes, links, seeds))

    with monkeypatch.context() as m:
        m.setattr(graph, "LOCAL_LINKS", 0)
        want = both()
    m = monkeypatch
    m.setattr(graph, "_joined", None)  # no iteration is a join
    assert both() == want and len(want[0]) == (7 if lone else 5)


def test_only_links_within_reach_are_ranked(spark):
    copies = spark.range(50)
    mentions = copies.select((F.col("id") * 10).alias("card_id"), F.concat(F.lit("p"), "id").alias("entity_id")).union(copies.select(F.col("id") * 10 + 1, F.concat(F.lit("q"), "id")))
    facts = copies.select(F.concat(F.lit("p"), "id").alias("subj"), F.concat(F.lit("s"), "id").alias("obj")).union(copies.select(F.concat(F.lit("q"), "id"), F.concat(F.lit("s"), "id")))
    seeds = spark.createDataFrame([(0, 0), (0, 20)], "query_id long, card_id long")
    m, f = graph.within_reach(mentions, facts, seeds)
    assert _rows(m) == [(0, "p0"), (1, "q0"), (20, "p2"), (21, "q2")] and _rows(f) == [("p0", "s0"), ("p2", "s2"), ("q0", "s0"), ("q2", "s2")]
    m, f = graph.within_reach(mentions, facts, seeds, 2)
    assert {r.entity_id for r in m.collect()} == {"p0", "p2"} and {r.subj for r in f.collect()} == {"p0", "p2"}


def test_queries_of_one_time_share_their_links(spark, sf_dir):
    from rankloom.operators import walkers

    rec = Record(spark, sf_dir)
    found = walkers.EntityGraph(rec)
    assert found.links.select("query_id").distinct().count() <= rec.queries.select("as_of", "intent").distinct().count() < rec.queries.count()


def test_facts_are_found_once_for_all_grades(spark, sf_dir):
    from rankloom.plans import flows

    out = flows.extraction_grades(Record(spark, sf_dir))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "sentence_no" in x]  # names of a sentence are not paired again for each grade
