from pyspark.sql import functions as F

from rankloom.operators import asof
from rankloom.sources import generator as g


def test_corpus_is_the_same_however_it_is_cut(spark):
    a = g.cards(spark, 300, 20)
    assert sorted(map(str, a.collect())) == sorted(map(str, a.repartition(7).collect()))
    assert spark.range(576).select(g.word(F.col("id")).alias("w")).distinct().count() == 576


def test_support_and_edges_point_back(spark):
    c = g.cards(spark, 400, 20)
    s = g.true_support(c, 20)
    e = g.recorded_edges(s, c)
    assert s.count() > 300 and s.where("dst >= src").count() == 0
    assert asof.checked_edges(e.select("src", "dst", "kind"), c).where("not kept").count() == 0
    shared = s.join(e, ["src", "dst"], "left_semi").count() / s.count()
    assert 0.45 < shared < 0.75


def test_labels_are_older_than_their_query(spark):
    c = g.cards(spark, 400, 20)
    q, labels = g.planted_queries(c, g.true_support(c, 20))
    late = labels.join(q, "query_id").join(c.select("card_id", "committed_at"), "card_id").where(F.col("committed_at") >= F.col("as_of"))
    assert q.count() > 10 and labels.count() > 10 and late.count() == 0
    assert {r.grade for r in labels.select("grade").distinct().collect()} == {1.0, 2.0}


def test_planted_entities_are_found_again_and_obey_the_classes(spark):
    from rankloom.functions.text import entity_key
    from rankloom.operators import extraction
    from rankloom.sources import generator
    from rankloom.storage import written

    corpus = written(generator.cards(spark, 240, 24), "cards")
    e = written(generator.true_entities(spark, 6), "true_entities")
    m = written(generator.true_mentions(corpus, e), "true_mentions")
    f = written(generator.true_facts(m, e), "true_facts")
    assert e.select("name").distinct().count() == 24 and m.count() > 200
    kinds = {r.entity_id: r.parent_kind for r in e.collect()}
    assert all((kinds[r.subj], kinds[r.obj]) == ("Method", "Dataset") for r in f.collect())
    first = {}
    for r in m.orderBy("card_id").collect():
        assert (r.role == "introduces") == (r.entity_id not in first)
        first.setdefault(r.entity_id, r.card_id)
    notes = written(generator.spoken(corpus, m, f), "spoken")
    found = written(extraction.mentions(notes).where("class in ('Method', 'Dataset')").withColumn("entity_id", entity_key("surface")), "found")
    ext = {
        "cards": corpus.select("card_id"),
        "entities": found.groupBy("entity_id").agg({"surface": "min", "class": "min"}).toDF("entity_id", "name", "kind"),
        "mentions": found.select("card_id", "entity_id", "surface", "role"),
        "facts": f.where("false"),
        "classes": found.selectExpr("class", "cast(null as string) as parent").distinct(),
    }
    r = extraction.grade({"entities": e, "mentions": m, "facts": f}, ext).first()
    assert (r.mention_precision, r.mention_recall, r.role_accuracy, r.false_merges, r.alias_resolution or 1.0) == (1.0, 1.0, 1.0, 0, 1.0)
    again = generator.true_mentions(corpus, e)
    assert again.exceptAll(m).count() == 0


def test_no_answer_queries_use_words_that_no_card_has(spark):
    from rankloom.sources import generator

    corpus = generator.cards(spark, 120, 24)
    words = {w for r in corpus.collect() for w in r.txt.split()}
    q = generator.planted_no_answer(spark, corpus, 20, topic=12).collect()
    assert len(q) == 20 and not any(w in words for r in q for w in r.qtext.split() if len(w) > 6)
