"""A record made from frames: every scorer works on it and keeps to its contract."""

import pytest
from pyspark.sql import functions as F

from rankloom import api
from rankloom.operators import embed, guards, judge
from rankloom.plans import networks
from rankloom.sources import sinks
from rankloom.sources.record import Record
from rankloom.storage import new_path, written

CARDS = [
    ("p1", "north", 1, None, "glacier melt in the valley"),
    ("p2", "north", 2, "p1", "glacier melt in the valley measured again"),
    ("p3", "south", 3, None, "sand dunes move with the wind"),
    ("p4", "south", 5, None, "wind and sand wear the stone"),
    ("p5", "east", 9, None, "a stone bridge near the glacier"),
]


@pytest.fixture(scope="module")
def record(spark):
    day = F.expr("timestampadd(DAY, day, timestamp_ntz'2025-03-01 00:00:00')")
    cards = spark.createDataFrame(CARDS, "card_id string, line string, day int, supersedes_id string, txt string").withColumn("committed_at", day)
    queries = spark.createDataFrame([("a", "glacier valley", 6, "current"), ("b", "wind", 6, "history")], "query_id string, qtext string, day int, intent string").withColumn("as_of", day)
    edges = spark.createDataFrame([("p3", "p2", "citation", 3), ("p5", "p3", "citation", 9)], "src string, dst string, kind string, day int").withColumn("valid_from", day)
    mentions = spark.createDataFrame([("p1", "ice", "glacier", "uses"), ("p4", "ice", "stone", "mentions")], "card_id string, entity_id string, surface string, role string")
    texts = cards.select("card_id", "txt")
    vectors = embed.embed_corpus(texts, lambda: embed.HashEmbedder(32))
    qv = embed.embed_corpus(queries.select(F.col("query_id").alias("card_id"), F.col("qtext").alias("txt")), lambda: embed.make_embedder("hash:32")).toDF("query_id", "qv")
    labels = spark.createDataFrame([("a", "p2", 2.0, 0), ("b", "p4", 2.0, 0)], "query_id string, card_id string, grade double, slot long")
    return Record.from_frames(spark, versions=cards, texts=texts, queries=queries, text_edges=edges, entity_mentions=mentions, vectors=vectors, query_vectors=qv, labels=labels)


@pytest.mark.parametrize("name", sorted(api.SCORERS))
def test_every_scorer_keeps_to_the_contract(record, name):
    rows = api.rankings(record, name, k=4).collect()
    seen = {(r.query_id, r.card_id): r for r in rows}
    assert rows and ("a", "p5") not in seen and ("b", "p5") not in seen
    for q in ("a", "b"):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len({r.top_score for r in own}) == 1
        chain = [r.chain_pos for r in own]
        assert set(chain) == {None} or sorted(chain) == list(range(1, len(own) + 1))
    if name in ("first_stage", "two_step", "dag_walk", "onto_walk", "onto_llm_walk"):
        assert ("a", "p1") not in seen and seen["a", "p2"]["rank"] == 1


def test_walks_reach_what_words_do_not(record):
    walked = {(r.query_id, r.card_id) for r in api.rankings(record, "onto_walk").collect()}
    assert ("a", "p4") in walked
    with pytest.raises(guards.Circular):
        api.rankings(record, "dag_walk", "dag_mined")


def test_hooks_replace_what_a_model_would_do(record, spark):
    longest = networks.reranked(record, 1, lambda pairs: pairs.select("query_id", "card_id", F.length("txt").cast("double").alias("score"))).collect()
    assert {r.query_id: r.card_id for r in longest}["a"] == "p2"
    pairs = judge.paired_lists(judge.lists(api.rankings(record, "bm25").unionByName(api.rankings(record, "dense")), record.labels), record.labels, "bm25", "dense")
    silent = judge.duel(pairs, lambda p, a, b, salt: F.lit(None).cast("string")).collect()
    assert len(silent) == 2 and all(r.verdict is None and not r.inconsistent for r in silent)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="committed_at"):
        Record.from_frames(spark, versions=spark.createDataFrame([("a", "l", None)], "card_id string, line string, supersedes_id string"))


def test_equal_lists_show_the_position_bias(spark):
    rows = spark.range(2000).select(F.col("id").alias("query_id"), F.lit(1.0).alias("x_gain"), F.lit(1.0).alias("y_gain"), F.lit(5).alias("x_length"), F.lit(5).alias("y_length"), F.lit("a|b").alias("x_ids"), F.lit("c|d").alias("y_ids"), F.lit(1.0).alias("best"))
    d = judge.duel(rows).collect()
    first = sum(r.forward == "A" for r in d) / sum(r.forward != "TIE" for r in d)
    assert first > 0.8 and sum(r.inconsistent for r in d) > 1000


def test_hash_embedding_has_fixed_values():
    v = embed.HashEmbedder(16)
    assert abs((v.encode(["two words"])[0] ** 2).sum() - 1) < 1e-12 and not v.encode([""])[0].any()
    import hashlib

    h = int.from_bytes(hashlib.blake2b(b"ab", digest_size=8).digest(), "little")
    assert v.encode(["ab"])[0][h % 16] == (1.0 if h >> 63 else -1.0)


def test_truth_is_seen_behind_stored_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/true_facts.parquet")
    df = written(written(spark.read.parquet(f"{tmp_path}/true_facts.parquet"), "one").where("id > 0"), "two")
    with pytest.raises(guards.TruthLeak):
        guards.check_truth(df)


def test_a_source_without_rows_is_emptied(spark):
    path = new_path(spark, "by-source")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string")
    sinks.replace_source(rows, path)
    sinks.replace_source(rows.where("source = 'a'").withColumn("id", F.lit(7)), path, ["a"])
    sinks.replace_source(rows.where("false"), path, ["b"])
    assert [(r.id, r.source) for r in spark.read.parquet(path).collect()] == [(7, "a")]


def test_the_oracle_row_of_the_method_table_is_one(record):
    from rankloom.plans import walks

    rows = {r.run: r for r in walks.walk_methods(record).collect()}
    assert set(rows) == {*walks.METHODS, "oracle"} and rows["oracle"].slot_recall == rows["oracle"].chain_recall == 1.0
    assert all(r.n == 2 for r in rows.values())
