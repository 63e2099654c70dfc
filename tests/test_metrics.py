from datetime import datetime, timedelta

from rankloom.operators import metrics, ranking, stats


def runs(spark, **lists):
    rows = [(run, q, c, i) for run, per in lists.items() for q, ids in per.items() for i, c in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "run string, query_id long, card_id string, rank long")


def labels(spark, *rows):
    return spark.createDataFrame([(1, c, 2.0, s) for c, s in rows], "query_id long, card_id string, grade double, slot long")


def test_slots_and_chain(spark):
    lab = labels(spark, ("m1", 0), ("m2", 0), ("k", 1), ("w", 2), ("v", 3))
    r = runs(spark, half={1: ["z", "m2", "z2", "w"]}, all={1: ["v", "k", "m1", "z", "w"]}, none={1: ["z"]})
    got = {m.run: (m.slot_recall, m.chain_recall, m.last_hop) for m in metrics.slots(r, lab, 5).collect()}
    assert got == {"half": (0.5, 0.0, 0.0), "all": (1.0, 1.0, 1.0), "none": (0.0, 0.0, 0.0)}
    assert {m.run: m.slot_recall for m in metrics.slots(r, lab, 3).collect()} == {"half": 0.25, "all": 0.75, "none": 0.0}


def test_chain_order(spark):
    lab = labels(spark, ("k", 0), ("w", 1), ("v", 2), ("u", 3))
    days = {"k": 20, "w": 4, "v": 11, "u": 30}
    at = spark.createDataFrame([(c, datetime(2024, 6, 1) + timedelta(days=d)) for c, d in days.items()], "card_id string, committed_at timestamp_ntz")
    r = runs(spark, dated={1: ["w", "z", "v", "k", "u"]}, mixed={1: ["w", "k", "v", "u"]}, turned={1: ["u", "k", "v", "w"]}, part={1: ["w", "v", "k"]})
    assert {m.run: (m.tau, m.in_order) for m in metrics.chain_tau(r, lab, at).collect()} == {
        "dated": (1.0, 1), "mixed": (round(4 / 6, 6), 0), "turned": (-1.0, 0), "part": (1.0, 1),
    }
    assert {m.run: m.exact for m in metrics.order_exact(r, lab, at).collect()} == {"dated": True, "mixed": False, "turned": False, "part": False}


def test_condensed_ignores_the_unjudged(spark):
    lab = labels(spark, ("a", 0))
    r = runs(spark, x={1: ["u", "v", "a"]})
    none = spark.createDataFrame([], "query_id long, card_id string")
    assert metrics.ndcg(r, lab, 10, none).first().ndcg == 1.0
    assert metrics.ndcg(r, lab, 10).first().ndcg == 0.5
    assert metrics.reciprocal_rank(r, lab).first().mrr == round(1 / 3, 6)
    assert metrics.recall(r, lab, 2).first().recall == 0.0


def test_bpref_counts_judged_nonrelevant_above(spark):
    lab = labels(spark, ("a", 0), ("b", 0))
    r = runs(spark, x={1: ["n", "a", "b"]}, y={1: ["a", "b", "n"]})
    got = {m.run: m.bpref for m in metrics.bpref(r, lab, metrics.judgment_pool(r, 3)).collect()}
    assert got == {"x": 0.0, "y": 1.0}


def test_fusion_and_tie_order(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, card_id long, rank long")
    b = spark.createDataFrame([(1, 8, 1), (1, 7, 2)], "query_id long, card_id long, rank long")
    assert [(r.card_id, r["rank"]) for r in ranking.ranked(ranking.fused([a, b])).orderBy("rank").collect()] == [(7, 1), (8, 2)]


def test_statistics(spark):
    d = spark.createDataFrame([("up", i, 0.1 + i / 1000) for i in range(20)] + [("few", i, 1.0) for i in range(2)], "label string, query_id long, delta double")
    b = {r.label: r for r in stats.bootstrap(d, 200).collect()}
    assert 0.1 <= b["up"].lo <= b["up"].mean <= b["up"].hi <= 0.12 and b["few"].lo is None
    g = {r.label: r for r in stats.bootstrap_pcg64(d, 200).collect()}
    assert abs(g["up"].lo - b["up"].lo) < 0.005 and g["few"].lo is None
    verdicts = {r.label: r.v for r in stats.bootstrap(d, 200).select("label", stats.verdict(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, ("lo", "hi"))).alias("v")).collect()}
    assert verdicts == {"up": "BETTER", "few": "NO DATA"}
    p = spark.createDataFrame([("m", True, False)] * 12 + [("m", False, True)] * 2 + [("t", True, True)], "label string, right_a boolean, right_b boolean")
    got = {r.label: r for r in stats.mcnemar(p).collect()}
    assert (got["m"].only_a, got["m"].only_b) == (12, 2) and abs(got["m"].p - 0.01616) < 1e-3 and got["t"].p is None
    k = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 1), (None, 1)], "a long, b long")
    assert stats.kappa(k).first().kappa == 0.5
    t = spark.createDataFrame([("x", i, float(i), float(-i)) for i in range(4)], "label string, key long, x double, y double")
    assert stats.kendall(t).first().tau == -1.0


def test_hop_split_order(spark):
    first = spark.createDataFrame([(1, i, 1.0 / i, i) for i in range(1, 13)], "query_id long, card_id long, score double, rank long")
    second = spark.createDataFrame([(1, 50, 0.9), (1, 7, 0.5), (1, 12, 0.4)], "query_id long, card_id long, score double")
    got = [r.card_id for r in ranking.hop_split(first, second, 10).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5, 50, 12, 7, 6, 8]
