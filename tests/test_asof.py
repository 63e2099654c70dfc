from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rankloom.operators import asof

DAY0 = datetime(2025, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def cards(spark, *rows):
    return asof.with_superseded(spark.createDataFrame([(i, day(d), s) for i, d, s in rows], "card_id string, committed_at timestamp_ntz, supersedes_id string"))


def test_currency_is_as_of(spark):
    c = cards(spark, ("a", 0, None), ("b", 10, "a"), ("z", 1, None))
    at = lambda d: {r.card_id for r in c.where(asof.in_snapshot(F.lit(day(d))) & asof.current(F.lit(day(d)))).collect()}
    assert at(5) == {"a", "z"}
    assert at(12) == {"b", "z"}


def test_forward_edges_leave_and_are_counted(spark):
    c = cards(spark, ("a", 0, None), ("b", 5, None), ("c", 9, None))
    e = spark.createDataFrame([("b", "a", "parent"), ("c", "a", "citation"), ("a", "c", "parent"), ("b", "c", "true_support")], "src string, dst string, kind string")
    rows = asof.checked_edges(e, c).collect()
    assert {(r.src, r.dst, r.kind) for r in rows if r.kept} == {("b", "a", "parent"), ("c", "a", "citation")}
    assert sorted(r.kind for r in rows if not r.kept) == ["parent", "true_support"]


def test_equal_instants_and_doubles_make_one_edge(spark):
    c = cards(spark, ("a", 3, None), ("b", 3, None))
    e = spark.createDataFrame([("b", "a", "parent")] * 2, "src string, dst string, kind string")
    assert [r.kept for r in asof.checked_edges(e, c).collect()] == [True]


def test_latest_version_at_citing_time(spark):
    v = spark.createDataFrame([("r", "v1", day(10)), ("r", "v2", day(20))], "root string, card_id string, committed_at timestamp_ntz")
    c = spark.createDataFrame([("x", "r", day(5)), ("y", "r", day(15)), ("z", "r", day(25))], "src string, root string, at timestamp_ntz")
    assert {(r.src, r.dst) for r in asof.cited_as_of(c, v).collect()} == {("y", "v1"), ("z", "v2")}


def test_in_degree_grows_with_time(spark):
    e = spark.createDataFrame([("x", "old", "citation", day(3)), ("y", "old", "citation", day(8))], "src string, dst string, kind string, valid_from timestamp_ntz")
    t = spark.createDataFrame([(day(1),), (day(3),), (day(30),)], "as_of timestamp_ntz")
    assert {(r.as_of, r.in_degree) for r in asof.in_degrees(e, t).collect()} == {(day(3), 1), (day(30), 2)}


def test_version_roots_of_long_and_branching_chains(spark):
    rows = [("c0", 0, None)] + [(f"c{i}", i, f"c{i - 1}") for i in range(1, 12)] + [("d", 3, "c2")]
    roots = asof.version_roots(cards(spark, *rows))
    assert {r.root for r in roots.collect()} == {"c0"} and roots.count() == 13


def test_scale_subset_pins_needles(spark):
    c = cards(spark, *[(f"k{i}", i, None) for i in range(20)])
    needles = spark.createDataFrame([("k3",), ("k4",)], "card_id string")
    got = {r.card_id for r in asof.scale_subset(c, needles, 7, 1).collect()}
    assert len(got) == 7 and {"k3", "k4"} <= got
    assert len(asof.scale_subset(c, needles, 1, 1).collect()) == 2
