from datetime import datetime, timedelta

from rankloom.operators import graph


def day(n):
    return datetime(2025, 1, 1) + timedelta(days=n)


def build(spark, cards, edges):
    c = spark.createDataFrame([(i, day(d)) for i, d, _ in cards], "card_id string, committed_at timestamp_ntz")
    r = spark.createDataFrame([(i, root or i) for i, _, root in cards], "card_id string, root string")
    at = {i: d for i, d, _ in cards}
    e = spark.createDataFrame([(a, b, "citation", day(max(at[a], at[b]))) for a, b in edges], "src string, dst string, kind string, valid_from timestamp_ntz")
    return c, r, e


def depths(spark, world, seed, at, **options):
    seeds = spark.createDataFrame([(1, seed)], "query_id long, card_id string")
    times = spark.createDataFrame([(1, day(at))], "query_id long, as_of timestamp_ntz")
    return {r.card_id: r.depth for r in graph.walk(seeds, times, *world, **options).collect()}


# a diamond with a tail: hub cites left and right, both cite base, base cites old; a review of hub follows on day 40
DIAMOND = (
    [("hub", 30, None), ("left", 21, None), ("right", 24, None), ("base", 12, None), ("old", 3, None), ("review", 40, None)],
    [("hub", "left"), ("hub", "right"), ("left", "base"), ("right", "base"), ("base", "old"), ("review", "hub")],
)


def test_walk_goes_both_ways_and_sees_only_the_past(spark):
    world = build(spark, *DIAMOND)
    assert depths(spark, world, "right", 35) == {"right": 0, "hub": 1, "base": 1, "left": 2, "old": 2}
    assert depths(spark, world, "right", 35, hops=1) == {"right": 0, "hub": 1, "base": 1}
    assert depths(spark, world, "right", 26) == {"right": 0, "base": 1, "left": 2, "old": 2}
    assert depths(spark, world, "right", 26, blind=True)["review"] == 2


def test_versions_share_a_depth_once_they_exist(spark):
    cards, edges = DIAMOND
    world = build(spark, [*cards, ("base-b", 28, "base"), ("base-c", 50, "base")], edges)
    at_35 = depths(spark, world, "old", 35)
    assert at_35["base"] == at_35["base-b"] == 1 and "base-c" not in at_35
    assert depths(spark, world, "base-b", 35)["left"] == 1


def test_cycles_end(spark):
    wheel = [f"r{i}" for i in range(7)]
    world = build(spark, [(x, 4, None) for x in wheel], [*((wheel[i], wheel[i - 1]) for i in range(7)), ("r0", "r3")])
    assert depths(spark, world, "r5", 4, hops=3) == {"r5": 0, "r4": 1, "r6": 1, "r3": 2, "r0": 2, "r2": 3, "r1": 3}


def test_induced_links(spark):
    _, _, e = build(spark, *DIAMOND)
    n = spark.createDataFrame([(4, "hub"), (4, "left"), (4, "base"), (9, "right"), (9, "old")], "query_id long, card_id string")
    assert sorted((r.query_id, r.src, r.dst) for r in graph.induced(n, e).collect()) == [(4, "hub", "left"), (4, "left", "base")]


def ppr(spark, nodes, links, seeds):
    n = spark.createDataFrame([(1, x) for x in nodes], "query_id long, card_id long")
    k = spark.createDataFrame([(1, a, b) for a, b in links], "query_id long, src long, dst long")
    s = spark.createDataFrame([(1, x, 1.0) for x in seeds], "query_id long, card_id long, weight double")
    return {r.card_id: r.score for r in graph.pagerank(n, k, s).collect()}


def test_pagerank_equals_a_dense_power_iteration(spark):
    import numpy as np

    links = [(0, 1), (0, 2), (2, 3), (2, 3), (3, 0), (5, 6)]
    got = ppr(spark, range(8), links, [2, 5])
    a = np.zeros((8, 8))
    for x, y in links:
        a[y, x] += 1
        a[x, y] += 1
    degree = a.sum(axis=0)
    m = a / np.where(degree, degree, 1)
    s = np.array([0, 0, 0.5, 0, 0, 0.5, 0, 0])
    p = s
    for _ in range(20):
        p = 0.5 * s + 0.5 * m @ p
    assert [got[i] for i in range(8)] == [round(float(x), 6) for x in p]


def test_pagerank_without_seeds_or_links(spark):
    assert set(ppr(spark, range(5), [(1, 4), (4, 2)], []).values()) == {0.0}
    alone = ppr(spark, range(3), [], [1])
    assert alone[1] > 0 == alone[0] == alone[2]


def test_components_and_snowball(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {(r.node, r.label) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    edges = spark.createDataFrame([(0, 1), (0, 2), (2, 3), (3, 4)], "src long, dst long")
    sizes = spark.createDataFrame([(i, 1) for i in range(5)], "node long, size long")
    assert {r.node for r in graph.snowball(edges, sizes, 1, 3).collect()} == {0, 1, 2}
