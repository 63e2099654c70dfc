"""Walks over a dated graph, for all queries at once, and personalised PageRank.

A walk goes along edges in either direction at cost 1 and along version chains at cost 0,
at most ``hops`` steps, seeing only what is valid at the query's time. Chains are
contracted to their root first, which turns the zero-cost steps into a key; each hop is
then one join on the root, followed by removal of what has been reached.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.storage import small, written

ALPHA, ITERATIONS = 0.5, 20
#: Most links of a query, or of queries with the same links, whose PageRank one task works out in its memory.
LOCAL_LINKS = 16_000_000
#: Tasks over which such groups are dealt.
LOCAL_TASKS = 64
#: Most nodes within reach of the seeds that are looked for.
MOST_REACHED = 4_000_000


def contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, valid_from between roots, in both directions, the earliest date of each."""
    r = roots.select("card_id", "root")
    e = edges.join(r.select(F.col("card_id").alias("src"), F.col("root").alias("ra")), "src").join(r.select(F.col("card_id").alias("dst"), F.col("root").alias("rb")), "dst").where("ra <> rb")
    both = e.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "valid_from").union(e.select("rb", "ra", "valid_from"))
    return both.groupBy("a", "b").agg(F.min("valid_from").alias("valid_from"))


def walk(seeds: DataFrame, times: DataFrame, cards: DataFrame, roots: DataFrame, edges: DataFrame, hops: int = 3, blind: bool = False) -> DataFrame:
    """query_id, card_id, depth for seeds (query_id, card_id) and times (query_id, as_of).

    ``blind`` ignores dates. A card's depth is that of its chain; versions that are not
    committed at the query's time are not reached.
    """
    adjacent = written(contracted(edges, roots), "adjacent")
    start = seeds.select("query_id", "card_id").join(roots, "card_id").select("query_id", F.col("root").alias("node")).distinct().join(times, "query_id")
    reached = written(start.withColumn("depth", F.lit(0)), "walk")
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.select("query_id", "as_of", F.col("node").alias("a")).join(adjacent, "a")
        if not blind:
            step = step.where(F.col("valid_from") <= F.col("as_of"))
        new = step.select("query_id", F.col("b").alias("node"), "as_of").distinct().join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti")
        frontier = written(new.withColumn("depth", F.lit(h)), "walk")
        reached = reached.unionByName(frontier)
    versions = roots.select("card_id", F.col("root").alias("node")).join(cards.select("card_id", "committed_at"), "card_id")
    out = reached.join(versions, "node")
    if not blind:
        out = out.where(F.col("committed_at") <= F.col("as_of"))
    return out.select("query_id", "card_id", "depth")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, src, dst: the edges with both ends among a query's nodes."""
    n = nodes.select("query_id", "card_id")
    return edges.select("src", "dst").join(n.withColumnRenamed("card_id", "src"), "src").join(n.withColumnRenamed("card_id", "dst"), ["query_id", "dst"]).select("query_id", "src", "dst")


def pagerank(
    nodes: DataFrame | None, links: DataFrame, seeds: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, views: DataFrame | None = None, only: str = "", lone: bool = False
) -> DataFrame:
    """query_id, card_id, score: p = alpha * seed + (1 - alpha) * sum of p / degree over neighbours.

    Links count in both directions and as often as they occur; mass at a node without
    links is not passed on. All nodes get a score, or (``nodes`` None) those ends of links
    whose score is above 0 in six places and whose name begins with ``only``; seeds that
    no link touches are among them if ``lone``. With ``views`` (query_id, view) queries
    share links, whose query_id then is a view.

    Up to LOCAL_LINKS of them, the links of a query meet in one task, which makes all
    iterations; beyond that each iteration is a join.
    """
    links = written(links.select("query_id", "src", "dst"), "links")
    total = seeds.groupBy("query_id").agg(F.sum("weight").alias("total"))
    s = seeds.select("query_id", "card_id", "weight").join(total, "query_id")
    if nodes is not None:
        known = written(nodes.select("query_id", "card_id").distinct(), "nodes")
        s = s.join(known, ["query_id", "card_id"], "left_semi")
    s = written(s.groupBy("query_id", "card_id").agg(F.coalesce(F.try_divide(F.sum("weight"), F.max("total")), F.lit(0.0)).alias("p")), "ppr")
    if (links.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) <= LOCAL_LINKS:
        shared = s.withColumn("view", F.col("query_id")) if views is None else s.join(views, "query_id")
        p = _local(links, shared, alpha, iterations, lone or nodes is not None, only)
    else:
        if views is not None:
            links = links.withColumnRenamed("query_id", "view").join(views, "view").select("query_id", "src", "dst")
        if nodes is None and not lone:
            ends = links.select("query_id", F.col("src").alias("card_id")).union(links.select("query_id", "dst")).distinct()
            s = s.join(ends, ["query_id", "card_id"], "left_semi")
        p = _joined(links, s, alpha, iterations)
    if nodes is None:
        named = p.select("query_id", "card_id", F.round("p", 6).alias("score")).where("score > 0")
        return named.where(F.col("card_id").startswith(only)) if only else named
    return known.join(p, ["query_id", "card_id"], "left").select("query_id", "card_id", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("score"))


def _joined(links: DataFrame, s: DataFrame, alpha: float, iterations: int) -> DataFrame:
    """query_id, card_id, p from the seeds' shares ``s`` (query_id, card_id, p).

    Only nodes that hold mass are carried, so an iteration is a join on the links and a
    sum, and the first ones touch the seeds' surroundings alone. Every fifth iteration is
    stored to keep plans short.
    """
    both = links.select("query_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(links.select("query_id", "dst", "src"))
    out_degree = both.groupBy("query_id", "a").agg(F.count(F.lit(1)).alias("degree"))
    weighted = written(both.join(out_degree, ["query_id", "a"]).groupBy("query_id", "a", "b").agg((F.count(F.lit(1)) / F.max("degree")).alias("w")), "links")
    source = s.select("query_id", "card_id", (F.col("p") * alpha).alias("p"))
    p = s
    for i in range(iterations):
        came = p.select("query_id", F.col("card_id").alias("a"), "p").join(weighted, ["query_id", "a"]).select("query_id", F.col("b").alias("card_id"), (F.col("p") * F.col("w") * (1 - alpha)).alias("p"))
        p = source.unionByName(came).groupBy("query_id", "card_id").agg(F.sum("p").alias("p"))
        if i % 5 == 4:
            p = written(p, "ppr")
    return p


def _local(links: DataFrame, s: DataFrame, alpha: float, iterations: int, lone: bool, only: str) -> DataFrame:
    """The same in one task for each view (of ``s``; query_id of ``links``); p below half of the sixth place is left out.

    ``lone``: seeds without links hold their mass, else they leave.
    """
    kinds, names = dict(s.dtypes), ["query_id", "card_id", "p"]

    def run(l: pa.Table, seeds: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*l.column("src").chunks, *l.column("dst").chunks, *(seeds.column("card_id").chunks if lone else [])], l.schema.field("src").type).combine_chunks()
        coded = (ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends).dictionary_encode()
        known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        del ends, coded
        src, dst = code[: l.num_rows], code[l.num_rows : 2 * l.num_rows]
        degree = np.maximum(np.bincount(src, minlength=len(known)) + np.bincount(dst, minlength=len(known)), 1)
        first = np.zeros((seeds.num_rows, 2), dtype=np.int64)
        first[:, 0] = pc.fill_null(pc.index_in(seeds.column("card_id"), known), -1).to_numpy()
        ids = seeds.column("query_id").combine_chunks().dictionary_encode() if seeds.num_rows else None
        if ids is None:
            return pa.table({n: pa.array([], f.type) for n, f in zip(names, out)})
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        first[:, 1] = ids.indices.to_numpy()
        share = seeds.column("p").to_numpy()
        shown = pc.starts_with(known, only).to_numpy(zero_copy_only=False) if only else np.ones(len(known), dtype=bool)
        parts = []
        for j, query in enumerate(ids.dictionary):
            mine = (first[:, 1] == j) & (first[:, 0] >= 0)
            start = np.bincount(first[mine, 0], weights=share[mine], minlength=len(known))
            p = start
            for _ in range(iterations):
                x = p / degree
                p = alpha * start + (1 - alpha) * (np.bincount(dst, weights=x[src], minlength=len(known)) + np.bincount(src, weights=x[dst], minlength=len(known)))
            at = np.flatnonzero(shown & (p >= 4e-7))
            parts.append(pa.table([pa.array([query.as_py()] * len(at), out[0].type), known.take(pa.array(at)), pa.array(p[at])], names=names))
        return pa.concat_tables(parts).cast(pa.schema(list(out)))

    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    out = [pa.field("query_id", kind[kinds["query_id"]]), pa.field("card_id", kind[kinds["card_id"]]), pa.field("p", pa.float64())]
    deal = lambda d, c: d.repartition(LOCAL_TASKS, c).groupBy(c)
    rows = deal(links.withColumnRenamed("query_id", "view"), "view").cogroup(deal(s, "view"))
    return rows.applyInArrow(run, f"query_id {kinds['query_id']}, card_id {kinds['card_id']}, p double")


def within_reach(mentions: DataFrame, facts: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """The mentions (card_id, entity_id) and facts (subj, obj) that mass from the cards of ``seeds`` can touch, all of their columns, stored.

    A step sends the nodes that are new to it to the links, which are not shuffled. Where
    more than MOST_REACHED nodes are reached everything is kept.
    """
    mentions, facts = written(mentions, "mentions"), written(facts, "facts")
    ways = [mentions.select(F.col("entity_id").alias("a"), F.col("card_id").alias("b")), mentions.select(F.col("card_id").alias("a"), F.col("entity_id").alias("b"))]
    ways += [facts.select(F.col("subj").alias("a"), F.col("obj").alias("b")), facts.select(F.col("obj").alias("a"), F.col("subj").alias("b"))]
    cards = at_cards = written(seeds.select(F.col("card_id").alias("b")).distinct(), "reach")
    entities = at_entities = None
    total = cards.count()
    for _ in range(iterations):
        step = lambda way, at: way.join(F.broadcast(at.select(F.col("b").alias("a"))), "a", "left_semi").select("b").distinct()
        far = step(ways[1], at_cards) if at_cards else None
        new_cards = None
        if at_entities is not None:
            new_cards = written(step(ways[0], at_entities).join(cards, "b", "left_anti"), "reach")
            near = step(ways[2], at_entities).union(step(ways[3], at_entities))
            far = near if far is None else far.union(near)
        if far is None:
            break
        new_entities = far.distinct().where("b is not null")
        new_entities = written(new_entities if entities is None else new_entities.join(entities, "b", "left_anti"), "reach")
        n_cards, n_entities = new_cards.count() if new_cards else 0, new_entities.count()
        at_cards, at_entities = new_cards if n_cards else None, new_entities if n_entities else None
        cards = cards.union(new_cards) if n_cards else cards
        entities = new_entities if entities is None else entities.union(new_entities)
        total += n_cards + n_entities
        if total > MOST_REACHED:
            return mentions, facts
        if not n_cards and not n_entities:
            break
    # a link of a node within reach has both ends there, but for the last step
    known = F.broadcast(entities)
    return (
        written(mentions.join(known.withColumnRenamed("b", "entity_id"), "entity_id", "left_semi").select(mentions.columns), "reached"),
        written(facts.join(known.withColumnRenamed("b", "subj"), "subj", "left_semi").select(facts.columns), "reached"),
    )


def entity_links(mentions: DataFrame, facts: DataFrame, times: DataFrame, blind: bool = False) -> DataFrame:
    """query_id, src, dst over card and entity nodes (strings) valid at each query's time.

    Mentions (card, entity, valid_from) last for good; facts (subj, obj, valid_from,
    valid_until) end; facts of an entity with itself leave. Times are a few rows.
    """
    t = small(times.select("query_id", "as_of", "intent"))
    m = mentions.select(F.concat(F.lit("c"), F.col("card_id").cast("string")).alias("src"), F.concat(F.lit("e"), F.col("entity_id")).alias("dst"), "valid_from")
    f = facts.where("subj <> obj").select(F.concat(F.lit("e"), F.col("subj")).alias("src"), F.concat(F.lit("e"), F.col("obj")).alias("dst"), "valid_from", "valid_until")
    if blind:
        return m.crossJoin(t).select("query_id", "src", "dst").union(f.crossJoin(t).select("query_id", "src", "dst"))
    began = F.col("valid_from") <= F.col("as_of")
    lasts = (F.col("intent") == "history") | F.col("valid_until").isNull() | (F.col("valid_until") > F.col("as_of"))
    return m.join(t, began).select("query_id", "src", "dst").union(f.join(t, began & lasts).select("query_id", "src", "dst"))


def snowball(edges: DataFrame, sizes: DataFrame, hubs: int, target: int) -> DataFrame:
    """node, depth, running: breadth-first from the ``hubs`` nodes of highest degree until the sizes reach ``target``.

    Order within a depth is by node, so the sample does not depend on the order of rows.
    """
    from pyspark.sql import Window

    both = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct(), "snow")
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    seen = written(degree.orderBy(F.col("d").desc(), "node").limit(hubs).select("node", F.lit(0).alias("depth")), "snow")
    frontier, depth = seen, 0
    while True:
        got = seen.join(sizes, "node").agg(F.sum("size")).first()[0] or 0
        if got >= target:
            break
        depth += 1
        new = frontier.select(F.col("node").alias("a")).join(both, "a").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)), "snow")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    sized = seen.join(sizes, "node")
    per = sized.groupBy("depth").agg(F.sum("size").alias("all"))
    levels = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)  # one row per depth
    per = per.select("depth", F.coalesce(F.sum("all").over(levels), F.lit(0)).alias("before"))
    inside = Window.partitionBy("depth").orderBy("node")
    out = sized.join(F.broadcast(per), "depth").withColumn("running", F.col("before") + F.sum("size").over(inside))
    return out.where(F.col("running") - F.col("size") < target).select("node", "depth", "running")


def components(edges: DataFrame) -> DataFrame:
    """node, label for the ends of ``edges`` (a, b): the smallest node of the component, by labels of labels."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        hop = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
        jump = hop.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid").select("node", "old", F.least("mid", "far").alias("label"))
        jump = written(jump, "labels")
        if not jump.where("label <> old").limit(1).count():
            return jump.select("node", "label")
        labels = jump.select("node", "label")
