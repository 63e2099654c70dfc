"""Point-in-time operators over versioned cards.

Cards have card_id, committed_at and supersedes_id; a card is superseded when its first
successor is committed. Edges have src, dst, kind and valid_from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import draw
from rankloom.storage import small, written


def with_superseded(cards: DataFrame) -> DataFrame:
    """``cards`` with superseded_at, the least commit time of a successor (null: current for good)."""
    later = cards.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("card_id")).agg(F.min("committed_at").alias("superseded_at"))
    return cards.join(later, "card_id", "left")


def in_snapshot(as_of: Column) -> Column:
    return F.col("committed_at") <= as_of


def current(as_of: Column) -> Column:
    return F.col("superseded_at").isNull() | (F.col("superseded_at") > as_of)


def in_pool(as_of: Column, intent: Column) -> Column:
    """What a query may see: its snapshot, and for current intent only what is current then."""
    return in_snapshot(as_of) & ((intent != "current") | current(as_of))


def masked(scores: DataFrame, queries: DataFrame, cards: DataFrame, pool: bool = False) -> DataFrame:
    """``scores`` of cards that the query's time allows. Joins are on keys; no time is matched against all cards."""
    seen = scores.join(queries.select("query_id", "as_of", "intent"), "query_id").join(cards.select("card_id", "committed_at", "superseded_at"), "card_id")
    keep = in_pool(F.col("as_of"), F.col("intent")) if pool else in_snapshot(F.col("as_of"))
    return seen.where(keep)


def version_roots(cards: DataFrame) -> DataFrame:
    """card_id, root by pointer doubling: the table shrinks the distance to the root by half each round."""
    links = written(cards.select("card_id", F.coalesce("supersedes_id", "card_id").alias("root")), "roots")
    while True:
        up = links.select(F.col("card_id").alias("root"), F.col("root").alias("above"))
        after = written(links.join(up, "root").select("card_id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("card_id", "root")
        links = after.select("card_id", "root")


def cited_as_of(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """As-of join: for (src, root, at) the latest version of ``root`` committed by ``at``; without one the row leaves.

    Citations and versions of a root are put in one order of dates and dealt by ranges of
    it, so a root that many cite fills many tasks; a range takes over the latest version
    of the ranges before it. No citation meets more than one version.
    """
    c = citations.select("src", "root", "at").where("root is not null and at is not null").distinct()
    v = versions.select("root", "committed_at", "card_id").where("committed_at is not null").join(c.select("root").distinct(), "root", "left_semi")
    v = v.select("root", F.col("committed_at").alias("at"), F.struct("committed_at", "card_id").alias("v"))
    both = v.withColumn("src", F.lit(None).cast(dict(c.dtypes)["src"])).withColumn("cites", F.lit(False))
    both = both.unionByName(c.withColumn("v", F.lit(None).cast(dict(v.dtypes)["v"])).withColumn("cites", F.lit(True)))
    both = written(both.repartitionByRange("root", "at").withColumn("part", F.spark_partition_id()), "as-of")
    earlier = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = both.groupBy("root", "part").agg(F.max("v").alias("last")).select("root", "part", F.max("last").over(earlier).alias("before"))
    inside = Window.partitionBy("root", "part").orderBy("at")
    known = both.withColumn("own", F.max("v").over(inside)).where("cites").join(before, ["root", "part"]).withColumn("v", F.coalesce("own", "before"))
    return known.where("v is not null").select("src", "root", "at", F.col("v.card_id").alias("dst"))


def checked_edges(edges: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct edges with ``kept``: dst exists and is not newer than src."""
    at = cards.select("card_id", "committed_at")
    joined = edges.dropDuplicates(["src", "dst", "kind"]).join(at.select(F.col("card_id").alias("src"), F.col("committed_at").alias("src_at")), "src", "left")
    joined = joined.join(at.select(F.col("card_id").alias("dst"), F.col("committed_at").alias("dst_at")), "dst", "left")
    return joined.withColumn("kept", F.coalesce(F.col("dst_at") <= F.col("src_at"), F.lit(False))).drop("src_at", "dst_at")


def in_degrees(edges: DataFrame, times: DataFrame) -> DataFrame:
    """card_id, as_of, in_degree for a small table of distinct times: edges valid by then."""
    hits = edges.join(small(times.select("as_of").distinct()), F.col("valid_from") <= F.col("as_of"))
    return hits.groupBy(F.col("dst").alias("card_id"), "as_of").agg(F.count(F.lit(1)).alias("in_degree"))


def scale_subset(cards: DataFrame, needles: DataFrame, n: int, seed: int) -> DataFrame:
    """Pinned needles and a seeded part of the rest, n cards in all; all needles if they are more."""
    pinned = cards.join(needles.select("card_id").distinct(), "card_id", "left_semi")
    room = max(0, n - pinned.count())
    rest = cards.join(needles.select("card_id").distinct(), "card_id", "left_anti")
    # the last draw that has room lies in one of 65,536 ranges: those before it stay whole, and it alone is put in order
    rest = rest.select("card_id", draw(F.col("card_id").cast("string"), F.lit(str(seed))).alias("h")).withColumn("range", F.shiftright("h", 16))
    upto = rest.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("range")))
    if last := upto.where(F.col("upto") >= room).orderBy("range").first():
        edge = rest.where(F.col("range") == last["range"]).orderBy("h", "card_id").limit(room - last.upto + last.n)
        rest = rest.where(F.col("range") < last["range"]).select("card_id").union(edge.select("card_id"))
    return pinned.select("card_id").union(rest.select("card_id"))


def round_robin(rows: DataFrame, family: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows dealt over families in turn, each family in seeded order."""
    own = Window.partitionBy(family).orderBy(draw(F.col(key).cast("string"), F.lit(str(seed))), key)
    return rows.withColumn("turn", F.row_number().over(own)).orderBy("turn", family).limit(n)
