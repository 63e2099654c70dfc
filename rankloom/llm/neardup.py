"""Near-duplicate documents by bottom-k sketches, exact links and components.

1. The shingles of a document are hashed once, to 64 bits; the sorted distinct values are
   its set and the k smallest its bottom-k sketch. Documents with equal sets are one class.
2. Inverted lists: how many classes retain a value is counted, and each class is listed
   under its rarest retained values only. Two sketches of k values that share at least o
   of them meet in one of their k - o + 1 rarest, whatever the order, so common passages
   and frequent phrases never form lists of unrelated documents. For sets that fit in
   their sketch o follows from the threshold; for longer ones the number of shared values
   is at least binomial and o is its lower bound at probability ``MISS``.
3. Short lists give all their pairs, each once (at its first common value). In a long
   list all members are compared with one hub; what is still unconnected to the hub after
   that is compared with all members of other components, so no link is lost.
4. The sketch of the union, merged from both sketches, estimates the similarity; pairs
   far below the threshold leave. The rest is verified on full sets, in whole numbers:
   100 * intersection >= percent * union.
5. Components grow by the smallest label with pointer jumping, in tables.

Nothing about documents is gathered on the driver. Defined cases: a null or empty text,
or one without words, has an empty set and is alone; a text with fewer words than a
shingle is one shingle; repeated rows and equal texts share a class; a null doc_id never
names a component unless no other is in it; texts of any length are taken whole, 128 at a
time in memory; an empty table gives no rows; other columns are ignored (``drop_near_duplicates`` returns them as they are).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.storage import written
from rankloom.llm.textops import mapped, per_batch, words

SKETCH = 64
#: Lists up to this length give all pairs, longer ones pairs with a hub.
SHORT_LIST = 16
#: Lists above this length are looked up by broadcast, so that their members are not gathered by value.
HOT_LIST = 1000
#: Bound on the chance that a pair at the threshold has fewer common sketch values than assumed.
MISS = 1e-7
#: Members of a long list that are compared with as many others in one task, and the shingles they may have.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Shingles counted at once.
COLUMNS = 2048
#: Most rows of ids that are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value for aligned word hashes, dependent on their order, mixed at the end."""
    acc = parts[0] + np.uint64(len(parts))
    for part in parts[1:]:
        acc = (acc << np.uint64(23) | acc >> np.uint64(41)) ^ part
        acc = acc * np.uint64(0x9E3779B97F4A7C15)
    acc = (acc ^ acc >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    acc = (acc ^ acc >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return acc ^ acc >> np.uint64(33)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle values of a text."""
    tokens = words(text) if text else []
    # only A-Z are lowered: bytes.lower leaves all else
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.lower, tokens)), dtype=np.uint64, count=len(tokens))
    if not len(w):
        return w
    if len(w) < width:
        return _joined([w[i : i + 1] for i in range(len(w))])
    return np.unique(_joined([w[i : len(w) - width + 1 + i] for i in range(width)]))


def shared_at_least(k: int, percent: int, miss: float = MISS) -> int:
    """The most o with P(Binomial(k, percent/100) < o) <= miss."""
    p, below, o = percent / 100, 0.0, 0
    while True:
        below += math.comb(k, o) * p**o * (1 - p) ** (k - o)
        if below > miss:
            return max(o, 1)
        o += 1


def featured(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n (set size), key (128-bit digest of the set), sketch (as signed longs in hash order)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        low = [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sketch"]
        )

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), per_batch(run, 128), f"doc_id {kind}, n long, key binary, sketch array<long>")


def looked_up(rows: DataFrame, counted: DataFrame, size: str) -> DataFrame:
    """``rows`` joined with the stored table ``counted`` by value, where ``size`` is the number of rows with the value.

    Values of more than HOT_LIST rows are at most one in HOT_LIST rows. They are broadcast
    while their table is small, so rows of a hot value stay where they are.
    """
    more = [c for c in counted.columns if c != "value"]
    near = rows.join(small(counted.where(F.col(size) > HOT_LIST)), "value", "left")
    rest = near.where(F.col(size).isNull()).drop(*more).join(counted.where(F.col(size) <= HOT_LIST), "value")
    return near.where(F.col(size).isNotNull()).unionByName(rest)


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """cid, n, centre, prefix: the rarest retained values that others retain too, rarest first.

    ``centre`` is the mean number of classes that retain a value of the sketch; among near
    copies it is highest for the text that the others were made from.
    """
    values = classes.select("cid", F.explode("sketch").alias("value"))
    known = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = looked_up(values, written(known, "dedup-known"), "df").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    common = common.join(classes.select("cid", "n", F.size("sketch").alias("m")), "cid")
    whole = F.col("n") * 100 <= F.lit(SKETCH * percent)
    least = F.when(whole, F.expr(f"(n * {percent} + 99) div 100")).otherwise(F.lit(shared_at_least(SKETCH, percent)))
    # values that no other class retains are rarer than all of these and fill the prefix first
    take = F.greatest(F.col("m") - least + 1 - (F.col("m") - F.size("common")), F.lit(0)).cast("int")
    centre = F.aggregate("common", F.lit(0).cast("long"), lambda acc, x: acc + x["df"]) / F.col("m")
    return common.select("cid", "n", centre.alias("centre"), F.transform(F.slice("common", F.lit(1), take), lambda x: x["value"]).alias("prefix")).where("size(prefix) > 0")


def _near_size(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def candidate_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes: all of short lists, and those with the hub of long lists. ``members`` are placed."""
    short = members.where(F.col("length") <= SHORT_LIST)
    x, y = short.alias("x"), short.alias("y")
    meet = (F.col("x.value") == F.col("y.value")) & (F.col("x.cid") < F.col("y.cid")) & _near_size("x.n", "y.n", percent)
    close = x.join(y, meet).where(F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == F.col("x.value"))
    starred = members.where(F.col("length") > SHORT_LIST).where(F.col("cid") != F.col("hub"))
    return _ordered(close.select(F.col("x.cid").alias("x"), F.col("y.cid").alias("y")).union(starred.select(F.col("cid").alias("x"), F.col("hub").alias("y"))))


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """value, cid, n, label, outside, blocks: long lists in which the hub is not connected to everyone, stored."""
    long = members.where(F.col("length") > SHORT_LIST).select("value", "cid", "n", "hub", "length", "shingles")
    named = long.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    hubs = labels.select(F.col("cid").alias("hub"), F.col("label").alias("hub_label"))
    named = named.join(hubs, "hub", "left").withColumn("outside", F.col("label") != F.coalesce("hub_label", "hub"))
    named = written(named.select("value", "cid", "n", "label", "outside", F.greatest(F.ceil(F.col("length") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "dedup-named")
    open_lists = small(named.where("outside").select("value").distinct())
    return named.join(open_lists, "value", "left_semi")


def block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of outsiders with members of other components, by exact counts in blocks.

    A list is cut into blocks of about BLOCK members, or fewer where their sets are large. Each pair of an outsider block and a
    member block is one group: common shingles are counted by a matrix product over the
    shingles that both sides have, and one link is given out for each pair of components.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        side, cid, label = (group[c].to_numpy() for c in ("side", "cid", "label"))
        found = _block_pairs(side, cid, label, [np.frombuffer(v, dtype=np.uint64) for v in group["values"].to_pylist()], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    own = F.pmod(F.hash("cid"), F.col("blocks"))
    seats = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rest.join(sets, "cid")
    x = rows.where("outside").select("value", own.alias("i"), F.explode(seats).alias("j"), F.lit(0).alias("side"), "cid", "label", "values")
    y = rows.select("value", F.explode(seats).alias("i"), own.alias("j"), F.lit(1).alias("side"), "cid", "label", "values")
    found = x.unionByName(y).groupBy("value", "i", "j").applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_pairs(side: np.ndarray, cid: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """One linked pair for each two components, side 0 against side 1."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    on_x = side[row] == 0
    n = int(column.max()) + 1
    shared = (np.bincount(column[on_x], minlength=n) > 0) & (np.bincount(column[~on_x], minlength=n) > 0)
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column, on_x = row[keep], number[column[keep]], on_x[keep]
    place = np.empty(len(sets), dtype=np.int64)
    place[xs], place[ys] = np.arange(len(xs)), np.arange(len(ys))
    common = np.zeros((len(xs), len(ys)), dtype=np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        width = min(COLUMNS, int(shared.sum()) - low)
        mx, my = np.zeros((len(xs), width), dtype=np.float32), np.zeros((len(ys), width), dtype=np.float32)
        mx[place[row[here & on_x]], column[here & on_x] - low] = 1
        my[place[row[here & ~on_x]], column[here & ~on_x] - low] = 1
        common += mx @ my.T
    both = sizes[xs][:, None] + sizes[ys][None, :]
    linked = (100 * common >= percent * (both - common)) & (label[xs][:, None] != label[ys][None, :])
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(linked)):
        out.setdefault((int(label[xs[i]]), int(label[ys[j]])), (int(cid[xs[i]]), int(cid[ys[j]])))
    return list(out.values())


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule the threshold out (six standard deviations below it)."""
    p = percent / 100
    floor = p - 6 * math.sqrt(p * (1 - p) / SKETCH)
    c = classes.select("cid", "n", "sketch")
    a = c.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = c.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b").where(_near_size("na", "nb", percent))
    joined = joined.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH))
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb"))
    return joined.where(shared >= F.lit(floor) * F.size("u")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets (cid, values) reach the threshold."""
    a = sets.select(F.col("cid").alias("a"), F.col("values").alias("va"))
    b = sets.select(F.col("cid").alias("b"), F.col("values").alias("vb"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb"), per_batch(run, 64), "a long, b long")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is stored and has at most BROADCAST_ROWS rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """cid, values for the classes in ``ids`` (cid), made again from one text of each; stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "values"])

    wanted = written(classes.select("cid", "key", "first_id").join(ids, "cid", "left_semi"), "dedup-wanted")
    d, w = docs.select("doc_id", "text").alias("d"), small(wanted.select("first_id").distinct()).alias("w")
    texts = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.first_id")), "left_semi").select("text")
    made = mapped(texts, per_batch(run, 128), "key binary, values binary")
    return written(made.join(small(wanted.select("key", "cid")), "key").select("cid", "values").dropDuplicates(["cid"]), "dedup-sets")


def components(edges: DataFrame) -> DataFrame:
    """cid, label for every class in ``edges`` (a, b): the smallest cid of its component."""
    both = written(edges.union(edges.select("b", "a")).toDF("cid", "other"), "dedup-edges")
    labels = written(both.groupBy("cid").agg(F.min("other").alias("label")).withColumn("label", F.least("cid", "label")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("cid").alias("other"), F.col("label").alias("near")), "other").groupBy("cid").agg(F.min("near").alias("near"))
        hop = labels.join(near, "cid").select("cid", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        # the label of a label: pointer jumping halves the distance to the smallest cid
        jump = hop.join(labels.select(F.col("cid").alias("mid"), F.col("label").alias("far")), "mid").select("cid", "old", F.least("mid", "far").alias("label"))
        jump = written(jump, "dedup-labels")
        if not jump.where("label <> old").limit(1).count():
            return jump.select("cid", "label")
        labels = jump.select("cid", "label")


def connected(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Labels by all links: those of short lists and of hubs, then of what the hubs have left open."""
    pairs = written(estimated(candidate_pairs(members, percent), classes, percent), "dedup-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    edges = written(verified(pairs, full_sets(docs, classes, ids, width), percent), "dedup-links")
    labels = components(edges)
    rest = unsettled(members, labels)
    if not rest.limit(1).count():
        return labels
    found = written(block_links(rest, full_sets(docs, classes, rest.select("cid").distinct(), width), percent), "dedup-links")
    return components(edges.union(found)) if found.limit(1).count() else labels


def marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, the key of its set and the label of its component."""
    features = written(featured(docs, width), "dedup-features")
    classes = features.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbers are given once, when the table is written, and read from it after that
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "dedup-classes")
    members = written(prefixes(classes, percent).select("*", F.explode("prefix").alias("value")), "dedup-lists")
    lists = members.groupBy("value").agg(F.count(F.lit(1)).alias("length"), F.sum("n").alias("shingles"), F.max(F.struct("centre", "cid")).alias("best")).where("length > 1")
    lists = written(lists.select("value", "length", "shingles", F.col("best.cid").alias("hub")), "dedup-heads")
    labels = connected(written(looked_up(members, lists, "length"), "dedup-placed"), classes, docs, width, percent)
    named = labels.join(classes.select("cid", "key", "first_id"), "cid")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = written(named.join(least, "label").select("key", "label", "component_id"), "dedup-components")
    ids = classes.select("key", "first_id", "cid").join(linked, "key", "left").select("key", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("label", "cid").alias("label"))
    out = features.select("doc_id", "n", "key").join(ids, "key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "label")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return marked(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keyed_rows(docs: DataFrame, width: int) -> DataFrame:
    """row (all columns), doc_id, text and the key of the set, which is null without shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], names=["doc_id", "text", "row", "key"])

    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kinds = dict(packed.dtypes)
    return mapped(packed, per_batch(run, 128), f"doc_id {kinds['doc_id']}, text string, row {kinds['row']}, key binary")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component; columns as they are.

    A doc_id of one row stands for its row. Rows whose doc_id is null or repeated are told
    apart by their sets, and of those of one set the least text stays. Rows without
    shingles all stay, but for repeats of both doc_id and text.
    """
    marks = written(marked(docs, width, percent), "dedup-marks")
    unsure = written(marks.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "dedup-unsure")
    some = unsure.limit(1).count() > 0
    gone = marks.where("not kept").select("doc_id").distinct()
    gone = small(written(gone.union(unsure).distinct() if some else gone, "dedup-gone"))
    d, g = docs.alias("d"), gone.alias("g")
    left = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")
    if not some:
        return left
    u = small(unsure).alias("u")
    m = marks.where("kept").alias("m").join(u, F.col("m.doc_id").eqNullSafe(F.col("u.doc_id")), "left_semi")
    # a component's kept rows have one doc_id; without shingles a row is its own component
    chosen = m.where("key is not null").groupBy("label").agg(F.first("doc_id").alias("doc_id"), F.min("key").alias("key")).select("doc_id", "key")
    chosen = small(written(chosen.union(m.where("key is null").select("doc_id", "key").distinct()), "dedup-chosen")).alias("c")
    rows = keyed_rows(d.join(u, F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")), "left_semi"), width).alias("r")
    rows = rows.join(chosen, F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("r.key").eqNullSafe(F.col("c.key")), "left_semi")
    same = F.when(F.col("key").isNull(), F.col("text")).alias("same")
    one = rows.groupBy("doc_id", "key", same).agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return left.unionByName(one.select("row.*"))
