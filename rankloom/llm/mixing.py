"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a share of a word budget in proportion to its weight. A source never
gives more than ``max_epochs`` times its own words: it is clamped there and what it
cannot give is shared again by weight among the others, until no target is above its
clamp (capped water-filling). The fixed point is found in closed form: with sources
ordered by clamp / weight, the water level after clamping the first i sources is
(budget - clamps so far) / (weights left), and the first source that fits below its
level fixes the level of all that follow.

A target of r times the source's words takes every document floor(r) whole times and a
seeded part of the documents once more: documents in the order of a seeded hash until
the fraction is filled. The order is never sorted as a whole: hash buckets are summed
first, and only the one bucket per source in which the fraction ends is ordered, one row
for each distinct key. Where the fraction ends among rows of one key (repeated rows), as
many of them as fit are taken: those rows are stored, numbered by file and row, and the
same two steps (sums of hash buckets, then one bucket) find which.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, last in order; repeated rows count as documents of their own, each with
a decision of its own; texts of any length are counted whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.storage import written
from rankloom.llm.textops import WORD_PATTERN

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 20240901
#: Hexadecimal digits of the seeded hash that name a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for ``sizes`` (source, source_size), one row per source.

    The windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    levelled = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)).withColumn("k", F.row_number().over(fill))
    free = F.col("cap") > F.col("level") * F.col("w")
    fixed = F.min(F.when(free, F.struct("k", "level"))).over(everything)["level"]
    target = F.when(fixed.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), fixed * F.col("w")))
    return levelled.select("source", "source_size", target.alias("target"))


def hash_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_cuts(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut (struct of h and size), part, fit.

    ``docs`` has doc_id, source and size and should be stored, as it is read twice. A
    document is taken ``whole`` times, and once more if its (h, size) is not above ``cut``.
    With ``part`` only ``fit`` of the rows whose key is ``cut`` are. The sums of the buckets
    and the bucket of each source are stored: inside one plan they would be planned for each use.
    """
    docs = docs.select("source", "size", hash_key(F.col("doc_id"), seed).alias("h")).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    cells = written(docs.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", epochs).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("base", F.coalesce(F.sum("cell_size").over(by_bucket), F.lit(0))).alias("c")
    t = targets.alias("t")
    based = based.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.source_size", "t.target", "t.whole", "t.need")
    ends = based.where((F.col("base") >= F.col("need")) | (F.col("base") + F.col("cell_size") > F.col("need")))
    edge = ends.groupBy("source", "source_size", "target", "whole", "need").agg(F.min(F.struct("bucket", "base")).alias("edge"))
    edge = written(edge.select("source", "source_size", "target", "whole", "need", "edge.bucket", "edge.base"), "mix-edge").alias("e")
    d = docs.alias("d")
    inside = d.join(edge, (F.col("d.bucket") == F.col("e.bucket")) & F.col("d.source").eqNullSafe(F.col("e.source"))).select("d.source", "d.size", "d.h", "e.base", "e.need")
    keys = inside.groupBy("source", "h", "size", "base", "need").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("ahead", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    # of equal rows those are taken whose middle lies before the end of the fraction
    fit = F.floor((F.col("need") - F.col("ahead") - F.col("size") / 2) / F.col("size")) + 1
    fit = F.when(F.col("size") == 0, F.when(F.col("ahead") <= F.col("need"), F.col("copies")).otherwise(F.lit(0))).otherwise(F.least(F.col("copies"), F.greatest(fit, F.lit(0))))
    keys = keys.withColumn("fit", fit.cast("long")).where("fit > 0")
    last = keys.groupBy("source").agg(F.max(F.struct("h", "size", "copies", "fit")).alias("l")).alias("l")
    none = F.struct(F.col("e.bucket").alias("h"), F.lit(-1).cast("long").alias("size"))
    cut = F.when(F.col("l.l").isNull(), none).otherwise(F.struct(F.col("l.l.h").alias("h"), F.col("l.l.size").alias("size")))
    return edge.join(last, F.col("e.source").eqNullSafe(F.col("l.source")), "left").select(
        "e.source", "e.source_size", "e.target", "e.whole", cut.alias("cut"), F.coalesce(F.col("l.l.copies") > F.col("l.l.fit"), F.lit(False)).alias("part"), F.coalesce("l.l.fit", F.lit(0)).alias("fit")
    )


def repeats(doc_id: Column, size: Column, whole: Column, cut: Column, seed: int = SEED) -> Column:
    extra = F.struct(hash_key(doc_id, seed).alias("h"), size.alias("size")) <= cut
    return whole + extra.cast("long")


def at_cut(doc_id: Column, size: Column, cut: Column, part: Column, seed: int = SEED) -> Column:
    """Whether a row has the key among whose rows the fraction of its source ends."""
    return part & (F.struct(hash_key(doc_id, seed).alias("h"), size.alias("size")) == cut)


def numbered_part(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` (s_source, fit, whole and others) with the column times: ``fit`` of each source's are taken once more.

    Rows are told apart by file and place in the file. A source's rows are counted in
    hash buckets first, and only the bucket in which the number ends is ordered.
    """
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    rows = rows.select("*", F.md5(place).alias("place")).withColumn("cell", F.substring("place", 1, BUCKET_DIGITS))
    cells = rows.groupBy("s_source", "fit", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = cells.where((F.col("base") < F.col("fit")) & (F.col("base") + F.col("n") >= F.col("fit"))).select("s_source", "cell", (F.col("fit") - F.col("base")).alias("room")).alias("e")
    inside = rows.alias("r").join(edge, F.col("r.s_source").eqNullSafe(F.col("e.s_source")) & (F.col("r.cell") == F.col("e.cell"))).select("r.s_source", "r.place", "e.room")
    nth = F.row_number().over(Window.partitionBy("s_source").orderBy("place"))
    ends = inside.withColumn("nth", nth).where("nth = room").select("s_source", F.col("place").alias("end")).alias("e")
    joined = rows.alias("r").join(ends, F.col("r.s_source").eqNullSafe(F.col("e.s_source")), "left")
    return joined.select("r.*", (F.col("r.whole") + F.coalesce(F.col("r.place") <= F.col("e.end"), F.lit(False)).cast("long")).alias("times")).drop("place", "cell")


def with_times(docs: DataFrame, size: Column, cuts: DataFrame, seed: int) -> DataFrame:
    """row (all columns of ``docs``), source_size, target, times. Rows at a partly taken key are stored and numbered."""
    d, c = docs.alias("d"), cuts.alias("s")
    joined = d.join(c, F.col("d.source").eqNullSafe(F.col("s.source")))
    parted = cuts.where("part").limit(1).count() > 0
    tied = at_cut(F.col("d.doc_id"), size, F.col("s.cut"), F.col("s.part"), seed)
    sure = joined.where(~tied) if parted else joined
    out = sure.select(F.struct("d.*").alias("row"), "s.source_size", "s.target", repeats(F.col("d.doc_id"), size, F.col("s.whole"), F.col("s.cut"), seed).alias("times"))
    if not parted:
        return out
    rows = written(joined.where(tied).select(F.struct("d.*").alias("row"), "s.source_size", "s.target", F.col("s.source").alias("s_source"), "s.whole", "s.fit"), "mix-tied")
    return out.unionByName(numbered_part(rows).select("row", "source_size", "target", "times"))


def mix_plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, repeats. ``docs`` has doc_id, source, size.

    The join carries one row per source. That table is stored first, so that Spark knows
    its size: it is broadcast while small, and beyond that a hot source is split.
    """
    narrow_docs = docs.select("doc_id", "source", "size")
    cuts = written(source_cuts(narrow_docs, seed=seed, **options), "mix-cuts")
    timed = with_times(narrow_docs, F.col("d.size"), cuts, seed)
    return timed.select("row.doc_id", "row.source", "row.size", "source_size", "target", F.col("times").alias("repeats"))


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of ``docs``, stored: texts are counted once and never shuffled."""
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns) with every row repeated as the mix takes it.

    Rows whose repeat count is 0 leave; the columns are those of ``docs``.
    """
    cuts = written(source_cuts(narrow(docs), seed=seed, **options), "mix-cuts")
    timed = with_times(docs, word_count(F.col("d.text")), cuts, seed).where("times > 0")
    return timed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
