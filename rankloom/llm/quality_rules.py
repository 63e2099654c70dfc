"""Quality rules with thresholds that follow the data.

No cutoff is a number given in advance: all come from mergeable quantile sketches of each
metric per language and source. A sketch is a set of log-linear buckets with counts (256
exact values, then 128 buckets for each doubling: a relative error below 1/128). Counts add
up, so sketches merge in any order and grouping, map-side too, and a hot source costs no
more than another.

A group's own sketch is merged with its language's, weighted as ``prior`` documents, and
the language's with that of all documents in the same way, so small groups lean on their
language and large ones on themselves, without a size at which the rule changes. With q25
and q75 of the blend::

    width = max(spread * (q75 - q25), |mean - median| of the language)
    low   = q25 - width
    high  = q75 + width          and for metrics in TAILED at least q99 + (q99 - q50)

The second term of the width matters where most values are equal. Repetition and capitals
occur in a few per cent of ordinary documents, so these cutoffs lie beyond the tail.
Multiplying a metric by a constant multiplies its cutoffs and changes no verdict. The
thresholds are then joined to the documents.

Metrics (integers): symbols, repeated words, capitals and repeated lines per 1000, and
characters per 100 words.

Defined cases: a null text has no words; documents without words or below the base rules
are out and take no part in the sketches; null languages and sources form groups of
their own; repeated rows are judged alike; texts of any length are counted whole, one
text at a time in memory; an empty table gives no rows; other columns pass through
``filter_documents`` untouched and are ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.storage import written
from rankloom.llm.textops import BLANKS, mapped, per_batch, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
METRICS = ("symbol_rate", "repeat_rate", "capital_rate", "line_rate", "word_length")
TAILED = ("repeat_rate", "capital_rate", "line_rate")
SPREAD = 3
#: Documents of the language that a group's sketch is merged with.
PRIOR = 100
#: A document's weight in whole numbers, so that merged weights stay exact.
UNIT = 1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Values below 2 to this power have buckets of their own.
EXACT_BITS = 8


def base_counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    tokens = words(text)
    n = len(tokens)
    if not n:
        return (0,) * len(COUNTS)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    capitals = int(np.count_nonzero((raw - np.uint8(65)) < 26))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), capitals


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    found = np.array([base_counts(t) for t in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
    keep = [i for i in range(batch.num_columns) if i != at]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in keep] + [pa.array(np.ascontiguousarray(found[:, j])) for j in range(len(COUNTS))],
        names=[batch.schema.names[i] for i in keep] + list(COUNTS),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS for every document, from whole texts."""
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return mapped(docs.select("doc_id", "lang", "source", "text"), per_batch(_counted, 128), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric_columns() -> list[Column]:
    return [
        F.expr("1000 * n_symbols div greatest(n_words, 1)").alias("symbol_rate"),
        F.expr("1000 * n_repeat_words div greatest(n_words, 1)").alias("repeat_rate"),
        F.expr("1000 * n_capitals div greatest(word_chars, 1)").alias("capital_rate"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1)").alias("line_rate"),
        F.expr("100 * word_chars div greatest(n_words, 1)").alias("word_length"),
    ]


def bucket_low(value: Column) -> Column:
    """The smallest value of the sketch bucket that holds ``value`` (a long, not negative)."""
    shift = F.greatest(F.length(F.bin(value)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the sketch of every group, as rows."""
    metrics = F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value")
    rows = measured.where(~base_failed()).select("lang", "source", metrics)
    return rows.groupBy("lang", "source", "metric", bucket_low(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of ``sketch`` added up for each group of ``by``, weights in units of a document."""
    return sketch.groupBy(*by, "metric", "bucket").agg((F.sum("n") * UNIT).alias("w"))


def blended(own: DataFrame, wide: DataFrame, on: list[str], prior: int = PRIOR) -> DataFrame:
    """``own`` merged with the sketch of the wider group that ``on`` names, which weighs ``prior`` documents.

    Windows run over the buckets of a sketch, a few hundred rows for any number of documents.
    """
    keys = [c for c in own.columns if c not in ("bucket", "w")]
    total = F.sum("w").over(Window.partitionBy(*on, "metric"))
    # weights count documents in units of 1e-6; a share is rounded down to a unit before it is multiplied
    share = wide.select(*on, "metric", "bucket", "w", total.alias("t"))
    lent = share.select(*on, "metric", "bucket", F.expr(f"w div (t div {UNIT}) * {prior}").alias("w"))
    groups, x = own.select(*keys).distinct().alias("g"), lent.alias("x")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"x.{c}")) for c in (*on, "metric")]
    more = groups.join(x, reduce(Column.__and__, same)).select("g.*", "x.bucket", "x.w")
    return own.select(*keys, "bucket", "w").unionByName(more).groupBy(*keys, "bucket").agg(F.sum("w").alias("w"))


def quantiles(cells: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Per group and metric the named quantiles (levels in per cent) and the mean, all whole numbers."""
    keys = [c for c in cells.columns if c not in ("bucket", "w")]
    group = Window.partitionBy(*keys)
    up_to = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("c", F.sum("w").over(up_to)).withColumn("total", F.sum("w").over(group))
    at = lambda q: F.min(F.when(F.col("c") >= F.expr(f"total div 100 * {q} + total % 100 * {q} div 100"), F.col("bucket")))
    mean = F.expr("cast(sum(cast(bucket as decimal(38, 0)) * w) div max(total) as bigint)").alias("mean")
    return cells.groupBy(*keys).agg(*[at(q).alias(name) for name, q in levels.items()], mean)


def thresholds(sketch: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """lang, source and a low and high cutoff for each metric: one row per group of the sketch.

    ``sketch`` is read several times and should be stored; the languages' is stored here, so
    that no plan holds the same steps again and again, which costs the driver memory.
    """
    every = merged(sketch, [])
    lang = written(blended(merged(sketch, ["lang"]), every, [], prior), "rules-lang")
    own = blended(merged(sketch, ["lang", "source"]), lang, ["lang"], prior)
    o = quantiles(own, {"q25": 25, "q50": 50, "q75": 75, "q99": 99}).alias("o")
    skew = quantiles(lang, {"q50": 50}).select("lang", "metric", F.abs(F.col("mean") - F.col("q50")).alias("skew")).alias("l")
    joined = o.join(skew, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric"))).select("o.*", "l.skew")
    width = F.greatest((F.col("q75") - F.col("q25")) * spread, F.col("skew"))
    tail = F.when(F.col("metric").isin(*TAILED), F.col("q99") * 2 - F.col("q50")).otherwise(F.col("q75"))
    cut = joined.select("lang", "source", "metric", (F.col("q25") - width).alias("low"), F.greatest(F.col("q75") + width, tail).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return cut.groupBy("lang", "source").agg(*[of(m, c) for m in METRICS for c in ("low", "high")])


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept, by the thresholds of each row's language and source."""
    m, t = measured.alias("m"), limits.alias("t")
    on = F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source"))
    inside = None
    for name in METRICS:
        ok = F.col(f"m.{name}").between(F.col(f"t.{name}_low"), F.col(f"t.{name}_high"))
        inside = ok if inside is None else inside & ok
    joined = m.join(t, on, "left").select("m.*", F.coalesce(inside, F.lit(True)).alias("inside"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("inside"))


def measured_limits(measured: DataFrame, **options) -> DataFrame:
    """The thresholds of stored ``measured``, stored like the sketch that they come from."""
    return written(thresholds(written(sketches(measured), "rules-sketch"), **options), "rules-limits")


def apply_rules(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, lang, source, COUNTS, metrics, base_failed, kept."""
    measured = written(with_counts(docs).select("*", *metric_columns()), "rules-counts")
    limits = measured_limits(measured, **options)
    return judged(measured, limits)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; texts are not shuffled unless the thresholds outgrow a broadcast."""
    measured = written(with_counts(docs).select("*", *metric_columns()), "rules-counts")
    limits = measured_limits(measured, **options)
    columns = [c for c in docs.columns]
    packed = docs.select("lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    schema = f"lang string, source string, row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = mapped(packed, per_batch(_counted, 128), schema).select("*", *metric_columns())
    return judged(counted, limits).where("kept").select("row.*")
