"""Paired statistics: deltas, bootstrap, power, agreement and verdicts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import draw
from rankloom.storage import written

Z_ALPHA, Z_POWER = 1.959963985, 0.8416212336


def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """query_id, delta = b - a where both have a value."""
    x = a.select("query_id", F.col(value).alias("va")).where("va is not null")
    y = b.select("query_id", F.col(value).alias("vb")).where("vb is not null")
    return x.join(y, "query_id").select("query_id", (F.col("vb") - F.col("va")).alias("delta"))


def bootstrap(deltas: DataFrame, resamples: int = 2000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """label, mean, lo, hi from percentile bootstrap with a portable index: the i-th draw of resample r is row md5(seed:r:i) mod n.

    Resamples are generated rows; draws meet deltas by an equi-join on the position.
    """
    from pyspark.sql import Window

    deltas = written(deltas.select("label", "query_id", "delta"), "deltas")
    place = Window.partitionBy("label").orderBy("query_id")
    rows = deltas.select("label", "query_id", "delta").withColumn("i", F.row_number().over(place) - 1)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"))
    spark = deltas.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("r")).crossJoin(F.broadcast(sizes.select("label", "n")))  # labels are few
    draws = draws.select("label", "r", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("j"))
    at = draw(F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")) % F.col("n")
    means = draws.select("label", "r", at.cast("int").alias("i")).join(rows.select("label", "i", "delta"), ["label", "i"]).groupBy("label", "r").agg(F.round(F.avg("delta"), 9).alias("m"))
    limits = means.groupBy("label").agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
    defined = lambda c: F.when(F.col("n") >= 3, F.round(c, 6))
    return sizes.join(limits, "label").select("label", "n", F.round("mean", 6).alias("mean"), defined(F.col("lo")).alias("lo"), defined(F.col("hi")).alias("hi"))


def bootstrap_pcg64(deltas: DataFrame, resamples: int = 2000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """The same with numpy's generator, one group per label (a delta per query)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        d = g.sort_values("query_id")["delta"].to_numpy()
        if len(d) < 3:
            return pd.DataFrame({"label": g["label"].iloc[:1], "n": [len(d)], "mean": [d.mean()], "lo": [None], "hi": [None]})
        rng = np.random.default_rng(seed)
        means = d[rng.integers(0, len(d), size=(resamples, len(d)))].mean(axis=1)
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({"label": g["label"].iloc[:1], "n": [len(d)], "mean": [d.mean()], "lo": [lo], "hi": [hi]})

    return deltas.select("label", "query_id", "delta").groupBy("label").applyInPandas(run, "label string, n long, mean double, lo double, hi double")


def power(deltas: DataFrame, target: float = 0.02) -> DataFrame:
    """label, n, sd, the least detectable effect and the number of queries that the target effect needs."""
    z = Z_ALPHA + Z_POWER
    per = deltas.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("delta").alias("sd"))
    return per.select("label", "n", F.round("sd", 6).alias("sd"), F.round(z * F.col("sd") / F.sqrt("n"), 6).alias("mde"), F.ceil(F.round(F.pow(z * F.col("sd") / target, 2), 6)).alias("n_required"))


def mcnemar_counts(pairs: DataFrame) -> DataFrame:
    """label, only_a, only_b, stat (with continuity correction; null without discordant pairs) of boolean right_a and right_b."""
    per = pairs.groupBy("label").agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("only_a"), F.count_if(~F.col("right_a") & F.col("right_b")).alias("only_b"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return per.withColumn("stat", F.round(F.try_divide((F.greatest(d, F.lit(0)) * F.greatest(d, F.lit(0))).cast("double"), F.col("only_a") + F.col("only_b")), 6))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """``mcnemar_counts`` with p = erfc(sqrt(stat / 2)); one row per label."""

    @F.pandas_udf("double")
    def p(stat: pd.Series) -> pd.Series:
        return stat.map(lambda s: None if pd.isna(s) else math.erfc(math.sqrt(s / 2)))

    return mcnemar_counts(pairs).withColumn("p", p("stat"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of columns a and b over rows where both are known (null if chance agreement is 1)."""
    known = pairs.where("a is not null and b is not null")
    n = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"))
    pa, pb = known.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("ca")), known.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("cb"))
    chance = pa.join(pb, "v").agg(F.sum(F.col("ca") * F.col("cb")).alias("cross"))
    pe = F.coalesce("cross", F.lit(0)) / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).select("n", "agree", F.round(F.when(pe < 1, (F.col("agree") / F.col("n") - pe) / (1 - pe)), 6).alias("kappa"))


def kendall(rows: DataFrame) -> DataFrame:
    """label, concordant, discordant, tau of x and y over pairs of rows (key, x, y) of a label; ties do not count.

    The rows of a label are a bounded list of runs or slots, never documents.
    """
    a, b = rows.alias("a"), rows.alias("b")
    s = F.signum(F.col("a.x") - F.col("b.x")) * F.signum(F.col("a.y") - F.col("b.y"))
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.key") < F.col("b.key"))).select("a.label", s.alias("s"))
    out = pairs.groupBy("label").agg(F.count_if(F.col("s") > 0).alias("concordant"), F.count_if(F.col("s") < 0).alias("discordant"))
    return out.withColumn("tau", F.round(F.try_divide((F.col("concordant") - F.col("discordant")).cast("double"), F.col("concordant") + F.col("discordant")), 6))


def verdict(lo: Column, hi: Column, tolerance: float = 0.0) -> Column:
    """BETTER if the interval is above the tolerance, WORSE if below minus its size, else UNDERPOWERED; NO DATA without one."""
    return F.when(lo.isNull() | hi.isNull(), "NO DATA").when(lo > tolerance, "BETTER").when(hi < -abs(tolerance), "WORSE").otherwise("UNDERPOWERED")


def two_proportion_n(p1: Column, p2: Column) -> Column:
    return F.ceil(F.round(F.lit(7.85) * (p1 * (1 - p1) + p2 * (1 - p2)) / F.pow(p1 - p2, 2), 6))
