"""A simulated judge with known biases, duels in both orders, and its noise floor.

The judge prefers the list with the better graded gain (as a share of the best possible),
always a little the list that it is shown first, a little the longer one, and adds noise
that depends on the question and both lists in their order. Small margins are ties. It is
there to test the machinery that measures bias; any other judge can be put in its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import draw

#: Fixed values of the simulated judge.
GAIN, FIRST, LENGTH, NOISE, TIE = 4.0, 0.10, 0.06, 0.30, 0.08
#: Cards of a list that a judge is shown.
SHOWN = 5

#: A judge: (pairs, side shown first, side shown second, salt) -> "A", "B", "TIE" or null for no answer.
#: ``pairs`` has query_id and for the sides x and y: _gain, _length, _ids; and best (gains of the ideal list).
Judge = Callable[[DataFrame, str, str, str], Column]


def verdict(m: Column) -> Column:
    return F.when(F.abs(m) < TIE, "TIE").when(m > 0, "A").otherwise("B")


def lists(rankings: DataFrame, labels: DataFrame, k: int = SHOWN) -> DataFrame:
    """run, query_id, gain, length and ids (joined by |) of the first k."""
    r = rankings.where(F.col("rank") <= k).join(labels.select("query_id", "card_id", "grade"), ["query_id", "card_id"], "left")
    gain = F.sum(F.coalesce("grade", F.lit(0.0)) / F.log2(F.col("rank") + 1))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("card_id").cast("string").alias("c")))), lambda x: x["c"]), "|")
    return r.groupBy("run", "query_id").agg(F.round(gain, 9).alias("gain"), F.count(F.lit(1)).alias("length"), ids.alias("ids"))


def paired_lists(per: DataFrame, labels: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Both lists of every labelled query, empty where a run has none, and the grades of its labels, the best first."""
    def side(run: str, s: str) -> DataFrame:
        return per.where(F.col("run") == run).select("query_id", *[F.col(f).alias(f"{s}_{f}") for f in ("gain", "length", "ids")])

    grades = labels.groupBy("query_id").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("grades"))
    joined = grades.join(side(run_a, "x"), "query_id", "left").join(side(run_b, "y"), "query_id", "left")
    filled = [F.coalesce(f"{s}_{f}", F.lit(empty)).alias(f"{s}_{f}") for s in "xy" for f, empty in (("gain", 0.0), ("length", 0), ("ids", ""))]
    shown = F.greatest("x_length", "y_length", F.lit(1)).cast("int")
    ideal = F.aggregate(F.transform(F.slice("grades", F.lit(1), shown), lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda a, g: a + g)
    out = joined.select("query_id", "grades", *filled)
    return out.select("*", F.round(ideal, 9).alias("ideal")).select("*", F.when(F.col("ideal") == 0, 1.0).otherwise(F.col("ideal")).alias("best"))


def simulated(pairs: DataFrame, first: str, second: str, salt: str = "") -> Column:
    """The simulated judge's answer when ``first`` is shown first; A is what is shown first."""
    c = lambda s, f: F.col(f"{s}_{f}")
    parts = [F.col("query_id").cast("string"), c(first, "ids"), F.lit("#"), c(second, "ids")]
    noise = draw(*parts, *([F.lit(salt)] if salt else [])) / F.lit(4294967296.0) - 0.5
    longer = (c(first, "length") - c(second, "length")) / F.greatest(c(first, "length"), c(second, "length"), F.lit(1))
    return verdict(GAIN * (c(first, "gain") - c(second, "gain")) / F.col("best") + FIRST + LENGTH * longer + NOISE * noise)


def duel(pairs: DataFrame, judge: Judge = simulated) -> DataFrame:
    """query_id, forward, backward (in the forward's terms), verdict, inconsistent.

    A tie and inconsistent if the orders disagree; no verdict (null) if the judge gave none in either order.
    """
    back = judge(pairs, "y", "x", "")
    d = pairs.select("query_id", judge(pairs, "x", "y", "").alias("forward"), F.when(back == "A", "B").when(back == "B", "A").otherwise(back).alias("backward"))
    same = F.col("forward") == F.col("backward")
    return d.select("*", F.when(same, F.col("forward")).when(~same, "TIE").alias("verdict"), F.coalesce(~same, F.lit(False)).alias("inconsistent"))


def noise_floor(pairs: DataFrame, judge: Judge = simulated) -> DataFrame:
    """How often the same question in the same order gets another answer."""
    d = pairs.select((judge(pairs, "x", "y", "1") != judge(pairs, "x", "y", "2")).alias("flip"))
    return d.agg(F.count("flip").alias("asked"), F.count_if("flip").alias("flips"))


def prompt(query: Column, a: Column, b: Column) -> Column:
    """The question to a language model as text: the query and both lists (arrays of card texts), numbered."""
    def shown(cards: Column) -> Column:
        return F.array_join(F.transform(cards, lambda text, i: F.concat((i + 1).cast("string"), F.lit(". "), text)), "\n")

    return F.concat(
        F.lit("Which list answers the question better? Reply with A, B or TIE.\n\nQuestion: "), query, F.lit("\n\nList A\n"), shown(a), F.lit("\n\nList B\n"), shown(b)
    )
