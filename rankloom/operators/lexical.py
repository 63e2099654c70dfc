"""Okapi BM25 over counts of queried terms, all queries at once.

Statistics come from the whole index; time masks apply to what is ranked, never to idf
or lengths. Up to a stated number of queries and terms every task knows them all: a card
keeps one row with its counts of queried terms, is scored against all queries where it
lies, and only the best cards of a task leave it. Beyond that number terms meet postings
in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators.ranking import PLACES
from rankloom.operators.vectors import micros

K1, B = 1.2, 0.75
#: Most terms, and pairs of a query and a term, that are sent to every task.
MOST_TERMS = 1_000_000
#: Pairs of a card's and a query's terms that are added up at once, and scores held for that.
AT_ONCE = 2_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term; a repeated token counts twice."""
    return queries.select("query_id", F.explode(tokens(F.col("qtext"))).alias("term"))


def tokenised(cards: DataFrame) -> DataFrame:
    w = cards.select("card_id", F.coalesce(tokens(F.col("txt")), F.array().cast("array<string>")).alias("w"))
    return w.select("card_id", "w", F.size("w").alias("dl"))


def statistics(cards: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl (1 if there are no tokens); tokens are counted without being made."""
    return totals(cards.select(F.coalesce(F.regexp_count(F.lower("txt"), F.lit("[a-z0-9]+")), F.lit(0)).alias("dl")))


def totals(lengths: DataFrame) -> DataFrame:
    """The same of rows that have dl."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1e-9)).alias("avgdl"))


def postings(toks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """card_id, dl, term, tf; limited to ``terms`` if given."""
    rows = toks.select("card_id", "dl", F.explode("w").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("card_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


#: For bytes of UTF-8: capitals of ASCII become small, all but a-z and 0-9 a blank.
_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: The two letters beyond ASCII whose small form has one of a-z: the Kelvin sign and I with a dot.
_FOLDED = ("\u212a".encode(), "\u0130".encode())


def index(cards: DataFrame, vocabulary: list[str]) -> DataFrame:
    """card_id, dl, at, tf: a row for each card with the places in ``vocabulary`` of its terms and how often it has them."""
    place = {w.encode(): i for i, w in enumerate(vocabulary)}
    words, folded, names = _WORDS, _FOLDED, ["card_id", "dl", "at", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl, ends, at, tf = [], [0], [], []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if any(c in raw for c in folded):
                    raw = raw.decode().lower().encode()
                n = Counter(raw.translate(words).split())
                dl.append(n.total())
                for w, k in n.items():
                    if (i := place.get(w)) is not None:
                        at.append(i)
                        tf.append(k)
                ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32()), *lists], names=names)

    return cards.select("card_id", "txt").mapInArrow(run, f"card_id {dict(cards.dtypes)['card_id']}, dl int, at array<int>, tf array<int>")


def frequencies(indexed: DataFrame, vocabulary: list[str]) -> DataFrame:
    """term, df of an ``index``; a task adds up its own cards first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(n))
        known = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([vocabulary[i] for i in known], pa.string()), pa.array(n[known])], names=["term", "n"])

    return indexed.select("at").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def best(indexed: DataFrame, vocabulary: list[str], queries: list[Row], terms: list[Row], idf: dict[str, float], avgdl: float, n: int, pool: bool) -> DataFrame:
    """query_id, card_id, score: for each query the n best of every task above 0, a superset of its n best.

    ``indexed`` is an ``index`` with committed_at and superseded_at, ``queries`` have
    query_id, as_of (in microseconds) and intent, ``terms`` query_id, term and n (how often a query has it).
    Ties go to the smaller card_id, so a cut does not depend on tasks.
    """
    kind = dict(indexed.dtypes)["card_id"]
    ids = [r.query_id for r in queries]
    named = "string" if isinstance(ids[0], str) else "bigint"
    as_of = np.array([r.as_of for r in queries], dtype=np.int64)
    now = np.array([r.intent == "current" for r in queries])
    weight = np.array([idf.get(w, 0.0) for w in vocabulary])
    # the queries of a term and how often each has it, one term after the other
    place, column = {w: i for i, w in enumerate(vocabulary)}, {q: j for j, q in enumerate(ids)}
    asked = sorted((place[r.term], column[r.query_id], r.n) for r in terms if r.term in place and r.query_id in column)
    holders = np.bincount([a for a, _, _ in asked], minlength=len(vocabulary))
    first = np.cumsum(holders) - holders
    query, often = np.array([j for _, j, _ in asked], dtype=np.int64), np.array([m for _, _, m in asked], dtype=np.float64)
    block = max(1, AT_ONCE // max(len(asked), len(ids), 1))
    names = ["query_id", "card_id", "score"]

    def scored(dl: np.ndarray, lists: pa.Array, counts: np.ndarray) -> np.ndarray:
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        term, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        part = weight[term] * counts * (K1 + 1) / (counts + K1 * ((1 - B) + B * dl[row] / avgdl))
        many = holders[term]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
        cell = np.repeat(row, many) * len(ids) + query[step]
        return np.bincount(cell, weights=np.repeat(part, many) * often[step], minlength=len(size) * len(ids)).reshape(len(size), len(ids))

    def cut(j: np.ndarray, card: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((card, -np.round(score, PLACES), j))
        j, card, score = j[order], card[order], score[order]
        nth = np.arange(len(j)) - np.searchsorted(j, j)
        return j[nth < n], card[nth < n], score[nth < n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, floor = [], np.zeros(len(ids))
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                card, dl, lists, tf, began, ended = batch.slice(low, block).columns
                card = card.to_numpy(zero_copy_only=False)
                scores = scored(dl.to_numpy(zero_copy_only=False), lists, tf.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                rounded = np.round(scores, PLACES)
                seen = (rounded > 0) & (rounded >= floor) & (began.to_numpy(zero_copy_only=False)[:, None] <= as_of)
                if pool:
                    seen &= (ended.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[:, None] > as_of) | ~now
                i, j = np.nonzero(seen)
                held.append((j, card[i], scores[i, j]))
                if sum(len(x[0]) for x in held) > max(AT_ONCE // 4, 2 * n * len(ids)):
                    held = [cut(*map(np.concatenate, zip(*held)))]
                    j, _, score = held[0]
                    full = np.bincount(j, minlength=len(ids)) == n
                    last = np.flatnonzero(np.append(j[1:] != j[:-1], True))  # the worst that a query keeps
                    floor[j[last]] = np.where(full[j[last]], np.round(score[last], PLACES), 0)
        if held:
            j, card, score = cut(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(j)), pa.array(card), pa.array(score)], names=names)

    rows = indexed.where("committed_at is not null").select("card_id", "dl", "at", "tf", micros("committed_at"), micros("superseded_at"))
    return rows.mapInArrow(run, f"query_id {named}, card_id {kind}, score double")


def _folded(raw: bytes) -> bytes:
    return (raw.decode().lower().encode() if any(c in raw for c in _FOLDED) else raw).translate(_WORDS)


def containing(cards: DataFrame, queries: list[Row]) -> DataFrame:
    """query_id, card_id where the card's text contains the query's (query_id, qtext), found in one pass over the texts.

    A word inside a query's text, with neighbours on both sides, is a word of every text that
    contains it; only texts that have the longest such word are searched for the whole.
    """
    named = "string" if queries and isinstance(queries[0].query_id, str) else "bigint"
    probes, always = {}, []
    for r in queries:
        if r.qtext is not None:
            low = _folded(r.qtext.encode())
            inner = low[len(low) - len(low.lstrip(_WORD_BYTES)) :].rstrip(_WORD_BYTES).split()
            (probes.setdefault(max(inner, key=len), []) if inner else always).append((r.query_id, r.qtext.encode()))
    words, folded = _WORDS, _FOLDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1)):
                if text.is_valid:
                    raw = text.as_buffer().to_pybytes()
                    low = raw.decode().lower().encode() if any(c in raw for c in folded) else raw
                    for w in [*(probes.keys() & set(low.translate(words).split())), None]:
                        for q, whole in always if w is None else probes[w]:
                            if whole in raw:
                                ids.append(q)
                                rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string() if named == "string" else pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["query_id", "card_id"])

    return cards.select("card_id", "txt").mapInArrow(run, f"query_id {named}, card_id {dict(cards.dtypes)['card_id']}")


def inverse_frequencies(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return inverse(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)


def inverse(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf of (term, df)."""
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select(  # one row
        "term", "df", F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )


def bm25(terms: DataFrame, posts: DataFrame, idf: DataFrame, stats: DataFrame, keep: Column | None = None) -> DataFrame:
    """query_id, card_id, score for every pair that shares a term; only pairs for which ``keep`` holds, on the columns of terms and posts."""
    hit = terms.join(posts, "term")
    if keep is not None:
        hit = hit.where(keep)
    hit = hit.join(idf.select("term", "idf"), "term").crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (F.lit(1 - B) + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "card_id").agg(F.round(F.sum(part), PLACES).alias("score"))


def feedback_terms(first: DataFrame, posts: DataFrame, idf: DataFrame, terms: DataFrame, docs: int = 5, n: int = 10) -> DataFrame:
    """The n terms of highest tf * idf in the best ``docs`` cards of each query, not in the query; ties by term."""
    from pyspark.sql import Window

    seen = first.where(F.col("rank") <= docs).select("query_id", "card_id")
    weights = seen.join(posts, "card_id").join(idf, "term").groupBy("query_id", "term").agg(F.round(F.sum(F.col("tf") * F.col("idf")), PLACES).alias("w"))
    fresh = weights.join(terms.distinct(), ["query_id", "term"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.col("w").desc(), "term")
    return fresh.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("query_id", "term")
