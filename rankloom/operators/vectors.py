"""Nearest vectors by dot product: a matrix product for each batch of cards, masked by time, cut before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rankloom.operators.ranking import PLACES

#: Most queries whose vectors are sent to every task.
MOST_QUERIES = 20_000
#: Cards multiplied at once.
BLOCK = 4096


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


def best(cards: DataFrame, queries: list[Row], n: int, pool: bool) -> DataFrame:
    """query_id, card_id, score: for each query the n best of every batch, a superset of its n best.

    ``cards`` have card_id, embedding, committed_at and superseded_at, ``queries`` query_id,
    qv, as_of and intent. Ties go to the smaller card_id, so a cut does not depend on batches.
    """
    kinds = dict(cards.dtypes)
    session = cards.sparkSession
    times = session.createDataFrame([(r.query_id, r.as_of) for r in queries], "q string, t timestamp_ntz" if isinstance(queries[0].query_id, str) else "q long, t timestamp_ntz")
    at = {r.q: r.t for r in times.select("q", micros("t")).collect()}
    ids = [r.query_id for r in queries]
    q = np.array([r.qv for r in queries], dtype=np.float64)
    as_of = np.array([at[i] for i in ids], dtype=np.int64)
    now = np.array([r.intent == "current" for r in queries])
    names = ["query_id", "card_id", "score"]

    def block(card: pa.Array, emb: pa.Array, began: np.ndarray, ended: np.ndarray) -> pa.RecordBatch:
        e = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(card), -1)
        scores = e @ q.T
        seen = began[:, None] <= as_of[None, :]
        if pool:
            seen &= (ended[:, None] > as_of[None, :]) | ~now[None, :]
        scores[~seen] = -np.inf
        rounded = np.round(scores, PLACES)
        rows, cols = [], []
        place = np.argsort(np.argsort(card.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        for j in range(len(ids)):
            known = np.flatnonzero(seen[:, j])
            if len(known) > n:
                edge = -np.partition(-rounded[known, j], n - 1)[n - 1]
                known = known[rounded[known, j] >= edge]
                known = known[np.lexsort((place[known], -rounded[known, j]))[:n]]
            rows.append(known)
            cols.append(np.full(len(known), j))
        at_row, at_col = np.concatenate(rows), np.concatenate(cols)
        query = pa.array(ids).take(pa.array(at_col))
        return pa.RecordBatch.from_arrays([query, card.take(pa.array(at_row)), pa.array(scores[at_row, at_col])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                card, emb, began, ended = part.columns
                ended = ended.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                yield block(card, emb, began.to_numpy(zero_copy_only=False), ended)

    kind = "string" if isinstance(ids[0], str) else "bigint"
    rows = cards.where("embedding is not null and committed_at is not null").select("card_id", "embedding", micros("committed_at"), micros("superseded_at"))
    return rows.mapInArrow(run, f"query_id {kind}, card_id {kinds['card_id']}, score double")
