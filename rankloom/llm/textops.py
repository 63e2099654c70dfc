"""Small text helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words are runs of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: str) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` parts at exactly the six blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 2048) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that sees at most ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return run


#: Rows that Spark hands to Python at once. Long texts make rows large, so batches are small.
BATCH_ROWS = 512


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows, which bounds the memory of both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


_memo_owner: list = [None, None]


def sole_memo(owner: object, drop: Callable[[], None]) -> None:
    """Called by the owner of a memo before it is used: at most one memo lives in a Python worker.

    Workers outlive stages, so the memo of an earlier operator is dropped when the next one starts.
    """
    if _memo_owner[0] is not owner:
        if _memo_owner[1]:
            _memo_owner[1]()
        _memo_owner[:] = [owner, drop]
