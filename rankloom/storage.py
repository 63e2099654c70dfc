"""Where operators put tables that must outlive a lost executor.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir``,
which the driver and all executors share. Where that setting is missing a temporary folder
is used if the driver and the executors are one process, and refused otherwise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: What each stored table was made from, so that guards see through it.
made: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a single machine without the setting, one temporary folder per process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="rankloom-"))
    return _own[0]


_scratch: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/rankloom/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what must stay is written after that or before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def kept(spark: SparkSession, path: str, make) -> DataFrame:
    """The table that ``make()`` gives, written to ``path``; what was written on the way is removed."""
    with scratch(spark):
        return written(make(), "", path)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read again: later uses cost a scan, and lost tasks reread files."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    made[path] = df
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    made.pop(path, None)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most rows of a side that is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which is counted; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
