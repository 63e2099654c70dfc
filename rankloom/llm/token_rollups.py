"""Token counts as rollups that deltas maintain.

A rollup is a folder of committed batches. A batch is a table of signed changes: an
insert adds a document and its tokens, a delete takes both away, a revision changes the
tokens only. Each batch is summed to one row per source, language and tokenizer version
before anything is stored, so a hot source costs one row per map task. Totals are the sum
of all committed batches; nothing is ever counted again from the documents.

A batch is written to a folder of its own first. It is committed when a small mark file of
its id, which names that folder, has been created: creating a file that must not exist yet
is one step, so of several writers of one id one wins and the others are told so and
remove what they wrote. Replaying batches after a failure therefore changes nothing.
``compact`` folds the batches listed at its start into a snapshot, which holds their ids
beside their sums; a batch counts as applied if its id is among those or has a mark, so
batches may come in any order, before and after a compaction.

Tokens are counted by two public tokenizers, from whole texts: a BPE with word ends (as
the token store encodes) and a byte-level BPE.

Defined cases: null source or lang are groups of their own; a null count is 0; groups
without documents and tokens are not listed; rows are changes, so repeated rows count
each time; an empty batch is committed and changes nothing; other columns are ignored.
``counts`` gives a row for every document, whatever it holds: null and empty texts have 0
tokens, texts of any length are counted whole, one batch of 64 texts at a time. Of rows
with equal texts (null and empty are equal) those whose doc_id is above the smallest are
copies; a null doc_id is never a copy, repeats of the smallest doc_id are not either.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.storage import remove, small, written
from rankloom.llm.textops import mapped, per_batch
from rankloom.llm.token_store import library_encoder

GROUP = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"
#: Rows of one text above which its group is looked up without moving its rows.
HOT = 1000


def inserts(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def deletes(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return inserts(rows, version, tokens).select(*GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(rows: DataFrame, version: str, old: str, new: str) -> DataFrame:
    change = F.coalesce(new, F.lit(0)).cast("long") - F.coalesce(old, F.lit(0)).cast("long")
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(0).cast("long").alias("docs"), change.alias("tokens"))


def _ranges(ids: set[int]) -> list[list[int]]:
    """Sorted first and last numbers of runs of consecutive ids."""
    out: list[list[int]] = []
    for i in sorted(ids):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


class Rollup:
    """The batches in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for kind in ("batches", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.folder}/{kind}"))

    # ---- marks ------------------------------------------------------------------------

    def _marks(self, kind: str) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.folder}/{kind}")) if s.getPath().getName().isdigit())

    def _mark(self, kind: str, name: int, content: dict) -> bool:
        """Creates a mark; False if there is one. The content is written in the same call."""
        where, data = self._path(f"{self.folder}/{kind}/{name}"), json.dumps(content).encode()
        if self._fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            try:
                handle = os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            return True
        try:
            out = self._fs.create(where, False)
        except Exception:
            if self._fs.exists(where):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def _read(self, kind: str, name: int) -> dict:
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._path(f"{self.folder}/{kind}/{name}")), "UTF-8")
        return json.loads(lines)

    def _snapshot(self) -> tuple[int, dict]:
        last = max(self._marks("snapshots"), default=-1)
        return last, self._read("snapshots", last) if last >= 0 else {"ids": [], "data": None}

    # ---- batches ----------------------------------------------------------------------

    def committed(self) -> list[int]:
        """Ids of the batches that are not in the snapshot."""
        return self._open(self._snapshot()[1])

    def _open(self, snapshot: dict) -> list[int]:
        return [b for b in self._marks("batches") if not _inside(b, snapshot["ids"])]

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch once; False if it had been applied before or another writer was first."""
        if batch < 0:
            raise ValueError("batch ids are not negative")
        if _inside(batch, self._snapshot()[1]["ids"]) or self._fs.exists(self._path(f"{self.folder}/batches/{batch}")):
            return False
        return self._place("batches", batch, changes, {})

    def _summed(self, changes: DataFrame) -> DataFrame:
        sums = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def _place(self, kind: str, name: int, rows: DataFrame, content: dict) -> bool:
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        self._summed(rows).write.parquet(data)
        if self._mark(kind, name, content | {"data": data}):
            return True
        remove(self.spark, data)
        return False

    def _sum_of(self, snapshot: dict, batches: list[int]) -> DataFrame:
        paths = [self._read("batches", b)["data"] for b in batches] + ([snapshot["data"]] if snapshot["data"] else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self._summed(self.spark.read.schema(SCHEMA).parquet(*paths))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens."""
        _, snapshot = self._snapshot()
        return self._sum_of(snapshot, self._open(snapshot))

    def compact(self) -> bool:
        """One snapshot in place of the batches that are committed now; False if there were none or another compaction was first."""
        last, snapshot = self._snapshot()
        done = self._open(snapshot)
        if not done:
            return False
        ids = {i for first, end in snapshot["ids"] for i in range(first, end + 1)} | set(done)
        return self._place("snapshots", last + 1, self._sum_of(snapshot, done), {"ids": _ranges(ids)})


def _inside(batch: int, ranges: list[list[int]]) -> bool:
    return any(first <= batch <= last for first, last in ranges)


# ---- counts ---------------------------------------------------------------------------


@cache
def byte_encoder(path: str):
    """A byte-level BPE from a file of ranks, one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counts(docs: DataFrame, word_path: str, byte_path: str) -> DataFrame:
    """doc_id, source, lang, copy_of (digest of the text), word_tokens, byte_tokens: stored, so texts are read once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(3).to_pylist()
        _, words = library_encoder(word_path).encode(batch.column(3), None)
        encode = byte_encoder(byte_path).encode_ordinary
        plain = [len(encode(t)) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(words, pa.int64()), pa.array(plain, pa.int64())], names=names)

    names = ["doc_id", "source", "lang", "copy_of", "word_tokens", "byte_tokens"]
    rows = docs.select("doc_id", "source", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("copy_of"))
    return written(mapped(rows, per_batch(run, 256), f"doc_id {dict(docs.dtypes)['doc_id']}, source string, lang string, copy_of string, word_tokens long, byte_tokens long"), "token-counts")


def with_copies(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Stored ``rows`` of ``counts`` with ``copy``: whether a smaller doc_id has the same text; stored.

    Texts of more than ``hot`` rows are at most one in ``hot`` rows; while their table is
    small it is broadcast, so that the rows of a hot text stay where they are.
    """
    groups = written(rows.groupBy("copy_of").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copy-groups")
    often = small(groups.where(F.col("n") > hot).select("copy_of", "first"))
    near = rows.join(often, "copy_of", "left").withColumn("known", F.col("first").isNotNull())
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")
    columns = [c for c in rows.columns]
    rest = near.where("not known").drop("first", "known").join(groups.where(F.col("n") <= hot).select("copy_of", "first"), "copy_of", "left")
    return written(near.where("known").select(*columns, copy).unionByName(rest.select(*columns, copy)), "token-copies")
