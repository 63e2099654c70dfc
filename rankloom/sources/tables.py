"""A folder of tables that jobs load, update and replace, with reads that never see half a change.

Every write makes a new version of the tables it touches, in folders of its own; what the
tables consist of is named in one small manifest, which takes its place by one rename. A
job that fails leaves the manifest as it was, so several tables change together or not at
all, and readers that have begun keep the files they know.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that an extractor writes for its source, with the columns beside ``source``.
EXTRACTED = {
    "extracted_cards": ("card_id",),
    "entities": ("entity_id", "name", "kind"),
    "mentions": ("card_id", "entity_id", "surface", "role"),
    "facts": ("card_id", "subj", "rel", "obj", "value", "valid_from", "valid_until"),
    "onto_classes": ("class", "parent"),
}


class Tables:
    """Tables below one folder. A table is a list of parts, each for one value of its replace key or for all rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifest -----------------------------------------------------------------------

    def _manifest(self) -> dict[str, dict[str, str]]:
        """table -> key -> folder."""
        where = self._path(f"{self.folder}/manifest.json")
        if not self._fs.exists(where):
            return {}
        return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(where), "UTF-8"))

    def _publish(self, manifest: dict) -> None:
        aside = self._path(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(aside, self._path(f"{self.folder}/manifest.json"), options)

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    # ---- reads and writes ---------------------------------------------------------------

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self._manifest()[name].values())

    def load(self, **frames: DataFrame) -> None:
        """Replaces whole tables, all of them at once: a bulk load."""
        made = {name: {"": self._write(name, df)} for name, df in frames.items()}
        self._publish(self._manifest() | made)

    def update(self, name: str, news: DataFrame, key: str, column: str) -> None:
        """Sets ``column`` of the rows whose ``key`` is in ``news``; other rows keep theirs."""
        old = self.read(name)
        joined = old.join(news.select(key, F.col(column).alias("__new")), key, "left")
        self.load(**{name: joined.select(*[F.coalesce("__new", column).alias(column) if c == column else F.col(c) for c in old.columns])})

    def set_flag(self, name: str, key: str, column: str, flags: DataFrame) -> None:
        """Recomputes ``column`` of all rows from ``flags`` (key, column): null where they have none."""
        old = self.read(name).drop(column)
        self.load(**{name: old.join(flags.select(key, column), key, "left")})

    def replace(self, part: str, **frames: DataFrame) -> None:
        """Replaces one part of each table (the rows of one source or provenance) at once; an empty frame empties it."""
        manifest = self._manifest()
        made = {name: manifest.get(name, {}) | {part: self._write(name, df)} for name, df in frames.items()}
        self._publish(manifest | made)

    def write_back(self, source: str, **frames: DataFrame) -> None:
        """Replaces all that an extractor wrote before, in all tables of EXTRACTED; those not given are emptied."""
        rows = {}
        for name, columns in EXTRACTED.items():
            df = frames.get(name)
            if df is None:
                df = self.spark.createDataFrame([], ", ".join(f"{c} {'timestamp_ntz' if c.startswith('valid') else 'string'}" for c in columns))
            rows[name] = df.select(*columns, F.lit(source).alias("source"))
        self.replace(source, **rows)
