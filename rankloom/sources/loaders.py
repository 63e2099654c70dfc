"""Loaders for papers, citations and titles, with every dropped row counted by reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import clean_title

PAPER_SCHEMA = "id string, title string, abstract string, categories string, versions array<struct<version: string, created: string>>, _corrupt_record string"
MIN_ABSTRACT, MIN_TITLE = 200, 10


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of papers with ``reason``: null if the paper is usable, else why it is dropped."""
    p = spark.read.schema(PAPER_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    p = p.select("id", squeezed(F.col("title")).alias("title"), squeezed(F.col("abstract")).alias("abstract"), F.split("categories", " ")[0].alias("area"), "versions", "_corrupt_record")
    reason = (
        F.when(F.col("_corrupt_record").isNotNull() | F.col("id").isNull(), "unparseable")
        .when((F.length("abstract") < MIN_ABSTRACT) | (F.length("title") < MIN_TITLE), "too short")
        .when(F.coalesce(F.size("versions"), F.lit(0)) < 1, "no version")
        .when(F.coalesce("area", F.lit("")) == "", "no category")
    )
    return p.withColumn("reason", reason).drop("_corrupt_record")


def dropped(papers: DataFrame) -> DataFrame:
    return papers.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def paper_cards(papers: DataFrame) -> DataFrame:
    """One card per version: card_id, paper, version, committed_at, supersedes_id, title, txt.

    Dates are those of mail headers. A version of which the date cannot be read leaves.
    """
    v = papers.where("reason is null").select("id", "title", "abstract", F.explode("versions").alias("v"))
    at = F.try_to_timestamp(F.regexp_replace("v.created", "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    v = v.select(F.col("id").alias("paper"), F.regexp_extract("v.version", r"(\d+)", 1).cast("int").alias("version"), at.alias("committed_at"), "title", F.concat_ws("\n", "title", "abstract").alias("txt"))
    v = v.where("committed_at is not null and version is not null")
    name = lambda n: F.concat(F.col("paper"), F.lit("v"), n.cast("string"))
    from pyspark.sql import Window

    before = F.lag("version").over(Window.partitionBy("paper").orderBy("version"))
    return v.select(name(F.col("version")).alias("card_id"), "paper", "version", "committed_at", name(before).alias("supersedes_id"), "title", "txt")


def read_citations(spark: SparkSession, path: str, papers: DataFrame) -> DataFrame:
    """src, dst of tab-separated lines with both ends among ``papers`` (id), without loops and doubles."""
    c = spark.read.schema("src string, dst string").option("sep", "\t").csv(path).where("src <> dst").distinct()
    ids = papers.select("id")
    return c.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def first_by_title(rows: DataFrame, title: str, key: str) -> DataFrame:
    """title_key, the smallest key of a title and how many others share it."""
    t = rows.select(clean_title(F.col(title)).alias("title_key"), F.col(key).alias("key")).where("title_key <> ''")
    return t.groupBy("title_key").agg(F.min("key").alias("key"), (F.count(F.lit(1)) - 1).alias("collisions"))


def joined_by_title(left: DataFrame, right: DataFrame, left_title: str, left_key: str, right_title: str, right_key: str) -> DataFrame:
    """title_key, left_key, right_key of two sources on the normalised title, the first row of a title winning on either side."""
    a = first_by_title(left, left_title, left_key).select("title_key", F.col("key").alias("left_key"))
    b = first_by_title(right, right_title, right_key).select("title_key", F.col("key").alias("right_key"))
    return a.join(b, "title_key")
