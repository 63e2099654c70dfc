"""A synthetic record with planted truth: cards in version chains, recorded links and queries.

Everything is drawn from a seeded hash of its own position, so any part of a corpus of any
size is made on any executor without a stream of random numbers. The true support of a
card is kept in frames named ``true_*``, which the guards keep away from retrieval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import draw

#: Syllables of invented words.
ONSETS = ["ba", "de", "ki", "lo", "mu", "na", "po", "ra", "se", "ti", "vo", "zu"]
MIDDLES = ["lar", "men", "nis", "rok", "sul", "tav", "vel", "zin"]
ENDS = ["a", "en", "ik", "or", "us", "yl"]
TOPIC_TERMS, SHARED_TERMS = 26, 4


def word(n: Column) -> Column:
    """The n-th invented word of three syllables; all of the first 576 are distinct."""
    pick = lambda parts, k: F.element_at(F.array(*map(F.lit, parts)), (k % len(parts) + 1).cast("int"))
    return F.concat(pick(ONSETS, n), pick(MIDDLES, F.floor(n / len(ONSETS))), pick(ENDS, F.floor(n / (len(ONSETS) * len(MIDDLES)))))


def unit(*parts: Column) -> Column:
    return draw(*parts) / F.lit(4294967296.0)


def cards(spark: SparkSession, n_cards: int, n_lines: int, seed: int = 20260909, words: int = 40) -> DataFrame:
    """card_id, line, topic, version, committed_at, supersedes_id, txt.

    Card i stands on line i mod n_lines; with chance 0.3 it supersedes the card before it on
    its line. Its words come from its topic's terms, some of which the next topic shares.
    """
    key = lambda *p: (F.lit(str(seed)), F.col("card_id").cast("string"), *map(F.lit, p))
    c = spark.range(n_cards).select(F.col("id").alias("card_id"), (F.col("id") % n_lines).alias("line"))
    c = c.withColumn("topic", F.col("line") % F.lit(max(1, n_lines // 4)))
    c = c.withColumn("revises", (unit(*key("revise")) < 0.3) & (F.col("card_id") >= n_lines))
    c = c.withColumn("committed_at", F.expr("timestampadd(HOUR, card_id * 3, timestamp_ntz'2025-01-01 00:00:00')"))
    numbers = F.transform(
        F.sequence(F.lit(1), F.lit(words)),
        lambda k: F.col("topic") * (TOPIC_TERMS - SHARED_TERMS) + draw(F.lit(str(seed)), F.col("card_id").cast("string"), k.cast("string")) % TOPIC_TERMS,
    )
    txt = F.array_join(F.transform(numbers, word), " ")
    return c.select("card_id", "line", "topic", "committed_at", F.when(F.col("revises"), F.col("card_id") - n_lines).alias("supersedes_id"), txt.alias("txt"))


def true_support(corpus: DataFrame, n_lines: int, seed: int = 20260909) -> DataFrame:
    """src, dst: a card rests on one or two earlier cards, mostly of its own line."""
    key = lambda *p: (F.lit(str(seed)), F.col("card_id").cast("string"), *map(F.lit, p))
    back = lambda k: F.when(unit(*key(k, "cross")) < 0.12, F.floor(unit(*key(k, "at")) * F.col("card_id"))).otherwise(F.col("card_id") - n_lines * (1 + draw(*key(k, "step")) % 3))
    both = F.array(back("1"), F.when(unit(*key("two")) < 0.5, back("2")))
    s = corpus.select(F.col("card_id").alias("src"), F.explode(both).alias("dst"))
    return s.where("dst is not null and dst >= 0 and dst < src").distinct()


def recorded_edges(support: DataFrame, corpus: DataFrame, seed: int = 20260909) -> DataFrame:
    """src, dst, kind, valid_from: what of the support is written down (60 in 100, as parent or citation), and 8 in 100 spurious links."""
    at = corpus.select(F.col("card_id").alias("src"), F.col("committed_at").alias("valid_from"))
    key = lambda *p: (F.lit(str(seed)), F.col("src").cast("string"), F.col("dst").cast("string"), *map(F.lit, p))
    kept = support.where(unit(*key("kept")) < 0.6).withColumn("kind", F.when(unit(*key("kind")) < 0.78, "parent").otherwise("citation"))
    stray = support.where(unit(*key("stray")) < 0.08).select("src", F.floor(F.col("dst") * unit(*key("to"))).alias("dst"), F.lit("citation").alias("kind"))
    return kept.unionByName(stray.where("dst < src")).dropDuplicates(["src", "dst", "kind"]).join(at, "src").select("src", "dst", "kind", "valid_from")


def planted_queries(corpus: DataFrame, support: DataFrame, share: float = 0.1, seed: int = 20260909) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, qtext, as_of, intent) from a share of the cards, and labels: support 2.0, what that rests on 1.0."""
    chosen = corpus.where(unit(F.lit(str(seed)), F.lit("query"), F.col("card_id").cast("string")) < share)
    text = F.array_join(F.slice(F.array_distinct(F.split("txt", " ")), 1, 8), " ")
    q = chosen.select(F.col("card_id").alias("query_id"), text.alias("qtext"), F.col("committed_at").alias("as_of"), F.lit("current").alias("intent"))
    one = support.join(q.select(F.col("query_id").alias("src")), "src", "left_semi").select(F.col("src").alias("query_id"), F.col("dst").alias("card_id"), F.lit(2.0).alias("grade"))
    two = one.join(support.select(F.col("src").alias("card_id"), F.col("dst").alias("far")), "card_id").select("query_id", F.col("far").alias("card_id"), F.lit(1.0).alias("grade"))
    return q, one.union(two).groupBy("query_id", "card_id").agg(F.max("grade").alias("grade"))


def paraphrased(terms: Column, key: Column, seed: int) -> Column:
    """An array of terms in other words, joined by blanks: 62 in 100 stay, 24 lose their ends, the others become other words."""
    def said(t: Column, i: Column) -> Column:
        u = unit(F.lit(str(seed)), key.cast("string"), i.cast("string"))
        short = F.substring(t, F.lit(1), F.greatest(F.lit(5), F.length(t) - 2))
        return F.when(u < 0.62, t).when(u < 0.86, short).otherwise(F.substring(F.reverse(t), 1, 6))

    return F.array_join(F.transform(terms, said), " ")


# ---- planted entities ------------------------------------------------------------------

#: Classes of the entities of a topic, in turn, with their parents; and the endings of dataset names.
PLANTED_KINDS = [("KernelMethod", "Method"), ("SamplingMethod", "Method"), ("Benchmark", "Dataset"), ("Corpus", "Dataset")]
ENDINGS = {"Benchmark": "-QA", "Corpus": "-Text"}


def true_entities(spark: SparkSession, n_topics: int, seed: int = 20260909) -> DataFrame:
    """entity_id, name, kind, parent_kind, topic: two methods and two datasets for every topic, with invented names."""
    e = spark.range(n_topics * len(PLANTED_KINDS)).select(F.col("id").alias("n"), F.floor(F.col("id") / len(PLANTED_KINDS)).alias("topic"))
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in PLANTED_KINDS]), (F.col("n") % len(PLANTED_KINDS) + 1).cast("int"))
    e = e.select("*", pick(0).alias("kind"), pick(1).alias("parent_kind"))
    number = (F.col("n") + 11).cast("string")
    ending = F.when(F.col("parent_kind") == "Method", F.concat(F.lit("-"), number)).when(F.col("kind") == "Benchmark", ENDINGS["Benchmark"]).otherwise(ENDINGS["Corpus"])
    # a topic's number among the syllables keeps names apart
    return e.select(F.concat(F.lit("t"), F.col("n").cast("string")).alias("entity_id"), F.concat(F.initcap(word(F.col("n") * 7 + seed % 500)), ending).alias("name"), "kind", "parent_kind", "topic")


def true_mentions(corpus: DataFrame, entities: DataFrame, share: float = 0.6, seed: int = 20260909) -> DataFrame:
    """card_id, entity_id, surface, role: a share of the cards speak of one method and one dataset of their topic.

    The first card that speaks of an entity introduces it, later ones use, study or only
    mention it; every third writes a method's name with a blank.
    """
    key = lambda *p: (F.lit(str(seed)), F.col("card_id").cast("string"), *map(F.lit, p))
    speak = corpus.where(unit(*key("speaks")) < share).select("card_id", "topic", (draw(*key("which")) % 2).alias("m"), (draw(*key("data")) % 2).alias("d"))
    turn = F.row_number().over(Window.partitionBy("topic", "parent_kind").orderBy("entity_id")) - 1
    e = entities.withColumn("turn", turn)
    both = speak.join(e, "topic").where(F.when(F.col("parent_kind") == "Method", F.col("turn") == F.col("m")).otherwise(F.col("turn") == F.col("d")))
    first = both.groupBy("entity_id").agg(F.min("card_id").alias("first"))
    u = unit(*key("role"))
    role = F.when(F.col("card_id") == F.col("first"), "introduces").when(u < 0.5, "uses").when(u < 0.7, "studies").otherwise("mentions")
    surface = F.when((F.col("parent_kind") == "Method") & (F.col("card_id") % 3 == 0), F.replace("name", F.lit("-"), F.lit(" "))).otherwise(F.col("name"))
    return both.join(first, "entity_id").select("card_id", "entity_id", surface.alias("surface"), role.alias("role"))


def true_facts(mentions: DataFrame, entities: DataFrame, seed: int = 20260909) -> DataFrame:
    """card_id, subj, rel, obj, value: a card's method is evaluated on its dataset, and half of such cards report a value."""
    named = mentions.join(entities.select("entity_id", "parent_kind"), "entity_id")
    m = named.where("parent_kind = 'Method'").select("card_id", F.col("entity_id").alias("subj"))
    d = named.where("parent_kind = 'Dataset'").select("card_id", F.col("entity_id").alias("obj"))
    pairs = m.join(d, "card_id")
    k = draw(F.lit(str(seed)), F.col("card_id").cast("string"), F.lit("value"))
    reports = pairs.where(k % 2 == 0).select("card_id", "subj", F.lit("reports").alias("rel"), "obj", F.format_string("0.%02d", 40 + k % 55).alias("value"))
    return pairs.select("card_id", "subj", F.lit("evaluated_on").alias("rel"), "obj", F.lit(None).cast("string").alias("value")).unionByName(reports)


#: How a role is said; other wordings of the same cues.
SAID = {"introduces": ["we introduce", "this note presents"], "uses": ["we adopt", "the work relies on"], "studies": ["we study", "samples of"], "mentions": ["compared with", "next to"]}


def spoken(corpus: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """``corpus`` with the sentences of its mentions and reported values behind its text."""
    said = F.element_at(F.create_map(*[x for r, ways in SAID.items() for x in (F.lit(r), F.array(*map(F.lit, ways)))]), F.col("role"))
    way = F.element_at(said, (F.col("card_id") % 2 + 1).cast("int"))
    told = mentions.groupBy("card_id").agg(F.sort_array(F.collect_list(F.concat_ws(" ", way, "surface"))).alias("s"))
    values = facts.where("rel = 'reports'").select("card_id", "subj", "value").join(mentions.select("card_id", F.col("entity_id").alias("subj"), "surface"), ["card_id", "subj"])
    values = values.select("card_id", F.concat_ws(" ", "surface", F.lit("reaches"), "value", F.lit("depth-score")).alias("v"))
    out = corpus.join(told, "card_id", "left").join(values, "card_id", "left")
    return out.withColumn("txt", F.concat_ws(" . ", "txt", F.array_join("s", " . "), "v")).drop("s", "v")


def planted_no_answer(spark: SparkSession, corpus: DataFrame, n: int, topic: int, seed: int = 20260909) -> DataFrame:
    """query_id, qtext, as_of, intent: needs in the terms of a topic that no card has, asked at the end of the record."""
    end = corpus.agg(F.max("committed_at").alias("as_of"))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(4) + (F.col("id") % 4).cast("int")), lambda k: F.lit(topic) * (TOPIC_TERMS - SHARED_TERMS) + SHARED_TERMS + draw(F.lit(str(seed)), F.col("id").cast("string"), k.cast("string")) % (TOPIC_TERMS - 2 * SHARED_TERMS))
    q = spark.range(n).select((-F.col("id") - 1).alias("query_id"), paraphrased(F.transform(numbers, word), F.col("id"), seed).alias("qtext"))
    return q.crossJoin(end).withColumn("intent", F.lit("current"))  # one row
