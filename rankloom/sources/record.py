"""The given tables as a versioned record: cards, queries, labels, vectors, edges, entities.

Cards of text are ``documents``: a card's line is its source, it is committed doc_id hours
after the start of 2024, and equal texts form a version chain. Queries are ``benchmark``
items with a time at a fixed fraction of the corpus; cards that contain an item's text
are relevant to it. Relational cards are ``orders``, one chain per customer, linked when
they follow each other on a part. Parts and suppliers are entities, line items mentions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import asof, lexical, ranking, vectors
from rankloom.storage import small, written

START = "timestamp_ntz'2024-01-01 00:00:00'"


class Record:
    """Frames over one folder of tables, built when first asked for.

    Most are plans. Those that many queries read (labels, statistics, postings, mentions)
    are computed once and stored.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    #: Frames that a record can be made from, with their columns.
    FRAMES = {
        "versions": ("card_id", "line", "committed_at", "supersedes_id"),
        "texts": ("card_id", "txt"),
        "queries": ("query_id", "qtext", "as_of", "intent"),
        "labels": ("query_id", "card_id", "grade", "slot"),
        "pairs": ("query_id", "pair_id"),
        "vectors": ("card_id", "embedding"),
        "query_vectors": ("query_id", "qv"),
        "text_edges": ("src", "dst", "kind", "valid_from"),
        "entity_mentions": ("card_id", "entity_id", "surface", "role"),
        "entity_facts": ("card_id", "subj", "rel", "obj", "value", "valid_from", "valid_until"),
    }

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> Record:
        """A record of one's own: any of FRAMES by name, each with at least its columns.

        Everything on text cards works on it: all scorers, metrics, judges and reports.
        What is not given is empty (labels, vectors, edges, entities). Without vectors the
        dense side of a fusion finds nothing.
        """
        rec = cls(spark, "")
        for name, df in frames.items():
            missing = set(cls.FRAMES[name]) - set(df.columns)
            if missing:
                raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
            setattr(rec, name, asof.with_superseded(df.select(*cls.FRAMES[name])) if name == "versions" else df)
        card = dict(frames["versions"].dtypes)["card_id"]
        query = dict(frames["queries"].dtypes)["query_id"] if "queries" in frames else "bigint"
        empty = {
            "labels": f"query_id {query}, card_id {card}, grade double, slot bigint",
            "pairs": f"query_id {query}, pair_id {query}",
            "vectors": f"card_id {card}, embedding array<float>",
            "query_vectors": f"query_id {query}, qv array<float>",
            "text_edges": f"src {card}, dst {card}, kind string, valid_from timestamp_ntz",
            "entity_mentions": f"card_id {card}, entity_id string, surface string, role string",
            "entity_facts": f"card_id {card}, subj string, rel string, obj string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz",
        }
        for name, schema in empty.items():
            if name not in frames:
                setattr(rec, name, spark.createDataFrame([], schema))
        return rec

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- text cards -----------------------------------------------------------------

    @cached_property
    def versions(self) -> DataFrame:
        """card_id, line, committed_at, supersedes_id, superseded_at: narrow, so chains shuffle no texts."""
        chain = Window.partitionBy(F.md5("text")).orderBy("doc_id")
        v = self.table("documents").select(
            F.col("doc_id").alias("card_id"),
            F.col("source").alias("line"),
            F.expr(f"timestampadd(HOUR, doc_id, {START})").alias("committed_at"),
            F.lag("doc_id").over(chain).alias("supersedes_id"),
        )
        return asof.with_superseded(v)

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("card_id"), F.col("text").alias("txt"))

    @cached_property
    def queries(self) -> DataFrame:
        """query_id, qtext, as_of, intent."""
        n = self.table("documents").agg(F.count(F.lit(1)).alias("n"))
        b = self.table("benchmark").crossJoin(F.broadcast(n))  # one row
        return b.select(
            F.col("item_id").alias("query_id"),
            F.col("text").alias("qtext"),
            F.expr(f"timestampadd(HOUR, n * (5 + item_id % 5) div 10, {START})").alias("as_of"),
            F.when(F.col("item_id") % 2 == 0, "current").otherwise("history").alias("intent"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        """query_id, card_id, grade, slot: cards in the snapshot that contain the item's text.

        The stated set of queries is sent to the texts, in one pass over them; the few pairs
        found are stored, as most queries read them several times.
        """
        found = self.containing().join(small(self.queries.select("query_id", "as_of")), "query_id")
        found = found.join(self.versions.select("card_id", "committed_at"), "card_id").where(F.col("committed_at") <= F.col("as_of"))
        nth = Window.partitionBy("query_id").orderBy("card_id")
        return written(found.select("query_id", "card_id", F.lit(2.0).alias("grade"), (F.row_number().over(nth) % 3).cast("long").alias("slot")), "labels")

    def containing(self) -> DataFrame:
        """query_id, card_id: cards whose text contains the query's."""
        known = self.queries.select("query_id", "qtext").limit(vectors.MOST_QUERIES + 1).collect()
        if len(known) <= vectors.MOST_QUERIES:
            return lexical.containing(self.texts, known)
        return self.texts.join(self.queries, F.contains("txt", "qtext")).select("query_id", "card_id")

    @cached_property
    def pairs(self) -> DataFrame:
        """query_id, pair_id: queries that make up a contrast; here two neighbouring items."""
        return self.queries.select("query_id", F.floor(F.col("query_id") / 2).alias("pair_id"))

    # ---- lexical and dense scores ----------------------------------------------------

    @cached_property
    def toks(self) -> DataFrame:
        return lexical.tokenised(self.texts)

    @cached_property
    def stats(self) -> DataFrame:
        return written(lexical.statistics(self.texts), "stats")

    @cached_property
    def terms(self) -> DataFrame:
        return lexical.query_terms(self.queries)

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """card_id, dl, term, tf and the card's dates, of the given terms; stored, as idf and scores both read them and the texts are split once."""
        dates = self.versions.select("card_id", "committed_at", "superseded_at")
        return written(lexical.postings(self.toks, terms).join(dates, "card_id"), "postings")

    def _vocabulary(self, terms: DataFrame) -> list[str] | None:
        """The distinct terms, if they are few enough to be sent to every task."""
        known = terms.select("term").distinct().limit(lexical.MOST_TERMS + 1).collect()
        return sorted(r.term for r in known) if len(known) <= lexical.MOST_TERMS else None

    def indexed(self, vocabulary: list[str]) -> DataFrame:
        """card_id, dl, at, tf, the card's dates and whether there is such a card: the counts of the terms of ``vocabulary`` in every text, stored."""
        dates = self.versions.select("card_id", "committed_at", "superseded_at", F.lit(True).alias("known"))
        return written(lexical.index(self.texts, vocabulary).join(dates, "card_id", "left"), "index")

    def idf_of(self, terms: DataFrame) -> DataFrame:
        """term, df, idf over all cards; stored."""
        if (vocabulary := self._vocabulary(terms)) is None:
            return lexical.inverse_frequencies(self.postings_of(terms.select("term").distinct()), self.stats)
        # counted where the texts lie; of texts without a card none are counted
        texts = self.texts if self.sf_dir else self.texts.join(self.versions.select("card_id"), "card_id", "left_semi")
        return written(lexical.inverse(lexical.frequencies(lexical.index(texts, vocabulary), vocabulary), self.stats), "idf")

    def _timed(self, terms: DataFrame) -> DataFrame:
        return terms.join(small(self.queries.select("query_id", "as_of", "intent")), "query_id")

    def bm25_best(self, terms: DataFrame, n: int, pool: bool = False, among: DataFrame | None = None) -> DataFrame:
        """query_id, card_id, score above 0 of the cards that a query's time allows, masked before they are cut; a superset
        of each query's n best. With ``among`` only its cards compete, by the statistics of all."""
        asked = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")).limit(lexical.MOST_TERMS + 1).collect()
        queries = self.queries.select("query_id", vectors.micros("as_of"), "intent").limit(vectors.MOST_QUERIES + 1).collect()
        if len(asked) > lexical.MOST_TERMS or len(queries) > vectors.MOST_QUERIES:
            return self._bm25_joined(terms, pool, among)
        if not asked or not queries:
            return self._bm25_joined(terms, pool, among).where("false")
        vocabulary, cards = self._index(sorted({r.term for r in asked}))
        if "stats" not in self.__dict__:
            self.stats = written(lexical.totals(cards), "stats")
        cards = cards.where("known")
        idf = {r.term: r.idf for r in lexical.inverse(lexical.frequencies(cards, vocabulary), self.stats).collect()}
        if among is not None:
            cards = cards.join(among.select("card_id"), "card_id", "left_semi")
        best = lexical.best(cards, vocabulary, queries, asked, idf, self.stats.first().avgdl, n, pool)
        return best.select("query_id", "card_id", F.round("score", ranking.PLACES).alias("score"))

    def _index(self, vocabulary: list[str]) -> tuple[list[str], DataFrame]:
        """The terms and their index, kept for the record as most scorers ask for the same."""
        known = self.__dict__.setdefault("indexes", {})
        key = tuple(vocabulary)
        if key not in known:
            known[key] = self.indexed(vocabulary)
        return vocabulary, known[key]

    def _bm25_joined(self, terms: DataFrame, pool: bool, among: DataFrame | None) -> DataFrame:
        """The same for more queries or terms than a task is sent: all pairs that share a term."""
        posts = self.postings_of(terms.select("term").distinct())
        idf = lexical.inverse_frequencies(posts, self.stats)
        if among is not None:
            posts = posts.join(among.select("card_id"), "card_id", "left_semi")
        keep = asof.in_pool(F.col("as_of"), F.col("intent")) if pool else asof.in_snapshot(F.col("as_of"))
        return lexical.bm25(self._timed(terms), posts, idf, self.stats, keep).where("score > 0")

    @cached_property
    def vectors(self) -> DataFrame:
        """card_id, embedding."""
        e = self.table("embeddings").select(F.col("vec_id").alias("card_id"), "embedding")
        return e.join(self.versions.select("card_id"), "card_id", "left_semi")

    @cached_property
    def query_vectors(self) -> DataFrame:
        """query_id, qv: here the vector with the item's number."""
        e = self.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
        return e.join(small(self.queries.select("query_id")), "query_id", "left_semi")

    @cached_property
    def dense(self) -> DataFrame:
        """query_id, card_id, score: all dot products of the stated queries' vectors with the cards'."""
        dot = F.aggregate(F.zip_with("qv", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
        return self.vectors.crossJoin(small(self.query_vectors)).select("query_id", "card_id", F.round(dot, ranking.PLACES).alias("score"))

    def _hidden(self, seen: DataFrame, without: DataFrame | None) -> DataFrame:
        # the pairs are a few labelled ones
        return seen if without is None else seen.join(small(without), ["query_id", "card_id"], "left_anti")

    def lexical_top(self, n: int, pool: bool = False, without: DataFrame | None = None) -> DataFrame:
        """The n best by BM25 among the cards of a query's time; pairs of ``without`` (query_id, card_id) are hidden."""
        if without is not None:
            # as many more as are hidden of any query
            most = without.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            return ranking.top(self._hidden(self.bm25_best(self.terms, n + most, pool), without), n)
        return self._listed(n, pool).where(F.col("rank") <= n)

    #: The depth to which lexical lists are made, so that shorter ones are read from them.
    DEPTH = 150

    def _listed(self, n: int, pool: bool) -> DataFrame:
        """A list of n or more cards for each query, stored."""
        known = self.__dict__.setdefault("lists", {})
        if known.get(pool, (0,))[0] < n:
            known[pool] = (max(n, self.DEPTH), written(ranking.top(self.bm25_best(self.terms, max(n, self.DEPTH), pool), max(n, self.DEPTH)), "lexical"))
        return known[pool][1]

    def dense_top(self, n: int, pool: bool = False, without: DataFrame | None = None) -> DataFrame:
        """The n best by dot product. Beyond a stated number of queries, or with hidden pairs, all products are made."""
        q = self.query_vectors.join(self.queries.select("query_id", "as_of", "intent"), "query_id")
        if without is None and (known := q.limit(vectors.MOST_QUERIES + 1).collect()) and len(known) <= vectors.MOST_QUERIES:
            best = vectors.best(self.vectors.join(self.versions.select("card_id", "committed_at", "superseded_at"), "card_id"), known, n, pool)
            return ranking.top(best.select("query_id", "card_id", F.round("score", ranking.PLACES).alias("score")), n)
        seen = asof.masked(self.dense, self.queries, self.versions, pool).select("query_id", "card_id", "score")
        return ranking.top(self._hidden(seen, without), n)

    def rrf(self, n: int, pool: bool = False) -> DataFrame:
        return ranking.fused([self.lexical_top(n, pool), self.dense_top(n, pool)])

    def first_stage(self) -> DataFrame:
        return ranking.ranked(self.rrf(150, pool=True))

    def fresh(self) -> DataFrame:
        """RRF of the best 150 each; what is not current leaves after that cut; then recency."""
        seen = self.rrf(150).join(self.queries.select("query_id", "as_of"), "query_id").join(self.versions, "card_id").where(asof.current(F.col("as_of")))
        age = F.expr("timestampdiff(SECOND, committed_at, as_of)") / F.lit(86400.0)
        return seen.select("query_id", "card_id", ranking.decayed(F.col("score"), age).alias("score"))

    @cached_property
    def text_edges(self) -> DataFrame:
        """Every card cites the card before it on its line."""
        line = Window.partitionBy("line").orderBy("card_id")
        e = self.versions.select("card_id", "committed_at", F.lag("card_id").over(line).alias("dst"))
        return e.where("dst is not null").select(F.col("card_id").alias("src"), "dst", F.lit("citation").alias("kind"), F.col("committed_at").alias("valid_from"))

    @cached_property
    def entity_mentions(self) -> DataFrame:
        """card_id, entity_id, surface, role: long words that 2 to 20 cards share stand for names."""
        names = self.toks.select("card_id", F.explode(F.array_distinct(F.filter("w", lambda x: F.length(x) >= 12))).alias("entity_id"))
        few = names.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 20").select("entity_id")
        return written(names.join(few, "entity_id", "left_semi").select("card_id", "entity_id", F.col("entity_id").alias("surface"), F.lit("mentions").alias("role")), "mentions")

    @cached_property
    def entity_facts(self) -> DataFrame:
        """card_id, subj, rel, obj, value, valid_from, valid_until: neighbours in a card's sorted names, as long as the card is current."""
        before = Window.partitionBy("card_id").orderBy("entity_id")
        pairs = self.entity_mentions.select("card_id", F.lag("entity_id").over(before).alias("subj"), F.lit("next_to").alias("rel"), F.col("entity_id").alias("obj"), F.lit(None).cast("string").alias("value"))
        at = self.versions.select("card_id", F.col("committed_at").alias("valid_from"), F.col("superseded_at").alias("valid_until"))
        return pairs.where("subj is not null").join(at, "card_id")

    def boosted(self) -> DataFrame:
        base = self.rrf(150).join(self.queries.select("query_id", "as_of"), "query_id")
        deg = asof.in_degrees(self.text_edges, self.queries)
        return base.join(deg, ["card_id", "as_of"], "left").select("query_id", "card_id", ranking.boosted(F.col("score"), F.coalesce("in_degree", F.lit(0))).alias("score"))

    # ---- orders ----------------------------------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        """Orders as cards: a customer's orders are versions of one card."""
        chain = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        o = self.table("orders").select(
            F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("line"), F.col("o_orderdate").alias("committed_at"), F.col("o_totalprice").alias("price"), F.lag("o_orderkey").over(chain).alias("supersedes_id")
        )
        return asof.with_superseded(o)

    @cached_property
    def order_edges(self) -> DataFrame:
        """src, dst, kind, valid_from: an order and the order before it on a part."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey").distinct().join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
        part = Window.partitionBy("l_partkey").orderBy("o_orderdate", "l_orderkey")
        e = lines.select(F.col("l_orderkey").alias("src"), F.lag("l_orderkey").over(part).alias("dst"), F.col("o_orderdate").alias("valid_from"))
        return e.where("dst is not null and dst <> src").distinct().select("src", "dst", F.lit("citation").alias("kind"), "valid_from")

    @cached_property
    def walks(self) -> DataFrame:
        """query_id, as_of: a walk for each nation, at a time of its own."""
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.expr("timestampadd(DAY, 30 * n_nationkey, timestamp_ntz'1995-01-01 00:00:00')").alias("as_of"))

    @cached_property
    def walk_seeds(self) -> DataFrame:
        """The ten dearest orders of a nation's customers up to its time."""
        o = self.orders.join(self.table("customer").select(F.col("c_custkey").alias("line"), F.col("c_nationkey").cast("long").alias("query_id")), "line")
        o = o.join(self.walks, "query_id").where(F.col("committed_at") <= F.col("as_of"))
        return ranking.top(o.select("query_id", "card_id", F.col("price").alias("score")), 10)
