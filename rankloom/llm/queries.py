"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, chat_format, fingerprints, license_scan, mixing, neardup, quality_model, quality_rules, token_rollups, token_store
from rankloom.llm.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents with their word-BPE tokens, revises every count by the end id, drops exact copies and
    counts the rest in a second tokenizer version. Batches come out of order and are replayed as after a failure,
    and the log is compacted on the way."""
    counted = token_rollups.counts(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    rows = token_rollups.with_copies(counted).withColumn("with_end", F.col("word_tokens") + 1)
    kept = rows.where("not copy")
    batches = {
        1: token_rollups.inserts(rows, "word_bpe_49k", "word_tokens"),
        2: token_rollups.revisions(rows, "word_bpe_49k", "word_tokens", "with_end"),
        3: token_rollups.deletes(rows.where("copy"), "word_bpe_49k", "with_end"),
        4: token_rollups.inserts(kept, "byte_bpe_50k", "byte_tokens"),
    }
    rollup = token_rollups.Rollup(spark, new_path(spark, "rollup"))
    for batch in (1, 3, 3, 1, 2, 4, 2):
        rollup.commit(batch, batches[batch])
        if batch == 3:
            rollup.compact()
    return rollup.totals()


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.narrow(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", F.col("size"), "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_store.read_digests(spark, folder)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = chat_format.format_conversations(rows.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])))
    read = chat_format.parse_conversations(formatted)
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_store": op3_token_store,
    "op4_near_dedup": op4_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality_model": op6_quality_model,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_rollups": op8_token_rollups,
    "op9_encode_decode": op9_encode_decode,
    "op10_format_chat": op10_format_chat,
}

OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM sized),
levelled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER fill AS k
  FROM ranked WINDOW fill AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
fixed AS (SELECT arg_min(level, k) AS level FROM levelled WHERE cap > level * w),
targets AS (
  SELECT source, source_size, CASE WHEN fixed.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, fixed.level * w) END AS target
  FROM levelled CROSS JOIN fixed),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('20240901:' || coalesce(d.doc_id::VARCHAR, 'null')), d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM docs d JOIN need n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""

OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM windows),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         CASE WHEN len(w) = 0 THEN 0 ELSE length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) END::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
         1000 * n_capitals // greatest(word_chars, 1) AS capital_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS line_rate,
         100 * word_chars // greatest(n_words, 1) AS word_length FROM counts),
long AS (
  UNPIVOT (SELECT lang, source, symbol_rate, repeat_rate, capital_rate, line_rate, word_length FROM measured WHERE NOT base_failed)
  ON symbol_rate, repeat_rate, capital_rate, line_rate, word_length INTO NAME metric VALUE value),
cells AS (
  SELECT lang, source, metric, (value >> greatest(length(bin(value)) - 8, 0)) << greatest(length(bin(value)) - 8, 0) AS bucket, count(*) AS n
  FROM long GROUP BY ALL),
every AS (SELECT metric, bucket, sum(n)::BIGINT * 1000000 AS w FROM cells GROUP BY ALL),
every_share AS (SELECT metric, bucket, w // (sum(w) OVER (PARTITION BY metric)::BIGINT // 1000000) * 100 AS w FROM every),
own_lang AS (SELECT lang, metric, bucket, sum(n)::BIGINT * 1000000 AS w FROM cells GROUP BY ALL),
lang AS (
  SELECT lang, metric, bucket, sum(w)::BIGINT AS w FROM (
    FROM own_lang UNION ALL SELECT g.lang, x.metric, x.bucket, x.w FROM (SELECT DISTINCT lang, metric FROM own_lang) g JOIN every_share x USING (metric)) GROUP BY ALL),
lang_share AS (SELECT lang, metric, bucket, w // (sum(w) OVER (PARTITION BY lang, metric)::BIGINT // 1000000) * 100 AS w FROM lang),
own AS (
  SELECT lang, source, metric, bucket, sum(w)::BIGINT AS w FROM (
    SELECT lang, source, metric, bucket, n * 1000000 AS w FROM cells
    UNION ALL SELECT g.lang, g.source, x.metric, x.bucket, x.w FROM (SELECT DISTINCT lang, source, metric FROM cells) g
      JOIN lang_share x ON x.metric = g.metric AND x.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL),
run_own AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket)::BIGINT AS c, sum(w) OVER (PARTITION BY lang, source, metric)::BIGINT AS total FROM own),
run_lang AS (SELECT *, sum(w) OVER (PARTITION BY lang, metric ORDER BY bucket)::BIGINT AS c, sum(w) OVER (PARTITION BY lang, metric)::BIGINT AS total FROM lang),
q AS (
  SELECT lang, source, metric, min(bucket) FILTER (c >= total // 100 * 25 + total % 100 * 25 // 100) AS q25, min(bucket) FILTER (c >= total // 100 * 50 + total % 100 * 50 // 100) AS q50,
         min(bucket) FILTER (c >= total // 100 * 75 + total % 100 * 75 // 100) AS q75, min(bucket) FILTER (c >= total // 100 * 99 + total % 100 * 99 // 100) AS q99
  FROM run_own GROUP BY lang, source, metric),
skew AS (
  SELECT lang, metric, abs((sum(bucket::HUGEINT * w) // max(total))::BIGINT - min(bucket) FILTER (c >= total // 100 * 50 + total % 100 * 50 // 100)) AS skew FROM run_lang GROUP BY lang, metric),
cut AS (
  SELECT q.lang, q.source, q.metric, q25 - greatest(3 * (q75 - q25), skew) AS low,
         greatest(q75 + greatest(3 * (q75 - q25), skew), CASE WHEN q.metric IN ('repeat_rate', 'capital_rate', 'line_rate') THEN 2 * q99 - q50 ELSE q75 END) AS high
  FROM q JOIN skew k ON q.metric = k.metric AND q.lang IS NOT DISTINCT FROM k.lang),
outside AS (
  SELECT DISTINCT m.doc_id FROM measured m JOIN cut c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
  WHERE CASE c.metric WHEN 'symbol_rate' THEN symbol_rate WHEN 'repeat_rate' THEN repeat_rate WHEN 'capital_rate' THEN capital_rate
                      WHEN 'line_rate' THEN line_rate ELSE word_length END NOT BETWEEN low AND high)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND o.doc_id IS NULL AS kept
FROM measured m LEFT JOIN outside o ON m.doc_id = o.doc_id
"""

OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'),
                                  (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows),
marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k) = role, false) AS same,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS written,
         length(role) + length(role) - length(replace(replace(replace(role, '\', ''), chr(10), ''), '<', '')) AS head FROM numbered)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written + CASE WHEN same THEN 10 ELSE 24 + head END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.scan_sql(),
    "op2_mix_sources": OP2_SQL,
    "op7_quality_rules": OP7_SQL,
    "op10_format_chat": OP10_SQL,
}
