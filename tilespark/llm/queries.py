"""The corpus operators as queries over the synthetic tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_digest
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .mixing import mix_digest
from .ngram_join import jaccard_join
from .packing import pack
from .quality import score_quality
from .sharding import shard_documents
from .token_files import read_digests, write_token_files
from .tokens import default_tokenizer
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents")).drop("text_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write_token_files(_table(spark, sf_dir, "documents"), default_tokenizer()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_digest(turns.unionByName(own)).drop("valid")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), default_tokenizer())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_quality": op7_quality,
    "op8_chat_format": op8_chat_format,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_dedup": op10_exact_dedup,
}

_MIXING_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM totals
), rounds(step, source, source_size, weight, cap, stopped, total) AS (
  SELECT 0, source, source_size, weight, cap, false, CAST(sum(source_size) OVER () AS BIGINT) FROM weighed
  UNION ALL
  SELECT step + 1, source, source_size, weight, cap, stopped OR left_ * weight > cap * over_, total FROM (
    SELECT *, total - coalesce(sum(cap) FILTER (WHERE stopped) OVER (), 0) AS left_, coalesce(sum(weight) FILTER (WHERE NOT stopped) OVER (), 0) AS over_,
           count(*) OVER () AS n
    FROM rounds
  ) WHERE step <= n
), ended AS (
  SELECT * FROM rounds WHERE step = (SELECT max(step) FROM rounds)
), levels AS (
  SELECT max(total) - coalesce(sum(cap) FILTER (WHERE stopped), 0) AS left_, sum(weight) FILTER (WHERE NOT stopped) AS over_ FROM ended
), targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE least(CAST(left_ AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(over_ AS DOUBLE), CAST(cap AS DOUBLE)) END AS target
  FROM ended, levels
), rated AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(role, '') AS name, length(text) + length(regexp_replace(text, '[^\\<\[>]', '', 'g')) AS escaped,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
              ELSE 18 + length(coalesce(role, '')) + length(regexp_replace(coalesce(role, ''), '[^\\<\[>]', '', 'g')) END AS marks
  FROM turns
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(name || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(escaped + marks) AS BIGINT) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM chats
"""

_EXACT_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM ranked
"""

_COMPONENTS = """
reached(id, other) AS (
  SELECT a, a FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other
), components AS (
  SELECT id, min(other) AS component FROM reached GROUP BY id
), degrees AS (
  SELECT a AS id, count(*) AS n FROM links GROUP BY a
)"""

_EMBEDDING_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), {_COMPONENTS}
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degrees d ON d.id = e.vec_id LEFT JOIN components c ON c.id = e.vec_id
"""

_NGRAM_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT c.a, c.b FROM common c JOIN sizes s ON s.doc_id = c.a JOIN sizes t ON t.doc_id = c.b WHERE 5 * c.n >= 4 * (s.n + t.n - c.n)
), {_COMPONENTS}
SELECT e.doc_id, coalesce(c.component, e.doc_id) AS class_id, coalesce(d.n, 0) AS n_links, coalesce(c.component, e.doc_id) = e.doc_id AS kept
FROM documents e LEFT JOIN degrees d ON d.id = e.doc_id LEFT JOIN components c ON c.id = e.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": _EMBEDDING_SQL,
    "op4_mixing": _MIXING_SQL,
    "op5_ngram_join": _NGRAM_SQL,
    "op8_chat_format": _CHAT_SQL,
    "op10_exact_dedup": _EXACT_SQL,
}
