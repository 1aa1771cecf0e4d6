"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwave.llm.byte_bpe import bpe_rows
from siftwave.llm.centroids import cluster_rows
from siftwave.llm.chat_format import chat_rows
from siftwave.llm.license_scan import license_rows
from siftwave.llm.media import media_rows
from siftwave.llm.merkle import manifest_rows
from siftwave.llm.mil_quality import quality_scores
from siftwave.llm.packing import packed_rows
from siftwave.llm.pitman_yor import lm_rows
from siftwave.llm.prefix_join import near_duplicate_rows
from siftwave.llm.quality_rules import STOP_WORDS, quality_rows
from siftwave.llm.warc import warc_rows
from siftwave.llm.winnowing import fingerprint_rows


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    documents = lambda f: lambda spark, sf_dir: f(_read(spark, sf_dir, "documents"))
    return {
        "op1_pitman_yor": documents(lm_rows),
        "op2_media": documents(media_rows),
        "op3_licenses": documents(license_rows),
        "op4_warc": lambda spark, sf_dir: warc_rows(_read(spark, sf_dir, "pages")),
        "op5_chat": lambda spark, sf_dir: chat_rows(_read(spark, sf_dir, "conversations")),
        "op6_mil_quality": lambda spark, sf_dir: quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")),
        "op7_prefix_join": documents(near_duplicate_rows),
        "op8_packing": lambda spark, sf_dir: packed_rows(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")),
        "op9_quality_rules": documents(quality_rows),
        "op10_byte_bpe": lambda spark, sf_dir: bpe_rows(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "op11_merkle_manifest": documents(manifest_rows),
        "op12_centroids": lambda spark, sf_dir: cluster_rows(_read(spark, sf_dir, "embeddings")),
        "op13_winnowing": documents(fingerprint_rows),
        "pipeline": _pipeline,
    }


CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length('<|im_start|>' || '<|im_end|>') + 2 AS n
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

RULES_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS s
  FROM documents
), windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), measured AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(s) - len(list_distinct(s)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(s) AS n_lines,
    len(list_filter(w, lambda x: x IN (STOP_WORDS))) AS n_stop,
    len(list_filter(s, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]'))) AS n_bullet,
    len(list_filter(s, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM split LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words AND n_symbols <= 0.1 * n_words
    AND n_stop >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_bullet <= 0.9 * n_lines AND n_ellipsis <= 0.5 * n_lines AS kept
FROM judged
""".replace("STOP_WORDS", ", ".join(f"'{w}'" for w in STOP_WORDS))


MANIFEST_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), marked AS (
  SELECT d.*, 4294967295 - list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])) AS crc FROM documents d, crc
), digests AS (
  SELECT doc_id, lang, sha256(before || nc || after) AS leaf, sha256(before || CASE WHEN crc % 7 = 0 THEN more ELSE nc END || after) AS claim FROM (
    SELECT doc_id, lang, crc, VALUE(doc_id) || VALUE(source) || VALUE(lang) AS before, VALUE(n_chars) AS nc, VALUE((n_chars + 1)) AS more, VALUE(text) AS after FROM marked)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM digests
), up AS (
  SELECT lang, 0 AS level, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY lang, level, place // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), above AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM above WHERE n > 1 GROUP BY level, place // 2, n
), steps AS (
  SELECT l.lang, l.place, u.level, u.place AS at, s.h FROM leaves l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.n > 1 AND u.place = l.place // (CAST(2 AS BIGINT) ** u.level)::BIGINT
    LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = u.level AND s.place = xor(u.place, 1)
  UNION ALL
  SELECT l.lang, l.place, 1000 + u.level, u.place, s.h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN above u ON u.n > 1 AND u.place = r.place // (CAST(2 AS BIGINT) ** u.level)::BIGINT
    LEFT JOIN above s ON s.level = u.level AND s.place = xor(u.place, 1)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang, place ORDER BY level) AS step FROM steps
), proofs AS (
  SELECT lang, place, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof, max(step) AS last FROM ordered GROUP BY lang, place
), folded AS (
  SELECT lang, place, 0 AS step, claim AS h FROM leaves
  UNION ALL
  SELECT f.lang, f.place, f.step + 1, sha256(CASE WHEN o.h IS NULL THEN f.h WHEN o.at % 2 = 0 THEN f.h || o.h ELSE o.h || f.h END)
  FROM folded f JOIN ordered o ON o.lang IS NOT DISTINCT FROM f.lang AND o.place = f.place AND o.step = f.step + 1
), ends AS (
  SELECT lang, place, arg_max(h, step) AS h FROM folded GROUP BY lang, place
)
SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN above t ON t.n = 1
  JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.place = l.place LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place
"""
MANIFEST_SQL = re.sub(r"VALUE\((\(.*?\)|\w+)\)", r"coalesce(strlen(CAST(\1 AS VARCHAR)) || ':' || CAST(\1 AS VARCHAR), '-')", MANIFEST_SQL)


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Full searches instead of partial ones, a common table expression for each round."""
    nearest = lambda i: f"""hits{i} AS (
  SELECT r, min(struct_pack(d := d, c := c)) AS hit FROM (SELECT r, c, list_sum(list_transform(range(1, {dims + 1}), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) AS d FROM vectors, c{i}) GROUP BY r
)"""  # noqa: E731
    parts = [
        f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS w FROM vectors ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds):
        parts.append(nearest(i))
        parts.append(f"""sums{i} AS (
  SELECT c, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS w FROM (
    SELECT hit.c AS c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM vectors JOIN hits{i} USING (r), range(1, {dims + 1}) t(j) GROUP BY hit.c, j) GROUP BY c
)""")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s.w, o.w) AS w FROM c{i} o LEFT JOIN sums{i} s USING (c))")
    parts.append(nearest(rounds))
    return (
        "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(hit.c AS INTEGER) AS cluster, CAST(hit.d AS BIGINT) AS distance, CAST(sum(hit.d) OVER (PARTITION BY hit.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(hit.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM vectors JOIN hits{rounds} USING (r) JOIN c{rounds} ON c{rounds}.c = hit.c
"""
    )


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; tests hold the others against brute force, round trips and held-out labels."""
    return {"op5_chat": CHAT_SQL, "op9_quality_rules": RULES_SQL, "op11_merkle_manifest": MANIFEST_SQL, "op12_centroids": _clusters_sql()}
