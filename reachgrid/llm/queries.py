"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachgrid.llm import fim, lexical, licenses, media, mixing, neardup, packing, pii, ppm, quality, rollup, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_private_spans": pii.op2_private_spans,
    "op3_host_quality": quality.op3_host_quality,
    "op4_token_rollup": rollup.op4_token_rollup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lossless_webp": media.op6_lossless_webp,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_ppm_scores": ppm.op9_ppm_scores,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_feistel_shards": sharding.op12_feistel_shards,
    "op13_block_max_search": lexical.op13_block_max_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_host_quality": quality.ORACLE_SQL,
    "op4_token_rollup": rollup.ORACLE_SQL,
    "op10_license_scan": licenses.ORACLE_SQL,
    "op11_fill_in_middle": fim.ORACLE_SQL,
    "op13_block_max_search": lexical.ORACLE_SQL,
}

ORACLE_SQL["op1_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, sum(source_size) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
q AS (
  SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE) / sum(w) OVER after AS level
  FROM (SELECT *, 3.0 * source_size / w AS ratio FROM s)
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT source, source_size, total,
         least(CAST(w AS DOUBLE) * (SELECT arg_min(level, ratio) FROM q WHERE ratio >= level), CAST(3 * source_size AS DOUBLE)) AS target
  FROM s),
r AS (
  SELECT d.*, t.source_size, t.target, t.total,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT r.*, k, CASE WHEN target > 0 THEN (served + k * source_size) / target ELSE 0 END AS finish
  FROM r, (SELECT unnest([0, 1, 2]) AS k)),
m AS (
  SELECT *, greatest(0, least(size, total - coalesce(sum(size) OVER (
    ORDER BY finish, k, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(sum(part) AS BIGINT) AS taken
FROM m GROUP BY doc_id, h, size, source, source_size, target, served
"""
