"""Registered query of the source mix, and the same figures in SQL.

The SQL places documents in their source's stream by one ordered sum and finds
what the quota leaves of each by arithmetic, without slots or blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm._scratch import load, materialize
from tarnflow.llm.source_mix import mix, mix_counts


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(load(spark, sf_dir, "documents"))
    counts, _ = materialize(spark, mix_counts(m).select("doc_id", "size", "source_size", "target", "taken"), "mix-counts")
    m.temp.release()
    return counts


SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS key
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized),
ratios AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size / ((sid - 1) % 3 + 1)::DOUBLE AS ratio FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ratios),
lambda_ AS (SELECT arg_min(level, (ratio, sid)) AS lam FROM levels WHERE level < ratio),
targets AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN (3 * source_size)::DOUBLE ELSE (SELECT lam FROM lambda_) * weight END AS target FROM levels),
quotas AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS quota FROM targets),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS begin_ FROM rows_)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - begin_)) + greatest(0, least(size, quota - source_size - begin_))
        + greatest(0, least(size, quota - 2 * source_size - begin_)))::BIGINT AS taken
FROM placed JOIN quotas ON placed.source IS NOT DISTINCT FROM quotas.source
"""

QUERIES = {"op5_source_mix": op5_source_mix}
ORACLES = {"op5_source_mix": SQL}
