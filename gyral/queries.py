"""All queries of the core, by name: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gyral.operators.donors import donor_files, donor_references
from gyral.operators.orphans import orphan_references, orphan_report
from gyral.plans import datasets, grids, kernels, masks, pipeline, placement, registry, retrieval, sampling  # noqa: F401 - registers its queries


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(donor_references(spark, sf_dir), donor_files(spark, sf_dir)).select("ref_table", "row_id").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(donor_references(spark, sf_dir), donor_files(spark, sf_dir))


_KEY = r"nullif(lower(trim(regexp_extract(replace(regexp_replace({0}, '[\s/\\]+$', ''), '\', '/'), '[^/]*$'), e' \t\n\r')), '')"
_REFS = f"""
refs AS (
  SELECT 'donor_index' AS ref_table, donor_id AS row_id, {_KEY.format('paths')} AS key, added_at AS t FROM donor_index
  UNION ALL SELECT 'donor_manifest', manifest_id, {_KEY.format('donor_paths')}, made_at FROM donor_manifest),
files AS (SELECT {_KEY.format('vol_path')} AS key, registered_at AS s, coalesce(removed_at, TIMESTAMP '9999-12-31') AS e FROM volume_files),
judged AS (
  SELECT r.ref_table, r.row_id, r.t, count(f.key) AS n, bool_or(f.s <= r.t AND r.t < f.e) AS held, bool_or(f.e <= r.t AND f.s < f.e) AS before
  FROM (SELECT * FROM refs WHERE key IS NOT NULL) r LEFT JOIN (SELECT * FROM files WHERE s < e) f ON r.key = f.key GROUP BY ALL)
"""
_ORPHANS = "FROM judged WHERE NOT coalesce(held, false)"

SQL = {
    "p5_found": f"WITH {_REFS} SELECT DISTINCT ref_table, row_id {_ORPHANS}",
    "p5_report": f"""WITH {_REFS} SELECT ref_table, strftime(t, '%Y-%m') AS month,
        CASE WHEN n = 0 THEN 'missing' WHEN before THEN 'removed' ELSE 'later' END AS reason, count(*) AS n_refs {_ORPHANS} GROUP BY ALL""",
}


def queries() -> dict:
    return registry.QUERIES | {f.__name__: f for f in (p5_found, p5_report)}


def oracle_sql() -> dict[str, str]:
    return registry.SQL | SQL
