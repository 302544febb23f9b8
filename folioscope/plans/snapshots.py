"""Queries on full snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.snapshot_diff import page_changes
from folioscope.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_changes(table(spark, sf_dir, "page_snapshots"), table(spark, sf_dir, "manifests"))


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each kind per later crawl."""
    return p1_found(spark, sf_dir).groupBy("manifest_no").pivot("diff_kind", ["added", "removed", "changed"]).count().na.fill(0)


CANONICAL_URL_SQL = r"""
url_parts AS (
  SELECT *, regexp_replace(url, '#.*$', '', 's') AS bare FROM page_rows
), url_split AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(.*)$', 1)) AS scheme,
    lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(.*)$', 2)) AS host,
    regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(.*)$', 3) AS raw_path,
    regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(.*)$', 4) AS query_part
  FROM url_parts
), url_clean AS (
  SELECT *, list_reduce(list_concat([CAST([] AS VARCHAR[])],
      list_transform(list_filter(string_split(raw_path, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s])),
      lambda done, s: CASE WHEN s[1] = '..' THEN done[1:greatest(len(done) - 1, 0)] ELSE list_concat(done, s) END) AS steps
  FROM url_split
), canonical AS (
  SELECT *, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '')
      WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
    || '/' || array_to_string(steps, '/') || CASE WHEN len(steps) > 0 AND raw_path LIKE '%/' THEN '/' ELSE '' END
    || query_part AS canonical_url
  FROM url_clean
)"""

P1_FOUND_SQL = rf"""
WITH crawls AS (
  SELECT manifest_no, min(manifest_no) OVER s AS series_no,
    row_number() OVER (PARTITION BY source_id, version ORDER BY snapshot_seq, manifest_no) AS pos,
    lead(manifest_no) OVER (PARTITION BY source_id, version ORDER BY snapshot_seq, manifest_no) AS next_no
  FROM manifests WHERE complete WINDOW s AS (PARTITION BY source_id, version)
), page_rows AS (
  SELECT p.manifest_no, p.url, p.content_hash, p.crawled_at, p.loaded_at FROM page_snapshots p WHERE p.url IS NOT NULL AND p.url <> ''
), {CANONICAL_URL_SQL}, listing AS (
  SELECT c.series_no, c.pos, c.next_no, c.manifest_no, canonical_url AS url, hash FROM (
    SELECT manifest_no, canonical_url, nullif(regexp_extract(lower(trim(content_hash)), '(?:^|[^0-9a-z])([0-9a-f]+)$', 1), '') AS hash,
      row_number() OVER (PARTITION BY manifest_no, canonical_url ORDER BY crawled_at DESC NULLS LAST, loaded_at DESC NULLS LAST,
        nullif(regexp_extract(lower(trim(content_hash)), '(?:^|[^0-9a-z])([0-9a-f]+)$', 1), '') DESC NULLS LAST) AS nth FROM canonical
  ) n JOIN crawls c USING (manifest_no) WHERE nth = 1
)
SELECT b.manifest_no, b.url, 'added' AS diff_kind FROM listing b
  WHERE b.pos > 1 AND NOT EXISTS (SELECT 1 FROM listing a WHERE a.series_no = b.series_no AND a.pos = b.pos - 1 AND a.url = b.url)
UNION ALL
SELECT b.manifest_no, b.url, 'changed' FROM listing b JOIN listing a
  ON a.series_no = b.series_no AND a.pos = b.pos - 1 AND a.url = b.url WHERE a.hash <> b.hash
UNION ALL
SELECT a.next_no, a.url, 'removed' FROM listing a
  WHERE a.next_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM listing b WHERE b.series_no = a.series_no AND b.pos = a.pos + 1 AND b.url = a.url)
"""

P1_SUMMARY_SQL = rf"""
SELECT manifest_no, count(*) FILTER (diff_kind = 'added') AS added, count(*) FILTER (diff_kind = 'removed') AS removed,
  count(*) FILTER (diff_kind = 'changed') AS changed FROM ({P1_FOUND_SQL}) GROUP BY manifest_no
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_summary": p1_summary}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_summary": P1_SUMMARY_SQL}
