"""Queries on whole crawls, retries and published snapshots, over a site made of the stored pages' numbers."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.ids import content_hash
from folioscope.operators.crawl import EVENT, Crawled, SourceSpec, crawl, retry, table_fetch
from folioscope.operators.index import index
from folioscope.plans.texts import EMBEDDING_TEXT, PAGES, UUID, chunks_sql, pages
from folioscope.session import checkpoint_folder, delete_on_exit
from folioscope.sources.providers import HashingEmbedder
from folioscope.sources.store import SnapshotStore

c = F.col
ROOT = "https://site.example/docs"
SPEC = SourceSpec("site", f"{ROOT}/p1", "main", "1", content_selectors=["#alt"])
T = datetime(2025, 1, 1)


def site(spark, sf_dir, repaired: bool = False) -> DataFrame:
    """A page of HTML for every stored page, by the remainder of its number by 12.

    0 redirects to the next page, 3 has its content under the second selector, 5 has none, 7 is a PDF, 9 refreshes to the
    next page, 11 is gone. Every page links five pages below it, one above it and one outside. ``repaired``: 5 and 11 are there.
    """
    no = c("page_no")
    kind = no % 12
    url = lambda n: F.concat(F.lit(f"{ROOT}/p"), n.cast("string"))
    link = lambda to: F.concat(F.lit("<a href='"), to, F.lit("'>x</a>"))
    links = F.concat(*(link(url(no * 5 + i)) for i in range(4)), link(F.concat(F.lit("p"), (no * 5 + 4).cast("string"))), link(F.concat(url(F.floor(no / 5)), F.lit("#top"))), link(F.concat(F.lit("//other.example/x"), (no % 7).cast("string"))))
    inner = F.concat(F.lit("<h1>Page "), no.cast("string"), F.lit("</h1><p>word"), no.cast("string"), F.lit("</p>"))
    gone = F.lit(False) if repaired else kind == 11
    empty = F.lit(False) if repaired else kind == 5
    content = (
        F.when(empty, F.concat(F.lit("<div>"), inner, F.lit("</div>"))).when(kind == 3, F.concat(F.lit("<div id=alt>"), inner, F.lit("</div>")))
        .otherwise(F.concat(F.lit("<main>"), inner, F.lit("</main>")))
    )
    refresh = F.when(kind == 9, F.concat(F.lit("<meta http-equiv=refresh content='0; url=p"), (no + 1).cast("string"), F.lit("'>"))).otherwise("")
    html = F.concat(F.lit("<title> Page "), no.cast("string"), F.lit("</title>"), refresh, links, content)
    return pages(spark, sf_dir).select(
        url(no).alias("url"), F.when(gone, 404).when(kind == 0, 302).otherwise(200).alias("status"), F.when(kind == 7, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(kind == 7, F.lit("%PDF-")).otherwise(html).alias("body"), F.when(kind == 0, url(no + 1)).alias("redirect_to"),
    )


def seeded() -> SourceSpec:
    """The whole folder is in scope; the crawl starts at its first page."""
    return SourceSpec(**{**SPEC.__dict__, "seed_url": ROOT})


def crawled(spark, sf_dir) -> Crawled:
    return crawl(spark, seeded(), table_fetch(site(spark, sf_dir)), [SPEC.seed_url], crawled_at=T)


def shown(documents: DataFrame) -> DataFrame:
    return documents.select("url", "title", "filename", "content_hash", F.md5("markdown").alias("body"))


def crawled_documents(spark, sf_dir):
    """The documents of a crawl of the whole site."""
    return shown(crawled(spark, sf_dir).documents)


def crawl_events(spark, sf_dir):
    """What happened in a crawl of the whole site: fetched, redirected, skipped, failed pages and those without content."""
    return crawled(spark, sf_dir).events.withColumn("status", F.coalesce("status", F.lit(0)))


def retried_documents(spark, sf_dir):
    """The documents after the pages that failed or had no content were crawled again on the repaired site."""
    old = crawled(spark, sf_dir)
    return shown(retry(spark, old, table_fetch(site(spark, sf_dir, repaired=True)), crawled_at=T).documents)


def published(spark, sf_dir) -> SnapshotStore:
    """A store with one snapshot: all stored pages, indexed as one source."""
    docs = pages(spark, sf_dir).where("markdown is not null and url <> ''").withColumn("content_hash", content_hash(c("markdown")))
    documents = docs.select("url", "title", "content_hash", "crawled_at", "markdown")
    root = f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"
    delete_on_exit(spark, root)
    store = SnapshotStore(spark, root)
    index(spark, Crawled(SPEC, documents, spark.createDataFrame([], EVENT), True), store, HashingEmbedder(16))
    return store


def published_points(spark, sf_dir):
    """The chunks as a published snapshot holds them: ids, inputs, dense vectors, and the postings of their sparse vectors."""
    store = published(spark, sf_dir)
    terms = store.postings("site").groupBy("point_id").agg(F.countDistinct("term").alias("n_terms"))
    rows = store.chunks("site", "1").select("point_id", "url", "chunk_index", "input_hash", F.size("dense_vector").alias("dimension"), F.size("indices").alias("n_indices"))
    return rows.join(terms, "point_id").select("point_id", "url", "chunk_index", "input_hash", "dimension", (c("n_terms") == c("n_indices")).alias("posted"))


def published_documents(spark, sf_dir):
    """The listing of a published snapshot."""
    return published(spark, sf_dir).list_documents("site").select("source", "version", "url", "title", "content_hash")


def published_sources(spark, sf_dir):
    """The catalog of a store: the source, its default version and how many documents and chunks it holds."""
    listed = published(spark, sf_dir).list_sources()["sources"]
    rows = [(s["source"], s["default_version"], v["version"], v["document_count"], v["chunk_count"], v["complete"]) for s in listed for v in s["versions"]]
    return spark.createDataFrame(rows, "source string, default_version string, version string, document_count bigint, chunk_count bigint, complete boolean")


def _site_sql(gone: str, empty: str) -> str:
    there = "list_contains(n.all_nos, {0})".format
    final = f"CASE WHEN x % 12 = 0 AND {there('x')} THEN x + 1 ELSE x END"
    return f"""
own AS (SELECT DISTINCT page_no AS no FROM stored_pages), n AS (SELECT list(no) AS all_nos FROM own),
levels AS (
  SELECT 0 AS level, [1::BIGINT] AS frontier, [1::BIGINT] AS seen
  UNION ALL
  SELECT level + 1, next, list_distinct(list_concat(seen, list_concat(next, list_transform(next, lambda x: {final})))) FROM (
    SELECT level, seen, n.all_nos, list_distinct(list_filter(flatten(list_transform(list_transform(frontier, lambda x: {final}), lambda f:
      CASE WHEN NOT {there('f')} OR f % 12 IN (0, 7 {gone}) THEN [] WHEN f % 12 = 9 THEN [f + 1] ELSE [f * 5, f * 5 + 1, f * 5 + 2, f * 5 + 3, f * 5 + 4, f // 5] END)), lambda x: NOT list_contains(seen, x))) AS next
    FROM levels, n WHERE len(frontier) > 0) n
), asked AS (
  SELECT level, x AS asked_no, {final} AS no, '{ROOT}/p' || x AS requested FROM (SELECT level, unnest(frontier) AS x FROM levels), n
), fetched AS (
  SELECT a.*, '{ROOT}/p' || a.no AS url, NOT {there('a.no')} OR a.no % 12 IN (-1 {gone}) AS failed, a.no % 12 = 7 AS other, a.no % 12 = 9 AS refreshed, a.no % 12 IN (-1 {empty}) AS missing FROM asked a, n
), content AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY level, requested) AS nth FROM fetched WHERE NOT failed AND NOT other AND NOT refreshed AND NOT missing
), documents_found AS (
  SELECT url, 'Page ' || no AS title, sha256('site' || chr(0) || '1' || chr(0) || url) AS d, '# Page ' || no || chr(10) || chr(10) || 'word' || no AS markdown FROM content WHERE nth = 1
)"""


DOCUMENTS_SQL = "SELECT url, title, 'documents/' || left(d, 24) || '.md' AS filename, sha256(markdown) AS content_hash, md5(markdown) AS body FROM documents_found"
BROKEN, REPAIRED = _site_sql(", 11", ", 5"), _site_sql("", "")
PUBLISHED_SQL = f"""
{PAGES}, kept AS (SELECT page_no, url, title, markdown, sha256(markdown) AS content_hash FROM pages WHERE markdown IS NOT NULL AND url <> ''), {chunks_sql('kept', 'page_no', 'markdown')},
points AS (
  SELECT k.url, k.title, chunk_index, path AS heading_path, c.markdown, sha256('site' || chr(0) || '1' || chr(0) || k.url || chr(0) || content_hash || chr(0) || chunk_index) AS d
  FROM chunked c JOIN kept k USING (page_no)
)"""

SQL = {
    crawled_documents: f"WITH RECURSIVE {BROKEN} {DOCUMENTS_SQL}",
    crawl_events: f"""
WITH RECURSIVE {BROKEN}, html AS (SELECT DISTINCT url, no, refreshed FROM fetched WHERE NOT failed AND NOT other)
SELECT DISTINCT * REPLACE (coalesce(status, 0)::INT AS status) FROM (
  SELECT 'fetched' AS kind, url, 200 AS status, NULL AS detail, NULL AS target FROM content
  UNION ALL SELECT 'selector_missing', url, 200, NULL, NULL FROM fetched WHERE NOT failed AND NOT other AND NOT refreshed AND missing
  UNION ALL SELECT 'failed', requested, 404, 'status 404', NULL FROM fetched WHERE failed
  UNION ALL SELECT 'skipped', requested, 200, 'not HTML: application/pdf', NULL FROM fetched WHERE NOT failed AND other
  UNION ALL SELECT 'skipped', requested, 200, 'duplicate canonical page', url FROM content WHERE nth <> 1
  UNION ALL SELECT 'skipped', 'https://other.example/x' || no % 7, NULL, 'out of scope', NULL FROM html WHERE NOT refreshed
  UNION ALL SELECT 'redirected', url, NULL, 'meta refresh', '{ROOT}/p' || (no + 1) FROM html WHERE refreshed
  UNION ALL SELECT 'redirected', requested, 302, NULL, url FROM fetched WHERE asked_no <> no)""",
    retried_documents: f"WITH RECURSIVE {REPAIRED} {DOCUMENTS_SQL}",
    published_points: f"WITH RECURSIVE {PUBLISHED_SQL} SELECT {UUID.format('d')} AS point_id, url, CAST(chunk_index AS INT) AS chunk_index, sha256({EMBEDDING_TEXT}) AS input_hash, 16 AS dimension, true AS posted FROM points",
    published_documents: f"WITH {PAGES} SELECT 'site' AS source, '1' AS version, url, title, sha256(markdown) AS content_hash FROM pages WHERE markdown IS NOT NULL AND url <> ''",
    published_sources: f"WITH RECURSIVE {PUBLISHED_SQL} SELECT 'site' AS source, '1' AS default_version, '1' AS version, (SELECT count(*) FROM kept) AS document_count, (SELECT count(*) FROM points) AS chunk_count, true AS complete",
}
QUERIES = tuple(SQL)


def queries():
    return {query.__name__: query for query in QUERIES}


def oracle_sql():
    return {query.__name__: sql for query, sql in SQL.items()}
