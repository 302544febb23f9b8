"""Queries on crawls, events, catalogs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.html import from_markdown, parse_pages
from folioscope.functions.ids import sha_of, stored_point_id
from folioscope.functions.text import printed
from folioscope.functions.urls import canonical_url
from folioscope.operators import catalog
from folioscope.operators.crawl import SourceSpec, reachable
from folioscope.operators.index import page_points
from folioscope.operators.snapshot_diff import hex_digits
from folioscope.plans.snapshots import CANONICAL_URL_SQL
from folioscope.plans.texts import PAGES, UUID, pages
from folioscope.session import table
from folioscope.sources.artifact import verify_hashes
from folioscope.sources.store import with_identity

c = F.col


def catalog_rollup(spark, sf_dir):
    """Sources with their versions and page counts; the version crawled last is the default."""
    counted = pages(spark, sf_dir).groupBy("source_id", "version").agg(F.count("*").alias("document_count"), F.max("crawled_at").alias("indexed_at"))
    newest = F.row_number().over(Window.partitionBy("source_id").orderBy(c("indexed_at").desc(), F.coalesce("version", F.lit("")))) == 1
    names = table(spark, sf_dir, "sources").select("source_id", F.coalesce("version", F.lit("")).alias("v"), "display_name")
    named = counted.withColumn("is_default", newest).withColumn("v", F.coalesce("version", F.lit(""))).join(names, ["source_id", "v"])
    rolled = catalog.source_catalog(named, "source_id", "version", "is_default", ["display_name"], ["document_count"])
    listed = F.array_join(F.transform("versions", lambda x: F.concat(x["version"], F.lit(":"), x["document_count"].cast("string"))), ",")
    return rolled.select("source_id", "default_version", "display_name", listed.alias("versions"))


def document_listing(spark, sf_dir):
    """Pages with a URL, with their store ids; vectors and texts are not read."""
    rows = pages(spark, sf_dir).where("url <> ''")
    return rows.select("source_id", "version", "url", "title", stored_point_id(sha_of("document", c("source_id"), c("url"))).alias("document_point_id"))


def document_lookup(spark, sf_dir):
    """One page by its deterministic id, as the source and URL of the lowest-numbered page give it."""
    rows = pages(spark, sf_dir)
    first = rows.orderBy("page_no").select("source_id", "url").first()
    documents = page_points(rows.withColumnRenamed("source_id", "source"))
    return with_identity(documents, first.source_id, first.url).select("document_point_id", "version", "url", F.md5("markdown").alias("body"))


def page_output(spark, sf_dir):
    """A page's Markdown as printed."""
    return pages(spark, sf_dir).select("page_no", F.md5(printed(c("markdown"))).alias("printed"))


def hash_check(spark, sf_dir):
    """Stored pages whose body has the stored hash."""
    rows = pages(spark, sf_dir).withColumn("url", c("page_no").cast("string"))
    return verify_hashes(rows).select(c("url").cast("bigint").alias("page_no"), "intact")


def snapshot_retention(spark, sf_dir):
    """Crawls kept per source: the newest two and all active ones (complete, the newest of their version)."""
    rows = table(spark, sf_dir, "manifests").where("completed_at is not null")
    newest = F.row_number().over(Window.partitionBy("source_id", "version").orderBy(F.when(c("complete"), c("completed_at")).desc_nulls_last(), "manifest_no")) == 1
    named = rows.withColumn("active", newest & c("complete"))
    return catalog.retained(named, "source_id", "completed_at", "manifest_no", "active", 2).select("manifest_no", "active", "keep")


def events_of(spark, sf_dir) -> DataFrame:
    """Page events derived from the crawls' listings: fetched, failed (no URL), without content (no hash)."""
    rows = table(spark, sf_dir, "page_snapshots")
    kind = F.when(c("url").isNull() | (c("url") == ""), "failed").when(c("content_hash").isNull(), "selector_missing").otherwise("fetched")
    return rows.select("manifest_no", kind.alias("kind"), F.coalesce("url", F.lit("")).alias("url"), F.lit(200).alias("status"), c("title").alias("detail"), F.when(c("url") != "", canonical_url(c("url"))).alias("target"))


def page_events(spark, sf_dir):
    """Distinct events of all crawls."""
    found = catalog.distinct_events(events_of(spark, sf_dir).drop("manifest_no"))
    return found.select("kind", "url", "status", "detail")


def crawl_completeness(spark, sf_dir):
    """Per crawl: failures and pages without content, and whether it counts as complete."""
    return catalog.is_complete(events_of(spark, sf_dir).dropDuplicates(["manifest_no", "kind", "url", "detail"]), "manifest_no")


def retry_urls(spark, sf_dir):
    """URLs to crawl again."""
    return catalog.retry_targets(events_of(spark, sf_dir))


def merged_series(spark, sf_dir):
    """The pages of all crawls of every series, each crawl replacing by URL what the ones before it left or adding to it.

    Within a crawl and canonical URL the row of the latest crawl time counts, then of the latest delivery, then the higher hash.
    """
    listing = table(spark, sf_dir, "page_snapshots").where("url <> ''").select("manifest_no", canonical_url(c("url")).alias("url"), hex_digits(c("content_hash")).alias("content_hash"), "crawled_at", "loaded_at")
    crawls = table(spark, sf_dir, "manifests").select("manifest_no", "source_id", "version", "snapshot_seq")
    order = ["snapshot_seq", "crawled_at", "loaded_at", "content_hash"]
    return catalog.fold_documents(listing.join(crawls, "manifest_no"), ["source_id", "version", "url"], order, ["snapshot_seq", "content_hash"])


def content_selectors(spark, sf_dir):
    """The selectors of a source in order, the primary one first, without repeats and blanks."""

    @F.udf("string", useArrow=True)
    def joined(primary: str | None, others: list[str] | None) -> str:
        return " | ".join(SourceSpec("", "", primary or "", content_selectors=others or []).selectors())

    return table(spark, sf_dir, "sources").select("source_id", "version", joined("content_selector", "content_selectors").alias("selectors"))


def links_of(spark, sf_dir) -> DataFrame:
    """A link table over the stored pages: each links its two neighbours in a binary tree, back to its parent, and one page far away."""
    own = pages(spark, sf_dir).select("page_no")
    to = F.array(c("page_no") * 2, c("page_no") * 2 + 1, F.floor(c("page_no") / 2), (c("page_no") * 7) % 101)
    return own.select(c("page_no").alias("src"), F.explode(to).alias("dst"))


def reachable_pages(spark, sf_dir):
    """Pages by their distance from page 3 over the link table."""
    links = links_of(spark, sf_dir).join(pages(spark, sf_dir).select(c("page_no").alias("dst")), "dst", "left_semi")
    return reachable(links, spark.sql("select cast(3 as bigint) as url")).select(c("url").alias("page_no"), "level")


def parsed_pages(spark, sf_dir):
    """Title, links and content of HTML pages that hold the whole stored texts, in all scripts and with all their marks.

    The stored Markdown is turned into HTML, wrapped, and parsed again; what comes back is compared by its letters.
    """
    content = F.udf(from_markdown, "string", useArrow=True)
    title = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(
        F.lit("<html><head><meta charset=utf-8><title>\n "), title, F.lit(" </title><script>var x = '<p>no</p>';</script></head><body><nav><a href='"), c("url"),
        F.lit("#top'>here</a><a href=\"/root?q=1\">root</a><a href=\"/root?q=1\">again</a></nav><main id=\"content\"><h2>Page</h2>"), content(F.coalesce("markdown", F.lit(""))),
        F.lit("<p>End of <b>page</b></main></body></html>"),
    )
    found = pages(spark, sf_dir).where("url is not null").select("page_no", "url", body.alias("html"))
    return parse_pages(found, ["page_no"], "url", "html", ["article", "main#content"]).select("page_no", "title", "links", "markdown", "missing")


def page_heads(spark, sf_dir):
    """Of the parsed pages: title, the links around the content (once each), and the letters of the content."""
    rows = parsed_pages(spark, sf_dir)
    around = F.filter("links", lambda x: F.endswith(x, F.lit("#top")) | F.endswith(x, F.lit("/root?q=1")))
    return rows.select("page_no", "title", F.array_join(around, " ").alias("links"), F.md5(F.regexp_replace("markdown", r"[^\p{L}]+", "")).alias("letters"), "missing")


SQL = {
    catalog_rollup: f"""
WITH {PAGES}, counted AS (SELECT source_id, coalesce(version, '') AS version, count(*) AS n, max(crawled_at) AS last_at FROM pages GROUP BY source_id, coalesce(version, '')),
d AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_at DESC, version) = 1 AS is_default FROM counted)
SELECT d.source_id, max(CASE WHEN is_default THEN d.version END) AS default_version, max(CASE WHEN is_default THEN s.display_name END) AS display_name,
  string_agg(d.version || ':' || n, ',' ORDER BY d.version) AS versions
FROM d JOIN sources s ON s.source_id = d.source_id AND coalesce(s.version, '') = d.version GROUP BY d.source_id""",
    document_listing: f"""
WITH {PAGES}, h AS (SELECT *, sha256('document' || chr(0) || source_id || chr(0) || url) AS d FROM pages WHERE url <> '')
SELECT source_id, version, url, title, {UUID.format('d')} AS document_point_id FROM h""",
    document_lookup: f"""
WITH {PAGES}, h AS (SELECT *, sha256('document' || chr(0) || source_id || chr(0) || url) AS d FROM pages), w AS (SELECT d FROM h ORDER BY page_no LIMIT 1)
SELECT {UUID.format('d')} AS document_point_id, version, url, md5(markdown) AS body FROM h WHERE d IN (SELECT d FROM w)""",
    page_output: f"WITH {PAGES} SELECT page_no, md5(CASE WHEN coalesce(markdown, '') LIKE '%' || chr(10) THEN markdown ELSE coalesce(markdown, '') || chr(10) END) AS printed FROM pages",
    hash_check: f"WITH {PAGES} SELECT page_no, coalesce(sha256(markdown) = content_hash, false) AS intact FROM pages",
    snapshot_retention: """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id, version ORDER BY CASE WHEN complete THEN completed_at END DESC NULLS LAST, manifest_no) = 1 AND complete AS active
  FROM manifests WHERE completed_at IS NOT NULL)
SELECT manifest_no, active, active OR row_number() OVER (PARTITION BY source_id ORDER BY completed_at DESC, manifest_no DESC) <= 2 AS keep FROM r""",
    page_events: """
SELECT DISTINCT CASE WHEN url IS NULL OR url = '' THEN 'failed' WHEN content_hash IS NULL THEN 'selector_missing' ELSE 'fetched' END AS kind,
  coalesce(url, '') AS url, 200::INT AS status, title AS detail FROM page_snapshots""",
    crawl_completeness: """
WITH e AS (SELECT DISTINCT manifest_no, CASE WHEN url IS NULL OR url = '' THEN 'failed' WHEN content_hash IS NULL THEN 'selector_missing' ELSE 'fetched' END AS kind, coalesce(url, '') AS url, title FROM page_snapshots)
SELECT manifest_no, count(*) FILTER (kind = 'failed') AS failed, count(*) FILTER (kind = 'selector_missing') AS missing, count(*) FILTER (kind <> 'fetched') = 0 AS complete FROM e GROUP BY manifest_no""",
    retry_urls: "SELECT DISTINCT coalesce(url, '') AS url FROM page_snapshots WHERE url IS NULL OR url = '' OR content_hash IS NULL",
    content_selectors: """
WITH listed AS (SELECT *, list_filter(list_concat([content_selector], coalesce(content_selectors, [])), lambda x: trim(coalesce(x, '')) <> '') AS chosen FROM sources)
SELECT source_id, version, array_to_string(list_filter(chosen, lambda x, i: list_position(chosen, x) = i), ' | ') AS selectors FROM listed""",
    reachable_pages: """
WITH RECURSIVE own AS (SELECT DISTINCT page_no FROM stored_pages),
links AS (SELECT page_no AS src, unnest([page_no * 2, page_no * 2 + 1, page_no // 2, (page_no * 7) % 101]) AS dst FROM own),
valid AS (SELECT src, dst FROM links WHERE dst IN (SELECT page_no FROM own)),
walk AS (SELECT 3::BIGINT AS page_no, 0 AS level UNION SELECT v.dst, w.level + 1 FROM walk w JOIN valid v ON v.src = w.page_no WHERE w.level < 40)
SELECT page_no, CAST(min(level) AS INT) AS level FROM walk GROUP BY page_no""",
    page_heads: r"""
WITH p AS (SELECT DISTINCT ON (page_no) * FROM stored_pages WHERE url IS NOT NULL)
SELECT page_no, trim(coalesce(title, '')) AS title, array_to_string(list_sort([url || '#top', regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || '/root?q=1']), ' ') AS links,
  md5('Page' || regexp_replace(coalesce(markdown, ''), '[^\p{L}]+', '', 'g') || 'Endofpage') AS letters, false AS missing FROM p""",
}

SQL[merged_series] = rf"""
WITH page_rows AS (
  SELECT m.source_id, m.version, m.snapshot_seq, p.url, p.crawled_at, p.loaded_at, nullif(regexp_extract(lower(trim(p.content_hash)), '(?:^|[^0-9a-z])([0-9a-f]+)$', 1), '') AS hash
  FROM page_snapshots p JOIN manifests m USING (manifest_no) WHERE p.url <> ''
), {CANONICAL_URL_SQL}
SELECT source_id, version, canonical_url AS url, snapshot_seq, hash AS content_hash FROM canonical
QUALIFY row_number() OVER (PARTITION BY source_id, version, canonical_url ORDER BY snapshot_seq DESC, crawled_at DESC NULLS LAST, loaded_at DESC NULLS LAST, hash DESC NULLS LAST) = 1"""

QUERIES = (*SQL, parsed_pages)


def queries():
    return {query.__name__: query for query in QUERIES}


def oracle_sql():
    return {query.__name__: sql for query, sql in SQL.items()}
