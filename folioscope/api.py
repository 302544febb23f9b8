"""The whole workflow as functions: scrape, retry, index, ingest, search, get, sources, documents."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.ids import safe_path
from folioscope.functions.text import printed
from folioscope.functions.urls import scope_test
from folioscope.operators import search as s
from folioscope.operators.crawl import CrawlSettings, Crawled, Fetch, SourceSpec, crawl, http_fetch
from folioscope.operators.crawl import retry as retry_crawl
from folioscope.operators.dense import Embed
from folioscope.operators.index import index as index_crawl
from folioscope.sources.artifact import read_artifact, write_artifact
from folioscope.sources.store import DEFAULT_RETENTION, SnapshotStore

# Fixed values of the printed forms.
NO_SOURCES = "No indexed documentation sources.\n"
NO_DOCUMENTS = "No indexed documents.\n"


def retry_settings(stored: CrawlSettings | None, **given) -> CrawlSettings:
    """Stored settings with the crawl's defaults where they are absent; what is given explicitly wins.

    Settings that are all zero stem from an old artifact: they also get the default throttle and retries.
    """
    default = CrawlSettings()
    if stored is None or not any(vars(stored).values()):
        settings = default
    else:
        absent = {k: getattr(default, k) for k in ("workers", "timeout", "backoff") if getattr(stored, k) <= 0}
        settings = replace(stored, **absent)
    settings = replace(settings, **{k: v for k, v in given.items() if v is not None})
    if settings.workers <= 0 or settings.max_retries < 0:
        raise ValueError("workers must be positive and retries non-negative")
    return settings


def artifact_name(spark: SparkSession, spec: SourceSpec) -> str:
    """Source and version as a path of safe names."""
    parts = spark.range(1).select(safe_path(F.lit(spec.source)), safe_path(F.lit(spec.version or "unversioned"))).first()
    return "/".join(parts)


def site_fetch(spec: SourceSpec, settings: CrawlSettings | None = None) -> Fetch:
    """Pages of the source's site from the network; redirects must stay in the seed's scope."""
    return http_fetch(settings or CrawlSettings(), scope_test(spec.seed_url))


def scrape(spark: SparkSession, spec: SourceSpec, fetch: Fetch, root: str, name: str | None = None, **watch) -> Crawled:
    """Crawl and write the artifact, also when pages failed or the crawl was cancelled; ``Crawled.check()`` raises then.

    ``watch``: ``progress`` and ``cancelled`` as in ``crawl``.
    """
    if not spec.source or not spec.content_selector:
        raise ValueError("source and content selector are required")
    started = datetime.now(UTC)
    crawled = crawl(spark, spec, fetch, **watch)
    write_artifact(spark, crawled, root, name or artifact_name(spark, spec), started, datetime.now(UTC))
    return crawled


def retry(
    spark: SparkSession, root: str, name: str, fetch: Fetch | Callable[[SourceSpec, CrawlSettings], Fetch] = site_fetch, selectors: list[str] | None = None,
    overrides: dict | None = None, **watch,
) -> Crawled:
    """Crawl again what is missing from an artifact and write the merged one; a complete artifact is not touched.

    ``fetch`` is called with the source and the artifact's own settings (``retry_settings``, with ``overrides``) if it
    is a function of both; a fetching function made before is used as it is.
    """
    manifest, old = read_artifact(spark, root, name)
    if old.complete:
        return old
    settings = retry_settings(old.settings, **(overrides or {}))
    own = fetch(old.spec, settings) if len(signature(fetch).parameters) > 1 else fetch
    merged = retry_crawl(spark, old, own, selectors, settings=settings, **watch)
    write_artifact(spark, merged, root, name, datetime.fromisoformat(manifest["started_at"]), datetime.now(UTC))
    return merged


def index(spark: SparkSession, root: str, name: str, store: SnapshotStore, embed: Embed, **options) -> dict:
    return index_crawl(spark, read_artifact(spark, root, name)[1], store, embed, **options)


def ingest(
    spark: SparkSession, spec: SourceSpec, fetch: Fetch, root: str, store: SnapshotStore, embed: Embed, allow_incomplete: bool = False, retention: int = DEFAULT_RETENTION, **options
) -> dict:
    """Scrape and index; stops after the scrape if pages failed, unless that is allowed."""
    crawled = scrape(spark, spec, fetch, root)
    if not allow_incomplete:
        crawled.check()
    return index_crawl(spark, crawled, store, embed, allow_incomplete=allow_incomplete, retention=retention, **options)


def search(
    spark: SparkSession, store: SnapshotStore, query: str, source: str, embed: Embed, version: str | None = None, limit: int | None = None,
    candidates: int | None = None, mode: str = "hybrid", reranker: Callable[[str, list[str]], list[tuple[int, float]]] | None = None,
) -> DataFrame:
    """The results of one query over one source's active snapshot.

    The lexical list comes from the snapshot's postings, which hold the whole embedding texts (title, headings and URL
    too); only the row groups of the query's terms are read. ``reranker``: a service (``HttpReranker``) or any function
    of a query and its candidates' texts; without one the query's words contained are counted.
    """
    if not query.strip() or not source:
        raise ValueError("query and source are required")
    vectors = embed([query])
    if len(vectors) != 1:
        raise ValueError(f"expected one query vector, got {len(vectors)}")
    asked = spark.createDataFrame([(0, query, [float(x) for x in vectors[0]])], "query_no int, asked string, query_vector array<float>")
    stored = store.chunks(source, version).withColumnRenamed("source", "source_id")
    posted = None
    if mode == "hybrid":
        terms = [r.term for r in s.postings(asked, "query_no", "asked").collect()]  # those of one query
        if not terms:
            raise ValueError("the query has no searchable term")
        posted = store.postings(source, version).where(F.col("term").isin(terms))
    rerank = s.service_scores(reranker) if reranker else None
    found = s.search(asked, stored, "query_no", "asked", "query_vector", "point_id", limit, candidates, mode, rerank, posted, stored.count())
    return found.orderBy("rank")


def get(store: SnapshotStore, source: str, url: str, version: str | None = None) -> str:
    """A page's Markdown with one final newline."""
    return store.get_document(source, version, url).select(printed(F.col("markdown"))).first()[0]


def sources(store: SnapshotStore, style: str = "text") -> str:
    catalog = store.list_sources()
    if style == "json":
        return json.dumps(catalog, indent=2, ensure_ascii=False) + "\n"
    if not catalog["sources"]:
        return NO_SOURCES
    lines = []
    for source in catalog["sources"]:
        lines.append(f"{source.get('display_name') or source['source']} (source: {source['source']})")
        for v in source["versions"]:
            default = " [default]" if v["version"] == source["default_version"] else ""
            lines.append(f"  {v['version'] or 'unversioned'}{default}: {v['document_count']} documents, {v['chunk_count']} chunks")
    return "\n".join(lines) + "\n"


def documents(store: SnapshotStore, source: str, version: str | None = None, style: str = "text") -> str:
    """The listing of a source's pages as text; for large sources use ``SnapshotStore.list_documents``."""
    rows = [r.asDict() for r in store.list_documents(source, version).collect()]
    if style == "json":
        shown = version or next((r["version"] for r in rows), "") or ""
        return json.dumps({"schema_version": 1, "source": source, "version": shown, "documents": rows}, indent=2, ensure_ascii=False, default=str) + "\n"
    return "".join(f"{r['title']}\n  {r['url']}\n" if r["title"] else f"{r['url']}\n" for r in rows) or NO_DOCUMENTS
