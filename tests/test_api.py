import json
from datetime import datetime

import pytest

from folioscope import api
from folioscope.operators.crawl import CrawlSettings
from folioscope.sources.providers import HashingEmbedder
from folioscope.sources.store import SnapshotStore
from folioscope.streaming import pages as streaming
from tests.test_crawl import ROWS, SEED, crawled, page, site, spec

T = datetime(2025, 1, 1)


def test_search_get_and_listings(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert api.sources(store) == api.NO_SOURCES
    api.index_crawl(spark, crawled(spark, {"/a": "# Install\n\nrun the installer", "/b": "remove everything"}), store, HashingEmbedder(16))
    found = api.search(spark, store, "installer", "docs", HashingEmbedder(16), limit=1).collect()
    assert [r.url for r in found] == [SEED + "/a"] and found[0].version == "1"
    assert api.get(store, "docs", SEED + "/b") == "remove everything\n"
    assert api.sources(store) == "docs (source: docs)\n  1 [default]: 2 documents, 2 chunks\n"
    assert api.documents(store, "docs") == f"t\n  {SEED}/a\nt\n  {SEED}/b\n"
    for query, source in (("", "docs"), ("x", "")):
        with pytest.raises(ValueError):
            api.search(spark, store, query, source, HashingEmbedder(16))
    with pytest.raises(ValueError):
        api.search(spark, store, "!!", "docs", HashingEmbedder(16))


def test_retry_settings():
    assert api.retry_settings(None) == api.retry_settings(CrawlSettings(0, 0, 0, 0, 0)) == CrawlSettings()
    assert api.retry_settings(CrawlSettings(0, 0.0, 5.0, 0, 0.0)) == CrawlSettings(4, 0.0, 5.0, 0, 0.2)
    assert api.retry_settings(CrawlSettings(), workers=9).workers == 9
    with pytest.raises(ValueError):
        api.retry_settings(None, max_retries=-1)


def test_words_of_titles_headings_and_urls_are_found(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    flat = lambda texts: [[1.0, 0.0] for _ in texts]
    pages = crawled(spark, {"/a": "# Zebra\n\nplain words", "/b": "other words", "/giraffe": "more words"})
    pages.documents = pages.documents.selectExpr("* except (title)", "if(url like '%/b', 'Lion', 't') as title")
    api.index_crawl(spark, pages, store, flat)
    first = lambda query: api.search(spark, store, query, "docs", flat, reranker=lambda _, texts: [(i, 1.0) for i in range(len(texts))]).first()
    assert [first(q).url.removeprefix(SEED) for q in ("zebra", "lion", "giraffe")] == ["/a", "/b", "/giraffe"]
    assert first("lion").sparse_score > 0 and store.postings("docs").columns == ["point_id", "term", "weight"]


def test_reranking_service(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    api.index_crawl(spark, crawled(spark, {"/a": "alpha one", "/b": "beta two", "/c": "gamma three"}), store, HashingEmbedder(16))
    service = lambda query, texts: [(i, float("two" in t) - float("one" in t)) for i, t in enumerate(texts) if "three" not in t]
    got = api.search(spark, store, "alpha", "docs", HashingEmbedder(16), reranker=service).collect()
    assert [(r.url.removeprefix(SEED), r.reranker_score) for r in got] == [("/b", 1.0), ("/a", -1.0)]


def test_chunk_count_is_counted_where_metadata_lacks_it(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    done = api.index_crawl(spark, crawled(spark, {"/a": "alpha", "/b": "beta"}), store, HashingEmbedder(4))
    meta = store.meta(done["physical"])
    store.files.write(f"{done['physical']}/meta.json", json.dumps(meta | {"chunk_count": 0}))
    assert store.list_sources()["sources"][0]["versions"][0]["chunk_count"] == 2


def test_vectors_are_reused_under_one_profile_only(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    page = crawled(spark, {"/a": "alpha"})
    embedded = lambda embed, **more: api.index_crawl(spark, page, store, embed, **more)["embedded"]
    assert [embedded(HashingEmbedder(4)), embedded(HashingEmbedder(4)), embedded(HashingEmbedder(8))] == [1, 0, 1]
    plain = lambda texts: [[1.0] for _ in texts]
    assert [embedded(plain, model="m1"), embedded(plain, model="m1"), embedded(plain, model="m2")] == [1, 0, 1]


def test_artifact_settings_and_retry_overrides(spark, tmp_path):
    root, told = f"file://{tmp_path}/art", []
    fetch = site(spark, ROWS[:4])
    fetch.settings = CrawlSettings(workers=7, throttle=0.0)
    name = "docs"
    assert api.scrape(spark, spec(), fetch, root, name, progress=lambda *x: told.append(x)).settings.workers == 7
    assert told[-1][0] == 100 and api.read_artifact(spark, root, name)[1].settings == CrawlSettings(workers=7, throttle=0.0)
    seen = []

    def build(source, settings):
        seen.append(settings)
        return site(spark, [("/b", 200, "text/html", page([]), None), ("/lost", 200, "text/html", page([]), None), ("/file.pdf", 200, "application/pdf", "", None), ("/moved", 302, None, None, "/a"), ROWS[1]])

    merged = api.retry(spark, root, name, build, overrides={"max_retries": 1})
    assert merged.complete and seen == [CrawlSettings(workers=7, throttle=0.0, max_retries=1)]
    assert api.read_artifact(spark, root, name)[1].settings == seen[0] and api.retry(spark, root, name, None).complete


def test_stream(spark, tmp_path):
    rows = [("s", "1", "https://h/a#x", "<title>A</title><main><h1>A</h1><p>text</main>", T), ("s", "1", "https://h/a", "<main>again</main>", T), ("s", "1", "https://h/b", "<div>none</div>", T)]
    spark.createDataFrame(rows, streaming.PAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    query = streaming.write_chunks(streaming.read_pages(spark, f"{tmp_path}/in"), ["main"], lambda df, n: got.extend(df.collect()), f"{tmp_path}/check")
    query.awaitTermination()
    assert [(r.url, r.chunk_index) for r in got] == [("https://h/a", 0)]
