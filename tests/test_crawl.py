import hashlib
import json
import time
import uuid
from datetime import datetime
from pathlib import Path

import pytest

from folioscope import session
from folioscope.functions.ids import EmbeddingProfile
from folioscope.functions.urls import scope_test
from folioscope.operators import catalog
from folioscope.operators.crawl import EVENT, Crawled, CrawlError, CrawlSettings, SourceSpec, Slots, crawl, fetch_with_retries, http_fetch, percent_done, reachable, retry, table_fetch
from folioscope.operators.index import index
from folioscope.session import discard, materialize, scratch
from folioscope.sources.artifact import read_artifact, write_artifact
from folioscope.sources.providers import HashingEmbedder
from folioscope.sources.store import DocumentNotFoundError, ReindexRequiredError, SnapshotStore, SourceNotFoundError

SEED = "https://docs.example.com/en/stable"
PAGES = "url string, status int, content_type string, body string, redirect_to string"
T = datetime(2025, 1, 1)


def site(spark, rows):
    full = [(u if u.startswith("http") else SEED + u, s, k, b, (t if t.startswith("http") else SEED + t) if t else None) for u, s, k, b, t in rows]
    return table_fetch(spark.createDataFrame(full, PAGES))


def page(links, body="<main>text</main>"):
    return "<title>t</title>" + "".join(f'<a href="{x}">x</a>' for x in links) + body


def spec(**more):
    return SourceSpec("docs", SEED, "main", **more)


ROWS = [
    ("", 200, "text/html", page(["/en/stable/a", "/en/stable/b#x", "/en/v1/old", "/en/stable/file.pdf", "/en/stable/lost", "https://docs.example.com/en/stable/moved"]), None),
    ("/a", 200, "text/html", page(["/en/stable/b", "/en/stable"]), None),
    ("/b", 200, "text/html", page(["/en/stable/c"], "<div>no root</div>"), None),
    ("/c", 200, "text/html", page([]), None),
    ("/file.pdf", 200, "application/pdf", "%PDF-", None),
    ("/moved", 302, None, None, "/a"),
    ("/fresh", 200, "text/html", '<meta http-equiv=refresh content="0; url=/en/stable/c">', None),
]


def events(crawled, kind):
    return sorted(r.url.removeprefix(SEED) for r in crawled.events.where(f"kind = '{kind}'").collect())


def test_crawl_and_retry(spark):
    got = crawl(spark, spec(), site(spark, ROWS), crawled_at=T)
    assert [r.url.removeprefix(SEED) for r in got.documents.collect()] == ["", "/a", "/c"]
    assert not got.complete and events(got, "selector_missing") == ["/b"] and events(got, "failed") == ["/lost"]
    assert "/file.pdf" in events(got, "skipped") and "https://docs.example.com/en/v1/old" in events(got, "skipped") and events(got, "redirected") == ["/moved"]
    with pytest.raises(CrawlError):
        got.check()
    repaired = [r for r in ROWS if r[0] != "/b"] + [("/b", 200, "text/html", page(["/en/stable/new"], "<div id=alt>found</div>"), None), ("/new", 200, "text/html", page([]), None), ("/lost", 200, "text/html", page([]), None)]
    again = retry(spark, got, site(spark, repaired), ["#alt", " ", "main"], crawled_at=T)
    assert [r.url.removeprefix(SEED) for r in again.documents.collect()] == ["", "/a", "/b", "/c", "/lost", "/new"] and again.complete
    assert again.spec.content_selectors == ["#alt"] and retry(spark, again, None) is again


def test_meta_refresh_and_seed_rules(spark):
    got = crawl(spark, spec(), site(spark, [("", 200, "text/html", page(["/en/stable/fresh"]), None), *ROWS[3:4], ROWS[6]]), crawled_at=T)
    assert [r.url.removeprefix(SEED) for r in got.documents.collect()] == ["", "/c"] and got.complete and events(got, "redirected") == ["/fresh"]
    failed = crawl(spark, spec(), site(spark, [("", 200, "application/json", "{}", None)]), crawled_at=T)
    assert failed.failed == 1 and failed.documents.count() == 0
    with pytest.raises(ValueError):
        crawl(spark, spec(), site(spark, ROWS), ["https://elsewhere.example.com/"])


def test_retries_and_backoff():
    answers, waits = [(503, "u", None, b"", []), OSError("reset"), (200, "u", "text/html", b"x", [])], []

    def open_url(url):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    row = fetch_with_retries(open_url, CrawlSettings(), waits.append)("u")
    assert row["status"] == 200 and waits == [0.2, 0.4]
    answers[:] = [(404, "u", None, b"", [])]
    assert fetch_with_retries(open_url, CrawlSettings(), waits.append)("u")["status"] == 404 and len(waits) == 2


def test_reachable_with_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("c", None)], "src string, dst string")
    got = {r.url: r.level for r in reachable(links, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_retention(spark):
    rows = [("s", 1, "n1", False), ("s", 2, "n2", True), ("s", 3, "n3", False), ("s", 4, "n4", False), ("s", 5, "n5", True), ("t", 1, "m", False)]
    df = spark.createDataFrame(rows, "source string, at int, name string, active boolean")
    kept = {r.name for r in catalog.retained(df, "source", "at", "name", "active", 2).where("keep").collect()}
    assert kept == {"n5", "n4", "n2", "m"}


def test_artifact_round_trip(spark, tmp_path):
    got = crawl(spark, spec(tags=["x"]), site(spark, ROWS[:4]), crawled_at=T)
    write_artifact(spark, got, f"file://{tmp_path}", "docs", T, T)
    manifest, back = read_artifact(spark, f"file://{tmp_path}", "docs")
    assert manifest["complete"] is False and back.spec == got.spec and back.documents.count() == got.documents.count()
    broken = type(got)(got.spec, got.documents.selectExpr("* except (markdown)", "cast(null as string) as markdown"), got.events, True)
    with pytest.raises(ValueError):
        write_artifact(spark, broken, f"file://{tmp_path}", "docs", T, T)
    assert read_artifact(spark, f"file://{tmp_path}", "docs")[1].documents.count() == got.documents.count()
    write_artifact(spark, got, f"file://{tmp_path}", "docs", T, T)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["docs"]


def crawled(spark, texts, complete=True):
    rows = [(SEED + path, "t", hashlib.sha256(text.encode()).hexdigest(), T, text) for path, text in texts.items()]
    documents = spark.createDataFrame(rows, "url string, title string, content_hash string, crawled_at timestamp, markdown string")
    return Crawled(spec(version="1"), documents, spark.createDataFrame([], EVENT), complete)


def test_index_publish_and_lookup(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(SourceNotFoundError):
        store.resolve("docs")
    one = crawled(spark, {"": "# Top\n\nseed words", "/a": "words of a"})
    first = index(spark, one, store, HashingEmbedder(8), EmbeddingProfile("profile"), retention=1)
    assert first["embedded"] == 2 and index(spark, one, store, HashingEmbedder(8), EmbeddingProfile("profile"), retention=1)["embedded"] == 0
    changed = crawled(spark, {"": "# Top\n\nseed words", "/a": "other words"})
    third = index(spark, changed, store, HashingEmbedder(8), EmbeddingProfile("profile"), retention=1)
    assert (third["reused"], third["embedded"]) == (1, 1)
    assert index(spark, changed, store, HashingEmbedder(8), EmbeddingProfile("another"), retention=1)["embedded"] == 2
    names = [n for n in store.files.names() if n.startswith("docs__")]
    assert len(names) == 1 and store.resolve("docs") == store.resolve("docs", "1") == names[0]
    assert store.get_document("docs", None, SEED + "/a").first().markdown == "other words"
    with pytest.raises(DocumentNotFoundError):
        store.get_document("docs", "1", SEED + "/zzz")
    with pytest.raises(SourceNotFoundError):
        store.get_document("docs", "2", SEED)
    listed = store.list_sources()["sources"]
    assert [s["source"] for s in listed] == ["docs"] and listed[0]["default_version"] == "1" and listed[0]["versions"][0]["chunk_count"] == 2
    assert [r.url for r in store.list_documents("docs").collect()] == [SEED, SEED + "/a"]
    bad = crawled(spark, {"/b": "text"}, complete=False)
    with pytest.raises(ValueError):
        index(spark, bad, store, HashingEmbedder(8))
    assert store.resolve("docs") == names[0]
    meta = store.meta(names[0])
    store.files.write(f"{names[0]}/meta.json", json.dumps(meta | {"schema": 3}))
    with pytest.raises(ReindexRequiredError):
        store.get_document("docs", None, SEED)


def test_progress_steps():
    assert [percent_done(n, 11) for n in (1, 2, 6, 11)] == [0, 10, 50, 100]


def test_slots_keep_the_interval_between_threads():
    clock, waits = [0.0], []
    slots = Slots(0.5, lambda: clock[0], waits.append)
    for host in ("a", "a", "b", "a"):
        slots.wait(host)
    assert waits == [0.5, 1.0, 0.5, 1.5]
    clock[0] = 9.0
    slots.wait("a")
    assert waits[-1] == 0


def slow_opener(folder):
    """Pages that take 0.3 s each; every request leaves a file with its begin and end."""

    def build(allowed, settings):
        def open_url(url):
            began = time.time()
            time.sleep(0.3)
            (Path(folder) / uuid.uuid4().hex).write_text(f"{began} {time.time()}")
            links = [f"/en/stable/p{i}" for i in range(12)] if url == SEED else []
            return 200, url, "text/html", page(links).encode(), []

        return open_url

    return build


def test_one_site_is_fetched_by_all_workers_at_once(spark, tmp_path):
    fetch = http_fetch(CrawlSettings(workers=4, throttle=0.0), scope_test(SEED), slow_opener(str(tmp_path)))
    got = crawl(spark, spec(), fetch, crawled_at=T)
    assert got.documents.count() == 13 and got.complete and got.settings.workers == 4
    times = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    at_once = max(sum(a <= t < b for a, b in times) for t, _ in times)
    assert len(times) == 13 and at_once == 4


def test_cancelled_crawl_is_kept_and_taken_up_again(spark, tmp_path):
    told = []
    got = crawl(spark, spec(), site(spark, ROWS), crawled_at=T, cancelled=lambda: True, progress=lambda *x: told.append(x))
    assert [r.url for r in got.documents.collect()] == [SEED] and not got.complete
    assert "" in events(got, "failed") and "/a" in events(got, "failed") and told == [(10, 1, 6)]
    write_artifact(spark, got, f"file://{tmp_path}", "docs", T, T)
    back = read_artifact(spark, f"file://{tmp_path}", "docs")[1]
    whole = [("/lost", 200, "text/html", page([]), None), ("/b", 200, "text/html", page(["/en/stable/c"]), None), *(r for r in ROWS if r[0] not in ("/b",))]
    again = retry(spark, back, site(spark, whole), crawled_at=T)
    assert again.complete and [r.url.removeprefix(SEED) for r in again.documents.collect()] == ["", "/a", "/b", "/c", "/lost"]


def test_redirects_and_scope():
    allowed = scope_test(SEED)
    assert allowed(SEED) and allowed(SEED + "/x?y") and not allowed(SEED + "x") and not allowed("http://docs.example.com/en/stable") and scope_test("https://h/")("https://h/any")


def test_steps_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        assert materialize(spark.range(2), "inner").count() == 2 and len(list(tmp_path.iterdir())) == 2
    assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    discard(kept)
    discard(kept, spark.range(1))
    assert not list(tmp_path.iterdir())


def test_chains_and_circles_of_redirects(spark):
    moves = [(f"/r{i}", 301, None, None, f"/r{i + 1}") for i in range(12)] + [("/r12", 200, "text/html", page([]), None), ("/x", 302, None, None, "/y"), ("/y", 302, None, None, "/x"), ("/gone", 302, None, None, "/nowhere")]
    fetch = site(spark, moves)
    asked = spark.createDataFrame([(SEED + u,) for u in ("/r2", "/r1", "/x", "/gone", "/none", "/r12")], "url string")
    got = {r.requested.removeprefix(SEED): (r.final_url.removeprefix(SEED), r.status, len(r.hops), r.error) for r in fetch(asked).collect()}
    assert got["/r2"] == ("/r12", 200, 10, None) and got["/r12"] == ("/r12", 200, 0, None) and got["/none"] == ("/none", 404, 0, None)
    assert got["/gone"] == ("/nowhere", 404, 1, None)
    assert got["/r1"][3] == got["/x"][3] == "too many redirects"
