"""Level-synchronous crawl as a loop of DataFrame steps, over a page table or a fetching function."""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions.batches import small_batches
from folioscope.functions.html import decode, is_html, media_type, parse_page, parse_selector
from folioscope.functions.ids import artifact_document_id, content_hash, document_filename
from folioscope.functions.urls import canonical_url, in_scope
from folioscope.operators.catalog import distinct_events, is_complete, merge_documents, merge_events, retry_targets
from folioscope.session import checkpoint_folder, delete_on_exit, discard, materialize

MAX_REDIRECTS = 10
FETCHED = "requested string, final_url string, status int, content_type string, body binary, hops array<struct<url:string,status:int,target:string>>, error string"
PARSED = "requested string, final_url string, status int, is_html boolean, media string, error string, hops array<struct<url:string,status:int,target:string>>, title string, links array<string>, markdown string, missing boolean, refresh string"
EVENT = "kind string, url string, status int, detail string, target string"


@dataclass
class SourceSpec:
    source: str
    seed_url: str
    content_selector: str
    version: str = ""
    display_name: str = ""
    description: str = ""
    tags: list[str] = field(default_factory=list)
    content_selectors: list[str] = field(default_factory=list)

    def selectors(self) -> list[str]:
        """The primary selector and the others, in order, without repeats and blank ones."""
        return list(dict.fromkeys(s for s in [self.content_selector, *(self.content_selectors or [])] if s and s.strip()))


@dataclass
class CrawlSettings:
    """Durations in seconds; the defaults of a crawl."""

    workers: int = 4
    throttle: float = 0.1
    timeout: float = 20.0
    max_retries: int = 3
    backoff: float = 0.2


class CrawlError(RuntimeError):
    """Some pages failed or missed the content; carries what was crawled."""

    def __init__(self, artifact: "Crawled", failed: int, missing: int):
        super().__init__(f"crawl incomplete: {failed} failed, {missing} without content")
        self.artifact = artifact


@dataclass
class Crawled:
    spec: SourceSpec
    documents: DataFrame
    events: DataFrame
    complete: bool
    failed: int = 0
    missing: int = 0
    settings: CrawlSettings | None = None

    def check(self) -> Crawled:
        if not self.complete:
            raise CrawlError(self, self.failed, self.missing)
        return self


Fetch = Callable[[DataFrame], DataFrame]


def fetch_with_retries(open_url: Callable[[str], tuple[int, str, str | None, bytes, list]], settings: CrawlSettings, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """A page by retrying transport errors, 429 and 5xx, with doubling waits; other errors end at once.

    ``open_url`` gives status, final URL, content type, body and the redirects taken.
    """

    def fetch(url: str) -> dict:
        row = {"requested": url, "final_url": url, "status": None, "content_type": None, "body": None, "hops": [], "error": None}
        for attempt in range(settings.max_retries + 1):
            if attempt:
                sleep(settings.backoff * 2 ** (attempt - 1))
            try:
                status, final, kind, body, hops = open_url(url)
            except PermissionError as error:  # a redirect out of scope
                return row | {"error": f"out of scope: {error}"}
            except (OSError, ValueError) as error:
                row["error"] = str(error)
                continue
            row |= {"status": status, "final_url": final, "content_type": kind, "body": body, "hops": hops, "error": None}
            if status != 429 and status < 500:
                break
        return row

    return fetch


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


class Slots:
    """When each host may be asked next. Threads share it; a host met for the first time waits a whole interval.

    So the interval holds from one level, that is task or Python worker, to the next without shared memory.
    """

    def __init__(self, interval: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.now, self.sleep = interval, now, sleep
        self.next: dict[str, float] = {}
        self.lock = threading.Lock()

    def wait(self, host: str) -> None:
        with self.lock:
            slot = max(self.now(), self.next.get(host, self.now() + self.interval))
            self.next[host] = slot + self.interval
        self.sleep(max(0.0, slot - self.now()))


def http_opener(allowed: Callable[[str], bool], settings: CrawlSettings) -> Callable[[str], tuple]:
    """GET with the crawl's headers, at most 10 redirects, each of which must stay in scope; a slot per host and throttle."""
    opener = urllib.request.build_opener(_NoRedirect)
    wait = Slots(settings.throttle).wait

    def open_url(url: str) -> tuple:
        hops: list[dict] = []
        while True:
            wait(urlsplit(url).netloc)
            request = urllib.request.Request(url, headers={"User-Agent": "folioscope/1.0", "Accept": "text/html, application/xhtml+xml"})
            try:
                with opener.open(request, timeout=settings.timeout) as got:
                    return got.status, url, got.headers.get("Content-Type"), got.read(), hops
            except urllib.error.HTTPError as error:
                target = error.headers.get("Location")
                if error.code not in (301, 302, 303, 307, 308) or not target:
                    return error.code, url, error.headers.get("Content-Type"), error.read(), hops
                target = urljoin(url, target)
                if len(hops) >= MAX_REDIRECTS:
                    raise ValueError("too many redirects") from None
                if not allowed(target):
                    raise PermissionError(target) from None
                hops.append({"url": url, "status": error.code, "target": target})
                url = target

    return open_url


FETCHED_ARROW = pa.schema([
    ("requested", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()),
    ("hops", pa.list_(pa.struct([("url", pa.string()), ("status", pa.int32()), ("target", pa.string())]))), ("error", pa.string()),
])


def http_fetch(settings: CrawlSettings, allowed: Callable[[str], bool], opener: Callable[..., Callable[[str], tuple]] = http_opener) -> Fetch:
    """Pages from the network: a host's URLs go to one task, which has up to ``workers`` of them under way at once.

    The throttle's slots are shared by the task's threads. Pages leave the task as they come, ``workers`` at a time.
    """

    def fetch(frontier: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = fetch_with_retries(opener(allowed, settings), settings)
            with ThreadPoolExecutor(settings.workers) as pool:
                for batch in batches:
                    urls = batch.column(0).to_pylist()
                    waiting = [pool.submit(one, u) for u in urls[: 2 * settings.workers]]
                    for at in range(0, len(urls), settings.workers):
                        rows = [f.result() for f in waiting[: settings.workers]]
                        after = at + 2 * settings.workers
                        waiting = waiting[settings.workers :] + [pool.submit(one, u) for u in urls[after : after + settings.workers]]
                        yield from pa.Table.from_pylist(rows, FETCHED_ARROW).to_batches()

        hosts = frontier.repartition(settings.workers, F.regexp_extract("url", "^[^/]+//([^/]+)", 1))
        return hosts.select("url").mapInArrow(run, FETCHED)

    fetch.settings = settings
    return fetch


def table_fetch(pages: DataFrame) -> Fetch:
    """Pages from a table: url, status, content_type, body (string or binary), redirect_to (null: none), without a network.

    Redirects are followed once for the whole table, in joins of the redirecting rows, at most ten; so a level of a crawl
    is one join. A URL the table lacks has status 404.
    """
    known = materialize(
        pages.select(
            canonical_url(F.col("url")).alias("at"), "status", "content_type", F.col("body").cast("binary").alias("body"), canonical_url(F.col("redirect_to")).alias("redirect_to")
        ),
        "pages",
    )
    hop = F.array(F.struct(F.col("at").alias("url"), F.coalesce("status", F.lit(302)).alias("status"), F.col("redirect_to").alias("target")))
    moves = known.where("redirect_to is not null").select(F.col("at").alias("from"), F.col("redirect_to").alias("to"), hop.cast("array<struct<url:string,status:int,target:string>>").alias("hop"))
    walked = moves.select(F.col("from").alias("requested"), F.col("to").alias("at"), F.col("hop").alias("hops"))
    for _ in range(MAX_REDIRECTS - 1):
        further = walked.join(moves, F.col("at") == F.col("from"), "left")
        walked, before = materialize(further.select("requested", F.coalesce("to", "at").alias("at"), F.when(F.col("to").isNotNull(), F.concat("hops", "hop")).otherwise(F.col("hops")).alias("hops"), F.col("to").isNotNull().alias("moved")), "redirects"), walked
        discard(before)
        still = not walked.where("moved").isEmpty()
        walked = walked.drop("moved")
        if not still:
            break
    own = known.where("redirect_to is null").select("at", "status", "content_type", "body")
    lost = walked.join(moves, F.col("at") == F.col("from"), "left_semi").select(
        "requested", F.col("at").alias("final_url"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("body"), "hops",
        F.lit("too many redirects").alias("error"),
    )
    ended = walked.join(moves, F.col("at") == F.col("from"), "left_anti").join(own, "at", "left")
    none = F.lit(None).cast("string")
    direct = own.select(F.col("at").alias("requested"), F.col("at").alias("final_url"), "status", "content_type", "body", F.array().cast("array<struct<url:string,status:int,target:string>>").alias("hops"), none.alias("error"))
    moved = ended.select("requested", F.col("at").alias("final_url"), F.coalesce("status", F.lit(404)).alias("status"), "content_type", "body", "hops", none.alias("error"))
    answers = materialize(direct.unionByName(moved).unionByName(lost), "answers")
    discard(known)

    def fetch(frontier: DataFrame) -> DataFrame:
        met = frontier.select(F.col("url").alias("requested")).join(answers.withColumn("there", F.lit(True)), "requested", "left")
        return met.select(
            "requested", F.coalesce("final_url", "requested").alias("final_url"), F.when(F.col("there"), F.col("status")).otherwise(404).alias("status"), "content_type", "body",
            F.coalesce("hops", F.array().cast("array<struct<url:string,status:int,target:string>>")).alias("hops"), "error",
        )

    return fetch


def parse_fetched(fetched: DataFrame, selectors: list[str]) -> DataFrame:
    """Media type, charset, and for HTML pages of status 2xx the parsed page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "body"):
            rows = []
            for r in batch.to_pylist():
                body = r.pop("body") or b""
                kind = media_type(r.pop("content_type"), body)
                good = r["error"] is None and r["status"] is not None and 200 <= r["status"] < 300
                page = {"title": "", "links": [], "markdown": None, "missing": False, "refresh": None}
                if good and is_html(kind):
                    try:
                        page = parse_page(r["final_url"], decode(body, kind), selectors)
                    except (ValueError, RecursionError) as error:
                        r["error"] = f"conversion: {error}"
                rows.append(r | {"is_html": is_html(kind), "media": kind} | page)
            yield from pa.Table.from_pylist(rows, PARSED_ARROW).to_batches()

    return fetched.mapInArrow(run, PARSED)


PARSED_ARROW = pa.schema([
    ("requested", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("is_html", pa.bool_()), ("media", pa.string()), ("error", pa.string()),
    FETCHED_ARROW.field("hops"), ("title", pa.string()), ("links", pa.list_(pa.string())), ("markdown", pa.string()), ("missing", pa.bool_()), ("refresh", pa.string()),
])


def _events(rows: DataFrame, kind: str, url: str, status, detail, target) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col(url).alias("url"), status.cast("int").alias("status"), detail.cast("string").alias("detail"), target.cast("string").alias("target"))


def percent_done(processed: int, discovered: int) -> int:
    """Crawl progress in steps of ten per cent."""
    return 100 if discovered <= 0 else processed * 10 // discovered * 10


class Grown:
    """A table in the shared folder that grows by one part at a time; no part is written again."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema, self.columns, self.parts = spark, schema, StructType.fromDDL(schema).names, 0
        self.path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        delete_on_exit(spark, self.path)

    def add(self, rows: DataFrame) -> DataFrame:
        """The part as it was written."""
        path = f"{self.path}/level={self.parts}"
        self.parts += 1
        rows.select(*self.columns).write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def whole(self) -> DataFrame:
        """All parts, with the number ``level`` of each."""
        if not self.parts:
            return self.spark.createDataFrame([], f"{self.schema}, level int")
        return self.spark.read.schema(f"{self.schema}, level int").parquet(self.path)


def crawl(
    spark: SparkSession, spec: SourceSpec, fetch: Fetch, initial: list[str] | None = None, known: DataFrame | None = None, crawled_at=None,
    progress: Callable[[int, int, int], None] | None = None, cancelled: Callable[[], bool] | None = None, settings: CrawlSettings | None = None,
) -> Crawled:
    """Documents and events of all pages in the seed's scope that links reach, level by level.

    ``initial``: start there instead of at the seed (each must be in scope); ``known``: documents (url) not to be
    fetched again. Every level is written to the shared folder and read once for its links and once for the result; the
    pages seen stand in one growing table and are taken out by an anti-join, so nothing grows on the driver. Of several
    pages with one final URL, the one requested under the lowest URL counts.

    ``progress`` is told the per cent done in steps of ten, the pages processed and the pages discovered, after a level
    that reaches another step. ``cancelled`` is asked after every level; if it says so, or on an interrupt from the
    keyboard, the crawl ends with what it has: an incomplete one. The seed and the pages that were still to be fetched
    count as failed, so ``retry`` goes on from there.
    """
    for selector in spec.selectors():
        parse_selector(selector)
    given = [spec.seed_url, *(initial or [spec.seed_url])]
    seed, *start = [r.url for r in spark.createDataFrame([(u,) for u in given], "url string").coalesce(1).select(canonical_url(F.col("url")).alias("url")).collect()]
    start = list(dict.fromkeys(start))
    frontier = spark.createDataFrame([(u,) for u in start], "url string")
    outside = [r.url for r in frontier.where(~in_scope(F.col("url"), F.lit(seed))).collect()]
    if outside or not seed.startswith(("http://", "https://")):
        raise ValueError(f"not in the scope of {spec.seed_url}: {outside}")
    known = (spark.createDataFrame([], "url string") if known is None else known.select("url")).distinct()
    seen, levels = Grown(spark, "seen", "url string"), Grown(spark, "level", PARSED)
    processed, step, stopped = 0, 0, ""
    seen.add(known)
    try:
        while not frontier.isEmpty():
            fetched = parse_fetched(fetch(frontier), spec.selectors()).withColumn("final_url", canonical_url(F.col("final_url")))
            level = levels.add(fetched)
            seen.add(level.select(F.explode(F.array("requested", "final_url")).alias("url")).distinct())
            to = link_targets(level, seed).where("ok").select("url").distinct()
            frontier, done = materialize(to.join(seen.whole().select("url"), "url", "left_anti"), "frontier"), frontier
            discard(done)
            if progress:
                processed += level.count()
                discovered = processed + frontier.count()
                reached = percent_done(processed, discovered)
                if reached > 0 and reached != step:
                    step = reached
                    progress(reached, processed, discovered)
            if cancelled and cancelled():
                stopped = "cancelled"
                break
    except KeyboardInterrupt:
        stopped = "interrupted"
    parsed = levels.whole()
    documents = materialize(crawled_documents(parsed, spec, known, crawled_at), "documents")
    happened = crawl_events(parsed, seed, known)
    if stopped:
        left = _events(frontier, "failed", "url", F.lit(None), F.lit(stopped), F.lit(None))
        happened = happened.unionByName(left).unionByName(spark.createDataFrame([("failed", seed, None, stopped, None)], EVENT))
    events = materialize(distinct_events(happened), "events")
    state = is_complete(events).first()
    return Crawled(spec, documents.orderBy("url"), events, state.complete, state.failed, state.missing, settings or getattr(fetch, "settings", None))


GOOD = "error is null and status between 200 and 299"
REFRESHED = "coalesce(refresh, '') <> ''"


def link_targets(parsed: DataFrame, seed: str) -> DataFrame:
    """page, url, how (link or refresh), ok: all references of good HTML pages, canonical, and whether in scope.

    A page with a meta refresh leads only to its target; pages whose content is missing still give their links.
    """
    pages = parsed.where(GOOD).where("is_html")
    followed = pages.where(f"not ({REFRESHED})").select("final_url", F.explode("links").alias("to"), F.lit("link").alias("how"))
    turned = pages.where(REFRESHED).select("final_url", resolve_url(F.col("final_url"), F.col("refresh")).alias("to"), F.lit("refresh").alias("how"))
    targets = followed.unionByName(turned).select(F.col("final_url").alias("page"), canonical_url(F.col("to")).alias("url"), "how")
    return targets.withColumn("ok", F.coalesce(in_scope(F.col("url"), F.lit(seed)), F.lit(False)))


def content_pages(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Good pages with content, numbered within their final URL; 0 for pages whose final URL is known already."""
    pages = parsed.where(GOOD).where(f"is_html and not ({REFRESHED}) and not missing")
    nth = F.row_number().over(Window.partitionBy("final_url").orderBy("level", "requested"))
    old = known.select(F.col("url").alias("final_url"), F.lit(True).alias("old"))
    return pages.withColumn("nth", nth).join(old, "final_url", "left").withColumn("nth", F.when(F.col("old"), 0).otherwise(F.col("nth")))


def crawled_documents(parsed: DataFrame, spec: SourceSpec, known: DataFrame, crawled_at) -> DataFrame:
    own_id = artifact_document_id(F.lit(spec.source), F.lit(spec.version), F.col("final_url"))
    return content_pages(parsed, known).where("nth = 1").select(
        own_id.alias("doc_id"), F.col("final_url").alias("url"), "title", document_filename(own_id).alias("filename"), content_hash(F.col("markdown")).alias("content_hash"),
        (F.lit(crawled_at).cast("timestamp") if crawled_at else F.current_timestamp()).alias("crawled_at"), "markdown",
    )


def crawl_events(parsed: DataFrame, seed: str, known: DataFrame) -> DataFrame:
    """All events of a crawl. A seed that is no HTML page failed; any other such page is skipped."""
    null = F.lit(None)
    to = link_targets(parsed, seed)
    content = content_pages(parsed, known)
    other = parsed.where(GOOD).where("not is_html")
    kind = F.concat(F.lit("not HTML: "), F.col("media"))
    status = F.col("status")
    hops = parsed.select(F.explode("hops").alias("h")).select("h.*")
    rows = [
        _events(content, "fetched", "final_url", status, null, null),
        _events(parsed.where(GOOD).where(f"is_html and not ({REFRESHED}) and missing"), "selector_missing", "final_url", status, null, null),
        _events(parsed.where(f"not ({GOOD}) or status is null"), "failed", "requested", status, F.coalesce("error", F.concat(F.lit("status "), status.cast("string"))), null),
        _events(other.where(F.col("requested") == seed), "failed", "requested", status, kind, null),
        _events(other.where(F.col("requested") != seed), "skipped", "requested", status, kind, null),
        _events(content.where("nth <> 1"), "skipped", "requested", status, F.lit("duplicate canonical page"), F.col("final_url")),
        _events(to.where("not ok and how = 'link'"), "skipped", "url", null, F.lit("out of scope"), null),
        _events(to.where("not ok and how = 'refresh'"), "skipped", "page", null, F.lit("redirect out of scope"), F.col("url")),
        _events(to.where("ok and how = 'refresh'"), "redirected", "page", null, F.lit("meta refresh"), F.col("url")),
        _events(hops, "redirected", "url", status, null, F.col("target")),
    ]
    return reduce(DataFrame.unionByName, rows)


def retry(spark: SparkSession, old: Crawled, fetch: Fetch, selectors: list[str] | None = None, crawled_at=None, **watch) -> Crawled:
    """Crawl the failed and content-less pages again and merge: a complete crawl is returned as it is.

    New selectors are added behind the stored ones. Documents are replaced by URL or added, the retried URLs' old
    failures leave, and all events are kept once.
    """
    if old.complete:
        return old
    spec = SourceSpec(**{**old.spec.__dict__, "content_selectors": list(dict.fromkeys(s for s in [*old.spec.content_selectors, *(selectors or [])] if s.strip() and s != old.spec.content_selector))})
    targets = retry_targets(old.events)
    wanted = [r.url for r in targets.collect()]  # the pages that failed, which the caller asked to fetch one by one
    new = crawl(spark, spec, fetch, wanted, old.documents, crawled_at, **watch)
    documents = materialize(merge_documents(old.documents, new.documents), "documents")
    events = materialize(merge_events(old.events, new.events, targets), "events")
    state = is_complete(events).first()
    return Crawled(spec, documents.orderBy("url"), events, state.complete, state.failed, state.missing, new.settings)


def resolve_url(base, href):
    """Reference resolution in an Arrow UDF; null for what can't be parsed."""
    @F.pandas_udf("string")
    def resolved(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return urljoin(b or "", (h or "").strip())
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype=object)

    return resolved(base, href)


def reachable(links: DataFrame, seeds: DataFrame, source: str = "src", target: str = "dst", max_levels: int | None = None) -> DataFrame:
    """url, level: breadth-first levels over a static link table; cycles end because pages seen are taken out.

    The levels are appended to one table, which is the result.
    """
    edges = links.select(F.col(source).alias("url"), F.col(target).alias("next"))
    reached = Grown(links.sparkSession, "reached", f"url {seeds.schema['url'].dataType.simpleString()}")
    frontier = reached.add(seeds.select("url").distinct())
    while not frontier.isEmpty() and (max_levels is None or reached.parts <= max_levels):
        after = frontier.join(edges, "url").select(F.col("next").alias("url")).where("url is not null").distinct()
        frontier = reached.add(after.join(reached.whole().select("url"), "url", "left_anti"))
    return reached.whole()
