"""A crawl on disk: manifest, report and one Markdown file per page, swapped in as a whole."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.crawl import Crawled, CrawlSettings, SourceSpec
from folioscope.sources.files import Files

ARTIFACT_SCHEMA = 1
KINDS = ("fetched", "redirected", "skipped", "failed", "selector_missing")


def write_artifact(spark: SparkSession, crawled: Crawled, root: str, name: str, started_at: datetime, completed_at: datetime) -> None:
    """Write beside the old artifact, then swap by two renames; a failure restores the old one.

    Documents and events are Parquet, written by the executors; the manifest is one JSON file, with the crawl's settings. A document without
    Markdown aborts before the swap.
    """
    files = Files(spark, root)
    fresh, old = f"{name}.new-{uuid.uuid4().hex[:8]}", f"{name}.old-{uuid.uuid4().hex[:8]}"
    try:
        if not crawled.documents.where("markdown is null").isEmpty():
            raise ValueError("a document has no Markdown")
        crawled.documents.repartitionByRange("url").sortWithinPartitions("url").write.parquet(f"{files.root}/{fresh}/documents")
        crawled.events.write.parquet(f"{files.root}/{fresh}/report")
        manifest = {
            "schema_version": ARTIFACT_SCHEMA, "source": crawled.spec.__dict__, "started_at": started_at.isoformat(), "completed_at": completed_at.isoformat(), "complete": crawled.complete,
            "crawl": vars(crawled.settings) if crawled.settings else None,
        }
        files.write(f"{fresh}/manifest.json", json.dumps(manifest, indent=2))
        had = files.exists(name)
        if had:
            files.rename(name, old)
        try:
            files.rename(fresh, name)
        except OSError:
            if had:
                files.rename(old, name)
            raise
        if had:
            files.delete(old)
    finally:
        files.delete(fresh)


def read_artifact(spark: SparkSession, root: str, name: str) -> tuple[dict, Crawled]:
    """Manifest and crawl. Wrong schema versions and bodies that don't match their hash are errors; unknown fields are ignored."""
    files = Files(spark, root)
    manifest = json.loads(files.read(f"{name}/manifest.json"))
    if manifest.get("schema_version") != ARTIFACT_SCHEMA:
        raise ValueError(f"unsupported artifact schema {manifest.get('schema_version')}")
    documents = spark.read.parquet(f"{files.root}/{name}/documents")
    broken = verify_hashes(documents).where("not intact").limit(3).collect()
    if broken:
        raise ValueError(f"content hash mismatch: {[r.url for r in broken]}")
    events = spark.read.parquet(f"{files.root}/{name}/report")
    spec = SourceSpec(**{k: v for k, v in manifest["source"].items() if k in SourceSpec.__dataclass_fields__})
    counts = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    known = {k: v for k, v in (manifest.get("crawl") or {}).items() if k in CrawlSettings.__dataclass_fields__}
    settings = CrawlSettings(**known) if known else None
    return manifest, Crawled(spec, documents, events, manifest["complete"], counts.get("failed", 0), counts.get("selector_missing", 0), settings)


def verify_hashes(documents: DataFrame) -> DataFrame:
    """url and whether the body's SHA-256 is the stored hash."""
    return documents.select("url", F.coalesce(F.sha2("markdown", 256) == F.col("content_hash"), F.lit(False)).alias("intact"))


def require_bodies(documents: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Documents with their Markdown; a document without a body is an error."""
    lost = documents.join(bodies, key, "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"documents without a body: {[r[key] for r in lost]}")
    return documents.join(bodies, key)
