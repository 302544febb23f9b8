"""Versioned snapshots as Parquet: publish, aliases, retention, catalog, lookup, cached vectors."""

from __future__ import annotations

import json
import secrets
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.ids import alias_name, physical_name, store_document_id, stored_point_id
from folioscope.operators.catalog import retained, source_catalog
from folioscope.operators.sparse import exploded
from folioscope.sources.files import Files

# Fixed values of the index format.
INDEX_SCHEMA = 4
CATALOG_SCHEMA = 1
DEFAULT_RETENTION = 2
ALIASES = "aliases.json"
PUBLISHED = (
    "source string, version string, is_default boolean, display_name string, description string, tags array<string>, seed_url string, "
    "document_count bigint, chunk_count bigint, indexed_at_ns bigint, complete boolean, embedding_model string"
)


class SourceNotFoundError(LookupError):
    def __init__(self, source: str, version: str | None):
        super().__init__(f"source {source!r} version {version or 'default'!r} has not been indexed")
        self.source, self.version = source, version


class DocumentNotFoundError(LookupError):
    def __init__(self, source: str, version: str | None, url: str):
        super().__init__(f"document {url!r} not found in source {source!r} version {version or 'default'!r}")
        self.source, self.version, self.url = source, version, url


class ReindexRequiredError(RuntimeError):
    def __init__(self, source: str, version: str | None):
        super().__init__(f"source {source!r} version {version or 'default'!r} must be indexed again")
        self.source, self.version = source, version


@dataclass
class Snapshot:
    """What is published; ``document_count`` is what the caller expects."""

    source: str
    version: str | None
    seed_url: str
    chunks: DataFrame
    documents: DataFrame
    document_count: int
    display_name: str = ""
    description: str = ""
    tags: list[str] = field(default_factory=list)
    complete: bool = True
    allow_incomplete: bool = False
    embedding_model: str = ""
    embedding_profile: str = ""


def snapshot_problems(snapshot: Snapshot) -> DataFrame:
    """One row: how many rows break each rule of a snapshot."""
    chunks, documents = snapshot.chunks, snapshot.documents
    same = lambda d: (F.col("source") == snapshot.source) & (F.coalesce("version", F.lit("")) == (snapshot.version or ""))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    size = F.coalesce(F.size("dense_vector"), F.lit(0))
    of_chunks = chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_if(~F.coalesce(same(chunks), F.lit(False))).alias("foreign_chunks"),
        F.count_if(empty("input_hash")).alias("without_input_hash"),
        F.coalesce(F.max(size) - F.min(size), F.lit(0)).alias("dimension_spread"),
        F.count_if(size <= 0).alias("without_vector"),
        F.count_if(F.coalesce((F.size("indices") <= 0) | (F.size("indices") != F.size("values")), F.lit(True))).alias("bad_sparse"),
    )
    of_documents = documents.agg(
        F.count("*").alias("n_documents"),
        F.count_if(~F.coalesce(same(documents), F.lit(False))).alias("foreign_documents"),
        F.count_if(empty("document_point_id") | empty("url") | empty("content_hash") | F.col("markdown").isNull()).alias("bad_documents"),
    )
    return of_chunks.crossJoin(of_documents)  # two rows of counts


def with_identity(documents: DataFrame, source: str, url: str) -> DataFrame:
    """The documents that have the id of this source and URL: a comparison with one value, which the file statistics serve."""
    wanted = documents.sparkSession.range(1).select(stored_point_id(store_document_id(F.lit(source), F.lit(url)))).first()[0]
    return documents.where(F.col("document_point_id") == wanted)


class SnapshotStore:
    """Physical snapshots are directories; one pointer file holds all aliases, so a switch is one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def aliases(self) -> dict[str, str]:
        return json.loads(self.files.read(ALIASES)) if self.files.exists(ALIASES) else {}

    def meta(self, physical: str) -> dict | None:
        name = f"{physical}/meta.json"
        return json.loads(self.files.read(name)) if self.files.exists(name) else None

    def resolve(self, source: str, version: str | None = None) -> str:
        """The physical snapshot of the source's version; without a version, of its last publish. Never another version's."""
        physical = self.aliases().get(alias_name(source, version))
        if not physical:
            raise SourceNotFoundError(source, version)
        return physical

    def publish(self, snapshot: Snapshot, retention: int = DEFAULT_RETENTION) -> str:
        """Validate, write, count what was written, switch the aliases, clean up. A failure leaves the old state.

        Beside the chunks their sparse vectors are written exploded and sorted by term, as the index of sparse search.
        """
        problems = snapshot_problems(snapshot).first().asDict()
        wrong = {k: v for k, v in problems.items() if not k.startswith("n_") and v}
        if problems["n_documents"] != snapshot.document_count:
            wrong["n_documents"] = problems["n_documents"]
        if not problems["n_chunks"]:
            wrong["n_chunks"] = 0
        if not (snapshot.complete or snapshot.allow_incomplete):
            wrong["complete"] = False
        if wrong:
            raise ValueError(f"snapshot rejected: {wrong}")
        nanos = time.time_ns()
        physical = physical_name(snapshot.source, snapshot.version, nanos, secrets.token_hex(4))
        published = False
        try:
            snapshot.chunks.write.parquet(f"{self.root}/{physical}/chunks")
            snapshot.documents.sort("document_point_id").write.parquet(f"{self.root}/{physical}/documents")
            posted = exploded(self.spark.read.parquet(f"{self.root}/{physical}/chunks"), "point_id")
            posted.repartitionByRange("term", "point_id").sortWithinPartitions("term", "point_id").write.parquet(f"{self.root}/{physical}/postings")
            counted = {k: self.spark.read.parquet(f"{self.root}/{physical}/{k}").count() for k in ("chunks", "documents")}
            if counted != {"chunks": problems["n_chunks"], "documents": problems["n_documents"]}:
                raise OSError(f"{physical} holds {counted}, not {problems}")
            kept = {k: v for k, v in asdict_light(snapshot).items()}
            meta = kept | {"physical": physical, "schema": INDEX_SCHEMA, "chunk_count": counted["chunks"], "document_count": counted["documents"], "indexed_at_ns": nanos}
            self.files.write(f"{physical}/meta.json", json.dumps(meta))
            pointers = {alias_name(snapshot.source, snapshot.version): physical, alias_name(snapshot.source, None): physical}
            self.files.write(ALIASES, json.dumps(self.aliases() | pointers, indent=1, sort_keys=True))
            published = True
        finally:
            if not published:
                self.files.delete(physical)
        try:
            self.clean(snapshot.source, retention)
        except Exception as error:  # the snapshot is published; old ones stay until the next publish
            print(f"cleanup of {snapshot.source}: {error}")
        return physical

    def snapshots(self) -> DataFrame:
        """name, source, version, indexed_at_ns, active of all physical snapshots that carry metadata."""
        active = set(self.aliases().values())
        metas = [m for n in self.files.names() if n not in (ALIASES,) and (m := self.meta(n))]
        rows = [(m["physical"], m["source"], m["version"], m["indexed_at_ns"], m["physical"] in active) for m in metas if m.get("source")]
        return self.spark.createDataFrame(rows, "name string, source string, version string, indexed_at_ns bigint, active boolean")

    def clean(self, source: str, retention: int = DEFAULT_RETENTION) -> list[str]:
        """Delete the source's snapshots beyond the ``retention`` newest; active ones stay and count."""
        own = self.snapshots().where(F.col("source") == source)
        gone = [r.name for r in retained(own, "source", "indexed_at_ns", "name", "active", retention).where("not keep").select("name").collect()]
        for name in gone:
            self.files.delete(name)
        return gone

    def chunks(self, source: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.resolve(source, version)}/chunks")

    def postings(self, source: str, version: str | None = None) -> DataFrame:
        """point_id, term, weight of all chunks, sorted by term: a filter on terms reads only their row groups."""
        return self.spark.read.parquet(f"{self.root}/{self.resolve(source, version)}/postings")

    def documents(self, source: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.resolve(source, version)}/documents")

    def get_document(self, source: str, version: str | None, url: str) -> DataFrame:
        """The one page of exactly this URL, by its deterministic id: never a scan, never another version."""
        physical = self.resolve(source, version)
        meta = self.meta(physical)
        if not meta or meta.get("schema", 0) < INDEX_SCHEMA:
            raise ReindexRequiredError(source, version)
        found = with_identity(self.documents(source, version), source, url)
        if found.isEmpty():
            raise DocumentNotFoundError(source, version, url)
        return found

    def list_documents(self, source: str, version: str | None = None) -> DataFrame:
        """url, title, content_hash, crawled_at by URL; vectors and texts are not read."""
        return self.documents(source, version).where("url <> ''").select("source", "version", "url", "title", "content_hash", "crawled_at").orderBy("url")

    def list_sources(self) -> dict:
        """Catalog: sources by name with their versions, the default version's description winning.

        Snapshots without metadata are left out. A snapshot whose metadata has no chunk count is counted.
        """
        pointers = self.aliases()
        metas = [m for p in sorted(set(pointers.values())) if (m := self.meta(p)) and m.get("source") and m.get("schema")]
        if not metas:
            return {"schema_version": CATALOG_SCHEMA, "sources": []}
        for meta in metas:
            meta["is_default"] = pointers.get(alias_name(meta["source"], None)) == meta["physical"]
            if not meta.get("chunk_count"):
                meta["chunk_count"] = self.spark.read.parquet(f"{self.root}/{meta['physical']}/chunks").count()
        names = [f.split()[0] for f in PUBLISHED.split(", ")]
        published = self.spark.createDataFrame([tuple(m.get(n) for n in names) for m in metas], PUBLISHED)
        details, columns = ["display_name", "description", "tags"], ["seed_url", "document_count", "chunk_count", "indexed_at_ns", "complete", "embedding_model"]
        rolled = source_catalog(published, "source", "version", "is_default", details, columns).orderBy("source")
        return {"schema_version": CATALOG_SCHEMA, "sources": [r.asDict(recursive=True) for r in rolled.collect()]}

    def stored_vectors(self, source: str, version: str | None, profile: str) -> DataFrame | None:
        """Chunks whose vectors may be reused: of the active snapshot, if it was embedded with the same profile."""
        try:
            physical = self.resolve(source, version)
        except SourceNotFoundError:
            return None
        meta = self.meta(physical) or {}
        if meta.get("schema") != INDEX_SCHEMA or meta.get("embedding_profile") != profile:
            return None
        return self.spark.read.parquet(f"{self.root}/{physical}/chunks").select("point_id", "input_hash", "dense_vector")


def asdict_light(snapshot: Snapshot) -> dict:
    """The snapshot's plain fields."""
    return {k: getattr(snapshot, k) for k in snapshot.__dataclass_fields__ if k not in ("chunks", "documents", "document_count")}


__all__ = ["Snapshot", "SnapshotStore", "SourceNotFoundError", "DocumentNotFoundError", "ReindexRequiredError", "snapshot_problems"]
