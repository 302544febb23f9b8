"""From documents to points: chunks with identities, embedding inputs, sparse vectors, and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.ids import EmbeddingProfile, chunk_point_id, sha_of, store_document_id, stored_point_id
from folioscope.functions.text import embedding_text
from folioscope.operators.chunking import chunk_documents
from folioscope.operators.crawl import Crawled
from folioscope.operators.dense import Embed, attach_vectors, reuse_counts
from folioscope.operators.sparse import with_term_vectors
from folioscope.session import materialize
from folioscope.sources.store import DEFAULT_RETENTION, Snapshot, SnapshotStore

DOCUMENT = ["source", "version", "url", "title", "content_hash", "crawled_at"]


def chunk_points(documents: DataFrame, max_tokens: int | None = None, overlap: int | None = None) -> DataFrame:
    """A row per chunk of (source, version, url, title, content_hash, crawled_at, markdown) documents, with its ids.

    ``input_hash`` is the hash of ``embedding_text``: provenance lines and the chunk.
    """
    chunks = chunk_documents(documents, DOCUMENT, "markdown", max_tokens, overlap)
    return (
        chunks.withColumn("point_id", stored_point_id(chunk_point_id(F.col("source"), F.col("version"), F.col("url"), F.col("content_hash"), F.col("chunk_index"))))
        .withColumn("embedding_text", embedding_text(F.col("title"), F.col("heading_path"), F.col("url"), F.col("markdown")))
        .withColumn("input_hash", F.sha2("embedding_text", 256))
    )


def page_points(documents: DataFrame) -> DataFrame:
    return documents.select(stored_point_id(store_document_id(F.col("source"), F.col("url"))).alias("document_point_id"), *DOCUMENT, "markdown")


def index(
    spark: SparkSession, crawled: Crawled, store: SnapshotStore, embed: Embed, profile: EmbeddingProfile | None = None, model: str = "", allow_incomplete: bool = False,
    force_reembed: bool = False, retention: int = DEFAULT_RETENTION, batch: int = 64,
) -> dict:
    """Publish a crawl as a new snapshot; vectors of unchanged inputs are taken from the active one.

    Vectors are reused under the same fingerprint only: of ``profile``, else of the embedder's own (``embed.profile``),
    with ``model`` where it names none. Incomplete crawls and crawls without a chunk are errors. Gives the physical name
    and the counts.
    """
    profile = (profile or getattr(embed, "profile", None) or EmbeddingProfile()).for_model(model)
    fingerprint = profile.fingerprint()
    spec = crawled.spec
    if not (crawled.complete or allow_incomplete):
        raise ValueError("the crawl is incomplete")
    documents = crawled.documents.withColumn("source", F.lit(spec.source)).withColumn("version", F.lit(spec.version))
    points = materialize(chunk_points(documents), "points")
    if points.isEmpty():
        raise ValueError("no indexable chunks")
    stored = None if force_reembed else store.stored_vectors(spec.source, spec.version or None, fingerprint)
    counts = reuse_counts(points, stored).first().asDict() if stored is not None else {"reused": 0, "embedded": points.select("input_hash").distinct().count()}
    with_vectors = with_term_vectors(attach_vectors(points, stored, "embedding_text", embed, batch), F.col("embedding_text"))
    chunks = materialize(with_vectors.drop("embedding_text"), "chunks")
    snapshot = Snapshot(
        spec.source, spec.version or None, spec.seed_url, chunks, page_points(documents), documents.count(), spec.display_name, spec.description, spec.tags,
        crawled.complete, allow_incomplete, model or profile.model, fingerprint,
    )
    return {"physical": store.publish(snapshot, retention)} | counts


__all__ = ["chunk_points", "index", "page_points", "sha_of"]
