"""An incremental front end: page rows arrive as files and leave as chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions.html import parse_pages
from folioscope.functions.urls import canonical_url
from folioscope.operators.index import chunk_points
from folioscope.sources.files import Files

PAGES = "source string, version string, url string, html string, crawled_at timestamp"
KEY = ["source", "version", "url"]
WRITTEN = "source string, version string, url string, crawled_at timestamp"


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _same_page(a: str, b: str):
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEY]


def page_documents(pages: DataFrame, selectors: list[str], written: DataFrame | None = None) -> DataFrame:
    """Documents of a batch of pages: of a canonical URL's pages with content the one crawled last.

    With ``written`` (source, version, url, crawled_at) only pages crawled later than what is written of them count, so
    a page is never left out for being late: one that was not seen before is always a document. A null crawl time is
    the earliest; of pages crawled at the same time within a batch the higher text counts, over batches the first.
    """
    rows = pages.withColumn("url", canonical_url(F.col("url"))).where("url <> ''")
    if written is not None:
        newest = written.groupBy(*KEY).agg(F.max("crawled_at").alias("crawled_at"))
        fresh = F.coalesce(F.col("p.crawled_at") <= F.col("w.crawled_at"), F.col("p.crawled_at").isNull())
        rows = rows.alias("p").join(newest.alias("w"), [*_same_page("p", "w"), fresh], "left_anti")
    parsed = parse_pages(rows, [*KEY, "crawled_at"], "url", "html", selectors)
    last = parsed.where("not missing").groupBy(*KEY).agg(F.max(F.struct("crawled_at", "markdown", "title")).alias("d"))
    return last.select(*KEY, "d.title", F.sha2("d.markdown", 256).alias("content_hash"), "d.crawled_at", "d.markdown")


def written_pages(spark: SparkSession, checkpoint: str, before: int | None = None) -> DataFrame:
    """source, version, url, crawled_at of every document that was delivered, or was so in the batches ``before`` a number."""
    names = [n for n in Files(spark, f"{checkpoint}/pages").names() if before is None or int(n.partition("-")[2]) < before]
    if not names:
        return spark.createDataFrame([], WRITTEN)
    return spark.read.schema(WRITTEN).parquet(*(f"{checkpoint}/pages/{n}" for n in names))


def current_chunks(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """Of all delivered chunks those of the version of their page that was crawled last."""
    newest = written.groupBy(*KEY).agg(F.max("crawled_at").alias("crawled_at"))
    same = [*_same_page("c", "w"), F.col("c.crawled_at").eqNullSafe(F.col("w.crawled_at"))]
    return chunks.alias("c").join(newest.alias("w"), same, "left_semi")


def write_chunks(pages: DataFrame, selectors: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, **sizes) -> StreamingQuery:
    """Chunks of every micro-batch go to ``sink``; the checkpoint makes a restarted query go on where it stopped.

    No page is dropped for its crawl time, however late it comes. The documents delivered are listed under
    ``checkpoint``/pages, a folder a batch. A page crawled again later is delivered again: ``current_chunks`` gives the
    chunks that count. A batch that is repeated after a failure has the same number and gives the same chunks.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        documents = page_documents(batch, selectors, written_pages(spark, checkpoint, number)).persist()
        try:
            sink(chunk_points(documents, **sizes), number)
            documents.select(*KEY, "crawled_at").write.mode("overwrite").parquet(f"{checkpoint}/pages/batch-{number}")
        finally:
            documents.unpersist()

    return pages.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
