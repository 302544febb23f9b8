"""Catalog roll-ups, snapshot retention and events as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_KEYS = ["url", "status", "detail", "target"]
BAD_KINDS = ("failed", "selector_missing")


def retained(snapshots: DataFrame, source: str, published: str, name: str, active: str, retention: int) -> DataFrame:
    """Snapshots with ``keep``: from the newest on, until ``retention`` are kept; active ones are always kept and count."""
    order = Window.partitionBy(source).orderBy(F.col(published).desc(), F.col(name).desc())
    newer = order.rowsBetween(Window.unboundedPreceding, -1)
    # An inactive one is kept while fewer than `retention` are kept before it: those are the active ones before it and
    # the inactive ones before it, as none of these is dropped earlier.
    return snapshots.withColumn("keep", F.col(active) | (F.coalesce(F.count("*").over(newer), F.lit(0)) < retention))


def source_catalog(published: DataFrame, source: str, version: str, is_default: str, details: list[str], columns: list[str]) -> DataFrame:
    """A row per source: its versions (sorted, absent first as ''), default version and the default's ``details``."""
    listed = F.sort_array(F.collect_list(F.struct(F.coalesce(version, F.lit("")).alias("version"), *columns)))
    return published.groupBy(source).agg(
        listed.alias("versions"),
        F.max(F.when(F.col(is_default), F.coalesce(version, F.lit("")))).alias("default_version"),
        *(F.max_by(F.col(c), F.col(is_default).cast("int")).alias(c) for c in details),
    )


def distinct_events(events: DataFrame) -> DataFrame:
    """Events without repeats, by (url, status, detail, target) within their kind, ordered by these."""
    return events.dropDuplicates(["kind", *EVENT_KEYS]).orderBy("kind", *EVENT_KEYS)


def merge_events(old: DataFrame, new: DataFrame, retried: DataFrame) -> DataFrame:
    """Old events except the retried URLs' failures, and the new ones, without repeats."""
    bad = old.where(F.col("kind").isin(*BAD_KINDS)).join(retried.select("url").distinct(), "url", "left_anti")
    return distinct_events(old.where(~F.col("kind").isin(*BAD_KINDS)).unionByName(bad).unionByName(new))


def retry_targets(events: DataFrame) -> DataFrame:
    """Distinct URLs that failed or missed the content."""
    return events.where(F.col("kind").isin(*BAD_KINDS)).select("url").distinct()


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """One document per URL; a new one replaces the old one, others stay or are added."""
    fields = [c for c in old.columns if c != "url"]
    pick = [F.when(F.col("n.url").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields]
    joined = old.alias("o").join(new.alias("n"), F.col("o.url") == F.col("n.url"), "full_outer")
    return joined.select(F.coalesce("n.url", "o.url").alias("url"), *pick).select(*old.columns)


def fold_documents(documents: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The document of every key that comes last by ``order``: what merging all crawls one after another leaves.

    One shuffle, however many crawls a series has. In ``order`` a null comes first; ties go to the higher ``columns``.
    """
    last = F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("_last")
    return documents.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns))


def is_complete(events: DataFrame, *by: str) -> DataFrame:
    """complete, failed, missing: one row, or one for each value of ``by``."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return events.groupBy(*by).agg((F.count_if(F.col("kind").isin(*BAD_KINDS)) == 0).alias("complete"), of("failed").alias("failed"), of("selector_missing").alias("missing"))
