"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.urls import canonical_url
from folioscope.session import materialize
from folioscope.sources.files import Files


def consecutive_snapshots(
    rows: DataFrame, series: str, position: str, keys: list[str], values: list[str], newest: list[Column], columns: list[str]
) -> DataFrame:
    """One merge over all snapshots of all series.

    The rows are range-partitioned and sorted by (series, keys, position). Within a range every key's rows of all
    snapshots then stand together in the order of the snapshots, so the merge's two pointers, into the earlier and
    the later listing, are the neighbouring rows of one sorted stream. Both are read in a single streaming pass; no
    listing is joined with another and the sort is used for choosing the row of a key, too.

    A repeated key within a snapshot counts once, by the order ``newest``. ``position`` numbers a series' snapshots
    1, 2, ... without gaps. Gives series, keys, position, ``columns``, and ``earlier_position``, ``later_position`` of
    the key's neighbouring rows and ``changed_columns``: the ``values`` known in this row and the earlier one and different.
    """
    ranged = rows.repartitionByRange(F.col(series), *map(F.col, keys))
    listing = Window.partitionBy(series, *keys, position).orderBy(*newest)
    stream = Window.partitionBy(series, *keys).orderBy(position)
    differs = F.array_compact(F.array(*(F.when(F.lag(v).over(stream) != F.col(v), F.lit(v)) for v in values)))
    return (
        ranged.withColumn("_nth", F.row_number().over(listing))
        .where("_nth = 1")
        .select(
            series, *keys, position, *columns, differs.alias("changed_columns"),
            F.lag(position).over(stream).alias("earlier_position"), F.lead(position).over(stream).alias("later_position"),
        )
    )


def typed_changes(merged: DataFrame, position: str, this_no: str, next_no: str, keys: list[str], with_columns: bool = False) -> DataFrame:
    """Added, removed and changed keys, each under the number of the later snapshot, ``with_columns`` with those that changed.

    ``added``: not in the snapshot just before (the first snapshot of a series gives none). ``removed``: not in the
    snapshot just after, of which ``next_no`` is the number (null: there is none). ``changed``: in both, and some value
    known in both and different.
    """
    before = F.coalesce(F.col("earlier_position") == F.col(position) - 1, F.lit(False))
    after = F.coalesce(F.col("later_position") == F.col(position) + 1, F.lit(False))
    arrived = (
        F.when(~before & (F.col(position) > 1), F.lit("added"))
        .when(before & (F.size("changed_columns") > 0), F.lit("changed"))
    )
    left = F.when(~after & F.col(next_no).isNotNull(), F.lit("removed"))
    none = F.array().cast("array<string>")
    changes = F.filter(
        F.array(
            F.struct(F.col(this_no).alias("no"), arrived.alias("kind"), F.when(arrived == "changed", F.col("changed_columns")).otherwise(none).alias("columns")),
            F.struct(F.col(next_no).alias("no"), left.alias("kind"), none.alias("columns")),
        ),
        lambda c: c["kind"].isNotNull(),
    )
    told = [F.col("c.columns").alias("changed_columns")] if with_columns else []
    return merged.select(F.explode(changes).alias("c"), *keys).select(F.col("c.no").alias(this_no), *keys, F.col("c.kind").alias("diff_kind"), *told)


class KeptSnapshots:
    """Full snapshots as they are delivered, each range-partitioned and sorted by key in a folder of its own.

    A new snapshot costs its own writing and one merge with the snapshot before it, however long the history is: only
    these two folders, and of them only the compared columns, are read. A key that a snapshot repeats counts once (the
    highest values); null keys take no part.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], values: list[str]):
        self.spark, self.folder, self.keys, self.values, self.files = spark, folder.rstrip("/"), keys, values, Files(spark, folder)

    def numbers(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.files.names() if n.startswith("snapshot="))

    def keep(self, rows: DataFrame, number: int) -> None:
        """Write a snapshot; the same number replaces it. It shows up under its name only when it is whole."""
        known = F.expr(" and ".join(f"`{k}` is not null" for k in self.keys))
        fresh = f"writing-{uuid.uuid4().hex}"
        rows.where(known).repartitionByRange(*map(F.col, self.keys)).sortWithinPartitions(*self.keys).write.parquet(f"{self.folder}/{fresh}")
        self.files.delete(f"snapshot={number}")
        self.files.rename(fresh, f"snapshot={number}")

    def changes(self, number: int) -> DataFrame:
        """keys, diff_kind, changed_columns from the kept snapshot before ``number`` to it; of the first one there is none."""
        before = [n for n in self.numbers() if n < number]
        pair = [*before[-1:], number] if before else [number]
        rows = None
        for place, n in enumerate(pair, 1):
            own = self.spark.read.parquet(f"{self.folder}/snapshot={n}").select(*self.keys, *self.values, F.lit(0).alias("_series"), F.lit(place).alias("_position"))
            rows = own if rows is None else rows.unionByName(own)
        numbered = rows.withColumn("_no", F.lit(number)).withColumn("_next", F.when(F.col("_position") < len(pair), F.lit(number)))
        merged = consecutive_snapshots(numbered, "_series", "_position", self.keys, self.values, [F.col(v).desc_nulls_last() for v in self.values], ["_no", "_next"])
        return typed_changes(merged, "_position", "_no", "_next", self.keys, with_columns=True).drop("_no")


def hex_digits(digest: Column) -> Column:
    """The hash's hex digits in lower case, without an algorithm's name; null if there are none."""
    digits = F.regexp_extract(F.lower(F.trim(digest)), r"(?:^|[^0-9a-z])([0-9a-f]+)$", 1)
    return F.when(digits != "", digits)


def complete_crawls(manifests: DataFrame) -> DataFrame:
    """Complete crawls numbered 1, 2, ... within source and version, with the number of the next one.

    A null version is a version of its own. ``series_no`` is the lowest manifest number of the series.
    """
    series = Window.partitionBy("source_id", "version")
    ordered = series.orderBy("snapshot_seq", "manifest_no")
    return (
        manifests.where("complete").select("manifest_no", "source_id", "version", "snapshot_seq").dropDuplicates(["manifest_no"])
        .select(
            "manifest_no",
            F.min("manifest_no").over(series).alias("series_no"),
            F.row_number().over(ordered).alias("position"),
            F.lead("manifest_no").over(ordered).alias("next_no"),
        )
    )


def page_changes(page_snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """manifest_no, url, diff_kind: pages added, removed or changed from one complete crawl to the next.

    Rows without URL, or of a crawl that is incomplete or unknown, take no part. Within a crawl and canonical URL the
    row of the latest crawl time counts (then the latest delivery, then the higher hash), so redelivered rows count
    once. A page whose hash is unknown on either side is never ``changed``. Empty tables give an empty result; other
    columns of the tables are not read.
    """
    pages = page_snapshots.where("url is not null and url <> ''").select(
        "manifest_no", canonical_url(F.col("url")).alias("url"), hex_digits(F.col("content_hash")).alias("hash"), "crawled_at", "loaded_at"
    )
    # The range partition samples its input before it moves it: the URLs' canonical forms are made once.
    merged = consecutive_snapshots(
        materialize(pages.join(complete_crawls(manifests), "manifest_no"), "listings"),
        "series_no", "position", ["url"], ["hash"],
        [F.col(c).desc_nulls_last() for c in ("crawled_at", "loaded_at", "hash")],
        ["manifest_no", "next_no"],
    )
    return typed_changes(merged, "position", "manifest_no", "next_no", ["url"])
