"""Lines repeated across one source's pages: boilerplate blocks in a graph of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import discard, materialize

MIN_PAGES = 5
MIN_CHARS = 12


def line_form(line: Column) -> Column:
    """Lower case, every run of ASCII digits one 0, and only letters and digits left."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[^\p{L}\p{Nd}]+", "")


def lines_of(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")


def page_lines(pages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """page_no, source, lines (line_no, node): a row per page with its lines of at least ``min_chars`` in their order.

    ``node`` is the MD5 of source and form. Redelivered pages are one row; if rows of a page differ, it has the lines of
    each. Null and empty texts have no line, a null source is a source of its own (the empty one).
    """
    source = F.coalesce("source_id", F.lit(""))
    forms = F.transform(lines_of(F.col("markdown")), lambda line, i: F.struct((i + 1).alias("line_no"), line_form(line).alias("form")))
    long = F.filter(forms, lambda x: F.char_length(x["form"]) >= min_chars)
    lines = F.transform(long, lambda x: F.struct(x["line_no"].alias("line_no"), F.unhex(F.md5(F.concat(F.col("source"), F.lit("\0"), x["form"]))).alias("node")))
    rows = pages.where("page_no is not null and markdown <> ''").select("page_no", source.alias("source"), "markdown").select("page_no", "source", lines.alias("lines"))
    return rows.groupBy("page_no", "source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"))


def line_graph(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """u, v, n_pages: nodes (v is null) and edges of the graph of consecutive lines, on at least ``min_pages`` each.

    An edge joins two lines that follow each other among a page's lines (blank and short lines between them are not
    seen). Both kinds are counted in one pass with one combining shuffle; the ends of an edge stand on the edge's pages,
    so they are nodes.
    """
    node = F.transform("lines", lambda x: F.struct(x["node"].alias("u"), F.lit(None).cast("binary").alias("v")))
    steps = F.zip_with(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0))), F.slice("lines", F.lit(2), F.size("lines")), lambda a, b: F.struct(a["node"].alias("u"), b["node"].alias("v")))
    parts = pages.select(F.explode(F.array_distinct(F.concat(node, F.filter(steps, lambda x: x["u"] != x["v"])))).alias("x"))
    return parts.groupBy("x.u", "x.v").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the lowest node of each connected component.

    Every round takes the lowest label among the neighbours and then the label of that label, so long chains need a
    logarithmic number of rounds. Each round is written to the shared folder and the one before it deleted.
    """
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialize(
            lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels"
        )
        discard(labels)
        labels = after
        if after.where("label <> old").isEmpty():
            discard(both)
            return after.select("node", "label")


def boilerplate_blocks(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """node, n_pages, block: the lines kept, and the connected component each belongs to."""
    graph = materialize(line_graph(pages, min_pages), "graph")
    nodes = graph.where("v is null").select(F.col("u").alias("node"), "n_pages")
    labels = components(nodes, graph.where("v is not null")).withColumnRenamed("label", "block")
    return nodes.join(labels, "node").select("node", "n_pages", "block")


def block_occurrences(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_no, source, block, line_nos: the places on pages that match a block.

    A match is a longest run of lines of one block that follow each other on the page, with nothing but blank and short
    lines between them. The lines meet the blocks in a join that is broadcast only below the session's threshold and
    split by AQE where one line is very frequent; runs are found within a page.
    """
    placed = pages.select("page_no", "source", F.posexplode("lines").alias("pos", "x")).select("page_no", "source", "pos", "x.line_no", "x.node")
    kept = placed.join(blocks.select("node", "block"), "node")
    order = Window.partitionBy("page_no", "source").orderBy("pos")
    follows = (F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("block").over(order) == F.col("block"))
    runs = kept.withColumn("begins", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(order))
    return runs.groupBy("page_no", "source", "run", "block").agg(F.sort_array(F.collect_list("line_no")).alias("line_nos")).drop("run")


def repeated_lines(pages: DataFrame) -> DataFrame:
    """page_no, source, block, line_no of every line within a match of a boilerplate block.

    Line numbers count from 1 over all lines, blank ones and those in fences included. Null and empty texts have none;
    a null source is a source of its own; redelivered rows count once (if they differ, the lines of each count).
    """
    lines = materialize(page_lines(pages), "lines")
    matches = block_occurrences(lines, materialize(boilerplate_blocks(lines), "blocks"))
    return matches.select("page_no", "source", "block", F.explode("line_nos").alias("line_no"))


def without_repeated_lines(pages: DataFrame) -> DataFrame:
    """page_no, markdown of every page without the matches of boilerplate blocks, line ends as LF; null stays null."""
    removed = repeated_lines(pages).groupBy("page_no").agg(F.collect_set("line_no").alias("removed"))
    newest = F.max_by(F.struct("markdown"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")))
    latest = pages.where("page_no is not null").groupBy("page_no").agg(newest.alias("c")).select("page_no", "c.markdown")
    kept = F.filter(lines_of(F.col("markdown")), lambda line, i: ~F.array_contains("removed", i + 1))
    return latest.join(removed, "page_no", "left").select(
        "page_no", F.when(F.col("removed").isNull(), F.replace("markdown", F.lit("\r\n"), F.lit("\n"))).otherwise(F.array_join(kept, "\n")).alias("markdown")
    )
