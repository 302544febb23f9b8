"""Markdown blocks and heading-aware chunks with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.batches import small_batches

# Fixed values of the chunk rules.
DEFAULT_MAX_TOKENS = 800
DEFAULT_OVERLAP_TOKENS = 100
WHITE = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FENCES = ("```", "~~~")
HEADING = re.compile(r"(#{1,6})[\t\n\f\r ]+([^\n]+?)[\t\n\f\r ]*\Z")
SPACE_RUN = re.compile("[" + WHITE + "]+")


def estimate(text: str) -> int:
    """ceil(code points / 4), at least 1."""
    return max(1, -(-len(text) // 4))


def block_spans(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """First line, line after the last, and heading path of every block.

    A heading outside a fence begins a block, a blank line outside one ends it. Any fence line toggles, whatever its
    kind; a fence that is not closed runs to the end. Spans that hold only white space are no block.
    """
    spans, path, fenced, start = [], [], False, None
    for number, line in enumerate(lines):
        bare = line.strip(WHITE)
        toggles = bare.startswith(FENCES)
        heading = None if fenced or toggles else HEADING.match(line)
        if start is not None and (heading or (not bare and not fenced)):
            spans.append((start, number, path))
            start = None
        if heading:
            level = len(heading[1])
            path = [*(path + [""] * level)[: level - 1], heading[2].strip(WHITE)]
        if start is None and (bare or fenced):
            start = number
        fenced ^= toggles
    if start is not None:
        spans.append((start, len(lines), path))
    return spans


def blocks(markdown: str) -> list[tuple[str, list[str]]]:
    """Trimmed text and heading path of every block."""
    lines = markdown.replace("\r\n", "\n").split("\n")
    found = (("\n".join(lines[a:b]).strip(WHITE), path) for a, b, path in block_spans(lines))
    return [(text, path) for text, path in found if text]


BLOCK = pa.struct([("block", pa.string()), ("heading_path", pa.list_(pa.string()))])


def document_blocks(df: DataFrame, keys: list[str], markdown: str) -> DataFrame:
    """A row per block: the keys, block_no (from 0), block, heading_path. Null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            found = [[{"block": b, "heading_path": path} for b, path in blocks(t)] if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(BLOCK))], [*keys, "_blocks"])

    picked = df.select(*(df[k] for k in keys), df[markdown].alias("_text"))
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    split = picked.mapInArrow(run, f"{schema}, _blocks array<struct<block:string,heading_path:array<string>>>")
    return split.select(*keys, F.posexplode("_blocks").alias("block_no", "b")).select(*keys, "block_no", "b.*")


def packed_words(text: str, max_tokens: int) -> list[str]:
    """The words joined by one blank, in pieces of as many as fit; a longer word is a piece of its own."""
    words = [w for w in SPACE_RUN.split(text) if w]
    ends = list(accumulate(len(w) + 1 for w in words))
    pieces, at = [], 0
    while at < len(words):
        room = (ends[at - 1] if at else 0) + 4 * max_tokens + 1
        after = max(at + 1, bisect_right(ends, room))
        pieces.append(" ".join(words[at:after]))
        at = after
    return pieces


def pack(sizes: list[int], max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of blocks that form a chunk.

    A chunk is a contiguous range, so the carried blocks are found on the running sums: the shortest tail of the
    emitted range that reaches the overlap. Nothing is carried after an oversized block.
    """
    total = [0, *accumulate(sizes)]
    ranges, low = [], 0
    for i, size in enumerate(sizes):
        if low < i and total[i + 1] - total[low] > max_tokens:
            ranges.append((low, i))
            low = max(low, bisect_right(total, total[i] - overlap) - 1)
        if size > max_tokens:
            ranges.append((low, i + 1))
            low = i + 1
    if low < len(sizes):
        ranges.append((low, len(sizes)))
    return ranges


def check_sizes(max_tokens: int | None, overlap: int | None) -> tuple[int, int]:
    """The sizes with defaults filled in. The check comes before the overlap's default, so 0 always means 100."""
    max_tokens = max_tokens if max_tokens and max_tokens > 0 else DEFAULT_MAX_TOKENS
    overlap = overlap or 0
    if overlap < 0 or overlap >= max_tokens:
        raise ValueError("overlap tokens must be between 0 and max tokens")
    return max_tokens, overlap or DEFAULT_OVERLAP_TOKENS


def split_markdown(markdown: str, max_tokens: int | None = None, overlap: int | None = None) -> list[dict]:
    """index, heading_path, markdown of the chunks of a text; no chunk for a blank one."""
    max_tokens, overlap = check_sizes(max_tokens, overlap)
    parts = []
    for text, path in blocks(markdown):
        if estimate(text) <= max_tokens or text.startswith(FENCES):
            parts.append((text, path))
        else:
            parts += [(piece, path) for piece in packed_words(text, max_tokens)]
    return [
        {"index": n, "heading_path": parts[b - 1][1], "markdown": "\n\n".join(text for text, _ in parts[a:b]).strip(WHITE) + "\n"}
        for n, (a, b) in enumerate(pack([estimate(text) for text, _ in parts], max_tokens, overlap))
    ]


CHUNK = pa.struct([("index", pa.int32()), ("heading_path", pa.list_(pa.string())), ("markdown", pa.string())])


def chunk_documents(df: DataFrame, keys: list[str], markdown: str, max_tokens: int | None = None, overlap: int | None = None) -> DataFrame:
    """A row per chunk: the keys, chunk_index, heading_path, markdown. Null and blank texts give no chunk.

    Texts are spread before the split, by length, so that a few very long ones don't share a task.
    """
    check_sizes(max_tokens, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            chunks = pa.array([split_markdown(t, max_tokens, overlap) if t else [] for t in texts], pa.list_(CHUNK))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), chunks], [*keys, "_chunks"])

    picked = df.select(*(df[k] for k in keys), df[markdown].alias("_text"))
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    split = picked.mapInArrow(run, f"{schema}, _chunks array<struct<index:int,heading_path:array<string>,markdown:string>>")
    return split.select(*keys, F.inline("_chunks")).withColumnRenamed("index", "chunk_index")


def chunk_sizes(max_tokens: Column, overlap: Column) -> tuple[Column, Column]:
    """Token limits with the defaults for null and 0."""
    size = F.when(max_tokens > 0, max_tokens).otherwise(DEFAULT_MAX_TOKENS)
    return size, F.when(overlap > 0, overlap).otherwise(DEFAULT_OVERLAP_TOKENS)
