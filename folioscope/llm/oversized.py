"""Splitting oversized texts at natural boundaries, all cuts at once by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.batches import small_batches
from folioscope.functions.text import token_estimate
from folioscope.operators.chunking import DEFAULT_MAX_TOKENS, WHITE, block_spans, chunk_sizes, estimate

SPACES = np.array([ord(c) for c in WHITE], np.uint32)


RANKED = ("inside word", "inside block", "between blocks")  # the worst first
KINDS = ("inside word", "inside block", "inside block", "between blocks")  # of a boundary: none, word, line, block


def boundaries(points: np.ndarray, block_starts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, kind and end of the text before of every place where a text may be cut, the end of the text included.

    Places are the starts of words (1), those of them that begin a line (2) or a block (3), and, only within a stretch
    longer than ``room`` without white space, every code point (0).
    """
    dark = np.concatenate(([False], ~np.isin(points, SPACES), [False]))
    starts, ends = np.flatnonzero(dark[1:] & ~dark[:-1]), np.flatnonzero(dark[:-1] & ~dark[1:])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    kind = np.ones(len(starts), np.int8)
    kind[1:][lines[starts[1:]] > lines[ends[:-1]]] = 2
    kind[np.isin(starts, starts[np.searchsorted(starts, block_starts)])] = 3
    size = np.where(ends - starts > room, ends - starts, 1)
    until = np.cumsum(size)
    inner = np.arange(until[-1]) - np.repeat(until - size, size)
    position = np.repeat(starts, size) + inner
    before = np.where(inner > 0, position, np.repeat(np.concatenate(([starts[0]], ends[:-1])), size))
    return np.append(position, ends[-1]), np.append(np.where(inner > 0, 0, np.repeat(kind, size)), 3), np.append(before, ends[-1])


def successors(position: np.ndarray, kind: np.ndarray, before: np.ndarray, room: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a cut at every boundary: the boundary where the next piece starts, and its farthest legal end.

    The piece after a cut starts at the boundary nearest to ``overlap`` code points before it. It ends at the last
    block start it reaches, else at the last line start, else at the last word start, else inside a word. The overlap
    gives way only where it would cut what can be kept whole: after a cut between blocks, so that the next block fits,
    and anywhere so that the next word fits. The text of a piece is at most ``room`` long, and the end always lies
    behind the cut.
    """
    n = len(position) - 1
    at = np.arange(n + 1)
    wanted = np.maximum(position - overlap, position[0])
    low = np.searchsorted(position, wanted, "right") - 1
    high = np.minimum(np.searchsorted(position, wanted), at)
    nearer = (wanted - position[low] <= position[high] - wanted) & (position - position[low] < room)
    start = np.minimum(np.where(nearer, low, high), at)
    reached = lambda begin: np.searchsorted(before, position[begin] + room, "right") - 1
    last = [np.maximum.accumulate(np.where(kind >= k, at, 0)) for k in range(4)]
    following = [np.minimum.accumulate(np.where(kind >= k, at, n)[::-1])[::-1][np.minimum(at + 1, n)] for k in range(4)]
    end = np.zeros(n + 1, np.int64)
    for k in (3, 2, 1):
        found = last[k][reached(start)]
        end = np.where((end == 0) & (found > at), found, end)
        if k != 2:  # the next block or word would fit with less overlap
            target = following[k]
            fits = (end == 0) & (before[target] - position <= room) & ((k == 1) | (kind == 3))
            start = np.where(fits, np.clip(np.searchsorted(position, before[target] - room), start, at), start)
            end = np.where(fits, last[k][reached(start)], end)
    start = np.where((end == 0) & (reached(start) <= at), at, start)
    end = np.where(end == 0, reached(start), end)
    return start, np.where(at == n, n, end)


def orbit(table: np.ndarray) -> np.ndarray:
    """All positions reached from 0 until the last one, which is its own successor.

    The table is squared again and again; each square doubles the positions known, so all greedy cuts are found in
    log(cuts) steps.
    """
    reached = np.zeros(1, np.int64)
    while reached[-1] != len(table) - 1:
        reached = np.unique(np.concatenate((reached, table[reached])))
        table = table[table]
    return reached


def split_oversized(markdown: str, path: list[str | None] | None, limit: int, overlap: int) -> list[dict]:
    """Ordered pieces of at most ``limit`` estimated tokens, each with its heading path and the kind of the cut behind it.

    A piece's path is the text's own path; below a heading within the text, that path up to the heading's level and
    the headings of the text. ``n_shared`` is how many of its first code points lie before the cut it starts behind;
    without them the pieces put together are the text but for white space at the cuts. The last piece has no cut.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap tokens must be between 0 and max tokens")
    text = markdown.replace("\r\n", "\n")
    lines = text.split("\n")
    offsets = [0, *accumulate(len(line) + 1 for line in lines)]
    spans = [x for x in block_spans(lines) if "".join(lines[x[0] : x[1]]).strip(WHITE)]
    starts = np.array([offsets[a] for a, _, _ in spans], np.int64)
    position, kind, before = boundaries(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), starts, 4 * limit)
    if not len(position):  # white space only
        return [{"piece_no": 0, "heading_path": list(path or []), "markdown": "", "n_tokens": 1, "n_shared": 0, "cut_kind": None}]
    begin, end = successors(position, kind, before, 4 * limit, 4 * overlap)
    pieces = []
    for cut in orbit(end)[:-1].tolist():
        piece = text[position[begin[cut]] : before[end[cut]]]
        own = spans[int(np.searchsorted(starts, before[end[cut]] - 1, "right")) - 1][2]
        base = list(path or [])
        level = next((i for i, h in enumerate(own) if h), len(own))
        whole = base if not own else [*(base + [""] * level)[:level], *own[level:]]
        pieces.append({
            "piece_no": len(pieces), "heading_path": whole, "markdown": piece, "n_tokens": estimate(piece), "n_shared": int(position[cut] - position[begin[cut]]),
            "cut_kind": KINDS[kind[end[cut]]] if end[cut] < len(position) - 1 else None,
        })
    return pieces


PIECE = pa.struct([
    ("piece_no", pa.int32()), ("heading_path", pa.list_(pa.string())), ("markdown", pa.string()), ("n_tokens", pa.int32()), ("n_shared", pa.int32()), ("cut_kind", pa.string()),
])
PIECES = "array<struct<piece_no:int,heading_path:array<string>,markdown:string,n_tokens:int,n_shared:int,cut_kind:string>>"


def split_arrays(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """point_no and the array of pieces of every chunk above its source's limit."""
    explicit = F.coalesce(F.col("overlap_tokens"), F.lit(0))
    size, overlap = chunk_sizes(F.col("max_tokens"), F.col("overlap_tokens"))
    wrong = configs.where((explicit < 0) | (explicit >= size)).limit(3).collect()
    if wrong:
        raise ValueError(f"overlap tokens must be between 0 and max tokens: {wrong}")
    overlap = F.when(explicit > 0, explicit).otherwise(F.least(overlap, F.floor(size / 2))).cast("int")
    limits = configs.groupBy("source_id").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("c")).select("source_id", "c.*")
    large = (
        chunks.where("point_no is not null and markdown <> ''").select("point_no", "source_id", "markdown", "heading_path", "loaded_at")
        .join(limits, "source_id", "left").withColumn("limit", size).withColumn("overlap", overlap)
        .where(token_estimate(F.col("markdown")) > F.col("limit"))
        .groupBy("point_no")
        .agg(F.max_by(F.struct("markdown", "heading_path", "limit", "overlap"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))).alias("c"))
        .select("point_no", "c.*")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "markdown", 1 << 20):
            part = batch.to_pydict()
            pieces = [split_oversized(*row) for row in zip(part["markdown"], part["heading_path"], part["limit"], part["overlap"])]
            yield pa.RecordBatch.from_arrays([pa.array(part["point_no"], pa.int64()), pa.array(pieces, pa.list_(PIECE))], ["point_no", "pieces"])

    return large.mapInArrow(run, f"point_no bigint, pieces {PIECES}")


def oversized_pieces(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """point_no, piece_no, heading_path, markdown, n_tokens, n_shared, cut_kind of every chunk above its source's limit.

    Limit and overlap are the source's, or 800 and 100 where they are null, 0 or the source has no row (the lowest
    row counts if it has several); the default overlap is at most half a smaller limit. A source whose own overlap is
    negative or not below its limit is an error. Null and empty texts are never oversized; redelivered rows count once
    (the latest); null heading paths count as empty. Rows with a null point_no are left out. Only the chunks above the
    limit reach Python and the one shuffle, which also spreads a hot source over all tasks.
    """
    return split_arrays(chunks, configs).select("point_no", F.inline("pieces"))


def oversized_cases(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """point_no and cut_kind of every chunk above the limit: the worst of the cuts it got.

    A cut lies inside a word only if a stretch without white space is above the limit, and inside a block only if a
    block is; a text that needs no cut, as only the white space around it is too much, counts as cut between blocks.
    """
    kinds = F.transform("pieces", lambda x: F.array_position(F.array(*map(F.lit, reversed(RANKED))), x["cut_kind"]))
    worst = F.greatest(F.lit(1), F.coalesce(F.array_max(kinds), F.lit(1))).cast("int")
    return split_arrays(chunks, configs).select("point_no", F.element_at(F.array(*map(F.lit, reversed(RANKED))), worst).alias("cut_kind"))


def checked_pieces(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """A row per oversized chunk on its pieces: whether they are in order and within the limit, and the MD5 of what they
    hold without the shared parts and without white space, which must be that of the chunk.
    """
    size, _ = chunk_sizes(F.col("max_tokens"), F.col("overlap_tokens"))
    limits = configs.groupBy("source_id").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("c")).select("source_id", "c.*").withColumn("limit", size)
    sources = chunks.where("point_no is not null").groupBy("point_no").agg(F.max("source_id").alias("source_id")).join(limits, "source_id", "left")
    own = F.transform("pieces", lambda x: F.substring(x["markdown"], x["n_shared"] + 1, F.char_length(x["markdown"])))
    told = split_arrays(chunks, configs).select(
        "point_no", F.array_max("pieces.n_tokens").alias("longest"), (F.col("pieces.piece_no") == F.sequence(F.lit(0), F.size("pieces") - 1)).alias("in_order"),
        F.md5(F.regexp_replace(F.array_join(own, ""), "[" + WHITE + "]+", "")).alias("body"),
    )
    return told.join(sources, "point_no").select("point_no", (F.col("longest") <= F.coalesce("limit", F.lit(DEFAULT_MAX_TOKENS))).alias("within_limit"), "in_order", "body")
