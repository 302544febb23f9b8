"""Byte-level BPE of a whole corpus with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

# Fixed values of the public tokenizer byte_bpe_50k: its word pattern and the folder of its file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = "/opt/tokenizers"
NO_RANK = np.iinfo(np.int32).max


def printable_bytes() -> dict[str, int]:
    """The character each byte has in a byte-level vocabulary file: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexEncoder:
    """Encodes many words at once.

    Every pair of neighbouring symbols that some merge joins is indexed with all its positions in the block of words.
    The active ranks are taken in ascending order; a rank's merge is applied to all its positions in one step, and
    only the lists of the pairs beside them are updated. A merge can only create pairs of higher rank, so each rank
    is taken at most once. Words seen before in the same Python worker are not encoded again; ``cache_words`` bounds
    that memory and does not change any result.
    """

    def __init__(self, path: str, cache_words: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in printable_bytes().items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        self.made = np.fromiter((vocab[a + b] for a, b in pairs), np.int32, len(pairs))
        self.twin = left == right
        keys = left << 32 | right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.words = regex.compile(WORD_PATTERN)
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where each word starts (one more than words)."""
        coded = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        n = int(bounds[-1])
        if n == 0:
            return np.zeros(0, np.int32), bounds
        ids = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        following = np.arange(1, n + 1)
        following[bounds[1:][sizes > 0] - 1] = n  # n: nothing follows within the word
        before = np.arange(-1, n)
        before[bounds[:-1][sizes > 0]] = n
        ids = np.append(ids, -1)
        following, before = np.append(following, n), before
        alive = np.ones(n + 1, bool)
        rank = np.full(n + 1, NO_RANK, np.int32)
        inner = np.flatnonzero(following[:n] < n)
        rank[inner] = self.ranks(ids[inner], ids[following[inner]])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(places: np.ndarray) -> None:
            places = places[rank[places] < NO_RANK]
            if not len(places):
                return
            found = rank[places]
            places = places[np.argsort(found, kind="stable")]
            found = rank[places]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enlist(inner)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = at[alive[at] & (rank[at] == r)]
            at = np.unique(at)
            if self.twin[r] and len(at) > 1:  # aaa: the left pair wins, as in reading order
                chained = np.concatenate(([False], following[at[:-1]] == at[1:]))
                place = np.arange(len(at))
                run_start = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - run_start) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            after = following[gone]
            ids[at] = self.made[r]
            alive[gone] = False
            rank[gone] = NO_RANK
            following[at] = after
            before[after] = at  # before[n] is a spare place
            rank[at] = NO_RANK
            on = at[after < n]
            rank[on] = self.ranks(ids[on], ids[following[on]])
            left = before[at]
            left = left[left < n]
            if self.twin[r]:
                left = np.unique(left)
            rank[left] = self.ranks(ids[left], ids[following[left]])
            enlist(np.unique(np.concatenate((on, left))) if self.twin[r] else np.concatenate((on, left)))
        kept = alive[:n]
        return ids[:n][kept], np.concatenate(([0], np.cumsum(kept)))[bounds]

    def learn(self, fresh: list[str]) -> None:
        ids, starts = self.encode_words(fresh)
        base = len(self.known)
        for i, w in enumerate(fresh):
            self.known[w] = base + i
        self.starts = np.concatenate((self.starts, starts[1:] + self.starts[-1]))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, one after another; null and empty have none."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > self.cache_words:
            self.forget()
        flat = list(chain.from_iterable(split))
        number = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            unknown = [flat[i] for i in missing]
            self.learn(list(dict.fromkeys(unknown)))
            number[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        first, size = self.starts[number], np.diff(self.starts)[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(first - (ends - size), size)]
        words_until = np.cumsum([0, *map(len, split)])
        return np.concatenate(([0], ends))[words_until], ids


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """One encoder per tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexEncoder(path)
    return _ENCODERS[path]


def blocks(batches: Iterator[pa.RecordBatch], column: str, block_chars: int) -> Iterator[pa.Table]:
    """Record batches gathered, and cut between rows, to about ``block_chars`` bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
        start = 0
        while start < batch.num_rows:
            room = np.cumsum(lengths[start:]) + size
            take = max(1, int(np.searchsorted(room, block_chars, "right")))
            part = batch.slice(start, take)
            held.append(part)
            size += int(lengths[start : start + take].sum())
            start += part.num_rows
            if size >= block_chars or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def token_ids(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, block_chars: int = 8_000_000) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, by byte_bpe_50k without special tokens.

    No shuffle: each partition's texts are taken in blocks of about ``block_chars`` bytes, the block's distinct words
    are encoded together and the ids put together by text. The strings of special tokens are ordinary text. Null and
    empty texts give an empty list; blank ones are encoded like any other; repeated rows each keep their row; a row
    with a null key keeps it. Only the two named columns are read, so others can't clash.
    """
    path = f"{tokenizer_dir}/byte_bpe_50k.json"
    picked = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for block in blocks(batches, "text", block_chars):
            offsets, ids = own.encode(block.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            keys = block.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, lists], ["key", "ids"])

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, block_chars: int = 8_000_000) -> DataFrame:
    """``key`` and ``n_tokens`` (bigint) of every row whose text is neither null nor empty, as ``token_ids`` encodes it."""
    path = f"{tokenizer_dir}/byte_bpe_50k.json"
    picked = df.select(df[key].alias("key"), df[text].alias("text")).where("text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for block in blocks(batches, "text", block_chars):
            offsets, _ = own.encode(block.column("text").to_pylist())
            keys = block.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets), pa.int64())], ["key", "n_tokens"])

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def decoded_texts(df: DataFrame, key: str, ids: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``text``: the bytes of the tokens put together, the inverse of ``token_ids``; an empty list gives an empty text."""
    path = f"{tokenizer_dir}/byte_bpe_50k.json"
    picked = df.select(df[key].alias("key"), df[ids].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        bytes_of = printable_bytes()
        shown = sorted(((i, bytes(bytes_of[c] for c in token)) for token, i in vocab.items() if all(c in bytes_of for c in token)))
        place = np.full(max(i for i, _ in shown) + 1, -1)
        place[[i for i, _ in shown]] = np.arange(len(shown))
        table = pa.array([b for _, b in shown], pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, lists = (column.slice(at, 1000) for column in batch.columns)
                offsets = np.asarray(lists.offsets)
                tokens = table.take(pa.array(place[np.asarray(lists.values)[offsets[0] : offsets[-1]]]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), tokens), b"")
                yield pa.RecordBatch.from_arrays([keys, joined.cast(pa.string())], ["key", "text"])

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
