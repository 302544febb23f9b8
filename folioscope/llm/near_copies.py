"""Near copies of texts: banded MinHash candidates, odd sketches, exact word-set similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import word_set
from folioscope.session import materialize

BANDS = 48
ROWS = 6
SKETCH_WORDS = 8  # 512 bits
SEED = 20260711
BUCKETS = 65_536  # in which the rows of bands are counted
ROWS_PER_SALT = 2000


def most_bits(similarity: float, samples: int, bits: int) -> int:
    """The XOR population count an odd sketch pair of this similarity is expected to have."""
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signatures(words: np.ndarray, starts: np.ndarray, bands: int, rows: int, sketch_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x sketch words) of non-empty sets of 64-bit word hashes.

    ``starts`` is where each text's words begin. A sketch flips, for every MinHash sample, the bit its position and
    value hash to, so the XOR of two sketches has bits only where the samples differ.
    """
    n, samples = len(starts), bands * rows
    by, add = _multipliers(samples)
    bits = 64 * sketch_words
    keys = np.zeros((n, bands), np.uint64)
    sketch = np.zeros((n, bits), np.uint8)
    row = np.arange(n)
    with np.errstate(over="ignore"):
        words = _mixed(words)
        for s in range(samples):
            least = np.minimum.reduceat(words * by[s] + add[s] >> np.uint64(20), starts)
            mixed = _mixed(least + np.uint64(s + 1 << 45))
            band = s // rows
            keys[:, band] = _mixed(keys[:, band] ^ mixed) if s % rows else mixed
            sketch[row, (mixed % np.uint64(bits)).astype(np.int64)] ^= 1
    packed = np.packbits(sketch, axis=1, bitorder="little").view("<u8")
    return keys.view(np.int64), packed.view(np.int64)


def word_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, k1, k2, words: a row per text with words; texts of the same word set have the same (k1, k2)."""
    words = F.array_sort(F.transform(word_set(F.col("text")), lambda w: F.xxhash64(w)))
    return (
        df.select(df[key].alias("key"), df[text].alias("text")).where("key is not null and text is not null")
        .select("key", words.alias("words")).where("size(words) > 0")
        .select("key", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("second"), "words").alias("k2"), "words")
    )


def banded_candidates(banded: DataFrame, n_rows: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """rep_a < rep_b, without repeats: all pairs of ``rep`` that agree in a ``band``.

    No band is capped. Rows are counted in ``BUCKETS`` hash buckets of bands (the counts are at most as many rows, so
    they may be broadcast); the bands of a bucket that has far more rows than the mean of ``n_rows`` are spread: one side
    of the join has one of the bucket's salts, the other a row for each.
    """
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "band"), F.lit(BUCKETS)).cast("int")
    mean = n_rows / BUCKETS
    counted = banded.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * mean + rows_per_salt)
    hot = materialize(counted.select("bucket", F.ceil((F.col("n") - mean) / rows_per_salt).cast("int").alias("salts")), "hot")
    on, left, right = ["band"], banded.withColumnRenamed("rep", "rep_a"), banded.withColumnRenamed("rep", "rep_b")
    if not hot.isEmpty():
        on = ["band", "salt"]
        spread = banded.withColumn("bucket", bucket).join(F.broadcast(hot), "bucket", "left").select("rep", "band", F.coalesce("salts", F.lit(1)).alias("salts"))
        left = spread.select(F.col("rep").alias("rep_a"), "band", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
        right = spread.select(F.col("rep").alias("rep_b"), "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.hint("merge").join(right, on).where("rep_a < rep_b").select("rep_a", "rep_b").distinct()


def class_pairs(classes: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, slack: float = 0.15) -> DataFrame:
    """rep_a < rep_b: all pairs of distinct word sets of at least ``threshold``.

    Sets that agree in some band of ``rows`` MinHash samples are candidates; of 48 bands of 6, a pair of similarity
    0.75 is missed once in 12,000, one of 0.8 once in 2 million. Candidates go on if their odd sketches' XOR has no more
    bits than a pair of similarity ``threshold - slack`` is expected to have (see the README for the share of pairs that
    this loses), and count if the exact similarity is reached.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("words"))
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(np.uint64)
            keys, sketch = signatures(flat, (offsets[:-1] - offsets[0]).astype(np.int64), bands, rows, SKETCH_WORDS)
            n = len(keys)
            lists_of = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("rep")), lists_of(keys), *(pa.array(sketch[:, i]) for i in range(SKETCH_WORDS))],
                ["rep", "bands", *(f"s{i}" for i in range(SKETCH_WORDS))],
            )

    sketch_columns = [f"s{i}" for i in range(SKETCH_WORDS)]
    kind = classes.schema["rep"].dataType.simpleString()
    signed = materialize(
        classes.select("rep", "words").mapInArrow(sign, f"rep {kind}, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in sketch_columns)),
        "sketches",
    )
    banded = signed.select("rep", F.explode("bands").alias("band"))
    candidates = banded_candidates(banded, signed.count() * bands)
    side = lambda x: signed.select(F.col("rep").alias(f"rep_{x}"), *(F.col(c).alias(f"{x}_{c}") for c in sketch_columns))
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in sketch_columns), F.lit(0))
    likely = candidates.join(side("a"), "rep_a").join(side("b"), "rep_b").where(
        apart <= most_bits(threshold - slack, bands * rows, 64 * SKETCH_WORDS)
    ).select("rep_a", "rep_b")
    likely = materialize(likely, "likely")
    words = lambda x: classes.select(F.col("rep").alias(f"rep_{x}"), F.col("words").alias(f"words_{x}"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    return (
        likely.join(words("a"), "rep_a").join(words("b"), "rep_b")
        .where(common >= threshold * (F.size("words_a") + F.size("words_b") - common))
        .select("rep_a", "rep_b")
    )


def near_copies(df: DataFrame, key: str, text: str, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (rep_a < rep_b) and the membership (key, rep).

    A class is all keys with the same word set (exact copies and reorderings), its representative the lowest key; so
    copies never meet in a bucket, however many there are. Redelivered rows count once; if rows of one key differ,
    each of their word sets counts. Null keys, null texts and texts without words take no part; an empty table gives
    empty results; other columns are not read.
    """
    hashed = materialize(word_classes(df, key, text), "words")
    classes = materialize(hashed.groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.first("words").alias("words")), "classes")
    members = hashed.select("k1", "k2", "key").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("key", "rep")
    return class_pairs(classes, threshold), members


def near_copy_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.75) -> DataFrame:
    """``key``_a < ``key``_b: all pairs of keys at or above the similarity, copies included."""
    pairs, members = near_copies(df, key, text, threshold)
    members = materialize(members, "members")
    copied = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    side = lambda x: members.select(F.col("rep").alias(f"rep_{x}"), F.col("key").alias(f"key_{x}"))
    met = pairs.unionByName(copied).join(side("a"), "rep_a").join(side("b"), "rep_b")
    return (
        met.where("(rep_a = rep_b and key_a < key_b) or (rep_a < rep_b and key_a <> key_b)")
        .select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b")).distinct()
    )


def near_copy_classes(df: DataFrame, key: str, text: str, threshold: float = 0.75) -> DataFrame:
    """A row per key: its class (``class_id``, the lowest key with the same words), the class's size and its links."""
    pairs, members = near_copies(df, key, text, threshold)
    links = (
        pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    )
    sizes = members.groupBy("rep").agg(F.count("*").alias("class_size"))
    return (
        members.join(sizes, "rep").join(links, "rep", "left")
        .select(F.col("key").alias(key), F.col("rep").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
