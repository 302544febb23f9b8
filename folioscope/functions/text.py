"""Text functions as Column expressions; all but the hashing of terms stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the token rule and of the two regular expressions.
CHARS_PER_TOKEN = 4
TOKEN_PATTERN = r"([\p{L}\p{N}][\p{L}\p{N}_.:/@-]*)"
PART_SPLIT = r"[^\p{L}\p{Nd}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=[\p{L}\p{Nd}])(?=\p{Lu}\p{Ll})"
UNDIVIDED = r"^[\p{Ll}\p{Lo}\p{Nd}]+$"
FNV32_OFFSET = 2166136261
FNV32_PRIME = 16777619


def token_estimate(text: Column) -> Column:
    """ceil(code points / 4), at least 1, also for null."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / CHARS_PER_TOKEN)).cast("int")


def lowered(text: Column) -> Column:
    """Lower case character by character: a capital sigma is always σ and a dotted I always i, wherever they stand."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def normalized_text(text: Column) -> Column:
    """Lower case, runs of white space (Unicode ones too) become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(lowered(text), r"(?U)\s+", " "))


def word_set(text: Column) -> Column:
    """Distinct lower-case words (letters, digits, ``_``) of more than one byte, in order of appearance."""
    words = F.split(lowered(text), r"[^\p{L}\p{Nd}_]+")
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays without repeats; 0.0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def lexical_tokens(text: Column) -> Column:
    """Lower-cased tokens, each followed by those of its identifier parts that differ from it.

    A token of letters without case or in lower case and of digits has no parts and is taken as it is.
    """
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))

    def expand(token: Column) -> Column:
        whole = lowered(token)
        parts = F.transform(F.split(token, PART_SPLIT), lowered)
        kept = F.filter(parts, lambda p: (F.octet_length(p) > 1) & (p != whole))
        return F.when(F.rlike(token, F.lit(UNDIVIDED)), F.array(token)).otherwise(F.concat(F.array(whole), kept))

    return F.flatten(F.transform(found, expand))


def identifier_parts(token: Column) -> Column:
    """``HTTPServer2Go`` -> HTTP, Server2, Go."""
    return F.filter(F.split(token, PART_SPLIT), lambda p: p != "")


def _fnv1a32(words: pa.Array) -> np.ndarray:
    """FNV-1a 32 of the UTF-8 bytes of every word: byte by byte, all words that are long enough at once."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    starts, longest = ends[:-1][order], np.sort(sizes)
    state = np.full(len(words), FNV32_OFFSET, np.uint32)
    for place in range(int(longest[-1]) if len(longest) else 0):
        some = slice(0, len(words) - int(np.searchsorted(longest, place, "right")))
        state[some] = (state[some] ^ data[starts[some] + place]) * np.uint32(FNV32_PRIME)
    found = np.empty(len(words), np.int64)
    found[order] = state
    return found


def fnv1a32(text: Column) -> Column:
    """FNV-1a 32 of the UTF-8 bytes as BIGINT; null for null. An Arrow UDF: the JVM has no such hash."""

    @F.arrow_udf("bigint")
    def hashed(words: pa.Array) -> pa.Array:
        return pa.array(_fnv1a32(words.fill_null("")), mask=np.asarray(words.is_null()))

    return hashed(text)


def term_vectors(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Hashed terms (ascending, distinct) and values (1 + ln of the count) of every list of tokens; null where there is none.

    The distinct tokens of all lists are hashed once, then each list's hashes are counted.
    """
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    coded = lists.flatten().dictionary_encode()
    terms = _fnv1a32(coded.dictionary)[np.asarray(coded.indices)]
    keys, counts = np.unique(np.repeat(np.arange(len(lists)), sizes) << 32 | terms, return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(len(lists) + 1) << 32), pa.int32())
    absent = pa.array(sizes == 0)
    values = (1 + np.log(counts)).astype(np.float32)
    return tuple(pa.ListArray.from_arrays(bounds, pa.array(x), mask=absent) for x in (keys & 0xFFFFFFFF, values))


def embedding_text(title: Column, headings: Column, url: Column, markdown: Column) -> Column:
    """Provenance lines (only those that have a value), then the content."""
    path = F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " > ", "")
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x, F.lit("\n"))).otherwise("")
    return F.concat(
        line("Title: ", title), line("Headings: ", path), line("URL: ", url), F.lit("Content:\n"), F.coalesce(markdown, F.lit(""))
    )


def title_or_url(title: Column, url: Column) -> Column:
    return F.coalesce(F.when(title != "", title), url)


def printed(markdown: Column) -> Column:
    """A page as it is printed: with one final newline where it has none; null as an empty page."""
    text = F.coalesce(markdown, F.lit(""))
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def rfc3339(time: Column) -> Column:
    """A time as RFC 3339 text in UTC with microseconds (the session's time zone is UTC)."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_rfc3339(text: Column) -> Column:
    """The time; null for text that is none."""
    return F.try_to_timestamp(F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")), text))
