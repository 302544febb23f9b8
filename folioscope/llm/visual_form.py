"""One form for texts that look the same."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.batches import small_batches
from folioscope.session import materialize

# Letters and hyphens that are drawn alike, as pairs of (drawn alike, its form here): Cyrillic small and
# capital, Greek small and capital, Latin small capitals and others, Armenian, Cherokee, Lisu, Coptic, signs.
LOOK_ALIKES = dict(zip(
    "асеорхуіјѕһԁԛԝӏѵү" "АВЕЅІЈКМНОРСТУХԚԜӀѴҮԌ" "οϲνϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "ɑɡᴄᴏꜱᴠᴡᴢ" "օսհոզցյՕՍՏԼ" "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏂᏃᏏᏙᏚᏞᏟᏢᏦᏧᏴ"
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ⲟⲣⲥⲞⲢⲤⲎⲒⲔⲘⲚⲦⲬⲂ" "µ" "‐‑﹣－˗⁃−",
    "aceopxyijshdqwlvy" "ABESIJKMHOPCTYXQWIVYG" "ocvj" "ABEZHIKMNOPTYXCJ" "agcosvwz" "ouhnqgjOUSL" "DRTiYAJEWMHGhZbVSLCPKdB"
    "BPDTGKJCZFMNLSRVHWXYAEIOU" "opcOPCHIKMNTXB" "μ" "-------",
    strict=True,
))
ZERO_WIDTH_JOINER = 0x200D
FILLERS = frozenset((0x115F, 0x1160, 0x2065, 0x3164, 0xFFA0, *range(0xFFF0, 0xFFF9)))
LAST = 0x110000
PLAIN = re.compile(r"[^\n\t\x20-\x7e]")


def _unseen(cp: int, category: str) -> bool:
    """Characters without an image: format and control characters, grapheme joiner, variation selectors, Hangul
    fillers and the unassigned code points that are ignored by default.

    Arabic and Indic signs that enclose digits are drawn though they count as format characters, and the tag
    characters (U+E0020...) choose between flags.
    """
    if category == "Cc":
        return cp not in (0x09, 0x0A, 0x0D)
    if category == "Cf":
        return not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2) or 0x110BD <= cp <= 0x1343F or cp >= 0xE0020)
    return cp in FILLERS or cp in (0x34F, 0x17B4, 0x17B5) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def _replacement(cp: int) -> str | None:
    """What a code point becomes before its marks are ordered; None: it stays."""
    char = chr(cp)
    category = unicodedata.category(char)
    if _unseen(cp, category):
        return ""
    if category == "Zs":
        return " "
    if category in ("Zl", "Zp"):
        return "\n"
    if 0xAC00 <= cp <= 0xD7A3:
        return None  # a Hangul syllable stays whole
    tag, *parts = unicodedata.decomposition(char).split() or [""]
    became = char
    if tag in ("<wide>", "<narrow>", "<font>") and category[0] in "LN":
        became = chr(int(parts[0], 16))  # also the mathematical letters and digits
    elif tag == "<compat>" and category[0] == "L" and len(parts) > 1:
        joined = "".join(chr(int(p, 16)) for p in parts)
        if all(unicodedata.category(c)[0] == "L" for c in joined):
            became = joined  # joined letters
    elif 0x2160 <= cp <= 0x217F:
        became = unicodedata.normalize("NFKD", char)  # Roman numerals
    became = "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", became))
    return None if became == char else became


@cache
def tables() -> dict[str, np.ndarray]:
    """Decomposition, look-alike, class and composition tables, derived from the Unicode database of Python."""
    start, count = np.arange(LAST, dtype=np.int32), np.ones(LAST, np.int32)
    extra: list[int] = []
    classes, picture = np.zeros(LAST, np.uint8), np.zeros(LAST, bool)
    joins: dict[int, int] = {}
    second = np.zeros(LAST, bool)
    for cp in range(LAST):
        if 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or 0xF0000 <= cp or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp < 0xE0000:
            continue  # private use and ideographs: nothing to replace
        char = chr(cp)
        classes[cp] = unicodedata.combining(char)
        picture[cp] = unicodedata.category(char) == "So" or 0x1F3FB <= cp <= 0x1F3FF or cp == 0xFE0F
        if (became := _replacement(cp)) is not None:
            start[cp], count[cp] = LAST + len(extra), len(became)
            extra.extend(map(ord, became))
        two = unicodedata.decomposition(char).split()
        if len(two) == 2 and two[0][0] != "<":
            a, b = (int(x, 16) for x in two)
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == char:
                joins[a << 32 | b] = cp
                second[b] = not unicodedata.combining(chr(b))
    keys = np.array(sorted(joins), np.int64)
    return {
        "start": start, "count": count, "pool": np.concatenate((np.arange(LAST), extra)).astype(np.uint32), "class": classes,
        "picture": picture, "second": second, "pair": keys, "joined": np.array([joins[k] for k in keys.tolist()], np.uint32),
    }


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the two compose by the table, and what they become."""
    t = tables()
    keys = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(t["pair"], keys), len(t["pair"]) - 1)
    return t["pair"][at] == keys, t["joined"][at]


def _hangul(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_pairs`` for Hangul, by the rule of its syllables: consonant and vowel, then final consonant."""
    left, right = left.astype(np.int64), right.astype(np.int64)
    opened = (left >= 0x1100) & (left <= 0x1112) & (right >= 0x1161) & (right <= 0x1175)
    closed = (left >= 0xAC00) & (left <= 0xD7A3) & ((left - 0xAC00) % 28 == 0) & (right >= 0x11A8) & (right <= 0x11C2)
    syllable = np.where(opened, 0xAC00 + ((left - 0x1100) * 21 + right - 0x1161) * 28, left + right - 0x11A7)
    return opened | closed, syllable.astype(np.uint32)


def _composed(out: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points with vowel signs and Hangul parts composed with what stands just before them, and their old places.

    Left to right within a text: a composition can compose again with what follows, so rounds go on until none is left.
    """
    t = tables()
    first = np.zeros(len(out) + 1, bool)
    first[starts] = True
    places = np.arange(len(out))
    while True:
        spots = np.flatnonzero((t["second"][out[1:]] | ((out[1:] >= 0x1161) & (out[1:] <= 0x11C2))) & ~first[places[1:]]) + 1
        done = np.zeros(len(out), bool)
        for rule in (_pairs, _hangul):
            joins, became = rule(out[spots - 1], out[spots])
            joins &= ~done[spots] & ~done[spots - 1]
            joins[1:] &= ~(joins[:-1] & (spots[1:] == spots[:-1] + 1))  # the left one of two that overlap
            out[spots[joins] - 1] = became[joins]
            done[spots[joins]] = True
        if not done.any():
            return out, places
        out, places = out[~done], places[~done]


def _ordered(out: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Combining marks in the order of their classes and composed with their letters; out's places to keep.

    ``starts``: where texts begin; a mark at the start of a text has no letter.
    """
    t = tables()
    keep = np.ones(len(out), bool)
    marks = np.flatnonzero(t["class"][out] > 0)
    if not len(marks):
        return keep
    first = np.zeros(len(out) + 1, bool)
    first[starts] = True
    fresh = np.ones(len(marks), bool)
    fresh[1:] = (np.diff(marks) > 1) | first[marks[1:]]
    run = np.cumsum(fresh) - 1
    out[marks] = out[marks][np.lexsort((t["class"][out[marks]], run))]
    begins = marks[fresh]
    has_letter = (begins > 0) & ~first[begins]
    letter = np.where(has_letter, begins - 1, 0)
    length = np.bincount(run)
    last_class = np.zeros(len(begins), np.int16)
    for k in range(int(length.max())):
        on = np.flatnonzero((length > k) & has_letter)
        mark = begins[on] + k
        own = t["class"][out[mark]]
        joins, became = _pairs(out[letter[on]], out[mark])
        joins &= last_class[on] < own
        out[letter[on[joins]]] = became[joins]
        keep[mark[joins]] = False
        last_class[on[~joins]] = own[~joins]
    return keep


def visual_forms(texts: list[str | None]) -> list[str | None]:
    """The form of each text; null for null.

    The texts become one array of positioned code points. Every point is replaced through the decomposition and
    look-alike table (several points, one or none), vowel signs and Hangul parts are composed, combining marks are
    ordered by class and composed again, and the texts are rebuilt. A text's form never depends on the texts beside it.
    """
    result = list(texts)
    odd = [i for i, x in enumerate(texts) if x and PLAIN.search(x)]
    if not odd:
        return result
    t = tables()
    chosen = [texts[i].replace("\r\n", "\n").replace("\r", "\n") for i in odd]
    points = np.frombuffer("".join(chosen).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, chosen)])
    count = t["count"][points]
    joiners = np.flatnonzero(points == ZERO_WIDTH_JOINER)
    joiners = joiners[(joiners > 0) & (joiners < len(points) - 1)]
    joiners = joiners[t["picture"][points[joiners - 1]] & t["picture"][points[joiners + 1]]]
    start = t["start"][points].astype(np.int64)
    start[joiners], count[joiners] = ZERO_WIDTH_JOINER, 1
    ends = np.cumsum(count, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    out = t["pool"][np.arange(total) + np.repeat(start - (ends - count), count)]
    bounds = np.concatenate(([0], ends))[bounds]
    out, places = _composed(out, bounds[:-1])
    bounds = np.searchsorted(places, bounds)
    keep = _ordered(out, bounds[:-1])
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    whole = out[keep].astype("<u4").tobytes().decode("utf-32-le")
    for i, a, b in zip(odd, bounds[:-1].tolist(), bounds[1:].tolist()):
        result[i] = whole[a:b]
    return result


def _mapped(df: DataFrame, key: str, text: str, schema: str, build) -> DataFrame:
    picked = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "text", 2 << 20):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield build(part.column(part.schema.get_field_index("key")), texts, visual_forms(texts))

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, {schema}")


def with_visual_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``form``: texts that look the same have the same form.

    Null gives null, empty and blank texts a form like any other. No shuffle; only the two columns are read.
    """
    build = lambda keys, texts, forms: pa.RecordBatch.from_arrays([keys, pa.array(forms, pa.string())], ["key", "form"])
    return _mapped(df, key, text, "form string", build).withColumnRenamed("key", key)


def hashed_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, f1, f2 (128 bits of the form), t1, t2 (128 bits of the text) of every text that shows something."""

    def build(keys: pa.Array, texts: list[str | None], forms: list[str | None]) -> pa.RecordBatch:
        digest = lambda x: hashlib.blake2b(x.encode(), digest_size=16).digest()
        shown = [i for i, f in enumerate(forms) if f is not None and f.strip()]
        form = np.frombuffer(b"".join(digest(forms[i]) for i in shown), np.int64).reshape(-1, 2)
        own = np.frombuffer(b"".join(digest(texts[i]) for i in shown), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(shown, pa.int64())), *(pa.array(x[:, i]) for x in (form, own) for i in (0, 1))], ["key", "f1", "f2", "t1", "t2"]
        )

    return _mapped(df, key, text, "f1 bigint, f2 bigint, t1 bigint, t2 bigint", build).where("key is not null")


def look_alike_pairs(df: DataFrame, key: str, text: str, rows_per_salt: int = 2000) -> DataFrame:
    """``key``_a < ``key``_b: texts that differ in their code points but have the same form.

    Null texts and texts that show nothing but white space take no part; equal texts are no pair; repeated rows count
    once. Only hashes are shuffled (128 bits of the form, 128 of the text). Groups whose texts are all equal are left
    out before any pair is made, and the rows of a larger group are spread over one salt per ``rows_per_salt`` rows.
    """
    rows = materialize(hashed_forms(df, key, text), "forms")
    groups = (
        rows.groupBy("f1", "f2").agg(F.min("t1").alias("least"), F.max("t1").alias("most"), F.count("*").alias("n"))
        .where("least <> most").select("f1", "f2", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts"))
    )
    grouped = materialize(rows.join(groups, ["f1", "f2"]).distinct(), "alike")
    one = grouped.select("f1", "f2", F.expr("pmod(xxhash64(key), salts)").cast("int").alias("salt"), F.col("key").alias("key_a"), F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    other = grouped.select("f1", "f2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("key_b"), "t1", "t2")
    return (
        one.join(other, ["f1", "f2", "salt"]).where("key_a < key_b and (t1 <> u1 or t2 <> u2)")
        .select(F.col("key_a").alias(f"{key}_a"), F.col("key_b").alias(f"{key}_b")).distinct()
    )


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, class_id (the lowest key of the texts that look the same), class_size and n_texts (different ones of them).

    The linear form of ``look_alike_pairs``, for groups of any size. Null texts and texts that show nothing but white
    space take no part; repeated rows of a key count once, and a key whose rows differ belongs to the class of each.
    """
    rows = materialize(hashed_forms(df, key, text).distinct(), "forms")
    texts = rows.select("f1", "f2", "t1", "t2").distinct().groupBy("f1", "f2").agg(F.count("*").alias("n_texts"))
    members = rows.select("key", "f1", "f2").distinct()
    classes = members.groupBy("f1", "f2").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")).join(texts, ["f1", "f2"])
    return members.join(classes, ["f1", "f2"]).select(F.col("key").alias(key), "class_id", "class_size", "n_texts")


def changed_points() -> dict[int, str]:
    """Code points that have another form than themselves, and that form before it is composed."""
    t = tables()
    told = {cp: "".join(map(chr, t["pool"][t["start"][cp] : t["start"][cp] + t["count"][cp]].tolist())) for cp in np.flatnonzero(t["start"] != np.arange(LAST)).tolist()}
    return {cp: form for cp, form in told.items() if unicodedata.normalize("NFC", form) != chr(cp)}
