import random
from datetime import datetime

import numpy as np
import pytest

from folioscope.llm import oversized as ov
from folioscope.operators.chunking import SPACE_RUN, WHITE, blocks, estimate

T = datetime(2025, 1, 1)


def needed_kind(text, limit):
    """The kind of cut a text needs, from its stretches and blocks."""
    if max(map(len, SPACE_RUN.split(text))) > 4 * limit:
        return "inside word"
    return "inside block" if any(estimate(b) > limit for b, _ in blocks(text)) else "between blocks"


def worst(pieces):
    return min((p["cut_kind"] for p in pieces if p["cut_kind"]), key=ov.RANKED.index, default="between blocks")


def test_orbit_follows_the_table():
    r = random.Random(2)
    for _ in range(50):
        n = r.randint(1, 200)
        table = np.array([r.randint(i + 1, min(n, i + 9)) for i in range(n)] + [n])
        walked = [0]
        while walked[-1] != n:
            walked.append(int(table[walked[-1]]))
        assert ov.orbit(table).tolist() == walked


def test_pieces_cover_the_text_within_the_limit():
    r = random.Random(7)
    for case in range(150):
        parts = []
        for _ in range(r.randint(1, 30)):
            own = lambda n, end: "".join(f"{chr(97 + r.randint(0, 25))}{r.randint(0, 10**6)}{end}" for _ in range(n))
            parts.append(r.choice([f"# {own(1, '')}\n", own(r.randint(1, 30), " "), "\n\n", own(r.randint(1, 8), "\n"), own(r.randint(1, 40), ""), f"```\n{own(2, '')}\n\ncode\n```\n", "\r\n", "é日 "]))
        text = "".join(parts)
        limit, overlap = r.choice([(10, 3), (20, 0), (50, 10), (8, 7), (40, 30)])
        pieces = ov.split_oversized(text, ["Top"], limit, overlap)
        plain = text.replace("\r\n", "\n")
        at = 0
        for p in pieces:
            assert p["n_tokens"] <= limit and estimate(p["markdown"]) == p["n_tokens"]
            starts = [i for i in range(max(0, at - 4 * limit), len(plain)) if plain.startswith(p["markdown"], i) and not plain[at:i].strip(WHITE)]
            assert starts
            at = max(at, starts[-1] + len(p["markdown"]))
        assert "".join(SPACE_RUN.sub("", p["markdown"][p["n_shared"] :]) for p in pieces) == SPACE_RUN.sub("", plain)
        assert not plain.strip(WHITE) or worst(pieces) == needed_kind(text, limit)
        assert not plain[at:].strip(WHITE) and [p["piece_no"] for p in pieces] == list(range(len(pieces)))


def test_natural_cuts_overlap_and_headings():
    text = "## A\n\n" + "one two three. " * 4 + "\n\n## B\n\n" + "four five six. " * 4
    pieces = ov.split_oversized(text, ["Top", "Old"], 20, 5)
    assert pieces[0]["markdown"].startswith("## A") and pieces[-1]["heading_path"] == ["Top", "B"]
    assert any(p["markdown"].startswith("## B") or "\n\n## B" in p["markdown"] for p in pieces)
    long = ov.split_oversized(" ".join(f"w{i:03}" for i in range(200)), None, 40, 10)
    for a, b in zip(long, long[1:]):
        assert 20 < len(set(a["markdown"].split()) & set(b["markdown"].split())) * 5 <= 45
    assert worst(ov.split_oversized("x" * 100, None, 10, 2)) == "inside word"
    assert worst(ov.split_oversized("ab " * 30, None, 10, 2)) == "inside block"
    assert worst(ov.split_oversized("ab cd ef gh\n\n" * 9, None, 10, 2)) == "between blocks"
    assert [p["cut_kind"] for p in ov.split_oversized("ab " * 30, None, 10, 2)][-1] is None
    exact = [p["n_shared"] for p in ov.split_oversized(" ".join(["abc"] * 400), None, 50, 10)[1:]]
    assert set(exact) == {40}
    for overlap in (10, 11, -1):
        with pytest.raises(ValueError):
            ov.split_oversized("ab " * 30, None, 10, overlap)
    assert ov.split_oversized(" " * 100, None, 10, 2)[0]["markdown"] == ""


def test_table(spark):
    schema = "point_no bigint, source_id string, markdown string, heading_path array<string>, loaded_at timestamp, pieces string"
    rows = [(1, "s", "ab " * 100, None, T, ""), (1, "s", "ab " * 100, None, T, ""), (2, "s", "short", ["h"], T, ""), (3, "unknown", "ab " * 1000, ["h", None], None, ""), (4, "s", None, None, T, ""), (5, "s", "", None, T, ""), (None, "s", "ab " * 100, None, T, ""), (6, None, "cd " * 1100, [], T, "")]
    configs = spark.createDataFrame([("s", 20, None), ("other", None, 0)], "source_id string, max_tokens int, overlap_tokens int")
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in ov.oversized_cases(df, configs).collect())
    assert got == [(1, "inside block"), (6, "inside block")]
    pieces = ov.oversized_pieces(df, configs).where("point_no = 6").collect()
    assert len(pieces) == 2 and all(p.n_tokens <= 800 for p in pieces)
    assert ov.oversized_cases(df.limit(0), configs).count() == 0
    assert all(r.within_limit and r.in_order for r in ov.checked_pieces(df, configs).collect())
    with pytest.raises(ValueError):
        ov.oversized_cases(df, spark.createDataFrame([("s", 20, 20)], configs.schema))


def test_a_block_that_fits_is_not_cut():
    r = random.Random(5)
    for _ in range(100):
        text = "\n\n".join(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 12))) for _ in range(r.randint(2, 20)))
        limit = max(estimate(b) for b in text.split("\n\n"))
        pieces = ov.split_oversized(text, None, limit, max(1, limit // 4) if limit > 1 else 0)
        assert {p["cut_kind"] for p in pieces[:-1]} <= {"between blocks"}
