import random
import re

import numpy as np
import pytest

from folioscope.llm import near_copies as nc


def words(text):
    return {w for w in re.split(r"[^\w]+", text.lower()) if len(w.encode()) > 1}


def fixture():
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = []
    for group in range(12):
        base = r.sample(vocabulary, r.randint(8, 60))
        for copy in range(5):
            edited = [w for w in base if r.random() > 0.08 * copy / 2] + r.sample(vocabulary, copy)
            r.shuffle(edited)
            texts.append(" ".join(edited))
    texts += [texts[0]] * 30 + [texts[0].upper() + "!"] + [None, "", " ", "a b c", "one two", "one two"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def case(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows] + [(0, rows[0][1], "y", 1)], "point_no bigint, markdown string, rep string, band int")
    sets = [(i, words(t)) for i, t in rows if t and words(t)]
    wanted = {(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) >= 0.75 * len(a | b)}
    return df, sets, wanted


def test_pairs_match_brute_force(case):
    df, _, wanted = case
    assert {tuple(r) for r in nc.near_copy_pairs(df, "point_no", "markdown").collect()} == wanted


def test_classes(case):
    df, sets, _ = case
    rows = {r.point_no: r for r in nc.near_copy_classes(df, "point_no", "markdown").collect()}
    assert set(rows) == {i for i, _ in sets}
    for i, s in sets:
        same = [j for j, t in sets if t == s]
        distinct = {frozenset(t) for _, t in sets if t != s and len(t & s) >= 0.75 * len(t | s)}
        assert (rows[i].class_id, rows[i].class_size, rows[i].n_links) == (min(same), len(same), len(distinct))


def test_empty(spark):
    df = spark.createDataFrame([], "point_no bigint, markdown string")
    assert nc.near_copy_pairs(df, "point_no", "markdown").count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 150).astype(np.uint64)
    for extra in (0, 20, 100, 600):
        a, b = (np.concatenate((common, rng.integers(0, 2**63, extra).astype(np.uint64))) for _ in range(2))
        keys, sketch = nc.signatures(np.concatenate((a, b)), np.array([0, len(a)]), 48, 6, 8)
        apart = sum(int(x).bit_count() for x in (sketch[0] ^ sketch[1]).view(np.uint64).tolist())
        similarity = 150 / (150 + 2 * extra)
        assert abs(apart - nc.most_bits(similarity, 288, 512)) < 50
        assert (keys[0] == keys[1]).all() == (extra == 0)


def test_a_hot_band_is_spread_and_loses_no_pair(spark):
    r = random.Random(4)
    rows = [(i, 7) for i in range(60)] + [(i, 1000 + i // 3) for i in range(60)] + [(r.randint(0, 59), b) for b in range(2000, 2100)]
    df = spark.createDataFrame(rows, "rep bigint, band bigint")
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60)}
    for rows_per_salt in (5, 10_000):
        found = nc.banded_candidates(df, len(rows), rows_per_salt)
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    assert nc.banded_candidates(df.limit(0), 0).count() == 0


def test_sketches_lose_few_pairs():
    """Odd sketches of pairs of similarity 0.75, drawn as differing samples that each flip a bit on either side."""
    rng = np.random.default_rng(2)
    most, lost = nc.most_bits(0.6, 288, 512), 0
    for _ in range(20_000):
        flips = rng.integers(0, 512, 2 * rng.binomial(288, 0.25))
        lost += int((np.bincount(flips, minlength=512) % 2).sum()) > most
    assert lost <= 20
