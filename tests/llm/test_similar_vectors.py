import numpy as np
import pytest

from folioscope.llm import similar_vectors as sv


def brute(rows, k):
    ids = [i for i, _ in rows]
    m = sv.unit(np.array([v for _, v in rows], np.float32))
    cos = np.round(m @ m.T, 9)
    pairs = set()
    for a, i in enumerate(ids):
        best = sorted((-cos[a, b], j) for b, j in enumerate(ids) if j != i)[:k]
        pairs |= {(min(i, j), max(i, j)) for _, j in best}
    return pairs


def clustered(n, d, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    return (centres[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32)


def test_recall_over_many_partitions(spark):
    rows = list(enumerate(clustered(3000, 64).tolist()))
    df = spark.createDataFrame(rows, "point_no bigint, dense_vector array<float>")
    got = {tuple(r) for r in sv.neighbour_pairs(df, "point_no", "dense_vector", part_rows=300, leaf_rows=32).collect()}
    wanted = brute(rows, 5)
    assert len(got & wanted) >= 0.98 * len(wanted) and len(got - wanted) <= 0.02 * len(wanted)


def test_copies_and_dirty_rows(spark):
    good = clustered(40, 8).tolist()
    rows = list(enumerate(good)) + [(100 + i, good[0]) for i in range(30)] + [(200 + i, good[1]) for i in range(3)]
    dirty = [(300, None), (301, []), (302, good[0][:-1]), (303, [0.0] * 8), (304, [float("nan")] * 8), (305, [None] * 8), (None, good[0]), (3, good[3]), (100, good[0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + dirty], "point_no bigint, dense_vector array<float>, ids string")
    got = sv.similar_vectors(df, "point_no", "dense_vector", dimensions=8).collect()
    assert {r.point_no for r in got} == {i for i, _ in rows} and all(r["rank"] <= 5 for r in got)
    assert {(min(r.point_no, r.neighbour), max(r.point_no, r.neighbour)) for r in got} == brute(rows, 5)
    assert sorted(r.neighbour for r in got if r.point_no == 129) == [0, 100, 101, 102, 103]


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "point_no bigint, dense_vector array<float>")
    assert sv.neighbour_pairs(df, "point_no", "dense_vector", dimensions=8).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 8)], "point_no bigint, dense_vector array<float>")
    assert sv.neighbour_pairs(one, "point_no", "dense_vector", dimensions=8).count() == 0


def test_chi_square_quantile():
    assert sv.chi_square_quantile(0.95, 16) == pytest.approx(26.296, rel=0.01)
    assert sv.chi_square_quantile(0.5, 16) == pytest.approx(15.338, rel=0.01)


def test_leaves_have_one_size_and_large_partitions_are_cut(spark):
    for n in (1, 64, 65, 1000, 5000):
        order, starts = sv.split_leaves(np.random.default_rng(n).standard_normal((n, 4)).astype(np.float32), 64)
        sizes = np.diff(np.append(starts, n))
        assert sorted(order.tolist()) == list(range(n)) and sizes.max() <= 64 and (n <= 64 or sizes.min() >= 16)
    same, _ = sv.split_leaves(np.ones((500, 4), np.float32), 64)  # equal coordinates are halved, too
    assert sorted(same.tolist()) == list(range(500))
    rows = list(enumerate(clustered(3000, 64, 5).tolist()))
    df = spark.createDataFrame(rows, "point_no bigint, dense_vector array<float>")
    got = {tuple(r) for r in sv.neighbour_pairs(df, "point_no", "dense_vector", sample_rows=32, part_rows=100, least_part_rows=1, leaf_rows=32).collect()}  # 4 top leaves
    wanted = brute(rows, 5)
    assert len(got & wanted) >= 0.98 * len(wanted) and len(got - wanted) <= 0.02 * len(wanted)
