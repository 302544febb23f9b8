import numpy as np

from folioscope.llm import similar_vectors as sv
from tests.llm.test_similar_vectors import brute, clustered


def pairs(spark, rows, **options):
    df = spark.createDataFrame(rows, "point_no bigint, dense_vector array<float>")
    return {tuple(r) for r in sv.neighbour_pairs(df, "point_no", "dense_vector", dimensions=8, leaf_rows=8, **options).collect()}


def test_proportional_vectors_keep_the_smallest_ids(spark):
    rng = np.random.default_rng(3)
    good = clustered(60, 8)
    ids = rng.permutation(np.arange(100, 140)).tolist()
    scaled = [(i, (good[0] * np.float32(f)).tolist()) for i, f in zip(ids, range(1, 41))]  # some exactly, some nearly proportional
    signed = [(200, [0.0, 1.0] + [0.0] * 6), (201, [-0.0, 2.0] + [0.0] * 6)]
    rows = [*enumerate(good.tolist()), *scaled, *signed]
    assert pairs(spark, rows, confidence=0.999999) == brute(rows, 5)  # no leaf left out by chance


def test_neighbours_closer_than_float32(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, centre in enumerate(rng.standard_normal((6, 8))):
        near = centre + 10.0 ** rng.uniform(-6, -3.3, (40, 1)) * rng.standard_normal((40, 8))
        rows += [(1000 * g + int(i), v) for i, v in zip(rng.permutation(40), near.astype(np.float32).tolist())]
    assert pairs(spark, rows, confidence=0.999999) == brute(rows, 5)  # no leaf left out by chance
