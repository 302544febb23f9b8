import math
import tracemalloc
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import embedding_text
from folioscope.operators import dense, search, sparse
from folioscope.sources import providers

POINT = "point_no bigint, markdown string, dense_vector array<float>, source_id string, version string, url string, title string, heading_path array<string>"


def points(spark, rows):
    df = spark.createDataFrame([(n, m, v, "s", None, u, f"t{n}", ["h"]) for n, m, v, u in rows], POINT)
    return sparse.with_term_vectors(df, embedding_text(F.col("title"), F.col("heading_path"), F.col("url"), F.col("markdown")))


def test_sparse_vectors(spark):
    df = spark.createDataFrame([(1, "parseURL parseURL HTTPServer"), (2, ""), (3, None)], "id int, text string")
    rows = sparse.sparse_vectors(df, "id", "text").collect()
    assert [r.id for r in rows] == [1] and rows[0].indices == sorted(set(rows[0].indices)) and len(rows[0].indices) >= 5
    assert max(rows[0]["values"]) == pytest.approx(1 + math.log(2))


def test_sparse_topk_brute_force(spark):
    texts = {1: "alpha beta", 2: "alpha alpha gamma", 3: "delta", 4: None, 5: "beta beta alpha"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    asked = sparse.postings(spark.createDataFrame([(7, "alpha beta")], "q int, asked string"), "q", "asked")
    got = sparse.sparse_topk(asked, "q", sparse.postings(df, "id", "text"), "id", 2, 5).collect()
    idf = {t: math.log(1 + (5 - n + 0.5) / (n + 0.5)) for t, n in {"alpha": 3, "beta": 2}.items()}
    score = {i: sum(idf[t] * (1 + math.log(x.split().count(t))) for t in idf if t in x.split()) for i, x in texts.items() if x}
    best = sorted((-s, i) for i, s in score.items() if s)[:2]
    assert [(r.id, r["rank"]) for r in got] == [(best[0][1], 1), (best[1][1], 2)]
    assert got[0].score == pytest.approx(-best[0][0], abs=1e-5)


def test_dense_topk_blocks_and_dirty_vectors(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(30)] + [(90, None), (91, []), (92, [0.0, 0.0]), (93, [float("nan"), 1.0]), (94, [1.0, 2.0, 3.0]), (95, [math.cos(1) * 2, math.sin(1) * 2])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    asked = df.where("id in (1, 7, 90, 92)").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    whole = {(r.q, r.id, r["rank"]) for r in dense.dense_topk(asked, "q", "qv", df, "id", "v", 3).collect()}
    blocked = {(r.q, r.id, r["rank"]) for r in dense.dense_topk(asked, "q", "qv", df, "id", "v", 3, block_bytes=64, least_rows=4).collect()}
    assert whole == blocked and {q for q, _, _ in whole} == {1, 7}
    assert (1, 1, 1) in whole and (1, 95, 2) in whole
    named = df.withColumn("id", F.format_string("p%02d", "id"))
    assert {(r.q, int(r.id[1:]), r["rank"]) for r in dense.dense_topk(asked, "q", "qv", named, "id", "v", 3, block_bytes=64).collect()} == whole
    infinite = spark.createDataFrame([(1, [float("inf"), 1.0]), (2, [1.0, 1.0])], "id bigint, v array<float>")
    assert [r.id for r in dense.dense_topk(asked.where("q = 1"), "q", "qv", infinite, "id", "v", 3).collect()] == [2]
    assert dense.dense_topk(asked.limit(0), "q", "qv", df, "id", "v", 3).count() == 0


def test_a_full_block_of_vectors_stays_small():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((dense.BLOCK_BYTES // 512, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    queries = rows[:1500]
    tracemalloc.start()
    q, p, score = dense.best_of_block(queries, rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + 4 * dense.BLOCK_BYTES < 500e6 and len(q) == 15_000
    first = [np.lexsort((np.arange(len(rows)), -np.round(queries[i] @ rows.T, 9)))[:10] for i in (0, 700, 1499)]
    assert [p[q == i].tolist() for i in (0, 700, 1499)] == [x.tolist() for x in first] and (score[p == q] == 1).all()


def test_ties_in_one_slice_and_over_slices():
    rows = np.tile(np.eye(3), (3000, 1))
    q, p, score = dense.best_of_block(np.eye(3), rows, 4)
    assert p.tolist() == [0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11] and (score == 1).all()


def test_modes_and_defaults():
    assert search.candidate_count(None, None) == (5, 40)
    assert search.candidate_count(60, 0) == (60, 60)
    with pytest.raises(ValueError):
        search.hybrid_candidates(None, None, "", "", "", "", 1, "other")


def test_suppression_is_ordered_not_transitive(spark):
    words = [f"w{i}" for i in range(20)]
    near = lambda n: " ".join(words[n : n + 17])
    rows = [(1, 1, 10, "u", near(0)), (1, 2, 11, "u", near(2)), (1, 3, 12, "u", near(3) + " " + near(3).upper()), (1, 4, 13, "other", "W0 " + near(0)[3:]), (1, 5, 14, "v", "other text"), (2, 1, 15, None, None), (2, 2, 16, "x", "")]
    df = spark.createDataFrame(rows, "q int, position int, id int, url string, markdown string")
    got = sorted((r.q, r["rank"], r.id) for r in search.suppress_near_duplicates(df, "q", "id", "url", "markdown", 5).collect())
    assert got == [(1, 1, 10), (1, 2, 12), (1, 3, 14), (2, 1, 15)]
    assert search.suppress_near_duplicates(df, "q", "id", "url", "markdown", 1).count() == 2


def test_search_end_to_end(spark):
    rows = [(1, "install the server quickly", [1.0, 0.0], "u1"), (2, "install the server quickly now", [1.0, 0.1], "u1"), (3, "remove the client", [0.0, 1.0], "u2"), (4, None, None, None), (5, "server", [0.9, 0.2], "u3")]
    queries = spark.createDataFrame([(1, "install server", [1.0, 0.0])], "q int, asked string, qv array<float>")
    got = search.search(queries, points(spark, rows), "q", "asked", "qv", limit=2).orderBy("rank").collect()
    assert [r.point_no for r in got] == [1, 5] and got[0].reranker_score == pytest.approx(2.1)
    assert got[0].vector_score == got[0].fusion_score == pytest.approx(2 / 61)
    dense_only = search.search(queries, points(spark, rows), "q", "asked", "qv", mode="dense").orderBy("rank").first()
    assert dense_only.vector_score == pytest.approx(1.0) and dense_only.fusion_score == 0


def test_printed_results():
    assert search.print_results([]) == '{\n  "results": []\n}'
    assert search.print_results([], "text") == search.NOTHING_FOUND
    row = {"rank": 1, "title": "", "url": "u", "version": "v", "heading_path": ["a", "b"], "markdown": " body\n"}
    assert search.print_results([row], "text") == "## 1. u\n\nSource: u\nVersion: v\nHeading: a > b\n\nbody\n"


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    points_df = spark.createDataFrame([("p1", "h1", "a"), ("p2", "h2", "bb"), ("p3", "h2", "bb")], "point_id string, input_hash string, text string")
    stored = spark.createDataFrame([("o1", "h1", [9.0, 9.0]), ("o2", "h1", [8.0, 8.0]), ("o3", "hx", [7.0])], "point_id string, input_hash string, dense_vector array<float>")
    got = {r.point_id: r.dense_vector for r in dense.attach_vectors(points_df, stored, "text", embed).collect()}
    assert got == {"p1": [9.0, 9.0], "p2": [2.0, 1.0], "p3": [2.0, 1.0]} and calls.value == 1
    assert tuple(dense.reuse_counts(points_df, stored).first()) == (1, 1)


def test_provider_responses():
    assert providers.ordered_vectors([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    for bad in ([{"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}]):
        with pytest.raises(ValueError):
            providers.ordered_vectors(bad, 2)
    assert providers.ordered_ranks([{"index": 1, "relevance_score": 0.5}, {"index": 0, "relevance_score": 0.5}], 3) == [(0, 0.5), (1, 0.5)]
    for bad in ([{"index": 3, "relevance_score": 1}], [{"index": 1, "relevance_score": 1}] * 2):
        with pytest.raises(ValueError):
            providers.ordered_ranks(bad, 3)
    vectors = providers.HashingEmbedder(8)(["a b", "b a"])
    assert vectors[0] == vectors[1] and len(vectors[0]) == 8 and datetime
