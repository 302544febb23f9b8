"""Hybrid search: ranked lists, reciprocal rank fusion, reranking, near-duplicate suppression, output."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import jaccard, lowered, normalized_text, word_set
from folioscope.operators.dense import dense_topk
from folioscope.operators.sparse import exploded, postings, sparse_topk, top_k

RRF_K = 60
DEFAULT_LIMIT = 5
DEFAULT_CANDIDATES = 40
SAME_PAGE_SIMILARITY = 0.75
# Fixed value of the printed form.
NOTHING_FOUND = "No matching documentation found."


def candidate_count(limit: int | None, candidates: int | None) -> tuple[int, int]:
    """Limit (5) and candidates (40, at least the limit)."""
    limit = limit if limit and limit > 0 else DEFAULT_LIMIT
    candidates = candidates if candidates and candidates > 0 else DEFAULT_CANDIDATES
    return limit, max(limit, candidates)


def fuse(dense: DataFrame, sparse: DataFrame, query: str, key: str, rrf_k: int = RRF_K) -> DataFrame:
    """query, key, dense_score, sparse_score (0 where not listed) and fusion_score = sum of 1 / (k + rank).

    One full outer join of the two ranked lists gives the scores and the fusion.
    """
    part = lambda rank: F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))
    left = dense.select(query, key, F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    right = sparse.select(query, key, F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    return left.join(right, [query, key], "full_outer").select(
        query, key, F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
        (part("dense_rank") + part("sparse_rank")).alias("fusion_score"),
    )


def hybrid_candidates(
    queries: DataFrame, points: DataFrame, query: str, query_text: str, query_vector: str, key: str, candidates: int, mode: str = "hybrid",
    posted: DataFrame | None = None, n_rows: int | None = None,
) -> DataFrame:
    """The ``candidates`` best points of every query with their scores and position ``candidate_rank``.

    ``points``: key, dense_vector and the published sparse vectors ``indices`` and ``values`` (null where a text has no
    token), which were made from the whole embedding text; no text is tokenized but the queries'. ``posted`` (key, term,
    weight) are these vectors exploded and ``n_rows`` the number of points, where a snapshot has them. ``hybrid``: the dense
    and the sparse list, each of that length, fused. ``dense``: the dense list alone.
    """
    if mode not in ("hybrid", "dense"):
        raise ValueError(f"unknown search mode {mode!r}")
    dense = dense_topk(queries, query, query_vector, points, key, "dense_vector", candidates)
    if mode == "dense":
        return dense.select(query, key, F.col("score").alias("dense_score"), F.lit(0.0).alias("sparse_score"), F.lit(0.0).alias("fusion_score"), F.col("rank").alias("candidate_rank"))
    asked = postings(queries, query, query_text)
    sparse = sparse_topk(asked, query, exploded(points, key) if posted is None else posted, key, candidates, points.count() if n_rows is None else n_rows)
    return top_k(fuse(dense, sparse, query, key), candidates, query, "fusion_score", key, "candidate_rank")


def words_contained(query_text: Column, markdown: Column) -> Column:
    """A deterministic reranker: 0.1 plus the number of the query's words that the text contains."""
    text = lowered(F.coalesce(markdown, F.lit("")))
    words = F.filter(F.split(F.trim(lowered(query_text)), r"\s+"), lambda w: w != "")
    return F.lit(0.1) + F.size(F.filter(words, lambda w: F.contains(text, w))).cast("double")


def rerank_order(scored: DataFrame, query: str) -> DataFrame:
    """``position``: by reranker score, then fusion (dense, where fusion is 0), then the candidates' own order."""
    tie = F.when(F.col("fusion_score") != 0, F.col("fusion_score")).otherwise(F.col("dense_score"))
    order = Window.partitionBy(query).orderBy(F.col("reranker_score").desc_nulls_last(), tie.desc(), F.col("candidate_rank"))
    return scored.withColumn("position", F.row_number().over(order))


def suppress_near_duplicates(
    ordered: DataFrame, query: str, key: str, url: str, markdown: str, limit: int, similarity: float = SAME_PAGE_SIMILARITY, carry: tuple[str, ...] = ()
) -> DataFrame:
    """query, key, rank and the columns ``carry``: walking by ``position``, a row is kept unless it repeats one already kept.

    Repeats: the same key; the same text but for case and white space; the same URL and word sets of at least the
    similarity. Stops at the limit. The fold runs over an array of a query's candidates, so the candidates must be
    bounded; normal forms and word sets are made once per candidate. Null texts count as empty, and an empty one
    repeats only an empty one.
    """
    text = F.coalesce(F.col(markdown), F.lit(""))
    item = F.struct(
        F.col("position").alias("position"), F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), normalized_text(text).alias("form"), word_set(text).alias("words"),
        F.struct(F.lit(None).cast("int").alias("_"), *carry).alias("carried"),
    )
    listed = ordered.select(query, item.alias("item")).groupBy(query).agg(F.sort_array(F.collect_list("item")).alias("items"))
    kind = listed.schema["items"].dataType.simpleString()
    repeats = lambda a, b: (a["key"] == b["key"]) | (a["form"] == b["form"]) | ((a["url"] == b["url"]) & (jaccard(a["words"], b["words"]) >= similarity))
    kept = F.aggregate(
        "items",
        F.array().cast(kind),
        lambda done, x: F.when((F.size(done) >= limit) | F.exists(done, lambda d: repeats(d, x)), done).otherwise(F.concat(done, F.array(x))),
    )
    walked = listed.select(query, F.posexplode(kept).alias("pos", "x"))
    return walked.select(query, F.col("x.key").alias(key), (F.col("pos") + 1).alias("rank"), *(F.col(f"x.carried.{c}").alias(c) for c in carry))


RESULT_COLUMNS = ["vector_score", "dense_score", "sparse_score", "fusion_score", "reranker_score", "source_id", "version", "url", "title", "heading_path", "markdown"]


def service_scores(reranker: Callable[[str, list[str]], list[tuple[int, float]]]) -> Callable[[DataFrame, str], DataFrame]:
    """A reranking service as a step of ``search``: one call for each query with the texts of all its candidates.

    The service gives (index, score) pairs; a candidate it leaves out is no result. The calls are
    made on the executors, one query's candidates (bounded by ``candidates``) in a task at a time.
    """

    def scored(found: DataFrame, query: str) -> DataFrame:
        listed = found.groupBy(query, "_asked").agg(F.sort_array(F.collect_list(F.struct("candidate_rank", F.coalesce("markdown", F.lit("")).alias("text")))).alias("c"))

        @F.arrow_udf("array<double>")
        def call(asked: pa.Array, texts: pa.Array) -> pa.Array:
            answers = []
            for question, own in zip(asked.to_pylist(), texts.to_pylist()):
                scores: list[float | None] = [None] * len(own)
                for index, score in reranker(question or "", own):
                    scores[index] = score
                answers.append(scores)
            return pa.array(answers, pa.list_(pa.float64()))

        ranked = listed.select(query, F.col("c.candidate_rank").alias("r"), call(F.col("_asked"), F.col("c.text")).alias("s"))
        scores = ranked.select(query, F.inline(F.arrays_zip(F.col("r").alias("candidate_rank"), F.col("s").alias("reranker_score"))))
        return found.join(scores.where("reranker_score is not null"), [query, "candidate_rank"])

    return scored


def column_scores(reranker: Callable[[Column, Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """A reranker that is an expression of the query's text and the candidate's Markdown."""
    return lambda found, _: found.withColumn("reranker_score", reranker(F.col("_asked"), F.col("markdown")))


def search(
    queries: DataFrame, points: DataFrame, query: str, query_text: str, query_vector: str, key: str = "point_no", limit: int | None = None,
    candidates: int | None = None, mode: str = "hybrid", rerank: Callable[[DataFrame, str], DataFrame] | None = None,
    posted: DataFrame | None = None, n_rows: int | None = None,
) -> DataFrame:
    """query, rank, key and the result columns: the whole search for a batch of queries.

    ``points``: key, dense_vector, indices, values, markdown, source_id, version, url, title, heading_path. The reranker
    (``column_scores`` or ``service_scores``; by default the words contained) sees the Markdown only. ``vector_score`` is
    the fusion score, or the dense one in dense mode. ``points`` is read for the two lists, for their number and for the
    columns shown, each time with only the columns needed; ``posted`` and ``n_rows`` as in ``hybrid_candidates``.
    """
    limit, candidates = candidate_count(limit, candidates)
    found = hybrid_candidates(queries, points, query, query_text, query_vector, key, candidates, mode, posted, n_rows)
    shown = points.select(key, "source_id", "version", "url", "title", "heading_path", "markdown")
    asked = found.join(queries.select(query, F.col(query_text).alias("_asked")), query).join(shown, key)
    scored = (rerank or column_scores(words_contained))(asked, query).withColumn("vector_score", F.col("dense_score" if mode == "dense" else "fusion_score"))
    kept = suppress_near_duplicates(rerank_order(scored, query), query, key, "url", "markdown", limit, carry=tuple(RESULT_COLUMNS))
    return kept.select(query, "rank", key, *RESULT_COLUMNS)


def result_json(results: DataFrame, query: str) -> DataFrame:
    """query, json: ``{"results": [...]}`` in rank order; a query without results is simply absent."""
    named = [c for c in results.columns if c not in (query,)]
    item = F.struct("rank", *(c for c in named if c != "rank"))
    listed = results.groupBy(query).agg(F.sort_array(F.collect_list(item)).alias("results"))
    return listed.select(query, F.to_json(F.struct("results")).alias("json"))


def result_text(results: DataFrame, query: str) -> DataFrame:
    """query, text: one section per result, separated by rules."""
    name = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}: "), x, F.lit("\n"))).otherwise("")
    section = F.concat(
        F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.coalesce(name, F.lit("")), F.lit("\n\n"), F.lit("Source: "), F.coalesce("url", F.lit("")), F.lit("\n"),
        line("Version", F.col("version")), line("Heading", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ", "")),
        F.lit("\n"), F.regexp_replace(F.coalesce("markdown", F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit("\n"),
    )
    listed = results.select(query, F.struct("rank", section.alias("section")).alias("s")).groupBy(query).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return listed.select(query, F.array_join("s.section", "\n---\n\n").alias("text"))


def print_results(rows: list[dict], style: str = "json") -> str:
    """The results of one query as text; an empty list is ``[]`` in JSON and one sentence otherwise."""
    if style == "json":
        return json.dumps({"results": rows}, indent=2, ensure_ascii=False, default=str)
    if not rows:
        return NOTHING_FOUND
    parts = []
    for row in rows:
        head = [f"## {row['rank']}. {row.get('title') or row.get('url') or ''}", "", f"Source: {row.get('url') or ''}"]
        head += [f"Version: {row['version']}"] if row.get("version") else []
        head += [f"Heading: {' > '.join(h or '' for h in row['heading_path'])}"] if row.get("heading_path") else []
        parts.append("\n".join([*head, "", (row.get("markdown") or "").strip(), ""]))
    return "\n---\n\n".join(parts)
