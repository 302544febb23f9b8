"""Queries on search: sparse, dense and hybrid retrieval, reranking, suppression, result forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import embedding_text, jaccard, normalized_text, word_set
from folioscope.operators import search as s
from folioscope.operators.dense import cached_vectors, dense_topk, has_direction, reuse_counts
from folioscope.operators.sparse import exploded, postings, top_k, with_term_vectors
from folioscope.operators.sparse import sparse_topk as sparse_search
from folioscope.plans.texts import EMBEDDING_TEXT
from folioscope.session import materialize, table

c = F.col
K = 10


def points(spark, sf_dir, *columns) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    return (rows.select("point_no", *columns) if columns else rows).dropDuplicates(["point_no"])


def published(spark, sf_dir, *more) -> DataFrame:
    """The points as a snapshot has them: once each, with the sparse vectors of their embedding texts, written to disk."""
    rows = points(spark, sf_dir, "source_id", "version", "url", "title", "heading_path", "markdown", *more)
    with_vectors = with_term_vectors(rows, embedding_text(c("title"), c("heading_path"), c("url"), c("markdown")))
    return materialize(with_vectors, "published")


def queries_of(rows: DataFrame) -> DataFrame:
    """The search queries: the title and the vector of every point whose number is divisible by 50."""
    return rows.where("point_no % 50 = 0").select(c("point_no").alias("query_no"), F.coalesce("title", F.lit("")).alias("asked"), c("dense_vector").alias("query_vector"))


def sparse_topk(spark, sf_dir):
    rows = published(spark, sf_dir, "dense_vector")
    found = sparse_search(postings(queries_of(rows), "query_no", "asked"), "query_no", exploded(rows, "point_no"), "point_no", K, rows.count())
    return found.select("query_no", "point_no", F.round("score", 6).alias("score"))


def dense_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(c("vec_id").alias("query_no"), c("embedding").alias("query_vector"))
    found = dense_topk(asked, "query_no", "query_vector", rows, "vec_id", "embedding", K)
    return found.select("query_no", "vec_id", "rank", F.round("score", 6).alias("score"))


def rrf_fusion(spark, sf_dir):
    """The dense and the sparse ranking in the stored results, fused per query."""
    listed = table(spark, sf_dir, "search_results").dropDuplicates(["query_no", "point_no"])
    dense = top_k(listed.withColumn("score", c("dense_score")), 40, "query_no", "score", "point_no")
    sparse = top_k(listed.withColumn("score", c("sparse_score")), 40, "query_no", "score", "point_no")
    return s.fuse(dense, sparse, "query_no", "point_no").select("query_no", "point_no", F.round("fusion_score", 9).alias("fusion_score"))


def hybrid_candidates(spark, sf_dir):
    rows = published(spark, sf_dir, "dense_vector")
    found = s.hybrid_candidates(queries_of(rows), rows, "query_no", "asked", "query_vector", "point_no", s.DEFAULT_CANDIDATES)
    return found.select("query_no", "point_no", F.round("fusion_score", 9).alias("fusion_score"))


def hybrid_search(spark, sf_dir):
    """The whole search for all queries: candidates, fusion, reranking, suppression, five results each."""
    rows = published(spark, sf_dir, "dense_vector")
    found = s.search(queries_of(rows), rows, "query_no", "asked", "query_vector")
    scores = ["vector_score", "dense_score", "sparse_score", "fusion_score", "reranker_score"]
    return found.select("query_no", "rank", "point_no", *(F.round(x, 6).alias(x) for x in scores), "source_id", "version", "url", "title")


def dense_only_search(spark, sf_dir):
    """The whole search by the dense list alone."""
    rows = materialize(points(spark, sf_dir, "source_id", "version", "url", "title", "heading_path", "markdown", "dense_vector"), "points")
    found = s.search(queries_of(rows), rows, "query_no", "asked", "query_vector", mode="dense")
    return found.select("query_no", "rank", "point_no", F.round("vector_score", 6).alias("vector_score"))


def results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "search_results").dropDuplicates(["query_no", "point_no"])


def rerank_order(spark, sf_dir):
    """The stored results of every query in final order; a missing reranker score comes last."""
    ordered = s.rerank_order(results(spark, sf_dir).withColumn("candidate_rank", c("rank_no")), "query_no")
    return ordered.select("query_no", "point_no", "position")


def near_duplicate_pairs(spark, sf_dir):
    """Pairs within a result list that repeat each other: same text, or same page and similar words."""
    text = F.coalesce("markdown", F.lit(""))
    rows = results(spark, sf_dir).select("query_no", "point_no", F.coalesce("url", F.lit("")).alias("url"), normalized_text(text).alias("form"), word_set(text).alias("words"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (c("a.query_no") == c("b.query_no")) & (c("a.point_no") < c("b.point_no")))
    alike = (c("a.form") == c("b.form")) | ((c("a.url") == c("b.url")) & (jaccard(c("a.words"), c("b.words")) >= s.SAME_PAGE_SIMILARITY))
    return met.where(alike).select("a.query_no", c("a.point_no").alias("point_no_a"), c("b.point_no").alias("point_no_b"))


def suppressed_results(spark, sf_dir):
    """The stored result lists without repeats, five results each."""
    ordered = s.rerank_order(results(spark, sf_dir).withColumn("candidate_rank", c("rank_no")), "query_no")
    return s.suppress_near_duplicates(ordered, "query_no", "point_no", "url", "markdown", s.DEFAULT_LIMIT)


def result_json(spark, sf_dir):
    """All results of every list as JSON with all their columns, read back from it."""
    shown = results(spark, sf_dir).select("query_no", c("rank_no").alias("rank"), "point_no", *s.RESULT_COLUMNS)
    printed = s.result_json(shown, "query_no")
    item = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in shown.schema if f.name != "query_no")
    return printed.select("query_no", F.inline(F.from_json("json", f"struct<results:array<struct<{item}>>>")["results"])).withColumn("heading_path", F.array_join("heading_path", " > ", "-"))


def result_text(spark, sf_dir):
    shown = results(spark, sf_dir).withColumn("rank", c("rank_no"))
    return s.result_text(shown, "query_no").select("query_no", F.md5("text").alias("text"))


def vector_dimensions(spark, sf_dir):
    """Per source: usable vectors, and whether all of them have one dimension."""
    rows = points(spark, sf_dir).where(has_direction(c("dense_vector")))
    size = F.size("dense_vector")
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), (F.min(size) == F.max(size)).alias("uniform"))


def wanted_and_stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All points but those that stand in the store, and these: of every input the point with a vector that was crawled first."""
    order = Window.partitionBy("input_hash").orderBy(c("dense_vector").isNull(), c("crawled_at").asc_nulls_last(), "point_no")
    rows = points(spark, sf_dir).withColumn("stored", (F.row_number().over(order) == 1) & c("dense_vector").isNotNull())
    return rows.where("not stored"), rows.where("stored")


def embedding_cache(spark, sf_dir):
    """Every point is in the store or looked up in it: how many are reused, and how many inputs are left."""
    return reuse_counts(*wanted_and_stored(spark, sf_dir))


def cached_inputs(spark, sf_dir):
    found = cached_vectors(*wanted_and_stored(spark, sf_dir))
    return found.select("input_hash", F.size("dense_vector").alias("dimension"))


POINTS = "points AS (SELECT DISTINCT ON (point_no) * FROM chunks)"
ASKED = "asked AS (SELECT point_no AS query_no, coalesce(title, '') AS asked, dense_vector AS qv FROM points WHERE point_no % 50 = 0)"


def _tokens(name: str, source: str, key: str, text: str) -> str:
    return rf"""
{name}_raw AS (SELECT {key}, unnest(regexp_extract_all({text}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.:/@-]*')) AS token FROM {source} WHERE {text} IS NOT NULL),
{name}_marked AS (SELECT {key}, lower(token) AS whole, unnest(string_split_regex(
    regexp_replace(regexp_replace(token, '([\p{{L}}\p{{Nd}}])(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'),
    '[^\p{{L}}\p{{Nd}}]+')) AS part FROM {name}_raw),
{name} AS (SELECT {key}, token, CAST(1 + ln(count(*)) AS FLOAT)::DOUBLE AS w FROM (
  SELECT {key}, lower(token) AS token FROM {name}_raw UNION ALL SELECT {key}, lower(part) FROM {name}_marked WHERE strlen(part) > 1 AND lower(part) <> whole
) GROUP BY {key}, token)"""


SPARSE = f"""
inputs AS (SELECT point_no, {EMBEDDING_TEXT} AS body FROM points), {_tokens('q', 'asked', 'query_no', 'asked')}, {_tokens('d', 'inputs', 'point_no', 'body')},
n AS (SELECT count(*) AS n FROM points), idf AS (SELECT token, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d, n GROUP BY token),
sparse AS (SELECT query_no, point_no, sum(q.w * d.w * idf) AS score FROM q JOIN d USING (token) JOIN idf USING (token) GROUP BY query_no, point_no),
sparse_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY round(score, 12) DESC, point_no) AS rank FROM sparse)"""
DENSE = """
usable AS (SELECT point_no, dense_vector::DOUBLE[] AS v FROM points WHERE len(dense_vector) > 0
  AND len(list_filter(dense_vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(dense_vector, lambda x: x <> 0)) > 0),
dense AS (SELECT q.point_no AS query_no, d.point_no, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM usable q JOIN usable d ON len(q.v) = len(d.v) WHERE q.point_no % 50 = 0),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, point_no) AS rank FROM dense)"""
LISTED = "listed AS (SELECT DISTINCT ON (query_no, point_no) * FROM search_results)"
WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce(markdown, '')), '[^\p{L}\p{Nd}_]+'), lambda w: strlen(w) > 1))"
SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FORM = r"trim(regexp_replace(lower(coalesce(markdown, '')), '[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')"
ORDER = "row_number() OVER (PARTITION BY query_no ORDER BY reranker_score DESC NULLS LAST, CASE WHEN fusion_score <> 0 THEN fusion_score ELSE dense_score END DESC NULLS LAST, rank_no)"
SQL = {
    sparse_topk: f"WITH {POINTS}, {ASKED}, {SPARSE} SELECT query_no, point_no, round(score, 6) AS score FROM sparse_ranked WHERE rank <= {K}",
    dense_search: f"""
SELECT query_no, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_no, b.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
  FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0) WHERE rank <= {K}""",
    rrf_fusion: f"""
WITH {LISTED}, ranked AS (SELECT query_no, point_no, row_number() OVER (PARTITION BY query_no ORDER BY dense_score DESC NULLS LAST, point_no) AS d,
  row_number() OVER (PARTITION BY query_no ORDER BY sparse_score DESC NULLS LAST, point_no) AS s FROM listed)
SELECT query_no, point_no, round(CASE WHEN d <= 40 THEN 1.0::DOUBLE / (60 + d) ELSE 0 END + CASE WHEN s <= 40 THEN 1.0::DOUBLE / (60 + s) ELSE 0 END, 9) AS fusion_score FROM ranked WHERE d <= 40 OR s <= 40""",
    hybrid_candidates: f"""
WITH {POINTS}, {ASKED}, {SPARSE}, {DENSE}, fused AS (
  SELECT query_no, point_no, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS fusion_score
  FROM (SELECT * FROM dense_ranked WHERE rank <= 40) d FULL JOIN (SELECT * FROM sparse_ranked WHERE rank <= 40) s USING (query_no, point_no))
SELECT query_no, point_no, round(fusion_score, 9) AS fusion_score FROM fused QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY fusion_score DESC, point_no) <= 40""",
    rerank_order: f"WITH {LISTED} SELECT query_no, point_no, CAST({ORDER} AS INT) AS position FROM listed",
    near_duplicate_pairs: f"""
WITH {LISTED}, r AS (SELECT query_no, point_no, coalesce(url, '') AS url, {FORM} AS form, {WORDS} AS words FROM listed)
SELECT a.query_no, a.point_no AS point_no_a, b.point_no AS point_no_b FROM r a JOIN r b ON a.query_no = b.query_no AND a.point_no < b.point_no
WHERE a.form = b.form OR (a.url = b.url AND len(a.words) > 0 AND len(b.words) > 0
  AND len(list_intersect(a.words, b.words)) >= 0.75 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))))""",
    result_json: f"""
WITH {LISTED} SELECT query_no, rank_no AS rank, point_no, vector_score, dense_score, sparse_score, fusion_score, reranker_score, source_id, version, url, title,
  array_to_string(list_transform(heading_path, lambda h: coalesce(h, '-')), ' > ') AS heading_path, markdown FROM listed""",
    result_text: rf"""
WITH {LISTED}, s AS (SELECT query_no, rank_no, '## ' || rank_no || '. ' || coalesce(nullif(title, ''), url, '') || chr(10) || chr(10) || 'Source: ' || coalesce(url, '') || chr(10)
  || CASE WHEN coalesce(version, '') <> '' THEN 'Version: ' || version || chr(10) ELSE '' END
  || CASE WHEN array_to_string(list_transform(coalesce(heading_path, []), lambda h: coalesce(h, '')), ' > ') <> ''
     THEN 'Heading: ' || array_to_string(list_transform(heading_path, lambda h: coalesce(h, '')), ' > ') || chr(10) ELSE '' END
  || chr(10) || regexp_replace(coalesce(markdown, ''), '^{SPACES}|{SPACES}$', '', 'g') || chr(10) AS section FROM listed)
SELECT query_no, md5(string_agg(section, chr(10) || '---' || chr(10) || chr(10) ORDER BY rank_no)) AS text FROM s GROUP BY query_no""",
    vector_dimensions: f"WITH {POINTS}, {DENSE} SELECT source_id, count(*) AS n, min(len(v)) = max(len(v)) AS uniform FROM usable JOIN points USING (point_no) GROUP BY source_id",
}

STORE = f"""
WITH {POINTS}, placed AS (SELECT *, dense_vector IS NOT NULL AND row_number() OVER (PARTITION BY input_hash ORDER BY dense_vector IS NULL, crawled_at NULLS LAST, point_no) = 1 AS stored FROM points)"""
SQL[embedding_cache] = f"""{STORE}, w AS (SELECT w.input_hash, s.input_hash IS NOT NULL AS hit FROM placed w LEFT JOIN (SELECT input_hash FROM placed WHERE stored) s USING (input_hash) WHERE NOT w.stored)
SELECT count(*) FILTER (hit) AS reused, count(DISTINCT input_hash) FILTER (NOT hit) AS embedded FROM w"""
SQL[cached_inputs] = f"{STORE} SELECT input_hash, CAST(len(dense_vector) AS INT) AS dimension FROM placed WHERE stored AND input_hash IN (SELECT input_hash FROM placed WHERE NOT stored)"



def suppressed_sql(ordered: str) -> str:
    """Common table expressions from ``ordered`` (query_no, position, point_no, url, markdown) to ``kept`` (query_no, point_no, rank).

    One step takes the next row of every list: it is kept unless it repeats one kept before it.
    """
    return f"""
ordered AS ({ordered}),
shaped AS (SELECT query_no, position, point_no, coalesce(url, '') AS url, {FORM} AS form, {WORDS} AS words FROM ordered),
repeats AS (
  SELECT b.query_no, b.position, list(a.position) AS of FROM shaped a JOIN shaped b ON a.query_no = b.query_no AND a.position < b.position
  WHERE a.point_no = b.point_no OR a.form = b.form OR (a.url = b.url AND len(a.words) > 0 AND len(b.words) > 0
    AND len(list_intersect(a.words, b.words)) >= 0.75 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))) GROUP BY ALL
), walk AS (
  SELECT DISTINCT query_no, 0::BIGINT AS position, []::BIGINT[] AS taken FROM ordered
  UNION ALL
  SELECT w.query_no, o.position, CASE WHEN len(taken) >= 5 OR list_has_any(taken, coalesce(r.of, [])) THEN taken ELSE list_append(taken, o.position) END
  FROM walk w JOIN ordered o ON o.query_no = w.query_no AND o.position = w.position + 1 LEFT JOIN repeats r ON r.query_no = o.query_no AND r.position = o.position
), last_step AS (SELECT query_no, arg_max(taken, position) AS taken FROM walk GROUP BY query_no),
ranked_rows AS (SELECT query_no, unnest(taken) AS position, generate_subscripts(taken, 1) AS rank FROM last_step),
kept AS (SELECT query_no, point_no, CAST(rank AS INT) AS rank FROM ranked_rows JOIN ordered USING (query_no, position))"""


RERANKED = r"""
scored AS (
  SELECT f.*, 0.1 + len(list_filter(string_split_regex(trim(lower(asked)), '\s+'), lambda w: w <> '' AND contains(lower(coalesce(markdown, '')), w))) AS reranker_score,
    p.url, p.markdown FROM found f JOIN asked USING (query_no) JOIN points p USING (point_no)
)"""
POSITIONED = "SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY reranker_score DESC, CASE WHEN fusion_score <> 0 THEN fusion_score ELSE dense_score END DESC, candidate_rank) AS position FROM scored"
SQL[suppressed_results] = f"WITH RECURSIVE {LISTED}, {suppressed_sql(f'SELECT query_no, point_no, url, markdown, CAST({ORDER} AS BIGINT) AS position FROM listed')} SELECT * FROM kept"
SQL[dense_only_search] = f"""
WITH RECURSIVE {POINTS}, {ASKED}, {DENSE}, found AS (SELECT query_no, point_no, score AS dense_score, 0.0::DOUBLE AS fusion_score, rank AS candidate_rank FROM dense_ranked WHERE rank <= 40),
{RERANKED}, {suppressed_sql(POSITIONED)} SELECT query_no, rank, point_no, round(dense_score, 6) AS vector_score FROM kept JOIN found USING (query_no, point_no)"""
SQL[hybrid_search] = f"""
WITH RECURSIVE {POINTS}, {ASKED}, {SPARSE}, {DENSE}, fused AS (
  SELECT query_no, point_no, coalesce(d.score, 0) AS dense_score, coalesce(round(s.score, 12), 0) AS sparse_score,
    coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS fusion_score
  FROM (SELECT * FROM dense_ranked WHERE rank <= 40) d FULL JOIN (SELECT * FROM sparse_ranked WHERE rank <= 40) s USING (query_no, point_no)),
found AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY fusion_score DESC, point_no) AS candidate_rank FROM fused QUALIFY candidate_rank <= 40),
{RERANKED}, {suppressed_sql(POSITIONED)}
SELECT query_no, rank, point_no, round(fusion_score, 6) AS vector_score, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, round(fusion_score, 6) AS fusion_score,
  round(reranker_score::DOUBLE, 6) AS reranker_score, source_id, version, p.url, title FROM kept JOIN scored USING (query_no, point_no) JOIN points p USING (point_no)"""

QUERIES = tuple(SQL)


def queries():
    return {query.__name__: query for query in QUERIES}


def oracle_sql():
    return {query.__name__: sql for query, sql in SQL.items()}
