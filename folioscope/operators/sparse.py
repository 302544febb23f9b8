"""Lexical term vectors, IDF weights and sparse top-k search over postings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions.text import lexical_tokens, term_vectors

SCORE_DECIMALS = 12  # below it, sums differ by the order of their terms


def term_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, n: occurrences of every token of a text. Null and empty texts have no rows."""
    return df.select(key, F.explode(lexical_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def with_term_vectors(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``indices`` (hashed terms, ascending and distinct) and ``values``; both null where there is no token.

    A text's vector is made in place, without a shuffle: the JVM finds the tokens, an Arrow function hashes and counts
    them. Tokens of one hash are one term.
    """

    names = [*df.columns, "indices", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices, values = term_vectors(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], indices, values], names)

    schema = StructType([*df.schema.fields, *StructType.fromDDL("indices array<bigint>, values array<float>").fields])
    return df.select("*", lexical_tokens(text).alias("_tokens")).mapInArrow(run, schema)


def sparse_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, indices, values of every text that has a token."""
    return with_term_vectors(df.select(key, F.col(text).alias("_text")), F.col("_text")).where("indices is not null").select(key, "indices", "values")


def exploded(vectors: DataFrame, key: str) -> DataFrame:
    """key, term, weight: one row per element of stored ``indices`` and ``values``; null and empty vectors have none."""
    return vectors.select(key, F.inline(F.arrays_zip(F.col("indices").alias("term"), F.col("values").alias("weight"))))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight: the hashed term vector of every text, exploded."""
    return exploded(sparse_vectors(df, key, text), key)


def document_frequency(posted: DataFrame, n_rows: int) -> DataFrame:
    """term, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N counts all rows of the snapshot."""
    df = F.col("df")
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (F.lit(n_rows) - df + 0.5) / (df + 0.5)))


def top_k(scored: DataFrame, k: int, query: str, score: str, key: str, rank: str = "rank") -> DataFrame:
    """The k best of every query, ties to the lower key; the limit works before the shuffle, too."""
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key)))
    return scored.withColumn(rank, nth).where(F.col(rank) <= k)


def sparse_scores(asked: DataFrame, query: str, posted: DataFrame, key: str, n_rows: int) -> DataFrame:
    """query, key, score: IDF-weighted products of the term vectors over shared terms.

    ``asked``: query, term, weight; ``posted``: key, term, weight. The queries' terms meet the postings in an
    equi-join; terms that no query has never reach the IDF or the sum. Scores are rounded to 12 decimals, so equal ones
    stay equal whatever the order of the sum.
    """
    wanted = asked.select("term").distinct()
    relevant = posted.join(wanted, "term", "left_semi")
    weighted = asked.select(query, "term", F.col("weight").cast("double").alias("query_weight")).join(document_frequency(relevant, n_rows).select("term", "idf"), "term")
    return (
        weighted.join(relevant, "term")
        .groupBy(query, key).agg(F.round(F.sum(F.col("query_weight") * F.col("weight").cast("double") * F.col("idf")), SCORE_DECIMALS).alias("score"))
    )


def sparse_topk(asked: DataFrame, query: str, posted: DataFrame, key: str, k: int, n_rows: int) -> DataFrame:
    """query, key, score, rank: the k best rows of the postings (key, term, weight) for every query (query, term, weight).

    Rows that share no term with a query are not listed for it; ``n_rows`` counts all rows of the snapshot, those
    without a vector included.
    """
    return top_k(sparse_scores(asked, query, posted, key, n_rows), k, query, "score", key)
