"""Vector search: exact top-k by cosine similarity under any relational or graph prefilter.

The score is a projection and the top-k a TakeOrdered (k rows per task reach the driver side of the plan), so a search
scans its candidates once and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.errors import UnboundedVectorSearch
from mnemo.functions.formula import Formula
from mnemo.functions.vectors import cosine, quantized


def top_k(df: DataFrame, column: str, query: list[float], k: int | None, tie: str, min_similarity: float | None = None, quantization: str = "F32") -> DataFrame:
    """The k rows most similar to query, with their score; equal scores in the order of tie."""
    if k is None:
        raise UnboundedVectorSearch("a vector search needs LIMIT")
    scored = df.withColumn("score", cosine(quantized(F.col(column), quantization), query))
    if min_similarity is not None:
        scored = scored.where(F.col("score") >= min_similarity)
    return scored.orderBy(F.col("score").desc(), F.col(tie)).limit(k)


def latest_match(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null key, the one with the highest order; a partial aggregate, no window."""
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__key", "__row.*")


def ranked(df: DataFrame, column: str, query: list[float], formula: str, k: int, tie: str, joined: DataFrame | None = None, anchor: str | None = None, key: str | None = None, key_order: str | None = None, min_similarity: float | None = None) -> DataFrame:
    """The k best rows by a rank formula over df, {vector_score} and the latest row of joined that matches.

    Columns of df hide those of joined.  A NULL formula ranks as NaN, after all numbers; equal ranks go by similarity,
    then by tie, both descending.  min_similarity bounds the raw similarity.
    """
    rule, rows = Formula(formula), df.withColumn("vector_score", cosine(F.col(column), query))
    if min_similarity is not None:
        rows = rows.where(F.col("vector_score") >= min_similarity)
    if joined is not None:
        other = latest_match(joined, key, key_order)
        other = other.select("__key", *[F.col(c).alias(f"__j_{c}") for c in joined.columns])
        rows = rows.join(other, rows[anchor] == other["__key"], "left").drop("__key")
    own = set(df.columns) | {"vector_score"}
    rank = F.coalesce(rule.column(lambda c: F.col(c if c in own else f"__j_{c}")), F.lit(float("nan")))
    best = rows.withColumn("rank", rank).orderBy(F.isnan("rank"), F.col("rank").desc(), F.col("vector_score").desc(), F.col(tie).desc()).limit(k)
    return best.select(*df.columns, "vector_score", "rank")
