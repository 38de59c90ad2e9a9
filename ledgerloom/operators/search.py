"""Candidate search: case-insensitive substrings in the original order, by scan or by a bigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bigrams, norm_text

MOST_SHOWN = 30


def distinct_candidates(rows: DataFrame, column: str, order: str = "_ord") -> DataFrame:
    """value, _ord: texts that differ in more than case, the first spelling kept."""
    clean = rows.select(norm_text(F.col(column)).alias("value"), F.col(order).alias("_ord")).filter("value <> ''")
    return clean.groupBy(F.lower("value").alias("k")).agg(F.min_by("value", "_ord").alias("value"), F.min("_ord").alias("_ord")).select("value", "_ord")


def distinct_suggestions(rows: DataFrame) -> DataFrame:
    """One suggestion a document number (case counts), the first; a blank label falls back to the number."""
    first = rows.filter("doc_no <> ''").groupBy("doc_no").agg(F.min_by("label", "_ord").alias("label"), F.min("_ord").alias("_ord"))
    return first.select("doc_no", F.when(F.coalesce("label", F.lit("")) == "", F.col("doc_no")).otherwise(F.col("label")).alias("label"), "_ord")


def search(candidates: DataFrame, query: str, column: str = "value", limit: int = MOST_SHOWN) -> DataFrame:
    """The first ``limit`` candidates that contain the query; a blank query matches all."""
    wanted = query.strip().lower()
    found = candidates.filter(F.contains(F.lower(column), F.lit(wanted))) if wanted else candidates
    return found.orderBy("_ord").limit(limit)


def bigram_index(candidates: DataFrame, column: str = "value") -> DataFrame:
    """(gram, _ord): postings of every two-character substring."""
    return candidates.select(F.explode(bigrams(F.col(column))).alias("gram"), "_ord")


def indexed_search(candidates: DataFrame, index: DataFrame, query: str, column: str = "value", limit: int = MOST_SHOWN) -> DataFrame:
    """The same result as :func:`search`: postings of all the query's bigrams are intersected, then verified."""
    wanted = query.strip().lower()
    if len(wanted) < 2:
        return search(candidates, query, column, limit)
    grams = list(dict.fromkeys(wanted[i : i + 2] for i in range(len(wanted) - 1)))
    hits = index.filter(F.col("gram").isin(grams)).groupBy("_ord").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    return search(candidates.join(hits.select("_ord"), "_ord", "left_semi"), query, column, limit).select(*candidates.columns)
