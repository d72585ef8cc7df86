"""BM25, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.model import Bm25


def inverse_doc_freq(doc_freq: Column, num_docs: Column) -> Column:
    """Always above 0."""
    return F.log((num_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1.0)


def term_weight(idf: Column, tf: Column, length: Column, average: Column, params: Bm25) -> Column:
    share = F.lit(1.0 - params.b) + F.lit(params.b) * length / average
    return idf * (tf * F.lit(params.k1 + 1.0)) / (tf + F.lit(params.k1) * share)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of (doc_id, score); equal scores by doc_id. A partial heap in each task, no full sort."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(0, k))


def top_k_of_each(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query of (qid, doc_id, score), with their rank; cut down in every task before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
