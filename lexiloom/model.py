"""Schemas of the stored tables, and ranking parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FORMAT_VERSION = 2

CORPUS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
])
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("length", T.IntegerType()),
])
TERMS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("doc_freq", T.LongType()),
    T.StructField("encoded_bytes", T.LongType()),
    T.StructField("naive_bytes", T.LongType()),
])
#: doc_len is repeated here so that scoring needs no join with DOCS; position_bytes is the coded size of the positions; bucket is the storage partition.
POSTINGS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("tf", T.IntegerType()),
    T.StructField("positions", T.ArrayType(T.IntegerType(), False)),
    T.StructField("doc_len", T.IntegerType()),
    T.StructField("position_bytes", T.IntegerType()),
    T.StructField("bucket", T.IntegerType()),
])
STATS = T.StructType([
    T.StructField("format_version", T.IntegerType()),
    T.StructField("buckets", T.IntegerType()),
    T.StructField("num_docs", T.LongType()),
    T.StructField("num_terms", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("avg_doc_len", T.DoubleType()),
    T.StructField("postings_bytes", T.LongType()),
    T.StructField("naive_bytes", T.LongType()),
])


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
