"""The index: made from a corpus on the fly, or written to and opened from a folder of Parquet tables."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import model as M
from lexiloom.operators import encoding, index as I

#: Tokens for each bucket of a stored index; a bucket is the least that a lookup opens.
BUCKET_TOKENS = 4_000_000
MAX_BUCKETS = 4096
#: Tokens for each file of a bucket; a term with more is spread over several files.
FILE_TOKENS = 64_000_000
#: Files of postings that a task has open at once; the rows of more buckets are sorted first.
OPEN_FILES = 32


class BadIndex(ValueError):
    pass


class Index:
    """docs is a DataFrame, the counts are on the driver; postings_of gives the postings of some terms."""

    spark: SparkSession
    docs: DataFrame

    def num_docs(self) -> int:
        raise NotImplementedError

    def avg_doc_len(self) -> float:
        raise NotImplementedError

    def postings_of(self, terms: list[str]) -> DataFrame:
        raise NotImplementedError

    def freqs(self, terms: list[str]) -> dict[str, int]:
        """The document frequency of those terms that occur: as many rows on the driver as the query has terms."""
        raise NotImplementedError


class CorpusIndex(Index):
    """Nothing is stored; each query reads the corpus, but sorts and groups its own terms alone."""

    def __init__(self, spark: SparkSession, corpus: DataFrame):
        self.spark = spark
        self.corpus = I.spread(I.unique_ids(corpus))
        self.docs = I.docs(corpus)
        self.totals: tuple[int, int] | None = None

    def _totals(self) -> tuple[int, int]:
        if self.totals is None:
            self.freqs([])
        return self.totals

    def num_docs(self) -> int:
        return self._totals()[0]

    def avg_doc_len(self) -> float:
        n, tokens = self._totals()
        return tokens / n if n else 0.0

    def postings_of(self, terms: list[str]) -> DataFrame:
        return I.postings(self.corpus, terms)

    def freqs(self, terms: list[str]) -> dict[str, int]:
        n, tokens, found = I.counts_of(self.corpus, terms)
        self.totals = n, tokens
        return found


class StoredIndex(Index):
    """Opened lazily: opening reads the one row of stats."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        try:
            row = read("stats", M.STATS).first()
        except AnalysisException as e:
            raise BadIndex(f"{folder} holds no index") from e
        if row is None or row["format_version"] != M.FORMAT_VERSION:
            raise BadIndex(f"{folder} holds no index of format {M.FORMAT_VERSION}")
        self.stats = row.asDict()
        self.docs, self.postings, self.terms = read("docs", M.DOCS), read("postings", M.POSTINGS), read("terms", M.TERMS)

    def num_docs(self) -> int:
        return self.stats["num_docs"]

    def avg_doc_len(self) -> float:
        return self.stats["avg_doc_len"]

    def postings_of(self, terms: list[str]) -> DataFrame:
        """Partition pruning by bucket, then the pushed filter on the sorted term column."""
        return self.postings.where(F.col("bucket").isin(self._buckets(terms)) & F.col("term").isin(terms))

    def _buckets(self, terms: list[str]) -> list[int]:
        """As literals, for a static partition filter; hashed by the optimizer, without a job."""
        if not terms:
            return []
        listed = self.spark.createDataFrame(pa.table({"t": pa.array(terms, pa.string())}))
        return sorted({r[0] for r in listed.select(I.bucket_of(F.col("t"), self.stats["buckets"])).collect()})

    def freqs(self, terms: list[str]) -> dict[str, int]:
        found = self.terms.where(F.col("term").isin(terms)).select("term", "doc_freq").collect() if terms else []
        return {r["term"]: r["doc_freq"] for r in found}


def find_term(index: Index, term: str) -> int | None:
    """The document frequency of a term, None where the dictionary has no such term."""
    return index.freqs([term]).get(term)


def _placed(corpus: DataFrame, terms: DataFrame, tokens: int, buckets: int) -> DataFrame:
    """Postings in files of about FILE_TOKENS: a bucket's light terms by their hash, a term that fills files of its own by blocks of documents.

    A term's postings are shuffled and sorted as lists, and become rows only to be written.
    """
    parts = max(1, math.ceil(tokens / buckets / FILE_TOKENS))
    inner = F.pmod(F.xxhash64("term", F.lit(7)), F.lit(parts)).cast("int")
    listed = I.placed(corpus).withColumn("bucket", I.bucket_of(F.col("term"), buckets))
    if tokens > FILE_TOKENS:
        # At most tokens / FILE_TOKENS terms have so many tokens; beyond that bound nothing is broadcast.
        own = F.col("naive_bytes") / encoding.POSTING_INT_BYTES - 2 * F.col("doc_freq")
        heavy = terms.where(own > FILE_TOKENS).select("term", F.ceil(own / FILE_TOKENS).cast("int").alias("files"))
        listed = listed.join(F.broadcast(heavy) if tokens / FILE_TOKENS <= 1_000_000 else heavy, "term", "left")
        inner = F.when(F.col("files").isNotNull(), -1 - F.pmod(F.xxhash64(F.shiftright("block", I.PLACED_SHIFT)), F.col("files")).cast("int")).otherwise(inner)
    listed = listed.withColumn("part", inner).repartition("bucket", "part", F.when(F.col("part") < 0, F.col("term")))
    return I.unplaced(listed.sortWithinPartitions("bucket", "term", "block"))


@contextmanager
def _files_side_by_side(spark: SparkSession) -> Iterator[None]:
    """Tasks write the files of all their buckets at once. They would sort their rows by bucket else, in which order they come already."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build_index(corpus: DataFrame, folder: str, buckets: int | None = None) -> dict:
    """Write postings, terms, docs and stats; returns the build report.

    The corpus is read three times: for docs, which tells how many buckets are needed, for
    the dictionary with its sizes, which tells the terms that need files of their own, and
    for postings. Raises DuplicateId before anything but docs is written where a doc_id repeats.
    """
    began = time.perf_counter()
    spark = corpus.sparkSession
    folder = folder.rstrip("/")
    corpus = I.spread(corpus)
    # In ranges of doc_id, so that a lookup of a few ids skips all files and row groups but theirs.
    I.measured_docs(corpus).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{folder}/docs")
    docs = I.unique_ids(spark.read.schema(M.DOCS).parquet(f"{folder}/docs"))
    totals = docs.agg(F.count("*").alias("n"), F.sum(F.col("length").cast("bigint")).alias("t")).first()
    n, tokens = totals["n"], totals["t"] or 0
    if buckets is None:
        buckets = max(8, min(MAX_BUCKETS, math.ceil(tokens / BUCKET_TOKENS)))
    # Term-ordered: a lookup skips all files but one by their least and greatest terms.
    ordered = encoding.term_sizes(I.packed(corpus)).repartitionByRange("term").sortWithinPartitions("term")
    ordered.write.mode("overwrite").parquet(f"{folder}/terms")
    terms = spark.read.schema(M.TERMS).parquet(f"{folder}/terms")
    with _files_side_by_side(spark):
        _placed(corpus, terms, tokens, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    sums = spark.read.parquet(f"{folder}/terms").agg(F.count("*").alias("terms"), F.sum("encoded_bytes").alias("e"), F.sum("naive_bytes").alias("v")).first()
    stats = {
        "format_version": M.FORMAT_VERSION, "buckets": buckets, "num_docs": n, "num_terms": sums["terms"], "total_tokens": tokens,
        "avg_doc_len": tokens / n if n else 0.0, "postings_bytes": sums["e"] or 0, "naive_bytes": sums["v"] or 0,
    }
    spark.createDataFrame([tuple(stats[f.name] for f in M.STATS)], M.STATS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    keys = ("num_docs", "num_terms", "total_tokens", "postings_bytes", "naive_bytes")
    return {k: stats[k] for k in keys} | {"build_seconds": time.perf_counter() - began}
