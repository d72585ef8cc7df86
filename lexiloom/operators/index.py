"""The positional inverted index as DataFrames.

Postings are made inside each Arrow batch of documents, in numpy (functions/lists.py). So
tokens are never shuffled; only finished postings are, once, to their place in storage.

Postings are stored in buckets by the hash of the term (a directory each, so that a
lookup reads the buckets of its terms alone) and within them by blocks of documents,
so that a term that every document holds is spread over many tasks and files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import lists
from lexiloom.functions import text as X
from lexiloom.functions.sizes import encoded_size
from lexiloom.shipping import ship

#: Documents in a block. A power of two.
BLOCK = 1 << 20
PLACED_SHIFT = 4
PACKED = "term string, block bigint, listed binary"


def as_corpus(table: DataFrame, doc_id: str = "doc_id", text: str = "text", title: str | None = None, url: str | None = None) -> DataFrame:
    """Any table with an id and a text as a corpus; title and url are empty unless named. Rows without an id are left out.

    Ids must be unique, as positions are told apart by them: searches and builds raise DuplicateId
    otherwise. Null texts are empty. Other columns are not read.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    return table.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), word(title).alias("title"), word(url).alias("url"), word(text).alias("text")
    )


class DuplicateId(ValueError):
    pass


def unique_ids(corpus: DataFrame) -> DataFrame:
    """The corpus, once it is sure that no doc_id repeats; reads that column alone."""
    again = corpus.groupBy("doc_id").count().where("count > 1").select("doc_id").first()
    if again:
        raise DuplicateId(f"doc_id {again[0]} occurs more than once")
    return corpus


def spread(corpus: DataFrame) -> DataFrame:
    """A corpus of fewer partitions than there are cores (one small file, say) is dealt out to all of them."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.repartition(cores) if corpus._jdf.queryExecution().toRdd().getNumPartitions() < cores else corpus


def tokenized(corpus: DataFrame) -> DataFrame:
    """(doc_id, tokens) of title and text."""
    return corpus.select("doc_id", X.tokens(X.searchable(F.col("title"), F.col("text"))).alias("tokens"))


def token_positions(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, term), one row for each token."""
    return tokenized(corpus).select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def docs(corpus: DataFrame) -> DataFrame:
    length = F.size(X.tokens(X.searchable(F.col("title"), F.col("text"))))
    return corpus.select("doc_id", "title", "url", length.alias("length"))


def measured_docs(corpus: DataFrame) -> DataFrame:
    """docs, with the lengths counted in numpy: faster where all of them are wanted, but a query for ids or titles alone counts them too."""
    ship(corpus.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists.lengths(batch.column(3)))], names=["doc_id", "title", "url", "length"])

    text = X.searchable(F.col("title"), F.col("text"))
    return corpus.select("doc_id", "title", "url", text.alias("text")).mapInArrow(run, "doc_id bigint, title string, url string, length int")


def _searchable(corpus: DataFrame) -> DataFrame:
    ship(corpus.sparkSession)
    return corpus.select("doc_id", X.searchable(F.col("title"), F.col("text")).alias("text"))


def postings(corpus: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, positions, doc_len, position_bytes); with only, of these terms alone, which drops all others before they are sorted."""
    return _searchable(corpus).mapInArrow(lists.poster(only), "term string, doc_id bigint, tf int, positions array<int>, doc_len int, position_bytes int")


def packed(corpus: DataFrame) -> DataFrame:
    """(term, block, listed): the postings without their positions, a row for each term, block and piece of the corpus (see lists.packer)."""
    return _searchable(corpus).mapInArrow(lists.packer(BLOCK), PACKED)


def placed(corpus: DataFrame) -> DataFrame:
    """packed, with the documents' lengths among the ints and the positions beside them; in smaller blocks, so that all postings of one fit into a task."""
    return _searchable(corpus).mapInArrow(lists.packer(placed_block(), True), f"{PACKED}, places binary")


def placed_block() -> int:
    return max(1, BLOCK >> PLACED_SHIFT)


def unplaced(rows: DataFrame) -> DataFrame:
    """The postings of placed rows, which are sorted by bucket, term and block."""
    listed = rows.select("term", "block", "listed", "places", "bucket")
    return listed.mapInArrow(lists.unpacker(placed_block()), "term string, doc_id bigint, tf int, positions array<int>, doc_len int, position_bytes int, bucket int")


def repacked(posted: DataFrame) -> DataFrame:
    """packed, of postings."""
    ship(posted.sparkSession)
    known = F.col("position_bytes") if "position_bytes" in posted.columns else position_bytes(F.col("positions"))
    size = encoded_size(F.col("tf")) + known
    return posted.select("term", F.col("doc_id").cast("bigint"), F.col("tf").cast("int"), size.cast("int")).mapInArrow(lists.repacker(BLOCK), PACKED)


def dictionary(posted: DataFrame) -> DataFrame:
    """(term, doc_freq) of postings."""
    return posted.groupBy("term").agg(F.count("*").alias("doc_freq"))


def doc_frequencies(corpus: DataFrame) -> DataFrame:
    """(term, doc_freq) straight from texts: no positions, and counts combined before the shuffle."""
    return tokenized(corpus).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("doc_freq"))


def counts_of(corpus: DataFrame, terms: list[str]) -> tuple[int, int, dict[str, int]]:
    """Documents, tokens, and the document frequency of each of the terms that occurs: one pass, a row for each term to the driver."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    # The empty term, which no text has, stands for the document itself.
    listed = F.array_append(F.array_intersect("tokens", wanted), F.lit(""))
    rows = tokenized(corpus).select(F.size("tokens").cast("bigint").alias("n"), F.explode(listed).alias("term"))
    found = {r["term"]: r for r in rows.groupBy("term").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()}
    own = found.pop("", None)
    return (own["c"], own["n"], {t: r["c"] for t, r in found.items()}) if own else (0, 0, {})


def corpus_stats(doc_table: DataFrame, terms: DataFrame) -> DataFrame:
    """(num_docs, num_terms, total_tokens, avg_doc_len), one row."""
    totals = doc_table.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum(F.col("length").cast("bigint")), F.lit(0)).alias("total_tokens"))
    some = terms.agg(F.count("*").alias("num_terms"))
    average = F.when(F.col("num_docs") > 0, F.col("total_tokens") / F.col("num_docs")).otherwise(F.lit(0.0))
    return totals.crossJoin(F.broadcast(some)).select("num_docs", "num_terms", "total_tokens", average.alias("avg_doc_len"))


def position_bytes(positions: Column) -> Column:
    """Bytes of a document's positions, each coded as the gap to the one before; positions are ints, so five bytes at most."""
    def step(state: Column, p: Column) -> Column:
        gap = p - state["p"]
        size = sum(((gap >= F.lit(1 << bits)).cast("int") for bits in (7, 14, 21, 28)), F.lit(1))
        return F.struct(p.alias("p"), (state["b"] + size).alias("b"))

    return F.aggregate(positions, F.struct(F.lit(0).alias("p"), F.lit(0).alias("b")), step, lambda s: s["b"])


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def block_of(doc_id: Column) -> Column:
    return F.shiftright(doc_id, BLOCK.bit_length() - 1)
