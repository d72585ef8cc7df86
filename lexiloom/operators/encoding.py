"""The gaps, skip entries and sizes of a delta and variable-byte coded index.

All follow a term's postings in document order. Instead of one window over a term,
which a term of billions of documents would not survive, each (term, block of
documents) is a group of its own, whose postings one task orders and adds up in numpy; a
window over one row for each block then carries on the document and the byte count where
the block before it ended.

Functions of postings also take what index.packed makes of a corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import lists
from lexiloom.functions.sizes import encoded_size
from lexiloom.operators import index as I

#: Lists shorter than this have no skip entries.
SKIP_LEAST = 16
POSTING_INT_BYTES = 4


def position_gaps(posted: DataFrame) -> DataFrame:
    """postings with gaps: each position less the one before it, starting anew in each document."""
    gap = lambda p, i: p - F.when(i > 0, F.get("positions", i - 1)).otherwise(F.lit(0))
    return posted.withColumn("gaps", F.transform("positions", gap))


def coded(posted: DataFrame) -> DataFrame:
    """(term, block, listed), shuffled by term and block. Both of its readers take the same shuffle, so Spark makes it once."""
    rows = posted if "listed" in posted.columns else I.repacked(posted)
    return _known(rows).repartition("term", "block")


def _known(rows: DataFrame) -> DataFrame:
    """Says that terms and blocks aren't null. The join would add that to its own side, and the two sides' shuffles would differ."""
    return rows.where("term is not null and block is not null")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("term", "block")


def _blocks(body: DataFrame) -> DataFrame:
    """One row for each block of a term, with what lies before it."""
    blocks = _known(_sorted(body).mapInArrow(lists.blocker(I.BLOCK), "term string, block bigint, n bigint, first bigint, last bigint, bytes bigint, tokens bigint"))
    zero = F.lit(0).cast("bigint")
    outer = Window.partitionBy("term").orderBy("block")
    upto = outer.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.coalesce(F.lag("last").over(outer), zero))
    blocks = blocks.withColumn("bytes", F.col("bytes") + encoded_size(F.col("first") - F.col("carried")))
    return blocks.withColumns({
        "rows_before": F.coalesce(F.sum("n").over(upto), zero),
        "bytes_before": F.coalesce(F.sum("bytes").over(upto), zero),
        "doc_freq": F.sum("n").over(Window.partitionBy("term")),
    })


def _with_blocks(body: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """body with columns of its blocks, sorted; the join leaves a block's rows in one task."""
    told = blocks.select(F.col("term").alias("t"), F.col("block").alias("b"), *columns).hint("merge")
    joined = body.join(told, (F.col("term") == F.col("t")) & (F.col("block") == F.col("b")))
    return _sorted(joined.select("term", "block", "listed", *columns))


def doc_gaps(posted: DataFrame) -> DataFrame:
    """(term, doc_id, gap) to the posting before; the first one's from 0."""
    body = coded(posted)
    return _with_blocks(body, _blocks(body), "n", "carried").mapInArrow(lists.gapper(I.BLOCK), "term string, doc_id bigint, gap bigint")


def _skips(body: DataFrame, blocks: DataFrame, sums: bool) -> DataFrame:
    long = blocks.where(F.col("doc_freq") >= SKIP_LEAST)
    # With the tokens, which it doesn't need, it reads what term_sizes reads as well, and Spark shuffles that once.
    schema = "term string, skips bigint, skip_bytes bigint" if sums else "term string, nth bigint, skip_doc bigint, skip_offset bigint"
    return _with_blocks(body, long, "n", "carried", "rows_before", "bytes_before", "doc_freq", "tokens").mapInArrow(lists.skipper(I.BLOCK, sums), schema)


def skip_table(posted: DataFrame) -> DataFrame:
    """(term, nth, skip_doc, skip_offset): the entry for the nth posting names the document before it and its own byte offset."""
    body = coded(posted)
    return _skips(body, _blocks(body), False)


def term_sizes(posted: DataFrame) -> DataFrame:
    """(term, doc_freq, encoded_bytes, naive_bytes)."""
    body = coded(posted)
    blocks = _blocks(body)
    skips = _skips(body, blocks, True).groupBy("term").agg(F.sum("skips").alias("skips"), F.sum("skip_bytes").alias("skip_bytes"))
    whole = blocks.groupBy("term").agg(F.sum("n").alias("doc_freq"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
    whole = whole.join(skips, "term", "left")
    n = F.coalesce("skips", F.lit(0).cast("bigint"))
    return whole.select(
        "term",
        "doc_freq",
        (encoded_size(n) + F.coalesce("skip_bytes", F.lit(0).cast("bigint")) + F.col("bytes")).alias("encoded_bytes"),
        (POSTING_INT_BYTES * (2 * F.col("doc_freq") + F.col("tokens"))).alias("naive_bytes"),
    )


def naive_size(posted: DataFrame) -> DataFrame:
    """One row: the bytes of one fixed-width integer for each document id, frequency and position."""
    return posted.agg(F.coalesce(F.sum(POSTING_INT_BYTES * (2 + F.col("tf").cast("bigint"))), F.lit(0)).alias("naive_bytes"))


def index_size(posted: DataFrame) -> DataFrame:
    """One row: (postings_bytes, naive_bytes)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for c, name in (("encoded_bytes", "postings_bytes"), ("naive_bytes", "naive_bytes"))]
    return term_sizes(posted).agg(*sums)
