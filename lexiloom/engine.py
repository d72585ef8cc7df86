"""Search: boolean matching, ranking, top-k, late lookup of titles and urls; one query or many in one job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.model import Bm25
from lexiloom.operators import ranking as R
from lexiloom.operators import retrieval as B
from lexiloom.plans import query as Q
from lexiloom.plans.lower import folded_score, predicate
from lexiloom.store import CorpusIndex, Index, StoredIndex

RESULT = "docid bigint, score double, title string, url string"
#: Queries that share one pass over the postings.
AT_ONCE = 64
#: Rows of results that are gathered on the driver, so that the docs table is read for their ids alone; more stay distributed.
GATHERED = 10_000


class SearchEngine:
    def __init__(self, index: Index, k1: float = Bm25.k1, b: float = Bm25.b):
        self.index = index
        self.params = Bm25(k1, b)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **params: float) -> SearchEngine:
        return cls(StoredIndex(spark, folder), **params)

    @classmethod
    def of(cls, corpus: DataFrame, **params: float) -> SearchEngine:
        return cls(CorpusIndex(corpus.sparkSession, corpus), **params)

    def num_docs(self) -> int:
        return self.index.num_docs()

    def _none(self, schema: str) -> DataFrame:
        return self.index.spark.createDataFrame([], schema)

    def contributions(self, terms: list[str]) -> DataFrame:
        """(term, doc_id, positions, c): the postings of the terms with their weights.

        The document frequencies, one for each of the query's terms, go into the plan as literals.
        """
        freqs = self.index.freqs(terms)
        known = [t for t in terms if t in freqs]
        posted = self.index.postings_of(known)
        n, average = F.lit(float(self.index.num_docs())), F.lit(float(self.index.avg_doc_len()))
        freq = F.lit(0.0)
        for t in known:
            freq = F.when(F.col("term") == t, F.lit(float(freqs[t]))).otherwise(freq)
        idf = R.inverse_doc_freq(freq, n)
        weight = R.term_weight(idf, F.col("tf").cast("double"), F.col("doc_len").cast("double"), average, self.params)
        return posted.select("term", "doc_id", "positions", weight.alias("c"))

    def _rows(self, trees: list[Q.Node], scored: bool = True) -> DataFrame:
        """(doc_id, ts, pm, cs) of every document that a tree may match."""
        union = lambda f: sorted({t for tree in trees for t in f(tree)})
        terms = union(Q.all_terms)
        if scored and union(Q.scoring_terms):
            hits = self.contributions(terms)
        else:
            hits = self.index.postings_of(terms).select("term", "doc_id", "positions", F.lit(0.0).alias("c"))
        rows = B.gathered(hits, union(Q.positional_terms), union(Q.scoring_terms) if scored else None)
        if any(map(Q.holds_for_absent, trees)):
            rows = self.index.docs.select("doc_id").join(rows, "doc_id", "left")
        return rows

    def match(self, query: str) -> DataFrame:
        """(doc_id) of every match, unranked."""
        tree = Q.parse(query)
        if tree is None:
            return self._none("doc_id bigint")
        return self._rows([tree], scored=False).where(predicate(tree, F.col("ts"), F.col("pm"))).select("doc_id")

    def scores(self, query: str) -> DataFrame:
        """(doc_id, score) of every match."""
        tree = Q.parse(query)
        if tree is None:
            return self._none("doc_id bigint, score double")
        matched = self._rows([tree]).where(predicate(tree, F.col("ts"), F.col("pm")))
        return matched.select("doc_id", folded_score(F.col("cs")).alias("score"))

    def _titled(self, best: DataFrame, rows: int, order: list) -> DataFrame:
        """best, of at most rows rows, with titles and urls, in order.

        Up to GATHERED rows come to the driver, and the docs table is read for their ids
        alone: sorted by id, it skips all files but theirs. The result is a local table.
        """
        if rows > GATHERED:
            found = self.index.docs.select("doc_id", "title", "url").join(best, "doc_id")
            return found.orderBy(*order)
        hits = best.toArrow()
        ids = sorted(set(hits.column("doc_id").to_pylist()))
        docs = self.index.docs.where(F.col("doc_id").isin(ids)).select("doc_id", "title", "url").collect() if ids else []
        texts = {r["doc_id"]: r for r in docs}
        for name in ("title", "url"):
            hits = hits.append_column(name, pa.array([texts[i][name] for i in hits.column("doc_id").to_pylist()], pa.string()))
        return self.index.spark.createDataFrame(hits).orderBy(*order)

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(docid, score, title, url), best first; titles and urls are looked up for the k best alone."""
        if Q.parse(query) is None or k <= 0:
            return self._none(RESULT)
        found = self._titled(R.top_k(self.scores(query), k), k, [F.desc("score"), "doc_id"])
        return found.select(F.col("doc_id").alias("docid"), "score", "title", "url")

    def search_all(self, queries: list[str], k: int = 10) -> DataFrame:
        """(qid, query, rank, docid, score, title, url): all queries over shared passes, AT_ONCE in each; qid counts from 0.

        Queries of one meaning are answered once. A query with a syntax error raises, as it
        does alone; an empty one has no rows.
        """
        schema = f"qid int, query string, rank int, {RESULT}"
        trees = [(i, q, Q.parse(q)) for i, q in enumerate(queries)]
        trees = [t for t in trees if t[2] is not None]
        if not trees or k <= 0:
            return self._none(schema)
        number: dict[Q.Node, int] = {}
        for i, _, tree in trees:
            number.setdefault(tree, i)
        each = [(i, tree) for tree, i in number.items()]
        best = None
        for at in range(0, len(each), AT_ONCE):
            own = R.top_k_of_each(self._scored_all(each[at : at + AT_ONCE]), k)
            best = own if best is None else best.unionByName(own)
        found = self._titled(best, k * len(each), ["qid", "rank"])
        names = pa.table({"own": pa.array([i for i, _, _ in trees], pa.int32()), "query": [q for _, q, _ in trees], "same": pa.array([number[t] for _, _, t in trees], pa.int32())})
        names = self.index.spark.createDataFrame(names)
        found = found.withColumnRenamed("qid", "same").join(F.broadcast(names), "same")  # a row for each query of the call
        return found.select(F.col("own").alias("qid"), "query", "rank", F.col("doc_id").alias("docid"), "score", "title", "url").orderBy("qid", "rank")

    def _scored_all(self, trees: list[tuple[int, Q.Node]]) -> DataFrame:
        rows = self._rows([tree for _, tree in trees])
        ts, pm, cs = F.col("ts"), F.col("pm"), F.col("cs")
        each = [F.when(predicate(tree, ts, pm), F.struct(F.lit(i).alias("qid"), folded_score(cs, Q.scoring_terms(tree)).alias("score"))) for i, tree in trees]
        found = F.filter(F.array(*each), lambda x: x.isNotNull())
        return rows.select("doc_id", F.inline(found))
