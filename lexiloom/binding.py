"""Plain functions over files and lists: what other programs call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexiloom import store
from lexiloom.engine import SearchEngine
from lexiloom.sources.corpus import read_tsv


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.appName("lexiloom").getOrCreate()


def build_index(corpus: str, out_dir: str, spark: SparkSession | None = None) -> dict:
    """Index a tab-separated file; returns num_docs, num_terms, total_tokens, postings_bytes, naive_bytes and build_seconds."""
    return store.build_index(read_tsv(_session(spark), corpus), out_dir)


class Engine:
    """A stored index, searched for lists of dicts."""

    def __init__(self, index_dir: str, spark: SparkSession | None = None):
        self.engine = SearchEngine.open(_session(spark), index_dir)

    def search(self, query: str, k: int = 10) -> list[dict]:
        """docid, score, title and url of the k best documents."""
        return [r.asDict() for r in self.engine.search(query, k).collect()]

    def num_docs(self) -> int:
        return self.engine.num_docs()
