"""Sinks: tab-separated corpora and formatted results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(corpus: DataFrame, path: str) -> None:
    """title, url and text with tabs between, a document a line, in doc_id order over the part files."""
    line = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("title", "url", "text")])
    corpus.orderBy("doc_id").select(line.alias("value")).write.mode("overwrite").text(path)


def result_lines(results: list) -> list[str]:
    """Rank, score to four places and title; the url, where there is one, below."""
    out = []
    for rank, row in enumerate(results, 1):
        out.append(f"{rank:2d}. [{row['score']:.4f}] {row['title']}")
        if row["url"]:
            out.append(f"        {row['url']}")
    return out
