"""Boolean retrieval as set algebra over (doc_id) sets, and the grouped form that queries use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lower import folded_score, phrase_condition
from lexiloom.plans.query import And, Node, Not, Or, Phrase, Term


def term_docs(posted: DataFrame, term: str) -> DataFrame:
    return posted.where(F.col("term") == term).select("doc_id")


def phrase_docs(posted: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Documents with the terms side by side: one join on doc_id for each term, narrowing the starts."""
    if not terms:
        return posted.select("doc_id").where(F.lit(False))
    if len(terms) == 1:
        return term_docs(posted, terms[0])
    lists = [posted.where(F.col("term") == t).select("doc_id", F.col("positions").alias(f"p{i}")) for i, t in enumerate(terms)]
    joined = reduce(lambda a, b: a.join(b, "doc_id"), lists)
    order = {i: F.col(f"p{i}") for i in range(len(terms))}
    return joined.where(phrase_condition(tuple(range(len(terms))), order.__getitem__)).select("doc_id")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def complement(doc_table: DataFrame, a: DataFrame) -> DataFrame:
    return doc_table.select("doc_id").join(a, "doc_id", "left_anti")


def evaluate(node: Node, posted: DataFrame, doc_table: DataFrame) -> DataFrame:
    """The (doc_id) set of a syntax tree, by joins. In an AND, negated parts become anti joins."""
    match node:
        case Term(term):
            return term_docs(posted, term)
        case Phrase(terms):
            return phrase_docs(posted, terms)
        case Not(part):
            return complement(doc_table, evaluate(part, posted, doc_table))
        case Or(parts):
            return reduce(union, [evaluate(p, posted, doc_table) for p in parts])
        case And(parts):
            wanted = [p for p in parts if not isinstance(p, Not)]
            barred = [p.part for p in parts if isinstance(p, Not)]
            out = reduce(intersection, [evaluate(p, posted, doc_table) for p in wanted]) if wanted else doc_table.select("doc_id")
            return reduce(lambda a, p: a.join(evaluate(p, posted, doc_table), "doc_id", "left_anti"), barred, out)


def gathered(hits: DataFrame, positional: list[str], scoring: list[str] | None) -> DataFrame:
    """One row for each document that holds any of the terms: ts, pm and cs, from one shuffle.

    hits has (term, doc_id, positions, c). Columns that no query needs aren't made, so
    that the scan reads no positions for a query without phrases.
    """
    aggregates = [F.collect_list("term").alias("ts")]
    if positional:
        wanted = F.when(F.col("term").isin(positional), F.struct("term", "positions"))
        aggregates.append(F.map_from_entries(F.collect_list(wanted)).alias("pm"))
    if scoring:
        pair = F.struct("term", "c")
        aggregates.append(F.collect_list(F.when(F.col("term").isin(scoring), pair)).alias("cs"))
    out = hits.groupBy("doc_id").agg(*aggregates)
    if not positional:
        out = out.withColumn("pm", F.lit(None).cast("map<string,array<int>>"))
    if not scoring:
        out = out.withColumn("cs", F.lit(None).cast("array<struct<term:string,c:double>>"))
    return out


__all__ = ["complement", "evaluate", "folded_score", "gathered", "intersection", "phrase_docs", "term_docs", "union"]
