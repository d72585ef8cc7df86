"""python -m lexiloom build CORPUS INDEX | search INDEX QUERY [K] | bench INDEX QUERIES [K]"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from lexiloom.engine import SearchEngine
from lexiloom.sources.corpus import read_queries, read_tsv
from lexiloom.sources.sinks import result_lines
from lexiloom.store import build_index
from lexiloom.workload import run_at_once, run_serially


def _build(spark: SparkSession, corpus: str, folder: str) -> None:
    r = build_index(read_tsv(spark, corpus), folder)
    shrink = 100.0 * (1.0 - r["postings_bytes"] / r["naive_bytes"]) if r["naive_bytes"] else 0.0
    print(f"index written to {folder}")
    for name, value in (
        ("documents", r["num_docs"]), ("unique terms", r["num_terms"]), ("total tokens", r["total_tokens"]),
        ("postings size", f"{r['postings_bytes'] / 1e6:.2f} MB"), ("naive size", f"{r['naive_bytes'] / 1e6:.2f} MB"),
        ("shrink", f"{shrink:.1f} %"), ("build time", f"{r['build_seconds']:.2f} s"),
    ):
        print(f"  {name:<14} {value}")


def _search(spark: SparkSession, folder: str, query: str, k: str = "10") -> None:
    began = time.perf_counter()
    engine = SearchEngine.open(spark, folder)
    opened = time.perf_counter()
    found = engine.search(query, int(k)).collect()
    print(f"open: {(opened - began) * 1000:.2f} ms; {len(found)} results in {(time.perf_counter() - opened) * 1000:.3f} ms\n")
    print("\n".join(result_lines(found)))


def _bench(spark: SparkSession, folder: str, path: str, k: str = "10") -> None:
    engine = SearchEngine.open(spark, folder)
    queries = read_queries(spark, path)
    for name, result in (("one by one", run_serially(engine, queries, int(k))), ("in one job", run_at_once(engine, queries, int(k)))):
        print(name + ": " + ", ".join(f"{key} {value:.3f}" if isinstance(value, float) else f"{key} {value}" for key, value in result.items()))


COMMANDS = {"build": (_build, 2, 2), "search": (_search, 2, 3), "bench": (_bench, 2, 3)}


def main(args: list[str]) -> int:
    run, least, most = COMMANDS.get(args[0], (None, 0, 0)) if args else (None, 0, 0)
    if run is None or not least <= len(args) - 1 <= most:
        print(__doc__, file=sys.stderr)
        return 1
    try:
        run(SparkSession.builder.appName("lexiloom").getOrCreate(), *args[1:])
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
