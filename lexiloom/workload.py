"""Timing of query workloads."""

from __future__ import annotations

import time

from lexiloom.engine import SearchEngine


def latency_summary(millis: list[float], total_ms: float) -> dict:
    """Mean, median (the upper one), 95th percentile (by position, so the greatest of few) and queries a second."""
    s = sorted(millis)
    n = len(s)
    return {"mean_ms": sum(s) / n, "p50_ms": s[n // 2], "p95_ms": s[min(n - 1, int(n * 0.95))], "qps": 1000.0 * n / total_ms}


def run_serially(engine: SearchEngine, queries: list[str], k: int = 10) -> dict:
    millis, hits = [], 0
    began = time.perf_counter()
    for q in queries:
        t = time.perf_counter()
        hits += len(engine.search(q, k).collect())
        millis.append((time.perf_counter() - t) * 1000)
    return {"queries": len(queries), "hits": hits} | latency_summary(millis, (time.perf_counter() - began) * 1000)


def run_at_once(engine: SearchEngine, queries: list[str], k: int = 10) -> dict:
    began = time.perf_counter()
    hits = len(engine.search_all(queries, k).collect())
    seconds = time.perf_counter() - began
    return {"queries": len(queries), "hits": hits, "seconds": seconds, "qps": len(queries) / seconds}
