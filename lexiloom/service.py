"""The search endpoint as plain functions: what a web handler would call."""

from __future__ import annotations

import time

from lexiloom.engine import SearchEngine
from lexiloom.plans.query import QuerySyntaxError

DEFAULT_K, MAX_K = 10, 50


def clamped_k(value: object) -> int:
    try:
        return min(max(int(value), 1), MAX_K)
    except (TypeError, ValueError):
        return DEFAULT_K


def api_search(engine: SearchEngine, q: str | None, k: object = DEFAULT_K) -> dict:
    """query, count (of what is returned), took_ms, results, error; a syntax error is reported, not raised."""
    query = (q or "").strip()
    answer = {"query": query, "count": 0, "took_ms": 0.0, "results": [], "error": None}
    if not query:
        return answer
    began = time.perf_counter()
    try:
        answer["results"] = [r.asDict() for r in engine.search(query, clamped_k(k)).collect()]
    except QuerySyntaxError as e:
        answer["error"] = str(e)
    return answer | {"count": len(answer["results"]), "took_ms": round((time.perf_counter() - began) * 1000, 3)}
