import random

import numpy as np
import pytest

from lexiloom.llm import mixing as M
from tests.llm.cases import documents, prose, rows

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        flavour = (["essay", "clear"], ["BUY", "!!!", "CLICK"], ["vileword", "grubfoul"])[kind]
        words = prose(rng, rng.randrange(10, 60)).split(" ") + flavour * rng.randrange(2, 6)
        docs.append((i, " ".join(words), "en", f"s{i % 5}"))
        labels.append((i, int(kind == 0), int(kind == 2)))
    return docs, labels


def brute(n, p, targets, steps=200_000):
    """The same objective by plain projected gradient descent."""
    w = n / n.sum()
    m = (w[:, None] * p).T @ p + 1e-6 * np.eye(p.shape[1])
    inverse = np.linalg.inv(m)
    r = np.ones(len(n))
    for _ in range(steps):
        e = (w * r) @ p - targets
        new = np.maximum(0, r - 0.3 * (p @ (inverse @ e) + M.RIDGE * (r - 1)))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400).astype(float)
    targets = np.array([0.7, 0.2, 0.1])
    table = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p)], "n double, p array<double>")
    got = M.rates(p, M.solve(table, targets))
    want = brute(n, p, targets)
    assert (got >= 0).all() and np.abs(got - want).max() < 5e-3
    w = n / n.sum()
    assert np.abs((w * got) @ p - targets).max() < 0.03


def test_posteriors_and_targets(spark):
    docs, labels = corpus(random.Random(14), 300)
    out = M.mixture_rates(documents(spark, docs), spark.createDataFrame(labels[:200], LABELS), {"high": 0.6, "low": 0.25, "toxic": 0.15})
    got = out.collect()
    assert out.columns == ["doc_id", "source", "tokens", "p_high", "p_low", "p_toxic", "rate"] and len(got) == 300
    p = np.array([[r["p_high"], r["p_low"], r["p_toxic"]] for r in got])
    assert np.abs(p.sum(1) - 1).max() < 1e-5
    held = [r for r in got if r["doc_id"] >= 200]
    assert np.mean([np.argmax([r["p_high"], r["p_low"], r["p_toxic"]]) == r["doc_id"] % 3 for r in held]) > 0.9
    n, rate = np.array([r["tokens"] for r in got], float), np.array([r["rate"] for r in got])
    assert np.abs((n / n.sum() * rate) @ p - [0.6, 0.25, 0.15]).max() < 0.03 and rate.min() >= 0


def test_defined_cases(spark):
    docs, labels = corpus(random.Random(15), 90)
    docs += [(500, None), (501, ""), (None, "essay clear", "en", None), (0, *docs[0][1:]), (502, "essay clear words " * 100_000)]
    table = documents(spark, docs, clash=True)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (500, None, 1), (3, 0, 0), (501, 5, 5)], LABELS)
    got = rows(M.mixture_rates(table, marks))
    assert len(got) == len(docs) and got[0] == got[1]
    by = {r[0]: r for r in got}
    assert by[500][2] == by[501][2] == 0 and by[502][2] == 300_000 and by[None][1] is None and all(r[-1] >= 0 for r in got)
    kept = M.mixed(table, marks)
    assert kept.columns == [*table.columns, "mixing_rate"]
    assert sorted(map(str, (r[0] for r in kept.select("doc_id").collect()))) == sorted(str(r[0]) for r in got)


def test_too_few_domains_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b", "en"), (2, None, "en")])
    for marks in ([], [(1, 1, 0)]):
        table = spark.createDataFrame(marks, LABELS)
        assert [(r[0], r[2], r[-1]) for r in rows(M.mixture_rates(docs, table))] == [(1, 2, 1.0), (2, 0, 1.0)]
        assert M.mixed(docs, table).columns == [*docs.columns, "rate"]
        taken = docs.selectExpr("*", "7 as Rate", "8 as mixing_rate")
        assert [tuple(r)[-3:] for r in M.mixed(taken, table).collect()] == [(7, 8, 1.0)] * 2 and M.mixed(taken, table).columns[-1] == "mixing_rate_2"
    assert rows(M.mixture_rates(documents(spark, []), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS))) == []
    both = documents(spark, [(1, "a"), (2, "b")])
    with pytest.raises(ValueError):
        M.mixture_rates(both, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS), {"high": 0.0, "low": 0.0})
