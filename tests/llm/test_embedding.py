import math

import numpy as np
import pytest

from lexiloom.llm import embedding_dedup as E
from tests.llm.cases import rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, key bigint, id string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in vectors], SCHEMA)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 64))
    near = [base[i % 300] + rng.normal(size=64) * s for i in range(500) for s in [(0.05, 0.3, 0.5, 0.9)[i % 4]]]
    return np.concatenate([base, near]).astype(np.float32)


def brute(data, threshold=E.THRESHOLD):
    """(vec_id, class_id, links) of each id, from all pairs."""
    usable = {}
    for i, v in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(tuple(np.float64(x) + 0.0 for x in v), set()).add(i)
    nodes = {v: min(ids) for v, ids in usable.items()}
    unit = {v: (lambda w: w / np.linalg.norm(w))(np.array(v) / np.abs(v).max()) for v in nodes}
    links, root = dict.fromkeys(nodes, 0), {i: i for i in nodes.values()}
    listed = list(nodes)
    pairs = []
    for dim in {len(v) for v in listed}:
        own = [v for v in listed if len(v) == dim]
        x = np.stack([unit[v] for v in own])
        for i, j in zip(*np.nonzero(x @ x.T >= threshold)):
            if nodes[own[i]] != nodes[own[j]]:
                links[own[i]] += 1
                pairs.append((nodes[own[i]], nodes[own[j]]))
    for _ in root:
        for p, q in pairs:
            root[p] = root[q] = min(root[p], root[q])
        if all(root[p] == root[q] for p, q in pairs):
            break
    out = {i: (i, i, 0) for i, _ in data if i is not None}
    for v, ids in usable.items():
        for i in ids:
            out[i] = (i, min(out[i][1], root[nodes[v]]), out[i][2] + links[v])
    return sorted(out.values())


def listed(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_links_and_classes(spark, cloud):
    data = listed(np.concatenate([cloud, cloud[:40], cloud[:40]]))
    want, got = brute(data), rows(E.near_duplicate_vectors(table(spark, data)))
    assert len(got) == len(want) == len(data)
    wanted, found = sum(w[2] for w in want), sum(g[2] for g in got)
    assert wanted > 600 and 0.95 * wanted <= found and all(g[2] <= w[2] and g[1] >= w[1] for g, w in zip(got, want))
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.9


def test_dense_groups_in_blocks(spark):
    """One hot bucket, cut into blocks: the same result, and none of the links is lost."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=32)
    data = listed((center + rng.normal(size=(400, 32)) * 0.22).astype(np.float32)) + [(900 + i, center.tolist()) for i in range(100)]
    want = brute(data)
    for hot in (E.HOT, 50):
        got = rows(E.near_duplicate_vectors(table(spark, data), hot=hot, recall=0.9999))
        assert sum(g[2] for g in got) >= 0.99 * sum(w[2] for w in want) > 10_000
        assert all(g[2] <= w[2] for g, w in zip(got, want)) and {g[1] for g in got} == {0}


def test_against_sql(spark, cloud):
    import duckdb
    import pandas as pd

    data = [(i, v) for i, v in listed(cloud[::4])] + [(1000 + i, v) for i, v in listed(cloud[:30])] + [(2000, []), (2001, None), (2002, [0.0] * 64)]
    con = duckdb.connect()
    con.register("raw", pd.DataFrame(data, columns=["vec_id", "embedding"]))
    con.execute("CREATE VIEW embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM raw")
    want = sorted(con.execute(E.ORACLE).fetchall())
    assert want == brute(data)
    assert rows(E.near_duplicate_vectors(table(spark, data), recall=0.9999)) == want


def test_estimates_are_unbiased_and_bounded(cloud):
    u = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    true = u[:200] @ u[300:500].T
    sums, inside = np.zeros_like(true), 0
    for seed in range(60):
        rot = E.rotation(64, seed)
        y, code, factor = E.encode(u, rot)
        signs = np.unpackbits(code, axis=1)[:, :64].astype(np.float32) * 2 - 1
        est = E.estimates(y[:200], signs[300:500], factor[300:500])
        sums += est
        width = E.Z * np.sqrt((1 - factor[300:500] ** 2) / factor[300:500] ** 2 / 63 * (1 - true**2))
        inside += (np.abs(est - true) <= width).mean()
    assert np.abs(sums / 60 - true).mean() < 0.02 and inside / 60 > 0.995


def test_plan_keeps_recall_and_bucket_size():
    for n in (10, 10_000, 10**7, 10**10):
        planes, tables = E.plan(n, E.THRESHOLD)
        meet = (1 - math.acos(E.THRESHOLD) / math.pi) ** planes
        assert 1 - (1 - meet) ** tables >= E.RECALL and (n / 2**planes <= E.PER_BUCKET or planes == 32)


def test_copies_of_any_number_are_one_vector(spark):
    v = [1.0] + [0.0] * 7
    w = [1.0, 0.1] + [0.0] * 6
    data = [(i, v) for i in range(3000)] + [(5000 + i, w) for i in range(500)] + [(9000, [0.0] * 7 + [1.0])]
    got = rows(E.near_duplicate_vectors(table(spark, data)))
    assert got == [(i, 0, 1) for i, _ in data[:-1]] + [(9000, 9000, 0)]


def test_defined_cases(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    data = [
        (1, v), (2, w), (2, w), (3, None), (None, v), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [1.0, 2.0]),
        (9, [-1.0, -2.0, -3.0]), (10, [float("inf"), 1.0, 1.0]), (11, [0.0, 1.0, -1.0]), (11, [1.0, 2.0, 2.999]), (12, [-0.0, 5.0, -5.0]), (13, [0.0, 5.0, -5.0]),
    ]
    got = rows(E.near_duplicate_vectors(table(spark, data), recall=0.9999))
    assert got == brute(data) and got[0] == (1, 1, 2) and [g[0] for g in got] == list(range(1, 14))
    assert rows(E.near_duplicate_vectors(table(spark, []))) == []


def test_finite_elements_of_any_size(spark):
    data = [(1, [1e151, 1e151]), (2, [1e151, 1e151]), (3, [1e300, 1.1e300]), (4, [1e-200, 1e-200]), (5, [1e-310, -1e-310]), (6, [0.0, 0.0])]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert rows(E.near_duplicate_vectors(frame, recall=0.9999)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 5, 0), (6, 6, 0)]


def test_every_dimension_is_searched(spark):
    data = [(i, [float(i), 1.0, 2.0]) for i in range(0, 50, 10)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [2.0, -1.0]), (200, [1.0] * 5), (201, [2.0] * 5), (300, [1.0] * 6)]
    got = rows(E.near_duplicate_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>"), recall=0.9999))
    assert got == brute(data) and got[5:] == [(100, 100, 0), (101, 100, 0), (102, 102, 0), (200, 200, 1), (201, 200, 1), (300, 300, 0)]
