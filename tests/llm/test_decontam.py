import random

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import decontam as D
from lexiloom.llm import textkernel as K
from tests.llm.cases import changed, documents, prose, rows

ITEMS = "item_id bigint, text string"


def grams(text):
    t = K.tokenize([text])
    return D.weighted_grams(t, D.SHINGLE)


def brute(docs, items, threshold=D.THRESHOLD):
    """(doc_id, item_id) -> best similarity over all windows of the item's length."""
    best = {}
    for d, text in docs:
        h, w = grams(text)
        for i, item in items:
            ih, iw = grams(item)
            n = len(ih)
            if n < D.MIN_WORDS:
                continue
            b = D.bag(ih, iw)
            for s in range(max(1, len(h) - n + 1)):
                last = max(min(s + n, len(h)) - 1, s + 1)
                x = D.similarity(D.bag(h[s:last], w[s:last]), b) if len(h) else 0.0
                if x >= threshold and x > best.get((d, i), (0,))[0]:
                    best[(d, i)] = (x, s)
    return sorted((d, i, s, round(x, 9)) for (d, i), (x, s) in best.items())


def fixture():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([6, 12, 30, 30, 55]))) for i in range(12)]
    docs = []
    for d in range(60):
        text = prose(rng, rng.randrange(0, 120))
        if d % 2:
            item = changed(rng, rng.choice(items)[1], rng.choice([0, 0, 0.05, 0.1, 0.3]))
            text = f"{text}. {item.upper() if d % 3 else item}\n{prose(rng, rng.randrange(0, 40))}"
        docs.append((d, text))
    return docs, items


def found(df):
    return [(a, b, c, round(s, 9)) for a, b, c, s in rows(df)]


def test_against_all_windows(spark):
    docs, items = fixture()
    table = spark.createDataFrame(items, ITEMS)
    got, want = found(D.contaminated(documents(spark, docs), table)), brute(docs, items)
    assert set(g[:2] for g in got) <= set(w[:2] for w in want)
    sure = {w[:2] for w in want if w[3] >= 0.6}
    assert sure <= {g[:2] for g in got} and len(got) >= 0.9 * len(want)
    assert len(set(got) & set(want)) >= 0.9 * len(got)
    sliced = found(D.contaminated(documents(spark, docs), table, slice_words=40))
    assert sliced == got


def test_simhash_by_prefix_sums():
    rng = np.random.default_rng(1)
    h, w = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 9, 300).astype(np.int32)
    first, last = np.array([0, 5, 5, 290, 7]), np.array([30, 6, 120, 300, 7])
    for a, b, got in zip(first, last, D.simhash(h, w, first, last)):
        bits = [sum((1 if int(h[i]) >> j & 1 else -1) * int(w[i]) for i in range(a, b)) >= 0 for j in range(64)]
        assert int(got) == sum(1 << j for j, x in enumerate(bits) if x)


def test_blocks_find_all_within_the_radius_and_none_beyond():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 12)) for _ in range(70)]
    items = D._Items(list(range(70)), texts, D.SHINGLE, D.THRESHOLD, D.RADIUS)
    prints = np.concatenate([items.prints ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64)), rng.integers(0, 2**63, 4000).astype(np.uint64)])
    for r in range(30):
        prints[r + 70] = items.prints[r] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 15 + r % 10, replace=False)))
    got = set(zip(*(x.tolist() for x in items.near(prints, 0))))
    want = {(w, i) for w in range(len(prints)) for i in range(70) if bin(int(prints[w]) ^ int(items.prints[i])).count("1") <= D.RADIUS}
    assert got == want and len(want) > 90


def test_defined_cases(spark):
    rng = random.Random(6)
    item = prose(rng, 20)
    data = [(1, f"x {item} y"), (1, f"x {item} y"), (2, None), (3, ""), (None, item), (4, prose(rng, 150_000) + " " + item), (5, "clean words only"), (6, item[: len(item) // 2])]
    df = documents(spark, data, clash=True)
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "too short"), (10, ""), (11, "one"), (12, "words only")], ITEMS).withColumn("doc_id", F.lit(1))
    assert [r[:2] for r in rows(D.contaminated(df, bench).select("doc_id", "item_id"))] == [(1, 7), (4, 7), (5, 12)]
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and [r[0] for r in rows(kept.select("doc_id"))] == [2, 3, 5, 6, None]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), documents(spark, [(1, "a b c")])
    assert rows(D.contaminated(some, none)) == [] and rows(D.decontaminate(some, none)) == rows(some)
    assert rows(D.contaminated(documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], ITEMS))) == []
