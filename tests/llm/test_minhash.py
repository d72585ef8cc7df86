import random

import numpy as np
import pytest

from lexiloom.llm import minhash as M
from lexiloom.llm import textkernel as K
from tests.llm.cases import changed, documents, prose, rows


def shingles(text, k=3):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, threshold=M.THRESHOLD):
    """Least id of each document's group, over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i, _ in docs}
    ids = sorted(root)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                a, b = root[x], root[y]
                for i in ids:
                    if root[i] in (a, b):
                        root[i] = min(a, b)
    sizes = {r: sum(1 for v in root.values() if v == r) for r in root.values()}
    return sorted((i, r, i == r) for i, r in root.items() if sizes[r] > 1)


@pytest.fixture(scope="module")
def family():
    rng = random.Random(1)
    docs, i = [], 0
    for g in range(25):
        base = prose(rng, rng.choice([3, 10, 60, 300]))
        docs.append((i, base))
        i += 1
        for _ in range(g % 5):
            docs.append((i, rng.choice([base, base.upper().replace(" ", "\n"), changed(rng, base, 0.02)])))
            i += 1
    rng.shuffle(docs)
    return docs


def test_signatures_are_shifts_of_one_permutation():
    values = np.array([5, 77, 12345, 9, 1 << 41], np.uint64)
    got = M.signatures(values, np.array([0, 3, 3, 5]), 10)
    for d, part in ((0, values[:3]), (2, values[3:])):
        at = M.sigma(part).tolist()
        assert got[d].tolist() == [min(int(M.pi(np.array([(a + k) % 2**32], np.uint32))[0]) for a in at) for k in range(10)]
    assert (got[1] == 0xFFFFFFFF).all()


def test_permutations_are_bijective_and_estimate_jaccard():
    x = np.concatenate([np.arange(1 << 20), np.arange(1 << 20) * 4093]).astype(np.uint32)
    assert len(np.unique(M.pi(x.copy()))) == len(np.unique(x))
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.2, 0.5, 0.9):
        for n in (20, 2000):
            for _ in range(20):
                pool = rng.integers(0, 2**63, 3 * n).astype(np.uint64)
                both, a, b = pool[: int(n * share)], pool[n : 2 * n], pool[2 * n :]
                one, two = (np.concatenate([both, p[: n - len(both)]]) for p in (a, b))
                s = M.signatures(np.concatenate([one, two]), np.array([0, n, 2 * n]), 400)
                errors.append((s[0] == s[1]).mean() - len(both) / (2 * n - len(both)))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.15


def test_against_all_pairs(spark, family):
    got = rows(M.near_duplicate_groups(documents(spark, family)))
    want = brute(family)
    # Everything found is right; a pair just above the threshold may be missed by the bands.
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert {g[0] for g in got} <= {w[0] for w in want}


def test_large_components_go_by_joins_with_the_same_result(spark, family):
    df = documents(spark, family)
    want = rows(M.near_duplicate_groups(df))
    assert rows(M.near_duplicate_groups(df, local_shingles=1)) == rows(M.near_duplicate_groups(df, local_documents=2)) == want


def test_a_hot_band_of_two_tight_groups_and_strangers(spark):
    """With one band of one row many documents share it; joins and search give the same groups as all pairs."""
    rng = random.Random(9)
    bases = [prose(rng, 80), prose(rng, 80)]
    data = [(i, changed(rng, bases[i % 2], 0.03) if i % 5 else prose(rng, 5) + " " + bases[0][:60]) for i in range(120)]
    df = documents(spark, data)
    want = brute(data)
    for local in (1, M.LOCAL_SHINGLES):
        assert rows(M.near_duplicate_groups(df, bands=60, rows=1, local_shingles=local)) == want


def test_defined_cases(spark):
    long = prose(random.Random(2), 300_000, 10**6)
    data = [
        (1, "same words here"), (2, "Same, words: here!"), (2, "Same, words: here!"), (3, None), (4, None), (5, ""), (6, "..."), (None, "same words here"),
        (7, "one"), (8, "ONE"), (9, "two"), (10, long), (11, long + " end"), (12, "other"), (12, "other"),
    ]
    df = documents(spark, data, clash=True)
    assert rows(M.near_duplicate_groups(df)) == [(1, 1, True), (2, 1, False), (7, 7, True), (8, 7, False), (10, 10, True), (11, 10, False)]
    kept = M.near_dedup(df)
    assert kept.columns == df.columns
    assert [r[0] for r in rows(kept.select("doc_id"))] == [1, 3, 4, 5, 6, 7, 9, 10, 12, 12, None]


def test_copies_with_a_tenth_of_words_changed(spark):
    rng = random.Random(4)
    pairs = [(base := prose(rng, 200), changed(rng, base, 0.1)) for _ in range(150)]
    like = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    data = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r[0] for r in rows(M.near_duplicate_groups(documents(spark, data)))}
    wanted = [2 * i for i, s in enumerate(like) if 0.5 <= s < 0.7]
    assert len(wanted) > 60 and np.mean([i in got for i in wanted]) > 0.9
    assert not any(2 * i in got for i, s in enumerate(like) if s < 0.5)


def test_scraps_of_near_copies_go_with_what_they_were(spark):
    rng = random.Random(11)
    base, other = prose(rng, 200), prose(rng, 60)
    words = changed(rng, base, 0.05).split(" ")
    scrap = " ".join(words[60:110])
    before = documents(spark, [(1, base), (2, " ".join(words)), (3, base), (4, other), (5, base + " x")])
    now = [(1, base), (2, scrap), (4, other), (5, prose(rng, 50)), (None, scrap), (6, None), (7, "")]
    df = documents(spark, now, clash=True)
    assert [r[0] for r in rows(M.near_dedup(df).select("doc_id"))] == [1, 2, 4, 5, 6, 7, None]
    kept = M.near_dedup(df, before)
    # 5 has another text than before, so it stays; without 1 the scrap stays.
    assert kept.columns == df.columns and [r[0] for r in rows(kept.select("doc_id"))] == [1, 4, 5, 6, 7, None]
    assert [r[0] for r in rows(M.near_dedup(documents(spark, now[1:]), before).select("doc_id"))] == [2, 4, 5, 6, 7, None]


def test_rows_that_repeat_an_id_are_not_paired_with_each_other(spark, monkeypatch):
    """What goes to the workers grows with the rows, not with their square, and the decisions are those of any row."""
    rng, seen = random.Random(13), []
    base, n = prose(rng, 120), 150
    texts = [changed(rng, base, 0.03) for _ in range(n)]
    data = [(1, base), *((2, t) for t in texts), *((3, texts[0]) for _ in range(n)), (4, prose(rng, 50)), (5, base)]
    before = documents(spark, data)
    plain = M.arrow

    def counted(df, run, schema):
        seen.append(df.count())
        return plain(df, run, schema)

    monkeypatch.setattr(M, "arrow", counted)
    assert [r[0] for r in rows(M.near_dedup(before, before).select("doc_id"))] == [1, 4]
    assert max(seen) <= 2 * len(data)
    now = documents(spark, [(1, base), *((2, t.replace(" ", " y ")) for t in texts[:40]), (2, " ".join(texts[7].split(" ")[9:60]))])
    assert [r[0] for r in rows(M.near_dedup(now, before).select("doc_id"))] == [1]


def test_empty(spark):
    df = documents(spark, [])
    assert rows(M.near_duplicate_groups(df)) == [] and rows(M.near_dedup(df)) == []


def test_long_texts_hash_like_short_ones():
    text = prose(random.Random(3), 400_000)
    whole = K.tokenize([text])
    parts = np.concatenate([K.tokenize([w]).hashes for w in text.split(" ")[:50] + text.split(" ")[-50:]])
    assert len(whole.hashes) == 400_000
    assert (np.concatenate([whole.hashes[:50], whole.hashes[-50:]]) == parts).all()
