import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import lm_score as M
from lexiloom.llm import textkernel as K
from tests.llm.cases import documents, rows


def patterned(rng, n):
    """Text in which a word tells much about the next."""
    out, at = [], rng.randrange(40)
    for _ in range(n):
        out.append(f"w{at}")
        at = (at * 3 + rng.choice([1, 2])) % 40 if rng.random() < 0.9 else rng.randrange(40)
    return " ".join(out)


def test_held_out_perplexity_beats_the_unigram_model(spark):
    rng = random.Random(10)
    train = documents(spark, [(i, patterned(rng, 400)) for i in range(400)])
    words, _ = M.vocabulary(train.select("text"))
    model = M.fit(train.select("text"), words)
    tokens = K.tokenize([patterned(rng, 3000)])
    ids, _ = words.find(tokens.hashes, tokens.ends - tokens.starts)
    each = M.log_probs(model, ids, M.contexts(ids, tokens.offsets, len(words.share)))
    assert math.exp(-each.mean()) < 0.6 * math.exp(-np.log(words.share[ids]).mean())


def test_only_words_that_may_be_of_the_head_are_sorted_in_one_task(spark):
    """The head is that of all words, ties included; the bulk of rarer ones never gets to its sort."""
    data = [(h * 7919 % 100_003, 0, 2 + (h % 5 == 0) + 40 * (h < 300)) for h in range(9000)]
    counts = spark.createDataFrame(data, "h bigint, c int, n bigint").repartition(8)
    for head in (200, 300, 900, 20_000):
        some = M._frequent(counts, head)
        assert [r["h"] for r in some.orderBy(F.desc("n"), "h").limit(head).collect()] == [h for h, _, _ in sorted(data, key=lambda r: (-r[2], r[0]))[:head]]
        assert some.count() == {200: 300, 300: 300, 900: 2040}.get(head, 9000)
    assert M._frequent(counts.limit(0), 5).count() == 0


def test_probabilities_are_normalised():
    share = np.full(20, 0.05)
    words = M.Words(np.arange(1, 20, dtype=np.uint64), np.arange(1, 20), share)
    model = M.start(words, seed=3)
    before = np.array([[3, 20], [7, 1]])
    for b in before:
        total = np.exp(M.log_probs(model, np.arange(20), np.tile(b, (20, 1)))).sum()
        assert abs(total - 1) < 1e-5
    s = np.exp((model.inner[3] * model.scale[0] + model.inner[20] * model.scale[1]) @ model.outer.T + model.bias)
    assert np.allclose(M.log_probs(model, np.array([5]), before[:1]), np.log(s[5] / s.sum()), atol=1e-5)


@pytest.mark.parametrize("size", [1.0, 60.0])
def test_each_context_is_summed_once_by_a_worker(size, monkeypatch):
    """With the largest number of symbols too; sums are exact whether the exponentials need a shift or not."""
    n = M.SYMBOLS[1] + M.CLASSES + 20
    rng = np.random.default_rng(8)
    model = M.Model(*(rng.normal(0, 0.3, x).astype(np.float32) for x in ((n + 1, M.DIM), (M.CONTEXT, M.DIM), (n, M.DIM), (n,))))
    model = model._replace(outer=model.outer * np.float32(size), bias=model.bias * np.float32(size))
    norms, done = M.Norms(model), []
    plain = norms.computed
    monkeypatch.setattr(norms, "computed", lambda keys: done.append(len(keys)) or plain(keys))
    ids, before = rng.integers(0, n, 300), rng.integers(0, 15, (300, M.CONTEXT))
    got = [M.log_probs(model, ids, before, norms) for _ in range(2)]
    assert done[0] == len(np.unique(before, axis=0)) and sum(done[1:]) == 0 and (got[0] == got[1]).all()
    q = sum(model.inner[before[:, d]].astype(float) * model.scale[d] for d in range(M.CONTEXT))
    z = q @ model.outer.astype(float).T + model.bias
    want = z[np.arange(300), ids] - np.log(np.exp(z - z.max(1)[:, None]).sum(1)) - z.max(1)
    assert np.abs(got[0] - want).max() < 1e-5 * max(1, np.abs(z).max())
    monkeypatch.setattr(M, "TABLE", 0)
    assert np.abs(M.log_probs(model, ids, before) - want).max() < 1e-5 * max(1, np.abs(z).max())


def test_a_minibatch_leaves_rows_alone_that_it_does_not_meet():
    words = M.Words(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.array([0.5, 0.5, *[0.0] * 98]))
    trainer = M.Trainer(M.start(words._replace(share=np.full(100, 0.01))), words.share + 1e-6)
    old = [p.copy() for p in trainer.parts]
    trainer.feed(np.array([7, 7, 9]), np.array([[3, 4], [3, 100], [7, 3]]))
    moved = [set(np.flatnonzero((p != o).reshape(len(p), -1).any(1)).tolist()) for p, o in zip(trainer.parts, old)]
    assert moved == [{3, 4, 7, 100}, {0, 1}, {0, 1, 7, 9}, {0, 1, 7, 9}] and not trainer.seen.any()


def test_vocabulary_counts_everything(spark):
    data = [(i, f"common rare{i} common") for i in range(30)] + [(98, "again again"), (99, None)]
    words, tail = M.vocabulary(documents(spark, data), size=5)
    assert len(words.hashes) == 2 and words.ids[words.hashes == K.tokenize(["common"]).hashes[0]].tolist() == [M.CLASSES]
    assert sum(tail.mass) == sum(tail.single) == 30 and tail.mass[1] == 30 and tail.counts.count() == 0
    assert abs(words.share[M.CLASSES] - 61 / (92 + len(words.share))) < 1e-9 and abs(words.share.sum() - 1) < 1e-9
    words, tail = M.vocabulary(documents(spark, data), head=1)
    assert len(words.hashes) == 1 and sum(tail.mass) == 32 and sum(tail.single) == 30 and [tuple(r)[1] for r in tail.counts.collect()] == [2]


def test_gathering_grows_with_the_corpus():
    """Every word is a target: as many training steps as the text has minibatches."""
    words = M.Words(np.array([7], np.uint64), np.array([1]), np.array([0.5, 0.5]))
    trainer = M.Trainer(M.start(words), words.share)
    ids = np.zeros(10_000, np.int64)
    trainer.feed(ids, M.contexts(ids, np.array([0, 10_000]), 2))
    assert trainer.words == 10_000


def test_defined_cases(spark):
    long = patterned(random.Random(1), 250_000)
    data = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "..."), (None, "a b"), (5, long)]
    got = rows(M.lm_scores(documents(spark, data, clash=True)))
    by = {r[0]: r for r in got}
    assert len(got) == 7 and got[0] == got[1] and by[1][1] == 3
    assert by[2][1:] == by[3][1:] == by[4][1:] == (0, 0, 0.0, None)
    assert by[None][1] == 2 and by[5][1] == 250_000 and by[5][3] < 0
    assert abs(by[1][4] - math.exp(-by[1][3] / 3)) < 0.01
    assert rows(M.lm_scores(documents(spark, []))) == []
    assert rows(M.lm_scores(documents(spark, [(1, None)]))) == [(1, 0, 0, 0.0, None)]


def brute(docs, words, tail, model, spelling):
    """Scores word by word, from counts in a dict and one softmax for each word."""
    lists = [K.tokenize([t or ""]) for _, t in docs]
    names = [[t[a:b].lower() for a, b in zip(x.starts, x.ends)] for x, (_, t) in zip(lists, docs)]
    counts = Counter(w for own in names for w in own)
    number = {w: K.tokenize([w]).hashes[0] for w in counts}
    known = dict(zip(words.hashes.tolist(), words.ids.tolist()))
    ident = {w: known.get(int(h), sum(len(w) > x for x in M.LENGTHS.tolist())) for w, h in number.items()}
    mass = Counter()
    for w, n in counts.items():
        mass[ident[w]] += n
    single = Counter(ident[w] for w, n in counts.items() if n < M.LEAST)
    out = []
    for (i, _), own in zip(docs, names):
        total, unknown, past = 0.0, 0, [len(words.share)] * M.CONTEXT
        for w in own:
            q = sum(model.inner[p].astype(float) * model.scale[d] for d, p in enumerate(past))
            z = model.outer.astype(float) @ q + model.bias
            total += z[ident[w]] - np.log(np.exp(z - z.max()).sum()) - z.max()
            if counts[w] >= M.LEAST:
                total += math.log(counts[w] / mass[ident[w]])
            else:
                cps = np.array([ord(c) for c in w], np.uint32)
                total += math.log(single[ident[w]] / mass[ident[w]]) + M.spelled(spelling, *M.letter_pairs(cps, np.array([0]), np.array([len(w)])))[0]
                unknown += 1
            past = [ident[w], *past][: M.CONTEXT]
        out.append((i, len(own), unknown, total))
    return out


@pytest.mark.parametrize("head", [M.HEAD, 30])
def test_against_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(M, "SYMBOLS", (12, 12))
    rng = random.Random(12)
    data = [(i, " ".join(rng.choice([f"w{rng.randrange(25)}", f"word{int(rng.random() ** 3 * 400)}", f"singular{i}{j}"]) for j in range(rng.randrange(60)))) for i in range(60)]
    data += [(100, None), (101, "Été and straße")]
    df = documents(spark, data).select("doc_id", "text").repartition(3, "doc_id")
    words, tail = M.vocabulary(df, head=head)
    model, spelling = M.fitted(df, words)
    got = rows(M._scored(df, words, tail, model, spelling))
    for g, w in zip(got, sorted(brute(data, words, tail, model, spelling))):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 2e-3 * max(1, g[1]), (g, w)
        assert g[4] is None if not g[1] else abs(g[4] / math.exp(-w[3] / w[1]) - 1) < 0.01
    assert sum(g[2] for g in got) > 100 and (tail.counts.count() > 100) == (head == 30)


def test_words_beyond_the_symbols_differ_by_count_and_letters(spark):
    rare = [(100 + i, f"rare{1000 + i}") for i in range(4000)]
    junk = [(9000 + i, f"jqxz{1000 + i}") for i in range(40)]
    got = rows(M.lm_scores(documents(spark, [*rare, *junk, *((1, "alpha"),) * 200])))
    spelt = {name: [r[3] for r in got if r[2] and r[0] in ids] for name, ids in (("rare", {i for i, _ in rare}), ("junk", {i for i, _ in junk}))}
    assert len(spelt["junk"]) == 40 and max(spelt["junk"]) < np.median(spelt["rare"]) and got[0][2] == 0 and got[0][3] > max(spelt["rare"])


def test_junk_scores_worse_than_text(spark):
    """Random consonants among the documents of the smallest given table are less probable than nearly all of them."""
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(4, 9))) for _ in range(300))
    got = M.lm_scores(docs.union(spark.createDataFrame([(-1, junk)], "doc_id bigint, text string"))).where("tokens > 20").toPandas()
    assert got[got.doc_id == -1].perplexity.iloc[0] > got.perplexity.quantile(0.95)


def test_spelling_is_normalised():
    """What may follow a letter has probability 1 in all."""
    folded = np.array([1, 2, 2, 1], np.uint32)
    pairs, firsts = M.letter_pairs(folded, np.array([0, 2]), np.array([2, 4]))
    assert firsts.tolist() == [0, 3] and [(p >> M.SHIFT, p & ((1 << M.SHIFT) - 1)) for p in pairs.tolist()] == [(0, 1), (1, 2), (2, 0), (0, 2), (2, 1), (1, 0)]
    model = M.letters(*np.unique(pairs, return_counts=True))
    after = np.array([(1 << M.SHIFT) | b for b in range(1 << M.SHIFT)])
    assert abs(np.exp(M.spelled(model, after, np.arange(len(after)))).sum() - 1) < 1e-9


def test_what_is_gathered_grows_with_the_corpus_and_the_head_does_not(spark):
    small, large = ([(i, f"a{i} a{i}") for i in range(n)] for n in (2000, 6000))
    found = [M.vocabulary(documents(spark, d).select("text"), head=1500) for d in (small, large)]
    assert [(len(w.hashes), t.counts.count()) for w, t in found] == [(1500, 500), (1500, 4500)]
