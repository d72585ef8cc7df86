import random

import numpy as np
import pytest

import corpus_pipeline
from lexiloom.llm import mixing, toxicity
from tests.llm import test_decontam, test_linededup, test_minhash
from tests.llm.cases import changed, documents, prose, rows

LABELS = "doc_id bigint, quality int, toxic int"
ITEMS = "item_id bigint, text string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(16)
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rng, 25)) for i in range(4)]
    passage = "\n".join(prose(rng, 9) for _ in range(7))
    docs, labels, i = [], [], 0
    for k in range(160):
        text = "\n".join(prose(rng, rng.randrange(8, 16)) for _ in range(6))
        good = k % 3 != 0
        text += " essay clear essay" if good else " BUY NOW !!! BUY"
        toxic = k % 5 == 0
        if toxic:
            text = f"vileword {text} grubfoul nastling vileword"
        if k % 7 == 1:
            text += "\n" + passage
        if k % 11 == 1:
            text += "\n" + items[k % 4][1]
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
        i += 1
        if k % 9 == 2:
            docs.append((i, changed(rng, text, 0.01)))
            i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, docs[3][1])]
    documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def brute(spark, folder, docs, items):
    """The stages one after the other on Python lists; the trained models alone are shared."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    c = toxicity.fit(read("documents"), read("labels"))
    cut = c.by_language.get("en", c.overall)
    kept = [(i, t) for i, t in docs if t is None or round(float(toxicity.score(c.model, [t])[0]), 6) <= cut]
    removed = test_linededup.brute(kept)
    kept = [(i, t) for i, t, n in removed if t is None or n == 0 or t.replace("\n", "").strip(" ")]
    gone = {i for i, _, keep in test_minhash.brute([(i, t) for i, t in kept if t]) if not keep}
    there, least = {i for i, t in kept if t}, {}
    for i, root, _ in test_minhash.brute([(i, t) for i, t in docs if t]):
        if i in there and least.setdefault(root, i) != i:
            gone.add(i)
    kept = [(i, t) for i, t in kept if i not in gone]
    held = {d for d, *_ in test_decontam.brute([(i, t) for i, t in kept if t], items)}
    kept = [(i, t) for i, t in kept if i not in held]
    names, model = mixing.fit(documents(spark, kept), read("labels"), domains=tuple(corpus_pipeline.TARGETS))
    both = [mixing.posteriors(model, [t or ""]) for _, t in kept]
    n, p = np.array([float(a[0]) for a, _ in both]), np.round(np.concatenate([b for _, b in both]), 6)
    targets = np.array([corpus_pipeline.TARGETS[d] for d in names])
    rate = brute_rates(n, p, targets / targets.sum())
    return [(i, t, r) for (i, t), r in zip(kept, rate)]


def brute_rates(n, p, targets):
    from tests.llm.test_mixing import brute

    return brute(n, p, targets)


def test_against_brute_force(spark, tables):
    folder, docs, items = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate"]
    got = sorted((r["doc_id"], r["text"], r["rate"]) for r in out.collect() if r["text"] is not None)
    want = sorted(x for x in brute(spark, folder, docs, items) if x[1] is not None)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 0.02
    assert 50 < len(got) < len(docs) - 30


def test_stages_keep_columns_and_clean_rows(spark, tables):
    folder = tables[0]
    data = [(1, None), (2, ""), (None, "clean words"), (3, "clean other words here"), (3, "clean other words here")]
    docs = documents(spark, data, clash=True)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        assert kept.columns[: len(docs.columns)] == docs.columns
        assert (kept.columns == docs.columns) == (name != "mixing")
        if name != "mixing":
            assert rows(kept.select("doc_id", "text")) == rows(docs.select("doc_id", "text")), name
        assert rows(stage(spark, docs.limit(0), folder)) == []
