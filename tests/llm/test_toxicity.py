import random

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import toxicity as T
from tests.llm.cases import documents, prose, rows

LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["vileword", "grubfoul", "nastling"]


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 80)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ed"]))
        docs.append((i, " ".join(words), ("en", "de")[i % 2]))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(random.Random(11), 600)
    table = documents(spark, docs)
    got = {r["doc_id"]: r["toxic"] for r in T.toxicity_scores(table, spark.createDataFrame(labels[:300], LABELS)).collect()}
    right = [got[i] == bool(t) for i, _, t in labels[300:]]
    assert np.mean(right) > 0.95


def test_held_out_accuracy_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    scored = T.toxicity_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where(~held))
    n = {(r["toxic"], r["t"]): r["count"] for r in scored.join(labels.where(held).select("doc_id", F.col("toxic").alias("t")), "doc_id").groupBy("toxic", "t").count().collect()}
    hit, missed, wrong, clean = n.get((True, 1), 0), n.get((False, 1), 0), n.get((True, 0), 0), n.get((False, 0), 0)
    # About 200 toxic rows in four languages to learn from.
    assert hit / (hit + missed) > 0.8 and wrong / (wrong + clean) < 0.02


def test_threshold():
    s, y = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 1, 0])
    assert abs(T.threshold(s, y, np.ones(5)) - 0.15) < 1e-9 or abs(T.threshold(s, y, np.ones(5)) - 0.55) < 1e-9
    assert T.threshold(s, y, np.array([1, 1, 50, 1, 1])) == 0.55


def test_training_is_reproducible():
    docs, labels = corpus(random.Random(12), 80)
    y = np.array([t for _, _, t in labels], np.float32)
    a, b = (T.train([d[1] for d in docs], y, epochs=2) for _ in range(2))
    assert all((x == z).all() for x, z in zip(a.filters, b.filters)) and (a.words == b.words).all()


def test_defined_cases(spark):
    docs, labels = corpus(random.Random(13), 200)
    docs += [(900, None), (901, ""), (None, "vileword vileword grubfoul nastling " * 3), (902, "grubfouls vileword nastling " * 60_000), (0, docs[0][1], "en"), (903, "fine words", None)]
    table = documents(spark, docs, clash=True)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (4, 1, 0), (77777, 1, 1)], LABELS)
    got = rows(T.toxicity_scores(table, marks))
    by = {r[0]: r for r in got}
    assert len(got) == len(docs) and by[900][2:] == by[901][2:] == (0.0, False) and by[902][3] and by[None][3] and not by[903][3]
    assert got[0] == got[1]
    kept = T.drop_toxic(table, marks)
    assert kept.columns == table.columns
    assert sorted(map(str, (r[0] for r in kept.select("doc_id").collect()))) == sorted(str(r[0]) for r in got if not r[3])


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "vileword"), (2, "b")])
    for marks in ([], [(1, 1, 1)], [(5, 1, 0), (6, 1, 1)]):
        table = spark.createDataFrame(marks, LABELS)
        assert [r[2:] for r in rows(T.toxicity_scores(docs, table))] == [(0.0, False)] * 2
        assert T.drop_toxic(docs, table).count() == 2
    assert rows(T.toxicity_scores(documents(spark, []), spark.createDataFrame([(1, 1, 1)], LABELS))) == []


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    """A rare language has few rows in the bounded sample, yet enough labelled ones for a threshold of its own."""
    rng = random.Random(14)
    docs, labels = corpus(rng, 900)
    docs = [(i, t, "rare" if i % 9 in (0, 1) else lang) for i, t, lang in docs]
    seen = []
    monkeypatch.setattr(T, "_thresholds", lambda counts, totals, least, run=T._thresholds: seen.append((counts, totals)) or run(counts, totals, least))
    c = T.fit(documents(spark, docs), spark.createDataFrame(labels, LABELS), toxic_rows=60, clean_rows=120)
    assert "rare" in c.by_language
    counts, totals = seen[0]
    assert sum(r["n"] for r in counts) == 900 - 45 - 90 and totals == {1: 225, 0: 675}


def test_labels_without_documents_leave_the_sample_whole(spark):
    docs, labels = corpus(random.Random(15), 200)
    strays = [(i, 1, i % 2) for i in range(10_000, 14_000)]
    c = T.fit(documents(spark, docs), spark.createDataFrame(labels + strays, LABELS), toxic_rows=40, clean_rows=80)
    assert c.model is not None
    d = T.fit(documents(spark, docs), spark.createDataFrame(labels, LABELS), toxic_rows=40, clean_rows=80)
    assert (c.model.words == d.model.words).all() and c[1:] == d[1:]
