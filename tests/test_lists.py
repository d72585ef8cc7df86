"""The kernels that make postings, against words() text by text; and that no step does its work once for each term or posting."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexiloom import queries as own
from lexiloom import store
from lexiloom.functions import lists, sizes
from lexiloom.functions import text as X
from lexiloom.operators import encoding
from lexiloom.operators import index as I

SMALL = "/root/testdata/sf0.001"
ODD = ["Hello, WORLD! 42 e-mail", "end", "begin", "", None, "étre K İ ok", "a\rb\tc\nd a A", "x" * 5000, "--", "été9été", "word " * 400]


def texts():
    rng = random.Random(5)
    return ODD + [" ".join(rng.choice(["the", "The", "fox", "a", "zebra", "9"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]


def batches(rows, ids=None):
    table = pa.table({"doc_id": pa.array(ids or range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string())})
    return [b for a in range(0, len(rows), 7) for b in table.slice(a, 7).to_batches()]


def brute(rows, ids=None, only=None):
    out = {}
    for i, t in zip(ids or range(len(rows)), rows):
        ws = X.words(t or "")
        for p, w in enumerate(ws):
            if only is None or w in only:
                out.setdefault((w, i), ([], len(ws)))[0].append(p)
    coded = lambda ps: sum(len(sizes.encode(p - q)) for p, q in zip(ps, [0, *ps]))
    return sorted((w, i, len(ps), ps, n, coded(ps)) for (w, i), (ps, n) in out.items())


@pytest.mark.parametrize("chunk", [1, 64, 1 << 20])
@pytest.mark.parametrize("only", [None, ["the", "42", "zzz"], []])
def test_postings_of_a_batch(monkeypatch, chunk, only):
    monkeypatch.setattr(lists, "CHUNK", chunk)
    monkeypatch.setattr(lists, "ROWS", 5)
    got = sorted(tuple(r.values()) for b in lists.poster(only)(iter(batches(texts()))) for r in b.to_pylist())
    assert got == brute(texts(), only=only)
    lengths = [n for b in batches(texts()) for n in lists.lengths(b.column(1))]
    assert lengths == [len(X.words(t or "")) for t in texts()]


@pytest.mark.parametrize("held", [1, 200, 1 << 21])
def test_lists_and_back(monkeypatch, held):
    """Documents in any order, gathered by piece and block; each term's come out in order."""
    monkeypatch.setattr(lists, "HELD", held)
    monkeypatch.setattr(lists, "CHUNK", 500)
    ids = random.Random(2).sample(range(-40, 1000), len(texts()))
    rows = [r for b in lists.packer(16, True)(iter(batches(texts(), ids))) for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["term"], r["block"]))
    table = pa.Table.from_pylist([r | {"bucket": 3} for r in rows], pa.schema([("term", pa.string()), ("block", pa.int64()), ("listed", pa.binary()), ("places", pa.binary()), ("bucket", pa.int32())]))
    got = [tuple(r.values()) for b in lists.unpacker(16)(iter(table.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    assert got == [(*r, 3) for r in brute(texts(), ids)]


def test_encoded_sizes():
    values = np.array([-5, 0, 127, 128, 16383, 16384, 1 << 40])
    assert lists.encoded_size(values).tolist() == [1, *(len(sizes.encode(int(v))) for v in values[1:])]


def test_a_group_in_two_tasks_is_an_error():
    with pytest.raises(RuntimeError):
        lists.Groups(pa.record_batch({"t": ["a"], "b": [0], "l": pa.array([np.zeros(3, np.int32).tobytes()])}), np.ones(1, bool), 8).check(np.array([2]))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_sizes_cut_the_texts_once(spark):
    """The lists are made and shuffled once for both passes, and no window goes over postings."""
    docs = [(i, "", "", "common word body" + (" rare" if i % 7 == 0 else "")) for i in range(60)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, title string, url string, text string")
    plan = final_plan(encoding.term_sizes(I.packed(corpus)))
    assert plan.count("regexp_extract_all") == 0 and plan.count("ReusedExchange") >= 2, plan


def test_set_algebra_cuts_the_texts_once(spark):
    plan = final_plan(own.queries()["set_nested"](spark, SMALL))
    assert "MapInArrow" not in plan and "regexp_extract_all" not in plan


def test_postings_are_not_sorted_again_to_be_written(spark, tmp_path, monkeypatch):
    """Rows come by bucket; the setting that saves their sort is put back, and files hold their terms in order."""
    asked = []
    inner = store._placed
    monkeypatch.setattr(store, "_placed", lambda *a: asked.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) or inner(*a))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    docs = [(i, "", "", f"common w{i % 9} w{i % 5}") for i in range(50)]
    store.build_index(spark.createDataFrame(docs, "doc_id bigint, title string, url string, text string"), str(tmp_path))
    assert asked == [str(store.OPEN_FILES)] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    files = list((tmp_path / "postings").rglob("*.parquet"))
    for f in files:
        keys = [(r["term"], r["doc_id"]) for r in pq.ParquetFile(f).read(columns=["term", "doc_id"]).to_pylist()]
        assert keys == sorted(keys) and keys
    assert files
