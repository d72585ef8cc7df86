import random

import pytest
from pyspark.sql import functions as F

from lexiloom import binding
from lexiloom import engine as engine_module
from lexiloom import store as store_module
from lexiloom.engine import SearchEngine
from lexiloom.operators import index as I
from lexiloom.operators import retrieval
from lexiloom.plans.query import QuerySyntaxError, all_terms, parse
from lexiloom.service import api_search, clamped_k
from lexiloom.store import BadIndex, build_index, find_term
from lexiloom.workload import latency_summary, run_at_once, run_serially
from tests.brute import Corpus

ANIMALS = [
    (0, "Cats", "http://x/cat", "the quick brown fox jumps"),
    (1, "Dogs", "http://x/dog", "the lazy dog sleeps all day"),
    (2, "Foxes", "http://x/fox", "a quick brown fox and a quick hare"),
    (3, "Weather", "http://x/wx", "the brown storm rolls in today"),
]
SCHEMA = "doc_id bigint, title string, url string, text string"
GOLDEN = {
    "fox": [(0, 0.745747), (2, 0.630853)],
    "brown AND fox": [(0, 1.129488), (2, 0.955473)],
    "brown fox": [(0, 1.129488), (2, 0.955473)],
    "dog OR storm": [(1, 1.2212), (3, 1.2212)],
    "brown AND NOT fox": [(3, 0.361778)],
    '"quick brown"': [(2, 1.217108), (0, 1.129488)],
    '"quick brown': [(2, 1.217108), (0, 1.129488)],
    '"brown quick"': [],
    "nonexistentterm": [],
    "e-mail": [],
    'fox ""': [],
    '"cats the"': [(0, 1.679078)],
    "NOT fox": [(1, 0.0), (3, 0.0)],
    "NOT NOT fox": [(0, 0.745747), (2, 0.630853)],
    "fox fox": [(0, 0.745747), (2, 0.630853)],
    'fox OR ""': [(0, 0.745747), (2, 0.630853)],
    "NOT (brown AND NOT fox)": [(0, 0.745747), (2, 0.630853), (1, 0.0)],
    'NOT ""': [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)],
    "cats OR dogs AND lazy": [(1, 2.4424), (0, 1.295337)],
    "(cats OR dogs) AND lazy": [(1, 2.4424)],
    '"and"': [(2, 1.09577)],
    "quick": [(2, 0.892488), (0, 0.745747)],
    "the brown OR hare": [(2, 1.42039), (0, 0.767483), (3, 0.723557)],
    "!!!": [],
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ANIMALS, SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "animals")
    report = build_index(corpus, folder, buckets=3)
    return SearchEngine.open(spark, folder), report, folder


def hits(df):
    return [(r["docid"], round(r["score"], 6)) for r in df.collect()]


def test_build_report(stored):
    report = {k: v for k, v in stored[1].items() if k != "build_seconds"}
    assert report == {"num_docs": 4, "num_terms": 21, "total_tokens": 29, "postings_bytes": 104, "naive_bytes": 332}
    assert stored[0].num_docs() == 4 and stored[0].index.avg_doc_len() == 7.25
    assert find_term(stored[0].index, "the") == 3 and find_term(stored[0].index, "zzz") is None


@pytest.mark.parametrize("query", GOLDEN)
def test_golden_stored(stored, query):
    assert hits(stored[0].search(query)) == GOLDEN[query]


def test_golden_on_the_fly_and_at_once(corpus):
    engine = SearchEngine.of(corpus)
    rows = engine.search_all(list(GOLDEN)).collect()
    for i, (query, want) in enumerate(GOLDEN.items()):
        assert [(r["docid"], round(r["score"], 6)) for r in rows if r["qid"] == i] == want, query
    assert hits(engine.search("fox")) == GOLDEN["fox"]


def test_titles_k_and_errors(stored):
    engine = stored[0]
    assert [tuple(r)[2:] for r in engine.search("dog OR storm", 1).collect()] == [("Dogs", "http://x/dog")]
    assert engine.search("fox", 0).collect() == []
    with pytest.raises(QuerySyntaxError):
        engine.search("(quick AND brown")


def test_ranking_parameters(corpus):
    docs = {i: f"{t} {x}" for i, t, _, x in ANIMALS}
    got = hits(SearchEngine.of(corpus, k1=2.0, b=0.1).search("quick OR the"))
    assert got == [(i, round(s, 6)) for i, s in Corpus(docs).search("quick OR the", 10, 2.0, 0.1)]


def test_service(stored):
    answer = api_search(stored[0], "  fox ", "2")
    assert (answer["query"], answer["count"], answer["error"]) == ("fox", 2, None)
    assert api_search(stored[0], " ", 5)["results"] == []
    assert api_search(stored[0], "(fox", 5)["error"] == "unbalanced parentheses"
    assert [clamped_k(x) for x in (None, "x", "0", 99, 7)] == [10, 10, 1, 50, 7]


def test_scan_reads_what_a_query_needs(stored):
    plan = stored[0].scores("quick AND fox")._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "bucket" in plan
    assert "positions" in stored[0].scores('"quick brown"')._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_are_an_error(spark, tmp_path):
    twice = spark.createDataFrame([(1, "", "", "quick brown"), (1, "", "", "quick brown"), (2, "", "", "fox")], SCHEMA)
    with pytest.raises(I.DuplicateId, match="doc_id 1"):
        SearchEngine.of(twice)
    with pytest.raises(I.DuplicateId):
        build_index(twice, str(tmp_path))


def test_titles_are_looked_up_by_id(stored, monkeypatch):
    """The docs table is asked for the ids of the results alone; more results than GATHERED are joined instead, with the same rows."""
    index = stored[0].index
    plan = index.docs.where(F.col("doc_id").isin([1, 3])).select("doc_id", "title", "url")._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id, [1,3])" in plan
    want = [tuple(r) for r in stored[0].search("NOT fox OR quick", 10).collect()]
    many = [tuple(r) for r in stored[0].search_all(["fox", "NOT fox", "fox", ""], 10).collect()]
    monkeypatch.setattr(engine_module, "GATHERED", 1)
    assert [tuple(r) for r in stored[0].search("NOT fox OR quick", 10).collect()] == want and len(want) == 4
    assert [tuple(r) for r in stored[0].search_all(["fox", "NOT fox", "fox", ""], 10).collect()] == many and [r[0] for r in many] == [0, 0, 1, 1, 2, 2]


def test_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Terms with more tokens than a file holds are spread by blocks of documents; sizes and results are the same."""
    docs = [(i, "", "", "common word " + " ".join(f"t{(i * k) % 97}" for k in range(1, 6))) for i in range(400)]
    corpus = spark.createDataFrame(docs, SCHEMA)
    report = build_index(corpus, str(tmp_path / "one"), buckets=2)
    want = hits(SearchEngine.open(spark, str(tmp_path / "one")).search("t5 AND common OR t7", 30))
    monkeypatch.setattr(store_module, "FILE_TOKENS", 150)
    monkeypatch.setattr(I, "BLOCK", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small files are written as one
    try:
        again = build_index(corpus, str(tmp_path / "many"), buckets=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: v for k, v in again.items() if k != "build_seconds"} == {k: v for k, v in report.items() if k != "build_seconds"}
    engine = SearchEngine.open(spark, str(tmp_path / "many"))
    assert hits(engine.search("t5 AND common OR t7", 30)) == want and len(want) == 30
    files = engine.index.postings.where("term = 'common'").select(F.input_file_name()).distinct().count()
    assert files > 1 and engine.index.postings.where("term = 't5'").select(F.input_file_name()).distinct().count() == 1


def test_binding(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("".join(f"{t}\t{u}\t{x}\n" for _, t, u, x in ANIMALS))
    report = binding.build_index(str(path), str(tmp_path / "index"), spark)
    engine = binding.Engine(str(tmp_path / "index"), spark)
    assert report["num_docs"] == engine.num_docs() == 4 and report["build_seconds"] > 0
    assert [(r["docid"], r["title"], round(r["score"], 6)) for r in engine.search("fox", 1)] == [(0, "Cats", 0.745747)]


def test_no_index(spark, stored, tmp_path):
    spark.createDataFrame([(99,)], "format_version int").write.parquet(str(tmp_path / "stats"))
    with pytest.raises(BadIndex):
        SearchEngine.open(spark, str(tmp_path))
    with pytest.raises(BadIndex):
        SearchEngine.open(spark, str(tmp_path / "nothing"))


def test_long_lists(spark, tmp_path):
    docs = [(i, f"doc{i}", f"http://x/{i}", "common word body" + (" rare" if i % 50 == 0 else "")) for i in range(500)]
    report = build_index(spark.createDataFrame(docs, SCHEMA), str(tmp_path))
    assert (report["num_terms"], report["total_tokens"], report["postings_bytes"], report["naive_bytes"]) == (504, 2010, 7152, 24120)
    assert hits(SearchEngine.open(spark, str(tmp_path)).search("common AND rare", 100)) == [(i, 3.515621) for i in range(0, 500, 50)]


def test_sizes_do_not_depend_on_blocks(spark, monkeypatch):
    from lexiloom.operators import encoding

    docs = [(3 * i, "", "", "common word body" + (" rare" if i % 7 == 0 else "")) for i in range(300)]
    posted = I.postings(spark.createDataFrame(docs, SCHEMA))
    want = sorted(map(tuple, encoding.term_sizes(posted).collect())), sorted(map(tuple, encoding.skip_table(posted).collect()))
    monkeypatch.setattr(I, "BLOCK", 64)
    got = sorted(map(tuple, encoding.term_sizes(posted).collect())), sorted(map(tuple, encoding.skip_table(posted).collect()))
    assert got == want


def random_query(rng, depth=3):
    word = lambda: rng.choice(["a", "b", "c", "d", "e", "zz"])
    kind = rng.choice(["term", "term", "phrase", "and", "or", "not"]) if depth else "term"
    if kind == "term":
        return word()
    if kind == "phrase":
        return '"' + " ".join(word() for _ in range(rng.randint(0, 3))) + '"'
    if kind == "not":
        return f"NOT ({random_query(rng, depth - 1)})"
    return f"({random_query(rng, depth - 1)} {kind} {random_query(rng, depth - 1)})"


def test_random_queries(spark):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice("aabbbcde") for _ in range(rng.randint(0, 12))) for i in range(60)}
    corpus = spark.createDataFrame([(i, "", "", t) for i, t in docs.items()], SCHEMA)
    model, engine = Corpus(docs), SearchEngine.of(corpus.cache())
    queries = [random_query(rng) for _ in range(40)]
    rows = engine.search_all(queries, 100).collect()
    for i, query in enumerate(queries):
        got = sorted((r["docid"], round(r["score"], 9)) for r in rows if r["qid"] == i)
        assert got == sorted((d, round(s, 9)) for d, s in model.search(query, 100)), query
    for query in queries[:4]:
        tree = parse(query)
        found = retrieval.evaluate(tree, I.postings(corpus, all_terms(tree)), corpus)
        assert sorted(r[0] for r in found.collect()) == sorted(model.match(tree)) == sorted(r[0] for r in engine.match(query).collect())


def test_empty_corpus(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert hits(SearchEngine.of(empty).search("a OR NOT b")) == []
    report = build_index(empty, str(tmp_path))
    assert report["num_docs"] == 0 and report["postings_bytes"] == 0
    assert hits(SearchEngine.open(spark, str(tmp_path)).search("a")) == []


def test_any_table_as_corpus(spark):
    rows = spark.createDataFrame([(1, None, 5), (None, "x", 6), (2, "Fox", 7)], "doc_id int, text string, title int")
    got = I.as_corpus(rows, title="title").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "5", "", ""), (2, "7", "", "Fox")]


def test_latency_summary():
    got = latency_summary([4.0, 1.0, 3.0, 2.0], 20.0)
    assert got == {"mean_ms": 2.5, "p50_ms": 3.0, "p95_ms": 4.0, "qps": 200.0}


def test_workload(stored):
    assert run_serially(stored[0], ["fox", "dog"])["hits"] == run_at_once(stored[0], ["fox", "dog"])["hits"] == 3


def test_stats_table(spark, corpus):
    row = I.corpus_stats(I.docs(corpus), I.dictionary(I.postings(corpus))).first()
    assert tuple(row) == (4, 21, 29, 7.25)
    assert I.token_positions(corpus).where(F.col("term") == "quick").count() == 3
