import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom import queries as own

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = own.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    sql = con.execute(own.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=key)


@pytest.mark.parametrize("name", ["tokenize", "postings", "compressed_size", "skip_table", "match_nested", "bm25_nested_not", "batch_search", "clean_truncate", "tsv_fields", "doc_freq", "corpus_stats", "stored_report", "stored_postings", "stored_batch", "stored_search_nested", "stored_match_not",
    "service_results", "result_text", "workload_hits", "read_tsv_file", "write_read_tsv", "read_dump_file", "variable_bytes", "latencies", "syntax_errors", "clamped"])
def test_against_sql(spark, name):
    same(spark, name)


def test_every_query_has_sql():
    assert own.queries().keys() == own.oracle_sql().keys()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["docid", "score", "title", "url"]


def test_entry_without_optional_parts(tmp_path):
    """The entry imports, and has the engine's queries, where only the engine is there."""
    import shutil

    shutil.copytree(ROOT / "lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'topk' in e.oracle_sql(), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(own.queries())), "True", "False"]


def test_entry_where_a_package_is_missing(tmp_path):
    """Without a package that the training-data operators need, the engine's queries are all there."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), 'topk' in e.oracle_sql(), any(n.startswith('op1') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(own.queries())), "True", "False"]
