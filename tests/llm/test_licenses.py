import random

import duckdb
import pandas as pd
import pytest

from lexiloom.llm import licenses as L
from tests.llm.cases import documents, prose, rows


def sql(data):
    con = duckdb.connect()
    con.register("raw", pd.DataFrame([r[:2] for r in data], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM raw")
    found = con.execute(L.oracle())
    names = [d[0] for d in found.description]
    return sorted(tuple(r[names.index(n)] for n in ("doc_id", "license", "start", "stop", "cover")) for r in found.fetchall())


def test_against_sql(spark):
    rng = random.Random(9)
    data = []
    for i in range(120):
        text = prose(rng, rng.randrange(40))
        for _ in range(rng.randrange(3)):
            words = rng.choice(list(L.TEMPLATES.values())).split(" ")
            if rng.random() < 0.4:
                words.insert(rng.randrange(len(words)), "inserted")
            if rng.random() < 0.3:
                words = words[: rng.randrange(1, len(words) + 1)]
            text += " " + (" ".join(words).upper() if rng.random() < 0.3 else "\n".join(words)) + " " + prose(rng, rng.randrange(20))
        data.append((i, text))
    got = rows(L.license_spans(documents(spark, data)))
    assert got == sql(data) and len(got) > 60


def test_spans(spark):
    line = L.TEMPLATES["apache-2.0-line"]
    broken = L.TEMPLATES["isc-grant"].replace("copyright notice", "very copyright notice").replace("hereby ", "")
    data = [(1, f"two words {line} end"), (2, broken), (3, " ".join(reversed(line.split())))]
    got = {(r[0], r[1]): r for r in rows(L.license_spans(documents(spark, data)))}
    assert got[(1, "apache-2.0-line")][2:] == (2, 10, 1.0)
    assert (2, "isc-grant") in got and not any(k[0] == 3 for k in got)


def test_defined_cases(spark):
    line = L.TEMPLATES["mit-line"]
    far = prose(random.Random(1), 120_000)
    data = [(1, line), (1, line), (2, None), (3, ""), (4, "two words"), (None, line), (5, f"{far} {line}"), (6, f"{line} x y z a b c d {line}")]
    got = rows(L.license_spans(documents(spark, data, clash=True)).select("doc_id", "license", "start"))
    assert got == [(1, "mit-line", 0), (5, "mit-line", 120_000), (6, "mit-line", 0), (6, "mit-line", 12)]
    assert rows(L.license_spans(documents(spark, []))) == []
    with pytest.raises(ValueError):
        L.license_spans(documents(spark, data), {"x": "two words"})


def test_many_templates_join_without_broadcast(spark, monkeypatch):
    df = documents(spark, [(1, L.TEMPLATES["unlicense"])])
    want = rows(L.license_spans(df))
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert rows(L.license_spans(df)) == want


def test_whole_licenses_are_covered_to_their_end(spark):
    names = ("mit", "bsd-2-clause", "bsd-3-clause", "isc", "zlib")
    got = {(r[0], r[1]): r for r in rows(L.license_spans(documents(spark, [(i, "start " + L.TEMPLATES[n]) for i, n in enumerate(names)])))}
    for i, n in enumerate(names):
        assert got[(i, n)][2:] == (1, 1 + len(L.K.tokenize([L.TEMPLATES[n]]).hashes), 1.0)
