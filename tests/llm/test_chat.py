import random

import duckdb
import pandas as pd

from lexiloom.llm import chat as C
from tests.llm.cases import rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def table(spark, data):
    return spark.createDataFrame([(*r, 5, "z") for r in data], SCHEMA + ", window bigint, c string")


def sql(data):
    con = duckdb.connect()
    con.register("raw", pd.DataFrame([*data, (None, None, None, None)], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM raw")
    found = con.execute(C.ORACLE)
    names = [d[0] for d in found.description]
    return sorted(tuple(r[names.index(n)] for n, _ in C.FIELDS) for r in found.fetchall())


def test_against_sql(spark):
    rng = random.Random(8)
    data = []
    for c in range(40):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and c % 3 else rng.choice(["user", "assistant", None, "tool"])
            data.append((c, t, role, rng.choice([None, "", "w " * rng.randrange(1, 200), "é ü\n" * 30])))
    rng.shuffle(data)
    assert rows(C.chat_windows(table(spark, data))) == sql(data)


def test_windows():
    turns = [("system", "be kind")] + [("user" if i % 2 == 0 else "assistant", "w " * 40) for i in range(20)]
    out = C.windows(turns, 200, 100, 4)
    assert [w[1] for w in out] == [0, *(w[2] + 1 for w in out[:-1])] and out[-1][2] == 19
    assert all(w[4] <= 200 and not w[5] and w[6].startswith("<|system|>\nbe kind\n") for w in out)
    assert all(w[3] == 2 for w in out[1:]) and sum(len(w[7].split(";")) for w in out) == 10
    for w in out:
        for span in w[7].split(";"):
            a, b = map(int, span.split("-"))
            assert w[6][a:b] == "w " * 40 and w[6][:a].endswith("<|assistant|>\n")


def test_defined_cases(spark):
    data = [
        (None, 0, "user", "x"), (1, 0, "system", "only"), (2, None, "user", "last"), (2, 1, None, None), (3, 0, "user", "w " * 5000), (3, 1, "assistant", "ok"),
        (4, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "system", "late"), (4, 2, "system", "second"),
    ]
    got = rows(C.chat_windows(table(spark, data)))
    assert got == sql(data)
    by = {(r[0], r[1]): r for r in got}
    assert (1, 0) not in by and by[(2, 0)][7] == "<|unknown|>\n\n<|user|>\nlast\n"
    assert by[(3, 0)][6] is True and by[(3, 1)][3] == 1 and by[(4, 0)][7].startswith("<|system|>\nlate\n<|user|>\nhi\n<|user|>\nhi\n<|system|>\nsecond")
    assert rows(C.chat_windows(table(spark, []))) == []
