"""Small tables with everything that goes wrong, and helpers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names operators use inside, in another case as well.
CLASHING = {"id": 1, "lx_id": "x", "LX_s": 2, "score": 0.5, "removed": 3, "rate": 9.0, "h": "y", "key": 7, "root": 8, "group_id": 9, "a b.c": 1}


def documents(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    schema = DOCS
    if clash:
        full = [(*r, *CLASHING.values()) for r in full]
        kinds = {int: "bigint", str: "string", float: "double"}
        schema += "".join(f", `{k}` {kinds[type(v)]}" for k, v in CLASHING.items())
    return spark.createDataFrame(full, schema)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    """n words out of many, so that unrelated texts share few runs of words."""
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(2)) + str(rng.randrange(words)) for _ in range(n))


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join("zz" + str(rng.randrange(10**6)) if rng.random() < share else w for w in text.split(" "))


def rows(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
