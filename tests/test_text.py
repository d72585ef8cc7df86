import pytest
from pyspark.sql import functions as F

from lexiloom.functions import sizes
from lexiloom.functions import text as X


@pytest.mark.parametrize("value", [0, 1, 127, 128, 300, 16384, 1 << 40])
def test_variable_bytes_round_trip(spark, value):
    data = sizes.encode(value)
    assert sizes.decode(b"\x85" + data + b"\x80", 1) == (value, 1 + len(data))
    assert spark.range(1).select(sizes.encoded_size(F.lit(value))).first()[0] == len(data)


def test_negative_is_refused():
    with pytest.raises(ValueError):
        sizes.encode(-1)


TEXTS = ["Hello, WORLD! 42 e-mail", "A_B", "étre", "K İ ok", "", "a\rb\tc\nd"]
TOKENS = [["hello", "world", "42", "e", "mail"], ["a", "b"], ["tre"], ["ok"], [], ["a", "b", "c", "d"]]


def test_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", X.tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in rows] == TOKENS == [X.words(t) for t in TEXTS]


def test_cleaning(spark):
    rows = ["  a   b\x1c\x1f c\n", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(X.cleaned(F.col("t"))).collect()] == [" ".join((r or "").split()) for r in rows]


def test_abstract_and_url(spark):
    df = spark.createDataFrame([("", "x  y"), (None, "z"), ("o" * 700, "z"), (None, None)], "o string, t string")
    assert [r[0] for r in df.select(X.abstract(F.col("o"), F.col("t"))).collect()] == ["x y", "z", "o" * 600, ""]
    assert spark.range(1).select(X.page_url(F.lit("A b c"))).first()[0].endswith("/wiki/A_b_c")


def test_shrink(spark):
    df = spark.createDataFrame([(25, 100), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(sizes.shrink_percent(F.col("a"), F.col("b"))).collect()] == [75.0, 0.0]
