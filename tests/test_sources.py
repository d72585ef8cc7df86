import gzip
import json
import random

import pytest

from lexiloom.cli import main
from lexiloom.sources.corpus import read_dump, read_queries, read_tsv, synthetic, with_row_ids
from lexiloom.sources.sinks import result_lines, write_tsv


def test_tsv_rules(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("\nonlytext here\ntwo\tfields here\na\tb\tc\td\n\t\tx\nlast\r with\tcr", newline="")
    rows = [tuple(r) for r in read_tsv(spark, str(path)).orderBy("doc_id").collect()]
    assert rows == [
        (0, "", "", ""), (1, "", "", "onlytext here"), (2, "two", "", "two\tfields here"), (3, "a", "b", "c\td"), (4, "", "", "x"),
        (5, "last\r with", "", "last\r with\tcr"),
    ]


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    lines = [f"t{i}\tu\tline {i} {'x' * (i % 50)}" for i in range(3000)]
    (folder / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    (folder / "b.txt").write_text("\n".join(lines[2500:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = read_tsv(spark, str(folder)).select("doc_id", "title").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r[0], r[1]) for r in rows) == [(i, f"t{i}") for i in range(3000)]


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="cannot open corpus"):
        read_tsv(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="cannot open queries"):
        read_queries(spark, str(tmp_path / "none"))


def test_query_file(spark, tmp_path):
    path = tmp_path / "q.txt"
    path.write_text("fox\n\n dog \n")
    assert read_queries(spark, str(path)) == ["fox", " dog "]
    path.write_text("\n\n")
    with pytest.raises(ValueError, match="no queries"):
        read_queries(spark, str(path))


def test_dump(spark, tmp_path):
    pages = [
        {"title": "A b", "opening_text": " One\n two ", "text": "no"}, {"title": "B", "opening_text": "", "text": "fall  back"}, {"title": "C", "text": ""},
        {"title": "", "opening_text": "x"},
    ]
    compact = lambda p: json.dumps(p, separators=(",", ":"))
    # Complete before its text and without an opening: dropped. The same with blanks, or without a title there, is parsed whole.
    more = [compact({"title": "Cut", "opening_text": "", "text": "never read"}), json.dumps({"title": "D", "opening_text": "", "text": "read"}),
            '{"opening_text":"","text":"all of it","title":"E"}', '{"title":"F","opening_text":"broken ,"text":"x"}', compact({"title": "G", "opening_text": "o", "text": "t"})]
    lines = [x for p in [*map(json.dumps, pages), *more] for x in ('{"index":{}}', p)] + ['{"index":{}}', "{broken"]
    path = tmp_path / "d.json.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    rows = [tuple(r) for r in read_dump(spark, str(path)).orderBy("doc_id").collect()]
    assert [(r[0], r[1], r[3]) for r in rows] == [(0, "A b", "One two"), (1, "B", "fall back"), (2, "D", "read"), (3, "E", "all of it"), (4, "G", "o")]
    assert rows[0][2].endswith("/A_b")
    assert read_dump(spark, str(path), 0).count() == 1


def test_row_ids_over_ranges(spark):
    values = sorted(random.Random(2).sample(range(5000), 700))
    made = spark.createDataFrame([(v, str(v)) for v in random.Random(3).sample(values, 700)], "k long, x string")
    got = {r["k"]: r["doc_id"] for r in with_row_ids(made, "k", block=64).collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_synthetic_round_trip(spark, tmp_path):
    made = synthetic(spark, 200)
    rows = made.orderBy("doc_id").collect()
    assert all(15 <= len(r["text"].split()) <= 40 for r in rows) and rows[0]["title"] == " ".join(w.capitalize() for w in rows[0]["text"].split()[:3])
    write_tsv(made, str(tmp_path / "out"))
    back = read_tsv(spark, str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in rows]


def test_result_lines():
    rows = [{"score": 1.23456, "title": "T", "url": "u"}, {"score": 0.0, "title": "V", "url": ""}]
    assert result_lines(rows) == [" 1. [1.2346] T", "        u", " 2. [0.0000] V"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.tsv").write_text("Cats\tu\tthe fox\nDogs\tv\tthe dog\n")
    (tmp_path / "q.txt").write_text("fox\nthe\n")
    index = str(tmp_path / "i")
    assert main(["build", str(tmp_path / "c.tsv"), index]) == 0
    assert main(["search", index, "fox OR dog", "1"]) == 0
    assert main(["bench", index, str(tmp_path / "q.txt")]) == 0
    out = capsys.readouterr().out
    assert "unique terms   5" in out and "1 results" in out and "hits 3" in out
    assert main(["search", index, "(fox"]) == 1 and main([]) == 1 and main(["search", index]) == 1
