"""Sources: tab-separated corpora, query files, page dumps, and a synthetic corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as X

SAMPLE_WORDS = (
    "river", "stone", "light", "garden", "window", "paper", "letter", "market", "harbour", "bridge", "winter", "summer", "music", "dance",
    "village", "castle", "forest", "valley", "island", "engine", "wheel", "metal", "copper", "silver", "planet", "comet", "orbit", "signal",
    "circuit", "number", "proof", "theorem", "puzzle", "recipe", "kitchen", "butter", "bread", "salt", "pepper", "honey", "horse", "falcon",
    "salmon", "spider", "oak", "maple", "cedar", "meadow", "canyon", "desert", "glacier", "thunder", "cloud", "shadow", "mirror", "lantern",
    "candle", "anchor", "sailor", "captain", "soldier", "doctor", "teacher", "student", "library", "museum", "theatre", "painter",
)


#: Partitions of a text source up to which the offsets of its splits are broadcast.
BROADCAST_SPLITS = 1_000_000


def split_line(line) -> list:
    """title, url and text of one tab-separated line, as Columns.

    No tab: the line is the text. One tab: the part before it is the title, and the
    whole line the text. More: title, url, and all that follows the second tab.
    """
    parts = F.split(line, "\t", 3)
    n = F.size(parts)
    title = F.when(n > 1, parts[0]).otherwise(F.lit(""))
    url = F.when(n > 2, F.get(parts, 1)).otherwise(F.lit(""))
    text = F.when(n > 2, F.get(parts, 2)).otherwise(line)
    return [title.alias("title"), url.alias("url"), text.alias("text")]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value) of a text file or folder; ids count lines from 0 in file order.

    A split holds consecutive lines, so a line's number is what the splits before it
    hold plus its place in its own. One cheap job counts the splits; their offsets, three
    longs for each, are broadcast as long as there are at most BROADCAST_SPLITS partitions.
    The id that Spark gives to a row carries both its partition (upper bits) and its place
    (lower 33 bits).
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"cannot open corpus: {path}") from e
    few = lines._jdf.queryExecution().toRdd().getNumPartitions() <= BROADCAST_SPLITS
    lines = lines.withColumn("_at", F.monotonically_increasing_id()).select(
        "value", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
    )
    piece = F.xxhash64("_file", "_start").alias("_piece")  # a partition may hold several small files
    pieces = lines.groupBy("_part", "_file", "_start").agg(F.count("*").alias("n"), F.min("_nth").alias("low"))
    order = Window.orderBy("_file", "_start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select("_part", piece, (before - F.col("low")).alias("offset"))
    joined = lines.select("value", "_part", "_nth", piece).join(F.broadcast(offsets) if few else offsets, ["_part", "_piece"])
    return joined.select((F.col("offset") + F.col("_nth")).cast("bigint").alias("doc_id"), "value")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, url, text); an empty line is an empty document. Lines end at \\n alone."""
    return numbered_lines(spark, path).select("doc_id", *split_line(F.col("value")))


def read_queries(spark: SparkSession, path: str) -> list[str]:
    """The lines of a query file that aren't empty."""
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"cannot open queries: {path}") from e
    found = [r["value"] for r in lines.where("value <> ''").collect()]  # a file written by hand
    if not found:
        raise ValueError("no queries")
    return found


_RECORD = "title STRING, opening_text STRING, text STRING, _bad STRING"
#: Before it the fields that are wanted have come; what follows is the page's whole text.
_MARKER = ',"text":"'


def parse_record(line: Column) -> Column:
    """(title, opening_text, text) of one JSON line, null where it doesn't parse.

    A record that is complete before the marker of its text and has a title there is read
    no further: its text is null, and a page without an opening has none then. Any other
    line is parsed whole.
    """
    parsed = lambda x: F.from_json(x, _RECORD, {"columnNameOfCorruptRecord": "_bad"})
    at = F.instr(line, _MARKER)
    early = parsed(F.when(at > 0, F.concat(F.substr(line, F.lit(1), at - 1), F.lit("}"))))
    sound = lambda r: F.when(r["_bad"].isNull(), r)
    head = sound(early)
    return F.when(F.coalesce(F.length(head["title"]) > 0, F.lit(False)), head).otherwise(sound(parsed(line)))


def read_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, title, url, text) of a page dump in JSON lines, every second of them an action line.

    text is the opening, or else the page's text where the record was parsed whole (see
    parse_record), cleaned and cut. Lines that don't parse, and pages without a title or a
    text, are left out. Ids count the pages that stay.
    """
    lines = numbered_lines(spark, path).where(F.pmod("doc_id", F.lit(2)) == 1)
    page = lines.select("doc_id", parse_record(F.col("value")).alias("r")).select("doc_id", "r.title", "r.opening_text", "r.text")
    page = page.select("doc_id", X.cleaned(F.col("title")).alias("title"), X.abstract(F.col("opening_text"), F.col("text")).alias("text"))
    page = page.where("title <> '' and text <> ''")
    if limit is not None:
        page = page.orderBy("doc_id").limit(max(1, limit))
    return with_row_ids(page.withColumn("url", X.page_url(F.col("title"))), "doc_id").select("doc_id", "title", "url", "text")


def with_row_ids(rows: DataFrame, by: str, block: int = 1 << 20) -> DataFrame:
    """rows with doc_id counting from 0 in the order of the long column by, whose values are distinct.

    Ranges of block values are numbered each in its own task; one row for each range carries
    on the count.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(by) / block))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_range").orderBy(by)
    numbered = ranged.withColumn("_nth", F.row_number().over(inner) - 1).join(starts, "_range")
    return numbered.withColumn("doc_id", F.col("_start") + F.col("_nth")).select(*dict.fromkeys([*rows.columns, "doc_id"]))


def synthetic(spark: SparkSession, docs: int = 50_000, seed: int = 7) -> DataFrame:
    """(doc_id, title, url, text): 15 to 40 words each, the i-th word with a chance in proportion to 1 / i."""
    n = len(SAMPLE_WORDS)
    total = sum(1 / (i + 1) for i in range(n))
    edges, at = [], 0.0
    for i in range(n):
        at += 1 / (i + 1) / total
        edges.append(at)
    chance = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), *salt), F.lit(1 << 40)) / F.lit(float(1 << 40))
    table = F.array(*[F.lit(w) for w in SAMPLE_WORDS])
    steps = F.array(*[F.lit(e) for e in edges[:-1]])
    size = F.lit(15) + F.floor(chance(F.col("id"), F.lit(-1)) * 26).cast("int")
    places = F.transform(F.sequence(F.lit(1), size), lambda i: chance(F.col("id"), i))
    body = F.transform(places, lambda x: F.get(table, F.size(F.filter(steps, lambda e: e <= x))))
    made = spark.range(docs).select(F.col("id").alias("doc_id"), body.alias("w"))
    title = F.concat_ws(" ", F.transform(F.slice("w", 1, 3), lambda w: F.initcap(w)))
    url = F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string"))
    return made.select("doc_id", title.alias("title"), url.alias("url"), F.concat_ws(" ", "w").alias("text"))
