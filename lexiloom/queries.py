"""Every operator as a query over the documents table, and the same in DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.engine import SearchEngine
from lexiloom.functions import sizes
from lexiloom.functions import text as X
from lexiloom.model import Bm25
from lexiloom.operators import encoding, ranking, retrieval
from lexiloom.operators import index as I
from lexiloom.plans import query as Q
from lexiloom.service import api_search, clamped_k
from lexiloom.shared import cut, shared_folder
from lexiloom.shipping import ship
from lexiloom.sources.corpus import read_dump, read_queries, read_tsv, split_line, synthetic
from lexiloom.sources.sinks import result_lines, write_tsv
from lexiloom.store import build_index, find_term
from lexiloom.workload import latency_summary, run_at_once, run_serially

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "reed AND anat"
BATCH = ("reed AND anat", "reed OR anat", "the AND NOT reed", '"of the"', "NOT NOT reed", '("of the" OR und) AND NOT (la OR reed)', "zzzq", "NOT the")
K = 10
_WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda w: lower(w))"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.spread(I.as_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    return SearchEngine.of(_corpus(spark, sf_dir))


def _big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# --- text and index -----------------------------------------------------------


def tokenize(spark, sf_dir):
    tokens = I.tokenized(_corpus(spark, sf_dir))
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("length"), F.concat_ws(" ", "tokens").alias("tokens"))


def positions(spark, sf_dir):
    return _big(I.token_positions(_corpus(spark, sf_dir)), "pos")


def postings(spark, sf_dir):
    posted = I.postings(_corpus(spark, sf_dir))
    listed = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")
    return posted.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), listed, F.col("doc_len").cast("bigint").alias("doc_len"))


def doc_freq(spark, sf_dir):
    return I.doc_frequencies(_corpus(spark, sf_dir))


def doc_store(spark, sf_dir):
    return _big(I.docs(_corpus(spark, sf_dir)), "length")


def corpus_stats(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return I.corpus_stats(I.docs(corpus), I.doc_frequencies(corpus))


def term_lookup(spark, sf_dir):
    return I.dictionary(I.postings(_corpus(spark, sf_dir), ["anat", "reed", "the", "zzzq"]))


def positions_fetch(spark, sf_dir):
    posted = I.postings(_corpus(spark, sf_dir), ["reed"])
    return posted.select("doc_id", F.explode("positions").alias("pos")).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


# --- encoding -----------------------------------------------------------------


def naive_size(spark, sf_dir):
    return encoding.naive_size(I.postings(_corpus(spark, sf_dir)))


def compressed_size(spark, sf_dir):
    return encoding.index_size(I.packed(_corpus(spark, sf_dir)))


def compression_ratio(spark, sf_dir):
    both = encoding.index_size(I.packed(_corpus(spark, sf_dir)))
    return both.select(F.round(sizes.shrink_percent(F.col("postings_bytes"), F.col("naive_bytes")), 6).alias("shrink"))


def term_sizes(spark, sf_dir):
    return encoding.term_sizes(I.packed(_corpus(spark, sf_dir)))


def doc_gaps(spark, sf_dir):
    return encoding.doc_gaps(I.packed(_corpus(spark, sf_dir)))


def position_gaps(spark, sf_dir):
    gaps = encoding.position_gaps(I.postings(_corpus(spark, sf_dir)))
    return gaps.select("term", "doc_id", F.array_join(F.transform("gaps", lambda g: g.cast("string")), ",").alias("gaps"))


def skip_table(spark, sf_dir):
    return encoding.skip_table(I.packed(_corpus(spark, sf_dir)))


def encoded_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", *[sizes.encoded_size(F.col(c) * m).alias(n) for c, m, n in (("doc_id", 1, "a"), ("n_chars", 1, "b"), ("n_chars", 7919, "c"))])


def idf(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    freqs = I.doc_frequencies(_corpus(spark, sf_dir))
    value = ranking.inverse_doc_freq(F.col("doc_freq").cast("double"), F.lit(float(engine.num_docs())))
    return freqs.select("term", F.round(value, 6).alias("idf"))


def term_weights(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    return engine.contributions(["anat", "reed", "the"]).select("term", "doc_id", F.round("c", 6).alias("weight"))


# --- set algebra --------------------------------------------------------------


def _algebra(query: str) -> Query:
    def run(spark, sf_dir):
        tree = Q.parse(query)
        corpus = _corpus(spark, sf_dir)
        posted = I.postings(corpus, Q.all_terms(tree)).select("term", "doc_id", "positions")
        return retrieval.evaluate(tree, cut(posted), corpus)  # stored, as each of the terms reads it

    return run


# --- search -------------------------------------------------------------------


def _match(query: str) -> Query:
    return lambda spark, sf_dir: _engine(spark, sf_dir).match(query)


def _scores(query: str, **params: float) -> Query:
    def run(spark, sf_dir):
        return SearchEngine.of(_corpus(spark, sf_dir), **params).scores(query).select("doc_id", F.round("score", 6).alias("score"))

    return run


def _top(query: str, k: int = K) -> Query:
    def run(spark, sf_dir):
        return _engine(spark, sf_dir).search(query, k).select("docid", F.round("score", 6).alias("score"), "title", "url")

    return run


def topk_with_metadata(spark, sf_dir):
    """Pages: the url is the title, the html the text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    engine = SearchEngine.of(I.as_corpus(pages, "page_id", "html", "url", "url"))
    return engine.search("the AND div", K).select("docid", F.round("score", 6).alias("score"), "title", "url")


def batch_search(spark, sf_dir):
    found = _engine(spark, sf_dir).search_all(list(BATCH), K)
    return found.select(F.col("qid").cast("bigint").alias("qid"), "query", F.col("rank").cast("bigint").alias("rank"), "docid", F.round("score", 6).alias("score"))


# --- ingest -------------------------------------------------------------------


def tsv_fields(spark, sf_dir):
    """The first word, the rest and the tabs between vary with the id, so that every case of the rules occurs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.translate(F.col("text"), "\n", " ")
    tabbed = F.regexp_replace(body, " ", "\t")
    one = F.concat(F.col("source"), F.lit("\t"), body)
    two = F.concat(F.col("source"), F.lit("\t"), F.col("lang"), F.lit("\t"), body)
    kind = F.pmod("doc_id", F.lit(5))
    line = F.when(kind == 0, body).when(kind == 1, one).when(kind == 2, two).when(kind == 3, tabbed).otherwise(F.lit(""))
    return docs.select("doc_id", *split_line(line))


def clean_truncate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    opening = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("")).when(F.pmod("doc_id", F.lit(3)) == 1, F.lit(None)).otherwise(F.col("text"))
    title = F.concat(F.col("lang"), F.lit(" "), F.col("source"))
    return docs.select("doc_id", X.abstract(opening, F.col("text")).alias("abstract"), X.page_url(title).alias("url"))


def doc_len_of_corpus(spark, sf_dir):
    """Whole-corpus totals as an opened engine gives them."""
    engine = _engine(spark, sf_dir)
    return spark.createDataFrame([(engine.num_docs(), round(engine.index.avg_doc_len(), 6))], "num_docs bigint, avg_doc_len double")


# --- files --------------------------------------------------------------------


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of this application and this data in the shared one."""
    return f"{shared_folder(spark)}/lexiloom-{spark.sparkContext.applicationId}/{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}/{name}"


_reports: dict[str, dict] = {}


def _stored(spark: SparkSession, sf_dir: str) -> tuple[SearchEngine, dict]:
    """The index of the documents, with source and language as title and url, built and written once, then opened from its files."""
    folder = _folder(spark, sf_dir, "index")
    if folder not in _reports:
        corpus = I.as_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), title="source", url="lang")
        _reports[folder] = build_index(corpus, folder)
    return SearchEngine.open(spark, folder), _reports[folder]


def stored_report(spark, sf_dir):
    """What a build reports, but for the seconds."""
    report = _stored(spark, sf_dir)[1]
    names = ("num_docs", "num_terms", "total_tokens", "postings_bytes", "naive_bytes")
    return spark.createDataFrame([tuple(report[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


def stored_stats(spark, sf_dir):
    """The row that opening reads."""
    index = _stored(spark, sf_dir)[0].index
    return spark.createDataFrame([(index.num_docs(), index.stats["total_tokens"], round(index.avg_doc_len(), 6))], "num_docs bigint, total_tokens bigint, avg_doc_len double")


def stored_terms(spark, sf_dir):
    return _stored(spark, sf_dir)[0].index.terms


def stored_docs(spark, sf_dir):
    return _big(_stored(spark, sf_dir)[0].index.docs, "length")


def stored_postings(spark, sf_dir):
    posted = _stored(spark, sf_dir)[0].index.postings
    listed = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")
    return _big(posted.select("term", "doc_id", "tf", listed, "doc_len", "position_bytes"), "tf", "doc_len", "position_bytes")


def stored_lookup(spark, sf_dir):
    """Dictionary lookups of single terms, known and unknown."""
    index = _stored(spark, sf_dir)[0].index
    return spark.createDataFrame([(t, find_term(index, t)) for t in ("anat", "reed", "the", "zzzq")], "term string, doc_freq bigint")


def _stored_match(query: str) -> Query:
    return lambda spark, sf_dir: _stored(spark, sf_dir)[0].match(query)


def _stored_search(query: str, k: int = K) -> Query:
    return lambda spark, sf_dir: _stored(spark, sf_dir)[0].search(query, k).withColumn("score", F.round("score", 6))


def stored_batch(spark, sf_dir):
    found = _stored(spark, sf_dir)[0].search_all([*BATCH, "", "!!!", *BATCH[:2]], K)
    return _big(found, "qid", "rank").withColumn("score", F.round("score", 6))


def _served(spark: SparkSession, sf_dir: str) -> list[dict]:
    engine = _stored(spark, sf_dir)[0]
    return [api_search(engine, q, k) for q, k in SERVED]


def service_answers(spark, sf_dir):
    """The search endpoint: cleaned query, number of results and error of each call."""
    rows = [(i, a["query"], a["count"], a["error"]) for i, a in enumerate(_served(spark, sf_dir))]
    return spark.createDataFrame(rows, "call bigint, query string, count bigint, error string")


def service_results(spark, sf_dir):
    """The results of each call, in their order."""
    rows = [(i, j, r["docid"], round(r["score"], 6), r["title"], r["url"]) for i, a in enumerate(_served(spark, sf_dir)) for j, r in enumerate(a["results"], 1)]
    return spark.createDataFrame(rows, "call bigint, rank bigint, docid bigint, score double, title string, url string")


def result_text(spark, sf_dir):
    """The lines that the command line prints."""
    lines = result_lines(_stored(spark, sf_dir)[0].search(FLAGSHIP, K).collect())
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, value string")


def workload_hits(spark, sf_dir):
    """Queries and hits of a workload read from a query file, one by one and in one job."""
    folder = _folder(spark, sf_dir, "queries")
    _write_lines(spark, ["", *BATCH, ""], folder)
    engine, queries = _stored(spark, sf_dir)[0], read_queries(spark, folder)
    runs = (("one by one", run_serially(engine, queries, K)), ("in one job", run_at_once(engine, queries, K)))
    return spark.createDataFrame([(name, r["queries"], r["hits"]) for name, r in runs], "run string, queries bigint, hits bigint")


def latencies(spark, sf_dir):
    """The summary of a workload whose n-th query took as many milliseconds as the n-th document has characters."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars is not null").select("n_chars").collect()
    millis = [float(r[0]) for r in rows]
    summary = latency_summary(millis, sum(millis))
    return spark.createDataFrame([tuple(round(summary[k], 6) for k in ("mean_ms", "p50_ms", "p95_ms", "qps"))], "mean_ms double, p50_ms double, p95_ms double, qps double")


def _write_lines(spark: SparkSession, lines: list[str], folder: str) -> None:
    spark.createDataFrame(list(enumerate(lines)), "i long, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(folder)


def _lines_of_documents(spark: SparkSession, sf_dir: str, line, folder: str) -> None:
    """A line for each document, in the order of doc_id over the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    docs.withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\n\t", "  ")).select("doc_id", line.alias("value")).orderBy("doc_id").select("value").write.mode("overwrite").text(folder)


def read_tsv_file(spark, sf_dir):
    """A corpus of lines with none, one and two tabs, read from its files; ids number the lines."""
    kind = F.pmod("doc_id", F.lit(3))
    line = F.concat(F.when(kind > 0, F.concat(F.col("source"), F.lit("\t"))).otherwise(""), F.when(kind > 1, F.concat(F.col("lang"), F.lit("\t"))).otherwise(""), F.col("text"))
    folder = _folder(spark, sf_dir, "tsv")
    _lines_of_documents(spark, sf_dir, line, folder)
    return read_tsv(spark, folder)


def write_read_tsv(spark, sf_dir):
    """A corpus written as lines and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.translate("text", "\n\t", "  "))
    folder = _folder(spark, sf_dir, "written")
    write_tsv(I.as_corpus(docs, title="source", url="lang"), folder)
    return read_tsv(spark, folder)


def _dump(spark: SparkSession, sf_dir: str) -> str:
    """Pages in JSON lines behind action lines, one for each document; every case of the rules occurs."""
    kind, opening = F.pmod("doc_id", F.lit(6)), F.substring("text", 1, 700).alias("opening_text")
    title = F.concat(F.col("lang"), F.lit("  page "), F.col("doc_id").cast("string")).alias("title")
    whole, none = F.to_json(F.struct(title, opening, F.lit("rest").alias("text"))), F.lit("").alias("opening_text")
    bare, text = F.lit("").alias("title"), F.col("text").alias("text")
    page = (
        F.when(kind == 0, whole).when(kind == 1, F.to_json(F.struct(title, none, text))).when(kind == 2, F.to_json(F.struct(bare, opening, text)))
        .when(kind == 3, F.to_json(F.struct(text, title))).when(kind == 4, F.concat(F.lit("{"), whole)).otherwise(F.regexp_replace(whole, ',"text":', ', "text": '))
    )
    folder = _folder(spark, sf_dir, "dump")
    _lines_of_documents(spark, sf_dir, F.concat(F.lit('{"index":{}}\n'), page), folder)
    return folder


def read_dump_file(spark, sf_dir):
    return read_dump(spark, _dump(spark, sf_dir))


def read_dump_limit(spark, sf_dir):
    """A limit is the feature: the first pages that stay."""
    return read_dump(spark, _dump(spark, sf_dir), 7)


def synthetic_corpus(spark, sf_dir):
    """What holds for every synthetic corpus: its size, the bounds of lengths, the words used, titles and urls that fit."""
    made = synthetic(spark, 2000).withColumn("w", F.split("text", " "))
    fits = (F.lower("title") == F.concat_ws(" ", F.slice("w", 1, 3))) & F.col("url").endswith(F.concat(F.lit("/"), F.col("doc_id").cast("string")))
    facts = made.agg(F.count("*").alias("docs"), F.min(F.size("w")).cast("bigint").alias("least"), F.max(F.size("w")).cast("bigint").alias("most"), F.sum(fits.cast("bigint")).alias("fit"))
    words = made.select(F.explode("w").alias("x")).agg(F.count_distinct("x").alias("words"))
    return facts.join(F.broadcast(words))


def variable_bytes(spark, sf_dir):
    """Numbers as coded, in hexadecimal, and decoded again."""
    def coded(v: pd.Series) -> pd.DataFrame:
        data = [sizes.encode(int(x)) for x in v]
        return pd.DataFrame({"code": [d.hex() for d in data], "back": [sizes.decode(d)[0] for d in data]})

    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars is not null").select("doc_id", (F.col("n_chars") * 7919).alias("v"))
    return docs.withColumn("x", F.pandas_udf(coded, "code string, back bigint")("v")).select("doc_id", "v", "x.code", "x.back")


def empty_query(spark, sf_dir):
    """Queries without a word have no results, and no error."""
    engine = _stored(spark, sf_dir)[0]
    return engine.search("", K).union(engine.search("!!! ,", K)).union(_engine(spark, sf_dir).search(" ", K))


def syntax_errors(spark, sf_dir):
    def said(query: str) -> str | None:
        try:
            Q.parse(query)
        except Q.QuerySyntaxError as e:
            return str(e)

    return spark.createDataFrame([(q, said(q)) for q in BROKEN], "query string, error string")


def clamped(spark, sf_dir):
    return spark.createDataFrame([(k, clamped_k(k)) for k in CLAMPED], "given string, k bigint")


# --- SQL ----------------------------------------------------------------------

_TOK = f"tok AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ts FROM documents WHERE doc_id IS NOT NULL)"
_POS = f"{_TOK}, pos AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM tok)"
_POST = f"""{_POS}, lens AS (SELECT doc_id, len(ts) AS doc_len FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf FROM pos GROUP BY term, doc_id),
terms AS (SELECT term, count(*) AS doc_freq FROM post GROUP BY term)"""


def _vb(x: str) -> str:
    return "(1" + "".join(f" + CAST({x} >= {1 << bits} AS BIGINT)" for bits in range(7, 63, 7)) + ")"


_CODED = f"""{_POST},
posgaps AS (SELECT term, doc_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS gap FROM pos),
lists AS (SELECT term, doc_id, sum({_vb("gap")}) AS pos_bytes FROM posgaps GROUP BY term, doc_id),
gapped AS (SELECT p.term, p.doc_id, p.tf, l.pos_bytes, t.doc_freq,
  coalesce(lag(p.doc_id) OVER w, 0) AS prev, row_number() OVER w - 1 AS nth
  FROM post p JOIN lists l USING (term, doc_id) JOIN terms t USING (term) WINDOW w AS (PARTITION BY p.term ORDER BY p.doc_id)),
rec AS (SELECT *, {_vb("(doc_id - prev)")} + {_vb("tf")} + pos_bytes AS bytes FROM gapped),
placed AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY term ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rec),
skips AS (SELECT term, nth, prev AS skip_doc, CAST(start AS BIGINT) AS skip_offset FROM placed
  WHERE doc_freq >= 16 AND nth > 0 AND nth % CAST(floor(sqrt(doc_freq)) AS BIGINT) = 0),
skip_sums AS (SELECT term, count(*) AS n, sum({_vb("skip_doc")} + {_vb("skip_offset")}) AS bytes FROM skips GROUP BY term),
sized AS (SELECT r.term, count(*) AS doc_freq, sum(r.bytes) AS bytes, sum(4 * (2 + r.tf)) AS naive FROM rec r GROUP BY r.term),
term_bytes AS (SELECT s.term, CAST(s.doc_freq AS BIGINT) AS doc_freq,
  CAST({_vb("coalesce(k.n, 0)")} + coalesce(k.bytes, 0) + s.bytes AS BIGINT) AS encoded_bytes, CAST(s.naive AS BIGINT) AS naive_bytes
  FROM sized s LEFT JOIN skip_sums k USING (term))"""


def _set_sql(node: Q.Node) -> str:
    """The (doc_id) set of a tree, over tok, pos and documents."""
    match node:
        case Q.Term(term):
            return f"SELECT DISTINCT doc_id FROM pos WHERE term = '{term}'"
        case Q.Phrase(()):
            return "SELECT doc_id FROM tok WHERE false"
        case Q.Phrase(terms):
            joins = " ".join(f"JOIN pos p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = '{t}'" for i, t in enumerate(terms) if i)
            return f"SELECT DISTINCT p0.doc_id FROM pos p0 {joins} WHERE p0.term = '{terms[0]}'"
        case Q.Not(part):
            return f"SELECT doc_id FROM tok EXCEPT ({_set_sql(part)})"
        case Q.And(parts):
            return " INTERSECT ".join(f"({_set_sql(p)})" for p in parts)
        case Q.Or(parts):
            return " UNION ".join(f"({_set_sql(p)})" for p in parts)


def _scored_ctes(tree: Q.Node, tag: str = "", k1: float = Bm25.k1, b: float = Bm25.b) -> str:
    listed = ", ".join(f"'{t}'" for t in Q.scoring_terms(tree)) or "NULL"
    return f"""matched{tag} AS ({_set_sql(tree)}),
scored{tag} AS (SELECT m.doc_id, coalesce(sum(x.c ORDER BY x.term), 0.0) AS score FROM matched{tag} m LEFT JOIN (
  SELECT p.term, p.doc_id, ln((n - t.doc_freq + 0.5) / (t.doc_freq + 0.5) + 1.0) * (p.tf * {k1 + 1.0})
    / (p.tf + CAST({k1} AS DOUBLE) * (CAST({1.0 - b} AS DOUBLE) + CAST({b} AS DOUBLE) * l.doc_len / avgdl)) AS c
  FROM post p JOIN terms t USING (term) JOIN lens l USING (doc_id), totals WHERE p.term IN ({listed})
) x ON x.doc_id = m.doc_id GROUP BY m.doc_id)"""


_TOTALS = "totals AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avgdl FROM lens)"


def _match_sql(query: str) -> str:
    return f"WITH {_POS} SELECT doc_id FROM ({_set_sql(Q.parse(query))})"


def _scores_sql(query: str, **params: float) -> str:
    return f"WITH {_POST}, {_TOTALS}, {_scored_ctes(Q.parse(query), **params)} SELECT doc_id, round(score, 6) AS score FROM scored"


_RANKED = "row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)"


def _top_sql(query: str, k: int = K) -> str:
    return f"""WITH {_POST}, {_TOTALS}, {_scored_ctes(Q.parse(query))}
SELECT doc_id AS docid, round(score, 6) AS score, '' AS title, '' AS url FROM scored QUALIFY {_RANKED} <= {k}"""


def _batch_sql() -> str:
    ctes, parts = [], []
    for i, q in enumerate(BATCH):
        ctes.append(_scored_ctes(Q.parse(q), str(i)))
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS qid, '{q}' AS query, CAST({_RANKED} AS BIGINT) AS rank, doc_id AS docid, round(score, 6) AS score
FROM scored{i} QUALIFY {_RANKED} <= {K}"""
        )
    return f"WITH {_POST}, {_TOTALS}, {', '.join(ctes)} " + " UNION ALL ".join(f"({p})" for p in parts)


def _pages_sql() -> str:
    docs = _POST.replace("coalesce(text, '')", "concat(url, ' ', html)").replace("FROM documents WHERE doc_id IS NOT NULL", "FROM (SELECT page_id AS doc_id, url, html FROM pages)")
    return f"""WITH {docs}, {_TOTALS}, {_scored_ctes(Q.parse("the AND div"))}
SELECT doc_id AS docid, round(score, 6) AS score, url AS title, url FROM scored JOIN (SELECT page_id AS doc_id, url FROM pages) USING (doc_id)
QUALIFY {_RANKED} <= {K}"""


_TSV_SQL = """WITH l AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN body WHEN 1 THEN source || chr(9) || body WHEN 2 THEN source || chr(9) || lang || chr(9) || body
    WHEN 3 THEN replace(body, ' ', chr(9)) ELSE '' END AS line
  FROM (SELECT *, replace(text, chr(10), ' ') AS body FROM documents)
), t AS (SELECT *, instr(line, chr(9)) AS a, instr(substr(line, instr(line, chr(9)) + 1), chr(9)) AS b FROM l)
SELECT doc_id, CASE WHEN a > 0 THEN substr(line, 1, a - 1) ELSE '' END AS title,
  CASE WHEN a > 0 AND b > 0 THEN substr(line, a + 1, b - 1) ELSE '' END AS url,
  CASE WHEN a > 0 AND b > 0 THEN substr(line, a + b + 1) ELSE line END AS text FROM t"""
_CLEAN_SQL = r"""SELECT doc_id, substr(trim(regexp_replace(coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END, ''), text, ''),
  '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')), 1, 600) AS abstract,
  'https://en.wikipedia.org/wiki/' || replace(lang || ' ' || source, ' ', '_') AS url FROM documents"""

SERVED = (("  reed ", "3"), ("reed AND anat", "x"), ("reed OR anat", "99"), ("", "5"), (None, "5"), (" !!! ", "5"), ("(reed", "5"), ("the", "0"), ("zzzq", None))
CLAMPED = ("0", "-4", "1", "10", "50", "51", "x", "", "7.5")
BROKEN = {
    "(quick AND brown": "unbalanced parentheses", "quick)": "unexpected token in query", "AND": "expected a term", "x AND": "expected a term", "OR x": "expected a term",
    "NOT": "expected a term", "()": "expected a term", "x AND OR y": "expected a term", "x OR OR y": "expected a term", "x AND ,": "expected a term", "x and y": None,
    '"x y': None, "": None, "NOT NOT x": None,
}
# The stored index has source and language as title and url; a title is part of what is searched.
_TITLED = _POST.replace(f"{_WORDS.format("coalesce(text, '')")}", f"{_WORDS.format("concat(coalesce(source, ''), ' ', coalesce(text, ''))")}")
_TITLED_POS = _TITLED[: _TITLED.index(", lens AS")]
_TITLED_CODED = _CODED.replace(_POST, _TITLED)
_NAMES = "coalesce(d.source, '') AS title, coalesce(d.lang, '') AS url"


def _stored_sql(query: str, k: int = K) -> str:
    return f"""WITH {_TITLED}, {_TOTALS}, {_scored_ctes(Q.parse(query))}
SELECT doc_id AS docid, round(score, 6) AS score, {_NAMES} FROM scored JOIN documents d USING (doc_id) QUALIFY {_RANKED} <= {k}"""


def _stored_batch_sql() -> str:
    ctes, parts = [], []
    asked = [*enumerate(BATCH), *((len(BATCH) + 2 + i, q) for i, q in enumerate(BATCH[:2]))]
    for i, q in asked:
        ctes.append(_scored_ctes(Q.parse(q), str(i)))
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS qid, '{q}' AS query, CAST({_RANKED} AS BIGINT) AS rank, doc_id AS docid, round(score, 6) AS score, {_NAMES}
FROM scored{i} JOIN documents d USING (doc_id) QUALIFY {_RANKED} <= {K}"""
        )
    return f"WITH {_TITLED}, {_TOTALS}, {', '.join(ctes)} " + " UNION ALL ".join(f"({p})" for p in parts)


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _answers_sql(results: bool) -> str:
    ctes, parts = [], []
    for i, (q, k) in enumerate(SERVED):
        query = (q or "").strip()
        tree, error = None, BROKEN.get(query)
        if query != "(reed":
            tree = Q.parse(query) if query else None
        else:
            error = "unbalanced parentheses"
        if tree:
            ctes.append(_scored_ctes(tree, str(i)))
        limit = min(max(int(k), 1), 50) if k and k.lstrip("-").isdigit() else 10
        if not results:
            n = f"least({limit}, (SELECT count(*) FROM scored{i}))" if tree else "0"
            parts.append(f"SELECT CAST({i} AS BIGINT) AS call, {_text(query)} AS query, CAST({n} AS BIGINT) AS count, {_text(error)} AS error")
        elif tree:
            parts.append(f"""SELECT CAST({i} AS BIGINT) AS call, CAST({_RANKED} AS BIGINT) AS rank, doc_id AS docid, round(score, 6) AS score, {_NAMES}
FROM scored{i} JOIN documents d USING (doc_id) QUALIFY {_RANKED} <= {limit}""")
    return f"WITH {_TITLED}, {_TOTALS}, {', '.join(ctes)} " + " UNION ALL ".join(f"({p})" for p in parts)


def _hits_sql() -> str:
    ctes = [_scored_ctes(Q.parse(q), str(i)) for i, q in enumerate(BATCH)]
    hits = " + ".join(f"least({K}, (SELECT count(*) FROM scored{i}))" for i in range(len(BATCH)))
    return f"WITH {_TITLED}, {_TOTALS}, {', '.join(ctes)} SELECT run, CAST({len(BATCH)} AS BIGINT) AS queries, CAST({hits} AS BIGINT) AS hits FROM (VALUES ('one by one'), ('in one job')) v(run)"


_LINED = "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n, translate(coalesce(text, ''), chr(10) || chr(9), '  ') AS line FROM documents WHERE doc_id IS NOT NULL"
_READ_SQL = f"""SELECT CAST(n AS BIGINT) AS doc_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS title, CASE WHEN doc_id % 3 = 2 THEN lang ELSE '' END AS url,
  CASE WHEN doc_id % 3 = 1 THEN source || chr(9) || line ELSE line END AS text FROM ({_LINED})"""
_SPACES = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"
_DUMP_SQL = f"""SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_id, title, 'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url, text FROM (
  SELECT doc_id, lang || ' page ' || doc_id AS title, substr(CASE doc_id % 6 WHEN 3 THEN {_SPACES.format("line")} ELSE
    coalesce(nullif({_SPACES.format("substr(line, 1, 700)")}, ''), CASE WHEN doc_id % 6 = 5 AND substr(line, 1, 700) = '' THEN 'rest' ELSE '' END) END, 1, 600) AS text
  FROM ({_LINED}) WHERE doc_id % 6 IN (0, 3, 5)) WHERE text <> ''"""
_BYTES_SQL = f"""SELECT doc_id, v, array_to_string(list_transform(range(0, {_vb("v")}),
  lambda i: printf('%02x', CAST((v >> CAST(7 * i AS INT)) & 127 AS INT) + CASE WHEN i = {_vb("v")} - 1 THEN 128 ELSE 0 END)), '') AS code, v AS back
FROM (SELECT doc_id, n_chars * 7919 AS v FROM documents WHERE n_chars IS NOT NULL)"""
_LATENCY_SQL = """WITH m AS (SELECT CAST(n_chars AS DOUBLE) AS ms, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT round(avg(ms), 6) AS mean_ms, round(max(ms) FILTER (WHERE i = n // 2), 6) AS p50_ms, round(max(ms) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))), 6) AS p95_ms,
  round(1000.0 * count(*) / sum(ms), 6) AS qps FROM m"""

_STORED_SEARCHES: dict[str, tuple[str, int]] = {
    "stored_search_term": ("reed", K), "stored_search_and": ("reed AND anat", K), "stored_search_or": ("reed OR anat", K), "stored_search_and_not": ("the AND NOT reed", K),
    "stored_search_phrase": ('"of the"', K), "stored_search_not": ("NOT the", 25), "stored_search_nested": ('("of the" OR und) AND NOT (la OR reed)', K),
    "stored_search_title": ("src3 OR anat", 40), "stored_search_rare_first": ("the AND anat AND reed", K), "stored_search_all": ("NOT zzzq", 20_000),
}
_STORED_MATCHES: dict[str, str] = {
    "stored_match_term": "reed", "stored_match_phrase": '"the anea eriner"', "stored_match_not": "NOT the", "stored_match_and": "reed AND anat AND the",
    "stored_match_missing": "reed AND zzzq", "stored_match_nested": '("of the" OR und) AND NOT (la OR reed)',
}
_SEARCHES: dict[str, str] = {
    "match_term": "reed", "match_and": "reed AND anat", "match_implicit_and": "the hand", "match_or": "reed OR anat", "match_not": "NOT the",
    "match_and_not": "the AND NOT reed", "match_phrase2": '"of the"', "match_phrase3": '"the anea eriner"', "match_repeated_phrase": '"the the"',
    "match_one_word_phrase": '"reed"', "match_nested": '("of the" OR und) AND NOT (la OR reed)', "match_missing_term": "zzzq",
    "match_missing_in_and": "reed AND zzzq", "match_missing_in_phrase": '"the zzzq"', "empty_phrase": 'reed AND ""', "empty_phrase_or": 'reed OR ""',
    "not_empty_phrase": 'NOT ""', "match_punctuated": "e-mail OR reed", "match_quoted_operator": '"and" AND reed', "match_unclosed": '"of the',
}
_ALGEBRA: dict[str, str] = {
    "set_term": "reed", "set_intersection": "reed AND anat", "set_union": "reed OR anat", "set_complement": "NOT the", "set_difference": "the AND NOT reed",
    "set_phrase_join": '"the anea eriner"', "set_nested": '("of the" OR und) AND NOT (la OR reed)',
}
_RANKINGS: dict[str, str] = {
    "bm25_term": "reed", "bm25_and": "reed AND anat", "bm25_or": "reed OR anat", "bm25_phrase": '"of the"', "bm25_nested_not": "NOT (the AND NOT reed)",
    "bm25_double_not": "NOT NOT reed", "bm25_pure_not": "NOT the", "bm25_other_branch": "reed OR (anat AND the)", "bm25_repeated_term": "reed reed",
    "bm25_unknown_term": "zzzq OR reed",
}
_TOPS: dict[str, tuple[str, int]] = {"topk": ("reed AND anat", K), "topk_ties": ("NOT the", 25), "topk_or": ("reed OR anat", 50), "topk_zero": ("reed", 0)}


def queries() -> dict[str, Query]:
    plain = (
        tokenize, positions, postings, doc_freq, doc_store, corpus_stats, term_lookup, positions_fetch, naive_size, compressed_size, compression_ratio,
        term_sizes, doc_gaps, position_gaps, skip_table, encoded_sizes, idf, term_weights, topk_with_metadata, batch_search, tsv_fields, clean_truncate,
        doc_len_of_corpus, stored_report, stored_stats, stored_terms, stored_docs, stored_postings, stored_lookup, stored_batch, service_answers, service_results,
        result_text, workload_hits, latencies, read_tsv_file, write_read_tsv, read_dump_file, read_dump_limit, synthetic_corpus, variable_bytes, empty_query,
        syntax_errors, clamped,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {name: _match(q) for name, q in _SEARCHES.items()}
    out |= {name: _algebra(q) for name, q in _ALGEBRA.items()}
    out |= {name: _scores(q) for name, q in _RANKINGS.items()}
    out["bm25_params"] = _scores("reed OR anat", k1=2.0, b=0.3)
    out |= {name: _top(q, k) for name, (q, k) in _TOPS.items()}
    out |= {name: _stored_search(q, k) for name, (q, k) in _STORED_SEARCHES.items()}
    out |= {name: _stored_match(q) for name, q in _STORED_MATCHES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {
        "tokenize": f"WITH {_TOK} SELECT doc_id, CAST(len(ts) AS BIGINT) AS length, array_to_string(ts, ' ') AS tokens FROM tok",
        "positions": f"WITH {_POS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM pos",
        "postings": f"""WITH {_POST} SELECT p.term, p.doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions,
  CAST(any_value(l.doc_len) AS BIGINT) AS doc_len FROM pos p JOIN lens l USING (doc_id) GROUP BY p.term, p.doc_id""",
        "doc_freq": f"WITH {_POST} SELECT term, doc_freq FROM terms",
        "doc_store": f"WITH {_TOK} SELECT doc_id, '' AS title, '' AS url, CAST(len(ts) AS BIGINT) AS length FROM tok",
        "corpus_stats": f"""WITH {_POST} SELECT count(*) AS num_docs, (SELECT count(*) FROM terms) AS num_terms, CAST(sum(doc_len) AS BIGINT) AS total_tokens,
  CAST(sum(doc_len) AS DOUBLE) / count(*) AS avg_doc_len FROM lens""",
        "term_lookup": f"WITH {_POST} SELECT term, doc_freq FROM terms WHERE term IN ('anat', 'reed', 'the', 'zzzq')",
        "positions_fetch": f"WITH {_POS} SELECT doc_id, CAST(pos AS BIGINT) AS pos FROM pos WHERE term = 'reed'",
        "naive_size": f"WITH {_POST} SELECT CAST(sum(4 * (2 + tf)) AS BIGINT) AS naive_bytes FROM post",
        "compressed_size": f"WITH {_CODED} SELECT CAST(sum(encoded_bytes) AS BIGINT) AS postings_bytes, CAST(sum(naive_bytes) AS BIGINT) AS naive_bytes FROM term_bytes",
        "compression_ratio": f"WITH {_CODED} SELECT round(100.0 * (1.0 - CAST(sum(encoded_bytes) AS DOUBLE) / CAST(sum(naive_bytes) AS DOUBLE)), 6) AS shrink FROM term_bytes",
        "term_sizes": f"WITH {_CODED} SELECT term, doc_freq, encoded_bytes, naive_bytes FROM term_bytes",
        "doc_gaps": f"WITH {_CODED} SELECT term, doc_id, doc_id - prev AS gap FROM gapped",
        "position_gaps": f"WITH {_CODED} SELECT term, doc_id, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY pos) AS gaps FROM posgaps GROUP BY term, doc_id",
        "skip_table": f"WITH {_CODED} SELECT term, nth, skip_doc, skip_offset FROM skips",
        "encoded_sizes": f"SELECT doc_id, {_vb('doc_id')} AS a, {_vb('n_chars')} AS b, {_vb('(n_chars * 7919)')} AS c FROM documents",
        "idf": f"WITH {_POST}, {_TOTALS} SELECT term, round(ln((n - doc_freq + 0.5) / (doc_freq + 0.5) + 1.0), 6) AS idf FROM terms, totals",
        "term_weights": f"""WITH {_POST}, {_TOTALS} SELECT p.term, p.doc_id, round(ln((n - t.doc_freq + 0.5) / (t.doc_freq + 0.5) + 1.0) * (p.tf * 2.2)
  / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.doc_len / avgdl)), 6) AS weight
  FROM post p JOIN terms t USING (term) JOIN lens l USING (doc_id), totals WHERE p.term IN ('anat', 'reed', 'the')""",
        "topk_with_metadata": _pages_sql(),
        "batch_search": _batch_sql(),
        "tsv_fields": _TSV_SQL,
        "clean_truncate": _CLEAN_SQL,
        "bm25_params": _scores_sql("reed OR anat", k1=2.0, b=0.3),
        "doc_len_of_corpus": f"WITH {_POST} SELECT count(*) AS num_docs, round(CAST(sum(doc_len) AS DOUBLE) / count(*), 6) AS avg_doc_len FROM lens",
        "stored_report": f"""WITH {_TITLED_CODED} SELECT (SELECT count(*) FROM lens) AS num_docs, count(*) AS num_terms, (SELECT CAST(sum(doc_len) AS BIGINT) FROM lens) AS total_tokens,
  CAST(sum(encoded_bytes) AS BIGINT) AS postings_bytes, CAST(sum(naive_bytes) AS BIGINT) AS naive_bytes FROM term_bytes""",
        "stored_stats": f"WITH {_TITLED} SELECT count(*) AS num_docs, CAST(sum(doc_len) AS BIGINT) AS total_tokens, round(CAST(sum(doc_len) AS DOUBLE) / count(*), 6) AS avg_doc_len FROM lens",
        "stored_terms": f"WITH {_TITLED_CODED} SELECT term, doc_freq, encoded_bytes, naive_bytes FROM term_bytes",
        "stored_docs": f"WITH {_TITLED} SELECT doc_id, {_NAMES}, CAST(doc_len AS BIGINT) AS length FROM lens JOIN documents d USING (doc_id)",
        "stored_postings": f"""WITH {_TITLED_CODED} SELECT p.term, p.doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions,
  CAST(any_value(l.doc_len) AS BIGINT) AS doc_len, CAST(any_value(b.pos_bytes) AS BIGINT) AS position_bytes
  FROM pos p JOIN lens l USING (doc_id) JOIN lists b ON b.term = p.term AND b.doc_id = p.doc_id GROUP BY p.term, p.doc_id""",
        "stored_lookup": f"WITH {_TITLED} SELECT v.term, t.doc_freq FROM (VALUES ('anat'), ('reed'), ('the'), ('zzzq')) v(term) LEFT JOIN terms t ON t.term = v.term",
        "stored_batch": _stored_batch_sql(),
        "service_answers": _answers_sql(False),
        "service_results": _answers_sql(True),
        "result_text": f"""WITH {_TITLED}, {_TOTALS}, {_scored_ctes(Q.parse(FLAGSHIP))}, best AS (
  SELECT {_RANKED} AS rank, score, {_NAMES} FROM scored JOIN documents d USING (doc_id) QUALIFY rank <= {K}
), listed AS (
  SELECT rank, 0 AS second, printf('%2d. [%.4f] %s', rank, score, title) AS value FROM best UNION ALL SELECT rank, 1, '        ' || url FROM best WHERE url <> ''
) SELECT row_number() OVER (ORDER BY rank, second) - 1 AS line, value FROM listed""",
        "workload_hits": _hits_sql(),
        "latencies": _LATENCY_SQL,
        "read_tsv_file": _READ_SQL,
        "write_read_tsv": f"SELECT CAST(n AS BIGINT) AS doc_id, coalesce(source, '') AS title, coalesce(lang, '') AS url, line AS text FROM ({_LINED})",
        "read_dump_file": _DUMP_SQL,
        "read_dump_limit": f"SELECT * FROM ({_DUMP_SQL}) WHERE doc_id < 7",
        "synthetic_corpus": "SELECT CAST(2000 AS BIGINT) AS docs, CAST(15 AS BIGINT) AS least, CAST(40 AS BIGINT) AS most, CAST(2000 AS BIGINT) AS fit, CAST(68 AS BIGINT) AS words",
        "variable_bytes": _BYTES_SQL,
        "empty_query": "SELECT CAST(0 AS BIGINT) AS docid, 0.0 AS score, '' AS title, '' AS url WHERE false",
        "syntax_errors": "SELECT * FROM (VALUES " + ", ".join(f"({_text(q)}, {_text(e)})" for q, e in BROKEN.items()) + ") v(query, error)",
        "clamped": "SELECT given, CAST(CASE WHEN regexp_full_match(given, '-?[0-9]+') THEN least(greatest(CAST(given AS INT), 1), 50) ELSE 10 END AS BIGINT) AS k FROM (VALUES "
        + ", ".join(f"('{k}')" for k in CLAMPED) + ") v(given)",
    }
    out |= {name: _match_sql(q) for name, q in (_SEARCHES | _ALGEBRA).items()}
    out |= {name: _scores_sql(q) for name, q in _RANKINGS.items()}
    out |= {name: _top_sql(q, k) for name, (q, k) in _TOPS.items()}
    out |= {name: _stored_sql(q, k) for name, (q, k) in _STORED_SEARCHES.items()}
    out |= {name: f"WITH {_TITLED_POS} SELECT doc_id FROM ({_set_sql(Q.parse(q))})" for name, q in _STORED_MATCHES.items()}
    return out
