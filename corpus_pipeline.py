"""From raw documents to a training corpus, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
what its stage keeps. Each result is written as Parquet and read again as the docs
of the next stage. All stages but the last return the columns of documents; the last
adds the sampling rate. No stage needs more than what its predecessor kept, and the
tables labels and benchmark beside it.

Null doc_id, null or empty text: such documents pass all stages, as no stage can tell
anything against them. Rows that repeat a doc_id share its decisions. Texts of any length
are read whole by every stage. Ties go to the least doc_id: it is the first occurrence of
a line and the copy that stays. Other columns pass through, whatever their names. An empty
table passes as an empty table.

The stages' results lie in a folder of the run's own below spark.checkpoint.dir. A stage's
input goes once its result is written; the last result stays, as the returned DataFrame
reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.common import table
from lexiloom.llm.decontam import decontaminate
from lexiloom.llm.linededup import line_dedup
from lexiloom.llm.minhash import near_dedup
from lexiloom.llm.mixing import mixed
from lexiloom.llm.toxicity import drop_toxic
from lexiloom.shared import remove, shared_folder

#: Toxic documents have gone before, so the mixture is one of the two other domains.
TARGETS = {"high": 0.9, "low": 0.1}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents of nothing else go too."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; near copies of which only scraps are left count as what they were."""
    return near_dedup(docs, table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which they meet the target weights."""
    return mixed(docs, table(spark, sf_dir, "labels"), TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", repeated_lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Trained classifiers and MinHash can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
