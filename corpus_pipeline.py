"""A training-data pipeline from five of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the next
one's ``docs``. All but the last return the columns of ``documents``.

1. toxicity: a classifier learned on the labels goes over all documents; those at or over 0.3 are dropped.
2. line_dedup: runs of lines of 50 words or more that stand in an earlier document are cut; a document of which
   nothing is left is dropped.
3. near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, that with the
   smallest id of each class stays.
4. decontamination: spans of ten or more words that benchmark items hold are cut; a document more than half of which
   they cover is dropped.
5. tokens: SentencePiece ids of each document, with the proof that they decode to its text.

A stage's intermediate tables are deleted when the next stage is called, so its result must have been written by then;
those of other operators are not touched. Two runs must not take turns in one process.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontamination, line_dedup, ngram_join, sentencepiece, toxicity
from loomspan.llm.base import Scratch, free_name

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC, COVERAGE = 0.3, 0.5


#: What the last stage's result still reads. It goes when the next stage begins, by when that result has been written.
_left: list[Scratch] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that closes the tables that the stage before it left, and notes its own."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().close()
        with Scratch.collected(_left):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts get the prior, which is under the limit: they stay. Repeated rows: judged alike. Empty table:
    empty result. Very long texts: scored whole. Extra columns pass through, whatever their names."""
    score = free_name(docs, "_toxicity")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, out=score).filter(F.col(score) < TOXIC).select(*docs.columns)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay. A row all of whose lines stand earlier goes; rows equal in id and text share their fate."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no shingles, are like nothing and stay, as do rows with a null id."""
    return ngram_join.keep_one(docs, n=5, percent=80)


@_stage
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay; a text that is nothing but a passage goes."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_coverage=COVERAGE)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have null ids and n_tokens; empty ones no ids."""
    model = sentencepiece.PieceModel.load()
    back = free_name(docs, "_decoded")
    encoded = sentencepiece.encode(docs, model, decoded=back)
    return encoded.select(*docs.columns, "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), F.col(back).eqNullSafe(F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("tokens", tokenize),
]

#: SQL can express neither a trained classifier nor the tokenizer; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through Parquet in the shared folder."""
    results = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for n, (name, stage) in enumerate(STAGES):
        docs = results.save(stage(spark, docs, sf_dir), f"{n}-{name}")
        if n:
            results.drop(f"{n - 1}-{STAGES[n - 1][0]}")
    return docs
