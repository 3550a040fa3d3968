"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows its predecessor kept, from Parquet, and returns a table that is written
as Parquet again. All but the last return the columns of ``documents``.

1. ``language``: texts in no known language go: those without a letter and those whose cosine with
   the nearest profile is below ``MIN_SCORE``.
2. ``lines``: later repeats of runs of lines are cut out; a document of which nothing is left goes.
3. ``near_duplicates``: of documents whose five-word shingles are alike to 0.8 or more, the one with
   the smallest id stays.
4. ``mix``: documents are taken as often as the target weights of their sources ask for.
5. ``pack``: the pieces of all documents in sequences of 1024 tokens, ids as bytes.

A stage may be called only when its predecessor's result is stored: it first deletes the working
tables of all stages before.

Rows with NULL or empty texts end in stage 1. Repeated rows are documents of their own: the later
ones lose their lines or fall to the near-duplicate stage. An empty table passes through all stages.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import lang_id, line_dedup, mixing, packing, simhash
from loanloom.llm.common import fresh, kept, sweep, table, word_count

MIN_SCORE = 0.1
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    learned = lang_id.profiles(docs.where(~lang_id.held_out(F.col("doc_id"))))
    copy, pred, score = (fresh(name, docs.columns) for name in ("_text", "_lang_pred", "_score"))
    judged = lang_id.predict(docs.withColumn(copy, F.col("text")), learned, copy, pred, score)
    return judged.where((F.col(pred) != lang_id.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occurred before; ``n_chars`` follows the text."""
    runs = fresh("_runs", docs.columns)
    short = line_dedup.dedup_lines(docs, runs_as=runs)
    emptied = F.col(runs).isNotNull() & (word_count(F.col("text")) == 0)
    short = short.where(~emptied)
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.when(F.col(runs).isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return short.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in documents and sequences, and their token ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def _after_storing(stage):
    """The stage, once the tables its predecessors left for their results are gone."""
    @wraps(stage)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        return stage(spark, docs, sf_dir)
    return step


STAGES = [(name, _after_storing(stage)) for name, stage in (
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack))]

# language profiles, similarity components and tokenisation are beyond SQL; a test holds run()
# against a brute-force version of every stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
